"""The published catalogue, derived from the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from larder import fixed
from larder.functions import text
from larder.operators.pairs import food_pairs, resolved_ingredients
from larder.operators.pivot import NutrientMap, long_tail, nutrient_dimension, wide
from larder.operators.relational import joined_set, numbered, within
from larder.session import materialise


def labelled_portions(portions: DataFrame, key: str = "fdc_id", hold=materialise) -> DataFrame:
    """Usable portions per food, numbered from 1; number 1 is the default serving.

    Labels are stored before they are filtered and sorted, so each is built once.
    """
    label = text.portion_label(F.col("measure_unit"), F.col("modifier"), F.col("portion_description"))
    each = hold(portions.filter(F.col("gram_weight") > 0).select(
        key, "seq_num", label.alias("label"), "gram_weight"), "labels")
    order = [F.col("seq_num").asc_nulls_last(), F.col("label"), F.col("gram_weight")]
    return numbered(each.dropna(subset=["label"]), [key], order).select(
        F.col(key).alias("food_id"), "seq", "label", "gram_weight")


def default_servings(portions: DataFrame, key: str = "fdc_id") -> DataFrame:
    """(food_id, serving_g, serving_label): the first usable portion, without sorting the rest."""
    label = text.portion_label(F.col("measure_unit"), F.col("modifier"), F.col("portion_description"))
    rows = portions.filter(F.col("gram_weight") > 0).select(key, "seq_num", "gram_weight", label.alias("label"))
    # Unlabelled portions are passed over inside the aggregate, so each label is built once.
    first = F.min(F.when(F.col("label").isNotNull(), F.struct(
        F.col("seq_num").isNull().alias("last"), "seq_num", "label", "gram_weight")))
    return rows.groupBy(F.col(key).alias("food_id")).agg(first.alias("f")).filter(F.col("f").isNotNull()).select(
        "food_id", F.col("f.gram_weight").alias("serving_g"), F.col("f.label").alias("serving_label"))


def catalog_foods(foods: DataFrame, items: DataFrame, preps: DataFrame, nutrition: DataFrame,
                  servings: DataFrame) -> DataFrame:
    """One row per food with its names, list macros and default serving beside it."""
    named = items.select("merged_food_id", "display_name", "emoji", "variable_fat", "commonness")
    labels = preps.select("prep_id", "prep_type")
    macros = nutrition.select(
        "food_id", *[F.col(c).alias(f"{c.split('_')[0].replace('energy', 'kcal')}_100g")
                     for c in fixed.LIST_MACROS])
    # The three tables keyed by food come first: they share one partitioning.
    rows = foods.withColumn("food_id", F.col("fdc_id")).join(macros, "food_id", "left").join(
        servings, "food_id", "left").join(labels, "prep_id", "left").join(named, "merged_food_id", "left")
    return rows.select(
        "food_id", "description", "display_name", "emoji", "prep_type", "variable_fat",
        F.col("food_category").alias("category"), "data_type", "commonness",
        "kcal_100g", "protein_100g", "fat_100g", "carb_100g", "serving_g", "serving_label",
        F.coalesce("merged_food_id", "food_id").alias("merged_food_id"),
        F.coalesce("prep_id", "food_id").alias("prep_id"),
    )


def catalog_items(foods: DataFrame, items: DataFrame, preps: DataFrame) -> DataFrame:
    """Every item, and an item of its own for each food that is in none."""
    default = preps.select(F.col("prep_id").alias("merged_food_id"), "prep_type")
    known = items.join(default, "merged_food_id", "left").select(
        "merged_food_id", "display_name", "emoji", "prep_type", F.col("food_category").alias("category"),
        "commonness", "variable_fat", "n_foods", "n_preps")
    alone = foods.filter(F.col("merged_food_id").isNull()).select(
        F.col("fdc_id").alias("merged_food_id"), F.col("food_category").alias("category"),
        F.lit(False).alias("variable_fat"), F.lit(1).alias("n_foods"), F.lit(1).alias("n_preps"))
    return known.unionByName(alone, allowMissingColumns=True)


def member_words(foods: DataFrame) -> DataFrame:
    """Distinct words of all member descriptions of an item.

    A set, not the texts joined: a large item must not look like a long document.
    """
    found = F.regexp_extract_all(F.lower("description"), F.lit("[a-z]+"), F.lit(0))
    each = foods.select("merged_food_id", F.explode(found).alias("word")).filter(F.length("word") > 1)
    return each.distinct().groupBy("merged_food_id").agg(
        F.array_join(F.array_sort(F.collect_list("word")), " ").alias("members"))


def index_documents(foods: DataFrame, items: DataFrame, preps: DataFrame, attributes: DataFrame,
                    keywords: DataFrame) -> DataFrame:
    """One searchable document per item: name, prep, aka, members and the fuzzy text."""
    default = foods.filter(F.col("food_id") == F.col("merged_food_id")).select(
        "merged_food_id", F.col("description").alias("default_desc"))
    values = attributes.filter(F.col("attribute_type").isin(*fixed.SYNONYM_TYPES)
                               & (F.coalesce("value", F.lit("")) != ""))
    aka = values.join(foods.select(F.col("food_id").alias("fdc_id"), "merged_food_id"), "fdc_id").select(
        "merged_food_id", "value").distinct().groupBy("merged_food_id").agg(
        joined_set(F.col("value")).alias("aka"))
    prep = preps.filter(F.col("prep_type").isNotNull()).groupBy("merged_food_id").agg(
        joined_set(F.col("prep_type"), sep=" ").alias("prep"))
    rows = (
        items.select("merged_food_id", "display_name")
        .join(default, "merged_food_id", "left").join(member_words(foods), "merged_food_id", "left")
        .join(aka, "merged_food_id", "left").join(prep, "merged_food_id", "left")
        .join(keywords.select("merged_food_id", "keywords"), "merged_food_id", "left")
    )
    name, prep_col = F.coalesce("display_name", "default_desc"), F.coalesce("prep", F.lit(""))
    return rows.select(
        "merged_food_id", name.alias("name"), prep_col.alias("prep"),
        F.concat_ws("; ", F.nullif("aka", F.lit("")), F.nullif("keywords", F.lit(""))).alias("aka"),
        F.coalesce("members", F.lit("")).alias("members"),
        F.lower(F.concat_ws(" ", name, prep_col, F.coalesce("aka", F.lit("")))).alias("trgm"),
    )


def build_catalog(tables: dict[str, DataFrame], nutrients: NutrientMap = fixed.APP_NUTRIENTS,
                  hold: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> dict[str, DataFrame]:
    """All published tables. ``hold`` may store the two that others read again.

    ``tables`` holds foods, items, preps, nutrients, portions, attributes, input_foods.
    """
    foods, items, preps = tables["foods"], tables["items"], tables["preps"]
    rows = within(tables["nutrients"], foods, "fdc_id")
    nutrition = hold(wide(rows, "fdc_id", nutrients).withColumnRenamed("fdc_id", "food_id"), "nutrition")
    portions = labelled_portions(tables["portions"])
    # the same rows as default_servings, whose labels would be built once more
    servings = portions.filter("seq = 1").select(
        "food_id", F.col("gram_weight").alias("serving_g"), F.col("label").alias("serving_label"))
    app_foods = hold(catalog_foods(foods, items, preps, nutrition, servings), "foods")
    app_items = catalog_items(foods, items, preps)
    return {
        "foods": app_foods,
        "merged_foods": app_items,
        "food_nutrition": nutrition,
        "nutrients": nutrient_dimension(tables["nutrients"], nutrients),
        "food_nutrients": long_tail(rows, "fdc_id", nutrients).withColumnRenamed("fdc_id", "food_id"),
        "food_portions": portions,
        "food_pairs": food_pairs(resolved_ingredients(tables["input_foods"], foods)),
        "index_documents": index_documents(app_foods, app_items, preps, tables["attributes"],
                                           items.select("merged_food_id", "keywords")),
    }


def portions_of(portions: DataFrame, ids: DataFrame) -> DataFrame:
    """Portions of the given foods; ``seq`` is their order within a food."""
    return portions.join(ids.select("food_id"), "food_id", "left_semi")


def nutrients_of(food_nutrients: DataFrame, nutrients: DataFrame, ids: DataFrame) -> DataFrame:
    """The nutrients outside the wide vector for the given foods, in display order."""
    return food_nutrients.join(ids.select("food_id"), "food_id", "left_semi").join(
        nutrients, "nutrient_id").select("food_id", "name", "unit", "amount", "sort_order")


def extra_nutrients(refs: DataFrame, nutrition: DataFrame, custom_foods: DataFrame) -> DataFrame:
    """Four extra columns for references to either table; an unsaved food has none."""
    cols = list(fixed.EXTRA_NUTRIENTS)
    from_catalog = refs.filter(F.col("food_id").isNotNull()).join(
        nutrition.select("food_id", *cols), "food_id")
    from_custom = refs.filter(F.col("custom_food_id").isNotNull()).join(
        custom_foods.select(F.col("id").alias("custom_food_id"), *cols), "custom_food_id")
    return from_catalog.unionByName(from_custom).select("food_id", "custom_food_id", *cols)


def representative_rows(foods: DataFrame) -> DataFrame:
    """One food per preparation: the one that gives the preparation its id."""
    return foods.filter(F.col("food_id") == F.col("prep_id"))


def attach_preparations(hits: DataFrame, foods: DataFrame) -> DataFrame:
    """Preparations of each hit and the position of its default, where there are several."""
    row = F.struct("food_id", text.prep_text(F.col("prep_type")).alias("prep"), "kcal_100g",
                   "protein_100g", "fat_100g", "carb_100g", "serving_g", "serving_label")
    wanted = hits.select(F.col("food_id").alias("merged_food_id")).dropna().distinct()
    each = representative_rows(foods).join(wanted, "merged_food_id", "left_semi").groupBy(
        "merged_food_id").agg(F.array_sort(F.collect_list(row)).alias("preps"))
    joined = hits.join(each.withColumnRenamed("merged_food_id", "food_id"), "food_id", "left")
    ids = F.transform("preps", lambda p: p["food_id"])
    at = F.array_position(ids, F.col("food_id")) - 1
    several = (F.size("preps") > 1) & (at >= 0)
    return joined.withColumns({
        "prep_index": F.when(several, at.cast("int")),
        "preps": F.when(several, F.col("preps")),
    })

