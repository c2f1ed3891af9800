"""Several release archives, read into one set of conformed tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder import fixed, schemas
from larder.functions.casts import column_containing, optional, safe_date, safe_float, safe_int
from larder.operators.relational import keep_first
from larder.sources.archives import csv_text, needed_files


@dataclass(frozen=True)
class Release:
    data_type: str
    version: str
    folder: str


def one_measure(amount: Column, description: Column) -> Column:
    """Portions of exactly one unit; an unknown answer drops the row."""
    return F.coalesce(
        (amount == 1) | (amount.isNull() & description.startswith("1 ")), F.lit(False)
    )


def real_unit(unit: Column) -> Column:
    return F.when(unit != "undetermined", unit)


def real_modifier(modifier: Column) -> Column:
    return F.when(~modifier.rlike(r"^\d+$"), modifier)


def tidy_portions(portions: DataFrame) -> DataFrame:
    """The same rules over stored portions that still carry their ``amount``."""
    return portions.filter(one_measure(F.col("amount"), F.col("portion_description"))).withColumns({
        "measure_unit": real_unit(F.col("measure_unit")),
        "modifier": real_modifier(F.col("modifier")),
    })


def nutrient_lookup(nutrients: DataFrame) -> DataFrame:
    """One key over both id spaces: modern ids and legacy numbers, modern first.

    The key stays a double because some legacy numbers are fractional.
    """
    base = nutrients.select(
        safe_int(F.col("id")).alias("nutrient_id"),
        F.col("name").alias("nutrient_name"),
        F.col("unit_name"),
        safe_float(optional(nutrients, "rank")).alias("nutrient_rank"),
        safe_float(optional(nutrients, "nutrient_nbr")).alias("nbr"),
    ).dropna(subset=["nutrient_id"])
    keys = F.array(
        F.struct(F.col("nutrient_id").cast("double").alias("join_key"), F.lit(0).alias("priority")),
        F.struct(F.col("nbr").alias("join_key"), F.lit(1).alias("priority")),
    )
    both = base.select("*", F.inline(keys)).dropna(subset=["join_key"]).drop("nbr")
    return keep_first(both, ["join_key"], ["priority", "nutrient_id"]).drop("priority")


def labelled(df: DataFrame, code: str, lookup: DataFrame | None, label: str) -> DataFrame:
    """Add the label of a coded column, NULL where the code is unknown."""
    if lookup is None or code not in df.columns:
        return df.withColumn(label, F.lit(None).cast("string"))
    pairs = lookup.select(safe_int(F.col("id")).alias("_code"), F.col("name").alias(label))
    return df.withColumn("_code", safe_int(F.col(code))).join(
        keep_first(pairs.dropna(subset=["_code"]), ["_code"], [label]), "_code", "left"
    ).drop("_code")


def survey_categories(survey: DataFrame, names: DataFrame) -> DataFrame | None:
    """Food -> category through its survey code; columns are found by part of their name."""
    code = column_containing(survey.columns, "wweia", "categ")
    text = column_containing(names.columns, "descri")
    name_code = column_containing(names.columns, "categ", skip=text)
    if not (code and text and name_code):
        return None
    left = survey.select(safe_int(F.col("fdc_id")).alias("fdc_id"), safe_int(F.col(code)).alias("code"))
    right = names.select(safe_int(F.col(name_code)).alias("code"), F.col(text).alias("survey_category"))
    return left.join(right, "code", "left").drop("code")


def _metadata(df: DataFrame) -> DataFrame:
    return df.select(
        safe_int(F.col("fdc_id")).alias("fdc_id"),
        optional(df, "NDB_number").alias("ndb_number"),
        optional(df, "food_code").alias("food_code"),
        optional(df, "wweia_category_number").alias("wweia_category_number"),
        safe_date(optional(df, "start_date")).alias("start_date"),
        safe_date(optional(df, "end_date")).alias("end_date"),
        optional(df, "footnote").alias("usda_footnote"),
    )


def _own_foods(spark: SparkSession, files: dict[str, str], release: Release) -> DataFrame:
    """Foods of the release's own type, as its food table has them."""
    raw = csv_text(spark, files["food.csv"])
    return raw.select(
        safe_int(F.col("fdc_id")).alias("fdc_id"),
        "data_type", "description",
        safe_int(optional(raw, "food_category_id")).alias("food_category_id"),
        safe_date(optional(raw, "publication_date")).alias("publication_date"),
    ).filter(F.col("data_type") == release.data_type)


def _foods(spark: SparkSession, files: dict[str, str], release: Release) -> DataFrame:
    foods = _own_foods(spark, files, release)
    if "food_category.csv" in files:
        categories = csv_text(spark, files["food_category.csv"])
        foods = foods.join(
            categories.select(safe_int(F.col("id")).alias("food_category_id"),
                              F.col("description").alias("food_category")),
            "food_category_id", "left",
        )
    else:
        foods = foods.withColumn("food_category", F.lit(None).cast("string"))

    if release.data_type == "survey_fndds_food" and {
        "survey_fndds_food.csv", "wweia_food_category.csv"
    } <= set(files):
        survey = survey_categories(csv_text(spark, files["survey_fndds_food.csv"]),
                                   csv_text(spark, files["wweia_food_category.csv"]))
        if survey is not None:
            foods = foods.join(survey, "fdc_id", "left").withColumn(
                "food_category", F.coalesce("food_category", "survey_category")
            )

    metadata = fixed.METADATA_FILES.get(release.data_type)
    if metadata in files:
        foods = foods.join(_metadata(csv_text(spark, files[metadata])), "fdc_id", "left")
    return foods.withColumn("source_version", F.lit(release.version))


def _nutrients(spark: SparkSession, files: dict[str, str]) -> DataFrame | None:
    if not {"food_nutrient.csv", "nutrient.csv"} <= set(files):
        return None
    raw = csv_text(spark, files["food_nutrient.csv"])
    amounts = raw.select(
        safe_int(F.col("fdc_id")).alias("fdc_id"),
        safe_float(F.col("nutrient_id")).alias("join_key"),
        safe_float(F.col("amount")).alias("amount"),
    ).filter(F.col("amount").isNotNull())
    lookup = nutrient_lookup(csv_text(spark, files["nutrient.csv"]))
    return amounts.join(lookup, "join_key").drop("join_key")


def averaged(amounts: DataFrame, *within_: str) -> DataFrame:
    """One row per food and nutrient: repeated measurements are averaged."""
    return amounts.groupBy("fdc_id", *within_, "nutrient_id").agg(
        F.min("nutrient_name").alias("nutrient_name"),
        F.min("unit_name").alias("unit_name"),
        F.min("nutrient_rank").alias("nutrient_rank"),
        F.avg("amount").alias("amount"),
    )


def _portions(spark: SparkSession, files: dict[str, str]) -> DataFrame | None:
    if "food_portion.csv" not in files:
        return None
    raw = csv_text(spark, files["food_portion.csv"])
    units = csv_text(spark, files["measure_unit.csv"]) if "measure_unit.csv" in files else None
    rows = labelled(raw, "measure_unit_id", units, "measure_unit")
    rows = rows.select(
        safe_int(F.col("fdc_id")).alias("fdc_id"),
        safe_int(optional(rows, "seq_num")).alias("seq_num"),
        safe_float(optional(rows, "amount")).alias("amount"),
        "measure_unit",
        optional(rows, "portion_description").alias("portion_description"),
        optional(rows, "modifier").alias("modifier"),
        safe_float(optional(rows, "gram_weight")).alias("gram_weight"),
        safe_int(optional(rows, "data_points")).alias("data_points"),
        optional(rows, "footnote").alias("footnote"),
    )
    return tidy_portions(rows)


def _attributes(spark: SparkSession, files: dict[str, str]) -> DataFrame | None:
    if "food_attribute.csv" not in files:
        return None
    raw = csv_text(spark, files["food_attribute.csv"])
    kinds = (csv_text(spark, files["food_attribute_type.csv"])
             if "food_attribute_type.csv" in files else None)
    rows = labelled(raw.drop("attribute_type"), "food_attribute_type_id", kinds, "attribute_type")
    return rows.select(
        safe_int(F.col("fdc_id")).alias("fdc_id"),
        safe_int(optional(rows, "seq_num")).alias("seq_num"),
        "attribute_type",
        optional(rows, "name").alias("name"),
        optional(rows, "value").alias("value"),
    )


def _input_foods(spark: SparkSession, files: dict[str, str]) -> DataFrame | None:
    if "input_food.csv" not in files:
        return None
    raw = csv_text(spark, files["input_food.csv"])
    prefix = "ingredient" if "ingredient_code" in raw.columns else "sr"
    text_prefix = "ingredient" if "ingredient_description" in raw.columns else "sr"
    return raw.select(
        safe_int(F.col("fdc_id")).alias("fdc_id"),
        safe_int(optional(raw, "seq_num")).alias("seq_num"),
        safe_int(optional(raw, "fdc_of_input_food")).alias("fdc_of_input_food"),
        safe_float(optional(raw, "amount")).alias("amount"),
        optional(raw, f"{prefix}_code").alias("ingredient_code"),
        optional(raw, f"{text_prefix}_description").alias("ingredient_description"),
        optional(raw, "unit").alias("unit"),
        optional(raw, "portion_description").alias("portion_description"),
        safe_float(optional(raw, "gram_weight")).alias("gram_weight"),
        optional(raw, "retention_code").alias("retention_code"),
    )


CHILDREN = {
    "nutrients": (_nutrients, schemas.NUTRIENTS),
    "portions": (_portions, schemas.PORTIONS),
    "attributes": (_attributes, schemas.ATTRIBUTES),
    "input_foods": (_input_foods, schemas.INPUT_FOODS),
}


def ingest(spark: SparkSession, releases: list[Release]) -> dict[str, DataFrame]:
    """``foods`` and its four child tables over every release, referentially whole.

    Earlier releases in the list win a food that several ship.
    """
    foods_parts, id_parts, child_parts = [], [], {name: [] for name in CHILDREN}
    for order, release in enumerate(releases):
        files, at = needed_files(spark, release.folder), F.lit(order).alias("_order")
        foods_parts.append(_foods(spark, files, release).select("*", at))
        id_parts.append(_own_foods(spark, files, release).select(
            "fdc_id", F.col("description").isNotNull().alias("described"), at))
        for name, (read, _) in CHILDREN.items():
            rows = read(spark, files)
            if rows is not None:
                child_parts[name].append(rows.select("*", at))

    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), foods_parts)
    foods = keep_first(every.dropna(subset=["fdc_id", "description"]), ["fdc_id"],
                       ["_order", "description"])
    # a child row stays if its own release has its food and some release describes it: one shuffle of the rows
    kept = reduce(DataFrame.unionByName, id_parts).dropna(subset=["fdc_id"]).groupBy("fdc_id").agg(
        F.collect_set("_order").alias("orders"), F.max("described").alias("described")).filter(
        "described").select("fdc_id", F.explode("orders").alias("_order"))
    out = {}
    for name, (_, schema) in CHILDREN.items():
        if child_parts[name]:
            rows = reduce(DataFrame.unionByName, child_parts[name]).join(kept, ["fdc_id", "_order"], "left_semi")
            rows = averaged(rows, "_order") if name == "nutrients" else rows
            out[name] = schemas.conform(rows, schema)
        else:
            out[name] = spark.createDataFrame([], schema)
    fat = out["nutrients"].filter(F.col("nutrient_id") == fixed.FAT_NUTRIENT_ID).groupBy("fdc_id").agg(
        F.max("amount").alias("fat_g")
    )
    return {"foods": schemas.conform(foods.join(fat, "fdc_id", "left"), schemas.FOODS_IN), **out}
