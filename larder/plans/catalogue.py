"""The published catalogue over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import catalog, pairs, pivot
from larder.plans import roles
from larder.plans.nutrients import _PORTIONS, PIVOT, PIVOT_SQL, amounts
from larder.plans.registry import query
from larder.plans.requests import _ATTRS, attributes
from larder.sources.release import tidy_portions

# Parts of one name and type are an item of two preparations, small parts are in none.
_GROUPED = f"""f AS ({roles.FOODS_SQL}), g AS (SELECT f.*, p_name, p_size FROM f JOIN part ON p_partkey = fdc_id),
foods AS (SELECT g.*, CASE WHEN p_size > 5 THEN min(CASE WHEN p_size > 5 THEN fdc_id END) OVER (PARTITION BY p_name, food_category) END AS merged_food_id,
  CASE WHEN p_size > 5 THEN min(fdc_id) OVER (PARTITION BY p_name, food_category, p_size > 5, p_size > 30) END AS prep_id FROM g),
preps AS (SELECT prep_id, merged_food_id, CASE WHEN bool_and(p_size > 30) THEN 'boiled' END AS prep_type FROM foods WHERE prep_id IS NOT NULL GROUP BY 1, 2),
items AS (SELECT merged_food_id, min(p_name) AS display_name, count(*) AS n_foods, count(DISTINCT prep_id) AS n_preps, min(food_category) AS food_category FROM foods WHERE merged_food_id IS NOT NULL GROUP BY 1)"""


def grouped(spark, sf):
    """(foods, items, preps) with the item and preparation ids of each food."""
    foods = roles.foods(spark, sf).join(roles.table(spark, sf, "part").select(
        F.col("p_partkey").alias("fdc_id"), "p_name", "p_size"), "fdc_id")
    in_item = foods.filter("p_size > 5")
    item = in_item.groupBy("p_name", "food_category").agg(F.min("fdc_id").alias("merged_food_id"))
    large = F.col("p_size") > 30
    prep = in_item.groupBy("p_name", "food_category", large.alias("large")).agg(F.min("fdc_id").alias("prep_id"))
    linked = foods.withColumn("large", F.when(F.col("p_size") > 5, large)).join(
        prep, ["p_name", "food_category", "large"], "left").join(item, ["p_name", "food_category"], "left")
    linked = linked.withColumn("merged_food_id", F.when(F.col("p_size") > 5, F.col("merged_food_id")))
    preps = prep.join(item, ["p_name", "food_category"]).select(
        "prep_id", "merged_food_id", F.when(F.col("large"), F.lit("boiled")).alias("prep_type"))
    items = linked.filter("merged_food_id IS NOT NULL").groupBy("merged_food_id").agg(
        F.min("p_name").alias("display_name"), F.count(F.lit(1)).cast("int").alias("n_foods"),
        F.count_distinct("prep_id").cast("int").alias("n_preps"), F.min("food_category").alias("food_category")).withColumns(
        {"emoji": F.lit(None).cast("string"), "variable_fat": F.lit(False), "commonness": F.lit(0.5)})
    return linked, items, preps


def nutrition(spark, sf):
    return pivot.wide(amounts(spark, sf), "fdc_id", PIVOT).withColumnRenamed("fdc_id", "food_id")


def catalog_foods_of(spark, sf):
    foods, items, preps = grouped(spark, sf)
    servings = catalog.default_servings(tidy_portions(roles.portions(spark, sf)))
    return catalog.catalog_foods(foods, items, preps, nutrition(spark, sf), servings)


@query("catalog_foods", f"""
WITH {_GROUPED}, {PIVOT_SQL}, {_PORTIONS}
SELECT f.fdc_id AS food_id, f.description, display_name, prep_type, round(energy_kcal, 6) AS kcal_100g, round(protein_g, 6) AS protein_100g, gram_weight AS serving_g, label AS serving_label,
  coalesce(f.merged_food_id, f.fdc_id) AS merged_food_id, coalesce(f.prep_id, f.fdc_id) AS prep_id
FROM foods f LEFT JOIN items m ON m.merged_food_id = f.merged_food_id LEFT JOIN preps pp ON pp.prep_id = f.prep_id
LEFT JOIN wide w ON w.fdc_id = f.fdc_id LEFT JOIN seq ON seq.food_id = f.fdc_id AND seq.seq = 1""")
def catalog_foods(spark, sf):
    return catalog_foods_of(spark, sf).select(
        "food_id", "description", "display_name", "prep_type", F.round("kcal_100g", 6).alias("kcal_100g"),
        F.round("protein_100g", 6).alias("protein_100g"), "serving_g", "serving_label", "merged_food_id", "prep_id")


@query("catalog_items", f"""
WITH {_GROUPED}
SELECT m.merged_food_id, display_name, prep_type, food_category AS category, n_foods, n_preps FROM items m LEFT JOIN preps p ON p.prep_id = m.merged_food_id
UNION ALL SELECT fdc_id, NULL, NULL, food_category, 1, 1 FROM foods WHERE merged_food_id IS NULL""")
def catalog_items(spark, sf):
    return catalog.catalog_items(*grouped(spark, sf)).select(
        "merged_food_id", "display_name", "prep_type", "category", F.col("n_foods").cast("bigint").alias("n_foods"),
        F.col("n_preps").cast("bigint").alias("n_preps"))


@query("index_documents", f"""
WITH {_GROUPED}, {_ATTRS},
cf AS (SELECT coalesce(merged_food_id, fdc_id) AS mid, fdc_id, description FROM foods),
w AS (SELECT DISTINCT mid, unnest(regexp_extract_all(lower(description), '[a-z]+')) AS word FROM cf),
mem AS (SELECT mid, string_agg(word, ' ' ORDER BY word) AS members FROM w WHERE length(word) > 1 GROUP BY 1),
aka AS (SELECT mid, string_agg(DISTINCT value, '; ' ORDER BY value) AS aka FROM a JOIN cf USING (fdc_id) WHERE attribute_type IN ('Common Name', 'Additional Description') AND value <> '' GROUP BY 1),
pl AS (SELECT merged_food_id AS mid, string_agg(DISTINCT prep_type, ' ' ORDER BY prep_type) AS prep FROM preps WHERE prep_type IS NOT NULL GROUP BY 1),
ids AS (SELECT merged_food_id AS mid, display_name FROM items UNION ALL SELECT fdc_id, NULL FROM foods WHERE merged_food_id IS NULL)
SELECT ids.mid AS merged_food_id, coalesce(display_name, cf.description) AS name, coalesce(prep, '') AS prep, coalesce(aka, '') AS aka, coalesce(members, '') AS members,
  lower(concat_ws(' ', coalesce(display_name, cf.description), coalesce(prep, ''), coalesce(aka, ''))) AS trgm
FROM ids LEFT JOIN cf ON cf.fdc_id = ids.mid LEFT JOIN mem ON mem.mid = ids.mid LEFT JOIN aka ON aka.mid = ids.mid LEFT JOIN pl ON pl.mid = ids.mid""")
def index_documents(spark, sf):
    foods, items, preps = grouped(spark, sf)
    rows = foods.select(F.col("fdc_id").alias("food_id"), F.coalesce("merged_food_id", "fdc_id").alias("merged_food_id"), "description")
    keywords = items.select("merged_food_id", F.lit(None).cast("string").alias("keywords"))
    return catalog.index_documents(rows, catalog.catalog_items(foods, items, preps), preps, attributes(spark, sf), keywords)


@query("representative_rows", f"""
WITH {_GROUPED} SELECT fdc_id AS food_id, coalesce(merged_food_id, fdc_id) AS merged_food_id FROM foods WHERE fdc_id = coalesce(prep_id, fdc_id)""")
def representative_rows(spark, sf):
    foods, _, _ = grouped(spark, sf)
    rows = foods.select(F.col("fdc_id").alias("food_id"), F.coalesce("merged_food_id", "fdc_id").alias("merged_food_id"),
                        F.coalesce("prep_id", "fdc_id").alias("prep_id"))
    return catalog.representative_rows(rows).select("food_id", "merged_food_id")


@query("extra_nutrients", f"""
WITH {PIVOT_SQL}, c AS ({roles.CUSTOM_SQL}), l AS (SELECT DISTINCT food_id, custom_food_id FROM ({roles.LOG_SQL}))
SELECT food_id, custom_food_id, round(fiber_g, 6) AS fiber_g FROM l JOIN wide ON fdc_id = food_id
UNION ALL SELECT food_id, custom_food_id, round(energy_kcal, 6) FROM l JOIN c ON c.id = custom_food_id""")
def extra_nutrients(spark, sf):
    refs = roles.log(spark, sf).select("food_id", "custom_food_id").distinct()
    none = {c: F.lit(None).cast("double") for c in ("sugar_g", "sat_fat_g", "sodium_mg")}
    own = roles.custom_foods(spark, sf).withColumn("fiber_g", F.col("energy_kcal")).withColumns(none)
    got = catalog.extra_nutrients(refs, nutrition(spark, sf).withColumns(none), own)
    return got.select("food_id", "custom_food_id", F.round("fiber_g", 6).alias("fiber_g"))


@query("nutrients_of", f"""
WITH {PIVOT_SQL}, l AS (SELECT DISTINCT food_id FROM ({roles.LOG_SQL}) WHERE food_id IS NOT NULL)
SELECT food_id, nutrient_name AS name, unit_name AS unit, round(amount, 6) AS amount FROM l JOIN nut_avg ON fdc_id = food_id
WHERE nutrient_id NOT IN (1003, 1005, 1050, 1004, 1008, 2047, 1079, 2033)""")
def nutrients_of(spark, sf):
    rows = amounts(spark, sf)
    ids = roles.log(spark, sf).select("food_id").dropna().distinct()
    tail = pivot.long_tail(rows, "fdc_id", PIVOT).withColumnRenamed("fdc_id", "food_id")
    return catalog.nutrients_of(tail, pivot.nutrient_dimension(rows, PIVOT), ids).select(
        "food_id", "name", "unit", F.round("amount", 6).alias("amount"))


@query("portions_of", f"""
WITH {_PORTIONS}, l AS (SELECT DISTINCT food_id FROM ({roles.LOG_SQL}) WHERE food_id IS NOT NULL)
SELECT food_id, CAST(seq AS BIGINT) AS seq, label, gram_weight FROM seq WHERE food_id IN (SELECT food_id FROM l)""")
def portions_of(spark, sf):
    ids = roles.log(spark, sf).select("food_id").dropna().distinct()
    rows = catalog.labelled_portions(tidy_portions(roles.portions(spark, sf)))
    return catalog.portions_of(rows, ids).withColumn("seq", F.col("seq").cast("bigint"))


@query("coded_ingredients", """
SELECT DISTINCT o_orderkey AS recipe_id, p_partkey AS food_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_type <> 'PROMO' AND l_returnflag <> 'A'""")
def coded_ingredients(spark, sf):
    lines = roles.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS fdc_id", "CASE WHEN l_returnflag = 'A' THEN '' ELSE concat('N', l_partkey) END AS ingredient_code")
    foods = roles.table(spark, sf, "part").selectExpr(
        "p_partkey AS fdc_id", "CASE WHEN p_type <> 'PROMO' THEN concat('N', p_partkey) END AS ndb_number")
    return pairs.resolved_ingredients(lines, foods)
