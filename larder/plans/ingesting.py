"""Three releases written as CSV from the standard tables, and read back as one set of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.plans import roles
from larder.plans.registry import query
from larder.session import fresh_path, materialise
from larder.sources.release import Release, ingest

NUTRIENTS = "(VALUES (1003, 'Protein', 203.0, 600), (1004, 'Fat', 204.0, 800), (1005, 'Carbohydrate, by difference', 205.0, 1110), (1050, 'Carbohydrate, other', 205.2, 1120), (1093, 'Sodium', 307.0, 5800))"

# Sizes up to 16 are one release, those up to 33 a second, the rest a third that codes nutrients by legacy number.
_SIDE = {"foundation": "p_size <= 16", "legacy": "p_size BETWEEN 17 AND 33", "survey": "p_size > 33"}
_KIND = {"foundation": "foundation_food", "legacy": "sr_legacy_food", "survey": "survey_fndds_food"}
_VERSION = {"foundation": "2024-04-18", "legacy": "2018-04-01", "survey": "2024-10-31"}
_DESCRIPTION = "concat('\"', p_name, '\", ', lower(p_type), CASE WHEN p_size % 5 = 0 THEN chr(10) ELSE '' END, 'x')"
_CODE = "CASE l_linenumber WHEN 1 THEN 1003 WHEN 2 THEN 1005 WHEN 3 THEN 1004 WHEN 4 THEN 1050 ELSE 1093 END"
_AMOUNT = "CASE WHEN l_discount > 0.08 THEN NULL ELSE l_quantity END"
#: Rows of one file: cells may hold line ends, so a file is read by one task.
FILE_ROWS = 250_000
#: Releases that a session has written, by its id and the tables' folder.
_written: dict = {}


def releases(spark, sf):
    """Every part is in one release, each table a folder of CSV files, written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _written:
        lines = materialise(_lines(spark, sf), "lines")
        _written[key] = [_release(spark, sf, side, lines) for side in _SIDE]
    return _written[key]


def _lines(spark, sf):
    """Order lines with the size of their part, which says the release; met once for all tables of the releases."""
    part = roles.table(spark, sf, "part").selectExpr("p_partkey AS l_partkey", "p_size")
    return roles.table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus").join(part, "l_partkey")


def _release(spark, sf, side, lines):
    folder, when, kind = fresh_path(spark, side), _SIDE[side], _KIND[side]
    part = roles.table(spark, sf, "part")
    nutrients = spark.sql(f"SELECT col1 AS id, col2 AS name, 'G' AS unit_name, col3 AS nutrient_nbr, col4 AS rank FROM {NUTRIENTS}")
    units = spark.sql("SELECT col1 AS id, col2 AS name FROM (VALUES (1, 'cup'), (9999, 'undetermined'))")
    own = part.filter(when)
    foods = own.selectExpr("concat(p_partkey, '.0') AS fdc_id", f"CASE WHEN p_size % 7 = 0 THEN 'sub_sample_food' ELSE '{kind}' END AS data_type",
                           f"{_DESCRIPTION} AS description", "CASE WHEN p_size < 10 THEN p_size END AS food_category_id",
                           "CASE WHEN p_size = 12 THEN 'n/a' ELSE '2020-10-30' END AS publication_date")
    # beside the foods, rows without a number, with none that can be read, and without a description
    nameless = own.filter("p_size % 7 = 2").selectExpr(
        "CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'n/a' ELSE concat(p_partkey + 5000000, '') END AS fdc_id",
        f"'{kind}' AS data_type", "CASE WHEN p_size % 3 = 2 THEN NULL ELSE p_name END AS description", "NULL AS food_category_id",
        "'2020-10-30' AS publication_date")
    mine = lines.filter(when)
    code = F.expr(_CODE)
    if side == "survey":
        legacy = nutrients.select(F.col("id").alias("code"), "nutrient_nbr")
        amounts = mine.withColumn("code", code).join(legacy, "code").select(
            F.col("l_partkey").alias("fdc_id"), F.col("nutrient_nbr").alias("nutrient_id"), F.expr(_AMOUNT).alias("amount"))
    else:
        amounts = mine.select(F.col("l_partkey").alias("fdc_id"), code.cast("double").alias("nutrient_id"), F.expr(_AMOUNT).alias("amount"))
    # and amounts of no food, of no nutrient, of a food that is nowhere
    lost = mine.filter("l_linenumber = 1").selectExpr(
        "CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN l_partkey + 7000000 ELSE l_partkey END AS fdc_id",
        "CASE WHEN l_suppkey % 3 = 2 THEN NULL ELSE 1003.0D END AS nutrient_id", "l_quantity AS amount")
    portions = mine.selectExpr(
        "l_partkey AS fdc_id", "l_linenumber AS seq_num", "CASE WHEN l_discount < 0.035 THEN 1.0 WHEN l_discount < 0.065 THEN NULL ELSE 2.0 END AS amount",
        "CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 9999 ELSE 5 END AS measure_unit_id",
        "CASE WHEN l_linenumber <= 4 THEN '1 piece' ELSE 'Quantity not specified' END AS portion_description",
        "CASE WHEN l_linestatus = 'F' THEN CAST(l_suppkey AS STRING) ELSE 'sliced' END AS modifier", "l_quantity AS gram_weight")
    tables = {"food.csv": foods.unionByName(nameless), "nutrient.csv": nutrients, "food_nutrient.csv": amounts.unionByName(lost),
              "measure_unit.csv": units, "food_portion.csv": portions}
    if side == "foundation":
        tables["food_category.csv"] = part.filter("p_size <= 6").selectExpr("p_size AS id", "concat('Category ', p_size) AS description").distinct()
        tables["foundation_food.csv"] = own.selectExpr("p_partkey AS fdc_id", "p_partkey + 10000 AS NDB_number", "concat('note', chr(10), p_size) AS footnote")
    elif side == "legacy":
        tables["sr_legacy_food.csv"] = own.selectExpr("p_partkey AS fdc_id", "p_partkey + 20000 AS NDB_number")
    else:
        tables["survey_fndds_food.csv"] = own.selectExpr(
            "p_partkey AS fdc_id", "p_partkey + 50000 AS food_code", "p_size AS wweia_category_number", "'2021-01-01' AS start_date", "'' AS end_date")
        tables["wweia_food_category.csv"] = part.filter("p_size > 40").selectExpr(
            "p_size AS wweia_food_category", "concat('Survey ', p_size) AS wweia_food_category_description").distinct()
    for name, df in tables.items():
        df.write.option("header", True).option("escape", '"').option("quoteAll", True).option(
            "maxRecordsPerFile", FILE_ROWS).csv(f"{folder}/{name}")
    return Release(kind, _VERSION[side], folder)


_SQL = f"""part_in AS (SELECT *, CASE WHEN p_size <= 16 THEN 'foundation_food' WHEN p_size <= 33 THEN 'sr_legacy_food' ELSE 'survey_fndds_food' END AS kind
  FROM part WHERE p_size % 7 <> 0),
code AS (SELECT col0 AS nutrient_id FROM {NUTRIENTS}),
amount AS (SELECT l_partkey AS fdc_id, {_CODE} AS nutrient_id, {_AMOUNT} AS amount FROM lineitem JOIN part_in ON p_partkey = l_partkey),
mean AS (SELECT fdc_id, nutrient_id, avg(amount) AS amount FROM amount WHERE amount IS NOT NULL GROUP BY ALL)"""


@query("ingest_foods", f"""
WITH {_SQL}
SELECT p_partkey AS fdc_id, kind AS data_type,
  CASE WHEN p_size <= 6 THEN concat('Category ', p_size) WHEN p_size > 40 THEN concat('Survey ', p_size) END AS food_category,
  {_DESCRIPTION} AS description, CASE WHEN p_size <> 12 THEN DATE '2020-10-30' END AS publication_date,
  CASE kind WHEN 'foundation_food' THEN CAST(p_partkey + 10000 AS VARCHAR) WHEN 'sr_legacy_food' THEN CAST(p_partkey + 20000 AS VARCHAR) END AS ndb_number,
  CASE WHEN kind = 'survey_fndds_food' THEN CAST(p_partkey + 50000 AS VARCHAR) END AS food_code,
  CASE WHEN kind = 'foundation_food' THEN concat('note', chr(10), p_size) END AS usda_footnote, round(amount, 6) AS fat_g,
  CASE kind WHEN 'foundation_food' THEN '2024-04-18' WHEN 'sr_legacy_food' THEN '2018-04-01' ELSE '2024-10-31' END AS source_version
FROM part_in LEFT JOIN mean ON fdc_id = p_partkey AND nutrient_id = 1004""")
def ingest_foods(spark, sf):
    foods = ingest(spark, releases(spark, sf))["foods"]
    return foods.select("fdc_id", "data_type", "food_category", "description", "publication_date", "ndb_number", "food_code",
                        "usda_footnote", F.round("fat_g", 6).alias("fat_g"), "source_version")


@query("ingest_nutrients", f"""
WITH {_SQL} SELECT fdc_id, CAST(nutrient_id AS BIGINT) AS nutrient_id, round(amount, 6) AS amount FROM mean""")
def ingest_nutrients(spark, sf):
    rows = ingest(spark, releases(spark, sf))["nutrients"]
    return rows.select("fdc_id", "nutrient_id", F.round("amount", 6).alias("amount"))


@query("ingest_portions", f"""
WITH {_SQL}
SELECT l_partkey AS fdc_id, CAST(l_linenumber AS BIGINT) AS seq_num, CASE WHEN l_returnflag = 'A' THEN 'cup' END AS measure_unit,
  CASE WHEN l_linenumber <= 4 THEN '1 piece' ELSE 'Quantity not specified' END AS portion_description,
  CASE WHEN l_linestatus <> 'F' THEN 'sliced' END AS modifier, l_quantity AS gram_weight
FROM lineitem JOIN part_in ON p_partkey = l_partkey
WHERE l_discount < 0.035 OR (l_discount < 0.065 AND l_linenumber <= 4)""")
def ingest_portions(spark, sf):
    rows = ingest(spark, releases(spark, sf))["portions"]
    return rows.select("fdc_id", "seq_num", "measure_unit", "portion_description", "modifier", "gram_weight")
