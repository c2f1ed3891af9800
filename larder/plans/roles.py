"""The standard tables in the roles of foods, nutrients, portions, recipes and log.

Each role is a list of plain SQL expressions over one table, so the Spark side and
the reference SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_LABEL = """CASE p_size % 8 WHEN 0 THEN 'raw' WHEN 1 THEN 'cooked' WHEN 2 THEN 'boiled'
    WHEN 3 THEN 'fried' WHEN 4 THEN 'dried' WHEN 5 THEN 'roasted' END"""

FOODS = {
    "fdc_id": "p_partkey",
    "data_type": """CASE WHEN p_size <= 16 THEN 'foundation_food' WHEN p_size <= 33
        THEN 'sr_legacy_food' ELSE 'survey_fndds_food' END""",
    "food_category": "p_type",
    "description": """concat(p_name, ', ', lower(p_type),
        CASE p_size % 8 WHEN 0 THEN ', raw' WHEN 1 THEN ', cooked, boiled' WHEN 2 THEN ', boiled'
             WHEN 3 THEN ', fried' WHEN 6 THEN ', raw' ELSE '' END,
        CASE WHEN p_size > 45 THEN ', NFS' WHEN p_size > 40 THEN ', w/o salt'
             WHEN p_size > 35 THEN ', prep. w/ 80% lean' WHEN p_size > 30 THEN ', 3.5% fat'
             WHEN p_size > 28 THEN ', 2 % milk fat, NS as to approx size' ELSE '' END,
        CASE p_brand WHEN 'Brand#5' THEN ', KRAFTY' WHEN 'Brand#6' THEN ', Kellogg''s'
             WHEN 'Brand#8' THEN ', USDA' ELSE '' END)""",
    "base_name": """CASE WHEN p_type = 'PROMO' THEN NULL
        WHEN (p_name LIKE 'small%' OR p_name LIKE 'large%') AND p_size > 25
        THEN concat(split_part(p_name, ' ', 2), 's, ', split_part(p_name, ' ', 1), ', 80% lean')
        ELSE p_name END""",
    "food_kind": "CASE WHEN p_type = 'ECONOMY' OR (p_type = 'LARGE' AND p_size > 40) THEN 'dish' ELSE 'ingredient' END",
    "prep_label": _LABEL,
    "fat_percentage": "CASE WHEN p_brand = 'Brand#7' AND p_type = 'SMALL' THEN CAST(p_size AS DOUBLE) END",
    "brand_flagged": "p_brand = 'Brand#3'",
    "source_version": "CASE WHEN p_size <= 16 THEN '2024-04' ELSE '2021-10' END",
}

NUTRIENTS = {
    "fdc_id": "l_partkey",
    "nutrient_id": """CASE l_linenumber WHEN 1 THEN 1003 WHEN 2 THEN 1005 WHEN 3 THEN 1004
        WHEN 4 THEN 1050 WHEN 5 THEN 1008 WHEN 6 THEN 1265 ELSE 1079 END""",
    "nutrient_name": "concat('nutrient ', l_linenumber)",
    "unit_name": "CASE WHEN l_linenumber = 5 THEN 'KCAL' ELSE 'G' END",
    "nutrient_rank": "CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_linenumber * 100 AS DOUBLE) END",
    "amount": "l_quantity",
}

PORTIONS = {
    "fdc_id": "l_partkey",
    "seq_num": "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END",
    "amount": "CASE WHEN l_discount < 0.035 THEN 1.0 WHEN l_discount < 0.065 THEN NULL ELSE 2.0 END",
    "measure_unit": "CASE l_returnflag WHEN 'A' THEN 'cup' WHEN 'N' THEN 'undetermined' END",
    "modifier": """CASE WHEN l_linestatus = 'F' THEN CAST(l_suppkey AS VARCHAR(20))
        WHEN l_linenumber = 3 THEN ' ' ELSE concat('container (', l_linenumber, ' oz)') END""",
    "portion_description": """CASE WHEN l_linenumber <= 4 THEN concat('1  piece ', l_linenumber)
        ELSE 'Quantity not specified' END""",
    "gram_weight": "l_quantity - 3",
    "line_id": "concat(l_orderkey, '-', l_suppkey, '-', l_linenumber)",
}

_K = {"spark": "CAST(get_json_object(props, '$.k') AS BIGINT)",
      "duck": "CAST(json_extract_string(props, '$.k') AS BIGINT)"}
_STAMP = {"spark": "date_format(ts, \"yyyy-MM-dd'T'HH:mm\")",
          "duck": "strftime(ts, '%Y-%m-%dT%H:%M')"}
_DATE = {"spark": "date_format(ts, 'yyyy-MM-dd')", "duck": "strftime(ts, '%Y-%m-%d')"}


def _log(d: str) -> dict[str, str]:
    k = _K[d]
    return {
        "id": "event_id", "user_id": "user_id", "ts": "ts",
        "food_id": f"CASE WHEN event_type <> 'signup' THEN {k} END",
        "custom_food_id": f"CASE WHEN event_type = 'signup' THEN concat('c', {k} % 10) END",
        "logged_at": _STAMP[d], "local_date": _DATE[d],
        "grams": "value * 9.8765432101D" if d == "spark" else "value * 9.8765432101::DOUBLE",
        "portion_qty": "CASE WHEN event_type = 'purchase' THEN 2.0 END",
        "portion_label": "CASE WHEN event_type = 'purchase' THEN 'cup' END",
        "name": f"concat('food ', {k})", "emoji": "CASE WHEN event_type = 'view' THEN 'V' END",
        "energy_kcal": f"CAST({k} * 4 AS DOUBLE)", "protein_g": f"CAST({k} AS DOUBLE) / 4",
        "fat_g": f"CASE WHEN event_type = 'click' THEN NULL ELSE CAST({k} AS DOUBLE) / 8 END",
        "carb_g": f"CAST({k} AS DOUBLE) / 2",
        "deleted": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
    }


CUSTOM = {
    "id": "concat('c', s_suppkey)",
    "name": "concat(CASE WHEN s_suppkey % 2 = 0 THEN 'Home ' ELSE 'home  ' END, 'dish ', s_nationkey)",
    "brand": "CASE WHEN s_nationkey < 12 THEN s_name END",
    "emoji": "CASE WHEN s_nationkey < 5 THEN 'x' END",
    "energy_kcal": "s_acctbal / 7.3", "protein_g": "s_acctbal / 73",
    "fat_g": "CASE WHEN s_nationkey > 20 THEN NULL ELSE s_acctbal / 200 END",
    "carb_g": "s_acctbal / 50",
    "serving_g": "CASE WHEN s_nationkey >= 3 THEN CAST(s_nationkey * 10 AS DOUBLE) END",
    "serving_label": "CASE WHEN s_nationkey >= 3 THEN 'bowl' END",
    "updated_at": "s_suppkey * 7", "deleted": "CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END",
}


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source}"


FOODS_SQL = _select(FOODS, "part")
NUTRIENTS_SQL = _select(NUTRIENTS, "lineitem")
PORTIONS_SQL = _select(PORTIONS, "lineitem")
LOG_SQL = _select(_log("duck"), "events")
CUSTOM_SQL = _select(CUSTOM, "supplier")
RECIPES_SQL = "SELECT l_orderkey AS recipe_id, l_partkey AS food_id, l_quantity AS grams, l_linenumber AS pos FROM lineitem"


def _take(spark: SparkSession, folder: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, folder, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def foods(spark: SparkSession, folder: str) -> DataFrame:
    return _take(spark, folder, "part", FOODS)


def nutrients(spark: SparkSession, folder: str) -> DataFrame:
    return _take(spark, folder, "lineitem", NUTRIENTS)


def portions(spark: SparkSession, folder: str) -> DataFrame:
    return _take(spark, folder, "lineitem", PORTIONS)


def log(spark: SparkSession, folder: str) -> DataFrame:
    return _take(spark, folder, "events", _log("spark"))


def custom_foods(spark: SparkSession, folder: str) -> DataFrame:
    return _take(spark, folder, "supplier", CUSTOM)


def recipes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS recipe_id", "l_partkey AS food_id", "l_quantity AS grams", "l_linenumber AS pos")
