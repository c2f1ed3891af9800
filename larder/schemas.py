"""Table schemas, declared once, and the helper that makes a frame fit one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DateType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType, TimestampType)

from larder.fixed import APP_NUTRIENTS

_TYPES = {
    "long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType(),
    "boolean": BooleanType(), "date": DateType(), "timestamp": TimestampType(),
    "array<int>": ArrayType(IntegerType()),
}


def _schema(columns: str) -> StructType:
    """``name type, …`` as a schema; unlike a DDL parse this needs no session."""
    pairs = [c.split() for c in columns.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


NUTRIENT_DDL = ", ".join(f"{name} double" for name in APP_NUTRIENTS)

FOODS_IN = _schema(
    "fdc_id long, data_type string, food_category string, description string, "
    "publication_date date, ndb_number string, food_code string, wweia_category_number string, "
    "start_date date, end_date date, usda_footnote string, fat_g double, source_version string"
)
FOODS = _schema(
    "fdc_id long, data_type string, food_category string, description_raw string, "
    "description string, fat_percentage double, brand_flagged boolean, source_version string, "
    "fat_g double, publication_date date, ndb_number string, food_code string, "
    "wweia_category_number string, start_date date, end_date date, usda_footnote string, "
    "base_name string, base_key string, food_kind string, prep_label string, canon_by string, "
    "merged_food_id long, prep_id long, updated_at timestamp"
)
NUTRIENTS = _schema(
    "fdc_id long, nutrient_id long, nutrient_name string, unit_name string, "
    "nutrient_rank double, amount double"
)
PORTIONS = _schema(
    "fdc_id long, seq_num long, measure_unit string, portion_description string, "
    "modifier string, gram_weight double, data_points long, footnote string"
)
ATTRIBUTES = _schema("fdc_id long, seq_num long, attribute_type string, name string, value string")
INPUT_FOODS = _schema(
    "fdc_id long, seq_num long, fdc_of_input_food long, amount double, ingredient_code string, "
    "ingredient_description string, unit string, portion_description string, "
    "gram_weight double, retention_code string"
)
METADATA = _schema(
    "fdc_id long, ndb_number string, food_code string, wweia_category_number string, "
    "start_date date, end_date date, usda_footnote string"
)
ITEMS = _schema(
    "merged_food_id long, member_key string, n_foods int, n_preps int, food_category string, "
    "variable_fat boolean, brand_flagged boolean, display_name string, emoji string, "
    "commonness double, keywords string, confidence double, review_status string, "
    "human_verified boolean, dissolved boolean, enriched_by string, enriched_reasoning string, "
    "source_version string, updated_at timestamp"
)
PREPS = _schema(
    "prep_id long, merged_food_id long, seq int, n_foods int, prep_type string, "
    "protein_g double, carb_g double, fat_g double"
)
LINKS = _schema("fdc_id long, merged_food_id long, prep_id long")
AUDIT = _schema(
    "fdc_id long, field string, old_value string, new_value string, actor string, "
    "source_version string, run_id string, timestamp timestamp"
)
CLEANUP = _schema("fdc_id long, rule string, old_text string, new_text string, run_id string")
CUSTOM_FOODS = _schema(
    "id string, name string, brand string, barcode string, emoji string, variable_fat boolean, "
    f"serving_g double, serving_label string, {NUTRIENT_DDL}, updated_at long, "
    "deleted int, dirty int"
)
RECIPE_INGREDIENTS = _schema(
    "recipe_id string, seq int, food_id long, custom_food_id string, grams double"
)
RECIPE_STEPS = _schema("recipe_id string, seq int, text string, duration_s int")
STEP_INGREDIENTS = _schema("recipe_id string, step_seq int, ingredient_seq int")
LOG_ENTRIES = _schema(
    "id string, food_id long, custom_food_id string, logged_at string, local_date string, "
    "grams double, portion_qty double, portion_label string, name string, emoji string, "
    f"{NUTRIENT_DDL}, updated_at long, deleted int, dirty int"
)
DETECTION = _schema(
    "instance_id string, name string, search_term string, emoji string, grams double, "
    "confidence double, kcal_100g double, protein_100g double, carb_100g double, "
    "fat_100g double, shots array<int>"
)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select the schema's columns in order, cast, with typed NULLs for absent ones."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
