"""The whole catalogue published as one version, and read back through its manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import fixed
from larder.operators import catalog
from larder.plans import roles
from larder.plans.catalogue import _GROUPED, grouped
from larder.plans.nutrients import _PAIRS_SQL, _PORTIONS
from larder.plans.registry import query
from larder.plans.requests import attributes
from larder.session import fresh_path, materialise
from larder.sources import tables
from larder.sources.release import averaged, tidy_portions

# Every nutrient the wide vector knows, alternates too, and three that stay long.
_IDS = [n for ids in fixed.APP_NUTRIENTS.values() for n in ids] + [1265, 1270, 1300]
_LIST = ", ".join(map(str, _IDS))
_AT = f"(l_partkey * 7 + l_linenumber * 11 + l_suppkey) % {len(_IDS)} + 1"

_AMOUNTS = f"""amount AS (SELECT l_partkey AS fdc_id, [{_LIST}][{_AT}] AS nutrient_id, avg(l_quantity) AS amount FROM lineitem GROUP BY 1, 2)"""


def amounts(spark, sf):
    rows = roles.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("fdc_id"),
        F.element_at(F.array(*[F.lit(n) for n in _IDS]), F.expr(_AT).cast("int")).cast("long").alias("nutrient_id"),
        F.col("l_quantity").cast("double").alias("amount"))
    return averaged(rows.withColumns({
        "nutrient_name": F.concat(F.lit("nutrient "), F.col("nutrient_id")), "unit_name": F.lit("G"),
        "nutrient_rank": F.col("nutrient_id").cast("double")}))


def stored_tables(spark, sf):
    foods, items, preps = grouped(spark, sf)
    lines = roles.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("fdc_id"), F.concat(F.lit("N"), F.col("l_partkey")).alias("ingredient_code"))
    return {
        "foods": materialise(foods.withColumn("ndb_number", F.concat(F.lit("N"), F.col("fdc_id"))), "foods"),
        "items": items.withColumn("keywords", F.lit(None).cast("string")), "preps": preps,
        "nutrients": materialise(amounts(spark, sf), "nutrients"), "portions": tidy_portions(roles.portions(spark, sf)),
        "attributes": attributes(spark, sf), "input_foods": lines,
    }


def published(spark, sf):
    """The folder of a catalogue built and published from the standard tables."""
    root = fresh_path(spark, "catalogue")
    tables.publish(catalog.build_catalog(stored_tables(spark, sf), hold=materialise), root, 1)
    return root


_TABLES = f"""{_GROUPED}, {_PORTIONS}, {_PAIRS_SQL}, {_AMOUNTS},
every_item AS (SELECT merged_food_id FROM items UNION ALL SELECT fdc_id FROM foods WHERE merged_food_id IS NULL)"""


@query("catalog_published", f"""
WITH {_TABLES}
SELECT 'foods' AS name, count(*) AS n_rows, 17 AS n_columns FROM foods
UNION ALL SELECT 'merged_foods', count(*), 9 FROM every_item
UNION ALL SELECT 'food_nutrition', count(DISTINCT fdc_id), {1 + len(fixed.APP_NUTRIENTS)} FROM amount
UNION ALL SELECT 'nutrients', count(DISTINCT nutrient_id), 4 FROM amount WHERE nutrient_id IN (1265, 1270, 1300)
UNION ALL SELECT 'food_nutrients', count(*), 3 FROM amount WHERE nutrient_id IN (1265, 1270, 1300)
UNION ALL SELECT 'food_portions', count(*), 4 FROM seq
UNION ALL SELECT 'food_pairs', count(*), 4 FROM partner
UNION ALL SELECT 'index_documents', count(*), 6 FROM every_item""")
def catalog_published(spark, sf):
    """Rows and columns of every table as they are found in the published version."""
    root = published(spark, sf)
    said, out = tables.manifest(spark, root), None
    for name in sorted(said):
        table = tables.open_catalog(spark, root, name)
        counted = table.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("name"), "n_rows", F.lit(len(table.columns)).alias("n_columns"),
            F.lit(said[name]["rows"]).alias("said"))
        out = counted if out is None else out.unionByName(counted)
    # a table whose count differs from the manifest's does not appear
    return out.filter("n_rows = said").drop("said")


def _wide_sql() -> str:
    def of(n: int) -> str:
        return f"max(CASE WHEN nutrient_id = {n} THEN amount END)"

    return ", ".join(f"round(coalesce({', '.join(map(of, ids))}, NULL), 6) AS {name}" for name, ids in fixed.APP_NUTRIENTS.items())


@query("catalog_nutrition", f"WITH {_AMOUNTS} SELECT fdc_id AS food_id, {_wide_sql()} FROM amount GROUP BY fdc_id")
def catalog_nutrition(spark, sf):
    """All fifty columns of every food's vector, from the published table."""
    wide = tables.open_catalog(spark, published(spark, sf), "food_nutrition")
    return wide.select("food_id", *[F.round(c, 6).alias(c) for c in fixed.APP_NUTRIENTS])


@query("catalog_rows_read", f"""
WITH {_GROUPED}
SELECT fdc_id AS food_id, description, coalesce(merged_food_id, fdc_id) AS merged_food_id FROM foods WHERE data_type = 'survey_fndds_food'""")
def catalog_rows_read(spark, sf):
    """One data type's foods, read from the published table with three of its columns."""
    root = published(spark, sf)
    return tables.read_table(spark, tables.catalog_path(spark, root, "foods"),
                             "food_id long, description string, data_type string, merged_food_id long",
                             ["food_id", "description", "merged_food_id"], F.col("data_type") == "survey_fndds_food")
