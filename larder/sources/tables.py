"""Stored tables: pruned reads, appended logs, versioned catalogue, row checks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from larder import fixed


def append_log(rows: DataFrame, path: str, part: str = "all") -> None:
    """Append one part of the log of a run; repeating it replaces that part of that run only."""
    (rows.withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "part").parquet(path))


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of a log, of every run and part."""
    return spark.read.schema(StructType([*schema.fields, StructField("part", StringType())])).parquet(path).drop("part")


def log_tail(log: DataFrame, n: int = 50) -> DataFrame:
    """The newest rows of an audit log."""
    return log.orderBy(F.col("timestamp").desc(), "fdc_id", "field").limit(n)


def read_table(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] | None = None,
               where: Column | None = None) -> DataFrame:
    """Some columns and rows of a stored table, which must hold the columns that are promised.

    A column that is missing or of another type is an error before anything is read. The
    filter and the choice of columns reach the scan; columns not promised are not read.
    """
    stored = spark.read.parquet(path)
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    have = {f.name: f.dataType for f in stored.schema.fields}
    wrong = [f"{f.name} {f.dataType.simpleString()} (stored: {have[f.name].simpleString() if f.name in have else 'none'})"
             for f in wanted.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{path} does not hold {', '.join(wrong)}")
    rows = stored.select(*wanted.fieldNames())
    rows = rows if where is None else rows.filter(where)
    return rows if columns is None else rows.select(*columns)


def publish(tables: Mapping[str, DataFrame], root: str, version: int,
            columns: Mapping[str, list[str]] | None = None) -> dict[str, int]:
    """Write each table whole under ``v=<version>``, then its manifest, then move the pointer to it.

    The manifest has the rows and the schema of every table. Readers see the old version
    until the pointer moves. Returns rows per table.
    """
    counts, kinds = {}, {}
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        chosen = df.select(*columns[name]) if columns and name in columns else df
        seen = Observation(name)
        (chosen.observe(seen, F.count(F.lit(1)).alias("rows"))
         .write.mode("overwrite").parquet(f"{root}/v={version}/{name}"))
        counts[name], kinds[name] = seen.get["rows"], chosen.schema.json()
    listed = spark.createDataFrame([(n, counts[n], kinds[n]) for n in counts], _MANIFEST)
    listed.coalesce(1).write.mode("overwrite").json(f"{root}/v={version}/_manifest")
    pointer = spark.range(1).select(F.lit(version).alias("version"))
    pointer.write.mode("overwrite").json(f"{root}/current")
    return counts


_MANIFEST = "name string, rows long, schema string"


def _current(spark: SparkSession, root: str) -> int:
    return spark.read.schema("version int").json(f"{root}/current").first().version


def manifest(spark: SparkSession, root: str) -> dict[str, dict]:
    """name -> rows and schema of the tables of the current version."""
    listed = spark.read.schema(_MANIFEST).json(f"{root}/v={_current(spark, root)}/_manifest").collect()
    return {r["name"]: {"rows": r["rows"], "schema": StructType.fromJson(json.loads(r["schema"]))} for r in listed}


def catalog_path(spark: SparkSession, root: str, name: str) -> str:
    return f"{root}/v={_current(spark, root)}/{name}"


def open_catalog(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(catalog_path(spark, root, name))


def split_by_rules(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a row is rejected when any rule is false.

    As with a CHECK, a rule that is NULL holds. Rejected rows name the broken rules.
    """
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()
    ]))
    judged = df.withColumn("broken", broken)
    return (judged.filter(F.size("broken") == 0).drop("broken"),
            judged.filter(F.size("broken") > 0))


def custom_food_rules(nutrients: list[str] | None = None) -> dict[str, Column]:
    """What a person's own food must satisfy; measured tables are not held to these."""
    emoji = F.col("emoji")
    rules = {
        "name": F.length(F.trim("name")) > 0,
        "serving_g": F.col("serving_g").isNull() | (F.col("serving_g") > 0),
        "serving_label": F.col("serving_label").isNull() | F.col("serving_g").isNotNull(),
        "emoji": emoji.isNull() | (F.length(emoji).between(1, fixed.MAX_EMOJI_BYTES)
                                   & ~emoji.rlike(r"^[\x00-\x7F]")),
    }
    for name in nutrients or fixed.APP_NUTRIENTS:
        rules[name] = F.col(name) >= 0
    return rules


def one_reference(food_id: Column, custom_food_id: Column) -> Column:
    return food_id.isNull() != custom_food_id.isNull()


INGREDIENT_RULES = {
    "one_reference": lambda: one_reference(F.col("food_id"), F.col("custom_food_id")),
    "not_itself": lambda: F.col("custom_food_id") != F.col("recipe_id"),
}


def portion_rules() -> dict[str, Column]:
    return {"gram_weight": F.col("gram_weight") > 0, "label": F.length(F.trim("label")) > 0}


def step_rules() -> dict[str, Column]:
    return {"text": F.length(F.trim("text")) > 0, "duration_s": F.col("duration_s") > 0}
