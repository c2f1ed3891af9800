"""Release archives: which is newest, what is in one, and its CSV files as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder import fixed


def newest_archives(names: DataFrame, column: str = "path") -> DataFrame:
    """(data_type, version, path): the greatest version text per release type.

    ``names`` holds file paths or links, one per row.
    """
    kind, version = F.lit(None).cast("string"), F.lit(None).cast("string")
    for data_type, pattern in fixed.ARCHIVE_PATTERNS.items():
        hit = F.regexp_extract(F.col(column), pattern, 1)
        kind = F.when(hit != "", F.lit(data_type)).otherwise(kind)
        version = F.when(hit != "", hit).otherwise(version)
    return (
        names.select(kind.alias("data_type"), version.alias("version"), F.col(column).alias("path"))
        .dropna(subset=["data_type"])
        .groupBy("data_type")
        .agg(F.max("version").alias("version"),
             F.max_by("path", F.struct("version", "path")).alias("path"))
    )


def listed_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """File paths under a folder; the content column is never read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(folder).select("path")
    )


#: A table of a release: one CSV file, or a folder of that name with its parts.
_TABLE = r"^(.*?/([^/]+\.csv))(/[^/]+)?$"


def is_needed(path: Column) -> Column:
    return F.regexp_extract(path, _TABLE, 2).isin(*fixed.NEEDED_FILES)


def needed_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Base name -> path for the tables of one extracted archive (13 at most).

    A table is a file or a folder of part files, each with a header. Two of one name are
    an error: which of them is meant cannot be told.
    """
    table = F.regexp_extract("path", _TABLE, 1).alias("path")
    found = sorted(r.path for r in listed_files(spark, folder, "*.csv").filter(is_needed(F.col("path"))).select(table).distinct().collect())
    named = {path.rsplit("/", 1)[-1]: path for path in found}
    if len(named) < len(found):
        raise ValueError(f"files of one name in {folder}: {found}")
    return named


def csv_text(spark: SparkSession, path: str, quoted_newlines: bool = True) -> DataFrame:
    """Every column as text; casts are ours, so a bad cell never fails the read.

    A quoted cell may hold line ends. Where none does, ``quoted_newlines=False`` lets
    one file be read by several tasks.
    """
    return spark.read.option("header", True).option("escape", '"').option("multiLine", quoted_newlines).csv(path)


def parsed_replies(df: DataFrame, content: str, schema: str) -> DataFrame:
    """Structured replies: adds ``items`` and ``readable``.

    A missing list is unreadable, an empty list is a valid answer of nothing.
    """
    from larder.functions import text

    reply = F.from_json(text.strip_code_fence(F.col(content)), f"items array<struct<{schema}>>")
    return df.withColumn("items", reply["items"]).withColumn("readable", F.col("items").isNotNull())
