"""The intake log as a stream: day totals, hour windows, repeats, pulls, scoring.

Every operator is a pair: what a micro-batch is reduced to, and how a reader merges the
batches. Sums, minima, maxima and sets merge in any order, so rows may come in any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from larder import fixed
from larder.operators.changes import latest_state
from larder.operators.relational import keep_first
from larder.streaming.segments import BATCH, Store
from larder.streaming.sinks import drain, read_batches


def _sums(rows: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Decimal sums: the same whatever the order and the cut of the rows, down to ties of rounding."""
    kcal = F.coalesce("kcal", F.lit(0.0)).cast("decimal(28,6)")
    return rows.groupBy(*keys).agg(F.sum(kcal).alias("kcal"), F.count(F.lit(1)).alias("n"))


def merged_sums(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge of the sums of several micro-batches under the given keys."""
    return lambda parts: parts.groupBy(*keys).agg(
        F.sum("kcal").cast("decimal(38,6)").alias("kcal"), F.sum("n").alias("n"), F.max(BATCH).alias(BATCH))


def day_parts(entries: DataFrame) -> DataFrame:
    """Sums per user and day of one micro-batch."""
    return _sums(entries, DAY)


DAY, HOUR = ["user_id", "local_date"], ["hour_start", "user_id"]


def day_totals(parts: DataFrame) -> DataFrame:
    """Whole totals per user and day over all micro-batches."""
    return merged_sums(DAY)(parts).select(*DAY, F.round("kcal").cast("bigint").alias("kcal"), "n")


def hour_parts(entries: DataFrame) -> DataFrame:
    """Sums per user and hour of event time of one micro-batch, however late its rows are."""
    return _sums(entries, [F.date_trunc("hour", "ts").alias("hour_start"), "user_id"])


def hour_totals(parts: DataFrame) -> DataFrame:
    return merged_sums(HOUR)(parts).select(*HOUR, F.col("kcal").cast("double").alias("kcal"), "n")


def first_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows pushed again under the same keys, within a micro-batch or between two, count once.

    Serves both sides: the reduction of a batch, and with the batch number the merge.
    """
    order = [c for c in (BATCH, *rows.columns) if c in rows.columns and c not in keys]
    return keep_first(rows, keys, list(dict.fromkeys(order))) if order else rows.distinct()


def pulled_parts(remote: DataFrame, key: str = "id", stamp: str = "updated_at") -> DataFrame:
    """The newest remote version per key of one micro-batch."""
    return latest_state(remote, key, [stamp])


def pulled(parts: DataFrame, key: str = "id", stamp: str = "updated_at") -> DataFrame:
    """Newest version of every row over all micro-batches; of equal stamps the first to come."""
    return merged_pulls(key, stamp)(parts).drop(BATCH)


def merged_pulls(key: str = "id", stamp: str = "updated_at") -> Callable[[DataFrame], DataFrame]:
    def merge(parts: DataFrame) -> DataFrame:
        return latest_state(parts.withColumn("_first", -F.col(BATCH)), key, [stamp, "_first"]).drop("_first")

    return merge


def cursor(spark: SparkSession, path: str, schema: StructType, stamp: str = "updated_at"):
    """The greatest stamp pulled so far, which the next pull asks from; None before the first."""
    return read_batches(spark, path, schema).agg(F.max(stamp)).first()[0]


def scored_stream(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, order: str,
                  size: int = fixed.FLUSH_EVERY):
    """Answer requests as they come, in groups of at most ``size``, and store what came of each.

    ``answer`` takes rows with the column ``group``. The micro-batch is written before
    the next starts, so a stop loses at most one.
    """
    store = Store(requests.sparkSession, path)

    def each(rows: DataFrame, batch: int) -> None:
        place = F.row_number().over(Window.partitionBy("_task").orderBy(order)) - 1
        grouped = (rows.withColumn("_task", F.spark_partition_id()).withColumn("group", F.concat_ws(
            "-", F.col("_task"), F.floor(place / size))).drop("_task"))
        store.add(answer(grouped), batch)

    return drain(requests, each, f"{path}/checkpoint")
