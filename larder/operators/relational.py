"""Small relational building blocks shared by the larger operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from larder.session import materialise


def within(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key some parent holds."""
    return rows.join(parents.select(key), key, "left_semi")


def without(rows: DataFrame, parents: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key no parent holds; a NULL key on the right removes nothing."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.join(parents.select(*keys), keys, "left_anti")


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and is never sent to the driver.

    Adaptive execution goes by the size of compressed files, in which names and flags
    take a tenth or less of what they take in a broadcast.
    """
    return df.hint("merge")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the least by ``order``.

    An aggregate rather than a window: it combines before the shuffle, so a key
    with many copies costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    return df.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, *[F.col(f"_best.{c}").alias(c) for c in rest]
    ).select(*df.columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rn") -> DataFrame:
    """First k rows per key; each task cuts to k before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def hot_keys(weights: DataFrame, keys: Sequence[str], weight: str = "n") -> DataFrame:
    """Keys with more rows than a task's even share, with the parts to split each into.

    A task's share is all rows by the shuffle partitions, so there are fewer such keys
    than partitions, which bounds the broadcast.
    """
    tasks = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = weights.agg(F.sum(weight).alias("_total"))
    share = F.col(weight) * tasks / F.col("_total")
    return (
        weights.crossJoin(F.broadcast(total)).filter(share > 1)
        .select(*keys, F.ceil(share).cast("int").alias("_parts"))
    )


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], weights: DataFrame,
                how: str = "inner", spread_by: Sequence[str] | None = None) -> DataFrame:
    """Join that splits hot keys of ``big`` over several tasks.

    ``weights`` holds (on..., n), rows per key of ``big``. Only rows of hot keys
    are repeated on the small side, once per part. The part is a hash of the row's
    own columns, so a task that is run again sends its rows to the same places.
    """
    keys = list(on)
    hot = F.broadcast(hot_keys(weights, keys))
    seed = F.struct(*(spread_by or [c for c in big.columns if c not in keys]))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    left = big.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(seed), parts).cast("int")
    ).drop("_parts")
    right = small.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), parts - 1))
    ).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def indexed(df: DataFrame, order: Sequence[Column], name: str = "idx") -> DataFrame:
    """Adds each row's place in a total order, from 0.

    Range partitioning rather than one global window: the rows are written once in
    order, so every reader sees the same ranges, and a row's place is its place in
    its range plus the rows of the ranges before it.
    """
    placed = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumns({"_range": F.shiftright("_slot", 33),
                      "_at": F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))})
        .drop("_slot"),
        "ordered",
    )
    # One row per range from here to the join: a handful, whatever the data.
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    return placed.join(F.broadcast(before), "_range").withColumn(
        name, F.coalesce("_before", F.lit(0)) + F.col("_at")
    ).drop("_range", "_at", "_before")


def _in_range(keys: Sequence[str]):
    """Number sorted rows within their key, from 1, and mark those of the key the partition begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before, n, head = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            opens = np.zeros(batch.num_rows, bool)
            for key in keys:
                column = batch.column(key)
                opens[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            first = [batch.column(key)[0].as_py() for key in keys]
            opens[0] = first != before
            place = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(opens, place, -1))
            number = np.where(start >= 0, place - start, n + place) + 1
            leads = head & (np.cumsum(opens) == int(before is None))
            before, n, head = [batch.column(key)[-1].as_py() for key in keys], int(number[-1]), bool(leads[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, task, np.int32)), pa.array(number.astype(np.int64)),
                 pa.array(leads)], [*batch.schema.names, "_range", "_n", "_head"])

    return run


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "seq") -> DataFrame:
    """1, 2, … per key (keys not NULL), without a whole key in one task.

    The rows are sorted into ranges, the one shuffle, and numbered in their range as they
    are written. Only the key that a range begins with can go on from the ranges before:
    one count per range, broadcast, carries its numbers on.
    """
    columns = [F.col(k) for k in keys]
    rows = df.repartitionByRange(*columns, *order).sortWithinPartitions(*columns, *order)
    schema = StructType([*df.schema.fields, StructField("_range", IntegerType()), StructField("_n", LongType()),
                         StructField("_head", BooleanType())])
    placed = materialise(rows.mapInArrow(_in_range(keys), schema), "numbered")
    # One row per range from here to the join: a handful, whatever the data.
    key = F.struct(*keys)
    ends = placed.groupBy("_range").agg(F.min(key).alias("first"), F.max(F.struct(key.alias("k"), "_n")).alias("last"))
    by_key = Window.partitionBy("last.k").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_order = Window.orderBy("_range")
    upto = ends.withColumn("upto", F.sum("last._n").over(by_key))
    carried = upto.select("_range", F.when(F.lag("last.k").over(in_order) == F.col("first"),
                                           F.lag("upto").over(in_order)).alias("_carried")).filter("_carried is not null")
    onward = F.when(F.col("_head"), F.coalesce("_carried", F.lit(0))).otherwise(0)
    return placed.join(F.broadcast(carried), "_range", "left").withColumn(
        name, (F.col("_n") + onward).cast("int")).drop("_range", "_n", "_head", "_carried")


def joined_set(values: Column, keep: Column | None = None, sep: str = "; ") -> Column:
    """Distinct texts of a group, sorted and joined; NULL when there are none."""
    chosen = F.when(keep, values) if keep is not None else values
    return F.nullif(F.array_join(F.array_sort(F.collect_set(chosen)), sep), F.lit(""))


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows chosen by a hash of their key: the same rows however data is laid out."""
    return df.orderBy(F.md5(F.concat_ws(":", key, F.lit(seed))), key).limit(n)


def stacked(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
