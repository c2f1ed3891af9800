"""Numbering in ranges against a window, with keys over many ranges."""

import random

import pytest
from pyspark.sql import Window, functions as F

from larder.operators.relational import numbered


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_numbers_equal_a_window(spark, hot):
    draw = random.Random(int(hot * 10))
    rows = [(7 if draw.random() < hot else draw.randrange(25), f"k{draw.randrange(2)}", draw.randrange(300) or None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b string, v long, id long")
    order = [F.col("v").asc_nulls_last(), F.col("id")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
                                             "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.id: r.n for r in numbered(df, ["a", "b"], order, "n").collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy(*order)))
    assert got == {r.id: r.n for r in want.collect()}
    assert numbered(df.limit(0), ["a"], order).count() == 0


def test_one_shuffle_of_the_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = numbered(rows, ["k"], [F.col("v")])._jdf.queryExecution().executedPlan().toString()
    # what is read back is only joined with one broadcast row per range
    assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan.split("BroadcastExchange")[0]
