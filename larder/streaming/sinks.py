"""Sources, sinks and small helpers shared by the streams.

A stream keeps no state in memory. Each micro-batch is reduced and stored as a segment
(``segments``): one that is run again changes nothing, late rows count like others, and a
reader merges the segments, of which there are few. What is kept is data, as bounded as
the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from larder.streaming.segments import FANOUT, Merge, Store


def table_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, given by its folder or a pattern, as a stream of its files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Run ``each`` over the available data in micro-batches, then stop.

    The checkpoint says what was read: a stream drained again with the same one goes on
    where it ended, so its place must outlive the run.
    """
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(each).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start()
    )
    query.awaitTermination()
    return query


def write_batches(stream: DataFrame, path: str, reduce: Merge, mode: str = "append", merge: Merge | None = None,
                  fanout: int = FANOUT):
    """Drain into ``path``: each micro-batch reduced, as a segment of a store beside the checkpoint.

    ``merge`` makes one set of rows of those of several batches; without it they are only
    laid together.
    """
    store = Store(stream.sparkSession, path, fanout)

    def save(rows: DataFrame, batch: int) -> None:
        store.add(reduce(rows), batch, merge)

    return drain(stream, save, f"{path}/checkpoint", mode)


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of all micro-batches with the number of a batch; none before the first."""
    return Store(spark, path).rows(schema)
