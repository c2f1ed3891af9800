"""Snapshots in hash buckets, of which a merge rewrites only those it touches.

A table's rows lie in buckets by a hash of their key. The manifest says for every bucket
in which version's folder it is. A merge reads the buckets that hold a key of the incoming
rows, writes what becomes of them under a new version, and then commits a manifest that
points these buckets there and leaves all others where they were. Until then readers see
the table as it was; the folders of the last few versions stay for readers at work.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from larder.session import remove
from larder.sources.files import Manifests

#: Rows that a bucket aims at when a table is first stored.
BUCKET_ROWS = 1 << 20

#: From (current rows of the touched buckets, incoming rows) to the rows they become.
Change = Callable[[DataFrame, DataFrame], DataFrame]


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.manifests = Manifests(spark, self.path)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _current(self) -> tuple[int, dict]:
        versions = self.manifests.versions()
        return (versions[-1], self.manifests.load(versions[-1])) if versions else (0, {})

    def _write(self, rows: DataFrame, version: int, n: int) -> set[str]:
        folder = f"{self.path}/data/v={version}"
        # few tasks write many buckets: a bucket comes from one task, of whole rows of it
        rows.withColumn("_bucket", self._bucket(n)).repartition("_bucket").write.mode("overwrite").partitionBy(
            "_bucket").parquet(folder)
        return {name.removeprefix("_bucket=") for name in self.manifests.files.names(folder) if name.startswith("_bucket=")}

    def create(self, rows: DataFrame, buckets: int | None = None) -> None:
        """Store a table whole; the number of buckets follows its rows unless given."""
        n = buckets or max(1, -(-rows.count() // BUCKET_ROWS))
        version, _ = self._current()
        made = self._write(rows, version + 1, n)
        self.manifests.commit(version + 1, {"buckets": n, "schema": rows.schema.json(), "at": {b: version + 1 for b in made}})

    def _read(self, at: dict[str, int], schema: StructType) -> DataFrame:
        paths = [f"{self.path}/data/v={version}/_bucket={b}" for b, version in sorted(at.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        _, said = self._current()
        return self._read(said["at"], _schema(said))

    def change(self, incoming: DataFrame, how: Change) -> int:
        """Apply rows to the buckets that their keys fall into; how many these were.

        ``how`` must look at keys one by one: it sees no others than those of the buckets.
        """
        version, said = self._current()
        touched = {str(r[0]) for r in incoming.select(self._bucket(said["buckets"])).distinct().collect()}
        if not touched:
            return 0
        before = self._read({b: v for b, v in said["at"].items() if b in touched}, _schema(said))
        made = self._write(how(before, incoming).select(*before.columns), version + 1, said["buckets"])
        at = {b: v for b, v in said["at"].items() if b not in touched} | {b: version + 1 for b in made}
        self.manifests.commit(version + 1, {**said, "at": at})
        self._tidy()
        return len(touched)

    def _tidy(self) -> None:
        used = {v for said in self.manifests.tidy() for v in said["at"].values()}
        for name in self.manifests.files.names(f"{self.path}/data"):
            if name.startswith("v=") and int(name.removeprefix("v=")) not in used:
                remove(self.spark, f"{self.path}/data/{name}")


def _schema(said: dict) -> StructType:
    return StructType.fromJson(json.loads(said["schema"]))
