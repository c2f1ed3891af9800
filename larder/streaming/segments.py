"""A store of micro-batches that a reader can always merge from a bounded number of folders.

Each micro-batch is written as a segment of its own. When as many segments as a tier holds
have gathered, they are merged into one of the next tier, so that n batches lie in about
``fanout`` times log n folders. What counts is the manifest: a numbered file that lists the
live segments with the batches each covers. It is written last and under a new name, so a
stop at any point leaves the one before it in force; a batch that is run again and is
already covered changes nothing. Segments that a newer manifest no longer lists are kept
until the manifests before it are gone too, for readers that are still at work on them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from larder.session import remove
from larder.sources.files import Manifests

BATCH = "batch"
#: Segments of a tier that are merged into one; manifests that are kept.
FANOUT, KEPT = 8, 3

Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Segment:
    folder: str
    tier: int
    first: int
    last: int


@dataclass(frozen=True)
class Manifest:
    version: int
    segments: tuple[Segment, ...]
    notes: dict

    def covers(self, batch: int) -> bool:
        return any(s.first <= batch <= s.last for s in self.segments)


class Store:
    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.manifests = Manifests(spark, self.path, KEPT)
        self.files = self.manifests.files

    def manifest(self) -> Manifest:
        versions = self.manifests.versions()
        if not versions:
            return Manifest(0, (), {})
        said = self.manifests.load(versions[-1])
        return Manifest(versions[-1], tuple(Segment(**s) for s in said["segments"]), said["notes"])

    def _commit(self, old: Manifest, segments: list[Segment], notes: dict) -> Manifest:
        new = Manifest(old.version + 1, tuple(sorted(segments, key=lambda s: s.first)), notes)
        self.manifests.commit(new.version, {"segments": [asdict(s) for s in new.segments], "notes": notes})
        return new

    def add(self, rows: DataFrame, batch: int, merge: Merge | None = None, notes: dict | None = None) -> None:
        """Store one micro-batch's rows; ``merge`` reduces the rows of several batches to fewer."""
        now = self.manifest()
        if now.covers(batch):
            return
        folder = f"{batch:09d}-{batch:09d}-{uuid.uuid4().hex[:8]}"
        rows.withColumn(BATCH, F.lit(batch).cast("int")).write.parquet(f"{self.path}/data/{folder}")
        now = self._commit(now, [*now.segments, Segment(folder, 0, batch, batch)], {**now.notes, **(notes or {})})
        self._compact(now, merge)

    def _compact(self, now: Manifest, merge: Merge | None) -> None:
        tier = 0
        while len(full := [s for s in now.segments if s.tier == tier]) >= self.fanout:
            first, last = min(s.first for s in full), max(s.last for s in full)
            folder = f"{first:09d}-{last:09d}-{uuid.uuid4().hex[:8]}"
            rows = self._rows(full, None)
            merged = merge(rows) if merge else rows.coalesce(max(1, len(rows.inputFiles()) // self.fanout))
            merged.write.parquet(f"{self.path}/data/{folder}")
            now = self._commit(now, [*[s for s in now.segments if s not in full], Segment(folder, tier + 1, first, last)],
                               now.notes)
            tier += 1
        self._tidy()

    def _tidy(self) -> None:
        """Drop old manifests, and folders that none of the kept ones lists."""
        listed = {s["folder"] for said in self.manifests.tidy() for s in said["segments"]}
        for name in self.files.names(f"{self.path}/data"):
            if name not in listed:
                remove(self.spark, f"{self.path}/data/{name}")

    def _rows(self, segments: list[Segment] | tuple[Segment, ...], schema: StructType | None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/data/{s.folder}" for s in segments])

    def rows(self, schema: StructType) -> DataFrame:
        """All rows of the live segments, with the number of a batch they came with."""
        full = StructType([*[f for f in schema.fields if f.name != BATCH], StructField(BATCH, IntegerType())])
        segments = self.manifest().segments
        return self._rows(segments, full) if segments else self.spark.createDataFrame([], full)
