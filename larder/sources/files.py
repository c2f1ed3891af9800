"""Small files beside stored tables: manifests that say what counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from larder.session import remove


class Files:
    """Small files of a store, through the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        target = self.path_of(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(target)) if self.fs.exists(target) else []

    def read(self, path: str) -> str:
        target = self.path_of(path)
        size, source = self.fs.getFileStatus(target).getLen(), self.fs.open(target)
        try:
            return bytes(source.readNBytes(int(size))).decode()
        finally:
            source.close()

    def write(self, path: str, text: str) -> None:
        """Appears whole under its name, or not at all."""
        part = self.path_of(f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
        out = self.fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(part, self.path_of(path)):
            raise OSError(f"{path} was not written")


class Manifests:
    """Numbered manifests of a store; the greatest number is in force, and a few before it are kept."""

    def __init__(self, spark: SparkSession, path: str, kept: int = 3):
        self.spark, self.folder, self.kept = spark, f"{path.rstrip('/')}/manifest", kept
        self.files = Files(spark, path)

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(self.folder) if n[:1].isdigit()]

    def load(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/{version:012d}.json"))

    def commit(self, version: int, said: dict) -> None:
        self.files.write(f"{self.folder}/{version:012d}.json", json.dumps(said))

    def tidy(self) -> list[dict]:
        """Drop all but the last few; what those say."""
        every = self.versions()
        for version in every[:-self.kept]:
            remove(self.spark, f"{self.folder}/{version:012d}.json")
        return [self.load(v) for v in every[-self.kept:]]
