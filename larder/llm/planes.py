"""Token ids in a binary file format of byte planes, in document order.

Ids are cut into chunks of 2**16. A chunk's ids are transposed into four byte planes, so
that bytes that vary alike lie together, and every plane is compressed with zstandard. A
plane of zeros is stored as no bytes. The chunk index (shard, chunk, first id, number of
ids, length and crc32 of each plane, and the places of the documents in it) makes any
chunk readable alone.

Layout of a store: ``chunks/`` has a row per chunk with its index and its payload,
``documents/`` a row per document with its place. Shards are ranges of doc_id. Both are
written by Spark's committed writer, so a lost executor leaves no half shard behind and
any storage that Spark can reach will do.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from larder.session import Workspace

CHUNK = 1 << 16
PLANES = 4
LEVEL = 3
END = 2
#: Bytes of text that are encoded at once, pieces in a row, and the most characters of such a piece.
BLOCK, ROW, LONGEST = 1 << 23, 512, 48
#: Pieces whose ids are put in place at once.
STEP = 1 << 16

#: Per plane: length in bytes and crc32.
_INDEX = struct.Struct(f"<{2 * PLANES}I")
_BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_CUT = re.compile("(?=[ \n])")
#: A space and letters, all of them letters in every reading of the splitting pattern.
_LATIN = "^ [A-Za-zÀ-ÖØ-öø-ɏ]+$"


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(index, payload) of one chunk of unsigned 32-bit ids."""
    rows = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, PLANES)
    coder = zstandard.ZstdCompressor(level=LEVEL)
    planes = [coder.compress(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in rows.T]
    return _INDEX.pack(*[x for p in planes for x in (len(p), zlib.crc32(p))]), b"".join(planes)


def unpack(index: bytes, payload: bytes, n: int) -> np.ndarray:
    """The n ids of a chunk; a plane that is not as it was written is an error."""
    rows, at, facts = np.zeros((PLANES, n), np.uint8), 0, _INDEX.unpack(index)
    for i in range(PLANES):
        size, check = facts[2 * i:2 * i + 2]
        part = payload[at:at + size]
        if len(part) != size or zlib.crc32(part) != check:
            raise ValueError(f"plane {i} of a chunk is damaged")
        if size:
            rows[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(part, max_output_size=n), np.uint8)
        at += size
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


class Coder:
    """Ids of texts by a byte-level tokenizer, each different piece of them encoded once.

    A text is cut before a space or line end that follows a visible character. Splitting
    into words ends there whatever follows, so the ids of the pieces are those of the
    text. A text with any other order of white space goes to the tokenizer whole.

    Arrow finds the different pieces. They are put in rows for the tokenizer, each after
    its space or line end; a token that begins with one begins a piece, and no other does.
    Pieces of Latin letters are one word each, so their rows need only be split at spaces,
    which the library does faster than by its pattern. Long pieces and those that are
    blank alone stand in no row. Nothing is kept from one call to the next.
    """

    def __init__(self, model: str):
        described = json.loads(model)
        splitter = described["pre_tokenizer"] or {}
        if (described["normalizer"] or splitter.get("type") != "ByteLevel" or splitter["add_prefix_space"]
                or not splitter.get("use_regex", True)):
            raise ValueError("not a byte-level tokenizer that splits text by the usual pattern alone")
        self.model, self.spaced = Tokenizer.from_str(model), Tokenizer.from_str(model)
        self.spaced.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            pre_tokenizers.Split("Ġ", "merged_with_next")])
        vocabulary = self.model.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[0] in "ĠĊ"]] = True

    @staticmethod
    def _whole(model: Tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts encoded one by one, number of ids of each)."""
        # One text in a call: what the library holds for a token is many times its text.
        ids = [np.array(e.ids, "<u4") for t in texts for e in model.encode_batch_fast([t], add_special_tokens=False)]
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.array([len(x) for x in ids], np.int64)

    def _rows(self, model: Tokenizer, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces encoded in rows, number of ids of each)."""
        rows = pa.ListArray.from_arrays(pa.array([*range(0, len(pieces), ROW), len(pieces)], pa.int32()), pieces)
        flat, _ = self._whole(model, pc.binary_join(rows, pa.scalar("", pieces.type)).to_pylist())
        places = np.flatnonzero(self.begins[flat])
        if len(places) != len(pieces):
            raise ValueError("a token that begins with a blank is not the first of its piece")
        return flat, np.diff(places, append=len(flat))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts, number of ids of each)."""
        plain = [not ("  " in t or "\n " in t or " \n" in t or "\n\n" in t or any(c in t for c in _BLANKS))
                 for t in texts]
        # What stands before the first cut, or the whole text where there is none to make.
        firsts = [_CUT.split(t, maxsplit=1)[0] if p else t for t, p in zip(texts, plain)]
        rests = pa.array([t[len(f):] for t, f in zip(texts, firsts)], pa.large_string())
        # A cut is marked by a blank that stands in no plain text; nothing stands before the first.
        rests = pc.replace_substring(pc.replace_substring(rests, " ", "\t "), "\n", "\t\n")
        rests = pc.split_pattern(rests, "\t")
        offsets, words = np.array(rests.offsets), rests.flatten().dictionary_encode()
        del rests
        pieces = words.dictionary
        sizes = np.asarray(pc.utf8_length(pieces))
        in_row = (sizes > 1) & (sizes <= LONGEST)
        latin = in_row & np.asarray(pc.match_substring_regex(pieces, _LATIN))
        groups = [latin, in_row & ~latin, ~in_row]
        held = [pieces.filter(pa.array(g)) for g in groups]
        parts = [self._rows(self.spaced, held[0]), self._rows(self.model, held[1]),
                 self._whole(self.model, held[2].to_pylist()), self._whole(self.model, firsts)]
        # The place of each piece among the groups; the firsts follow.
        place = np.empty(len(pieces), np.int32)
        place[np.concatenate([np.flatnonzero(g) for g in groups])] = np.arange(len(pieces))
        codes = place[np.asarray(words.indices)]
        codes[offsets[:-1]] = len(pieces) + np.arange(len(texts))
        counts = np.concatenate([n for _, n in parts])
        flat = np.concatenate([x for x, _ in parts])
        lengths = counts[codes]
        begins, ends = np.cumsum(counts) - counts, np.cumsum(lengths)
        whole = np.empty(ends[-1], "<u4")
        for lo in range(0, len(codes), STEP):
            # Every piece's ids in turn: where they begin, less where they go, plus where each id goes.
            some, to = lengths[lo:lo + STEP], ends[lo:lo + STEP]
            first, last = to[0] - some[0], to[-1]
            whole[first:last] = flat[np.repeat(begins[codes[lo:lo + STEP]] - to + some, some) + np.arange(first, last)]
        return whole, np.diff(np.concatenate([[0], ends])[offsets])


@lru_cache(maxsize=2)
def coder_of(model: str) -> Coder:
    """One per process, so that tasks that follow one another share what is kept."""
    return Coder(model)


def write(documents: DataFrame, tokenizer_json: str, path: str, id_col: str = "doc_id", text_col: str = "text",
          end: int = END) -> None:
    """Encode every text, append ``end`` to each, and write a store in ascending doc_id order.

    A null or empty text is its end id alone. Rows of equal doc_id follow one another, by
    a hash of their text; a null doc_id comes first. An empty table gives an empty store.
    Other columns are not read.
    """
    spark = documents.sparkSession
    with open(tokenizer_json, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = coder_of(model.value), TaskContext.get().partitionId()
        tail, start, chunk = np.empty(0, "<u4"), 0, 0
        waiting: list[dict] = []

        def rows(kind: list, **columns: list) -> pa.RecordBatch:
            n = len(kind)
            blank: list = [None] * n
            return pa.RecordBatch.from_arrays(
                [pa.array(columns.get(f.name, blank), f.type) for f in _STORE], schema=_STORE)

        def chunks(ids: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal tail, chunk, waiting
            tail = np.concatenate([tail, ids])
            while len(tail) >= CHUNK or last and len(tail):
                index, payload = pack(tail[:CHUNK])
                n, stops = min(len(tail), CHUNK), (chunk + 1) * CHUNK
                # Documents follow one another: those that begin in a chunk come first, those that end later last.
                held = waiting[:bisect_left(waiting, stops, key=lambda d: d["first"])]
                yield rows([0], shard=[shard], chunk=[chunk], first=[chunk * CHUNK], n_ids=[n], index=[index],
                           payload=[payload], docs=[held])
                waiting = waiting[bisect_right(waiting, stops, key=lambda d: d["first"] + d["n_ids"]):]
                tail, chunk = tail[CHUNK:], chunk + 1

        for batch in batches:
            for lo, hi in _blocks(batch.column("text")):
                texts = [t or "" for t in batch.column("text")[lo:hi].to_pylist()]
                flat, sizes = coder.ids(texts)
                flat, sizes = np.insert(flat, np.cumsum(sizes), np.uint32(end)), sizes + 1
                begins = start + np.cumsum(sizes) - sizes
                yield rows([None] * len(texts), doc_id=batch.column("doc_id")[lo:hi], shard=[shard] * len(texts),
                           first=begins, n_ids=sizes)
                waiting += [{"first": int(f), "n_ids": int(n)} for f, n in zip(begins, sizes)]
                start += len(flat)
                yield from chunks(flat, False)
        yield from chunks(np.empty(0, "<u4"), True)

    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    parts = ordered.mapInArrow(run, _COLUMNS)
    (parts.withColumn("kind", F.when(F.col("chunk").isNull(), "documents").otherwise("chunks"))
     .write.mode("overwrite").partitionBy("kind").parquet(path))


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most BLOCK bytes, or one longer text."""
    lo, total = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > lo and total + size > BLOCK:
            yield lo, i
            lo, total = i, 0
        total += size
    if len(texts):
        yield lo, len(texts)


_STORE = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()),
                    ("n_ids", pa.int64()), ("index", pa.binary()), ("payload", pa.binary()),
                    ("docs", pa.list_(pa.struct([("first", pa.int64()), ("n_ids", pa.int64())])))])
_COLUMNS = ("doc_id long, shard int, chunk int, first long, n_ids long, index binary, payload binary, "
            "docs array<struct<first:long,n_ids:long>>")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start (ids before it), n_tokens, ids (array of int).

    A document lies in one chunk or in several that follow one another; it is put together
    from its piece of each. Places before a shard come from one total per shard.
    """
    documents, pieces = _pieces(spark, path, False)
    whole = pieces.groupBy("shard", "first").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("chunk", "piece"))), lambda p: p["piece"])).alias("ids"))
    return documents.join(whole, ["shard", "first"]).select("doc_id", "start", "n_tokens", "ids")


def checked(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens, ids_crc32 (of its little-endian ids).

    Only documents that cross chunks need their pieces brought together.
    """
    documents, pieces = _pieces(spark, path, True)
    return documents.join(pieces, ["shard", "first"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def _pieces(spark: SparkSession, path: str, sums: bool) -> tuple[DataFrame, DataFrame]:
    store = spark.read.schema(f"{_COLUMNS}, kind string").parquet(path)
    documents = store.filter("kind = 'documents'").select("doc_id", "shard", "first", "n_ids")
    totals = documents.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row per shard; shards are as many as the write had tasks.
    offset = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("offset"))
    placed = documents.join(F.broadcast(offset), "shard").select(
        "doc_id", "shard", "first", (F.col("offset") + F.col("first")).alias("start"), F.col("n_ids").alias("n_tokens"))
    chunks = store.filter("kind = 'chunks'").select(
        "shard", "chunk", F.col("first").alias("base"), F.col("n_ids").alias("n"), "index", "payload", "docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["index"], row["payload"], row["n"])
                found = [(w["first"], w["n_ids"]) for w in row["docs"]]
                cut = [ids[max(f - row["base"], 0):f - row["base"] + n] for f, n in found]
                crc = [zlib.crc32(x.tobytes()) if len(x) == n else None for x, (_, n) in zip(cut, found)]
                if sums:
                    value = pa.array([None if c is not None else x.tobytes() for c, x in zip(crc, cut)], pa.binary())
                else:
                    value = pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(cut), pa.int32()), pa.array([f for f, _ in found], pa.int64()),
                     pa.array([row["chunk"]] * len(cut), pa.int32()), pa.array(crc, pa.int64()), value],
                    ["shard", "first", "chunk", "crc", "piece"])

    pieces = chunks.mapInArrow(run, f"shard int, first long, chunk int, crc long, piece {'binary' if sums else 'array<int>'}")
    if not sums:
        return placed, pieces.select("shard", "first", "chunk", "piece")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for parts in batch.column("parts"):
                value = 0
                for part in parts.as_py():
                    value = zlib.crc32(part["piece"], value)
                crc.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("first"), pa.array(crc, pa.int64())],
                                             ["shard", "first", "ids_crc32"])

    work = Workspace(spark, "planes")
    kept = work.keep(pieces, "pieces")
    split = (kept.filter("crc is null").groupBy("shard", "first")
             .agg(F.sort_array(F.collect_list(F.struct("chunk", "piece"))).alias("parts"))
             .mapInArrow(join, "shard int, first long, ids_crc32 long"))
    return placed, kept.filter("crc is not null").select("shard", "first", F.col("crc").alias("ids_crc32")).unionByName(split)
