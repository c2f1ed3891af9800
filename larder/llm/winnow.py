"""Benchmark decontamination by winnowing.

Of every 8 consecutive 6-word hashes the least is a fingerprint, so any 13 consecutive
words that a document shares with an item choose the same fingerprint in both. Documents
and items are joined on fingerprints, and each hit is extended over the words around it:
where 13 or more agree, those words are hit. Every 13-word window has a fingerprint inside,
so looking 7 words to either side of each finds all of them.

Items of fewer than 13 words are one window each. They have no such guarantee and are
joined on the hash of the whole item instead, against every place of every document.

Only fingerprints that may belong to an item leave the pass over the documents: a bit
table of fixed size, built from the items, decides. A wrong bit costs a row, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from larder.llm import words as W
from larder.session import Workspace

WINDOW, GRAM = 13, 6
SPAN = WINDOW - GRAM + 1
SIDE = WINDOW - GRAM
FILTER_BITS = 22
#: Share of hit words, as 1 in so many, from which a document is contaminated.
ONE_IN = 20


def _chosen(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints: the rightmost least gram of each window."""
    grams = W.joined(words.hashes, GRAM)
    places, _ = W.runs(words, WINDOW)
    if not len(places):
        return places, grams[:0]
    # rightmost among equals: scan the window from its end
    offset = SPAN - 1 - np.argmin(np.stack([grams[places + j] for j in range(SPAN - 1, -1, -1)]), axis=0)
    at = np.unique(places + offset)
    return at, grams[at]


def _around(words: W.Words, at: np.ndarray, row: np.ndarray) -> list[bytes]:
    """Hashes of the gram at each place and of 7 words to either side; 0 beyond the document."""
    index = at[:, None] + np.arange(-SIDE, GRAM + SIDE)
    inside = (index >= words.first[row][:, None]) & (index < words.first[row + 1][:, None])
    near = np.where(inside, words.hashes[np.clip(index, 0, len(words.hashes) - 1)], 0)
    return [x.tobytes() for x in near.astype(np.uint64)]


_HIT = pa.struct([("place", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("near", pa.binary())])
HIT = "array<struct<place:int,size:int,hash:long,near:binary>>"


def _found(words: W.Words, sizes: list[int], table: np.ndarray | None, whole_short: bool) -> list[list[dict]]:
    """Per document: fingerprints (size 13), and runs of the short sizes, that the table may know."""
    out: list[list[dict]] = [[] for _ in range(words.hi - words.lo)]

    def add(size: int, at: np.ndarray, hashes: np.ndarray) -> None:
        if table is not None:
            slot = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            known = (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            at, hashes = at[known], hashes[known]
        if not len(at):
            return
        row = np.searchsorted(words.first, at, "right") - 1
        near = _around(words, at, row) if size == WINDOW else [b""] * len(at)
        for r, place, h, x in zip(row, at - words.first[row], hashes.view(np.int64), near):
            out[r].append({"place": place, "size": size, "hash": h, "near": x})

    add(WINDOW, *_chosen(words))
    for size in sizes:
        places, _ = W.runs(words, size)
        if whole_short:
            places = places[np.isin(places, words.first[:-1][words.counts == size])]
        add(size, places, W.joined(words.hashes, size)[places])
    return out


def _scan(column: str, sizes: list[int], table: np.ndarray | None, whole_short: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.words_of(batch.column("text"), W.LETTERS):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(column)[part.lo:part.hi], pa.array(part.counts, pa.int64()),
                     pa.array(_found(part, sizes, table, whole_short), pa.list_(_HIT))], [column, "n_words", "found"])

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a fingerprint met in both: how far the words around it agree."""
    for batch in batches:
        place, size = (batch.column(c).to_numpy() for c in ("place", "size"))
        start, stop = place.copy(), place + size
        long = np.flatnonzero(size == WINDOW)
        if len(long):
            x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(long)).to_pylist()), np.uint64)
                    .reshape(len(long), -1) for c in ("near", "item_near"))
            same = (x == y) & (x != 0)
            left = np.minimum.accumulate(same[:, :SIDE][:, ::-1], axis=1).sum(axis=1)
            middle = same[:, SIDE:SIDE + GRAM].all(axis=1)
            right = np.minimum.accumulate(same[:, SIDE + GRAM:], axis=1).sum(axis=1)
            start[long] = place[long] - left
            stop[long] = np.where(middle & (left + GRAM + right >= WINDOW), place[long] + GRAM + right, start[long])
        keep = pa.array(stop > start)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row").filter(keep), batch.column("item_id").filter(keep),
             pa.array(start, pa.int32()).filter(keep), pa.array(stop, pa.int32()).filter(keep)],
            ["row", "item_id", "start", "stop"])


def _bits(items: DataFrame) -> np.ndarray:
    """The bit table: as many slots as it has bits at most come to the driver, however many items."""
    slots = items.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("slot")).distinct().toPandas()["slot"]
    table = np.zeros(1 << FILTER_BITS, bool)
    table[slots.to_numpy(np.int64)] = True
    return np.packbits(table, bitorder="little")


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A
    window is 13 consecutive words of an item, or the whole of a shorter one. n_hit counts
    the document's words inside an occurrence of a window, n_items the items that have
    one; items_sha256 is over their ids, sorted as strings and joined with commas.
    contaminated: at least one word in twenty is hit.

    A null or empty text has no words and is clean. Repeated rows are judged each on its
    own; so is a null doc_id. An item without words has no window; items that share an id
    count once; an item with a null id hits words but is in no list. With no items every
    document is clean; no documents give an empty result. Other columns are not read.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "winnow")
    item_rows = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    items = work.keep(
        item_rows.mapInArrow(_scan("item_id", list(range(1, WINDOW)), None, True),
                             f"item_id string, n_words long, found {HIT}")
        .select("item_id", F.explode("found").alias("f"))
        .select("item_id", "f.size", "f.hash", F.col("f.near").alias("item_near")).distinct(), "items")
    sizes = sorted(r["size"] for r in items.filter(F.col("size") < WINDOW).select("size").distinct().collect())
    table = _bits(items)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = work.keep(
        docs.mapInArrow(_scan("doc_id", sizes, table, False), f"doc_id long, n_words long, found {HIT}")
        .withColumn("row", F.monotonically_increasing_id()), "rows")

    met = (rows.filter(F.size("found") > 0).select("row", F.explode("found").alias("f"))
           .select("row", "f.place", "f.size", "f.hash", "f.near")
           .join(items, ["hash", "size"]).select("row", "item_id", "place", "size", "near", "item_near"))
    spans = work.keep(met.mapInArrow(_spans, "row long, item_id string, start int, stop int").distinct(), "spans")
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    hit = (spans.select("row", "start", "stop").distinct()
           .withColumn("open", F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
           .groupBy("row").agg(F.sum(F.greatest(F.col("stop") - F.col("open"), F.lit(0))).alias("n_hit")))
    listed = (spans.filter("item_id is not null").select("row", "item_id").distinct()
              .groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items")))
    out = rows.select("row", "doc_id", "n_words").join(hit, "row", "left").join(listed, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (ONE_IN * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    Of rows that share a doc_id all go if one is contaminated; rows without one are kept
    unless their text is contaminated as well.
    """
    key = W.unused("_key", documents.columns)
    keyed = documents.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))))
    bad = contamination(keyed, benchmark, key, text_col).filter("contaminated").select(
        F.col("doc_id").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
