"""Near-duplicate documents: universal hash minima, banding, verification, components.

1. One pass over the texts gives each document the size and a 128-bit digest of its set
   of five-word shingles, the minima of 128 universal hashes in 32 bands of 4, and one
   byte of each minimum.
2. Documents of equal sets form a class; only its smallest doc_id goes on.
3. Classes that share a band meet in that band's bucket. Every one is compared with the
   bucket's smallest, never with all others: a star. Pairs whose minima agree too seldom
   are left out; of the rest each class has its best confirmed on the full sets first,
   then those that still lie in different components.
4. A bucket whose other members are still in several components is compared across them
   in blocks, and what agrees is confirmed as well, so that no link which would join two
   components is lost.

Two sets of similarity 0.75 miss each other in all 32 bands with probability 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larder.llm import words as W
from larder.llm.graph import components
from larder.session import Workspace

SHINGLE = 5
BANDS, ROWS = 32, 4
PERCENT = 75
#: Of 128 one-byte minima; at similarity 0.75 fewer agree with probability 1e-8.
LEAST_AGREEING = 68
#: Members of a bucket that one block holds on each side.
BLOCK = 128

_A, _B = W.constants(BANDS * ROWS, 11), W.constants(BANDS * ROWS, 12, odd=False)
_BAND = W.constants(BANDS * ROWS, 13).reshape(BANDS, ROWS)
_SET = W.constants(2, 14, odd=False)

SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, minima binary"


def _minima(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Least value of each universal hash (multiply, add, keep the high half) per document."""
    out = np.empty((len(first), len(_A)), np.uint64)
    for i, (a, b) in enumerate(zip(_A, _B)):
        out[:, i] = np.minimum.reduceat(values * a + b, first)
    return out >> np.uint64(32)


def _sketch_slice(words: W.Words, ids: np.ndarray) -> dict:
    n = len(ids)
    sizes, digests, sets, rows = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), [], []
    for row, found in W.shingles(words, SHINGLE):
        if len(found):
            own = np.unique(found)
            r = row - words.lo
            sizes[r] = len(own)
            digests[r] = W.mix(own ^ _SET[0]).sum(), W.mix(own ^ _SET[1]).sum()
            sets.append(own)
            rows.append(r)
    bands: list = [[]] * n
    minima: list = [b""] * n
    if rows:
        first = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
        least = _minima(np.concatenate(sets), first)
        keys = W.mix((least.reshape(len(rows), BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64)).view(np.int64)
        low = (least & np.uint64(255)).astype(np.uint8)
        for i, r in enumerate(rows):
            bands[r], minima[r] = keys[i], low[i].tobytes()
    d = digests.view(np.int64)
    return {"doc_id": ids, "n_shingles": sizes, "d1": d[:, 0], "d2": d[:, 1], "bands": bands, "minima": minima}


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                     ("bands", pa.list_(pa.int64())), ("minima", pa.binary())])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.words_of(batch.column("text"), W.NOT_SPACE):
            got = _sketch_slice(part, batch.column("doc_id")[part.lo:part.hi])
            yield pa.RecordBatch.from_arrays(
                [pa.array(got[f.name], f.type) for f in _SKETCH], schema=_SKETCH)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.words_of(batch.column("text"), W.NOT_SPACE):
            found = [np.unique(x).view(np.int64) for _, x in W.shingles(part, SHINGLE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[part.lo:part.hi], pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])


def _bytes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * ROWS)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = (_bytes_of(batch.column("x")) == _bytes_of(batch.column("y"))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.select(["u", "v"]).columns, pa.array(same, pa.int32())],
                                         ["u", "v", "same"]).filter(pa.array(same >= LEAST_AGREEING))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two bytes of every shingle of a document's set."""
    for batch in batches:
        for part in W.words_of(batch.column("text"), W.NOT_SPACE):
            found = [(np.unique(x) >> np.uint64(48)).astype(np.uint16).tobytes() for _, x in W.shingles(part, SHINGLE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[part.lo:part.hi], pa.array(found, pa.binary())], ["id", "prints"])


def _at_most(few: list[np.ndarray], many: list[np.ndarray]) -> np.ndarray:
    """Upper bounds of the intersections: shingles of one set whose print the other holds."""
    out = np.empty((len(few), len(many)), np.int64)
    first = np.concatenate([[0], np.cumsum([len(x) for x in many])[:-1]])
    every = np.concatenate(many)
    for i, prints in enumerate(few):
        held = np.zeros(1 << 16, np.int32)
        held[prints] = 1
        out[i] = np.add.reduceat(held[every], first)
    return out


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of a bucket's minority against one of all its members.

    A pair is taken if its components differ, its sizes and minima allow the similarity,
    and so does the bound by prints.
    """
    for batch in batches:
        out = [np.empty((2, 0), np.int64)]
        for few, many in zip(*(batch.column(c).to_pylist() for c in ("few", "many"))):
            if not few or not many:
                continue
            a, b = ({k: np.array([m[k] for m in side]) for k in ("id", "component", "n")}
                    for side in (few, many))
            p, q = (np.frombuffer(b"".join(m["minima"] for m in side), np.uint8).reshape(len(side), -1)
                    for side in (few, many))
            take = (p[:, None, :] == q[None, :, :]).sum(axis=2) >= LEAST_AGREEING
            take &= a["component"][:, None] != b["component"][None, :]
            take &= 100 * np.minimum(a["n"][:, None], b["n"]) >= PERCENT * np.maximum(a["n"][:, None], b["n"])
            if take.any():
                x, y = ([np.frombuffer(m["prints"], np.uint16) for m in side] for side in (few, many))
                bound = _at_most(x, y)
                take &= 100 * bound >= PERCENT * (a["n"][:, None] + b["n"] - bound)
            i, j = np.nonzero(take)
            out.append(np.stack([np.maximum(a["id"][i], b["id"][j]), np.minimum(a["id"][i], b["id"][j])]))
        pairs = np.concatenate(out, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


def _confirm(docs: DataFrame, pairs: DataFrame, work: Workspace) -> DataFrame:
    """The pairs (u, v) whose full sets are similar; only texts of such pairs are read again."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = work.keep(docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "id long, shingles array<long>"), "sets")
    left = sets.select(F.col("id").alias("v"), F.col("shingles").alias("y"))
    right = sets.select(F.col("id").alias("u"), F.col("shingles").alias("x"))
    common = F.size(F.array_intersect("x", "y"))
    links = work.keep(
        pairs.join(left, "v").join(right, "u").withColumn("common", common)
        .filter(100 * F.col("common") >= PERCENT * (F.size("x") + F.size("y") - F.col("common")))
        .select("u", "v").distinct(), "links")
    work.drop(sets)
    return links


def _open_pairs(docs: DataFrame, shared: DataFrame, classes: DataFrame, found: DataFrame,
                work: Workspace) -> DataFrame:
    """Candidates between different components of one bucket, by blocks of bounded size.

    A bucket's smallest has met all its members already and is left out, so buckets of
    two are done. Of the others those outside the largest component are the few: they are
    compared with all. A bucket that is one component, as a group of near copies soon is,
    costs nothing.
    """
    placed = shared.filter("id != v").select("key", "id").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    bucket = counts.groupBy("key").agg(
        F.max_by("component", "n").alias("main"), F.sum("n").alias("n_many"),
        (F.sum("n") - F.max("n")).alias("n_few")).filter("n_few > 0")
    met = work.keep(placed.join(bucket, "key"), "met")
    ids = met.select(F.col("id").alias("doc_id")).distinct()
    prints = docs.join(ids, "doc_id", "left_semi").mapInArrow(_prints, "id long, prints binary")
    facts = classes.select("id", "n_shingles", "minima").join(prints, "id")
    members = met.join(work.keep(facts, "facts"), "id")
    blocks_few, blocks_many = F.ceil(F.col("n_few") / BLOCK).cast("int"), F.ceil(F.col("n_many") / BLOCK).cast("int")
    row = F.struct("id", "component", F.col("n_shingles").alias("n"), "minima", "prints")
    place = F.xxhash64("id")
    few = members.filter("component != main").select(
        "key", F.pmod(place, blocks_few).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), blocks_many - 1)).alias("j"), F.lit(True).alias("is_few"), row.alias("row"))
    many = members.select(
        "key", F.explode(F.sequence(F.lit(0), blocks_few - 1)).alias("i"),
        F.pmod(place, blocks_many).cast("int").alias("j"), F.lit(False).alias("is_few"), row.alias("row"))
    tiles = few.unionByName(many).groupBy("key", "i", "j").agg(
        F.collect_list(F.when(F.col("is_few"), F.col("row"))).alias("few"),
        F.collect_list(F.when(~F.col("is_few"), F.col("row"))).alias("many"))
    return tiles.select("few", "many").mapInArrow(_block_pairs, "u long, v long").distinct()


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (u, v) that lie in different components so far."""
    of = [found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")) for side in ("u", "v")]
    return pairs.join(of[0], "u", "left").join(of[1], "v", "left").filter(
        F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select("u", "v")


def _extended(found: DataFrame, docs: DataFrame, pairs: DataFrame, work: Workspace) -> DataFrame:
    """Components once those of the pairs that are links join them."""
    pairs = work.keep(pairs, "pairs")
    links = _confirm(docs, pairs, work)
    if links.isEmpty():
        return found
    return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links), work)


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but white space, A-Z lower-cased. Documents whose sets of
    five-word shingles have similarity 0.75 or more are linked; component_id is the
    smallest doc_id reachable by links, itself included, and kept marks that one.

    A null or empty text, or one of white space only, has an empty set and no links.
    Fewer than five words count as one shingle. Repeated rows are equal documents and
    come back each; rows that share a doc_id but not the text are linked by that doc_id.
    A null doc_id is linked with nothing: component_id null, kept true. An empty table
    gives an empty result. Other columns are not read, whatever their names.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "minhash")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = work.keep(docs.mapInArrow(_sketch, SKETCH), "rows")
    live = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = work.keep(
        live.groupBy("d1", "d2", "n_shingles").agg(
            F.min("doc_id").alias("id"), F.min_by(F.struct("bands", "minima"), "doc_id").alias("s"))
        .select("id", "n_shingles", "d1", "d2", "s.bands", "s.minima"), "classes")
    key = ["d1", "d2", "n_shingles"]
    ids = classes.select("id", *key)

    banded = classes.select("id", F.explode("bands").alias("key"))
    bucket = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("v")).filter("n > 1")
    shared = work.keep(banded.join(bucket.select("key", "v"), "key"), "shared")
    sketches = classes.select("id", "n_shingles", "minima")
    star = shared.filter("id != v").select(F.col("id").alias("u"), "v").distinct()
    candidates = work.keep(_judged(star, sketches), "candidates")
    best = candidates.groupBy("u").agg(F.max_by("v", F.struct("same", -F.col("v"))).alias("v"))
    # a doc_id with several texts ties the classes of all of them to the least
    text_of = F.struct("d1", "d2", "n_shingles")
    several = live.groupBy("doc_id").agg(F.min(text_of).alias("a"), F.max(text_of).alias("b")).filter("a != b")
    owners = work.keep(live.join(several.select("doc_id"), "doc_id", "left_semi").join(ids, key)
                       .select("doc_id", F.col("id").alias("u")).distinct(), "owners")
    least = owners.groupBy("doc_id").agg(F.min("u").alias("v"))
    twice = owners.join(least, "doc_id").filter("u != v").select("u", "v")
    found = components(_confirm(docs, best, work).unionByName(twice), work)
    found = _extended(found, docs, _across(candidates, found), work)
    found = _extended(found, docs, _open_pairs(docs, shared, classes, found, work), work)
    work.drop(shared)

    out = rows.join(ids, key, "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "id"))
    return out.withColumn("component_id", component).select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _judged(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose minima agree often enough."""
    u = sketches.select(F.col("id").alias("u"), F.col("n_shingles").alias("nu"), F.col("minima").alias("x"))
    v = sketches.select(F.col("id").alias("v"), F.col("n_shingles").alias("nv"), F.col("minima").alias("y"))
    near = pairs.join(v, "v").join(u, "u").filter(
        100 * F.least("nu", "nv") >= PERCENT * F.greatest("nu", "nv"))
    return near.select("u", "v", "x", "y").mapInArrow(_agreeing, "u long, v long, same int")


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents kept, with all their columns: one of each group of near duplicates.

    Rows of one kept doc_id are repeats of it, so one of them stays;
    rows without a doc_id stay.
    """
    verdict = near_duplicates(documents, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_keep"))
    count = verdict.groupBy("_keep").agg(F.count(F.lit(1)).alias("_n"))
    ids, (one, more) = documents[id_col].cast("long"), (count.filter("_n = 1"), count.filter("_n > 1"))
    single = documents.join(one, ids == one["_keep"], "left_semi")
    repeated = documents.join(more, ids == more["_keep"], "left_semi").dropDuplicates([id_col])
    return single.unionByName(repeated).unionByName(documents.filter(F.col(id_col).isNull()))
