"""Ranked lexical search over norm buckets (in the way of LEMP).

A document is a sparse vector of impacts over the query terms, tf saturated and damped by
length; an item is one of term weights. An item's best documents are those of the largest
inner products. Every task holds its documents' vectors in order of their length, the
longest first, and takes them in buckets:

- Cauchy-Schwarz on the whole bucket: an item whose own length times the bucket's greatest
  is below the score it needs leaves the bucket out.
- Inside, on the item's few heaviest coordinates (its focus): a vector's coordinate must lie
  in the interval that the needed cosine allows, and its partial product plus the product
  of the two remaining lengths must reach the score.
- Survivors are rescored exactly in 64-bit integers.

The score an item needs is its k-th best so far. It starts from a first pass over the
longest vectors of all tasks, and each task raises its own further on. Bounds are doubles
and are widened by far more than their rounding; only what is surely worse is left out.

Terms are 64-bit hashes of words. Items are taken in blocks of bounded size, as the
vocabulary and the vectors of a block's items travel to every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larder.llm import words as W
from larder.operators.relational import top_k
from larder.session import Workspace

TOP = 20
#: Vectors in a bucket; coordinates of a focus; share of vectors that the first pass reads.
BUCKET, FOCUS, FIRST_SHARE = 4096, 6, 1 / 32
#: Items and words that one block of items aims at.
BLOCK_ITEMS, BLOCK_WORDS = 4096, 1 << 20
#: Bounds are relaxed by this share, some 10,000 times what doubles may lose.
SLACK = 1e-9


def _terms(name: str):
    """Per text: its distinct words as hashes, how often each occurs, and how many words it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.words_of(batch.column("text"), W.LETTERS):
                terms, times = [], []
                for lo, hi in zip(part.first[:-1], part.first[1:]):
                    t, n = np.unique(part.hashes[lo:hi].view(np.int64), return_counts=True)
                    terms.append(t)
                    times.append(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(name)[part.lo:part.hi], pa.array(part.counts, pa.int64()),
                     pa.array(terms, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                    [name, "n", "terms", "times"])

    return run


def _lists(numbers: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers, kind))


def _known(vocabulary: np.ndarray):
    """Per text: how many words it has, and places in the vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.words_of(batch.column("text"), W.LETTERS):
                at = np.searchsorted(vocabulary, part.hashes)
                at[at == len(vocabulary)] = 0
                hit = vocabulary[at] == part.hashes if len(vocabulary) else np.zeros(len(at), bool)
                row = np.repeat(np.arange(len(part.counts)), part.counts)[hit]
                both, times = np.unique(row * max(len(vocabulary), 1) + at[hit], return_counts=True)
                sizes = np.bincount(both // max(len(vocabulary), 1), minlength=len(part.counts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part.lo:part.hi], pa.array(part.counts, pa.int64()),
                     _lists(both % max(len(vocabulary), 1), sizes, pa.int32()), _lists(times, sizes, pa.int64())],
                    ["doc_id", "n", "terms", "times"])

    return run


def _impacts(documents: int, words: int, weights: np.ndarray):
    """From counts to impacts, and each vector's length with its terms' weights in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            wide = n.astype(object) if 25 * int(n.max(initial=0)) * documents >= 1 << 63 else n
            m = (75 + (25 * wide * documents) // words).astype(np.int64)
            terms, times = batch.column("terms"), batch.column("times").flatten().to_numpy()
            sizes = np.diff(terms.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), sizes)
            impact = (1_000_000_000 * times) // (1000 * times + 12 * m[row])
            place = terms.flatten().to_numpy()
            length = np.sqrt(np.bincount(row, impact.astype(np.float64) ** 2 * weights[place], len(n)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(length), _lists(place, sizes, pa.int32()),
                 _lists(impact, sizes, pa.int64())], ["doc_id", "length", "terms", "impacts"])

    return run


@dataclass
class Item:
    """A query vector: its row, terms by falling weight, integer weights, lengths behind each focus.

    Both sides carry the square root of a term's weight, so that the product of lengths
    bounds the score tightly; ``scaled`` is repeats times that root.
    """

    row: int
    terms: np.ndarray
    exact: np.ndarray
    scaled: np.ndarray

    @property
    def length(self) -> float:
        return float(np.sqrt((self.scaled ** 2).sum()))


class Bucket:
    """Vectors of like length, by term."""

    def __init__(self, ids: pa.Array, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray,
                 impacts: np.ndarray, weights: np.ndarray):
        self.ids, self.lengths, self.rows = ids, lengths, len(lengths)
        at = np.argsort(terms, kind="stable")
        self.row, self.impact = np.repeat(np.arange(self.rows), sizes)[at], impacts[at]
        self.scaled = self.impact * np.sqrt(weights[terms[at]])
        self.first = np.searchsorted(terms[at], np.arange(len(weights) + 1))

    def postings(self, term: int) -> slice:
        return slice(self.first[term], self.first[term + 1])

    def survivors(self, item: Item, need: float) -> np.ndarray:
        """Rows that may score ``need`` or more."""
        lengths = self.lengths
        if need <= 0:
            return np.flatnonzero(lengths > 0)
        least = need * (1 - SLACK)
        if item.length * lengths[0] < least:
            return np.empty(0, np.int64)
        cosine = np.clip(least / np.maximum(item.length * lengths, 1e-300), 0.0, 2.0)
        open_ = cosine <= 1 + SLACK
        spread = np.sqrt(np.maximum(1 - np.minimum(cosine, 1.0) ** 2, 0.0))
        partial, squares, used = np.zeros(self.rows), np.zeros(self.rows), 0.0
        for term, q in zip(item.terms[:FOCUS], item.scaled[:FOCUS]):
            post, unit = self.postings(term), q / item.length
            value = np.zeros(self.rows)
            value[self.row[post]] = self.scaled[post]
            partial += q * value
            squares += value ** 2
            used += q * q
            # the interval a unit vector's coordinate lies in when its cosine is that large: no upper
            # end where the axis itself is as near
            own, side = value / np.maximum(lengths, 1e-300), math.sqrt(max(1 - unit * unit, 0.0)) * spread
            open_ &= own >= unit * cosine - side - SLACK
            open_ &= (own <= unit * cosine + side + SLACK) | (cosine <= unit + SLACK)
        rest = math.sqrt(max(item.length ** 2 * (1 + SLACK) - used, 0.0))
        others = np.sqrt(np.maximum(lengths ** 2 * (1 + SLACK) - squares, 0.0))
        return np.flatnonzero(open_ & (partial + rest * others >= least))

    def exact(self, item: Item, rows: np.ndarray) -> np.ndarray:
        """The rows' scores in integers."""
        score = np.zeros(self.rows, np.int64)
        for term, weight in zip(item.terms.tolist(), item.exact.tolist()):
            post = self.postings(term)
            score[self.row[post]] += weight * self.impact[post]
        return score[rows]


class Best:
    """The k best (score, doc_id) of each item so far; what an item needs to enter."""

    def __init__(self, k: int, need: dict[int, int]):
        self.k, self.need, self.found = k, dict(need), {}

    def add(self, row: int, scores: np.ndarray, ids: pa.Array) -> None:
        held = self.found.get(row, [])
        # ascending ids, a null one last
        rows = [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids.to_pylist())]
        self.found[row] = sorted(held + rows)[:self.k]
        if len(self.found[row]) == self.k:
            self.need[row] = max(self.need.get(row, 0), -self.found[row][-1][0])


def _searched(items: list[Item], weights: np.ndarray, k: int, need: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, need)
        for batch in batches:
            for lo in range(0, batch.num_rows, BUCKET):
                part = batch.slice(lo, BUCKET)
                lengths = part.column("length").to_numpy()
                terms, impacts = part.column("terms"), part.column("impacts")
                bucket = Bucket(part.column("doc_id"), lengths, np.diff(terms.offsets.to_numpy()),
                                terms.flatten().to_numpy(), impacts.flatten().to_numpy(), weights)
                for item in items:
                    rows = bucket.survivors(item, best.need.get(item.row, 0))
                    if not len(rows):
                        continue
                    score = bucket.exact(item, rows)
                    good = score >= max(best.need.get(item.row, 0), 1)
                    rows, score = rows[good], score[good]
                    if len(rows) > k:  # only those that can be among this bucket's best
                        least = np.partition(score, len(score) - k)[len(score) - k]
                        rows, score = rows[score >= least], score[score >= least]
                    if len(rows):
                        best.add(item.row, score, bucket.ids.take(pa.array(rows)))
        for row, found in best.found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * len(found), pa.int64()), pa.array([None if no else i for _, no, i in found], pa.int64()),
                 pa.array([-s for s, _, _ in found], pa.int64())], ["row", "doc_id", "score"])

    return run


_FOUND = "row long, doc_id long, score long"


def _blocks(rows: DataFrame) -> list[list[tuple]]:
    """Names of item blocks (block, of), each within the bounds unless it is a single item."""
    total = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    of = max(1, -(-total[0] // BLOCK_ITEMS), -(-(total[1] or 0) // BLOCK_WORDS))
    while True:
        sizes = rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(of)).alias("block")).agg(
            F.count(F.lit(1)).alias("items"), F.sum("n").alias("words"))
        over = sizes.filter((F.col("items") > 1) & ((F.col("items") > 2 * BLOCK_ITEMS) | (F.col("words") > 4 * BLOCK_WORDS)))
        if over.isEmpty() or of > 4 * total[0]:
            return [(b, of) for b in range(of)]
        of *= 2


def ranked(documents: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per item its k best documents: item_id, rank, doc_id, score.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A
    word's weight is floor(1000 ln((2N+2)/(2df+1))), N being the documents with a word and
    df those with this one; a document's score is the sum over the item's words, repeats
    included, of weight * (10^9 tf div (1000 tf + 12 m)) with m = 75 + 25 n N div L. Scores
    of 0 are left out; of equal scores the lesser doc_id comes first, a null one last.

    A null or empty text has no words: such a document counts nowhere and such an item has
    no rows. Repeated rows of either table count, and are ranked, each on its own. Empty
    tables give an empty result. Other columns are not read.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "lexical")
    item_type = dict(items.dtypes)[item_col]
    asked = work.keep(
        items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
        .mapInArrow(_terms("item_id"), f"item_id {item_type}, n long, terms array<long>, times array<long>")
        .filter("n > 0").withColumn("row", F.monotonically_increasing_id()), "items")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block, of in _blocks(asked):
        mine = asked.filter(F.pmod(F.xxhash64("row"), F.lit(of)) == block)
        found = _block(work, docs, mine.select("row", "terms", "times").collect(), k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    best = top_k(out, ["row"], [F.desc("score"), F.col("doc_id").asc_nulls_last()], k, "rank")
    return best.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def _block(work: Workspace, docs: DataFrame, asked: list, k: int) -> DataFrame | None:
    """The best of one block of items, some of them more than once over the tasks."""
    if not asked:
        return None
    vocabulary = np.unique(np.concatenate([np.array(r.terms, np.int64) for r in asked]).view(np.uint64))
    counts = work.keep(docs.mapInArrow(
        _known(vocabulary), "doc_id long, n long, terms array<int>, times array<long>").filter("n > 0"), "counts")
    documents, words = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return None
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()
    df = np.zeros(len(vocabulary), np.int64)
    df[held["term"]] = held["count"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    items = []
    for r in asked:
        terms = np.searchsorted(vocabulary, np.array(r.terms, np.int64).view(np.uint64))
        times = np.array(r.times, np.int64)
        scaled = times * np.sqrt(weights[terms])
        at = np.argsort(-scaled, kind="stable")
        items.append(Item(r.row, terms[at], (times * weights[terms])[at], scaled[at]))
    vectors = work.keep(
        counts.filter(F.size("terms") > 0)
        .mapInArrow(_impacts(documents, words, weights), "doc_id long, length double, terms array<int>, impacts array<long>")
        .sortWithinPartitions(F.desc("length")), "vectors")
    work.drop(counts)
    edge = vectors.select(F.percentile_approx("length", F.lit(1 - FIRST_SHARE))).first()[0]
    if edge is None:
        return None
    longest = vectors.filter(F.col("length") >= edge).sortWithinPartitions(F.desc("length"))
    first = work.keep(longest.mapInArrow(_searched(items, weights, k, {}), _FOUND), "first")
    kth = top_k(first, ["row"], [F.desc("score")], k, "rank").filter(F.col("rank") == k)
    need = {r.row: r.score for r in kth.select("row", "score").collect()}
    rest = vectors.filter(F.col("length") < edge).sortWithinPartitions(F.desc("length"))
    return first.unionByName(work.keep(rest.mapInArrow(_searched(items, weights, k, need), _FOUND), "rest"))
