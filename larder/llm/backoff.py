"""Language-model scores by a weighted backoff automaton.

The model smooths every order with the one below it (Dirichlet, strength ``MU``):

    p(w)      = (c(w) + 1) / (N + V + 1)
    p(w | h)  = (c(hw) + MU p(w | h')) / (c(h) + MU),   h' = h without its first word

As an automaton, the state is the longest known history. A word known after it has an arc
with weight log10 p(w | h). Any other word takes the failure arc to h', of weight
log10 MU / (c(h) + MU), and tries again; at the empty history every word has an arc. The
probabilities of all words after a history, the unknown one included, add up to one.

A text is traversed once, from left to right. All texts of a block go in step, the state
of each carried in an array: its arc for the next word if there is one, else failure arcs
down to a state that has it; weights add up and the arc's end is the next state.

The counts of a whole corpus fit no single process, and a traversal needs those of its
own text only. So texts are taken in blocks, each written once as word numbers. A block
asks, with one sorted list of hashes per order and bucket, for the counts of the n-grams
it holds; a bucket adds up the counts of all blocks and answers every list in its order.
There are as many buckets as the corpus needs to keep each small. They are answered in a
few parts, and a part's lists are removed as soon as its answers are stored.
From the answers a block builds its part of the automaton and runs its documents through
it. Lists travel packed, an n-gram once per block that has it.

Words are known by 64-bit hashes, longer n-grams by 48 bits of theirs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from larder.llm import words as W
from larder.session import Workspace, remove

ORDER = 2
MU = 4.0
#: Words of text that a block is closed after.
BLOCK_WORDS = 600_000
#: Bytes of text whose n-grams share a bucket; parts of the buckets that are answered one after another.
BUCKET_BYTES, PARTS = 8 << 20, 4

_END, _BEGIN = np.uint64(0xE0D5F1A2C3B49687), np.uint64(0xB36148D2F0A59C17)
_CHAIN = W.constants(2, 21)


def _packed(values: np.ndarray) -> bytes:
    """Little-endian numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not n:
        return np.empty(0, dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=n * size), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).reshape(-1)


class Block:
    """Documents as one sequence of word numbers, each with its end; the words' hashes."""

    def __init__(self, hashes: np.ndarray, sequence: np.ndarray, sizes: np.ndarray):
        self.hashes, self.sequence, self.sizes = hashes, sequence, sizes
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.empty(0, np.int64)
        self.begin = len(hashes)

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1 to order: (n, keys, words, where, parents).

        keys are the distinct n-grams' hashes, words their last words' numbers; where is
        the n-gram that ends at each place of the sequence, parents its history, as a
        number among the (n-1)-grams; their number itself stands for the begin of a text.
        """
        where, keys = self.sequence.astype(np.int64), self.hashes
        yield 1, self.hashes, np.arange(len(self.hashes)), where, np.zeros(len(where), np.int64)
        for n in range(2, order + 1):
            names, history = np.append(keys, _BEGIN), np.empty(len(where), np.int64)
            history[1:] = where[:-1]
            history[self.first] = len(keys)
            code, where_n = np.unique(history * np.int64(self.begin + 1) + self.sequence, return_inverse=True)
            last = code % (self.begin + 1)
            keys = W.mix(names[code // (self.begin + 1)] * _CHAIN[0] + self.hashes[last] * _CHAIN[1])
            yield n, keys, last, where_n, history
            where = where_n


def _held_out(ids: list, modulus: int, fold: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % modulus == fold for i in ids], bool)


def _ask(order: int, buckets: int, modulus: int, fold: int):
    """From texts to blocks (kind 0) and their lists of n-grams with training counts (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list = []
        gathered = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal hashes, sizes, ids, gathered, made
            if not ids:
                return
            block, made = (task << 24) + made, made + 1
            counts = np.concatenate(sizes)
            held = _held_out(ids, modulus, fold)
            every = np.full(int(counts.sum()) + len(counts), _END)
            ends = np.cumsum(counts + 1) - 1
            inside = np.ones(len(every), bool)
            inside[ends] = False
            every[inside] = np.concatenate(hashes)
            distinct, sequence = np.unique(every, return_inverse=True)
            del every
            own = Block(distinct, sequence, counts + 1)
            training = np.repeat(~held, counts + 1)
            yield _row(kind=0, part=0, block=block, n=len(sequence), n_words=len(distinct),
                       keys=_packed(distinct), counts=_packed(sequence.astype("<u4")),
                       ids=ids, held=held.tolist(), sizes=(counts + 1).tolist())
            for n, keys, _, where, _ in own.grams(order):
                seen = np.bincount(where[training], minlength=len(keys)).astype("<u4")
                if n > 1:
                    keys = keys >> np.uint64(16)
                at = np.lexsort((keys, keys % np.uint64(buckets)))
                keys, seen = keys[at], seen[at]
                edges = np.searchsorted(keys % np.uint64(buckets), np.arange(buckets + 1))
                for bucket in range(buckets):
                    lo, hi = edges[bucket:bucket + 2]
                    if hi > lo:
                        part = np.diff(keys[lo:hi], prepend=np.uint64(0))
                        yield _row(kind=1, part=bucket % PARTS, block=block, width=n, bucket=bucket, n=int(hi - lo),
                                   keys=_packed(part), counts=_packed(seen[lo:hi]))
            hashes, sizes, ids, gathered = [], [], [], 0
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for part in W.words_of(batch.column("text"), W.NOT_SPACE):
                hashes.append(part.hashes)
                sizes.append(part.counts)
                ids += batch.column("doc_id")[part.lo:part.hi].to_pylist()
                gathered += len(part.hashes)
                if gathered >= BLOCK_WORDS:
                    yield from close()
        yield from close()

    return run


_ROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("width", pa.int32()), ("bucket", pa.int32()),
                  ("n", pa.int64()), ("n_words", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()),
                  ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64()))])
_COLUMNS = ("kind int, part int, block long, width int, bucket int, n long, n_words long, keys binary, counts binary, "
            "ids array<long>, held array<boolean>, sizes array<long>")


def _row(**values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in _ROW], schema=_ROW)


def _answer(table: pa.Table) -> pa.Table:
    """One bucket of one order: the sum over all blocks for every entry of every list."""
    lists = [np.cumsum(_unpacked(k.as_py(), n.as_py(), "<u8"), dtype=np.uint64)
             for k, n in zip(table["keys"], table["n"])]
    every, where = np.unique(np.concatenate(lists), return_inverse=True)
    counts = np.concatenate([_unpacked(c.as_py(), n.as_py(), "<u4") for c, n in zip(table["counts"], table["n"])])
    total = np.bincount(where, counts, len(every)).astype("<u8")
    ends = np.cumsum([len(x) for x in lists])
    answers = [_packed(total[where[hi - len(x):hi]]) for x, hi in zip(lists, ends)]
    rows = len(answers)
    return pa.table({
        "block": table["block"].combine_chunks(), "width": table["width"].combine_chunks(),
        "bucket": table["bucket"].combine_chunks(), "n": table["n"].combine_chunks(),
        "counts": pa.array(answers, pa.binary()),
        "known": pa.array([int((total > 0).sum())] + [0] * (rows - 1), pa.int64()),
        "total": pa.array([int(total.sum())] + [0] * (rows - 1), pa.int64())})


class Automaton:
    """The part of the model that one block needs: arcs, failure arcs and where they lead.

    A state is a level (words of its history) and a number among the n-grams of that many
    words; the number behind the last n-gram is the begin of a text. Level 0 is one state.
    """

    def __init__(self, block: Block, totals: list[np.ndarray], tokens: int, types: int, begins: int):
        self.block, self.order = block, len(totals)
        self.base = np.log10((totals[0] + 1.0) / (tokens + types + 1.0))
        self.known = totals[0] > 0
        #: From level 1 on: sorted codes (state, word) of the arcs, their weights and ends.
        self.codes, self.arcs, self.ends = [], [], []
        #: From level 1 on: weight of the failure arc of each state, and its end one level below.
        self.fails, self.below = [], []
        history_count, suffix = np.append(totals[0], begins).astype(np.float64), np.zeros(block.begin + 1, np.int64)
        weight, before = self.base, None
        for n, _, last, where, history in block.grams(self.order):
            if n > 1:
                count = totals[n - 1]
                state, shorter = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
                state[where], shorter[where] = history, before
                raised = np.log10((count + MU * 10.0 ** weight[shorter]) / (history_count[state] + MU))
                self.fails.append(np.log10(MU / (history_count + MU)))
                self.below.append(suffix)
                seen = np.flatnonzero(count > 0)
                code = state[seen] * (block.begin + 1) + last[seen]
                at = np.argsort(code, kind="stable")
                self.codes.append(code[at])
                self.arcs.append(raised[seen][at])
                self.ends.append((seen if n < self.order else shorter[seen])[at])
                history_count = np.append(count, begins).astype(np.float64)
                suffix = np.append(shorter, len(totals[n - 2]))
                weight = raised
            before = where

    def scores(self) -> np.ndarray:
        """log10 probability of each document."""
        block, top = self.block, self.order - 1
        turn = np.argsort(-block.sizes, kind="stable")
        first, sizes = block.first[turn], block.sizes[turn]
        level = np.full(len(turn), top)
        state = np.full(len(turn), len(self.fails[-1]) - 1 if top else 0)
        gained = np.zeros(len(turn))
        open_ = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")
        for step, n in enumerate(open_.tolist()):
            word = block.sequence[first[:n] + step].astype(np.int64)
            for height in range(top, 0, -1):
                mine = np.flatnonzero(level[:n] == height)
                code, codes = state[mine] * (block.begin + 1) + word[mine], self.codes[height - 1]
                at = np.searchsorted(codes, code)
                has = at < len(codes)
                has[has] = codes[at[has]] == code[has]
                met, at, failed = mine[has], at[has], mine[~has]
                gained[met] += self.arcs[height - 1][at]
                state[met], level[met] = self.ends[height - 1][at], min(height + 1, top)
                gained[failed] += self.fails[height - 1][state[failed]]
                state[failed], level[failed] = self.below[height - 1][state[failed]], height - 1
            # an arc never ends below the level it left, so level 0 is those that failed down to it
            root = np.flatnonzero(level[:n] == 0)
            gained[root] += self.base[word[root]]
            if top:
                known = self.known[word[root]]
                state[root], level[root] = np.where(known, word[root], 0), known
        out = np.empty(len(turn))
        out[turn] = gained
        return out


def _run(order: int, buckets: int, tokens: int, types: int, begins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()
                block = Block(_unpacked(get("keys"), get("n_words"), "<u8"), _unpacked(get("counts"), get("n"), "<u4"),
                              np.array(get("sizes"), np.int64))
                totals = []
                answers = {(a["width"], a["bucket"]): a for a in get("answers")}
                for n, keys, _, _, _ in block.grams(order):
                    if n > 1:
                        keys = keys >> np.uint64(16)
                    at = np.lexsort((keys, keys % np.uint64(buckets)))
                    got = np.empty(len(keys), np.int64)
                    got[at] = np.concatenate([_unpacked(a["counts"], a["n"], "<u8") for b in range(buckets)
                                              if (a := answers.get((n, b)))]).astype(np.int64)
                    totals.append(got)
                answers.clear()
                model = Automaton(block, totals, tokens, types, begins)
                of_word = np.stack([totals[0] > 0, model.base])[:, block.sequence]
                known, base = np.add.reduceat(of_word, block.first, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(get("ids"), pa.int64()), pa.array(get("held"), pa.bool_()),
                     pa.array(block.sizes, pa.int64()), pa.array(known.astype(np.int64)),
                     pa.array(base), pa.array(model.scores())],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
                del block, totals, model, of_word, known, base
                pa.default_memory_pool().release_unused()

    return run


def scored(documents: DataFrame, modulus: int = 7, fold: int = 2, order: int = ORDER,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose id, as text, has a crc32 of another remainder than
    ``fold`` by ``modulus``, and scores every row. Words are runs of anything but white
    space, A-Z lower-cased; one end follows each text and counts as a token. base_score
    is the log10 probability by smoothed single words, score by the automaton.

    A null or empty text is its end alone. A null doc_id is learned from. Repeated rows
    count each and come back each. An empty table gives an empty result. Other columns
    are not read.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "backoff")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    path = work.path("asked")
    docs.mapInArrow(_ask(order, buckets, modulus, fold), _COLUMNS).write.partitionBy("kind", "part").parquet(path)
    asked = spark.read.schema(_COLUMNS).parquet(path)
    blocks = asked.filter("kind = 0").select("block", "n", "n_words", "keys", "counts", "ids", "held", "sizes")
    answers = None
    for part in range(PARTS):
        lists = asked.filter(f"kind = 1 AND part = {part}").select("block", "width", "bucket", "n", "keys", "counts")
        answered = work.keep(lists.groupBy("width", "bucket").applyInArrow(
            _answer, "block long, width int, bucket int, n long, counts binary, known long, total long"), "answers")
        remove(spark, f"{path}/kind=1/part={part}")
        answers = answered if answers is None else answers.unionByName(answered)
    sums = answers.filter("width = 1").agg(F.sum("known"), F.sum("total")).first()
    types, tokens = sums[0] or 0, sums[1] or 0
    begins = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    replies = answers.groupBy("block").agg(F.collect_list(F.struct("width", "bucket", "n", "counts")).alias("answers"))
    return blocks.join(replies, "block").mapInArrow(
        _run(order, buckets, tokens, types, begins),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    ).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
             "base_score", "score")
