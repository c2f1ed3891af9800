"""Token counts that follow edits.

Each document is a row of segments, cut where a visible character is followed by white
space. There the splitting into pre-tokens ends whatever stands on either side, so the
counts of the segments add up to that of the text. Over them lies a tree of sums, of
characters and of tokens, kept as an array with the children of node i at 2i and 2i+1.

An edit finds its segments by descending the tree, takes in as many neighbours as it
needs for both ends to be such places again, re-encodes that stretch alone and updates
the sums above. The tree is built anew when a segment outgrows its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from larder.llm.bpe import BLANK, encode_piece, encoding, pieces, read_ranks

SEGMENT = 512
#: A segment is cut anew when it has grown to so many characters.
TOO_LONG = 8 * SEGMENT

TREE = "text string, chars array<int>, tokens array<int>, n_tokens long"


class Tree:
    """The segments of one text and the sums over them."""

    def __init__(self, coder: tiktoken.Encoding, text: str):
        self.coder, self.encoded = coder, 0
        self._build(list(pieces(text, SEGMENT)))

    @classmethod
    def restored(cls, coder: tiktoken.Encoding, text: str, chars: list[int], tokens: list[int]) -> Tree:
        """The tree of a stored row; nothing is encoded."""
        own = cls.__new__(cls)
        own.coder, own.encoded, own.chars, own.tokens = coder, 0, list(chars), list(tokens)
        own.size, at, own.parts = len(chars) // 2, 0, []
        for n in own.chars[own.size:]:
            own.parts.append(text[at:at + n])
            at += n
        return own

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(encode_piece(self.coder, text)) if text else 0

    def _build(self, parts: list[str], counts: list[int] | None = None) -> None:
        self.size = 1 << max(0, (len(parts) - 1).bit_length())
        counts = counts or [self._count(p) for p in parts]
        blank = self.size - len(parts)
        self.parts = parts + [""] * blank
        self.chars = [0] * self.size + [len(p) for p in parts] + [0] * blank
        self.tokens = [0] * self.size + counts + [0] * blank
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def _find(self, place: int) -> tuple[int, int]:
        """(segment, offset) of a character; the end of the text lies in the last segment."""
        i = 1
        while i < self.size:
            i *= 2
            if place >= self.chars[i] and self.chars[i + 1]:
                place -= self.chars[i]
                i += 1
        return i - self.size, place

    def _set(self, segment: int, part: str, count: int) -> None:
        i = segment + self.size
        more_chars, more_tokens = len(part) - self.chars[i], count - self.tokens[i]
        self.parts[segment] = part
        while i:
            self.chars[i] += more_chars
            self.tokens[i] += more_tokens
            i //= 2

    def edit(self, place: int, n_deleted: int, inserted: str) -> None:
        """Replace characters; places beyond the text are moved to its end."""
        total = self.chars[1]
        place = min(max(place, 0), total)
        end = min(place + max(n_deleted, 0), total)
        first, offset = self._find(place)
        last, stop = self._find(end)
        part = self.parts[first][:offset] + inserted + self.parts[last][stop:]
        part, first = self._joined(part, first, -1)
        part, last = self._joined(part, last, 1)
        for segment in range(first, last + 1):
            if segment == first:
                self._set(segment, part, self._count(part))
            elif self.parts[segment]:
                self._set(segment, "", 0)
        if len(part) > TOO_LONG:
            kept = [(p, c) for p, c in zip(self.parts, self.tokens[self.size:]) if p]
            cut = [(q, c if q == p else self._count(q)) for p, c in kept
                   for q in (pieces(p, SEGMENT) if p is part else [p])]
            self._build([p for p, _ in cut], [c for _, c in cut])

    def _joined(self, part: str, segment: int, step: int) -> tuple[str, int]:
        """Take in neighbours on one side until the text is cut at a safe place there."""
        at = segment + step
        while 0 <= at < self.size:
            other = self.parts[at]
            if other:
                left, right = (other, part) if step < 0 else (part, other)
                if part and not left[-1].isspace() and right[0] in BLANK:
                    break
                part, segment = left + right, at
            at += step
        return part, segment


def _rows(tree: Tree) -> list:
    return [tree.text, tree.chars, tree.tokens, tree.n_tokens]


_EDIT = "array<struct<place:long,n_deleted:long,inserted:string>>"


def trees(documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text, chars and tokens (the tree's sums), n_tokens.

    A null text is an empty one. Repeated rows and null ids are rows like others; an
    empty table gives an empty result; other columns are not read.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = [_rows(Tree(coder, t or "")) for t in batch.column("text")[lo:lo + 256].to_pylist()]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:lo + 256], pa.array(columns[0], pa.string()),
                     pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.int32())),
                     pa.array(columns[3], pa.int64())], ["doc_id", "text", "chars", "tokens", "n_tokens"])

    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id long, {TREE}")


def with_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with their edits, in order: edits has doc_id, seq, place, n_deleted, inserted.

    Places refer to the text as earlier edits left it. Edits of unknown or null documents
    are dropped; documents without edits have an empty list. A document's edits must be
    applied one after another, so they are one row.
    """
    own = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(
        F.struct("seq", "place", "n_deleted", "inserted"))).alias("_all"))
    listed = F.transform("_all", lambda e: F.struct(
        e["place"].cast("long").alias("place"), e["n_deleted"].cast("long").alias("n_deleted"),
        e["inserted"].alias("inserted")))
    return state.join(own.select("doc_id", listed.alias("edits")), "doc_id", "left").withColumn(
        "edits", F.coalesce("edits", F.array().cast(_EDIT)))


def edited(state: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Trees after their edits: the columns of ``trees``, n_before, n_encoded.

    n_encoded counts the characters that had to be encoded again. A null place is 0, a
    null number of deleted characters 0, a null insertion empty.
    """
    ranks = state.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for row in batch.slice(lo, 256).to_pylist():
                    tree = Tree.restored(coder, row["text"], row["chars"], row["tokens"])
                    for e in row["edits"] or []:
                        tree.edit(e["place"] or 0, e["n_deleted"] or 0, e["inserted"] or "")
                    rows.append([*_rows(tree), row["n_tokens"], tree.encoded])
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:lo + 256], pa.array(columns[0], pa.string()),
                     pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.int32())),
                     *[pa.array(c, pa.int64()) for c in columns[3:]]],
                    ["doc_id", "text", "chars", "tokens", "n_tokens", "n_before", "n_encoded"])

    columns = state.select("doc_id", "text", "chars", "tokens", "n_tokens", F.col("edits").cast(_EDIT).alias("edits"))
    return columns.mapInArrow(run, f"doc_id long, {TREE}, n_before long, n_encoded long")
