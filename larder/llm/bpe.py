"""Byte-level BPE encoding and decoding by a local rank file.

Long texts are cut at safe boundaries before encoding, which changes no token: a cut
stands where a word character or mark is followed by white space. There every match of
the splitting pattern ends, whatever follows, and a new one begins, whatever went before.
A run without such a place is left whole.

Runs of many thousand blanks are taken out before the library's splitting sees them, as
that goes back over a run from its end and fails on very long ones. The pattern's match
there is the whole run, or all but its last blank where something visible follows; it is
encoded as one piece, and the last blank goes with what follows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

#: Characters after which a long text is cut at the next safe place.
PIECE = 1 << 16

#: White space in every reading of the splitting pattern; Python's own class is wider.
BLANK = " \t\n\r\f\v"
_SAFE = re.compile(rf"(?<=\S)(?=[{BLANK}])")
#: Blanks in a row from which on a run is encoded apart.
LONG_RUN = 100_000
#: White space as the splitting pattern reads it.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(rf"(?<![{_SPACE}])[{_SPACE}]{{{LONG_RUN},}}")
_loaded: dict[str, tiktoken.Encoding] = {}


def read_ranks(path: str) -> bytes:
    """A rank file, about a megabyte: read once by the driver and sent with the job."""
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file, one per process and file."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _loaded:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        _loaded[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _loaded[key]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``most`` characters whose encodings add up to its own."""
    lo = 0
    while len(text) - lo > most:
        cut = _SAFE.search(text, lo + most)
        if not cut:
            break
        yield text[lo:cut.start()]
        lo = cut.start()
    yield text[lo:]


def encode_piece(coder: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text, very long runs of blanks apart."""
    if len(text) < LONG_RUN:
        return coder.encode_ordinary(text)
    ids, lo = [], 0
    for run in _RUN.finditer(text):
        stop = run.end() - (run.end() < len(text))
        ids += coder.encode_ordinary(text[lo:run.start()])
        ids += coder._encode_single_piece(text[run.start():stop])
        lo = stop
    return ids + coder.encode_ordinary(text[lo:])


def encode(coder: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= PIECE:
        return coder.encode_ordinary(text)
    return [i for piece in pieces(text) for i in encode_piece(coder, piece)]


def encoded(documents: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The documents with ids (array of int) and decoded (binary): the text's tokens and their bytes.

    A null or empty text has no ids and no bytes. Ids of special tokens never occur:
    their strings are ordinary text. Rows are taken one by one, so repeated rows and null
    ids stay as they are and an empty table gives an empty result. A column of the input
    that is named like a result is replaced.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks.value, pattern)
        for batch in batches:
            texts = batch.column("_text")
            for lo in range(0, max(batch.num_rows, 1), 256):
                ids = [encode(coder, t) if t else [] for t in texts[lo:lo + 256].to_pylist()]
                decoded = [coder.decode_bytes(i) for i in ids]
                kept = [batch.column(c)[lo:lo + 256] for c in rest]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())],
                    [*rest, "ids", "decoded"])

    rest = [c for c in documents.columns if c not in ("ids", "decoded")]
    source = documents.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest)
    return source.mapInArrow(run, ", ".join(filter(None, [kinds, "ids array<int>, decoded binary"])))


def digests(documents: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (little-endian 32-bit ids) and decoded_sha256.

    The same cases as ``encoded``; digests are made where the ids are, so neither ids nor
    bytes leave the task.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks.value, pattern)
        for batch in batches:
            n, ids_sum, decoded_sum = [], [], []
            for value in batch.column("text"):
                ids = encode(coder, value.as_py() or "")
                n.append(len(ids))
                ids_sum.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                decoded_sum.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sum), pa.array(decoded_sum)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
