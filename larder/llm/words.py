"""Words of whole Arrow text columns as 64-bit hashes, found by array arithmetic.

A word is a run of bytes of one class. Both classes used here (everything but white
space; ASCII letters, digits and all of non-ASCII) can be told from single bytes, so
UTF-8 needs no decoding. Text is taken in slices of whole documents, which bounds the
memory of a task by the slice or by its one longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BYTES = np.arange(256)
#: `[^\\x20\\x09-\\x0D]+`
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z
LETTERS = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def constants(n: int, seed: int, odd: bool = True) -> np.ndarray:
    """n fixed 64-bit numbers, the same in every process."""
    out = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)
    return out | np.uint64(1) if odd else out


_CODE = constants(256, 1)
_JOIN = constants(64, 2)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over the whole of it."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _ODD), ("down", _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """Words of the rows lo..hi of a column; row r holds hashes[first[r-lo]:first[r-lo+1]]."""

    lo: int
    hi: int
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(column: pa.Array, kind: np.ndarray) -> Iterator[Words]:
    """Slices of a text column; a null text has no words."""
    texts = column.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_BYTES, "right")) - 1)
        yield _slice(lo, hi, data[ends[lo]:ends[hi]], ends[lo:hi + 1] - ends[lo], kind)
        lo = hi


def _slice(lo: int, hi: int, data: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> Words:
    n = len(data)
    if not n:
        return Words(lo, hi, np.empty(0, np.uint64), np.zeros(hi - lo + 1, np.int64))
    data = _LOWER[data]
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:n]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[data] * up[:n], out=total[1:])
    spans = (total[stop] - total[start]) * down[start]
    return Words(lo, hi, mix(spans + (stop - start).astype(np.uint64) * _ODD), np.searchsorted(start, ends))


def joined(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (also of those that cross documents)."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    n = len(hashes) - k + 1
    out = hashes[:n] * _JOIN[0]
    for j in range(1, k):
        out += hashes[j:n + j] * _JOIN[j % 64]
    return mix(out + np.uint64(k))


def runs(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, first): where runs of k words that stay in one document begin."""
    n = np.maximum(words.counts - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    return np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], n), first


def shingles(words: Words, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes) of each document's k-word shingles; with fewer words, the whole as one."""
    whole = joined(words.hashes, k)
    for r in range(words.hi - words.lo):
        a, b = words.first[r], words.first[r + 1]
        if b - a >= k:
            yield words.lo + r, whole[a:b - k + 1]
        elif b > a:
            yield words.lo + r, joined(words.hashes[a:b], int(b - a))
        else:
            yield words.lo + r, whole[:0]
