"""Vector code compression: product codes by exact integer k-means.

Components become integers, a vector is cut into equal parts, and every part is coded by
the nearest entry of its position's codebook. Nearest is decided exactly: the squared
distance less the part's own norm, |c|^2 - 2 p.c, needs dot products, and those come from
float64 matrix products of limbs. A number is split into limbs of so few bits that a sum
of a part's products of two limbs stays under 2^53, where doubles hold every integer; the
limb products are then shifted and added in int64. The first least entry wins a tie.

A round is one pass: tasks assign their rows and add them up, per entry one row of sums
leaves a task, and the codebooks (entries x components numbers, whatever the table) come
to the driver and go out with the next pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from larder.operators.relational import salted_join
from larder.session import Workspace

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that are multiplied with the codebooks at once.
ROWS = 8192


def limb_bits(width: int) -> int:
    """Bits of a limb: a sum of ``width`` products of two limbs stays under 2^53."""
    return (53 - (width - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Limbs of int64 numbers, the lowest first, as float64; only the highest is signed."""
    out = []
    while len(x) and (np.abs(x) >> bits).any():
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def dots(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Exact a @ b.T of int64 matrices whose products' sums fit in int64."""
    bits = limb_bits(a.shape[1]) if bits is None else bits
    out = np.zeros((len(a), len(b)), np.int64)
    high = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(high):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per point: the first nearest entry and its squared distance, in integers."""
    apart = (book * book).sum(axis=1)[None, :] - 2 * dots(points, book)
    code = apart.argmin(axis=1)
    return code, apart[np.arange(len(points)), code] + (points * points).sum(axis=1)


def largest_component(width: int) -> int:
    """Components up to this size, either sign, keep every distance of a vector in int64."""
    return int(2 ** ((61 - (PARTS * width - 1).bit_length()) / 2))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part, part.column("parts").flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS, width)


def _summed(books: np.ndarray):
    """Per entry that a task used: how many parts it took and their componentwise sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, points in _blocks(batches, width):
            for p in range(parts):
                code, _ = nearest(points[:, p], books[p])
                n[p] += np.bincount(code, minlength=entries)
                at = np.argsort(code, kind="stable")
                used, first = np.unique(code[at], return_index=True)
                sums[p, used] += np.add.reduceat(points[at, p], first, axis=0)
        part, entry = np.nonzero(n)
        for p, e in zip(part.tolist(), entry.tolist()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width, p, np.int32)), pa.array(np.full(width, e, np.int32)),
                 pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n[p, e])), pa.array(sums[p, e])],
                ["part", "entry", "place", "n", "total"])

    return run


def _coded(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, points in _blocks(batches, books.shape[2]):
            error, codes = np.zeros(len(points), np.int64), np.zeros((len(points), PARTS), np.int64)
            for p in range(PARTS):
                codes[:, p], apart = nearest(points[:, p], books[p])
                error += apart
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes.tolist(), pa.list_(pa.int32())),
                 pa.array(error)], ["vec_id", "label", "codes", "error"])

    return run


def whole_parts(vector: Column, scale: int = SCALE) -> Column:
    """A vector's components as integers: floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Not null, and without a null or non-finite component."""
    bound = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < bound), F.lit(False)))


def next_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; an entry that no part took stays."""
    sums = rows.select("parts").mapInArrow(_summed(books), "part int, entry int, place int, n long, total long")
    found = sums.groupBy("part", "entry", "place").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()
    out = books.copy()
    out[found.part, found.entry, found.place] = found.total.to_numpy(np.int64) // found.n.to_numpy(np.int64)
    return out


def compressed(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, id_col: str = "vec_id",
               vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept vector: vec_id, label, codes, error, label_error, codebooks_sha256.

    codes holds one entry number per part, error the squared distances summed over parts,
    label_error the errors of all vectors of an equal label, null being one label. The
    codebooks start as the parts of the vectors of the least ids and are moved ``rounds``
    times.

    Vectors that are null or hold null or non-finite components are dropped; so are those
    whose length is not the one of the vector of the least id, and all if that is not a
    multiple of four. With fewer vectors than ``entries`` the codebooks have one entry per
    vector. Of equal ids the lesser vector comes first; null ids come last. Repeated rows
    count each and come back each. An empty table gives an empty result. Components whose
    distances could pass 64 bits raise an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "codes")
    kept = vectors.filter(usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
        whole_parts(F.col(vector_col)).alias("parts"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("parts")]
    least = kept.orderBy(*order).select(F.size("parts")).first()
    size = least[0] if least else 0
    width = size // PARTS
    rows = work.keep(kept.filter((F.size("parts") == size) & F.lit(size > 0 and size % PARTS == 0)), "rows")
    largest = rows.agg(F.max(F.greatest(F.array_max("parts"), -F.array_min("parts")))).first()[0]
    if largest is None:
        books = np.zeros((PARTS, 1, max(width, 1)), np.int64)
    else:
        if largest > largest_component(width):
            raise ValueError(f"a component of {largest} has distances beyond 64 bits")
        first = rows.orderBy(*order).select("parts").limit(entries).collect()
        books = np.array([r[0] for r in first], np.int64).reshape(-1, PARTS, width).transpose(1, 0, 2)
        for _ in range(rounds):
            books = next_books(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = work.keep(rows.mapInArrow(
        _coded(books), f"vec_id long, label {dict(rows.dtypes)['label']}, codes array<int>, error long"), "coded")
    # null is one label among others, and any label may hold most of the rows
    named = out.withColumns({"_none": F.col("label").isNull(), "_key": F.col("label").cast("string")})
    named = named.withColumn("_key", F.coalesce("_key", F.lit("")))
    sums = named.groupBy("_none", "_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return salted_join(named, sums.drop("n"), ["_none", "_key"], sums.drop("label_error"), spread_by=["vec_id", "error"]).select(
        "vec_id", "label", "codes", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def code_text(codes: Column) -> Column:
    """Two hex digits per part."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
