"""Language identification with string kernels.

The kernel of two texts is the share of byte n-grams (blended, n = 1 to 4) present in
both: |a and b| / sqrt(|a| |b|), over n-grams hashed into 2**15 places. A bounded sample
of labelled documents is kept as presence bits; some of them per language are landmarks
for a Nyström map, on which one ridge regression per language against the rest is fitted.
Whole texts are then scored in batches: presence matrix x landmarks x weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.llm import words as W

BITS = 15
PLACES = 1 << BITS
MAX_N = 4
#: Bounds of the training sample: documents and landmarks per language, and of all languages
#: together. With many languages each gets an even share of the latter, one at least.
PER_LANGUAGE, LANDMARKS = 300, 32
ALL_DOCUMENTS, ALL_LANDMARKS = 9600, 1024
RIDGE = 0.3
#: Sharpness of the scores; texts per matrix product.
SHARPNESS, BATCH = 4.0, 128
UNKNOWN = "und"
#: Score from which on a prediction overrules a document's own label.
REJECT_FROM = 0.9

_MULTIPLY = np.uint32(2654435761)


def presence(data: np.ndarray) -> np.ndarray:
    """One byte per place: does the text hold an n-gram of that hash?"""
    out = np.zeros(PLACES, np.uint8)
    code = data.astype(np.uint32) + np.uint32(1)
    gram = np.zeros(len(code), np.uint32)
    for n in range(1, MAX_N + 1):
        if len(code) < n:
            break
        gram = gram[:len(code) - n + 1] * np.uint32(257) + code[n - 1:]
        out[((gram + np.uint32(n)) * _MULTIPLY) >> np.uint32(32 - BITS)] = 1
    return out


def _lowered(column: pa.Array) -> Iterator[np.ndarray]:
    for text in column:
        yield np.frombuffer((text.as_py() or "").lower().encode(), np.uint8)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose label and hash this task has not met yet, so copies of a text stay in their task."""
    met: set = set()
    for batch in batches:
        keys = zip(batch.column("lang").to_pylist(), batch.column("hash").to_pylist())
        fresh = [i for i, key in enumerate(keys) if key not in met and not met.add(key)]
        yield batch.take(pa.array(fresh, pa.int64()))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(presence(x)).tobytes() for x in _lowered(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(bits, pa.binary())],
                                         ["lang", "rank", "bits"])


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def margins(self, bits: np.ndarray) -> np.ndarray:
        """One margin per language for every row of presence bytes."""
        return _kernel(bits, self.landmarks) @ self.weights


def _unit(bits: np.ndarray) -> np.ndarray:
    rows = bits.astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


def _kernel(bits: np.ndarray, unit_landmarks: np.ndarray) -> np.ndarray:
    return (_unit(bits) @ unit_landmarks.T).astype(np.float64)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def remainder(id_col: str, modulus: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on at most per_language documents of each language (columns text, lang).

    The sample is those different texts with the least hash. It is first cut down by a hash
    threshold that follows the number of different texts, whatever their copies, so that
    ranking handles a few hundred rows of each language and not all. The threshold aims at
    more than twice the sample, and the estimated count is good to about a twentieth.
    Every label that occurs is fitted; None without any.
    """
    seen = labelled.filter(F.col("lang").isNotNull() & has_letter(F.col("text"))).select(
        "text", "lang", F.xxhash64("text").alias("hash"))
    counts = seen.groupBy("lang").agg(
        F.approx_count_distinct("hash").alias("texts")).collect()
    if not counts:
        return None
    per_language = max(1, min(per_language, ALL_DOCUMENTS // len(counts)))
    landmarks = max(1, min(landmarks, ALL_LANDMARKS // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (
        r["lang"], min(1 << 30, int((1 << 30) * (per_language * 2 + 50) / max(r["texts"], 1)) + 1))])
    few = seen.withColumn("place", F.pmod("hash", F.lit(1 << 30))).filter(F.col("place") < share[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "hash"))
    sample = (few.mapInArrow(_once, few.schema).dropDuplicates(["lang", "hash"])
              .withColumn("rank", rank).filter(F.col("rank") <= per_language)
              .select("lang", "rank", "text").mapInArrow(_packed, "lang string, rank int, bits binary")
              .toPandas().sort_values(["lang", "rank"], ignore_index=True))
    if sample.empty:
        return None
    packed = np.frombuffer(b"".join(sample["bits"]), np.uint8).reshape(len(sample), -1)
    names = sorted(sample["lang"].unique())
    marks = _unit(np.unpackbits(packed[(sample["rank"] <= landmarks).to_numpy()], axis=1))
    among = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    mapped = np.concatenate([_kernel(np.unpackbits(packed[lo:lo + BATCH], axis=1), marks)
                             for lo in range(0, len(packed), BATCH)]) @ root
    targets = np.where(sample["lang"].to_numpy()[:, None] == np.array(names), 1.0, -1.0)
    # Each language weighs the same, however many documents the sample has of it.
    weight = 1 / sample.groupby("lang")["rank"].transform("count").to_numpy()
    left = (mapped * weight[:, None]).T @ mapped + RIDGE / len(sample) * np.eye(mapped.shape[1])
    solved = np.linalg.solve(left, (mapped * weight[:, None]).T @ targets)
    return Model([str(x) for x in names], marks, root @ solved)


def predicted(documents: DataFrame, model: Model | None, text_col: str = "text",
              names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents with lang_pred and score, or so named, added. Only the text decides.

    ``und`` with score 0 for a null text, one without a letter, or without a model;
    otherwise a learned language, and how far its margin stands above the others, 0 to 1.
    Rows are taken one by one: repeated rows, null ids and other columns stay as they
    are. Columns of the input that have these names are replaced.
    """
    rest = [c for c in documents.columns if c not in names]
    source = documents.select(*[F.col(f"`{c}`") for c in rest])
    if model is None:
        return source.withColumns(dict(zip(names, (F.lit(UNKNOWN), F.lit(0.0)))))
    shared = documents.sparkSession.sparkContext.broadcast(
        (model.languages, np.packbits(model.landmarks > 0, axis=1), model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, packed, weights = shared.value
        own = Model(languages, _unit(np.unpackbits(packed, axis=1)), weights)
        for batch in batches:
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            texts = batch.column(batch.num_columns - 1)
            known = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            for lo in range(0, len(known), BATCH):
                rows = known[lo:lo + BATCH]
                margins = own.margins(np.stack([presence(x) for x in _lowered(texts.take(pa.array(rows)))]))
                raised = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)))
                best[rows], score[rows] = margins.argmax(axis=1), raised.max(axis=1) / raised.sum(axis=1)
            chosen = pa.array([languages[i] if i >= 0 else UNKNOWN for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], chosen, pa.array(score)], [*rest, *names])

    kinds = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest]
    text = F.when(has_letter(documents[text_col]), documents[text_col]).alias("_scored")
    return documents.select(*[F.col(f"`{c}`") for c in rest], text).mapInArrow(run, ", ".join([*kinds, f"`{names[0]}` string, `{names[1]}` double"]))


def learned(documents: DataFrame, modulus: int = 5, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang") -> Model | None:
    """The model of the labelled rows outside the held-out fold.

    A row is held out when the crc32 of its id, as text, leaves no remainder by
    ``modulus``; a row without an id is not learned from either.
    """
    rows = documents.filter(remainder(id_col, modulus) != 0)
    return fit(rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))


def identified(documents: DataFrame, modulus: int = 5, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang") -> DataFrame:
    """Learn as ``learned`` and predict every row: doc_id, held_out, lang_pred, score.

    held_out is false for a row without an id. Labels that are null everywhere, or an
    empty table, leave no model: every row is ``und``.
    """
    model = learned(documents, modulus, id_col, text_col, lang_col)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(remainder("doc_id", modulus) == 0, F.lit(False))
    return predicted(rows, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def accepted(documents: DataFrame, wanted: list[str] | None = None, least: float = REJECT_FROM, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is found and believed, as they are.

    Rejected are rows without a text or a letter; rows predicted to be in none of the
    ``wanted`` languages, where these are given; and rows whose own label is one that was
    learned while another language is predicted with a score of ``least`` or more: what
    is labelled wrongly would be filed under the wrong language. A row without a label,
    or with one that was not learned, is judged by its prediction alone.
    """
    model = learned(documents, 5, id_col, text_col, lang_col)
    names = tuple(W.unused(name, documents.columns) for name in ("_language", "_score"))
    found = predicted(documents, model, text_col, names)
    good = F.col(names[0]) != UNKNOWN
    if wanted is not None:
        good &= F.col(names[0]).isin(*wanted)
    if model is not None:
        known = F.coalesce(F.col(lang_col).cast("string").isin(*model.languages), F.lit(False))
        good &= ~(known & (F.col(names[0]) != F.col(lang_col).cast("string")) & (F.col(names[1]) >= least))
        good = F.coalesce(good, F.lit(True))
    return found.filter(good).drop(*names)
