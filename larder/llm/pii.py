"""Personal data by candidate spans and boosted trees.

Exact rules find e-mail addresses, IP addresses, cards and phone numbers; these always
stand. Beside them, generators propose every span that could be one of the four written
otherwise: chains of digit groups under any of the usual separators, four dotted or
defanged numbers, groups of hexadecimal digits with colons, any run around an at sign, and
addresses with the signs spelled out. Such spans overlap freely. Boosted trees judge each
by its format and its surroundings; the calibrated probability must pass a threshold of
its kind, and of overlapping spans the likeliest stays.

There are no labels of personal data, so the exact rules teach. In all different texts
each finding is an example, and so is the same finding rewritten as the rules do not read
it (the plus sign left out, other separators, signs spelled out); any other candidate is a
counter-example. Every fourth text is held out to calibrate and to set the least threshold
that keeps the wanted precision; a kind that no threshold serves gets none, and adds
nothing. Candidates of the same binned features are counted together in a stored table,
and each level of a tree is one pass over it that adds up gradients by node, feature and
bin; the driver sees those sums only.

Every scan is linear in the text: rules start from signs and from runs of digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from larder.llm import trees
from larder.session import materialise

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Features are whole numbers, told apart one by one up to 23 and then by these edges.
EDGES = np.array([i + 0.5 for i in range(24)] + [26.5, 30.5, 36.5, 44.5, 56.5, 72.5, 120.5])
BINS = len(EDGES) + 1
#: Margins are told apart to this part of one where the trees are calibrated.
MARGIN_PARTS = 64
#: Trees after which the margins are stored anew.
STORED_TREES = 6
#: Tasks that add up one level; each sends its sums, so this bounds what the driver gets.
SUM_TASKS = 8
#: Groups of digits in a candidate: none of the kinds is written in more.
GROUPS = 8
#: Characters of text, and candidates, that are judged at once.
SLICE, ROWS = 1 << 22, 1 << 14
#: Precision that a threshold keeps on held-out candidates, and the examples above it that it needs.
PRECISION, SUPPORT = 0.99, 20

_RUN = re.compile(r"[0-9]+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PAD = re.compile(r"[\x20()./\[\]-]{1,3}")
_AROUND_AT = re.compile(r"[^\s@<>()\[\],;:\"'|=]{1,64}")
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at |@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{1,63}){1,4}")
_SIGNS = (" dot ", "(at)", "[at]", "(dot)", "[dot]")
_HEX = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
_HINTS = [re.compile(p, re.I) for p in (
    r"mail|contact|write|courriel", r"\bip\b|host|server|addr|login", r"card|visa|pay|credit|karte|carte|tarjeta",
    r"phone|tel|call|fax|mobil|cell", r"token|key|hash|sha|md5|secret|id\b|version|isbn|order")]

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(text: str) -> str:
    return "".join(_RUN.findall(text))


def _back(text: str, lo: int, hi: int, kind: re.Pattern) -> int:
    """Start of the run of ``kind`` that ends at hi, not before lo."""
    step = 64
    while hi > lo:
        cut = max(lo, hi - step)
        got = kind.match(text[cut:hi][::-1]).end()
        if got < hi - cut:
            return hi - got
        hi, step = cut, 2 * step
    return hi


def exact_spans(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """The findings of the exact rules, by kind, then place; runs are the text's runs of digits."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start, domain = _back(text, done, at, _LOCAL), _DOMAIN.match(text, at + 1)
        if start < at and domain:
            done = domain.end()
            out.append((EMAIL, start, done))
        at = text.find("@", max(at + 1, done))
    i = 0
    while i + 3 < len(runs):
        four = runs[i:i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            if all(_small(text[a:b]) for a, b in four):
                out.append((IP, four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j, n = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            n += runs[j][1] - runs[j][0]
        if 16 <= n <= 19 and luhn(_digits(text[runs[i][0]:runs[j][1]])):
            out.append((CARD, runs[i][0], runs[j][1]))
        i = j + 1
    at = text.find("+")
    while at >= 0:
        found = _PHONE.match(text, at)
        if found and 8 <= sum(c.isdigit() and c.isascii() for c in found[0]) <= 15:
            out.append((PHONE, at, found.end()))
        at = text.find("+", found.end() if found else at + 1)
    return out


def candidates(text: str, runs: list[tuple[int, int]]) -> set[Span]:
    """Spans that could be personal data, overlapping ones included."""
    out: set[Span] = set()
    chained = [b - a <= 3 and bool(_PAD.fullmatch(text, a, b)) for (_, a), (b, _) in zip(runs, runs[1:])]
    for i, (start, _) in enumerate(runs):
        n = 0
        for j in range(i, min(i + GROUPS, len(runs))):
            if j > i and not chained[j - 1]:
                break
            n += runs[j][1] - runs[j][0]
            if n > 19:
                break
            stop, first = runs[j][1], start
            if first and text[first - 1] == "(" and ")" in text[first:stop]:
                first -= 1
            if first and text[first - 1] == "+":
                first -= 1
            if 13 <= n <= 19:
                out.add((CARD, start, stop))
            if 7 <= n <= 15:
                out.add((PHONE, first, stop))
            if j == i + 3 and all(b - a <= 3 for a, b in runs[i:j + 1]) and all(
                    "." in text[a[1]:b[0]] for a, b in zip(runs[i:j], runs[i + 1:j + 1])):
                out.add((IP, start, stop))
    at = text.find("@")
    while at >= 0:
        before, after = _AROUND_AT.match(text[max(0, at - 64):at][::-1]), _AROUND_AT.match(text, at + 1)
        if before and after:
            stop = after.end()
            while stop > at + 2 and text[stop - 1] in ".!?":
                stop -= 1
            out.add((EMAIL, at - before.end(), stop))
        at = text.find("@", at + 1)
    for sign in _SIGNS:
        at = text.find(sign)
        while at >= 0:
            lo = max(0, at - 160)
            for found in _SPELLED.finditer(text, lo, min(len(text), at + 160)):
                if found.start() > lo or lo == 0:
                    out.add((EMAIL, found.start(), found.end()))
            at = text.find(sign, at + 1)
    if text.count(":") >= 7:
        out.update((IP, m.start(), m.end()) for m in _HEX.finditer(text))
    return out


def _sort_of(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 4 if c in "\"'=:_/" else 3


def features(text: str, span: Span) -> list[float]:
    """Format and surroundings of one span."""
    kind, start, stop = span
    inside, before, after = text[start:stop], text[max(0, start - 40):start], text[stop:stop + 40]
    groups = _RUN.findall(inside)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    tail = inside.rpartition(".")[2] if "." in inside else inside.rpartition(" ")[2]
    word = before.rstrip().rpartition(" ")[2]
    first = groups[0] if groups else ""
    return [
        *(float(kind == k) for k in range(4)), len(inside), len(digits), sum(c.isalpha() for c in inside), len(groups),
        min(sizes), max(sizes), sizes[0], sizes[-1], len(set(digits)), float(first.startswith("0")),
        *(inside.count(c) for c in " .-(/[:@+"), float(bool(digits) and luhn(digits)) if kind == CARD else 0.0,
        float(bool(groups) and all(_small(g) for g in groups)), float("at" in inside.lower() and "dot" in inside.lower()),
        len(tail), float(tail.isalpha()), _sort_of(before[-1:]), _sort_of(after[:1]), _sort_of(before[-2:-1]),
        len(word), float(any(c.isdigit() for c in word)), float(any(c.isdigit() for c in after[:8])),
        float(before[-1:] == "+"), *(float(bool(h.search(before))) for h in _HINTS),
    ]


def rewritten(kind: int, found: str, draw: int) -> str:
    """A finding as the exact rules do not read it; draw chooses how."""
    if kind == EMAIL:
        local, _, domain = found.rpartition("@")
        at, dot = ((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", "."), ("[at]", "[dot]"))[draw % 4]
        return local.replace(".", "_") + at + domain.replace(".", dot)
    if kind == IP:
        return found.replace(".", ("[.]", " . ", "[.]")[draw % 3])
    if kind == CARD:
        digits = _digits(found)
        return (".", "/", "  ")[draw % 3].join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return (found[1:], found[1:].replace(" ", "-"), "00" + found[1:], found[1:].replace("(", "").replace(")", ""))[draw % 4]


def _examples(text: str, seed: int) -> list[tuple[list[float], int]]:
    """Candidates of one text as (features, label), its findings also rewritten.

    Labels: 2 a finding of the rules, 1 a finding rewritten, 0 anything else.
    """
    runs = [m.span() for m in _RUN.finditer(text)]
    base = exact_spans(text, runs)
    own = set(base)
    out = [(features(text, span), 2 * (span in own)) for span in sorted(candidates(text, runs) | own)]
    for i, (kind, start, stop) in enumerate(base):
        lo, hi = max(0, start - 80), min(len(text), stop + 80)
        written = rewritten(kind, text[start:stop], seed + i)
        near = text[lo:start] + written + text[stop:hi]
        want = (kind, start - lo, start - lo + len(written))
        near_runs = [m.span() for m in _RUN.finditer(near)]
        for span in sorted(candidates(near, near_runs)):
            if span[0] == kind and span[1] < want[2] and want[1] < span[2]:
                out.append((features(near, span), int(span == want)))
    return out


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, seed in zip(batch.column("text").to_pylist(), batch.column("digest").to_pylist()):
            made = _examples(text, seed & 0xFFFF)
            if made:
                binned = np.searchsorted(EDGES, np.array([f for f, _ in made]), "left").astype(np.uint8)
                rows = pa.array([[{"cell": c.tobytes(), "label": y} for c, (_, y) in zip(binned, made)]], _EXAMPLES)
                yield pa.RecordBatch.from_arrays([pa.array([seed], pa.int64()), rows], ["digest", "examples"])


_EXAMPLES = pa.list_(pa.struct([("cell", pa.binary()), ("label", pa.int32())]))


def _cells(documents: DataFrame, text_col: str) -> DataFrame:
    """(cell, label, held, n): binned candidates of all different texts, counted."""
    texts = documents.select(F.col(text_col).alias("text")).filter("text is not null").select(
        "text", F.xxhash64("text").alias("digest"))
    made = texts.mapInArrow(_training, "digest long, examples array<struct<cell:binary,label:int>>")
    each = made.dropDuplicates(["digest"]).select((F.pmod("digest", F.lit(4)) == 0).alias("held"), F.inline("examples"))
    return materialise(each.groupBy("cell", "label", "held").agg(F.count(F.lit(1)).alias("n")), "cells")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cells = np.frombuffer(b"".join(batch.column("cell").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return cells, batch.column("label").to_numpy(), batch.column("n").to_numpy()


def _advanced(grown: list, width: int):
    """The same cells with their margins once further trees are added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margin = trees.advanced(_arrays(batch)[0], batch.column("margin").to_numpy(), grown)
                yield batch.set_column(width, "margin", pa.array(margin))

    return run


def _level_sums(train: DataFrame):
    """Sums of one level over the stored cells; see ``trees.grow``. Margins are stored anew every few trees."""
    width = len(train.first().cell)
    kept = {"rows": None, "trees": 0}

    def of(grown: list, tree: tuple, level: int, start: float) -> np.ndarray:
        if kept["rows"] is None:
            kept["rows"] = train.withColumn("margin", F.lit(start))
        if len(grown) - kept["trees"] >= STORED_TREES:
            rows = kept["rows"]
            kept["rows"] = materialise(rows.mapInArrow(_advanced(grown[kept["trees"]:], rows.columns.index("margin")), rows.schema), "margins")
            kept["trees"] = len(grown)
        later, shape = grown[kept["trees"]:], (2, 2 ** level, width, BINS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, np.int64)
            for batch in batches:
                if batch.num_rows:
                    cells, label, n = _arrays(batch)
                    margin = trees.advanced(cells, batch.column("margin").to_numpy(), later)
                    total += trees.sums(cells, label > 0, n, margin, tree, level, BINS)
            g, h = total.reshape(2, -1)
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(g[at]), pa.array(h[at])], ["at", "g", "h"])

        found = kept["rows"].coalesce(SUM_TASKS).mapInArrow(run, "at long, g long, h long").toArrow()
        out = np.zeros((2, int(np.prod(shape[1:]))), np.int64)
        for total, name in zip(out, ("g", "h")):
            np.add.at(total, found["at"].to_numpy(), found[name].to_numpy())
        return out.reshape(shape)

    return of


def _margins(model: trees.Trees):
    """(kind, margin in parts, label, n) of binned candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a value that stands for each bin
        values = np.append(EDGES - 0.5, EDGES[-1] + 0.5)
        for batch in batches:
            if batch.num_rows:
                cells, label, n = _arrays(batch)
                z = np.rint(model.margin(values[cells]) * MARGIN_PARTS).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[:, :4].argmax(axis=1)), pa.array(z), pa.array(label), pa.array(n)], ["kind", "z", "label", "n"])

    return run


class Judge:
    """Fitted trees and a threshold per kind; a kind without one adds no spans."""

    def __init__(self, model: trees.Trees | None, thresholds: list[float]):
        self.model, self.thresholds = model, thresholds

    def probabilities(self, text: str, spans: list[Span]) -> np.ndarray:
        if self.model is None or not spans:
            return np.zeros(len(spans))
        return np.concatenate([
            self.model.probability(np.array([features(text, s) for s in spans[lo:lo + ROWS]]))
            for lo in range(0, len(spans), ROWS)])

    def spans(self, text: str) -> list[tuple[Span, bool, float]]:
        """(span, exact, probability) of what stands in one text, by kind, then place."""
        runs = [m.span() for m in _RUN.finditer(text)]
        base = exact_spans(text, runs)
        others = sorted(candidates(text, runs) - set(base))
        p = self.probabilities(text, base + others)
        out = [(s, True, float(q)) for s, q in zip(base, p)]
        likely = sorted((-q, s) for s, q in zip(others, p[len(base):]) if q >= self.thresholds[s[0]])
        if likely:
            taken = bytearray(len(text))
            for _, a, b in base:
                taken[a:b] = b"\1" * (b - a)
            for q, s in likely:
                if 1 not in taken[s[1]:s[2]]:
                    taken[s[1]:s[2]] = b"\1" * (s[2] - s[1])
                    out.append((s, False, float(-q)))
        return sorted(out)


def threshold(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The least probability from which on held-out candidates keep the wanted precision."""
    n = np.ones(len(p), np.int64) if n is None else n
    at = np.argsort(-p, kind="stable")
    right, seen = (y * n)[at].cumsum(), n[at].cumsum()
    last = np.append(p[at][1:] < p[at][:-1], True) if len(p) else np.empty(0, bool)
    good = np.flatnonzero(last & (right >= PRECISION * seen) & (right >= SUPPORT))
    return float(p[at][good[-1]]) if len(good) else float("inf")


def learned(documents: DataFrame, text_col: str = "text") -> Judge:
    """Trees and thresholds of all different texts.

    To the driver come sums by node, feature and bin, and held-out counts by kind, label
    and rounded margin: as many as there are bins, whatever the table.
    """
    cells = _cells(documents, text_col)
    counts = {(r.held, r.y): r.n for r in cells.groupBy("held", (F.col("label") > 0).alias("y")).agg(F.sum("n").alias("n")).collect()}
    if len(counts) < 4:
        return Judge(None, [float("inf")] * 4)
    width = len(cells.first().cell)
    share = counts[False, True] / (counts[False, True] + counts[False, False])
    grown, start = trees.grow(_level_sums(cells.filter("not held")), BINS, share)
    model = replace(trees.on_values(grown, start, [EDGES] * width), parts=MARGIN_PARTS)
    rows = cells.filter("held").mapInArrow(_margins(model), "kind long, z long, label int, n long").groupBy(
        "kind", "z", "label").agg(F.sum("n").alias("n")).orderBy("kind", "z", "label").collect()
    kind, z, label, n = (np.array(c) for c in zip(*rows))
    scale, shift = trees.platt(z / MARGIN_PARTS, (label > 0).astype(float), n)
    model = replace(model, scale=scale, shift=shift)
    # the rules' own findings stand anyway, so thresholds are set on all others
    p, open_ = trees.sigmoid(scale * (z / MARGIN_PARTS) + shift), label < 2
    return Judge(model, [threshold(*(v[open_ & (kind == k)] for v in (p, (label > 0).astype(np.int64), n))) for k in range(4)])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts, some millions of characters at a time."""
    for batch in batches:
        lo, gathered = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for i, n in enumerate(sizes):
            gathered += n
            if gathered >= SLICE or i + 1 == len(sizes):
                yield batch.column("doc_id")[lo:i + 1], batch.column("text")[lo:i + 1].to_pylist()
                lo, gathered = i + 1, 0


def _found(judge: Judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            spans = [[{"kind": KINDS[k], "start": a, "stop": b, "exact": e, "score": q}
                      for (k, a, b), e, q in judge.spans(text or "")] for text in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return run


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()),
                             ("exact", pa.bool_()), ("score", pa.float64())]))
SPANS = "array<struct<kind:string,start:long,stop:long,exact:boolean,score:double>>"


def personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and its spans (kind, start, stop, exact, score), by kind, then place.

    Places count code points, stop is exclusive. exact marks the findings of the rules,
    which overlap where two kinds read the same signs; added spans overlap nothing. score
    is the calibrated probability (0 where nothing could be learned).

    A null or empty text has no spans. Repeated rows come back each, and teach once. A
    null doc_id is a row like others. An empty table gives an empty result. Other columns
    are not read.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_found(learned(docs)), f"doc_id long, spans {SPANS}")


def redacted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and the text with every span replaced by its kind in brackets.

    Overlapping spans go as one, named by the first. A null text stays null.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    judge = learned(docs)

    def cut(text: str) -> str:
        pieces, done = [], 0
        for (kind, a, b), _, _ in sorted(judge.spans(text), key=lambda s: s[0][1:]):
            if a >= done:
                pieces += [text[done:a], f"[{KINDS[kind].upper()}]"]
            done = max(done, b)
        return "".join(pieces) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([None if t is None else cut(t) for t in texts], pa.string())], ["doc_id", "text"])

    return docs.mapInArrow(run, "doc_id long, text string")
