"""Ranked search, vector codes and personal data: brute force, odd rows, properties."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import codes, lexical, pii, queries, trees
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, row long, n int, terms string, item_id string"


# ranked search

def ranked(documents: list, items: list, k: int) -> list:
    """(item_id, rank, doc_id, score) by reading every document for every item."""
    words = [re.findall(brute.LETTERED, brute.lowered(t)) for _, t in documents]
    n_docs, total = sum(bool(w) for w in words), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = []
    for item, text in items:
        found = []
        for (doc_id, _), w in zip(documents, words):
            tf, m = Counter(w), 75 + (25 * len(w) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m))
                        for t in re.findall(brute.LETTERED, brute.lowered(text)) if tf[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return out


def as_rows(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def search_rows(seed: int, n: int) -> tuple[list, list]:
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(300)]
    text = lambda size: " ".join(names[min(int(draw.expovariate(0.03)), 299)] for _ in range(size))
    documents = [(i, text(draw.randrange(1, 120))) for i in range(n)]
    hot = text(80)
    documents += [(n + i, hot) for i in range(n // 2)]
    return documents, [(f"q{i}", text(draw.randrange(1, 12))) for i in range(25)]


@pytest.mark.parametrize("bucket", [16, 4096])
def test_search_equals_reading_everything(spark, monkeypatch, bucket):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    documents, items = search_rows(bucket, 900)
    got = lexical.ranked(spark.createDataFrame(documents, "doc_id long, text string").repartition(3),
                         spark.createDataFrame(items, "item_id string, text string"), 7)
    assert as_rows(got) == sorted(ranked(documents, items, 7), key=repr)


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    documents, items = search_rows(3, 120)
    got = lexical.ranked(spark.createDataFrame(documents, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id string, text string"), 5)
    assert as_rows(got) == sorted(ranked(documents, items, 5), key=repr)


def test_bounds_lose_nothing_and_leave_much_out():
    draw = np.random.default_rng(4)
    weights = draw.integers(1, 9000, 60)
    sizes = draw.integers(1, 20, 2000)
    terms = np.concatenate([draw.choice(60, s, replace=False) for s in sizes])
    impacts = draw.integers(1, 900_000, len(terms))
    row = np.repeat(np.arange(2000), sizes)
    lengths = np.sqrt(np.bincount(row, impacts.astype(float) ** 2 * weights[terms]))
    at = np.argsort(-lengths)
    order = np.argsort(np.argsort(-lengths)[row].argsort() * 0 + np.argsort(at)[row], kind="stable")
    bucket = lexical.Bucket(None, lengths[at], sizes[at], terms[order], impacts[order], weights)
    for _ in range(30):
        own = draw.choice(60, 8, replace=False)
        scaled = np.sqrt(weights[own])
        turn = np.argsort(-scaled)
        item = lexical.Item(0, own[turn], weights[own][turn], scaled[turn])
        score = bucket.exact(item, np.arange(2000))
        need = int(np.sort(score)[-10])
        left = set(bucket.survivors(item, need).tolist())
        assert set(np.flatnonzero(score >= need).tolist()) <= left
        assert len(left) < 1000


def test_search_odd_rows(spark):
    documents = [(1, "alpha Beta"), (1, "alpha Beta"), (2, "ALPHA beta"), (None, "alpha beta"), (3, None), (4, ""),
                 (5, " ... "), (6, "öl Ölpha 1"), (7, "alpha " * 60_000)]
    items = [("a", "Alpha"), ("a", "beta"), (None, "öl"), ("b", None), ("c", ""), ("d", "nothing"), ("e", "alpha alpha öl")]
    docs = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in documents], DOCS)
    asked = spark.createDataFrame([(i, t, 9, 9, "z") for i, t in items],
                                  "item_id string, text string, score long, rank int, doc_id string")
    assert as_rows(lexical.ranked(docs, asked)) == sorted(ranked(documents, items, 20), key=repr)
    assert lexical.ranked(docs.limit(0), asked).count() == 0
    assert lexical.ranked(docs, asked.limit(0)).count() == 0
    assert lexical.ranked(docs.filter("doc_id = 4"), asked).columns == ["item_id", "rank", "doc_id", "score"]


# vector codes

def coded(vectors: list, rounds: int, entries: int) -> tuple:
    """vec_id -> codes and error, and the books, in Python integers."""
    rows = [(i, [[math.floor(1024 * x) for x in v[p * len(v) // 4:(p + 1) * len(v) // 4]] for p in range(4)])
            for i, v in sorted(vectors)]
    books = [[parts[p] for _, parts in rows[:entries]] for p in range(4)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, v: min((apart(v, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        moved = []
        for p in range(4):
            own = {}
            for _, parts in rows:
                own.setdefault(near(p, parts[p])[1], []).append(parts[p])
            moved.append([[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else old
                          for e, old in enumerate(books[p])])
        books = moved
    found = {i: [near(p, parts[p]) for p in range(4)] for i, parts in rows}
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return ({i: ([e for _, e in f], sum(d for d, _ in f)) for i, f in found.items()},
            hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("scale", [1.0, 3000.0])
def test_codes_equal_plain_integers(spark, scale):
    draw = random.Random(int(scale))
    vectors = [(i, [draw.uniform(-1, 1) * scale for _ in range(12)]) for i in range(90)]
    rows = spark.createDataFrame([(i, v, i % 3 or None) for i, v in vectors], "vec_id long, embedding array<double>, label int")
    got = codes.compressed(rows.repartition(3), rounds=3, entries=16).collect()
    want, digest = coded(vectors, 3, 16)
    assert {r.vec_id: (list(r.codes), r.error) for r in got} == want
    assert {r.codebooks_sha256 for r in got} == {digest}
    for label in (None, 1, 2):
        assert {r.label_error for r in got if r.label == label} == {sum(r.error for r in got if r.label == label)}


@pytest.mark.parametrize("bits", [3, 9, 24])
def test_limb_products_are_exact(bits):
    draw = np.random.default_rng(bits)
    a, b = (draw.integers(-(1 << 26), 1 << 26, (40, 16)) for _ in range(2))
    a[0], b[0] = -(1 << 26), (1 << 26)
    want = [[sum(x * y for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]
    assert codes.dots(a, b, bits).tolist() == want
    assert 16 * (2 ** codes.limb_bits(16)) ** 2 <= 2 ** 53


def test_codes_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, parts int, n long, codes string, error double, _key int"
    bad = [None, [1.0, None, 0.0, 0.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], []]
    good = [(3, [0.5, 0.25, -0.5, 0.0]), (1, [0.5, 0.25, -0.5, 0.0]), (1, [0.5, 0.25, -0.5, 0.0]),
            (2, [-0.0001, 1.0, 2.0, 3.0]), (None, [0.0, 0.0, 0.0, 0.0])]
    rows = spark.createDataFrame([(i, v, None, 1, 2, "c", 0.5, 4) for i, v in good]
                                 + [(10 + i, v, 1, 1, 2, "c", 0.5, 4) for i, v in enumerate(bad)], schema)
    got = codes.compressed(rows).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, list(r.codes), r.error) for r in got) == [
        (False, 1, [0, 0, 0, 0], 0), (False, 1, [0, 0, 0, 0], 0), (False, 2, [2, 2, 2, 2], 0),
        (False, 3, [0, 0, 0, 0], 0), (True, 0, [4, 4, 4, 0], 0)]
    assert {r.label_error for r in got} == {0}
    assert codes.compressed(rows.limit(0)).count() == 0
    assert codes.compressed(rows.filter("vec_id >= 10 and vec_id < 14")).count() == 0
    with pytest.raises(ValueError):
        codes.compressed(spark.createDataFrame([(1, [1e12] * 4, 1)], "vec_id long, embedding array<double>, label int"))


# personal data

BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(text: str) -> list:
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True,
                    16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15)[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def exact(text: str) -> list:
    return pii.exact_spans(text, [m.span() for m in re.finditer("[0-9]+", text)])


def test_exact_rules_equal_the_patterns():
    draw = random.Random(8)
    pieces = ["a.b", "@", "x1-", ".", "..", "com", "+", "+1 ", "(017)", " ", "-", "255", "256", "001", "4845168114407329",
              "1.2.3.4", ".5", "12 34", "é", "%_", "4111 1111 1111 1111", "٣", "\n", "_", "0", "me@x.org", "@@", "5-5"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 14)))
        assert exact(text) == base_spans(text), text


def test_exact_rules_on_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_boosted_personal_data(spark, FOLDER).collect()}
    for i, text in texts.items():
        want = base_spans(text)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in range(4)]
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(got[i].spans.split(","))


def test_very_long_texts_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "+1" * 500_000, "a@" * 500_000, "1 " * 300_000,
                 "+" + "1(" * 500_000, "at dot " * 100_000):
        runs = [m.span() for m in re.finditer("[0-9]+", text)]
        pii.exact_spans(text, runs)
        pii.candidates(text, runs)


def planted(n: int, seed: int, written: bool) -> list:
    """Texts with personal data and with numbers that are none; some data written otherwise."""
    draw = random.Random(seed)
    num = lambda size: "".join(draw.choice("0123456789") for _ in range(size))
    word = lambda: "".join(draw.choice("aeioulnrst") for _ in range(draw.randrange(2, 9)))
    out = []
    for i in range(n):
        phone = f"({num(3)}) 555-{num(4)}"
        parts = [word() for _ in range(30)]
        parts[5] = f"call +1 {phone}" if not written else f"call 1 {phone}"
        parts[12] = f"mail {word()}.{num(2)}@{word()}.example.com" if not written else f"mail {word()}_{num(2)}(at){word()}(dot)example(dot)com"
        parts[20] = f"order {num(9)} of {num(4)}-{num(2)}-{num(2)}"
        parts[25] = f"version {num(1)}.{num(2)}.{num(3)}"
        out.append((i, " ".join(parts)))
    return out


def test_trees_find_what_is_written_otherwise_and_leave_numbers(spark):
    judge = pii.learned(spark.createDataFrame(planted(1500, 1, False), "doc_id long, text string"))
    assert judge.model is not None and min(judge.thresholds[pii.EMAIL], judge.thresholds[pii.PHONE]) < 1
    found = wrong = 0
    for _, text in planted(200, 2, True):
        spans = {(pii.KINDS[k], text[a:b]) for (k, a, b), _, _ in judge.spans(text)}
        want = {("phone", re.search(r"1 \([0-9]+\) [0-9-]+", text)[0]), ("email", re.search(r"\S+\(at\)\S+", text)[0])}
        found += len(spans & want)
        wrong += len(spans - want)
    assert found >= 0.9 * 400 and wrong <= 0.05 * 400


def test_boosted_trees_and_calibration():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = trees.calibrate(trees.fit(x[:2000], y[:2000]), x[2000:2500], y[2000:2500])
    p = model.probability(x[2500:])
    assert ((p > 0.5) == y[2500:]).mean() > 0.95
    assert abs(p.mean() - y[2500:].mean()) < 0.05
    assert pii.threshold(np.array([0.9] * 30 + [0.5] * 10), np.array([1.0] * 30 + [0.0] * 10)) == 0.9
    assert pii.threshold(np.array([0.9]), np.array([1.0])) == float("inf")


def test_personal_data_of_odd_rows(spark):
    rows = [(1, "me@x.org and 10.0.0.1"), (1, "me@x.org and 10.0.0.1"), (2, None), (3, ""), (None, "+1 (017) 555-7713"),
            (4, "é me@x.org " + "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in rows], DOCS).withColumnRenamed("terms", "spans")
    got = sorted((r.doc_id or 0, [(s.kind, s.start, s.stop) for s in r.spans if s.exact]) for r in pii.personal_data(docs).collect())
    two = [("email", 0, 8), ("ip", 13, 21)]
    assert got == [(0, [("phone", 0, 17)]), (1, two), (1, two), (2, []), (3, []), (4, [("email", 2, 10)])]
    assert pii.personal_data(docs.limit(0)).count() == 0
    cut = {r.doc_id: r.text for r in pii.redacted(docs.filter("doc_id < 4")).collect()}
    assert cut == {1: "[EMAIL] and [IP]", 2: None, 3: ""}


def test_trees_are_fitted_on_every_different_text(spark):
    texts = spark.createDataFrame(planted(6000, 3, False), "doc_id long, text string")
    want = Counter()
    for text, seed in texts.select("text", F.xxhash64("text")).collect():
        for features, label in pii._examples(text, seed & 0xFFFF):
            want[label, seed % 4 == 0] += 1
    got = pii._cells(texts.unionByName(texts), "text").groupBy("label", "held").agg(F.sum("n").alias("n"))
    assert {(r.label, r.held): r.n for r in got.collect()} == dict(want)
    assert sum(want.values()) > 40_000


def test_sums_over_parts_grow_the_same_trees():
    draw = np.random.default_rng(7)
    cells, n = draw.integers(0, 8, (900, 3)).astype(np.uint8), draw.integers(1, 5, 900)
    y = (cells[:, 0] > 3) ^ (cells[:, 1] > 5)

    def of(at, n=n):
        return lambda grown, tree, level, start: trees.sums(
            cells[at], y[at], n[at], trees.advanced(cells[at], np.full(len(y[at]), start), grown), tree, level, 8)

    parts = [of(slice(lo, lo + 300)) for lo in (0, 300, 600)]
    whole = trees.grow(of(slice(None)), 8, 0.5, rounds=8)
    split = trees.grow(lambda *a: sum(part(*a) for part in parts), 8, 0.5, rounds=8)
    assert all(np.array_equal(a, b) for s, t in zip(whole[0], split[0]) for a, b in zip(s, t))
    copied = trees.grow(of(np.repeat(np.arange(900), n), np.ones(900)), 8, 0.5, rounds=8)
    assert all(np.array_equal(a, b) for s, t in zip(whole[0], copied[0]) for a, b in zip(s, t))
