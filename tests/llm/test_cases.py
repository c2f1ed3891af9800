"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import backoff, bpe, edits, flatgraph, graph, langid, minhash, planes, toolcalls, urlfilter, winnow
from larder.session import Workspace
from tests.llm import brute

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, score double, ids int, id long, row string, bands int"
WORDS = ["alpha", "beta", "gamma", "Delta", "öl", "x1", "the", "of", "and", "naïve"]


def prose(n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


BASE = prose(120, 1)
LONG = prose(30_000, 2)
ODD = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("alpha", "ALPHA").replace(" ", "\t", 3)),
    (4, " ".join(BASE.split()[:-4])), (5, None), (6, ""), (7, "  \n\t "), (8, "one two"), (9, "One  two"),
    (10, "one two three"), (None, BASE), (11, LONG), (12, LONG + " tail"), (13, "1234 !!! 99"), (14, "a" * 5000),
    (15, "日本語 テキスト です"), (16, "a  b\n\nc \n d\t\x1c!　z  "), (17, "it's  'll we'd\r\n x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 0.5, 1, 2, "r", 3) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def coder():
    return bpe.encoding(bpe.read_ranks(RANKS), PATTERN)


def test_near_duplicates(odd, none):
    got = minhash.near_duplicates(odd).collect()
    want = brute.near_duplicates({i: t for i, t in ODD if i is not None})
    assert len(got) == len(ODD)
    for row in got:
        if row.doc_id is None:
            assert (row.component_id, row.kept) == (None, True)
        else:
            assert (row.n_shingles, row.component_id) == want[row.doc_id]
            assert row.kept == (row.component_id == row.doc_id)
    assert want[4][1] == 1 and want[9][1] == 8 and want[12][1] == 11 and want[6] == (0, 6)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 6, 7, 8, 10, 11, 13, 14, 15, 16, 17]


def test_large_groups_of_near_copies_against_brute_force(spark):
    """Copies some of which are linked only through others, and far relatives in the same buckets."""
    draw = random.Random(5)
    texts = {}
    for group in range(3):
        base = prose(60, 10 + group).split()
        for copy in range(40):
            words = list(base)
            for _ in range(draw.randrange(0, 6)):
                words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
            texts[len(texts)] = " ".join(words)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = brute.near_duplicates(texts)
    assert got == want
    assert 3 < len({c for _, c in want.values()}) < 120


def test_rows_of_one_id_are_one_document(spark):
    rows = [(5, prose(50, 1)), (5, prose(50, 2)), (7, prose(50, 2)), (3, prose(50, 3))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 5), (5, 5), (7, 5)]


def test_an_id_with_three_texts_ties_all_of_them(spark):
    rows = [(50, prose(50, 1)), (50, prose(50, 2)), (50, prose(50, 3)), (10, prose(50, 1)), (20, prose(50, 2)),
            (30, prose(50, 3)), (60, prose(50, 4))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [
        (10, 10), (20, 10), (30, 10), (50, 10), (50, 10), (50, 10), (60, 60)]


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    found = graph.components(spark.createDataFrame(links, "u long, v long"), Workspace(spark, "test")).collect()
    want = brute.least_reachable({n for a, b in links for n in (a, b)}, links)
    assert {r.node: r.component for r in found} == {n: c for n, c in want.items() if any(n in x and x[0] != x[1] for x in links)}
    assert graph.components(spark.createDataFrame([], "u long, v long"), Workspace(spark, "test")).count() == 0


def test_contamination(spark, odd, none):
    items = {1: BASE[:0] + " ".join(BASE.split()[10:40]), 2: "Two", 3: "", 4: None, 5: "one two three four",
             6: " ".join(LONG.split()[500:520]), 10: "te xt"}
    bench = spark.createDataFrame([(k, v, 1) for k, v in items.items()] + [(None, "b", 1), (1, items[1], 1)],
                                  "item_id long, text string, place int")
    got = winnow.contamination(odd, bench).collect()
    listed = items | {None: "b"}
    want = {i: brute.contamination(t, listed) for i, t in ODD}
    assert len(got) == len(ODD)
    for row in got:
        n, hit, ids = want[row.doc_id]
        ids = [i for i in ids if i != "None"]
        assert (row.n_words, row.n_hit, row.n_items) == (n, hit, len(ids)), row
        assert row.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert row.contaminated == (hit > 0 and 20 * hit >= n)
    assert winnow.contamination(none, bench).count() == 0
    assert not [r for r in winnow.contamination(odd, bench.limit(0)).collect() if r.n_hit or r.contaminated]
    clean = winnow.clean(odd, bench)
    assert clean.columns == odd.columns
    bad = {i for i, (n, hit, _) in want.items() if hit and 20 * hit >= n}
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(i or 0 for i, _ in ODD if i not in bad)


def test_every_shared_window_is_found(spark):
    """Random overlaps of every length around thirteen, of words that repeat a lot."""
    draw = random.Random(9)
    items = {k: " ".join(draw.choice("abc") for _ in range(draw.randrange(1, 40))) for k in range(30)}
    docs = [(i, " ".join(draw.choice("abc") for _ in range(draw.randrange(0, 120)))) for i in range(60)]
    got = winnow.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    want = {i: brute.contamination(t, items) for i, t in docs}
    assert all((r.n_words, r.n_hit, r.n_items) == (*want[r.doc_id][:2], len(want[r.doc_id][2])) for r in got)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model(odd, none, order):
    rows = backoff.scored(odd, order=order).collect()
    held = [brute.fold(i, 7) == 2 for i, _ in ODD]
    want = brute.language_model([t for _, t in ODD], held, order, backoff.MU)
    key = lambda r: tuple("" if x is None else str(x) if not isinstance(x, float) else f"{x:.6f}" for x in r)
    assert sorted(key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score)) for r in rows) == sorted(
        key((i, h, *w)) for (i, _), h, w in zip(ODD, held, want))
    assert backoff.scored(none, order=order).count() == 0


def test_byte_planes(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    planes.write(odd, public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/store")
    got = sorted(planes.read(spark, f"{tmp_path}/store").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([i for i, _ in ODD], key=lambda i: i or 0)
    texts, start = {i: t for i, t in ODD}, 0
    for row in got:
        want = model.encode(texts[row.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (row.start, row.n_tokens, row.ids) == (start, len(want), want)
        start += row.n_tokens
    assert planes.checked(spark, f"{tmp_path}/store").count() == len(ODD)
    planes.write(none, public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/none")
    assert planes.checked(spark, f"{tmp_path}/none").count() == 0
    ids = np.array([0, 1, 2**32 - 1, 65536] * 5, "<u4")
    index, payload = planes.pack(ids)
    assert (planes.unpack(index, payload, 20) == ids).all()
    with pytest.raises(ValueError):
        planes.unpack(index, payload[:-1] + b"\x00", 20)


def test_byte_plane_ids_of_any_order_of_blanks():
    from tokenizers import Tokenizer
    path, draw = public_tokenizers.path("byte_bpe_50k.json"), random.Random(8)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    parts = ["a", "Bc", " ", " ", "\n", "!", "é", "ÿǅ", "日", "'s", "1", "<|endoftext|>", "\u180e", "\u0085", "Ġ", "x" * 60]
    texts = ["", " ", "\n", "a ", "a\n", " \n", "\na b"] + [
        "".join(draw.choice(parts) for _ in range(draw.randrange(40))) for _ in range(2000)]
    flat, sizes = planes.Coder(text).ids(texts)
    want = [e.ids for e in Tokenizer.from_str(text).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want]
    assert flat.tolist() == [i for x in want for i in x]
    for texts in ([""], ["a"], ["  "]):
        flat, sizes = planes.Coder(text).ids(texts)
        assert flat.tolist() == Tokenizer.from_str(text).encode(texts[0], add_special_tokens=False).ids
    with pytest.raises(ValueError):
        planes.Coder(text.replace('"add_prefix_space":false', '"add_prefix_space":true')
                     .replace('"add_prefix_space": false', '"add_prefix_space": true'))


def test_edits_against_whole_encoding(coder):
    draw = random.Random(4)
    bits = ["", " ", "  ", "\n", "'s", "abc", " word", "123", "!?", "\t x", "é", "\x1c", "日本"]
    for case in range(60):
        text = "".join(draw.choice(bits) for _ in range(draw.randrange(0, 900)))
        tree = edits.Tree(coder, text)
        for _ in range(6):
            place, n = draw.randrange(-3, len(text) + 5), draw.choice([0, 1, 3, 700])
            new = "".join(draw.choice(bits) for _ in range(draw.choice([0, 1, 4, 3000])))
            tree = edits.Tree.restored(coder, tree.text, tree.chars, tree.tokens)
            tree.edit(place, n, new)
            at = min(max(place, 0), len(text))
            text = text[:at] + new + text[at + n:]
            assert tree.text == text
            assert tree.n_tokens == len(coder.encode_ordinary(text))


def test_edit_tables(spark, odd, none, coder):
    state = edits.trees(odd, RANKS, PATTERN)
    plan = spark.createDataFrame([(1, 2, 0, 3, "Now "), (1, 1, 5, None, "new "), (8, 1, None, 0, None), (99, 1, 0, 0, "x"),
                                  (11, 1, 10**9, 5, " end"), (None, 1, 0, 0, "y")],
                                 "doc_id long, seq int, place long, n_deleted long, inserted string")
    got = {r.doc_id: r for r in edits.edited(edits.with_edits(state, plan), RANKS, PATTERN).collect()}
    want = {i: t or "" for i, t in ODD}
    want[1] = "Now " + (BASE[:5] + "new " + BASE[5:])[3:]
    want[11] = LONG + " end"
    for i, text in want.items():
        assert (got[i].text, got[i].n_tokens) == (text, len(coder.encode_ordinary(text)))
    assert got[11].n_encoded < 3000 and got[2].n_encoded == 0
    assert edits.edited(edits.with_edits(edits.trees(none, RANKS, PATTERN), plan), RANKS, PATTERN).count() == 0


def test_language_cases(spark, odd, none):
    english = [(i, prose(30, i) + " the house with the words", "en") for i in range(40)]
    german = [(100 + i, " ".join(w[::-1] for w in prose(30, i).split()) + " über das schöne Haus", "de") for i in range(40)]
    docs = spark.createDataFrame(english + german + [(500, None, "en"), (501, "12 3", None), (None, "über das Haus", "de"),
                                                     (503, "the house", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identified(docs).collect()}
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[500].score == 0
    assert got[503].lang_pred == "en" and got[None].lang_pred == "de" and not got[None].held_out
    assert all(got[i].lang_pred == lang for i, _, lang in english + german)
    assert langid.identified(none).count() == 0
    assert {r.lang_pred for r in langid.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.accepted(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, t in ODD if t and any(c.isalpha() for c in t))


def test_rejected_languages(spark):
    rows = [(i, f"the house of the cat {prose(20, i)}", "en") for i in range(60)]
    rows += [(100 + i, f"über das schöne haus und die straße größe {i} öäü", "de") for i in range(60)]
    rows += [(300, "über das schöne haus und die straße größe öäü", "en"), (301, "the house of the cat alpha beta", None),
             (302, "the house of the cat alpha gamma", "xx"), (303, "12", "en"), (304, None, "en"), (None, "the house alpha", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.accepted(docs, least=0.8).collect()}
    assert {r[0] for r in rows} - kept == {300, 303, 304}
    assert {r.doc_id for r in langid.accepted(docs, wanted=["de"], least=0.8).collect()} == {r[0] for r in rows if r[2] == "de"}
    assert langid.accepted(docs.limit(0)).count() == 0


def test_every_label_is_learned(spark):
    names = [f"l{i:02}" for i in range(45)]
    draw = random.Random(6)
    own = {n: ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for n in names}
    rows = [(i * 45 + j, " ".join(draw.choice(own[n]) for _ in range(25)), n) for i in range(12) for j, n in enumerate(names)]
    got = langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    said = {i: n for i, _, n in rows}
    assert {r.lang_pred for r in got} == set(names)
    assert np.mean([r.lang_pred == said[r.doc_id] for r in got]) > 0.97


def test_margins_equal_plain_kernel_ridge(spark):
    """With every sampled text a landmark the map is exact, and the fit is kernel ridge regression."""
    texts = [(f"the house of {prose(6, i)}", "en") for i in range(9)] + [(f"über das haus {prose(6, 50 + i)}", "de") for i in range(7)]
    model = langid.fit(spark.createDataFrame(texts, "text string, lang string"), landmarks=20)

    def places(text):
        data, out = text.lower().encode(), set()
        for n in range(1, langid.MAX_N + 1):
            for i in range(len(data) - n + 1):
                code = 0
                for b in data[i:i + n]:
                    code = (code * 257 + b + 1) % 2**32
                out.add(((code + n) * 2654435761 % 2**32) >> (32 - langid.BITS))
        return out

    sets = [places(t) for t, _ in texts]
    alike = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    kernel = np.array([[alike(a, b) for b in sets] for a in sets])
    weight = np.array([1 / sum(y == lang for _, y in texts) for _, lang in texts])
    target = np.array([[1.0 if lang == name else -1.0 for name in model.languages] for _, lang in texts])
    ridge = langid.RIDGE / len(texts)
    dual = np.linalg.solve(kernel + ridge * np.diag(1 / weight), target)
    asked = ["the cat of the house", "über straße", "alpha beta 1"]
    want = np.array([[alike(places(t), s) for s in sets] for t in asked]) @ dual
    bits = np.stack([langid.presence(np.frombuffer(t.lower().encode(), np.uint8)) for t in asked])
    assert np.allclose(model.margins(bits), want, atol=1e-3)


def test_languages_of_copies(spark):
    one = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("the house of the cat").alias("text"), F.lit("en").alias("lang"))
    assert {r.lang_pred for r in langid.identified(one).collect()} == {"en"}
    # 3,000 different texts beside 300,000 copies of another
    words = [f"{w}{x}" for w in ("über", "das", "haus", "straße", "größe") for x in ("", "n", "es")]
    draw = random.Random(4)
    german = spark.createDataFrame([(" ".join(draw.choice(words) for _ in range(12)),) for _ in range(3000)], "text string")
    copies = spark.range(300_000).select(F.lit("das haus über der straße").alias("text"))
    english = spark.createDataFrame([("the cat of the house and " + prose(6, i),) for i in range(400)], "text string")
    rows = german.unionByName(copies).withColumn("lang", F.lit("de")).unionByName(english.withColumn("lang", F.lit("en")))
    seen = []
    kernel, langid._kernel = langid._kernel, lambda bits, marks: seen.append(len(bits)) or kernel(bits, marks)
    try:
        model = langid.fit(rows)
    finally:
        langid._kernel = kernel
    assert model.languages == ["de", "en"] and sum(seen) == 2 * langid.PER_LANGUAGE
    got = langid.predicted(rows.limit(50), model).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_encoding_cases(odd, none):
    coder = bpe.encoding(bpe.read_ranks(RANKS), PATTERN)
    got = bpe.encoded(odd, RANKS, PATTERN).collect()
    assert sorted((r.doc_id or 0, tuple(r.ids), bytes(r.decoded)) for r in got) == sorted(
        (i or 0, tuple(coder.encode_ordinary(t or "")), (t or "").encode()) for i, t in ODD)
    assert bpe.encoded(none, RANKS, PATTERN).count() == bpe.digests(none, RANKS, PATTERN).count() == 0
    for text in (LONG, "ab1" * 3000, "x  \n y" * 500, "it's " * 400 + "\x1c! \x85" * 100):
        parts = list(bpe.pieces(text, 7))
        assert "".join(parts) == text
        assert [i for p in parts for i in coder.encode_ordinary(p)] == coder.encode_ordinary(text)


def test_very_long_runs_of_blanks(spark, coder):
    for blank in (" ", "\n", "\t \u2003"):
        for n in (bpe.LONG_RUN // len(blank) + 7, 300_000 // len(blank)):
            run = blank * n
            for text in (run + "a", "a" + run, "a" + run + "'s b", run, "x y " + run + "\x1c!" + run + "z", "\x1c" + run + "1"):
                assert bpe.encode_piece(coder, text) == coder.encode_ordinary(text)
    million = [(1, " " * 2_000_000 + "end"), (2, "start" + "\n" * 2_000_000), (3, "a b" + " \n" * 1_000_000 + "c d")]
    docs = spark.createDataFrame(million, "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digests(docs, RANKS, PATTERN).collect()}
    for i, text in million:
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    state = {r.doc_id: r.n_tokens for r in edits.trees(docs, RANKS, PATTERN).selectExpr("doc_id", "tokens[1] AS n_tokens").collect()}
    assert state == {i: got[i].n_tokens for i in got}


def test_vectors_in_double_precision(spark):
    """A pair on the border that single precision would put on its other side."""
    a = [1.0, 0.0]
    b = [0.93, (1 - 0.93 ** 2) ** 0.5 + 1e-9]
    assert np.dot(a, b) / np.linalg.norm(b) < 0.93
    got = flatgraph.near_duplicates(spark.createDataFrame([(1, a, 0), (2, b, 0)], "vec_id long, embedding array<double>, label int"))
    assert {r.n_links for r in got.collect()} == {0}


def test_vectors(spark):
    draw = np.random.default_rng(1)
    centre = draw.normal(size=(3, 16))
    rows = [(i, [float(x) for x in np.float32(centre[i % 3] + draw.normal(size=16) * (0.1 if i % 2 else 0.5))], i % 2)
            for i in range(300)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, rows[4][1], None),
             (304, rows[6][1], 0), (304, rows[6][1], 0), (305, [1.0, 2.0], 0), (306, [], 0), (None, rows[6][1], 0),
             (307, [None] + rows[6][1][1:], 0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, size int")
    got = flatgraph.near_duplicates(df).collect()
    usable = [(i, np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and lab is not None
              and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for x, a in enumerate(usable) for y, b in enumerate(usable)
             if x != y and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.93]
    least = brute.least_reachable([r[0] for r in rows if r[0] is not None], [(a[0], b[0]) for a, b in links])
    degree = {id(a): 0 for a in usable}
    for a, _ in links:
        degree[id(a)] += 1
    want = sorted([(a[0], degree[id(a)], least[a[0]]) for a in usable] +
                  [(i, 0, i) for i in (300, 301, 302, 303, 306, 307)])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == want
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert flatgraph.near_duplicates(df.limit(0)).count() == 0


def test_links_missed_by_the_graph_are_found(spark, monkeypatch):
    draw, large = np.random.default_rng(2), 2000
    pairs = np.repeat(draw.normal(size=(150, 16)), 2, axis=0)
    vectors = np.float32(np.concatenate([np.ones((large, 16)), pairs]) + draw.normal(size=(large + 300, 16)) * 0.02)
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(vectors)],
                               "vec_id long, embedding array<float>, label string")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    alike = unit @ unit.T >= flatgraph.MIN_COSINE
    np.fill_diagonal(alike, False)
    links_of, shares, audit = flatgraph.links_of, [], flatgraph.audit

    def losing(*args):
        """Every link of the large group and none of the others."""
        counts, edges = links_of(*args)
        return (counts.withColumn("n_links", F.when(F.col("id") < large, F.col("n_links")).otherwise(0)),
                edges.filter((F.col("u") < large) & (F.col("v") < large)))

    monkeypatch.setattr(flatgraph, "links_of", losing)
    monkeypatch.setattr(flatgraph, "audit", lambda *args: shares.append(audit(*args)) or shares[-1])
    got = {r.vec_id: (r.n_links, r.component_id) for r in flatgraph.near_duplicates(df).collect()}
    least = brute.least_reachable(range(len(vectors)), [(int(a), int(b)) for a, b in zip(*np.nonzero(alike))])
    assert got == {i: (int(alike[i].sum()), least[i]) for i in range(len(vectors))}
    assert len(shares) == flatgraph.ATTEMPTS and max(shares) < flatgraph.MIN_RECALL


def copies(large, far, seed):
    """Near copies of one vector, as many shards hold, among unlike ones: vectors and which are linked."""
    draw = np.random.default_rng(seed)
    vectors = np.float32(np.concatenate([np.ones((large, 16)) + draw.normal(size=(large, 16)) * 0.1, draw.normal(size=(far, 16))]))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    alike = unit @ unit.T >= flatgraph.MIN_COSINE
    np.fill_diagonal(alike, False)
    return vectors, alike


def test_links_of_a_large_group_are_counted_and_not_listed(spark, monkeypatch):
    vectors, alike = copies(1500, 500, 3)
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(vectors)],
                               "vec_id long, embedding array<float>, label string")
    kept, keep = {}, Workspace.keep

    def counted(self, table, name):
        out = keep(self, table, name)
        kept[name] = max(kept.get(name, 0), out.count())
        return out

    monkeypatch.setattr(flatgraph, "SHARD_ROWS", 250)
    monkeypatch.setattr(Workspace, "keep", counted)
    got = {r.vec_id: (r.n_links, r.component_id) for r in flatgraph.near_duplicates(df).collect()}
    least = brute.least_reachable(range(len(vectors)), [(int(a), int(b)) for a, b in zip(*np.nonzero(alike))])
    assert got == {i: (int(alike[i].sum()), least[i]) for i in range(len(vectors))}
    assert alike.sum() > 2_000_000 and max(kept.values()) < 50_000, kept


def test_a_task_holds_no_more_of_a_large_group_than_its_blocks():
    vectors, _ = copies(6000, 1, 4)
    at = np.arange(6001) // 500
    lists = [np.unique((i + np.arange(1, 30) ** 2) % 6000) for i in range(6001)]
    table = pa.table({"id": np.arange(6001), "at": at, "shard": np.zeros(6001, np.int64), "home": at == 0, "weight": np.ones(6001, np.int64),
                      "medoid": np.arange(6001) == 0, "neighbours": pa.array(lists, pa.list_(pa.int64())),
                      "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})
    tracemalloc.start()
    out = flatgraph._searched(flatgraph.MIN_COSINE)(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 90e6 and out.num_rows < 20_000, (most, out.num_rows)


def test_links_that_only_one_side_found_are_counted_for_both(spark, monkeypatch):
    """Shards that say nothing of a third of what was found there by nodes at home elsewhere."""
    vectors, alike = copies(600, 100, 5)
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(vectors)],
                               "vec_id long, embedding array<float>, label string")
    searched, again, recounted = flatgraph._searched, [], flatgraph._recounted

    def silent(min_cosine):
        run = searched(min_cosine)

        def less(table):
            out = run(table)
            lost = [o is not None and (i + 2 * o) % 3 == 0 for i, o in zip(out["id"].to_pylist(), out["out"].to_pylist())]
            return out.filter(pa.array([not x for x in lost]))

        return less

    monkeypatch.setattr(flatgraph, "SHARD_ROWS", 100)
    monkeypatch.setattr(flatgraph, "_searched", silent)
    monkeypatch.setattr(flatgraph, "_recounted", lambda x: again.append(x) or recounted(x))
    got = {r.vec_id: (r.n_links, r.component_id) for r in flatgraph.near_duplicates(df).collect()}
    least = brute.least_reachable(range(len(vectors)), [(int(a), int(b)) for a, b in zip(*np.nonzero(alike))])
    assert again and got == {i: (int(alike[i].sum()), least[i]) for i in range(len(vectors))}


def test_a_link_found_from_one_end_inside_a_shard_is_counted_for_both(monkeypatch):
    vectors, alike = copies(40, 10, 6)
    search = flatgraph._search
    monkeypatch.setattr(flatgraph, "_search", lambda v, first, flat, queries, *more: (
        search(v, first, flat, queries, *more) & (queries[:, None] < np.arange(len(v)))))
    n = len(vectors)
    table = pa.table({"id": np.arange(n), "at": np.zeros(n, np.int64), "shard": np.zeros(n, np.int64), "weight": np.arange(n) % 3 + 1,
                      "medoid": np.arange(n) == 0, "neighbours": pa.array([np.arange(n)] * n, pa.list_(pa.int64())),
                      "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})
    out = flatgraph._searched(flatgraph.MIN_COSINE)(table)
    assert dict(zip(out["id"].to_pylist(), out["found"].to_pylist())) == dict(enumerate((alike @ (np.arange(n) % 3 + 1)).tolist()))
    tied = brute.least_reachable(range(n), [(i, j) for i, j in zip(out["id"].to_pylist(), out["tied"].to_pylist())])
    assert tied == brute.least_reachable(range(n), [(int(a), int(b)) for a, b in zip(*np.nonzero(alike))])


def test_vectors_in_small_blocks(spark, monkeypatch):
    """Every loop over blocks takes many, and the comparison of all nodes gives the same."""
    vectors, alike = copies(300, 200, 7)
    monkeypatch.setattr(flatgraph, "CELLS", 700)
    ids, weight = np.arange(len(vectors)), np.ones(len(vectors), np.int64)
    table = pa.table({"id": ids, "weight": weight, "block": ids % 2, "lo": np.zeros(len(ids), np.int64), "hi": np.ones(len(ids), np.int64),
                      "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})
    out = flatgraph._compared(flatgraph.MIN_COSINE)(table)
    assert out["found"].to_pylist() == (alike & ((ids % 2)[:, None] != ids % 2)).sum(axis=1).tolist()
    near, rows = np.argsort(-(vectors @ vectors.T), axis=1)[:, 1:9], len(vectors)
    table = pa.table({"id": ids, "at": ids // 100, "shard": np.ones(rows, np.int64), "weight": weight, "medoid": ids == 0,
                      "neighbours": pa.array(list(near), pa.list_(pa.int64())), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})
    small = flatgraph._searched(flatgraph.MIN_COSINE)(table)
    monkeypatch.setattr(flatgraph, "CELLS", 1 << 20)
    large = flatgraph._searched(flatgraph.MIN_COSINE)(table)
    key = lambda t: sorted(map(str, zip(*(t[c].to_pylist() for c in ("id", "place", "found", "digest", "out")))))
    assert key(small) == key(large)


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        ("a", 1, 1, "search", '{"query": "x", "limit": 3}', []), ("b", 1, 3, "search", '{"limit": 2.5}', ["a"]),
        ("c", 1, 5, "fetch", "[1]", ["b", "a", "zz"]), ("d", 1, 7, None, None, ["e"]), ("e", 1, 9, "search", '{"query": null}', ["d"]),
        ("f", 2, 1, "search", '{"z": 1, "query": "q\\"", "a": {"y": 1, "b": [1, 2]}}', ["a"]), ("a", 1, 4, "fetch", "{}", []),
        (None, 3, 1, "search", '{"query": "n"}', []), ("g", 2, 3, "search", '{"query": 5}', ["d", "g"]), ("h", 2, 5, "search", "{", None),
    ], "call_id string, conv_id long, turn long, name string, arguments string, depends array<string>")
    results = spark.createDataFrame([("a", 2, "ok"), ("a", 3, "late"), ("q", 2, None), (None, 4, "lost"), ("f", 2, 'say "é"\n')],
                                    "call_id string, turn long, content string")
    tools = {"search": {"query": ("string", True), "limit": ("integer", False)}, "fetch": {"url": ("string", True)}}
    got = {r.call_id: r for r in toolcalls.formatted(calls, results, tools).collect() if r.call_id}
    assert {k: (r.level, r.status, r.problems) for k, r in got.items()} == {
        "a": (0, "linked", ""), "b": (1, "pending", "missing:query,type:limit"), "c": (2, "pending", "json"),
        "d": (None, "cyclic", "json,tool"), "e": (None, "cyclic", "missing:query"), "f": (0, "linked", "unknown:a,unknown:z"),
        "g": (None, "cyclic", "type:query"), "h": (0, "pending", "json"), "q": (None, "orphan", None)}
    assert got["f"].message == ('{"arguments":{"a":{"b":[1,2],"y":1},"query":"q\\"","z":1},"call_id":"f","name":"search",'
                                '"result":"say \\"é\\"\\n"}')
    assert got["d"].message == '{"arguments":null,"call_id":"d","name":null,"result":null}'
    unnamed = [r.status for r in toolcalls.formatted(calls, results, tools).collect() if r.call_id is None]
    assert unnamed == ["unnamed", "unnamed"]
    assert toolcalls.formatted(calls.limit(0), results.limit(0), tools).count() == 0


def test_url_lists(spark):
    events = spark.createDataFrame([
        ("block", "Bad.example.org", "add", "2024-01-10"), ("block", "bad.example.org", "add", "2024-01-12"),
        ("block", "bad.example.org", "remove", "2024-02-01"), ("block", "bad.example.org", "add", "2024-03-01"),
        ("block", "example.org", "add", "2024-02-15"), ("allow", "good.example.org", "add", "2024-01-01"),
        ("block", "good.example.org", "add", "2024-01-01"), ("block", "x.org", "remove", "2024-01-01"),
        ("other", "x.org", "add", "2024-01-01"), ("block", None, "add", "2024-01-01"), ("block", "10.0.0.1", "add", "2024-01-01"),
    ], "list string, domain string, action string, day string").withColumn("day", F.col("day").cast("date"))
    cases = [("http://bad.example.org/a", "2024-01-09", "none"), ("https://u:p@BAD.example.org:80/", "2024-01-10", "block"),
             ("http://www.bad.example.org?q", "2024-01-31", "block"), ("http://bad.example.org", "2024-02-01", "none"),
             ("http://bad.example.org", "2024-02-20", "block"), ("http://bad.example.org.", "2024-03-05", "block"),
             ("http://good.example.org/", "2024-03-05", "allow"), ("http://x.org/", "2024-03-05", "none"),
             (None, "2024-03-05", "none"), ("no url", "2024-03-05", "none"), ("http://bad.example.org", None, "none"),
             ("http://10.0.0.1/", "2024-03-05", "block"), ("http://notexample.org/", "2024-03-05", "none"),
             ("http://good.example.org/", "2024-03-05", "allow")]
    pages = spark.createDataFrame([(i, u, d, "x") for i, (u, d, _) in enumerate(cases)],
                                  "page_id long, url string, fetched string, host string")
    got = {r.page_id: r for r in urlfilter.judged(pages, urlfilter.intervals(events)).collect()}
    assert [got[i].verdict for i in range(len(cases))] == [v for _, _, v in cases]
    assert (got[4].matched, str(got[4].since)) == ("example.org", "2024-02-15")
    assert (got[5].matched, str(got[5].since)) == ("bad.example.org", "2024-03-01")
    assert urlfilter.judged(pages.limit(0), urlfilter.intervals(events)).count() == 0
    assert {r.verdict for r in urlfilter.judged(pages, urlfilter.intervals(events.limit(0))).collect()} == {"none"}
