"""The operators' queries on the small tables: against their SQL, or against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from larder.llm import backoff, bpe, edits, queries
from tests.llm import brute
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark.read.parquet(f"{FOLDER}/documents.parquet"))


@pytest.fixture(scope="module")
def coder():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encoding(ranks, public_tokenizers.PATTERN)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, name):
    assert compare(spark, duck(FOLDER), queries.QUERIES[name], queries.SQL[name], FOLDER) is None


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_backoff_scores(spark, docs):
    got = brute.frame(queries.op2_backoff_automaton(spark, FOLDER))
    held = [brute.fold(i, 7) == 2 for i in docs.doc_id]
    want = brute.language_model(list(docs.text), held, backoff.ORDER, backoff.MU)
    assert list(got.held_out) == held
    assert list(zip(got.n_tokens, got.n_known)) == [w[:2] for w in want]
    assert np.allclose(got.base_score, [w[2] for w in want], rtol=1e-9)
    assert np.allclose(got.score, [w[3] for w in want], rtol=1e-9)
    assert (got.score[got.held_out].sum() > got.base_score[got.held_out].sum())


def test_byte_planes_hold_the_ids(spark, docs):
    got = brute.frame(queries.op3_byte_planes(spark, FOLDER))
    model, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for row, text in zip(got.itertuples(), docs.text):
        ids = model.encode(text, add_special_tokens=False).ids + [2]
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_counts_after_edits(spark, docs):
    got = brute.frame(queries.op4_edited_token_counts(spark, FOLDER))
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = bpe.encoding(ranks, public_tokenizers.PATTERN)
    for row, text in zip(got.itertuples(), docs.text):
        n = len(text)
        cut = text[:n // 3] + text[n // 3 + 5:]
        at = min(2 * n // 3, len(cut))
        after = f"[{n}] " + cut[:at] + " (revised) 2024" + cut[at:]
        assert row.text_sha256 == hashlib.sha256(after.encode()).hexdigest()
        assert (row.n_tokens, row.n_tokens_edited) == (len(own.encode_ordinary(text)), len(own.encode_ordinary(after)))
        assert row.n_encoded <= 3 * 8 * edits.SEGMENT


def test_languages_are_found(spark, docs):
    got = brute.frame(queries.op5_string_kernel_language(spark, FOLDER))
    assert list(got.held_out) == [brute.fold(i, 5) == 0 for i in docs.doc_id]
    assert (got.lang_pred == docs.lang)[got.held_out].mean() >= 0.95
    assert got.score.between(0, 1).all()


def test_byte_bpe(spark, docs, coder):
    got = brute.frame(queries.op6_byte_bpe(spark, FOLDER))
    for row, text in zip(got.itertuples(), docs.text):
        ids = coder.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_against_brute_force(spark, docs, coder):
    got = brute.frame(corpus_pipeline.run(spark, FOLDER))
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").toPandas()
    items = dict(zip(items.item_id, items.text))
    texts = {i: t for i, t in zip(docs.doc_id, docs.text) if any(c.isalpha() for c in t)}
    found = brute.near_duplicates(texts)
    kept = {i for i in texts if found[i][1] == i}
    clean = {}
    for i in kept:
        n, hit, _ = brute.contamination(texts[i], items)
        if not (hit and 20 * hit >= n):
            clean[i] = texts[i]
    assert len(clean) < len(kept) < len(texts)
    assert list(got.doc_id) == sorted(clean)
    assert got.lossless.all()
    assert all(list(ids) == coder.encode_ordinary(clean[i]) for i, ids in zip(got.doc_id, got.ids))


def test_pipeline_of_odd_rows(spark, tmp_path):
    text = " ".join(f"word{i} the" for i in range(40))
    rows = [(1, text, "en"), (1, text, "en"), (2, text, None), (3, None, "en"), (4, "", "en"), (5, "12 34", "en"),
            (None, "the other text of no number", "en"), (6, "benchmark " + " ".join(f"b{i}" for i in range(20)), "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 7, "x") for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, row long, _keep string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20)))], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "lossless"]
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1]
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
