"""What is read and kept grows with the rows that are asked for."""

import re

from pyspark.sql import functions as F

from larder.operators import pairs, scoring, search
from larder.plans import ingesting, logbook, requests
from larder.session import materialise
from larder.sources.release import ingest
from tests.test_ingest import releases  # noqa: F401


def index_of(spark, n=300):
    docs = spark.range(n).select("id", F.concat(F.lit("name"), F.col("id"), F.lit("x")).alias("name"), F.lit("brand").alias("aka"))
    return search.build_index(docs, "id", ("name", "aka"))


def test_a_common_word_is_read_for_what_a_rare_one_leaves(spark):
    kept = {}

    def hold(df, name):
        kept[name] = materialise(df, name)
        return kept[name]

    asked = spark.range(20).select(F.col("id").alias("query_id"), F.concat(F.lit("name"), F.col("id"), F.lit("x brand")).alias("text"))
    got = search.prefix_hits(asked, index_of(spark), {}, hold=hold)
    assert sorted((r.query_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(20)]
    assert kept["hits"].count() == 20 and kept["hits"].filter("term = 'brand'").isEmpty()


def test_documents_of_few_terms_are_counted_without_the_postings(spark):
    index = index_of(spark)
    terms = spark.createDataFrame([("brand",), ("name1",), ("name12",), ("b",), ("none",)], "term string")
    seen = search._documents(index, materialise(search.prefix_matches(terms, index.vocabulary), "matches"))
    assert not any("postings" in f for f in seen.inputFiles())
    assert {r.term: r.n for r in seen.collect()} == {"brand": 300, "b": 300, "name1": 111, "name12": 11}


def test_child_rows_of_all_releases_meet_the_foods_once(spark, releases):  # noqa: F811
    out = ingest(spark, releases)
    for name in ("portions", "nutrients", "foods"):
        assert out[name]._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1, name


def test_a_release_is_written_in_files_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(ingesting, "FILE_ROWS", 20)
    folder = "/root/testdata/sf0.001"
    release = ingesting._release(spark, folder, "legacy", ingesting._lines(spark, folder))
    files = spark.read.option("header", True).csv(f"{release.folder}/sr_legacy_food.csv").inputFiles()
    assert len(files) > 1


def test_pairs_are_cut_where_they_are_counted(spark, monkeypatch):
    rows = spark.range(600).selectExpr("id % 40 AS recipe_id", "id * 7 % 53 AS food_id")
    whole = pairs.food_pairs(rows)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*n_food", plan)
    monkeypatch.setattr(pairs, "TASK_PAIRS", 64)
    cut = pairs.food_pairs(rows)
    assert {tuple(r) for r in cut.collect()} == {tuple(r) for r in whole.collect()}


def test_items_to_be_named_are_joined_without_broadcasts_and_asked_from_what_is_stored(spark, monkeypatch):
    plans = []

    def hold(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, name)

    for module in (requests, scoring):
        monkeypatch.setattr(module, "materialise", hold, raising=False)
    hold(requests.score_names(spark, "/root/testdata/sf0.001"), "named")
    assert not any("Broadcast" in p for p in plans)
    assert [p.count("lineitem.parquet") > 0 for p in plans] == [True, False, False, False]


def test_answers_meet_the_foods_of_their_batches_without_broadcasts(spark):
    batched = spark.createDataFrame([(0, 0, 7), (0, 1, 8)], "batch bigint, i int, fdc_id bigint")
    foods = spark.createDataFrame([(0, [{"i": "1", "base": "egg", "kind": "dish"}, {"i": "0", "base": "rice", "kind": "dish"}])],
                                  "batch bigint, foods array<map<string,string>>")
    got = scoring.canon_answers(materialise(foods, "foods"), materialise(batched, "batched"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.fdc_id, r.base_name) for r in got.collect()) == [(7, "rice"), (8, "egg")]


def test_entries_of_a_batch_are_counted_per_food_before_they_are_joined(spark):
    plan = logbook.batch_route(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join LeftOuter"):].splitlines()[1]
    assert "Aggregate" in left and "count(1)" in left
