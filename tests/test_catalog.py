"""The eight-food fixture, from stored tables to the published catalogue and its search."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from larder import schemas
from larder.operators import catalog, changes, cluster, pivot, search
from larder.session import materialise


def frame(spark, schema, rows):
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.fixture(scope="module")
def tables(spark):
    foods = [
        (1, "sr_legacy_food", "Dairy", "Yogurt, plain", None, "yogurt", "ingredient", None),
        (2, "foundation_food", "Fruits", "Strawberries, raw", None, "strawberry", "ingredient", "raw"),
        (3, "survey_fndds_food", "Beverages", "Water, tap", None, "tap water", "ingredient", None),
        (4, "sr_legacy_food", "Sauces", "Ranch dip", None, "ranch dip", "dish", None),
        (10, "sr_legacy_food", "Dairy", "Milk, whole", "1077", "whole milk", "ingredient", None),
        (11, "sr_legacy_food", "Cereals", "Oats, rolled", "8120", "rolled oats", "ingredient", None),
        (12, "sr_legacy_food", "Dairy and Egg Products", "Egg, whole, raw, fresh", None, "egg", "ingredient", "raw"),
        (13, "sr_legacy_food", "Dairy and Egg Products", "Egg, whole, cooked, hard-boiled", None, "egg", "ingredient", "boiled"),
    ]
    foods = frame(spark, schemas.FOODS, [dict(zip(("fdc_id", "data_type", "food_category", "description", "ndb_number",
                                                   "base_name", "food_kind", "prep_label"), f)) for f in foods])
    nutrients = [(1, 1008, "Energy", 61.0), (1, 1003, "Protein", 3.5), (1, 2000, "Total Sugars", 4.7), (1, 1265, "SFA 16:0", .8),
                 (2, 2047, "Energy (Atwater General)", 32.0), (2, 1063, "Sugars, Total", 4.9), (2, 1265, "SFA 16:0", .01),
                 (12, 1003, "Protein", 12.6), (12, 1004, "Fat", 9.5), (12, 1005, "Carbohydrate", .7),
                 (13, 1003, "Protein", 10.0), (13, 1004, "Fat", 7.0), (13, 1005, "Carbohydrate", .6)]
    nutrients = frame(spark, schemas.NUTRIENTS, [dict(fdc_id=a, nutrient_id=b, nutrient_name=c, unit_name="G", nutrient_rank=1.0, amount=d) for a, b, c, d in nutrients])
    portions = frame(spark, schemas.PORTIONS, [dict(fdc_id=1, seq_num=2, modifier="container (6 oz)", gram_weight=170.0),
                                               dict(fdc_id=1, seq_num=1, measure_unit="cup", gram_weight=245.0),
                                               dict(fdc_id=2, seq_num=1, portion_description="1 cup, halves", gram_weight=152.0)])
    attributes = frame(spark, schemas.ATTRIBUTES, [dict(fdc_id=1, seq_num=1, attribute_type="Common Name", value="curd"),
                                                   dict(fdc_id=1, seq_num=2, attribute_type="Additional Description", value="yoghurt"),
                                                   dict(fdc_id=4, seq_num=1, attribute_type="Additional Description", value="yogurt based")])
    inputs = frame(spark, schemas.INPUT_FOODS, [dict(fdc_id=3, seq_num=1, ingredient_code="1077"), dict(fdc_id=3, seq_num=2, ingredient_code="8120")])
    got = cluster.cluster(pivot.macro_input(foods, nutrients))
    items = changes.merge_clusters(spark.createDataFrame([], schemas.ITEMS), got.items).snapshot
    items = items.withColumn("display_name", F.when(F.col("n_foods") > 1, F.lit("Egg")))
    linked, counts = changes.relink(foods, got.links)
    assert tuple(counts.first()) == (8, 8)
    return {"foods": materialise(linked, "foods"), "items": materialise(items, "items"), "preps": materialise(got.preps, "preps"),
            "nutrients": nutrients, "portions": portions, "attributes": attributes, "input_foods": inputs}


@pytest.fixture(scope="module")
def built(tables):
    return {k: materialise(v, k) for k, v in catalog.build_catalog(tables, hold=materialise).items()}


def test_pivot_takes_the_first_id_with_a_value(built):
    got = {r.food_id: (r.energy_kcal, r.sugar_g) for r in built["food_nutrition"].collect()}
    assert got[1] == (61.0, 4.7) and got[2] == (32.0, 4.9)


def test_wide_and_long_share_nothing(built):
    assert {r.nutrient_id for r in built["food_nutrients"].collect()} == {1265}
    assert [r.nutrient_id for r in built["nutrients"].collect()] == [1265]


def test_food_without_anything_survives(built):
    row = built["foods"].filter("food_id = 3").first()
    assert (row.kcal_100g, row.serving_g, row.serving_label) == (None, None, None)


def test_portions_are_numbered_and_labelled(built):
    got = sorted((r.food_id, r.seq, r.label, r.gram_weight) for r in built["food_portions"].collect())
    assert got == [(1, 1, "cup", 245.0), (1, 2, "container (6 oz)", 170.0), (2, 1, "cup, halves", 152.0)]


def test_pairs_go_both_ways(built):
    assert {(r.food_id, r.pair_food_id, r.score) for r in built["food_pairs"].collect()} == {(10, 11, 0.0), (11, 10, 0.0)}


def test_items_are_total(built):
    assert built["merged_foods"].count() == 7
    egg = built["merged_foods"].filter("n_foods > 1").first()
    assert (egg.merged_food_id, egg.display_name, egg.n_foods, egg.n_preps) == (12, "Egg", 2, 2)
    assert built["foods"].join(built["merged_foods"], "merged_food_id", "left_anti").count() == 0
    assert catalog.representative_rows(built["foods"]).count() == built["merged_foods"].agg(F.sum("n_preps")).first()[0]


def test_catalogue_without_any_grouping(spark, tables):
    bare = dict(tables, items=tables["items"].limit(0), preps=tables["preps"].limit(0),
                foods=tables["foods"].withColumns({c: F.lit(None).cast("bigint") for c in ("merged_food_id", "prep_id")}))
    got = catalog.build_catalog(bare)
    assert got["merged_foods"].count() == 8
    assert got["index_documents"].filter("name IS NULL").count() == 0


def hits(spark, built, text, fuzzy=False):
    asked = spark.createDataFrame([(1, text)], "query_id long, text string")
    docs = built["index_documents"]
    found = (search.gram_hits(asked, search.build_gram_index(docs, "merged_food_id", "trgm")) if fuzzy else
             search.prefix_hits(asked, search.build_index(docs, "merged_food_id", ("name", "prep", "aka", "members"))))
    return [(r.item_id, r.rank) for r in found.orderBy("rank", "item_id").collect()]


@pytest.mark.parametrize("text, want", [("yogurt", [1, 4]), ("curd", [1]), ("hard", [12])])
def test_search_finds(spark, built, text, want):
    assert [i for i, _ in hits(spark, built, text)] == want


def test_fuzzy_search_recovers_a_typo(spark, built):
    assert hits(spark, built, "stawberry", fuzzy=True)[0][0] == 2


@pytest.mark.parametrize("text, match", [("yogurt", '"yogurt"*'), ("egg ra", '"egg"* "ra"*'), ("o", '"o"*'), ("who mil", '"who"* "mil"*'),
    ("whole-raw egg", '"whole-raw"* "egg"*'), ("hard-boi", '"hard-boi"*'), ("boiled/eg", '"boiled/eg"*'), ("cook-egg-fr who", '"cook-egg-fr"* "who"*'),
    ("cooked,egg,fr", '"cooked,egg,fr"*')])
def test_ranks_equal_an_fts5_index(spark, built, text, match):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(name, prep, aka, members, content='', prefix='2 3', tokenize='unicode61 remove_diacritics 2')")
    rows = built["index_documents"].collect()
    con.executemany("INSERT INTO t(rowid, name, prep, aka, members) VALUES (?,?,?,?,?)", [(r.merged_food_id, r.name, r.prep, r.aka, r.members) for r in rows])
    want = con.execute("SELECT rowid, bm25(t, 10.0, 2.0, 3.0, 1.0) FROM t WHERE t MATCH ?", (match,)).fetchall()
    got = hits(spark, built, text)
    assert {i: round(x, 9) for i, x in got} == {i: round(x, 9) for i, x in want}
    assert got or "-" in text or "/" in text


def word_rows(spark, seed, n):
    draw = random.Random(seed)
    names = ["".join(draw.choice("abcdeinrst") for _ in range(draw.randrange(1, 6))) for _ in range(60)]
    text = lambda size: draw.choice((" ", "-")).join(names[min(int(draw.expovariate(0.08)), 59)] for _ in range(size))
    docs = [(i, text(draw.randrange(1, 12)), text(draw.randrange(0, 30))) for i in range(n)]
    asked = [(i, " ".join(text(draw.randrange(1, 3))[:9] for _ in range(draw.randrange(1, 6)))) for i in range(60)]
    return docs, asked, spark.createDataFrame(docs, "id long, a string, b string"), spark.createDataFrame(asked, "query_id long, text string")


def test_many_queries_equal_an_fts5_index(spark):
    docs, asked, rows, queries = word_rows(spark, 3, 400)
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, tokenize='unicode61')")
    con.executemany("INSERT INTO t(rowid, a, b) VALUES (?,?,?)", docs)
    want = {}
    for q, text in asked:
        match = " ".join(f'"{t}"*' for t in text.split())
        for i, rank in con.execute("SELECT rowid, bm25(t, 3.0, 1.0) FROM t WHERE t MATCH ?", (match,)).fetchall():
            want[q, i] = round(rank, 8)
    index = search.build_index(rows, "id", ("a", "b"))
    got = {(r.query_id, r.item_id): round(r["rank"], 8) for r in search.prefix_hits(queries, index, {"a": 3.0, "b": 1.0}).collect()}
    assert got == want and len({q for q, _ in want}) > 20


def test_the_best_by_grams_without_scoring_the_rest(spark):
    _, _, rows, queries = word_rows(spark, 4, 3000)
    index = search.build_gram_index(rows, "id", "b")
    every = search.gram_hits(queries, index)
    some = materialise(search.fuzzy_hits(queries, index, 5), "some")
    best = lambda hits: {(r.query_id, r.item_id): round(r["rank"], 8) for r in search.top_k(
        hits, ["query_id"], [F.col("rank"), F.col("item_id")], 5).collect()}
    assert best(some) == best(every)
    assert some.count() < every.count()
    wide = search.fuzzy_hits(queries, index, 5, 0.2)
    assert best(wide) == best(every) and some.count() <= wide.count()


def test_long_words_and_missing_terms(spark):
    rows = spark.createDataFrame([(1, "x" * 5000 + " tail"), (2, "x" * 5001), (3, None), (4, "")], "id long, a string")
    asked = spark.createDataFrame([(1, "x" * 5000), (2, "x" * 5001), (3, "x" * 24 + " tail"), (4, "tail none"), (5, " - "), (6, None)],
                                  "query_id long, text string")
    got = search.prefix_hits(asked, search.build_index(rows, "id", ("a",)))
    assert sorted((r.query_id, r.item_id) for r in got.collect()) == [(1, 1), (1, 2), (2, 2), (3, 1)]


def test_gram_ranks_equal_an_fts5_index(spark, built):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(txt, content='', tokenize='trigram')")
    con.executemany("INSERT INTO t(rowid, txt) VALUES (?,?)", [(r.merged_food_id, r.trgm) for r in built["index_documents"].collect()])
    text = "stawberry"
    match = " OR ".join(f'"{text[i:i + 3]}"' for i in range(len(text) - 2))
    want = {i: round(x, 9) for i, x in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall()}
    assert {i: round(x, 9) for i, x in hits(spark, built, text, fuzzy=True)} == want and want


def test_an_index_is_built_in_as_many_tasks_as_its_words_need(spark, monkeypatch):
    docs = spark.range(600).coalesce(1).selectExpr("id", "concat('word', id % 50, ' a', id, ' b', id % 7) AS body")
    asked = spark.createDataFrame([(1, "word3 b"), (2, "a1")], "query_id long, text string")
    whole = search.build_index(docs, "id", ("body",)), search.build_gram_index(docs, "id", "body")
    monkeypatch.setattr(search, "TASK_ROWS", 100)
    cut = search.build_index(docs, "id", ("body",)), search.build_gram_index(docs, "id", "body")
    assert len(cut[0].postings.inputFiles()) > 10 and len(cut[1].postings.inputFiles()) > 20
    for find, a, b in zip((search.prefix_hits, search.gram_hits), whole, cut):
        want, got = ({(r.query_id, r.item_id, round(r.rank, 9)) for r in find(asked, i).collect()} for i in (a, b))
        assert got == want and got
