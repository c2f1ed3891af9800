"""The preparation split against a plain re-statement of its rules on small inputs."""

import random

from larder.operators import changes, cluster
from larder.schemas import ITEMS, conform
from larder.session import materialise

COLUMNS = ("fdc_id long, base_name string, food_kind string, prep_label string, protein_g double, carb_g double, "
           "fat_g double, fat_percentage double, description string, food_category string, brand_flagged boolean, n_nutrients long")
COOKED = {"roasted", "baked", "boiled", "fried", "grilled", "stewed", "poached", "broiled"}


def foods(spark, rows):
    full = []
    for r in rows:
        i, base, kind, prep, p, c, f, *rest = r
        fat = rest[0] if rest else None
        n = rest[1] if len(rest) > 1 else 3
        full.append((i, base, kind, prep, float(p), float(c), float(f), fat, f"food {i}", "cat", False, n))
    return spark.createDataFrame(full, COLUMNS)


def preps_of(spark, rows):
    got = cluster.cluster(foods(spark, rows))
    return sorted([tuple(r) for r in got.preps.select("prep_type", "n_foods").collect()], key=repr)


def one(label_rows, base="x"):
    return [(i + 1, base, "ingredient", *r) for i, r in enumerate(label_rows)]


def test_water_splits_preparations(spark):
    assert preps_of(spark, one([("raw", 19.7, 0, 4.1), ("roasted", 24.8, 0, 8.2), ("stewed", 25, 0, 9.8)])) == [("cooked", 2), ("raw", 1)]


def test_vague_cooked_is_absorbed(spark):
    rows = one([("cooked", 2.4, 4.1, .2), ("cooked", 3.0, 4.4, .4), ("boiled", 4.2, 7.0, .5)])
    got = cluster.cluster(foods(spark, rows)).preps.collect()
    assert [(r.prep_type, r.n_foods, round(r.protein_g, 6)) for r in got] == [("boiled", 3, 3.2)]


def test_earned_cooked_is_kept(spark):
    assert preps_of(spark, one([("roasted", 27, 0, 15), ("stewed", 25, 0, 16), ("fried", 30, 12, 20)])) == [("cooked", 2), ("fried", 1)]


def test_several_named_siblings_keep_cooked(spark):
    assert preps_of(spark, one([("cooked", 2, 20, .1), ("boiled", 2, 12, .1), ("fried", 3.5, 35, 15)])) == [("boiled", 1), ("cooked", 1), ("fried", 1)]


def test_one_label_is_one_preparation(spark):
    assert preps_of(spark, one([("raw", 9.3, 0, 53), ("raw", 26.6, 0, 32.2)])) == [("raw", 2)]


def test_raw_never_joins_cooked(spark):
    assert preps_of(spark, one([("raw", 12.6, .7, 9.5), ("poached", 12.5, .7, 9.5)])) == [("poached", 1), ("raw", 1)]


def test_shared_parent(spark):
    assert preps_of(spark, one([("grilled", 31, 0, 3.6), ("baked", 31, 0, 3.6)])) == [("cooked", 2)]


def test_unlabelled_food_joins(spark):
    assert preps_of(spark, one([("raw", 17, 0, 13.4), ("baked", 25.4, 0, 12.4), (None, 25.6, 0, 12)])) == [("baked", 2), ("raw", 1)]


def test_fat_levels_are_one_item(spark):
    rows = one([("raw", 14.4, 0, 30, 30.0), ("raw", 17.4, 0, 20, 20.0), ("raw", 21.4, 0, 5, 5.0)])
    got = cluster.cluster(foods(spark, rows))
    item = got.items.first()
    assert (item.n_foods, item.n_preps, item.variable_fat) == (3, 1, True)


def test_no_identity_stays_alone(spark):
    rows = [(1, None, "ingredient", None, 1, 1, 1), (2, None, "ingredient", None, 1, 1, 1)]
    assert cluster.cluster(foods(spark, rows)).items.count() == 2


def test_representative_has_the_widest_panel(spark):
    rows = [(1, "x", "ingredient", "raw", 1, 1, 1, None, 3), (2, "x", "ingredient", "raw", 1, 1, 1, None, 60)]
    assert cluster.cluster(foods(spark, rows)).items.first().merged_food_id == 2


def test_kind_vote(spark):
    same = [(i, "white rice", k, None, 1, 1, 1) for i, k in ((1, "ingredient"), (2, "ingredient"), (3, "dish"))]
    assert cluster.cluster(foods(spark, same)).items.count() == 1
    two_ways = [*same[:2], (3, "rice, white", "dish", None, 1, 1, 1)]
    assert cluster.cluster(foods(spark, two_ways)).items.count() == 2


def _expected(rows):
    """Buckets in order, greedy complete linkage, widest label, absorption, final order."""
    def mean(b, i):
        return round(sum(r[4 + i] for r in b) / len(b), 9)

    def parent(x):
        return "cooked" if x in COOKED else x

    variable = any(r[7] is not None for r in rows)

    def vector(b):
        p, c, f = (mean(b, i) for i in range(3))
        lean = max(1.0, 100 - f)
        return (p * 100 / lean, c * 100 / lean) if variable else (p, c, f)

    def near(a, b):
        return max(abs(x - y) / max(5.0, x, y) for x, y in zip(vector(a), vector(b))) <= 0.2

    by_label = {}
    for r in rows:
        by_label.setdefault(r[3], []).append(r)
    groups = []
    for label in sorted(by_label, key=lambda k: (k is None, -mean(by_label[k], 0), k or "")):
        for g in groups:
            family = {parent(b[0][3]) for b in g} - {None}
            if (label is None or not family or family == {parent(label)}) and all(near(by_label[label], b) for b in g):
                g.append(by_label[label])
                break
        else:
            groups.append([by_label[label]])
    preps = []
    for g in groups:
        named = {b[0][3] for b in g} - {None}
        label = None if not named else named.copy().pop() if len(named) == 1 else parent(min(named))
        preps.append((label, [r for b in g for r in b]))
    vague = [i for i, (x, m) in enumerate(preps) if x == "cooked" and not any(r[3] in COOKED for r in m)]
    named = [i for i, (x, _) in enumerate(preps) if x in COOKED]
    if len(vague) == 1 and len(named) == 1:
        preps[named[0]] = (preps[named[0]][0], preps[named[0]][1] + preps[vague[0]][1])
        del preps[vague[0]]
    return sorted(((x, tuple(sorted(r[0] for r in m))) for x, m in preps), key=repr)


def test_split_matches_brute_force(spark):
    rng = random.Random(5)
    rows, want = [], []
    for item in range(120):
        fat = item % 5 == 0
        mine = []
        for _ in range(rng.randint(1, 9)):
            label = rng.choice(["raw", "cooked", "boiled", "fried", "roasted", "grilled", "dried", None])
            mine.append((len(rows) + len(mine) + 1, f"item {'abcdefghij'[item % 10]}{'abcdefghijkl'[item // 10]}x", "ingredient", label,
                         float(rng.randint(5, 12)), float(rng.randint(0, 8)), float(rng.randint(0, 9)),
                         5.0 if fat and rng.random() < .5 else None, 3))
        rows += mine
        want += _expected(mine)
    got = cluster.cluster(foods(spark, rows))
    labels = {r.prep_id: r.prep_type for r in got.preps.collect()}
    members = {}
    for r in got.links.collect():
        members.setdefault(r.prep_id, []).append(r.fdc_id)
    assert sorted(((labels[p], tuple(sorted(m))) for p, m in members.items()), key=repr) == sorted(want, key=repr)


def test_result_does_not_depend_on_layout(spark):
    rng = random.Random(9)
    rows = [(i, f"n{'abcde'[i % 5]}", "ingredient", rng.choice(["raw", "boiled", None]), rng.randint(1, 30), 1, 2) for i in range(200)]
    df = foods(spark, rows)
    a = cluster.cluster(df.repartition(1)).preps.orderBy("prep_id").collect()
    b = cluster.cluster(df.repartition(7)).preps.orderBy("prep_id").collect()
    assert a == b


def test_one_identity_may_hold_most_foods(spark):
    rows = [(i, "rice" if i % 3 else f"food {'abcdefghij'[i % 10]}", "ingredient", "raw" if i % 2 else None, 7, 80, 1) for i in range(3000)]
    got = cluster.cluster(foods(spark, rows))
    assert got.links.count() == 3000
    assert got.items.agg({"n_foods": "sum"}).first()[0] == 3000


def test_clustering_twice_changes_nothing(spark):
    rows = [(1, "rice", "ingredient", "raw", 1, 1, 1), (2, "rice", "ingredient", "raw", 1, 1, 1), (3, "stew", "dish", None, 5, 5, 5)]
    got = cluster.cluster(foods(spark, rows))
    empty = spark.createDataFrame([], ITEMS)
    first = changes.merge_clusters(empty, got.items)
    assert first.counts.first().created == 2
    stored = materialise(conform(first.snapshot, ITEMS), "items")
    again = changes.merge_clusters(stored, got.items)
    assert tuple(again.counts.first()) == (0, 0, 0)
    assert again.audit.count() == 0
