import math
import random
from collections import Counter
from itertools import permutations

from larder.operators.pairs import food_pairs


def brute(rows, keep):
    baskets = {}
    for r, f in rows:
        baskets.setdefault(r, set()).add(f)
    freq = Counter(f for b in baskets.values() for f in b)
    pairs = Counter(p for b in baskets.values() for p in permutations(b, 2))
    out = {}
    for (a, b), n in pairs.items():
        score = math.log(n * len(baskets) / (freq[a] * freq[b]))
        out.setdefault(a, []).append((-score, -n, b))
    return {(a, b, -n) for a, xs in out.items() for s, n, b in sorted((round(s, 12), n, b) for s, n, b in xs)[:keep]}


def result(df):
    return {(r.food_id, r.pair_food_id, r.n_recipes) for r in df.collect()}


def test_pairs_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 40), rng.randint(1, 30)) for _ in range(300)]
    df = spark.createDataFrame(rows, "recipe_id long, food_id long")
    assert result(food_pairs(df, keep=5)) == brute(rows, 5)


def test_twenty_huge_recipes_are_exact(spark):
    """Foods of few and of many huge recipes, twins, and small recipes beside them."""
    rng = random.Random(4)
    rows = [(rng.randint(100, 160), rng.randint(1, 120)) for _ in range(200)]
    for recipe in range(1, 21):
        share = rng.choice([0.05, 0.5, 0.9])
        rows += [(recipe, f) for f in range(1, 121) if rng.random() < share]
        rows += [(recipe, 1000 + 10 * recipe + i) for i in range(rng.choice([0, 3, 9]))]
    rows += [(r, f) for f in range(500, 530) for r in (3, 5, 7)]
    df = spark.createDataFrame(rows, "recipe_id long, food_id long")
    for keep in (3, 6, 25):
        assert result(food_pairs(df, keep=keep)) == brute(rows, keep)


def test_recipes_are_split_over_tasks(spark, monkeypatch):
    from larder.operators import pairs
    monkeypatch.setattr(pairs, "TASK_PAIRS", 50)
    rng = random.Random(6)
    rows = [(rng.randint(1, 12), rng.randint(1, 60)) for _ in range(400)]
    df = spark.createDataFrame(rows, "recipe_id long, food_id long")
    assert result(food_pairs(df, keep=7)) == brute(rows, 7)


def test_pairs_are_symmetric_when_nothing_is_cut(spark):
    rows = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 1), (3, 3)]
    got = result(food_pairs(spark.createDataFrame(rows, "recipe_id long, food_id long")))
    assert {(b, a, n) for a, b, n in got} == got


def test_pairs_are_met_in_as_many_tasks_as_they_need(spark, monkeypatch):
    from larder.operators import pairs
    monkeypatch.setattr(pairs, "TASK_PAIRS", 200)
    basket = spark.range(900).selectExpr("id div 6 AS recipe_id", "id % 91 AS food_id")
    rows = pairs._rows(basket, 25)
    joined = pairs._met(rows, rows.select("recipe_id", "food_id", "n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [recipe_id" in joined and ", 54" in joined
