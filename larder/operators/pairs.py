"""Foods that occur together in recipes, scored by pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from larder import fixed
from larder.functions.maths import mutual_information
from larder.operators.relational import top_k
from larder.session import materialise

#: Pairs that one task spells out of one recipe.
TASK_PAIRS = 1 << 20


def resolved_ingredients(input_foods: DataFrame, foods: DataFrame) -> DataFrame:
    """(recipe_id, food_id): ingredient codes resolved to foods, once per recipe."""
    coded = input_foods.filter(F.coalesce("ingredient_code", F.lit("")) != "").select(
        F.col("fdc_id").alias("recipe_id"), F.col("ingredient_code").alias("code")
    )
    known = foods.select(F.col("ndb_number").alias("code"), F.col("fdc_id").alias("food_id"))
    return coded.join(known, "code").select("recipe_id", "food_id").distinct()


def _rows(basket: DataFrame, keep: int) -> DataFrame:
    """(recipe_id, food_id, n, first): with the food's recipes, and if it can be a partner.

    Foods of exactly the same recipes tie as partners of any other, so only the keep + 1
    smallest of them, which are marked, can be among its best.
    """
    same = [F.bit_xor(F.xxhash64("recipe_id", F.lit(seed))) for seed in (1, 2)]
    foods = basket.groupBy("food_id").agg(
        F.count(F.lit(1)).alias("n"), same[0].alias("c1"), same[1].alias("c2"))
    first = top_k(foods, ["n", "c1", "c2"], [F.col("food_id")], keep + 1).select(
        "food_id", F.lit(True).alias("first"))
    counted = foods.join(first, "food_id", "left").select(
        "food_id", "n", F.coalesce("first", F.lit(False)).alias("first"))
    return basket.join(counted, "food_id")


def _large(rows: DataFrame, keep: int) -> DataFrame:
    """(recipe_id, m): recipes of more than ``keep`` foods."""
    return rows.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > keep)


def _asked(rows: DataFrame, large: DataFrame, keep: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(partners, skipped, floor): where which partner is looked for.

    In a recipe of more than ``keep`` foods the keep + 1 rarest score, with any food of
    it, no less than 1 recipe in common with the last of them would: the rate is r, that
    one's recipes. A food met in this recipe only is therefore among the best only if it
    is one of them. One met in k recipes must reach k / n >= 1 / r, so of the n recipes
    of a partner, smallest first, the last ones need not be searched: what shares only
    those shares too few. Sizes are told apart by powers of two.
    """
    within_large = rows.join(large, "recipe_id").withColumn("level", F.floor(F.log2("m")))
    short = top_k(within_large, ["recipe_id"], [F.col("n"), F.col("food_id")], keep + 1).drop("rn")
    rate = short.groupBy("recipe_id").agg(F.max("n").alias("r"))
    able = within_large.filter(F.col("first") & (F.col("n") > 1))
    up = Window.partitionBy("food_id").orderBy(F.col("level").desc())
    left = able.groupBy("food_id", "level").agg(F.count(F.lit(1)).alias("c")).withColumn("left", F.sum("c").over(up))
    judged = able.join(rate, "recipe_id").join(left.drop("c"), ["food_id", "level"])
    columns = ["recipe_id", "food_id", "n"]
    searched = judged.filter(F.col("r") * F.col("left") >= F.col("n")).select(*columns)
    in_large = searched.unionByName(short.filter("first").select(*columns)).distinct()
    small = rows.filter("first").join(large, "recipe_id", "left_anti").select(*columns)
    skipped = able.select(*columns).join(in_large, ["recipe_id", "food_id"], "left_anti")
    floor = within_large.join(rate, "recipe_id").groupBy("food_id").agg(F.min("r").alias("r"))
    return small.unionByName(in_large), skipped, floor


def _met(rows: DataFrame, partners: DataFrame, keep: int | None = None) -> DataFrame:
    """(food_id, n_food, pair_food_id, n_pair, n): recipes in which a food meets a partner.

    Each recipe is cut into as many parts as its pairs need tasks; a part is a hash of
    the food, so the same path serves recipes of every size. The parts are dealt into
    tasks by the number of all pairs, as a pair takes more room than the row it comes from.
    With ``keep``, the most foods of a recipe, pairs are dealt by food and ``slice``, as many
    as the food's pairs need tasks, so they can be cut to the best where they are counted.
    """
    asked = partners.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("p"))
    work = rows.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("m")).join(asked, "recipe_id").select(
        "recipe_id", (F.col("m") * F.col("p")).alias("pairs"), F.ceil(F.col("m") * F.col("p") / TASK_PAIRS).cast("int").alias("parts"))
    tasks = max(1, -(-2 * (work.agg(F.sum("pairs")).first()[0] or 0) // TASK_PAIRS))
    # at most one recipe for TASK_PAIRS pairs
    split = F.broadcast(work.filter("parts > 1").select("recipe_id", "parts"))
    parts = F.coalesce("parts", F.lit(1))
    mine = rows.join(split, "recipe_id", "left").select(
        "recipe_id", "food_id", F.col("n").alias("n_food"), F.pmod(F.xxhash64("food_id"), parts).cast("int").alias("part"))
    theirs = partners.join(split, "recipe_id", "left").select(
        "recipe_id", F.col("food_id").alias("pair_food_id"), F.col("n").alias("n_pair"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    mine, theirs = (side.repartition(tasks, "recipe_id", "part") for side in (mine, theirs))
    pairs, by = mine.join(theirs, ["recipe_id", "part"]).filter("food_id != pair_food_id"), ["food_id"]
    if keep is not None:
        slices = F.ceil(F.col("n_food") * keep / TASK_PAIRS)
        pairs, by = pairs.withColumn("slice", F.pmod(F.xxhash64("pair_food_id"), slices)), ["food_id", "slice"]
        pairs = pairs.repartition(tasks, *by)
    return pairs.groupBy(*by, "n_food", "pair_food_id", "n_pair").agg(F.count(F.lit(1)).alias("n"))


def _completed(met: DataFrame, rows: DataFrame, skipped: DataFrame, floor: DataFrame) -> DataFrame:
    """Adds the common recipes in which the partner was not searched.

    Only to pairs that can still reach the floor, and from the side that has fewer
    recipes to look through.
    """
    more = skipped.groupBy("food_id").agg(F.count(F.lit(1)).alias("s")).withColumnRenamed("food_id", "pair_food_id")
    reach = F.col("n") + F.least("s", F.col("n_food") - F.col("n"))
    open_ = met.join(more, "pair_food_id").join(floor, "food_id", "left").filter(
        F.col("r").isNull() | (reach * F.col("r") >= F.col("n_pair"))).select("food_id", "pair_food_id", "n_food", "s")
    places = rows.select("recipe_id", "food_id")
    theirs = skipped.select("recipe_id", F.col("food_id").alias("pair_food_id"))
    by_partner = open_.filter("s <= n_food").join(theirs, "pair_food_id").join(places, ["recipe_id", "food_id"])
    by_food = open_.filter("s > n_food").join(places, "food_id").join(theirs, ["recipe_id", "pair_food_id"])
    extra = by_partner.select("food_id", "pair_food_id").unionByName(by_food.select("food_id", "pair_food_id")).groupBy(
        "food_id", "pair_food_id").agg(F.count(F.lit(1)).alias("extra"))
    return met.join(extra, ["food_id", "pair_food_id"], "left").withColumn(
        "n", F.col("n") + F.coalesce("extra", F.lit(0))).drop("extra")


def food_pairs(ingredients: DataFrame, keep: int = fixed.MAX_PAIRS_PER_FOOD, hold=materialise) -> DataFrame:
    """(food_id, pair_food_id, n_recipes, score): the best partners of every food.

    ``ingredients`` is (recipe_id, food_id), repeats allowed. The distinct rows are stored
    with what is known of their foods, since both sides of the join read them. A recipe of
    at most ``keep`` foods is asked for all of them; what larger ones need besides is worked
    out where there are any.
    """
    rows = hold(_rows(ingredients.select("recipe_id", "food_id").dropna().distinct(), keep), "rows")
    total = rows.agg(F.count_distinct("recipe_id").alias("n_recipes_all"))
    large = hold(_large(rows, keep), "large")
    small = large.isEmpty()
    if small:
        pairs = _met(rows, rows.filter("first").select("recipe_id", "food_id", "n"), keep)
    else:
        partners, skipped, floor = _asked(rows, large, keep)
        partners, skipped = hold(partners, "partners"), hold(skipped, "skipped")
        pairs = _completed(hold(_met(rows, partners), "met"), rows, skipped, floor)
    scored = pairs.crossJoin(F.broadcast(total)).withColumn("score", mutual_information(
        F.col("n"), F.col("n_food"), F.col("n_pair"), F.col("n_recipes_all")))
    order = [F.col("score").desc(), F.col("n").desc(), F.col("pair_food_id")]
    if small:
        scored = top_k(scored, ["food_id", "slice"], order, keep).drop("rn")
    return top_k(scored, ["food_id"], order, keep).select(
        "food_id", "pair_food_id", F.col("n").alias("n_recipes"), "score"
    )


def named_pairs(pairs: DataFrame, foods: DataFrame, k: int = 10) -> DataFrame:
    """Partners with the name shown for them, best k per food."""
    names = foods.select(
        F.col("food_id").alias("pair_food_id"), F.coalesce("display_name", "description").alias("name")
    )
    best = top_k(pairs, ["food_id"], [F.col("score").desc(), F.col("pair_food_id")], k)
    return best.join(names, "pair_food_id").select("food_id", "pair_food_id", "name", "score", "rn")
