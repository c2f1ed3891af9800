"""The intake log: entries with their nutrient snapshot, totals, recents, recipes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larder import fixed
from larder.functions import dates, maths, text
from larder.operators.changes import replace_children
from larder.operators.relational import numbered, stacked, top_k, without

NUTRIENTS = tuple(fixed.APP_NUTRIENTS)
MACROS = ("energy_kcal", "protein_g", "fat_g", "carb_g")


# --- reading the log ---------------------------------------------------------
def live(log: DataFrame, since: str | Column | None = None, until: str | None = None) -> DataFrame:
    """Entries not deleted, within local dates; the log is partitioned by that date."""
    rows = log.filter(F.col("deleted") == 0)
    if since is not None:
        rows = rows.filter(F.col("local_date") >= since)
    return rows.filter(F.col("local_date") <= until) if until is not None else rows


def reference(food_id: Column, custom_food_id: Column) -> Column:
    """``catalog`` or ``custom``; exactly one id must be set."""
    bad = F.raise_error(F.lit("a log entry must name exactly one food")).cast("string")
    return F.when(food_id.isNull() == custom_food_id.isNull(), bad).when(
        food_id.isNotNull(), F.lit("catalog")).otherwise(F.lit("custom"))


def timeline(log: DataFrame, keys: Sequence[str] = ("user_id",), date: str | None = None) -> DataFrame:
    """Entries with what they amount to; ``place`` is their order in the day, by the time they were logged."""
    rows = live(log, date, date) if date else live(log)
    rows = numbered(rows, [*keys, "local_date"], [F.col("logged_at"), F.col("id")], "place")
    return rows.select(*keys, "place", "id", "local_date", "logged_at", "name", "emoji", "grams", "portion_qty", "portion_label",
                       maths.scaled(F.col("grams"), F.col("energy_kcal")).alias("kcal"),
                       maths.scaled(F.col("grams"), F.col("protein_g")).alias("protein"),
                       maths.scaled(F.col("grams"), F.col("fat_g")).alias("fat"),
                       maths.scaled(F.col("grams"), F.col("carb_g")).alias("carb"))


def _macro_sums(digits: int | None = 0) -> list[Column]:
    out = []
    for name, column in zip(("kcal", "protein", "fat", "carb"), MACROS):
        total = F.sum(F.coalesce(maths.scaled(F.col("grams"), F.col(column)), F.lit(0.0)))
        # millionths first, so that the order of addition decides no tie
        out.append((F.round(F.round(total, 6), digits).cast("bigint") if digits == 0 else total).alias(name))
    return out


def day_totals(log: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Whole totals per user and day; a missing nutrient counts as zero."""
    return live(log).groupBy(*keys, "local_date").agg(*_macro_sums(), F.count(F.lit(1)).alias("n"))


def hour_timeline(log: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Hours 5 to 23 of every logged day with their totals, empty hours kept.

    Entries before five are in the day's totals but not shown here.
    """
    hour = dates.local_hour(F.col("logged_at"))
    sums = live(log).withColumn("hour", hour).groupBy(*keys, "local_date", "hour").agg(
        *_macro_sums(), F.count(F.lit(1)).alias("n"))
    # One shuffle: the hours are laid beside the sums of their own day.
    day = sums.groupBy(*keys, "local_date").agg(F.map_from_entries(F.collect_list(F.struct(
        "hour", F.struct("kcal", "protein", "fat", "carb", "n")))).alias("by_hour"))
    rows = day.withColumn("hour", F.explode(F.sequence(F.lit(fixed.FIRST_HOUR), F.lit(fixed.LAST_HOUR))))
    at = F.element_at("by_hour", F.col("hour"))
    return rows.select(*keys, "local_date", "hour", *[
        F.coalesce(at[c], F.lit(0)).alias(c) for c in ("kcal", "protein", "fat", "carb", "n")])


def hour_text(kcal: Column, protein: Column, carb: Column, fat: Column) -> Column:
    """``450 kcal · 30P 40C 12F``; only the energy when there are no macros, blank when neither."""
    def whole(c: Column) -> Column:
        return F.round(c).cast("bigint").cast("string")

    return (
        F.when(kcal == 0, F.lit(""))
        .when(protein + carb + fat == 0, F.concat(whole(kcal), F.lit(" kcal")))
        .otherwise(F.concat(whole(kcal), F.lit(" kcal · "), whole(protein), F.lit("P "),
                            whole(carb), F.lit("C "), whole(fat), F.lit("F")))
    )


def period_totals(log: DataFrame, period: Column, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Totals per user and period, say ``month_of`` or ``monday_week`` of the local date."""
    return live(log).groupBy(*keys, period.alias("period")).agg(
        *_macro_sums(), F.count_distinct("local_date").alias("days"))


def daily_averages(log: DataFrame, since: str, until: str, keys: Sequence[str] = ("user_id",),
                   nutrients: Sequence[str] = NUTRIENTS) -> DataFrame:
    """(keys, nutrient, per_day): mean over the days that have any entry; never logged stays NULL.

    One pass: the sums are taken wide and unpivoted afterwards, so rows are not
    repeated per nutrient.
    """
    totals = live(log, since, until).groupBy(*keys, "local_date").agg(*[
        F.sum(maths.scaled(F.col("grams"), F.col(c))).alias(c) for c in nutrients])
    wide = totals.groupBy(*keys).agg(
        *[(F.sum(c) / F.count(F.lit(1))).alias(c) for c in nutrients])
    return wide.unpivot(list(keys), list(nutrients), "nutrient", "per_day")


_RECENT = ("name", "emoji", *MACROS, "portion_label")


def recents(log: DataFrame, as_of: str, keys: Sequence[str] = ("user_id",),
            days: int = fixed.RECENT_DAYS, k: int = fixed.RECENT_LIMIT) -> DataFrame:
    """Most logged foods of the window, each with the facts of its latest entry.

    A logged ``2 × cup`` comes back as the weight of one cup.
    """
    rows = live(log, dates.days_before(as_of, days)).withColumn(
        "serving_g", maths.serving_of(F.col("grams"), F.col("portion_qty")))
    last = F.max_by(F.struct(*_RECENT, "serving_g"), F.struct("logged_at", "id"))
    grouped = rows.groupBy(*keys, "food_id", "custom_food_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("logged_at").alias("last_at"), last.alias("l"))
    flat = grouped.select(*keys, "food_id", "custom_food_id", "n", "last_at", "l.*")
    order = [F.col("n").desc(), F.col("last_at").desc(), F.col("food_id").asc_nulls_last(), F.col("custom_food_id")]
    return top_k(flat, list(keys), order, k)


def recents_by_item(log: DataFrame, foods: DataFrame, as_of: str, keys: Sequence[str] = ("user_id",),
                    days: int = fixed.RECENT_DAYS, k: int = fixed.RECENT_LIMIT) -> DataFrame:
    """The same, counted per item rather than per logged member."""
    per_food = live(log, dates.days_before(as_of, days)).filter(F.col("food_id").isNotNull()).groupBy(
        *keys, "food_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("logged_at", "id", "name", "grams")).alias("l"))
    items = per_food.join(foods.select("food_id", "merged_food_id"), "food_id").groupBy(
        *keys, "merged_food_id").agg(
        F.sum("n").alias("n"), F.max("l").alias("l"), F.max_by("food_id", "l").alias("food_id"))
    flat = items.select(*keys, "merged_food_id", "food_id", "n", F.col("l.logged_at").alias("last_at"),
                        F.col("l.name").alias("name"), F.col("l.grams").alias("grams"))
    return top_k(flat, list(keys), [F.col("n").desc(), F.col("last_at").desc(), F.col("merged_food_id")], k)


def energy_view(df: DataFrame) -> DataFrame:
    """Energy shares of each macro and shares of the daily targets, beside a row's macros."""
    shares = maths.energy_shares(F.col("protein_g"), F.col("carb_g"), F.col("fat_g"))
    targets = {f"{c}_of_target": maths.target_share(F.col(c), F.lit(goal))
               for c, goal in fixed.DAILY_TARGETS.items()}
    return df.withColumns({**shares, **targets})


def batch_totals(staged: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Sums of what is staged but not yet logged."""
    return staged.groupBy(*keys).agg(*[
        F.sum(maths.staged(F.col("grams"), F.col(f"{c}_100g"))).alias(c)
        for c in ("kcal", "protein", "carb", "fat")])


# --- writing to the log --------------------------------------------------------
def entry_id(*parts: Column) -> Column:
    """Repeatable id of an entry: a digest of where it came from and its position."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(32))


def snapshots(entries: DataFrame, foods: DataFrame, nutrition: DataFrame, custom_foods: DataFrame,
              nutrients: Sequence[str] = NUTRIENTS) -> DataFrame:
    """Log rows with the whole nutrient vector copied from wherever the food lives.

    ``entries`` holds id, food_id or custom_food_id, logged_at, grams, portion_qty,
    portion_label and an optional name. Unknown foods are not logged.
    """
    shared = [c for c in entries.columns if c not in ("food_id", "custom_food_id", "name")]
    own_name = F.col("e.name") if "name" in entries.columns else F.lit(None).cast("string")
    facts = foods.select("food_id", "display_name", "description", "emoji").join(
        nutrition.select("food_id", *nutrients), "food_id", "left")
    catalog = entries.filter(F.col("food_id").isNotNull()).alias("e").join(
        facts.alias("f"), F.col("e.food_id") == F.col("f.food_id")
    ).select(*[F.col(f"e.{c}") for c in shared], F.col("e.food_id"), F.lit(None).cast("string").alias("custom_food_id"),
             F.coalesce(own_name, F.col("f.display_name"), F.col("f.description")).alias("name"),
             F.col("f.emoji"), *[F.col(f"f.{c}") for c in nutrients])
    custom = entries.filter(F.col("custom_food_id").isNotNull()).alias("e").join(
        custom_foods.alias("c"), F.col("e.custom_food_id") == F.col("c.id")
    ).select(*[F.col(f"e.{c}") for c in shared], F.lit(None).cast("bigint").alias("food_id"),
             F.col("e.custom_food_id"), F.col("c.name"), F.col("c.emoji"), *[F.col(f"c.{c}") for c in nutrients])
    return catalog.unionByName(custom).withColumns({
        "local_date": dates.local_date(F.col("logged_at")), "deleted": F.lit(0), "dirty": F.lit(1)})


def named_custom(custom_foods: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(folded name, id): the latest live own food of each name."""
    return custom_foods.filter(F.col("deleted") == 0).groupBy(
        *keys, F.lower(F.trim("name")).alias("folded")).agg(
        F.max_by("id", F.struct("updated_at", "id")).alias("id"))


def find_or_create(wanted: DataFrame, custom_foods: DataFrame, now: Column,
                   keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(folded name -> id, rows to add) for foods supplied by name.

    A name is created once however often it is wanted, its first appearance giving
    the facts; ``wanted`` holds pos, name, emoji and per-100 g columns.
    """
    folded = F.lower(F.trim("name"))
    facts = [c for c in wanted.columns if c not in (*keys, "pos")]
    first = wanted.withColumn("folded", folded).groupBy(*keys, "folded").agg(
        F.min_by(F.struct(*facts), "pos").alias("f"))
    known = named_custom(custom_foods, keys)
    missing = without(first, known, [*keys, "folded"])
    new_id = entry_id(F.lit("custom"), *[F.col(k).cast("string") for k in keys], F.col("folded"))
    created = missing.select(
        new_id.alias("id"), *keys, "folded", F.trim("f.name").alias("name"),
        *[F.col(f"f.{c}").alias(c) for c in facts if c != "name"],
        now.alias("updated_at"), F.lit(0).alias("deleted"), F.lit(1).alias("dirty"))
    reused = known.join(first.select(*keys, "folded"), [*keys, "folded"], "left_semi")
    ids = reused.unionByName(created.select(*reused.columns))
    return ids, created.drop("folded")


def routed_batch(staged: DataFrame, custom_foods: DataFrame, now: Column,
                 keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(entries, own foods to add) for a staged batch.

    Catalogue and own foods keep their id. A detected food is reused or made by
    name; a typed one is always a row of its own, one nominal 100 g serving.
    """
    unsaved = F.col("food_id").isNull() & F.col("custom_food_id").isNull()
    detected, typed = staged.filter(unsaved & F.col("detected")), staged.filter(unsaved & ~F.col("detected"))
    macros = [c for c in MACROS if c in staged.columns]
    zeroed = {c: F.coalesce(c, F.lit(0.0)) for c in macros}
    facts = [*keys, "pos", "name", "emoji", *macros]
    ids, created = find_or_create(detected.select(*facts).withColumns(zeroed), custom_foods, now, keys)
    typed_id = entry_id(F.lit("typed"), *[F.col(k).cast("string") for k in keys], F.col("pos").cast("string"))
    typed = typed.withColumn("custom_food_id", typed_id)
    typed_rows = typed.select(
        F.col("custom_food_id").alias("id"), *keys, "name", "emoji", *macros,
        F.lit(100.0).alias("serving_g"), F.lit("serving").alias("serving_label"),
        now.alias("updated_at"), F.lit(0).alias("deleted"), F.lit(1).alias("dirty")).withColumns(zeroed)
    found = detected.withColumn("folded", F.lower(F.trim("name"))).drop("custom_food_id").join(
        ids.withColumnRenamed("id", "custom_food_id"), [*keys, "folded"]).drop("folded")
    entries = stacked(staged.filter(~unsaved), typed, found.select(*staged.columns))
    return entries, stacked(typed_rows, created)


def per_100g_rows(labels: DataFrame, nutrients: Sequence[str]) -> DataFrame:
    """Label values per serving, stored per 100 g."""
    return labels.withColumns({c: maths.per_100g(F.col(c), F.col("serving_g")) for c in nutrients})


# --- recipes -------------------------------------------------------------------
def rollup(ingredients: DataFrame, nutrition: DataFrame, custom_foods: DataFrame,
           nutrients: Sequence[str] = NUTRIENTS) -> DataFrame:
    """(recipe_id, serving_g, nutrients…): gram-weighted means back to per 100 g.

    An ingredient without a value still counts in the weight. One level deep: a
    nested recipe is read from its own stored row.
    """
    own = custom_foods.select(F.col("id").alias("custom_food_id"),
                              *[F.col(c).alias(f"own_{c}") for c in nutrients])
    rows = ingredients.join(nutrition.select("food_id", *nutrients), "food_id", "left").join(
        own, "custom_food_id", "left")
    total = F.nullif(F.sum("grams"), F.lit(0.0))
    return rows.groupBy("recipe_id").agg(total.alias("serving_g"), *[
        (F.sum(F.col("grams") * F.coalesce(c, f"own_{c}")) / total).alias(c) for c in nutrients])


def parents_of(ingredients: DataFrame, edited: DataFrame) -> DataFrame:
    """Recipes that use an edited own food."""
    return ingredients.join(edited.select(F.col("id").alias("custom_food_id")), "custom_food_id",
                            "left_semi").select("recipe_id").distinct()


def reroll(ingredients: DataFrame, edited: DataFrame, nutrition: DataFrame, custom_foods: DataFrame,
           nutrients: Sequence[str] = NUTRIENTS) -> DataFrame:
    """New roll-ups of the recipes right above edited foods, and no further."""
    affected = ingredients.join(parents_of(ingredients, edited), "recipe_id", "left_semi")
    return rollup(affected, nutrition, custom_foods, nutrients)


def save_recipes(recipes: DataFrame, current: DataFrame, incoming: DataFrame, nutrition: DataFrame,
                 custom_foods: DataFrame, now: Column,
                 nutrients: Sequence[str] = NUTRIENTS) -> tuple[DataFrame, DataFrame]:
    """(all ingredient rows, own foods restamped) after recipes were saved whole.

    ``incoming`` has ``pos`` for the order in which ingredients were given.
    """
    fresh = numbered(incoming, ["recipe_id"], [F.col("pos")]).select(*current.columns)
    rows = replace_children(current, fresh, recipes.select("recipe_id"), "recipe_id")
    saved = recipes.select("recipe_id").distinct()
    rolled = saved.join(rollup(fresh, nutrition, custom_foods, nutrients), "recipe_id", "left")
    values = rolled.select(F.col("recipe_id").alias("id"), F.struct("serving_g", *nutrients).alias("r"))
    joined = custom_foods.join(values, "id", "left")
    stamped = joined.select(*[
        F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(c)).alias(c)
        if c in ("serving_g", *nutrients) else
        F.when(F.col("r").isNotNull(), now).otherwise(F.col(c)).alias(c) if c == "updated_at" else
        F.when(F.col("r").isNotNull(), F.lit(1)).otherwise(F.col(c)).alias(c) if c == "dirty" else F.col(c)
        for c in custom_foods.columns])
    return rows, stamped


def recipes_only(custom_foods: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Own foods that have ingredients."""
    return custom_foods.join(ingredients.select(F.col("recipe_id").alias("id")), "id", "left_semi")


def cooking_view(steps: DataFrame, step_ingredients: DataFrame, ingredients: DataFrame,
                 foods: DataFrame, custom_foods: DataFrame) -> DataFrame:
    """Steps of a recipe with the ingredients each uses, named."""
    used = step_ingredients.join(
        ingredients.withColumnRenamed("seq", "ingredient_seq"), ["recipe_id", "ingredient_seq"], "left"
    ).join(foods.select("food_id", text.shown_name(F.col("display_name"), F.col("description")).alias("_n")),
           "food_id", "left").join(
        custom_foods.select(F.col("id").alias("custom_food_id"), F.col("name").alias("_c")), "custom_food_id", "left")
    return steps.withColumnRenamed("seq", "step_seq").join(
        used.select("recipe_id", "step_seq", "ingredient_seq", "grams", F.coalesce("_n", "_c").alias("ingredient")),
        ["recipe_id", "step_seq"], "left")
