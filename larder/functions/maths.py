"""Numbers: scaling, shares, portions, scores, distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from larder import fixed
from larder.functions import text


def scaled(grams: Column, per_100g: Column) -> Column:
    """A per-100 g value at a weight; NULL stays NULL."""
    return grams / 100.0 * per_100g


def staged(grams: Column, per_100g: Column) -> Column:
    """The same for a staged plate, where a missing value counts as zero."""
    return F.coalesce(per_100g, F.lit(0.0)) * grams / 100.0


def per_100g(value: Column, serving_g: Column) -> Column:
    return value / (F.coalesce(serving_g, F.lit(100.0)) / 100.0)


def serving_of(grams: Column, qty: Column) -> Column:
    """Weight of one measure, from a logged amount of several."""
    return grams / F.coalesce(qty, F.lit(1.0))


def mutual_information(n_ab: Column, n_a: Column, n_b: Column, total: Column) -> Column:
    return F.log((n_ab * total) / (n_a * n_b.cast("double")))


def loggable_grams(grams: Column, serving_g: Column) -> Column:
    """A usable estimate rounded, else the food's serving, else 100."""
    usable = ~F.isnan(grams) & grams.between(fixed.MIN_GRAMS, fixed.MAX_GRAMS)
    return (
        F.when(usable, F.round(grams))
        .when(serving_g > 0, serving_g)
        .otherwise(F.lit(fixed.DEFAULT_GRAMS))
    )


def reported_grams(grams: Column) -> Column:
    """A usable estimate rounded, else 0 for "none"."""
    usable = ~F.isnan(grams) & grams.between(fixed.MIN_GRAMS, fixed.MAX_GRAMS)
    return F.when(usable, F.floor(grams + 0.5).cast("double")).otherwise(F.lit(0.0))


def not_negative(c: Column) -> Column:
    """Only for generated foods: measured ones may be slightly below zero."""
    return F.greatest(F.lit(0.0), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)))


def unit_interval(c: Column) -> Column:
    return F.least(F.lit(1.0), not_negative(c))


def atwater(protein: Column, carb: Column, fat: Column) -> Column:
    def z(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return F.round(z(protein) * 4 + z(carb) * 4 + z(fat) * 9)


def energy(kcal: Column, protein: Column, carb: Column, fat: Column) -> Column:
    """The typed energy, or the macro total when left blank."""
    return F.coalesce(F.round(kcal), atwater(protein, carb, fat))


def energy_shares(protein: Column, carb: Column, fat: Column) -> dict[str, Column]:
    """Whole percent of energy per macro; negatives floor at 0, no energy reads 0."""
    parts = {
        "protein_pct": F.greatest(F.coalesce(protein, F.lit(0.0)) * 4, F.lit(0.0)),
        "carb_pct": F.greatest(F.coalesce(carb, F.lit(0.0)) * 4, F.lit(0.0)),
        "fat_pct": F.greatest(F.coalesce(fat, F.lit(0.0)) * 9, F.lit(0.0)),
    }
    total = parts["protein_pct"] + parts["carb_pct"] + parts["fat_pct"]
    return {
        name: F.when(total <= 0, F.lit(0)).otherwise(F.round(part / total * 100)).cast("int")
        for name, part in parts.items()
    }


def target_share(value: Column, goal: Column) -> Column:
    """Percent of a daily target, held within 0..100."""
    share = F.least(F.lit(100.0), F.greatest(F.lit(0.0), value / goal * 100))
    return F.round(share).cast("int")


def macro_ratio(protein: Column, carb: Column, fat: Column) -> dict[str, Column]:
    total = (F.coalesce(protein, F.lit(0.0)) + F.coalesce(carb, F.lit(0.0))
             + F.coalesce(fat, F.lit(0.0)))
    return {
        name: F.round(F.try_divide(part, total), 3)
        for name, part in (("p", protein), ("c", carb), ("f", fat))
    }


def portion_ladder(serving_g: Column) -> Column:
    """Rising gram steps below one serving, to the nearest 5 g, then the serving itself."""
    unit = F.when(serving_g > 0, serving_g).otherwise(F.lit(100.0))
    rungs = F.array(*[F.round(f * unit / 5) * 5.0 for f in fixed.PORTION_FRACTIONS])
    fit = F.filter(rungs, lambda g: (g >= 5) & (g < unit))
    return F.concat(F.array_distinct(fit), F.array(unit))


def portion_units(serving_g: Column, serving_label: Column, portions: Column) -> Column:
    """Units offered for a food: its serving, its portions, grams and ounces; first label wins.

    ``portions`` is an ordered array of (label, gram_weight).
    """
    def unit(label: Column, weight: Column, measure: bool) -> Column:
        return F.struct(label.alias("label"), weight.alias("gram_weight"),
                        F.lit(measure).alias("is_measure"))

    empty = F.array().cast("array<struct<label:string,gram_weight:double,is_measure:boolean>>")
    own = F.when(serving_g.isNotNull() & serving_label.isNotNull(),
                 F.array(unit(serving_label, serving_g, True))).otherwise(empty)
    listed = F.coalesce(
        F.transform(portions, lambda p: unit(p["label"], p["gram_weight"], True)), empty
    )
    fixed_units = F.array(
        unit(F.lit("g"), F.lit(1.0), False), unit(F.lit("oz"), F.lit(fixed.OUNCE_G), False)
    )
    every = F.filter(F.concat(own, listed, fixed_units), lambda u: u["gram_weight"] > 0)
    labels = F.transform(every, lambda u: u["label"])
    return F.filter(every, lambda u, i: F.array_position(labels, u["label"]) == i + 1)


def picked_portion(amount: Column, unit_label: Column, unit_weight: Column, measure: Column) -> Column:
    """(grams, qty, portion_label, label): a quantity is kept only for a real measure."""
    grams = amount * unit_weight
    return F.struct(
        grams.alias("grams"),
        F.when(measure, amount).alias("qty"),
        F.when(measure, unit_label).alias("portion_label"),
        F.when(measure, F.concat(text.format_amount(amount), F.lit(" × "), unit_label))
        .otherwise(F.concat(text.format_grams(grams), F.lit(" g"))).alias("label"),
    )


def composite_rank(rank: Column, commonness: Column, prep_type: Column, recent: Column,
                   exact: Column, penalised: Column) -> Column:
    """Index rank (negative) times a boost; smaller is better."""
    w = fixed.RANK_WEIGHTS
    cooked = F.coalesce(prep_type == "cooked", F.lit(False)).cast("double")
    seen = F.least(F.coalesce(recent, F.lit(0)), F.lit(w["recency_cap"])) / w["recency_cap"]
    return rank * (
        1
        + w["commonness"] * F.coalesce(commonness, F.lit(w["commonness_default"]))
        + w["cooked"] * cooked
        + w["recency"] * seen
        + w["exact"] * F.coalesce(exact, F.lit(False)).cast("double")
        - w["penalty"] * F.coalesce(penalised, F.lit(False)).cast("double")
    )


def relative_gap(x: Column, y: Column) -> Column:
    return F.abs(x - y) / F.greatest(F.lit(fixed.PREP_FLOOR_G), x, y)


def macro_distance(a: Column, b: Column, variable_fat: Column) -> Column:
    """Worst relative gap of two (protein, carb, fat) structs.

    Across fat levels only protein and carbohydrate count, per 100 g of lean.
    """
    def lean(s: Column, axis: str) -> Column:
        return s[axis] * 100 / F.greatest(F.lit(1.0), 100.0 - s["fat"])

    plain = F.greatest(*[relative_gap(a[x], b[x]) for x in ("protein", "carb", "fat")])
    by_lean = F.greatest(*[relative_gap(lean(a, x), lean(b, x)) for x in ("protein", "carb")])
    return F.when(variable_fat, by_lean).otherwise(plain)


def projected_cost(cost: Column, succeeded: Column, remaining: Column) -> Column:
    return F.round(F.try_divide(cost, succeeded) * remaining, 4)


def projected_minutes(elapsed_s: Column, succeeded: Column, remaining: Column) -> Column:
    return F.round(F.try_divide(elapsed_s, succeeded) * remaining / 60, 1)
