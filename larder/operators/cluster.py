"""Foods to items and preparations.

An item is an identity key with one voted kind. Its preparations start from the
stated labels and are merged where the macros agree. All of it runs on at most one
row per (identity, kind, label), reduced before the first shuffle, so an identity
that holds a third of all foods is no larger to handle than any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from larder import fixed
from larder.functions import labels, text
from larder.functions.structured import bound
from larder.functions.maths import macro_distance
from larder.operators.relational import salted_join

DIGITS = 9


@dataclass(frozen=True)
class Clusters:
    items: DataFrame
    preps: DataFrame
    links: DataFrame


def identified(foods: DataFrame) -> DataFrame:
    """Adds ``base_key``, ``written`` and a non-NULL ``kind``.

    A food without an identity keys on its own id, so it stays alone.
    """
    # each name's words are found once, the key and the written form both made of them
    said = bound(text.key_words(F.col("base_name")), lambda ws: F.struct(
        F.coalesce(text.key_of_words(ws), F.lit("")).alias("key"), F.array_join(F.array_distinct(ws), " ").alias("written")))
    alone = F.concat(F.lit("\x00"), F.col("fdc_id").cast("string"))
    keys = bound(said, lambda s: F.struct(
        F.when(s["key"] != "", s["key"]).otherwise(alone).alias("base_key"),
        F.when(F.coalesce("base_name", F.lit("")) != "", s["written"]).alias("written")))
    return foods.withColumn("_said", keys).withColumns({
        "base_key": F.coalesce("_said.base_key", alone), "written": F.col("_said.written"),
        "kind": F.coalesce("food_kind", F.lit("")),
    }).drop("_said")


def key_votes(keyed: DataFrame) -> DataFrame:
    """Per identity: kinds, the winning kind, and whether it was written in two ways."""
    per_kind = keyed.groupBy("base_key", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("written").alias("w0"), F.max("written").alias("w1")
    )
    ballot = F.struct(F.col("n"), F.col("kind") == "ingredient", F.col("kind"))
    return per_kind.groupBy("base_key").agg(
        F.count(F.lit(1)).alias("n_kinds"),
        F.max_by("kind", ballot).alias("winner"),
        F.sum("n").alias("n_foods"),
        (F.min("w0") != F.max("w1")).alias("_two"),
    ).withColumn("two_spellings", F.coalesce("_two", F.lit(False))).drop("_two")


def voted_kinds(votes: DataFrame) -> DataFrame:
    """(base_key, voted): only identities that disagree and are written one way."""
    return votes.filter((F.col("n_kinds") > 1) & ~F.col("two_spellings")).select(
        "base_key", F.col("winner").alias("voted")
    )


def _digest_part(start: int) -> Column:
    return F.bit_xor(F.conv(F.substring(F.md5(F.col("fdc_id").cast("string")), start, 15), 16, 10).cast("bigint"))


def label_buckets(keyed: DataFrame) -> DataFrame:
    """One row per (identity, recorded kind, label): counts, sums, representative, digest."""
    def macro(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)).cast("double")

    total = sum((macro(c) for c in fixed.MERGE_MACROS[1:]), macro(fixed.MERGE_MACROS[0]))
    version = F.max("source_version") if "source_version" in keyed.columns else F.lit(None).cast("string")
    return keyed.groupBy("base_key", "kind", "prep_label").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(macro(c)).alias(c) for c in fixed.MERGE_MACROS],
        F.min(F.struct((-F.round(total, DIGITS)).alias("m"), F.col("fdc_id").alias("id"))).alias("lead"),
        F.min(F.struct((-F.col("n_nutrients")).alias("n"), F.length("description").alias("len"),
                       F.col("fdc_id").alias("id"), F.col("food_category").alias("category"))).alias("rep"),
        F.bool_or(F.col("fat_percentage").isNotNull()).alias("variable_fat"),
        F.bool_or(F.coalesce("brand_flagged", F.lit(False))).alias("brand_flagged"),
        _digest_part(1).alias("d1"), _digest_part(16).alias("d2"),
        version.alias("source_version"),
    )


_SUMS = ("n", *fixed.MERGE_MACROS)


def item_buckets(buckets: DataFrame, voted: DataFrame) -> DataFrame:
    """The buckets under each item's final kind, remembering the recorded kinds."""
    ruled = buckets.join(voted, "base_key", "left").withColumn(
        "item_kind", F.coalesce("voted", "kind")
    )
    return ruled.groupBy("base_key", "item_kind", "prep_label").agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.min("lead").alias("lead"), F.min("rep").alias("rep"),
        F.bool_or("variable_fat").alias("variable_fat"),
        F.bool_or("brand_flagged").alias("brand_flagged"),
        F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"),
        F.max("source_version").alias("source_version"),
        F.collect_set("kind").alias("kinds"),
    )


def _mean(s: Column, c: str) -> Column:
    return F.round(s[c] / s["n"], DIGITS)


def _vector(s: Column) -> Column:
    return F.struct(_mean(s, "protein_g").alias("protein"), _mean(s, "carb_g").alias("carb"),
                    _mean(s, "fat_g").alias("fat"))


def _merge_labels(buckets: Column, variable_fat: Column) -> Column:
    """Ordered buckets folded into groups: array of (parent, members).

    A bucket joins the first group whose label family it fits and all of whose
    members lie within the distance; otherwise it starts a group.
    """
    group = ("array<struct<parent:string,members:array<struct<label:string,n:bigint,"
             "protein_g:double,carb_g:double,fat_g:double,"
             "parent:string,vector:struct<protein:double,carb:double,fat:double>,"
             "lead:struct<m:double,id:bigint>,"
             "rep:struct<n:bigint,len:int,id:bigint,category:string>,kinds:array<string>>>>>")

    def first_fit(groups: Column, b: Column) -> Column:
        fits = F.transform(groups, lambda g: (
            (g["parent"].isNull() | b["parent"].isNull() | (g["parent"] == b["parent"]))
            & F.forall(g["members"], lambda m:
                       macro_distance(b["vector"], m["vector"], variable_fat) <= fixed.PREP_DISTANCE)
        ))
        return F.array_position(fits, True)

    def step(groups: Column, b: Column) -> Column:
        def placed(at: Column) -> Column:
            joined = F.transform(groups, lambda g, i: F.when(
                i + 1 == at,
                F.struct(F.coalesce(g["parent"], b["parent"]).alias("parent"),
                         F.concat(g["members"], F.array(b)).alias("members")),
            ).otherwise(g))
            fresh = F.array(F.struct(b["parent"].alias("parent"), F.array(b).alias("members")))
            return F.when(at > 0, joined).otherwise(F.concat(groups, fresh))

        return bound(first_fit(groups, b), placed)

    return F.aggregate(buckets, F.array().cast(group), step)


def _prep_of(members: Column) -> Column:
    """One preparation from its buckets: widest label, totals, representative."""
    def total(c: str, kind: str) -> Column:
        return F.aggregate(members, F.lit(0).cast(kind), lambda t, m: t + m[c])

    named = F.array_distinct(F.filter(F.transform(members, lambda m: m["label"]), lambda x: x.isNotNull()))
    stated = bound(named, lambda n: F.struct(
        F.when(F.size(n) == 1, F.get(n, F.lit(0))).when(F.size(n) > 1, labels.parent_label(F.array_min(n))).alias("label"),
        F.exists(n, lambda x: x.isin(*fixed.COOKED_METHODS)).alias("method")))
    return bound(stated, lambda said: F.struct(
        said["label"].alias("label"), total("n", "bigint").alias("n"),
        *[total(c, "double").alias(c) for c in fixed.MERGE_MACROS],
        F.array_min(F.transform(members, lambda m: m["lead"])).alias("lead"),
        F.array_min(F.transform(members, lambda m: m["rep"])).alias("rep"),
        said["method"].alias("states_method"),
        F.flatten(F.transform(members, lambda m: F.transform(
            m["kinds"], lambda k: F.struct(k.alias("kind"), m["label"].alias("label"))))).alias("sources"),
    ))


def _absorb_vague(preps: Column) -> Column:
    """A "cooked" nobody gave a method for joins the only preparation that names one."""
    def vague(p: Column) -> Column:
        return F.coalesce((p["label"] == "cooked") & ~p["states_method"], F.lit(False))

    def method(p: Column) -> Column:
        return F.coalesce(p["label"].isin(*fixed.COOKED_METHODS), F.lit(False))

    loose = F.filter(preps, vague)
    one_each = (F.size(loose) == 1) & (F.size(F.filter(preps, method)) == 1)

    def absorbed(taken: Column) -> Column:
        return F.transform(F.filter(preps, lambda p: ~vague(p)), lambda p: F.when(method(p), F.struct(
            p["label"].alias("label"), (p["n"] + taken["n"]).alias("n"),
            *[(p[c] + taken[c]).alias(c) for c in fixed.MERGE_MACROS],
            F.least(p["lead"], taken["lead"]).alias("lead"),
            F.least(p["rep"], taken["rep"]).alias("rep"),
            p["states_method"].alias("states_method"),
            F.concat(p["sources"], taken["sources"]).alias("sources"),
        )).otherwise(p))

    return F.when(one_each, bound(F.get(loose, F.lit(0)), absorbed)).otherwise(preps)


def split_items(buckets: DataFrame) -> DataFrame:
    """One row per item with its ordered preparations as an array."""
    own = F.struct("n", *fixed.MERGE_MACROS)
    spread = F.struct(
        F.col("prep_label").isNull().alias("o1"),
        (-F.round(F.col("protein_g") / F.col("n"), DIGITS)).alias("o2"),
        F.coalesce("prep_label", F.lit("")).alias("o3"),
        F.struct(F.col("prep_label").alias("label"), "n", *fixed.MERGE_MACROS,
                 labels.parent_label(F.col("prep_label")).alias("parent"), _vector(own).alias("vector"), "lead", "rep",
                 F.array_sort("kinds").alias("kinds")).alias("b"),
    )
    grouped = buckets.groupBy("base_key", "item_kind").agg(
        F.transform(F.array_sort(F.collect_list(spread)), lambda s: s["b"]).alias("buckets"),
        F.bool_or("variable_fat").alias("variable_fat"),
        F.bool_or("brand_flagged").alias("brand_flagged"),
        F.sum("n").alias("n_foods"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"),
        F.max("source_version").alias("source_version"),
    )
    def ordered(preps: Column) -> Column:
        return F.transform(F.array_sort(F.transform(preps, lambda p: F.struct(
            (-(_mean(p, "protein_g") + _mean(p, "carb_g") + _mean(p, "fat_g"))).alias("o1"),
            p["lead"]["id"].alias("o2"), p.alias("p")))), lambda s: s["p"])

    groups = _merge_labels(F.col("buckets"), F.col("variable_fat"))
    each = bound(groups, lambda gs: F.transform(gs, lambda g: _prep_of(g["members"])))
    preps = grouped.withColumn("preps", bound(each, lambda ps: ordered(bound(ps, _absorb_vague)))).drop("buckets")
    default = F.array_max(F.transform("preps", lambda p, i: F.struct(
        p["n"].alias("n"), (-i).alias("o"), p["rep"].alias("rep"))))["rep"]
    return preps.withColumn("default", default).select(
        F.col("default.id").alias("merged_food_id"),
        F.concat_ws("-", F.col("n_foods").cast("string"), F.hex("d1"), F.hex("d2")).alias("member_key"),
        F.col("n_foods").cast("int").alias("n_foods"),
        F.size("preps").alias("n_preps"),
        F.col("default.category").alias("food_category"),
        "variable_fat", "brand_flagged", "source_version", "base_key", "item_kind", "preps",
    )


def item_table(split: DataFrame) -> DataFrame:
    return split.drop("preps", "base_key", "item_kind")


def prep_table(split: DataFrame) -> DataFrame:
    each = split.select("merged_food_id", F.posexplode("preps").alias("seq", "p"))
    return each.select(
        F.col("p.rep.id").alias("prep_id"), "merged_food_id", F.col("seq").cast("int").alias("seq"),
        F.col("p.n").cast("int").alias("n_foods"), F.col("p.label").alias("prep_type"),
        *[(F.col(f"p.{c}") / F.col("p.n")).alias(c) for c in fixed.MERGE_MACROS],
    )


def link_table(keyed: DataFrame, split: DataFrame) -> DataFrame:
    """Food -> item and preparation, through its (identity, kind, label).

    The hot identities are spread over several tasks.
    """
    each = split.select("base_key", "merged_food_id", F.explode("preps").alias("p"))
    places = each.select(
        "base_key", "merged_food_id", F.col("p.rep.id").alias("prep_id"), F.inline("p.sources")
    ).withColumn("label", F.coalesce("label", F.lit("")))
    rows = keyed.select("fdc_id", "base_key", "kind", F.coalesce("prep_label", F.lit("")).alias("label"))
    on = ["base_key", "kind", "label"]
    sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return salted_join(rows, places, on, sizes).select("fdc_id", "merged_food_id", "prep_id")


_KEPT = ("fdc_id", "base_key", "written", "kind", "prep_label", "description", "food_category",
         "fat_percentage", "brand_flagged", "n_nutrients", *fixed.MERGE_MACROS)


def cluster(foods: DataFrame, hold=lambda df: df) -> Clusters:
    """Items, preparations and links of a foods frame.

    Expects fdc_id, description, food_category, fat_percentage, brand_flagged,
    n_nutrients, base_name, food_kind, prep_label and the three macros. ``hold``
    may store the two results read more than once: the foods with their identity
    key, and the one row per item behind all three tables.
    """
    extra = [c for c in ("source_version",) if c in foods.columns]
    keyed = hold(identified(foods).select(*_KEPT, *extra))
    buckets = item_buckets(label_buckets(keyed), voted_kinds(key_votes(keyed)))
    split = hold(split_items(buckets))
    return Clusters(item_table(split), prep_table(split), link_table(keyed, split))
