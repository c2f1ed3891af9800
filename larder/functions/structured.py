"""Arrays of numbers and structs, and the JSON exchanged with a scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from larder import fixed
from larder.functions import text

CANON_REPLY = "foods array<map<string,string>>"
PLATE_ROW = ("instance_id string, name string, search_term string, emoji string, grams double, "
             "confidence double, kcal_100g double, protein_100g double, carb_100g double, "
             "fat_100g double, shots array<int>")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sorted_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def union_shots(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def usable_shots(shots: Column, shot_count: Column) -> Column:
    """Shots within 1..n, distinct and rising; none usable means the newest."""
    n = F.greatest(shot_count, F.lit(1))
    kept = F.filter(F.coalesce(shots, F.array().cast("array<int>")), lambda s: s.between(1, n))
    return F.when(F.size(kept) == 0, F.array(n.cast("int"))).otherwise(sorted_set(kept))


def canon_payload(foods: Column) -> Column:
    """Request for a batch; ``foods`` is an array of (i, d, cat, aka, also, ing).

    Blank optional members are NULL and so left out of the text.
    """
    return F.to_json(F.struct(foods.alias("foods")))


def canon_food(i: Column, description: Column, category: Column, common: Column, extra: Column,
               ingredients: Column) -> Column:
    def some(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    return F.struct(
        i.alias("i"), description.alias("d"), some(category).alias("cat"),
        some(common).alias("aka"), some(extra).alias("also"), some(ingredients).alias("ing"),
    )


def enrich_payload(base: Column, kind: Column, category: Column, common: Column, extra: Column,
                   preps: Column) -> Column:
    """Request for one item. Label and category keep NULL; blank synonyms are left out."""
    rows = F.transform(preps, lambda p: F.struct(
        p["prep_type"].alias("prep"),
        F.array(*[F.bround(F.coalesce(p[m], F.lit(0.0)), 1) for m in fixed.MERGE_MACROS]).alias("m"),
        p["descs"].alias("d"),
    ))
    head = [base.alias("base"), kind.alias("kind"), category.alias("cat")]
    tail = [rows.alias("p")]
    keep_nulls = {"ignoreNullFields": "false"}
    has_common = F.coalesce(common, F.lit("")) != ""
    has_extra = F.coalesce(extra, F.lit("")) != ""

    def shape(*middle: Column) -> Column:
        return F.to_json(F.struct(*head, *middle, *tail), keep_nulls)

    return (
        F.when(has_common & has_extra, shape(common.alias("aka"), extra.alias("also")))
        .when(has_common, shape(common.alias("aka")))
        .when(has_extra, shape(extra.alias("also")))
        .otherwise(shape())
    )


def plate_payload(rows: Column) -> Column:
    """Staged plate as text; ``rows`` is an array of (instance_id, name, grams)."""
    return F.to_json(F.struct(rows.alias("plate")))


def keys_outside(json: Column, allowed: tuple[str, ...]) -> Column:
    return F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in allowed]))


def canon_record_errors(r: Column) -> Column:
    """Rule names one answered food breaks; ``r`` is its map of text values."""
    allowed = F.array(*[F.lit(k) for k in ("i", "base", "kind", "prep")])
    index = r["i"].try_cast("int")
    return F.array_compact(F.array(
        F.when(F.size(F.array_except(F.map_keys(r), allowed)) > 0, F.lit("unknown_key")),
        F.when(index.isNull() | (index < 0), F.lit("index")),
        F.when(text.tidy_identity(r["base"]).isNull(), F.lit("base")),
        F.when(~F.coalesce(r["kind"].isin(*fixed.FOOD_KINDS), F.lit(False)), F.lit("kind")),
        F.when(r["prep"].isNotNull() & ~r["prep"].isin(*fixed.PREP_TYPES), F.lit("prep")),
    ))


GROUP_REPLY = ("display_name string, emoji string, commonness double, keywords array<string>, "
               "confidence double")
GROUP_KEYS = ("display_name", "emoji", "commonness", "keywords", "confidence")


def group_reply_errors(content: Column, reply: Column) -> Column:
    """Rule names an item's answer breaks; ``reply`` is ``content`` parsed."""
    def within(c: Column) -> Column:
        return F.coalesce(c.between(0.0, 1.0), F.lit(False))

    return F.array_compact(F.array(
        F.when(F.coalesce(F.size(F.json_object_keys(content)), F.lit(0)) <= 0, F.lit("unreadable")),
        F.when(F.size(keys_outside(content, GROUP_KEYS)) > 0, F.lit("unknown_key")),
        F.when(F.coalesce(reply["display_name"], F.lit("")) == "", F.lit("display_name")),
        F.when(~text.is_single_emoji(reply["emoji"]), F.lit("emoji")),
        F.when(~within(reply["commonness"]), F.lit("commonness")),
        F.when(F.coalesce(F.size(text.clean_keywords(reply["keywords"])), F.lit(0)) <= 0,
               F.lit("keywords")),
        F.when(~within(reply["confidence"]), F.lit("confidence")),
    ))


