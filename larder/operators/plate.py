"""Detections of one meal across several photos: cleaned, matched, merged into a plate.

Order matters here and is carried in an explicit ``pos`` column; nothing relies on
the order rows arrive in. ``session`` names one meal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larder import fixed
from larder.functions import maths, structured, text
from larder.operators.relational import without
from larder.session import materialise

SCALARS = ("name", "search_term", "emoji", "grams", "confidence", "kcal_100g", "protein_100g",
           "carb_100g", "fat_100g")


def cleaned(detections: DataFrame) -> DataFrame:
    """Usable rows only, with ids, numbers and shots brought into range.

    Input: session, pos, shot_count and the detection columns.
    """
    name = F.regexp_replace("name", r"^\s+|\s+$", "")
    return detections.select(
        "session", "pos", text.slug(F.col("instance_id")).alias("instance_id"), name.alias("name"),
        text.term_or_name(F.col("search_term"), name).alias("search_term"),
        text.leading_emoji(F.col("emoji")).alias("emoji"),
        maths.reported_grams(F.col("grams")).alias("grams"),
        maths.unit_interval(F.col("confidence")).alias("confidence"),
        *[maths.not_negative(F.col(c)).alias(c) for c in SCALARS[5:]],
        structured.usable_shots(F.col("shots"), F.col("shot_count")).alias("shots"),
    ).filter((F.col("instance_id") != "") & (F.col("name") != ""))


def aliased(detections: DataFrame, staged: DataFrame) -> DataFrame:
    """A new id that names a food already on the plate takes that food's id.

    Not when the reply used that id itself: then there are two items. Of several
    such rows only the first takes it. ``staged``: session, pos, instance_id, name.
    """
    plate = staged.select("session", "pos", text.slug(F.col("instance_id")).alias("staged_id"),
                          text.name_key(F.col("name")).alias("key")).filter(F.col("staged_id") != "")
    by_name = plate.filter(F.col("key") != "").groupBy("session", "key").agg(
        F.min_by("staged_id", "pos").alias("target"))
    known = plate.select("session", F.col("staged_id").alias("instance_id")).distinct()
    returned = detections.select("session", F.col("instance_id").alias("target")).distinct()
    fresh = without(detections, known, ["session", "instance_id"]).withColumn("key", text.name_key(F.col("name")))
    options = without(
        fresh.join(by_name, ["session", "key"]).select("session", "pos", "target"),
        returned, ["session", "target"])
    takers = options.groupBy("session", "target").agg(F.min("pos").alias("pos"))
    return detections.join(takers, ["session", "pos"], "left").withColumn(
        "instance_id", F.coalesce("target", "instance_id")).drop("target")


def collapsed(detections: DataFrame) -> DataFrame:
    """One row per id: the surest reading, the shots of all of them, the first place.

    There are few distinct shot lists, so gathering those is bounded however often
    an id repeats.
    """
    best = F.max_by(F.struct(*SCALARS), F.struct(F.col("confidence"), -F.col("pos")))
    return detections.groupBy("session", "instance_id").agg(
        F.min("pos").alias("pos"), best.alias("b"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("shots")))).alias("shots"),
    ).select("session", "pos", "instance_id", "b.*", "shots")


def normalise_detections(detections: DataFrame, staged: DataFrame, hold=materialise) -> DataFrame:
    """Cleaned, aliased to the plate, and collapsed to one row per item.

    The cleaned rows are stored, since finding aliases reads them several times.
    """
    return collapsed(aliased(hold(cleaned(detections), "cleaned"), staged))


def readable_replies(replies: DataFrame, usable: DataFrame, key: str) -> DataFrame:
    """Adds ``ok``: a list was given, and if it was not empty something in it was usable."""
    some = usable.select(key).distinct().withColumn("_some", F.lit(True))
    return replies.join(some, key, "left").withColumn(
        "ok", F.col("readable") & ((F.size("items") == 0) | F.coalesce("_some", F.lit(False)))).drop("_some")


def multi_shot_count(detections: DataFrame) -> DataFrame:
    return detections.groupBy("session").agg(
        F.count_if(F.size("shots") > 1).alias("across_shots"), F.count(F.lit(1)).alias("items"))


def best_match(wanted: DataFrame, candidates: DataFrame, key: str,
               threshold: float = fixed.MATCH_THRESHOLD) -> DataFrame:
    """The candidate whose name is most alike, if enough; ties keep the better ranked.

    ``wanted``: key, name. ``candidates``: key, rn, name and facts.
    """
    facts = [c for c in candidates.columns if c != key]
    pairs = candidates.withColumnRenamed("name", "found").join(
        wanted.select(key, F.col("name").alias("_wanted")), key)
    score = text.dice(text.name_tokens(F.col("_wanted")), text.name_tokens(F.col("found")))
    scored = pairs.withColumn("similarity", score).filter(F.col("similarity") >= threshold)
    names = ["found" if c == "name" else c for c in facts]
    return scored.groupBy(key).agg(F.max_by(
        F.struct("similarity", *names), F.struct(F.col("similarity"), -F.col("rn"))).alias("m")).select(key, "m.*")


def resolve(detections: DataFrame, matches: DataFrame) -> DataFrame:
    """Sure and named detections as stageable foods: the matched food, else a generated one.

    ``matches``: session, instance_id, food_id, found, serving_g and the list macros.
    """
    rows = detections.filter(
        (F.col("confidence") >= fixed.CONFIDENCE_FLOOR) & (F.trim("name") != "")
    ).join(matches.select("session", "instance_id", "food_id", F.col("found"), "serving_g",
                          *[F.col(f"{c}_100g").alias(f"m_{c}") for c in ("kcal", "protein", "carb", "fat")]),
           ["session", "instance_id"], "left")
    hit = F.col("food_id").isNotNull()
    return rows.select(
        "session", "pos", "instance_id", "food_id",
        F.when(hit, F.col("found")).otherwise(F.trim("name")).alias("name"),
        F.when(~hit, text.blank_to_null(F.col("emoji"))).alias("emoji"),
        *[F.when(hit, F.col(f"m_{c}")).otherwise(maths.not_negative(F.col(f"{c}_100g"))).alias(f"{c}_100g")
          for c in ("kcal", "protein", "carb", "fat")],
        F.when(hit, F.col("serving_g")).alias("serving_g"),
        maths.loggable_grams(F.col("grams"), F.when(hit, F.col("serving_g"))).alias("grams"),
        structured.sorted_set(F.col("shots")).alias("shots"),
    )


FOOD = ("food_id", "name", "emoji", "kcal_100g", "protein_100g", "carb_100g", "fat_100g", "serving_g")


def merge_plate(batch: DataFrame, candidates: DataFrame, edited: DataFrame, removed: DataFrame) -> DataFrame:
    """The plate after one reply.

    Rows not from a detector pass through; a known id is rewritten where it stands,
    keeping a weight set by hand; a new one is appended; what a person removed stays
    removed. An empty reply changes nothing. ``place`` orders the result.

    ``batch``: session, pos, instance_id (NULL for typed rows), food columns, grams,
    shots. ``edited`` and ``removed``: session, instance_id.
    """
    keys = ["session", "instance_id"]
    wanted = without(candidates, removed, keys)
    newest = wanted.groupBy(*keys).agg(F.max_by(
        F.struct(*FOOD, "grams", "shots", F.col("pos")), "pos").alias("c"))
    hand_set = edited.select(*keys).distinct().withColumn("_edited", F.lit(True))
    hit = F.col("c").isNotNull()

    def after(name: str) -> Column:
        return F.when(hit, F.col(f"c.{name}")).otherwise(F.col(name)).alias(name)

    kept = batch.join(newest, keys, "left").join(hand_set, keys, "left").select(
        "session", F.lit(0).alias("part"), F.col("pos").cast("bigint").alias("pos"), "instance_id",
        *[after(c) for c in FOOD],
        F.when(hit & ~F.coalesce("_edited", F.lit(False)), F.col("c.grams")).otherwise(F.col("grams")).alias("grams"),
        F.when(hit, structured.union_shots(F.col("shots"), F.col("c.shots"))).otherwise(F.col("shots")).alias("shots"))
    added = without(newest, batch.filter(F.col("instance_id").isNotNull()), keys).select(
        "session", F.lit(1).alias("part"), F.col("c.pos").cast("bigint").alias("pos"), "instance_id",
        *[F.col(f"c.{c}").alias(c) for c in FOOD], "c.grams", "c.shots")
    return kept.unionByName(added).withColumn("place", F.struct("part", "pos")).drop("part", "pos")


def plate_summaries(batch: DataFrame) -> DataFrame:
    """The staged plate of each session as one JSON text, detector rows only."""
    rows = batch.filter(F.col("instance_id").isNotNull())
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "instance_id", "name", "grams"))),
                         lambda r: F.struct(r["instance_id"].alias("instance_id"), r["name"].alias("name"),
                                            r["grams"].alias("grams")))
    return rows.groupBy("session").agg(structured.plate_payload(listed).alias("payload"))
