"""Successive replies about one meal, as a plate.

What is kept per item does not depend on the order rows arrive in: the first place, the
latest reading, every shot, and whether a person changed or removed it. So micro-batches
are reduced to parts and the parts merged by the reader (``plate_parts``, ``merged_parts``,
``plate_of``). Parts are keyed by session and item rather than by session, so a very busy
session is spread over tasks. An empty reply brings no rows and so leaves nothing.

Plates that end (``drain_expiring``, ``expiring_plates``) are cut by event time: an item of
a session that stays silent for the idle time ends, and what comes after starts a new
plate. The watermark is the greatest time of the batches before, less a delay, and is kept
in the store's manifest: it outlives restarts, and a batch that is run again meets the same
one. A reply from before the watermark may belong to a plate that was already handed out;
it goes to a side table instead. All of it is built-in expressions.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from larder.streaming.segments import BATCH, Store
from larder.streaming.sinks import drain

def running_plate(events: DataFrame) -> DataFrame:
    """Plate rows, emitted again whenever they change (update mode).

    The same as ``plate_of(plate_parts(events))`` with the state in memory, for as long
    as the query runs. A row marked removed is to be taken off the plate.
    """
    return plate_of(plate_parts(events))


def plate_parts(events: DataFrame) -> DataFrame:
    """What a micro-batch says of each item.

    ``events``: session, instance_id, kind (detected, edited, removed), seq, name,
    grams, shot. The shots of an item are a set, as large as it has shots.
    """
    detected, edited = F.col("kind") == "detected", F.col("kind") == "edited"
    said = F.max(F.when(detected, F.struct("seq", "name", "grams")))
    by_hand = F.max(F.when(edited, F.struct("seq", "grams")))
    return events.groupBy("session", "instance_id").agg(
        F.min(F.when(detected, F.col("seq"))).alias("first_seen"), said.alias("said"), by_hand.alias("by_hand"),
        F.collect_set(F.when(detected, F.col("shot").cast("int"))).alias("shots"),
        F.bool_or(F.col("kind") == "removed").alias("removed"))


def merged_parts(parts: DataFrame) -> DataFrame:
    """Parts of several micro-batches as one per item."""
    return parts.groupBy("session", "instance_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("said").alias("said"), F.max("by_hand").alias("by_hand"),
        F.array_distinct(F.flatten(F.collect_set("shots"))).alias("shots"), F.bool_or("removed").alias("removed"),
        *([F.max(BATCH).alias(BATCH)] if BATCH in parts.columns else []))


def plate_of(parts: DataFrame) -> DataFrame:
    """Plate rows from one part per item; an item that was never detected is not on it."""
    return _shown(parts)


def _shown(parts: DataFrame, *more: Column | str) -> DataFrame:
    return parts.filter(F.col("first_seen").isNotNull()).select(
        "session", "instance_id", "first_seen", F.col("said.seq").alias("last_seen"), F.col("said.name").alias("name"),
        F.coalesce("by_hand.grams", "said.grams").alias("grams"),
        F.array_join(F.transform(F.array_sort("shots"), lambda s: s.cast("string")), ",").alias("shots"),
        F.col("by_hand").isNotNull().alias("edited"), "removed", *more)


def reply_rows(replies: DataFrame) -> DataFrame:
    """One row per item that a reply names; an empty or unreadable reply gives none.

    ``replies``: session, seq, shot, ts, reply (a list of objects with id, name and grams).
    """
    items = F.from_json("reply", "array<struct<id:string,name:string,grams:double>>")
    return replies.select("session", "seq", "shot", "ts", F.explode(items).alias("i")).filter(
        F.col("i.id").isNotNull()).select(
        "session", F.col("i.id").alias("instance_id"), F.lit("detected").alias("kind"), "seq",
        F.col("i.name").alias("name"), F.col("i.grams").alias("grams"), "shot", "ts")


_MERGED = {
    "first_seen": F.min, "said": F.max, "by_hand": F.max, "removed": F.bool_or, "first_ts": F.min, "last_ts": F.max,
}


def _seconds(interval: timedelta) -> float:
    return interval.total_seconds()


def timed_parts(events: DataFrame, idle: timedelta) -> DataFrame:
    """As ``plate_parts``, for each stretch of an item without a silence of ``idle``."""
    detected, edited = F.col("kind") == "detected", F.col("kind") == "edited"
    window = F.session_window("ts", f"{_seconds(idle)} seconds")
    return events.groupBy("session", "instance_id", window).agg(
        F.min(F.when(detected, F.col("seq"))).alias("first_seen"),
        F.max(F.when(detected, F.struct("seq", "name", "grams"))).alias("said"),
        F.max(F.when(edited, F.struct("seq", "grams"))).alias("by_hand"),
        F.collect_set(F.when(detected, F.col("shot").cast("int"))).alias("shots"),
        F.bool_or(F.col("kind") == "removed").alias("removed"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("session_window")


def merged_timed(parts: DataFrame, idle: timedelta) -> DataFrame:
    """Stretches of several micro-batches: those that touch within ``idle`` become one."""
    lasted = F.unix_micros("last_ts") - F.unix_micros("first_ts")
    gap = F.make_interval(secs=(lasted / 1e6 + _seconds(idle)).cast("decimal(18,6)"))
    return parts.groupBy("session", "instance_id", F.session_window("first_ts", gap)).agg(
        *[how(c).alias(c) for c, how in _MERGED.items()],
        F.array_distinct(F.flatten(F.collect_set("shots"))).alias("shots"), F.max(BATCH).alias(BATCH),
    ).drop("session_window").select(*[c for c in parts.columns])


def drain_expiring(events: DataFrame, path: str, idle: timedelta, delay: timedelta, fanout: int = 8) -> None:
    """Drain replies (the columns of ``plate_parts`` and ts) into plates that end, and a side table of late ones."""
    spark = events.sparkSession
    plates, late = Store(spark, f"{path}/plates", fanout), Store(spark, f"{path}/late", fanout)

    def each(rows: DataFrame, batch: int) -> None:
        mark = watermark(plates, delay)
        on_time = F.lit(True) if mark is None else F.col("ts") >= F.lit(mark)
        late.add(rows.filter(~on_time), batch)
        newest = rows.agg(F.max("ts")).first()[0]
        seen = plates.manifest().notes.get("newest")
        notes = {"newest": max(filter(None, (seen, newest and newest.isoformat())), default=None)}
        plates.add(timed_parts(rows.filter(on_time), idle), batch, lambda parts: merged_timed(parts, idle), notes)

    drain(events, each, f"{path}/checkpoint")


def watermark(plates: Store, delay: timedelta) -> datetime | None:
    """The time that no later batch goes back behind; None before the first batch."""
    newest = plates.manifest().notes.get("newest")
    return datetime.fromisoformat(newest) - delay if newest else None


def late_replies(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return Store(spark, f"{path}/late").rows(schema)


def expiring_plates(spark: SparkSession, path: str, schema: StructType, idle: timedelta, delay: timedelta) -> DataFrame:
    """Plate rows with first_ts, last_ts and ended: nothing that is still to come can join an ended one.

    ``schema`` is that of ``timed_parts``.
    """
    store = Store(spark, f"{path}/plates")
    parts = merged_timed(store.rows(schema), idle)
    mark = watermark(store, delay)
    ended = F.lit(False) if mark is None else F.col("last_ts") + F.make_interval(
        secs=F.lit(_seconds(idle)).cast("decimal(18,6)")) <= F.lit(mark)
    return _shown(parts, "first_ts", "last_ts", ended.alias("ended"))
