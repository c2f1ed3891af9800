"""Snapshot merges: what is new, what changed, what vanished, with an audit row per field.

Tables are immutable snapshots: a merge reads the current one and the incoming rows
and gives the next one. Both sides are unique by key, so one full join on the key
serves every output; ``hold`` (say, ``materialise``) keeps it from being run again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from larder.operators.relational import differs, without

Hold = Callable[[DataFrame], DataFrame]
STAMP = "updated_at"


def same(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Merge:
    snapshot: DataFrame
    audit: DataFrame
    counts: DataFrame


def both_sides(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Full join on the key: (key, old struct, new struct), NULL struct where absent."""
    old = current.select(key, F.struct(*[c for c in current.columns if c != key]).alias("old"))
    new = incoming.select(key, F.struct(*[c for c in incoming.columns if c != key]).alias("new"))
    return old.join(new, key, "full_outer")


def change_row(field: str, old: Column, new: Column, when: Column, actor: str | Column,
               version: Column) -> Column:
    who = F.lit(actor) if isinstance(actor, str) else actor
    return F.when(when, F.struct(
        F.lit(field).alias("field"), old.cast("string").alias("old_value"),
        new.cast("string").alias("new_value"), who.alias("actor"),
        version.cast("string").alias("source_version"),
    ))


def audit_rows(df: DataFrame, key: str, changes: Sequence[Column], run_id: str) -> DataFrame:
    """One row per change that happened; ``changes`` are nullable structs."""
    return df.select(F.col(key).alias("fdc_id"), F.inline(F.array_compact(F.array(*changes)))).select(
        "fdc_id", "field", "old_value", "new_value", "actor", "source_version",
        F.lit(run_id).alias("run_id"), F.current_timestamp().alias("timestamp"),
    )


def stamp_at(name: str, when: Column, old: Column) -> Column:
    """The time of the last change of a row."""
    return F.when(when, F.current_timestamp()).otherwise(old).alias(name)


def upsert(current: DataFrame, incoming: DataFrame, key: str, tracked: Sequence[str],
           carried: Sequence[str] = (), version: str | None = None, run_id: str = "run",
           hold: Hold = same) -> Merge:
    """Insert new keys, update changed ones, leave the rest alone.

    Only ``tracked`` fields decide whether a row changed; ``carried`` ones come
    along when it did. Columns the incoming rows lack keep their current value.
    """
    merged = hold(both_sides(current, incoming, key))
    is_new, in_both = F.col("old").isNull(), F.col("old").isNotNull() & F.col("new").isNotNull()
    changed = in_both & F.exists(
        F.array(*[differs(F.col(f"old.{c}"), F.col(f"new.{c}")) for c in tracked]), lambda x: x
    )
    updated = [*tracked, *carried]

    def value(c: str) -> Column:
        mine = F.col(f"old.{c}")
        if c == STAMP:
            return stamp_at(c, is_new | changed, mine)
        if c in updated:
            return F.when(is_new | changed, F.col(f"new.{c}")).otherwise(mine).alias(c)
        if c in incoming.columns:
            return F.when(is_new, F.col(f"new.{c}")).otherwise(mine).alias(c)
        return mine.alias(c)

    snapshot = merged.select(key, *[value(c) for c in current.columns if c != key])
    stamp = F.col(f"new.{version}") if version else F.lit(None)
    rows = [
        change_row(c, F.col(f"old.{c}"), F.col(f"new.{c}"),
                   in_both & differs(F.col(f"old.{c}"), F.col(f"new.{c}")), "auto", stamp)
        for c in tracked
    ]
    rows.append(change_row("ingest", F.lit(None), F.col(f"new.{tracked[0]}"), is_new, "auto", stamp))
    counts = merged.agg(
        F.count_if(is_new).alias("inserted"), F.count_if(changed).alias("updated"),
        F.count_if(F.col("new").isNull()).alias("untouched"),
    )
    return Merge(snapshot, audit_rows(merged, key, rows, run_id), counts)


def apply_fields(current: DataFrame, values: DataFrame, key: str, fields: Sequence[str],
                 version: str = "source_version", run_id: str = "run", actor: str = "auto",
                 unless: str | None = None, hold: Hold = same) -> Merge:
    """Overwrite fields of known keys and log each difference; unknown keys are ignored.

    Rows where the boolean column ``unless`` holds are locked.
    """
    new = values.select(key, F.struct(*fields).alias("new"))
    joined = hold(current.join(new, key, "left"))
    locked = F.coalesce(F.col(unless), F.lit(False)) if unless else F.lit(False)
    live = F.col("new").isNotNull() & ~locked
    any_change = F.exists(F.array(*[differs(F.col(c), F.col(f"new.{c}")) for c in fields]), lambda x: x)
    snapshot = joined.select(*[
        F.when(live, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in fields
        else stamp_at(c, live & any_change, F.col(c)) if c == STAMP else F.col(c)
        for c in current.columns
    ])
    rows = [change_row(c, F.col(c), F.col(f"new.{c}"), live & differs(F.col(c), F.col(f"new.{c}")),
                       actor, F.col(version)) for c in fields]
    counts = joined.agg(
        F.count_if(live & any_change).alias("updated"),
        F.count_if(F.col("new").isNotNull() & locked).alias("skipped_locked"),
    )
    return Merge(snapshot, audit_rows(joined, key, rows, run_id), counts)


def rewrite(df: DataFrame, key: str, values: dict[str, Column], version: str = "source_version",
            run_id: str = "run", actor: str = "auto", hold: Hold = same) -> Merge:
    """Recompute fields of every row from the row itself, logging each difference; no join."""
    beside = hold(df.select("*", *[v.cast(df.schema[c].dataType).alias(f"_new_{c}") for c, v in values.items()]))
    changed = {c: differs(F.col(c), F.col(f"_new_{c}")) for c in values}
    any_change = F.exists(F.array(*changed.values()), lambda x: x)
    snapshot = beside.select(*[
        F.col(f"_new_{c}").alias(c) if c in values else stamp_at(c, any_change, F.col(c)) if c == STAMP else F.col(c)
        for c in df.columns])
    rows = [change_row(c, F.col(c), F.col(f"_new_{c}"), changed[c], actor, F.col(version)) for c in values]
    return Merge(snapshot, audit_rows(beside, key, rows, run_id),
                 beside.agg(F.count_if(any_change).alias("updated")))


def replace_children(current: DataFrame, incoming: DataFrame, parents: DataFrame,
                     key: str) -> DataFrame:
    """Swap the child rows of every parent given, including parents left without any."""
    return without(current, parents.select(key).distinct(), key).unionByName(
        incoming.join(parents.select(key).distinct(), key, "left_semi").select(*current.columns)
    )


def known_only(log: DataFrame, foods: DataFrame, key: str = "fdc_id") -> DataFrame:
    """Clean-up log rows of foods that exist."""
    return log.join(foods.select(key), key, "left_semi")


def merge_clusters(current: DataFrame, items: DataFrame, run_id: str = "run",
                   hold: Hold = same) -> Merge:
    """Bring the item table in line with a new grouping, keeping names and human work.

    Same members: untouched. Other members: facts refreshed and queued again, names
    kept. Gone: dropped, or kept and marked dissolved when a person verified it.
    """
    key, facts = "merged_food_id", ["member_key", "n_foods", "n_preps", "food_category",
                                    "variable_fat", "brand_flagged"]
    merged = hold(both_sides(current, items, key))
    old, new = F.col("old"), F.col("new")
    created, gone = old.isNull(), new.isNull()
    verified = F.coalesce(F.col("old.human_verified"), F.lit(False))
    moved = ~created & ~gone & ~verified & differs(F.col("old.member_key"), F.col("new.member_key"))
    refresh = created | (~gone & ~verified)

    def value(c: str) -> Column:
        mine = F.col(f"old.{c}")
        if c in facts:
            return F.when(refresh, F.col(f"new.{c}")).otherwise(mine).alias(c)
        if c == "source_version":
            theirs = F.col("new.source_version") if c in items.columns else F.lit(None)
            return F.when(refresh, F.coalesce(theirs, mine)).otherwise(mine).alias(c)
        if c == STAMP:
            return stamp_at(c, created | moved, mine)
        if c == "review_status":
            return F.when(created | moved, F.lit("pending")).otherwise(mine).alias(c)
        if c == "human_verified":
            return verified.alias(c)
        if c == "dissolved":
            return gone.alias(c)
        return mine.alias(c)

    snapshot = merged.filter(~gone | verified).select(
        key, *[value(c) for c in current.columns if c != key]
    )
    actor = F.when(verified, F.lit("human")).otherwise(F.lit("auto"))
    version = F.col("old.source_version")
    rows = [
        change_row("group_dissolved", F.col("old.display_name"), F.lit(None),
                   gone & ~F.coalesce(F.col("old.dissolved"), F.lit(False)), actor, version),
        change_row("member_key", F.col("old.member_key"), F.col("new.member_key"), moved, "auto", version),
        change_row("group_created", F.lit(None), F.col("new.member_key"), created, "auto", F.lit(None)),
    ]
    counts = merged.agg(
        F.count_if(created).alias("created"), F.count_if(moved).alias("requeued"),
        F.count_if(gone).alias("dissolved"),
    )
    return Merge(snapshot, audit_rows(merged, key, rows, run_id), counts)


def relink(foods: DataFrame, links: DataFrame, hold: Hold = same) -> tuple[DataFrame, DataFrame]:
    """Foods pointed at their new item and preparation, and how many moved."""
    new = links.select("fdc_id", F.col("merged_food_id").alias("_item"), F.col("prep_id").alias("_prep"))
    joined = hold(foods.join(new, "fdc_id", "left"))
    moved = F.col("_item").isNotNull() & (
        differs(F.col("merged_food_id"), F.col("_item")) | differs(F.col("prep_id"), F.col("_prep"))
    )
    out = joined.withColumns({
        "merged_food_id": F.coalesce("_item", "merged_food_id"),
        "prep_id": F.coalesce("_prep", "prep_id"),
    }).drop("_item", "_prep")
    counts = joined.agg(F.count_if(moved).alias("relinked"),
                        F.count(F.coalesce("_item", "merged_food_id")).alias("linked"))
    return out, counts


# --- rows that two sides may both edit ---------------------------------------
def latest_state(changes: DataFrame, key: str, stamp: Sequence[str]) -> DataFrame:
    """Current row per key of an append-only change table.

    A running maximum, so a key edited very often costs one row per task.
    """
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*stamp)).alias("_last")).select(
        key, *[F.col(f"_last.{c}").alias(c) for c in rest]
    ).select(*changes.columns)


def pull(local: DataFrame, remote: DataFrame, key: str = "id", stamp: str = "updated_at") -> DataFrame:
    """Newest version of every row wins; on equal stamps the local one stays."""
    both = local.withColumn("_local", F.lit(1)).unionByName(remote.withColumn("_local", F.lit(0)))
    return latest_state(both, key, [stamp, "_local"]).drop("_local")


def push_queue(local: DataFrame) -> DataFrame:
    return local.filter(F.col("dirty") == 1)


def acknowledge(local: DataFrame, pushed: DataFrame, key: str = "id",
                stamp: str = "updated_at") -> DataFrame:
    """Clear the dirty flag where exactly that version was pushed."""
    done = pushed.select(key, stamp).distinct().withColumn("_done", F.lit(True))
    return local.join(done, [key, stamp], "left").withColumn(
        "dirty", F.when(F.col("_done"), F.lit(0)).otherwise(F.col("dirty"))
    ).drop("_done").select(*local.columns)


def touched(current: DataFrame, edits: DataFrame, now: Column, key: str = "id",
            stamp: str = "updated_at") -> DataFrame:
    """Apply edits; one that kept its stamp is stamped now and marked to push."""
    old = current.select(key, F.col(stamp).alias("_old"))
    kept_stamp = F.col("_old").isNotNull() & (F.col(stamp) == F.col("_old"))
    stamped = edits.join(old, key, "left").withColumns({
        "dirty": F.when(kept_stamp, F.lit(1)).otherwise(F.col("dirty")),
        stamp: F.when(kept_stamp, now).otherwise(F.col(stamp)),
    }).drop("_old").select(*current.columns)
    return without(current, edits, key).unionByName(stamped)


def deletions(entries: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Change rows that hide entries; nothing is removed."""
    return entries.join(ids.select("id"), "id", "left_semi").withColumns(
        {"deleted": F.lit(1), "dirty": F.lit(1), "updated_at": now}
    )


def gram_edits(entries: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """Change rows with a new weight and everything else as it was."""
    new = edits.select("id", F.col("grams").alias("_grams"))
    return entries.join(new, "id").withColumns(
        {"grams": F.col("_grams"), "dirty": F.lit(1), "updated_at": now}
    ).select(*entries.columns)
