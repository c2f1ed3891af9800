"""Review queue, human decisions and status reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.operators.changes import Merge, audit_rows, change_row
from larder.operators.relational import differs, indexed, salted_join


def prep_lists(preps: DataFrame) -> DataFrame:
    """Labels of an item in order, joined; at most one per label of a closed list."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "prep_type")))
    return preps.filter(F.col("prep_type").isNotNull()).groupBy("merged_food_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["prep_type"]), ", ").alias("preps")
    )


def review_queue(items: DataFrame, preps: DataFrame, foods: DataFrame, k: int = 500) -> DataFrame:
    """Least certain first; the cut happens before anything is joined on."""
    head = items.filter(
        (F.col("review_status") == "needs_review") & ~F.coalesce("human_verified", F.lit(False))
    ).orderBy(F.col("confidence").asc_nulls_first(), "merged_food_id").limit(k)
    described = foods.select(F.col("fdc_id").alias("merged_food_id"), "description")
    return (
        head.select("merged_food_id", "food_category", "display_name", "emoji", "keywords", "n_foods",
                    "n_preps", "variable_fat", "brand_flagged", "confidence")
        .join(prep_lists(preps), "merged_food_id", "left")
        .join(described, "merged_food_id", "left")
    )


def apply_review(items: DataFrame, decisions: DataFrame, run_id: str = "run") -> Merge:
    """Accept or reject; either way the item is locked. Edits count only on acceptance.

    ``decisions`` holds (merged_food_id, accept, display_name, emoji, keywords).
    """
    edits = ("display_name", "emoji", "keywords")
    verdict = decisions.select("merged_food_id", F.struct("accept", *edits).alias("d"))
    joined = items.join(verdict, "merged_food_id", "left")
    decided, accepted = F.col("d").isNotNull(), F.coalesce(F.col("d.accept"), F.lit(False))
    new = {c: F.when(accepted, F.coalesce(F.nullif(F.col(f"d.{c}"), F.lit("")), F.col(c))).otherwise(F.col(c))
           for c in edits}
    new["review_status"] = F.when(accepted, F.lit("verified")).when(decided, F.lit("rejected")).otherwise(
        F.col("review_status"))
    new["human_verified"] = F.when(decided, F.lit(True)).otherwise(F.coalesce("human_verified", F.lit(False)))
    rows = [change_row(c, F.col(c), value, decided & differs(F.col(c), value), "human",
                       F.col("source_version")) for c, value in new.items()]
    snapshot = joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in items.columns])
    return Merge(snapshot, audit_rows(joined, "merged_food_id", rows, run_id),
                 joined.agg(F.count_if(decided).alias("decided")))


def status_summary(items: DataFrame, foods: DataFrame) -> DataFrame:
    kinds = foods.select(F.col("fdc_id").alias("merged_food_id"), "data_type")
    return items.join(kinds, "merged_food_id", "left").groupBy("data_type", "review_status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("brand_flagged").alias("brand_flagged"),
        F.sum("n_foods").cast("bigint").alias("foods"),
    )


def duplicate_names(items: DataFrame) -> DataFrame:
    """(display_name, n, merged_food_id): one row per item whose name others carry too.

    Rows rather than a joined list, so a name on very many items stays spread out.
    """
    named = items.filter(F.col("display_name").isNotNull()).select("display_name", "merged_food_id")
    sizes = named.groupBy("display_name").agg(F.count(F.lit(1)).alias("n"))
    repeated = sizes.filter(F.col("n") > 1)
    return salted_join(named, repeated, ["display_name"], sizes).select(
        "display_name", "n", "merged_food_id")


def cluster_items(items: DataFrame, preps: DataFrame, min_size: int = 2, k: int | None = None) -> DataFrame:
    """Items by size, ``place`` counting from 0, with their preparation labels; all unless ``k`` is given."""
    rows = items.filter(F.col("n_foods") >= min_size)
    order = [F.col("n_foods").desc(), F.col("merged_food_id")]
    if k is not None:
        rows = rows.orderBy(*order).limit(k)
    return indexed(rows, order, "place").join(prep_lists(preps), "merged_food_id", "left").select(
        "place",
        "merged_food_id", "emoji", "display_name", "n_foods", "n_preps", "variable_fat",
        "food_category", "review_status", "confidence", "preps",
    )
