"""What a grouping looks like and where it is doubtful."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder import fixed
from larder.functions import text
from larder.operators.cluster import Clusters, identified, key_votes
from larder.operators.relational import salted_join


def spelling_splits(foods: DataFrame) -> DataFrame:
    """Identities whose words were written in more than one order."""
    return key_votes(identified(foods)).filter("two_spellings").select("base_key", "n_foods")


def kind_splits(foods: DataFrame) -> DataFrame:
    """Identities of several kinds that the vote left apart."""
    return key_votes(identified(foods)).filter((F.col("n_kinds") > 1) & F.col("two_spellings")).select(
        "base_key", "n_kinds"
    )


def leaked_words(foods: DataFrame) -> DataFrame:
    """Identities that hold a preparation word and, without it, equal another of their kind."""
    known = identified(foods).select("base_key", "kind").distinct()
    ws = F.split("base_key", " ")
    leaks = known.select(
        "base_key", "kind",
        F.explode(F.filter(F.array_distinct(ws), lambda w: w.isin(*fixed.PREP_TYPES))).alias("word"),
    ).withColumn("stripped", text.identity_key(
        F.array_join(F.filter(F.split("base_key", " "), lambda w: w != F.col("word")), " ")))
    target = known.select(F.col("base_key").alias("stripped"), "kind")
    return leaks.join(target, ["stripped", "kind"], "left_semi").select("base_key").distinct()


def unstated_preps(foods: DataFrame, preps: DataFrame, links: DataFrame) -> DataFrame:
    """Labelled preparations holding a food that stated none.

    Links of the unlabelled foods are reduced to their preparations before they
    meet the preparation table.
    """
    silent = foods.filter(F.col("prep_label").isNull()).select("fdc_id")
    held = links.join(silent, "fdc_id", "left_semi").select("prep_id").distinct()
    return preps.filter(F.col("prep_type").isNotNull()).join(held, "prep_id", "left_semi").select(
        "prep_id", "prep_type"
    )


def identity_browser(foods: DataFrame, k: int = 500, members: int = 4) -> DataFrame:
    """Largest identities: a kind, their count and labels, and their first members."""
    keyed = identified(foods)
    heads = keyed.groupBy("base_key").agg(
        F.min("food_kind").alias("food_kind"), F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set("prep_label")), ", ").alias("labels"),
    ).orderBy(F.col("n").desc(), "base_key").limit(k)
    from larder.operators.relational import top_k

    first = top_k(keyed.join(heads.select("base_key"), "base_key", "left_semi"), ["base_key"],
                  [F.length("description"), F.col("fdc_id")], members)
    lists = first.groupBy("base_key").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "description"))), lambda s: s["description"]
    ), " | ").alias("members"))
    return heads.join(lists, "base_key")


def cluster_summary(foods: DataFrame, clusters: Clusters) -> DataFrame:
    """One row of counters over a grouping."""
    base = foods.agg(
        F.count(F.lit(1)).alias("foods"),
        F.count_if(F.col("base_name").isNull()).alias("uncanonicalized"),
        F.count_if(F.col("food_kind") == "dish").alias("dishes"),
    )
    items = clusters.items.agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("n_preps").cast("bigint").alias("preps"),
        F.count_if(F.col("n_foods") > 1).alias("multi_food_items"),
        F.count_if(F.col("n_preps") > 1).alias("multi_prep_items"),
        F.count_if("variable_fat").alias("variable_fat"),
        F.max("n_foods").cast("bigint").alias("largest_item"),
    )
    votes = key_votes(identified(foods)).agg(
        F.count_if((F.col("n_kinds") > 1) & F.col("two_spellings")).alias("kind_splits"),
        F.count_if("two_spellings").alias("spelling_splits"),
    )
    leaks = leaked_words(foods).agg(F.count(F.lit(1)).alias("leaked_words"))
    silent = unstated_preps(foods, clusters.preps, clusters.links).agg(
        F.count(F.lit(1)).alias("unstated_preps"))
    out = base
    for one_row in (items, votes, leaks, silent):
        out = out.crossJoin(F.broadcast(one_row))
    return out


def token_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Words of a corpus by how often they occur; counted before the shuffle."""
    found = F.regexp_extract_all(F.lower(column), F.lit("[a-z/&']+"), F.lit(0))
    return df.select(F.explode(found).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("count")
    )


def members_of(foods: DataFrame, preps: DataFrame, macros: DataFrame) -> DataFrame:
    """Foods of every item beside their macros and macro ratio."""
    from larder.functions.maths import macro_ratio

    heads = preps.select("prep_id", "seq", "prep_type")
    sizes = foods.groupBy("prep_id").agg(F.count(F.lit(1)).alias("n"))
    rows = salted_join(foods, heads, ["prep_id"], sizes, spread_by=["fdc_id"]).join(
        macros.select("fdc_id", *fixed.MERGE_MACROS), "fdc_id", "left")
    ratio = macro_ratio(*[F.col(c) for c in fixed.MERGE_MACROS])
    return rows.select(
        "merged_food_id", "seq", "prep_type", (F.col("fdc_id") == F.col("prep_id")).alias("representative"),
        "fdc_id", "description", *fixed.MERGE_MACROS, *[c.alias(name) for name, c in ratio.items()],
    )
