"""Requests to a scorer, its answers, and what is written back from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from larder import fixed
from larder.functions import labels, structured, text
from larder.operators.changes import Hold, Merge, apply_fields, audit_rows, change_row, same
from larder.operators.relational import indexed, joined_set, shuffled, top_k
from larder.session import materialise

Scorer = Callable[[pd.Series], pd.Series]

CANON_PENDING = "base_name IS NULL"
ENRICH_PENDING = ("NOT coalesce(human_verified, false) AND (display_name IS NULL "
                  "OR emoji IS NULL OR review_status = 'pending')")


# --- candidates ----------------------------------------------------------------
def synonyms(attributes: DataFrame, key: str, where: DataFrame | None = None) -> DataFrame:
    """Common names and extra descriptions per food, or per item through ``where``.

    Reduced to distinct values before they are gathered, so a much-repeated synonym
    costs one row.
    """
    rows = attributes.filter(F.col("attribute_type").isin(*fixed.SYNONYM_TYPES)
                             & (F.coalesce("value", F.lit("")) != ""))
    if where is not None:
        rows = rows.join(shuffled(where), "fdc_id")
    distinct = rows.select(key, "attribute_type", "value").distinct()
    return distinct.groupBy(key).agg(
        joined_set(F.col("value"), F.col("attribute_type") == "Common Name").alias("common_name"),
        joined_set(F.col("value"), F.col("attribute_type") == "Additional Description").alias("extra_desc"),
    )


def first_ingredients(input_foods: DataFrame, k: int = fixed.MAX_INPUT_FOODS) -> DataFrame:
    rows = input_foods.filter(F.coalesce("ingredient_description", F.lit("")) != "")
    first = top_k(rows, ["fdc_id"], [F.col("seq_num").asc_nulls_last(), F.col("ingredient_description")], k)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rn", "ingredient_description"))),
                          lambda s: s["ingredient_description"])
    return first.groupBy("fdc_id").agg(F.array_join(ordered, " | ").alias("ingredients"))


def sibling_order() -> list[Column]:
    """Descriptions that start alike stand together."""
    return [F.lower(F.split_part("description", F.lit(","), F.lit(1))), F.lower("description"), F.col("fdc_id")]


def canon_candidates(foods: DataFrame, attributes: DataFrame, input_foods: DataFrame,
                     limit: int | None = None, where: str = CANON_PENDING) -> DataFrame:
    """Foods without an identity, with their synonyms and first ingredients."""
    rows = (
        foods.filter(where).select("fdc_id", "description", "food_category")
        .join(synonyms(attributes, "fdc_id"), "fdc_id", "left")
        .join(first_ingredients(input_foods), "fdc_id", "left")
    )
    return rows.orderBy(*sibling_order()).limit(limit) if limit is not None else rows


def first_descriptions(foods: DataFrame, key: str = "prep_id",
                       k: int = fixed.MAX_GROUP_DESCRIPTIONS) -> DataFrame:
    """The k shortest descriptions of each preparation."""
    first = top_k(foods.select(key, "fdc_id", "description"), [key],
                  [F.length("description"), F.col("fdc_id")], k)
    return first.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "description"))), lambda s: s["description"]
    ).alias("descs"))


def enrich_candidates(items: DataFrame, preps: DataFrame, foods: DataFrame, attributes: DataFrame,
                      limit: int | None = None, where: str = ENRICH_PENDING) -> DataFrame:
    """Items still to be named, with their preparations nested in order."""
    nested = preps.join(shuffled(first_descriptions(foods)), "prep_id").groupBy("merged_food_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "seq", "prep_id", "prep_type", *fixed.MERGE_MACROS, "descs"))).alias("preps")
    )
    names = synonyms(attributes, "merged_food_id",
                     foods.filter(F.col("merged_food_id").isNotNull()).select("fdc_id", "merged_food_id"))
    identity = foods.select(F.col("fdc_id").alias("merged_food_id"), "base_name", "food_kind")
    rows = (
        items.filter(where)
        .select("merged_food_id", "food_category", "brand_flagged", "variable_fat", "source_version")
        .join(shuffled(nested), "merged_food_id").join(shuffled(names), "merged_food_id", "left")
        .join(shuffled(identity), "merged_food_id", "left")
    )
    return rows.orderBy(*enrich_order()).limit(limit) if limit is not None else rows


def enrich_order() -> list[Column]:
    """Brands last, then by id: the order items are asked in."""
    return [F.col("brand_flagged"), F.col("merged_food_id")]


# --- batches --------------------------------------------------------------------
def to_batches(df: DataFrame, order: list[Column], size: int = fixed.CANON_BATCH_SIZE) -> DataFrame:
    """Adds (batch, i): rows in total order, cut into runs of ``size``."""
    return indexed(df, order, "_idx").withColumns({
        "batch": F.floor(F.col("_idx") / size),
        "i": F.pmod(F.col("_idx"), F.lit(size)).cast("int"),
    }).drop("_idx")


def canon_requests(batched: DataFrame) -> DataFrame:
    """(batch, n, payload): at most ``size`` foods to a payload."""
    food = structured.canon_food(*[F.col(c) for c in
                                   ("i", "description", "food_category", "common_name", "extra_desc", "ingredients")])
    return batched.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(food)).alias("foods")
    ).select("batch", "n", structured.canon_payload(F.col("foods")).alias("payload"))


def enrich_requests(candidates: DataFrame) -> DataFrame:
    return candidates.select("merged_food_id", structured.enrich_payload(
        *[F.col(c) for c in ("base_name", "food_kind", "food_category", "common_name", "extra_desc", "preps")]
    ).alias("payload"))


# --- the scorer -------------------------------------------------------------------
def ask(requests: DataFrame, scorer: Scorer, key: str) -> DataFrame:
    """Run the scorer over payloads in Arrow batches: (key, content)."""
    kind = requests.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "content": scorer(frame["payload"])})

    return requests.select(key, "payload").mapInPandas(run, f"{key} {kind}, content string")


def score(requests: DataFrame, scorer: Scorer, key: str, accepts: Callable[[DataFrame], DataFrame],
          attempts: int = 2, hold: Hold | None = None) -> tuple[DataFrame, DataFrame]:
    """(answered, failed). What ``accepts`` refuses is asked once more, then given up.

    ``accepts`` adds a boolean ``ok`` and an ``error``. Each attempt's answers are
    stored, so a scorer that costs money is never run again for the same request.
    ``requests`` is read once per attempt and again for the next: store what is dear.
    """
    hold = hold or (lambda df: materialise(df, "answers"))
    done, waiting, last = None, requests, None
    facts = requests.drop("payload") if {*requests.columns} - {key, "payload"} else None
    for _ in range(attempts):
        replies = ask(waiting, scorer, key)
        last = hold(accepts(replies if facts is None else replies.join(shuffled(facts), key)))
        good = last.filter("ok")
        done = good if done is None else done.unionByName(good)
        bad = last.filter(~F.col("ok")).select(key)
        waiting = requests.join(shuffled(bad), key, "left_semi")
    return done, last.filter(~F.col("ok")).select(key, "error")


def check_canon(replies: DataFrame) -> DataFrame:
    """A batch is accepted whole or not at all.

    Every record must be valid and the echoed indices exactly 0..n-1, once each.
    """
    reply = F.from_json("content", structured.CANON_REPLY)
    foods = F.coalesce(reply["foods"], F.array().cast("array<map<string,string>>"))
    bad = F.flatten(F.transform(foods, structured.canon_record_errors))
    indices = F.array_sort(F.transform(foods, lambda r: r["i"].try_cast("int")))
    expected = F.sequence(F.lit(0), F.col("n").cast("int") - 1)
    stray = F.coalesce(F.size(structured.keys_outside(F.col("content"), ("foods",))), F.lit(1))
    error = (
        F.when(F.size(foods) == 0, F.lit("no foods"))
        .when(stray > 0, F.lit("unknown keys"))
        .when(F.size(bad) > 0, F.concat(F.lit("invalid: "), F.array_join(F.array_sort(F.array_distinct(bad)), ",")))
        .when(~indices.eqNullSafe(expected), F.lit("indices do not match the foods sent"))
    )
    return replies.withColumns({"foods": foods, "error": error, "ok": error.isNull()})


def canon_answers(accepted: DataFrame, batched: DataFrame) -> DataFrame:
    """(fdc_id, base_name, food_kind, prep_label) for the foods of accepted batches."""
    rows = accepted.select("batch", F.explode("foods").alias("r")).select(
        "batch", F.col("r")["i"].try_cast("int").alias("i"),
        text.tidy_identity(F.col("r")["base"]).alias("base_name"),
        F.col("r")["kind"].alias("food_kind"), F.col("r")["prep"].alias("prep_label"),
    )
    return batched.select("batch", "i", "fdc_id").join(shuffled(rows), ["batch", "i"]).drop("batch", "i")


def check_group(replies: DataFrame) -> DataFrame:
    reply = F.from_json("content", structured.GROUP_REPLY)
    errors = structured.group_reply_errors(F.col("content"), reply)
    error = F.when(F.size(errors) > 0, F.array_join(errors, ","))
    return replies.withColumns({"reply": reply, "error": error, "ok": error.isNull()})


# --- write-back ---------------------------------------------------------------------
def apply_identities(foods: DataFrame, answers: DataFrame, model: str | None = None,
                     run_id: str = "run", hold: Hold = same) -> Merge:
    """Store identities. The key and the corrected label are derived here and nowhere else."""
    known = answers.join(foods.select("fdc_id", "description"), "fdc_id")
    values = known.select(
        "fdc_id", "base_name", "food_kind",
        labels.corrected_label(F.col("prep_label"), F.col("description"), F.col("base_name"),
                               F.col("food_kind")).alias("prep_label"),
        text.identity_key(F.col("base_name")).alias("base_key"),
        F.lit(model).cast("string").alias("canon_by"),
    )
    merge = apply_fields(foods, values, "fdc_id",
                         ["base_name", "food_kind", "prep_label", "base_key", "canon_by"],
                         run_id=run_id, hold=hold)
    logged = F.col("field").isin("base_name", "food_kind", "prep_label")
    return Merge(merge.snapshot, merge.audit.filter(logged), merge.counts)


def naming_values(accepted: DataFrame, items: DataFrame, foods: DataFrame) -> DataFrame:
    """Accepted names with their checks applied and their review status decided."""
    facts = items.select("merged_food_id", "brand_flagged")
    identity = foods.select(F.col("fdc_id").alias("merged_food_id"), "base_name")
    rows = accepted.join(shuffled(facts), "merged_food_id").join(shuffled(identity), "merged_food_id", "left")
    issues = labels.naming_issues(F.col("reply.display_name"), F.col("reply.emoji"), F.col("base_name"))
    return rows.withColumn("issues", issues).select(
        "merged_food_id", F.col("reply.display_name").alias("display_name"),
        F.col("reply.emoji").alias("emoji"), F.col("reply.commonness").alias("commonness"),
        F.array_join(text.clean_keywords(F.col("reply.keywords")), "; ").alias("keywords"),
        F.col("reply.confidence").alias("confidence"),
        labels.route(F.col("reply.confidence"), F.coalesce("brand_flagged", F.lit(False)),
                     F.size("issues") > 0).alias("review_status"),
        F.array_join("issues", "; ").alias("notes"),
    )


NAMING_FIELDS = ("display_name", "emoji", "commonness", "keywords", "confidence", "review_status")


def apply_enrichment(items: DataFrame, values: DataFrame, model: str | None = None,
                     reasoning: str | None = None, run_id: str = "run", hold: Hold = same) -> Merge:
    """Store names of unverified items; logs each difference and any notes."""
    stamped = values.withColumns({"enriched_by": F.lit(model).cast("string"),
                                  "enriched_reasoning": F.lit(reasoning).cast("string")})
    merge = apply_fields(items, stamped, "merged_food_id",
                         [*NAMING_FIELDS, "enriched_by", "enriched_reasoning"], run_id=run_id,
                         unless="human_verified", hold=hold)
    open_items = items.filter(~F.coalesce("human_verified", F.lit(False))).select(
        "merged_food_id", "source_version")
    noted = values.filter(F.coalesce("notes", F.lit("")) != "").join(open_items, "merged_food_id")
    notes = audit_rows(noted, "merged_food_id", [change_row(
        "llm_notes", F.lit(None), F.col("notes"), F.lit(True), "auto", F.col("source_version"))], run_id)
    audit = merge.audit.filter(~F.col("field").isin("enriched_by", "enriched_reasoning")).unionByName(notes)
    return Merge(merge.snapshot, audit, merge.counts)


def route_failures(items: DataFrame, failures: DataFrame, run_id: str = "run") -> Merge:
    """Items whose answers stayed unusable go to review, unless verified; the error is logged."""
    bad = failures.select("merged_food_id", text.clipped_error(F.col("error")).alias("_error"))
    joined = items.join(bad, "merged_food_id", "left")
    hit = F.col("_error").isNotNull() & ~F.coalesce("human_verified", F.lit(False))
    snapshot = joined.withColumn(
        "review_status", F.when(hit, F.lit("needs_review")).otherwise(F.col("review_status"))
    ).select(*items.columns)
    audit = audit_rows(joined, "merged_food_id", [change_row(
        "validation_error", F.col("review_status"), F.col("_error"), hit, "auto", F.col("source_version"))], run_id)
    return Merge(snapshot, audit, joined.agg(F.count_if(hit).alias("failed")))


# --- run statistics -------------------------------------------------------------------
def run_counters(replies: DataFrame) -> DataFrame:
    """Sums over a reply log: tokens, cache share, cost as charged or from list prices."""
    sums = replies.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("review_status") == "auto_approved").alias("auto_approved"),
        F.count_if(F.col("review_status") == "needs_review").alias("needs_review"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens")],
        F.sum("cost_usd").alias("charged"), F.sum("elapsed_s").alias("elapsed_s"),
    )
    listed = (F.col("prompt_tokens") / 1e6 * fixed.PROMPT_PRICE_PER_M
              + F.col("completion_tokens") / 1e6 * fixed.COMPLETION_PRICE_PER_M)
    return sums.withColumns({
        "cache_hit_rate": F.coalesce(F.try_divide("cached_tokens", "prompt_tokens"), F.lit(0.0)),
        "cost_usd": F.when(F.coalesce("charged", F.lit(0.0)) > 0, F.col("charged")).otherwise(listed),
    }).drop("charged")


def compare_scorers(requests: DataFrame, scorers: dict[str, Scorer], key: str) -> DataFrame:
    """The same requests through several scorers, one column each."""
    parts = [ask(requests, scorer, key).withColumn("config", F.lit(name)) for name, scorer in scorers.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(key).pivot("config", list(scorers)).agg(F.min("content"))
