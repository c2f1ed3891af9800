"""Requests to a scorer and its answers, over the standard tables.

The scorer is a plain function of the payload texts, the same on every run; what it
answers is derived from the request, so the results can be checked.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from larder.functions import maths, structured
from larder.operators import scoring
from larder.plans import roles
from larder.plans.merges import ITEMS_SQL, items
from larder.plans.registry import query
from larder.session import materialise
from larder.sources.archives import parsed_replies

# Order lines as synonyms and ingredients of parts.
_ATTRS = f"""a AS (SELECT l_partkey AS fdc_id, CASE l_returnflag WHEN 'A' THEN 'Common Name' WHEN 'N' THEN 'Additional Description' ELSE 'Other' END AS attribute_type,
  CASE WHEN l_linenumber = 7 THEN '' ELSE concat('syn ', l_suppkey % 20) END AS value FROM lineitem)"""
_SYN = """syn AS (SELECT {} AS key, string_agg(DISTINCT value, '; ' ORDER BY value) FILTER (WHERE attribute_type = 'Common Name') AS common_name,
  string_agg(DISTINCT value, '; ' ORDER BY value) FILTER (WHERE attribute_type = 'Additional Description') AS extra_desc
  FROM a {} WHERE attribute_type IN ('Common Name', 'Additional Description') AND value <> '' GROUP BY 1)"""
_ING = """ing AS (SELECT fdc_id, string_agg(d, ' | ' ORDER BY rn) AS ingredients FROM (
  SELECT l_partkey AS fdc_id, concat('part of ', l_orderkey) AS d, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, concat('part of ', l_orderkey)) AS rn FROM lineitem) WHERE rn <= 6 GROUP BY 1)"""
_ORDER = "lower(split_part(description, ',', 1)), lower(description), fdc_id"


def attributes(spark, sf):
    return roles.table(spark, sf, "lineitem").selectExpr(
        "l_partkey AS fdc_id", "l_linenumber AS seq_num",
        "CASE l_returnflag WHEN 'A' THEN 'Common Name' WHEN 'N' THEN 'Additional Description' ELSE 'Other' END AS attribute_type",
        "CASE WHEN l_linenumber = 7 THEN '' ELSE concat('syn ', l_suppkey % 20) END AS value")


def input_foods(spark, sf):
    return roles.table(spark, sf, "lineitem").selectExpr(
        "l_partkey AS fdc_id", "CAST(l_linenumber AS BIGINT) AS seq_num", "concat('part of ', l_orderkey) AS ingredient_description")


@query("synonyms_agg", f"WITH {_ATTRS}, {_SYN.format('fdc_id', '')} SELECT key AS fdc_id, common_name, extra_desc FROM syn")
def synonyms_agg(spark, sf):
    return scoring.synonyms(attributes(spark, sf), "fdc_id")


@query("item_synonyms", f"""
WITH {_ATTRS}, f AS (SELECT p_partkey AS fdc_id, p_size AS merged FROM part), {_SYN.format('merged', 'JOIN f USING (fdc_id)')}
SELECT CAST(key AS BIGINT) AS merged_food_id, common_name, extra_desc FROM syn""")
def item_synonyms(spark, sf):
    members = roles.table(spark, sf, "part").selectExpr("p_partkey AS fdc_id", "CAST(p_size AS BIGINT) AS merged_food_id")
    return scoring.synonyms(attributes(spark, sf), "merged_food_id", members)


@query("first_ingredients", f"WITH {_ING} SELECT fdc_id, ingredients FROM ing")
def first_ingredients(spark, sf):
    return scoring.first_ingredients(input_foods(spark, sf))


_CANON = f"""f AS ({roles.FOODS_SQL}), {_ATTRS}, {_SYN.format('fdc_id', '')}, {_ING},
cand AS (SELECT f.fdc_id, description, food_category, common_name, extra_desc, ingredients FROM f LEFT JOIN syn ON syn.key = f.fdc_id LEFT JOIN ing USING (fdc_id) WHERE base_name IS NULL)"""


def canon_candidates(spark, sf, limit=None):
    return scoring.canon_candidates(roles.foods(spark, sf), attributes(spark, sf), input_foods(spark, sf), limit)


@query("canon_candidates", f"WITH {_CANON} SELECT * FROM cand")
def candidates(spark, sf):
    return canon_candidates(spark, sf)


@query("canon_candidates_head", f"WITH {_CANON} SELECT fdc_id, description FROM cand ORDER BY {_ORDER} LIMIT 200")
def candidates_head(spark, sf):
    return canon_candidates(spark, sf, limit=200).select("fdc_id", "description")


def _batched(spark, sf):
    return scoring.to_batches(canon_candidates(spark, sf), scoring.sibling_order())


_BATCHED = f"""{_CANON}, b AS (SELECT *, (row_number() OVER (ORDER BY {_ORDER}) - 1) // 40 AS batch, (row_number() OVER (ORDER BY {_ORDER}) - 1) % 40 AS i FROM cand)"""


@query("sibling_batches", f"WITH {_BATCHED} SELECT fdc_id, CAST(batch AS BIGINT) AS batch, CAST(i AS INTEGER) AS i FROM b")
def sibling_batches(spark, sf):
    return _batched(spark, sf).select("fdc_id", "batch", "i")


@query("canon_payload", f"""
WITH {_BATCHED}, j AS (SELECT batch, i, concat('{{"i":', i, ',"d":"', description, '","cat":"', food_category, '"', CASE WHEN common_name IS NOT NULL THEN concat(',"aka":"', common_name, '"') ELSE '' END,
  CASE WHEN extra_desc IS NOT NULL THEN concat(',"also":"', extra_desc, '"') ELSE '' END, CASE WHEN ingredients IS NOT NULL THEN concat(',"ing":"', ingredients, '"') ELSE '' END, '}}') AS t FROM b)
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, concat('{{"foods":[', string_agg(t, ',' ORDER BY i), ']}}') AS payload FROM j GROUP BY 1""")
def canon_payload(spark, sf):
    return scoring.canon_requests(_batched(spark, sf))


def fake_canon(payloads: pd.Series) -> pd.Series:
    """Names each food by the part of its description before the comma; spoils some batches."""
    out = []
    for text in payloads:
        foods = json.loads(text)["foods"]
        rows = [{"i": f["i"], "base": f" {f['d'].split(',')[0]} ,", "kind": "dish" if "aka" in f else "ingredient",
                 "prep": "cooked" if "cooked" in f["d"] else None} for f in foods]
        if "fried" in foods[0]["d"]:
            rows = rows[:-1]
        out.append(json.dumps({"foods": rows}))
    return pd.Series(out)


@query("score_identities", f"""
WITH {_BATCHED}, bad AS (SELECT batch FROM b WHERE i = 0 AND contains(description, 'fried'))
SELECT fdc_id, trim(split_part(description, ',', 1)) AS base_name, CASE WHEN common_name IS NOT NULL THEN 'dish' ELSE 'ingredient' END AS food_kind,
  CASE WHEN contains(description, 'cooked') THEN 'cooked' END AS prep_label FROM b WHERE batch NOT IN (SELECT batch FROM bad)""")
def score_identities(spark, sf):
    batched = _batched(spark, sf)
    done, _ = scoring.score(scoring.canon_requests(batched), fake_canon, "batch", scoring.check_canon)
    return scoring.canon_answers(done, batched)


@query("score_failures", f"""
WITH {_BATCHED} SELECT CAST(batch AS BIGINT) AS batch, 'indices do not match the foods sent' AS error FROM b WHERE i = 0 AND contains(description, 'fried')
UNION ALL SELECT -1, 'none'""")
def score_failures(spark, sf):
    _, failed = scoring.score(scoring.canon_requests(_batched(spark, sf)), fake_canon, "batch", scoring.check_canon)
    return failed.unionByName(spark.range(1).selectExpr("CAST(-1 AS BIGINT) AS batch", "'none' AS error"))


@query("identity_write", f"""
WITH f AS ({roles.FOODS_SQL}) SELECT fdc_id, CASE WHEN p_size > 10 THEN p_name ELSE base_name END AS base_name, CASE WHEN p_size > 10 THEN 'dish' ELSE food_kind END AS food_kind,
  CASE WHEN p_size > 10 THEN 'fried' ELSE prep_label END AS prep_label FROM f JOIN part ON p_partkey = fdc_id""")
def identity_write(spark, sf):
    answers = roles.table(spark, sf, "part").filter("p_size > 10").selectExpr(
        "p_partkey AS fdc_id", "p_name AS base_name", "'dish' AS food_kind", "'fried' AS prep_label")
    foods = roles.foods(spark, sf).withColumns({c: F.lit(None).cast("string") for c in ("base_key", "canon_by")})
    return scoring.apply_identities(foods, answers).snapshot.select("fdc_id", "base_name", "food_kind", "prep_label")


# --- naming --------------------------------------------------------------------
_ENRICH = f"""i AS ({ITEMS_SQL}), f AS ({roles.FOODS_SQL}),
prep AS (SELECT merged_food_id, seq, prep_type, round(avg(q), 1) AS m FROM (SELECT l_partkey AS merged_food_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS seq,
  CASE l_returnflag WHEN 'A' THEN 'boiled' WHEN 'N' THEN 'raw' END AS prep_type, l_quantity AS q FROM lineitem) GROUP BY 1, 2, 3)"""


def _enrich_candidates(spark, sf, limit=None):
    """Preparations by return flag; one member each, the item's own part."""
    preps = roles.table(spark, sf, "lineitem").selectExpr(
        "l_partkey AS merged_food_id", "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS seq",
        "CASE l_returnflag WHEN 'A' THEN 'boiled' WHEN 'N' THEN 'raw' END AS prep_type", "l_quantity").groupBy(
        "merged_food_id", "seq", "prep_type").agg(F.min("l_quantity").alias("protein_g"), F.max("l_quantity").alias("carb_g"), F.lit(0.0).alias("fat_g"))
    preps = preps.withColumn("prep_id", F.col("merged_food_id"))
    foods = roles.foods(spark, sf).withColumns({"prep_id": F.col("fdc_id"), "merged_food_id": F.col("fdc_id")})
    return scoring.enrich_candidates(items(spark, sf), preps, foods, attributes(spark, sf), limit)


@query("enrich_candidates", f"""
WITH {_ENRICH}, {_ATTRS}, {_SYN.format('fdc_id', '')}
SELECT i.merged_food_id, common_name, extra_desc, base_name, food_kind, string_agg(concat(seq, ':', coalesce(prep_type, '-')), ' ' ORDER BY seq) AS preps
FROM i JOIN prep USING (merged_food_id) LEFT JOIN syn ON syn.key = i.merged_food_id LEFT JOIN f ON f.fdc_id = i.merged_food_id
WHERE NOT human_verified AND (display_name IS NULL OR emoji IS NULL OR review_status = 'pending') GROUP BY 1, 2, 3, 4, 5""")
def enrich_candidates(spark, sf):
    shown = F.transform("preps", lambda p: F.concat(p["seq"].cast("string"), F.lit(":"), F.coalesce(p["prep_type"], F.lit("-"))))
    return _enrich_candidates(spark, sf).select(
        "merged_food_id", "common_name", "extra_desc", "base_name", "food_kind", F.array_join(shown, " ").alias("preps"))


def fake_names(payloads: pd.Series) -> pd.Series:
    """Repeats the identity as the name; an item of one preparation gets a bad answer."""
    out = []
    for text in payloads:
        item = json.loads(text)
        out.append(json.dumps({
            "display_name": (item["base"] or "thing").title(), "emoji": "🍗" if len(item["p"]) > 1 else "no",
            "commonness": 0.5, "keywords": [" A ", "a", item["cat"]], "confidence": 0.9 if item["kind"] == "dish" else 0.7,
        }))
    return pd.Series(out)


@query("score_names", f"""
WITH {_ENRICH}, n AS (SELECT i.merged_food_id, i.brand_flagged, food_kind, i.food_category, base_name, count(*) AS np FROM i JOIN prep USING (merged_food_id) LEFT JOIN f ON f.fdc_id = i.merged_food_id
  WHERE NOT human_verified AND (display_name IS NULL OR emoji IS NULL OR review_status = 'pending') GROUP BY 1, 2, 3, 4, 5)
SELECT merged_food_id, concat('a; ', lower(food_category)) AS keywords, CASE WHEN food_kind = 'dish' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence,
  CASE WHEN NOT brand_flagged AND food_kind = 'dish' THEN 'auto_approved' ELSE 'needs_review' END AS review_status FROM n WHERE np > 1""")
def score_names(spark, sf):
    asked = materialise(scoring.enrich_requests(_enrich_candidates(spark, sf)), "asked")
    done, _ = scoring.score(asked, fake_names, "merged_food_id", scoring.check_group)
    return scoring.naming_values(done, items(spark, sf), roles.foods(spark, sf)).select(
        "merged_food_id", "keywords", "confidence", "review_status")


@query("compare_scorers", f"""
SELECT p_partkey AS id, concat(upper(p_name), '!') AS loud, lower(p_name) AS soft FROM part""")
def compare_scorers(spark, sf):
    asked = roles.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("payload"))
    return scoring.compare_scorers(asked, {"loud": lambda s: s.str.upper() + "!", "soft": lambda s: s.str.lower()}, "id")


# --- replies in stored form ------------------------------------------------------
@query("reply_parse", """
SELECT conv_id, turn, CAST(turn % 4 <> 3 AS BIGINT) AS readable, CASE WHEN turn % 4 = 3 THEN NULL WHEN turn % 4 = 2 THEN 0 ELSE 1 END AS items,
  CASE WHEN turn % 4 IN (0, 1) THEN md5(role) END AS digest FROM conversations""")
def reply_parse(spark, sf):
    body = F.when(F.col("turn") % 4 == 3, F.lit('{"other":1}')).when(F.col("turn") % 4 == 2, F.lit('{"items":[]}')).otherwise(
        F.to_json(F.struct(F.array(F.struct(F.col("role").alias("name"), F.col("text").alias("search_term"))).alias("items"))))
    fenced = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    rows = roles.table(spark, sf, "conversations").withColumn("content", fenced)
    got = parsed_replies(rows, "content", structured.PLATE_ROW)
    return got.select("conv_id", "turn", F.col("readable").cast("bigint").alias("readable"), F.size("items").alias("items"),
                      F.md5(F.get("items", F.lit(0))["name"]).alias("digest"))


@query("index_echo", f"""
WITH f AS ({roles.FOODS_SQL}), b AS (SELECT f.fdc_id, p_brand, (row_number() OVER (ORDER BY {_ORDER}) - 1) // 40 AS batch FROM f JOIN part ON p_partkey = f.fdc_id)
SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, CAST(count(*) FILTER (WHERE p_brand = 'Brand#1') = 0 AS BIGINT) AS ok FROM b GROUP BY 1""")
def index_echo(spark, sf):
    """Every food in batches of 40, echoed back; one brand's foods are left out of the echo."""
    rows = roles.foods(spark, sf).select("fdc_id", "description").join(
        roles.table(spark, sf, "part").select(F.col("p_partkey").alias("fdc_id"), "p_brand"), "fdc_id")
    record = F.when(F.col("p_brand") != "Brand#1", F.create_map(
        F.lit("i"), F.col("i").cast("string"), F.lit("base"), F.lit("b"), F.lit("kind"), F.lit("dish")))
    replies = scoring.to_batches(rows, scoring.sibling_order()).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.to_json(F.struct(F.collect_list(record).alias("foods"))).alias("content"))
    return scoring.check_canon(replies).select("batch", "n", F.col("ok").cast("bigint").alias("ok"))


@query("reply_rules", """
SELECT event_type, k, count(*) AS n, concat_ws(',', CASE WHEN event_type = 'view' THEN 'display_name' END, CASE WHEN event_type = 'click' THEN 'emoji' END,
  CASE WHEN k > 50 THEN 'commonness' END, CASE WHEN event_type = 'error' THEN 'keywords' END) AS errors
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1, 2""")
def reply_rules(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    content = F.to_json(F.struct(
        F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.lit("name")).alias("display_name"),
        F.when(F.col("event_type") == "click", F.lit("xx")).otherwise(F.lit("🍗")).alias("emoji"), (k / 50).alias("commonness"),
        F.when(F.col("event_type") == "error", F.array(F.repeat(F.lit("k"), 41))).otherwise(F.array(F.lit("a"))).alias("keywords"), F.lit(0.5).alias("confidence")))
    rows = roles.table(spark, sf, "events").select("event_type", k.alias("k"), content.alias("content"))
    errors = structured.group_reply_errors(F.col("content"), F.from_json("content", structured.GROUP_REPLY))
    return rows.groupBy("event_type", "k", F.array_join(errors, ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query("run_counters", """
SELECT count(*) AS requested, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed,
  CAST(sum(k * 10) AS BIGINT) AS prompt_tokens, round(sum(k * 3) / sum(k * 10), 6) AS cache_hit_rate, round(sum(k * 10) / 1e6 * 0.1288 + sum(k) / 1e6 * 0.5336, 6) AS cost_usd,
  round((sum(k * 10) / 1e6 * 0.1288 + sum(k) / 1e6 * 0.5336) / count(*) FILTER (WHERE event_type <> 'error') * 1000, 4) AS projected,
  round(sum(value) / count(*) FILTER (WHERE event_type <> 'error') * 1000 / 60, 1) AS minutes
FROM (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def run_counters(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    log = roles.table(spark, sf, "events").select(
        (F.col("event_type") != "error").alias("ok"), F.lit(None).cast("string").alias("review_status"), (k * 10).alias("prompt_tokens"),
        k.alias("completion_tokens"), (k * 3).alias("cached_tokens"), F.lit(0.0).alias("cost_usd"), F.col("value").alias("elapsed_s"))
    got = scoring.run_counters(log).crossJoin(F.broadcast(log.agg(F.sum("elapsed_s").alias("_elapsed"))))
    return got.select("requested", "succeeded", "failed", "prompt_tokens", F.round("cache_hit_rate", 6).alias("cache_hit_rate"),
                      F.round("cost_usd", 6).alias("cost_usd"),
                      maths.projected_cost(F.col("cost_usd"), F.col("succeeded"), F.lit(1000)).alias("projected"),
                      maths.projected_minutes(F.col("_elapsed"), F.col("succeeded"), F.lit(1000)).alias("minutes"))
