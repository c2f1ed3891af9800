"""Detections and plates over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import maths, structured
from larder.operators import plate, search
from larder.plans import roles, searches
from larder.plans.registry import query
from larder.plans.texts import sql_suffix
from larder.session import materialise

# Events as detections: a user is a session, the event its place in the reply.
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_+$', '')"
_CLEAN = f"""d AS (SELECT user_id AS session, event_id AS pos, {_K} AS k, event_type,
  CASE WHEN {_K} % 10 = 9 THEN '!!' ELSE concat(event_type, '-', {_K} % 5) END AS raw_id,
  concat(event_type, ' dish ', {_K} % 3, 's') AS name, value * 20 AS grams, value / 40 AS confidence, -value + 10 AS kcal,
  CAST(day(ts) % 10 AS INTEGER) AS shot FROM events),
cleaned AS (SELECT session, pos, {_SLUG.format('raw_id')} AS instance_id, name,
  CASE WHEN grams BETWEEN 1 AND 2000 THEN floor(grams + 0.5) ELSE 0.0 END AS grams, least(1.0, greatest(0.0, confidence)) AS confidence,
  greatest(0.0, kcal) AS kcal_100g, CASE WHEN shot BETWEEN 1 AND 8 THEN shot ELSE 8 END AS shot FROM d WHERE raw_id <> '!!')"""

def _name_key(c: str) -> str:
    return ("array_to_string(list_sort([" + sql_suffix("w")
            + f" FOR w IN regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{Nd}}]+') IF w <> '']), ' ')")


# The plate so far: what the user's large views and purchases left on it.
_STAGED = f"""staged AS (SELECT user_id AS session, min(event_id) AS pos, concat('plate_', event_type) AS instance_id, concat('Dish 1 ', event_type) AS name
  FROM events WHERE event_type IN ('view', 'purchase') AND value > 30 GROUP BY user_id, event_type),
by_name AS (SELECT session, {_name_key('name')} AS key, arg_min(instance_id, pos) AS target FROM staged GROUP BY 1, 2),
fresh AS (SELECT *, {_name_key('name')} AS key FROM cleaned c WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.session = c.session AND s.instance_id = c.instance_id)),
takers AS (SELECT f.session, target, min(f.pos) AS pos FROM fresh f JOIN by_name b ON b.session = f.session AND b.key = f.key
  WHERE NOT EXISTS (SELECT 1 FROM cleaned c WHERE c.session = f.session AND c.instance_id = target) GROUP BY 1, 2),
aliased AS (SELECT c.session, c.pos, coalesce(target, instance_id) AS instance_id, name, grams, confidence, kcal_100g, shot FROM cleaned c LEFT JOIN takers t ON t.session = c.session AND t.pos = c.pos),
collapsed AS (SELECT session, instance_id, min(pos) AS pos, arg_max(name, (confidence, -pos)) AS name, arg_max(grams, (confidence, -pos)) AS grams,
  max(confidence) AS confidence, arg_max(kcal_100g, (confidence, -pos)) AS kcal_100g, list_sort(list(DISTINCT shot)) AS shots FROM aliased GROUP BY 1, 2)"""


def detections(spark, sf):
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)"
    return roles.table(spark, sf, "events").selectExpr(
        "user_id AS session", "event_id AS pos", "8 AS shot_count",
        f"CASE WHEN {k} % 10 = 9 THEN '!!' ELSE concat(event_type, '-', {k} % 5) END AS instance_id",
        f"concat(event_type, ' dish ', {k} % 3, 's') AS name", "' ' AS search_term", "'🍗 x' AS emoji",
        "value * 20 AS grams", "value / 40 AS confidence", "-value + 10 AS kcal_100g",
        "1D AS protein_100g", "CAST('NaN' AS DOUBLE) AS carb_100g", "CAST(NULL AS DOUBLE) AS fat_100g",
        "array(CAST(day(ts) % 10 AS INT)) AS shots")


def staged(spark, sf):
    rows = roles.table(spark, sf, "events").filter("event_type IN ('view', 'purchase') AND value > 30")
    return rows.groupBy(F.col("user_id").alias("session"), "event_type").agg(F.min("event_id").alias("pos")).select(
        "session", "pos", F.concat(F.lit("plate_"), "event_type").alias("instance_id"),
        F.concat(F.lit("Dish 1 "), "event_type").alias("name"))


_SHOTS = "array_to_string([CAST(s AS VARCHAR) FOR s IN {}], ',')"


def _shots(c):
    return F.array_join(F.transform(c, lambda s: s.cast("string")), ",")


@query("detection_clean", f"WITH {_CLEAN} SELECT session, pos, instance_id, grams, round(confidence, 6) AS confidence, round(kcal_100g, 6) AS kcal_100g, CAST(shot AS VARCHAR) AS shots FROM cleaned")
def detection_clean(spark, sf):
    return plate.cleaned(detections(spark, sf)).select(
        "session", "pos", "instance_id", "grams", F.round("confidence", 6).alias("confidence"),
        F.round("kcal_100g", 6).alias("kcal_100g"), _shots("shots").alias("shots"))


@query("detection_normalise", f"""
WITH {_CLEAN}, {_STAGED} SELECT session, pos, instance_id, name, grams, round(confidence, 6) AS confidence, {_SHOTS.format('shots')} AS shots FROM collapsed""")
def detection_normalise(spark, sf):
    return plate.normalise_detections(detections(spark, sf), staged(spark, sf)).select(
        "session", "pos", "instance_id", "name", "grams", F.round("confidence", 6).alias("confidence"), _shots("shots").alias("shots"))


@query("multi_shot_count", f"""
WITH {_CLEAN}, {_STAGED} SELECT session, count(*) FILTER (WHERE len(shots) > 1) AS across_shots, count(*) AS items FROM collapsed GROUP BY 1""")
def multi_shot_count(spark, sf):
    return plate.multi_shot_count(plate.normalise_detections(detections(spark, sf), staged(spark, sf)))


@query("loggable_grams", """
SELECT event_id AS id, CASE WHEN value * 100 BETWEEN 1 AND 2000 THEN round(value * 100) WHEN user_id % 3 > 0 THEN (user_id % 3) * 30.0::DOUBLE ELSE 100.0 END AS grams FROM events""")
def loggable_grams(spark, sf):
    serving = (F.col("user_id") % 3 * 30).cast("double")
    return roles.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), maths.loggable_grams(F.col("value") * 100, serving).alias("grams"))


# Every part name is looked for, turned round and in the plural, among the ten best hits of a
# search for it.
_TURNED = "concat(split_part(p_name, ' ', 2), 's ', split_part(p_name, ' ', 1))"
_MATCH = f"""{searches.DOCS_SQL},
asked AS (SELECT min(p_partkey) AS query_id, p_name AS text, {_TURNED} AS wanted FROM part GROUP BY p_name),
{searches.bm25_sql('docs', 'id', searches.WEIGHTS, 'asked')}, {searches.RECENT_SQL},
item AS (SELECT p_partkey AS item_id, p_name AS display_name, NULL::DOUBLE AS commonness, NULL::VARCHAR AS prep_type, p_name AS description FROM part),
placed AS (SELECT query_id, wanted, item_id, display_name AS found, row_number() OVER (PARTITION BY query_id ORDER BY {searches.score_sql('rank', 'text')}, item_id) AS rn
  FROM matched JOIN asked USING (query_id) JOIN item USING (item_id) LEFT JOIN recent USING (item_id)),
tok AS (SELECT query_id, item_id, found, rn,
  list_distinct([{sql_suffix('w')} FOR w IN [x FOR x IN regexp_split_to_array(lower(wanted), '[^a-z0-9]+') IF x <> '']]) AS a,
  list_distinct([{sql_suffix('w')} FOR w IN [x FOR x IN regexp_split_to_array(lower(found), '[^a-z0-9]+') IF x <> '']]) AS b
  FROM placed WHERE rn <= 10),
alike AS (SELECT *, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS similarity FROM tok),
match AS (SELECT query_id, arg_max(item_id, (similarity, -rn)) AS food_id, arg_max(found, (similarity, -rn)) AS found,
  arg_max(rn, (similarity, -rn)) AS rn, max(similarity) AS similarity FROM alike WHERE similarity >= 0.6 GROUP BY 1)"""


def name_matches(spark, sf, text="p_name"):
    """(query_id, text, food_id, found, rn, similarity) for every distinct part name."""
    asked = roles.table(spark, sf, "part").groupBy(F.expr(text).alias("text")).agg(F.min("p_partkey").alias("query_id"))
    asked = asked.withColumn("name", F.expr(_TURNED.replace("p_name", "text")))
    none = F.lit(None).cast("double")
    part = roles.table(spark, sf, "part").select(F.col("p_partkey").alias("merged_food_id"), F.col("p_name").alias("display_name"))
    items = part.withColumns({"emoji": F.lit(None).cast("string"), "commonness": none, "prep_type": F.lit(None).cast("string"), "n_preps": F.lit(1)})
    foods = part.select("merged_food_id", F.col("merged_food_id").alias("food_id"), F.col("display_name").alias("description"),
                        *[none.alias(f"{c}_100g") for c in ("kcal", "protein", "fat", "carb")], none.alias("serving_g"),
                        F.lit(None).cast("string").alias("serving_label"))
    index = search.build_index(searches.docs(spark, sf), "id", searches.FIELDS)
    hits = search.primary_search(asked, index, items, foods, roles.log(spark, sf), roles.AS_OF)
    best = plate.best_match(asked, hits.select("query_id", "food_id", "name", "rn"), "query_id")
    return asked.select("query_id", "text").join(best, "query_id")


@query("fuzzy_match", f"WITH {_MATCH} SELECT query_id AS key, found, food_id, rn, round(similarity, 6) AS similarity FROM match")
def fuzzy_match(spark, sf):
    return name_matches(spark, sf).select(
        F.col("query_id").alias("key"), "found", "food_id", F.col("rn").cast("bigint").alias("rn"), F.round("similarity", 6).alias("similarity"))


# A reply merged into a plate: what is on it, what is new, what a person changed or took off.
_PLATE = f"""WITH {_CLEAN}, {_STAGED},
batch AS (SELECT session, pos, CASE WHEN instance_id = 'plate_view' THEN NULL ELSE instance_id END AS instance_id, name, 50.0 AS grams FROM staged
  UNION ALL SELECT session, pos + 1000000, concat('click_', n), 'old click', 70.0 FROM (SELECT user_id AS session, min(event_id) AS pos, 2 AS n FROM events WHERE event_type = 'click' GROUP BY 1)),
edited AS (SELECT DISTINCT session, instance_id FROM cleaned WHERE instance_id = 'click_2' AND session % 2 = 0),
removed AS (SELECT DISTINCT session, instance_id FROM cleaned WHERE instance_id LIKE 'view%' AND grams > 500),
cand AS (SELECT c.* FROM aliased c WHERE NOT EXISTS (SELECT 1 FROM removed r WHERE r.session = c.session AND r.instance_id = c.instance_id)),
newest AS (SELECT session, instance_id, max(pos) AS pos, arg_max(name, pos) AS name, arg_max(grams, pos) AS grams, arg_max(shot, pos) AS shot FROM cand GROUP BY 1, 2)
SELECT b.session, 0 AS part, b.pos, b.instance_id, coalesce(n.name, b.name) AS name,
  CASE WHEN n.session IS NOT NULL AND e.session IS NULL THEN n.grams ELSE b.grams END AS grams, CASE WHEN n.session IS NULL THEN '1' WHEN n.shot = 1 THEN '1' ELSE concat('1,', n.shot) END AS shots
FROM batch b LEFT JOIN newest n ON n.session = b.session AND n.instance_id = b.instance_id LEFT JOIN edited e ON e.session = b.session AND e.instance_id = b.instance_id
UNION ALL SELECT session, 1, pos, instance_id, name, grams, CAST(shot AS VARCHAR) FROM newest n
WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.session = n.session AND b.instance_id = n.instance_id)"""


@query("plate_merge", _PLATE)
def plate_merge(spark, sf):
    cleaned = materialise(plate.cleaned(detections(spark, sf)), "cleaned")
    candidates = plate.aliased(cleaned, staged(spark, sf)).withColumns(
        {"food_id": F.lit(None).cast("bigint"), "serving_g": F.lit(None).cast("double")})
    clicks = roles.table(spark, sf, "events").filter("event_type = 'click'").groupBy(F.col("user_id").alias("session")).agg(
        (F.min("event_id") + 1000000).alias("pos")).withColumns({"instance_id": F.lit("click_2"), "name": F.lit("old click"), "grams": F.lit(70.0)})
    own = staged(spark, sf).withColumns({"grams": F.lit(50.0), "instance_id": F.when(F.col("instance_id") != "plate_view", F.col("instance_id"))})
    batch = own.unionByName(clicks).withColumn("shots", F.array(F.lit(1)))
    batch = batch.withColumns({c: F.lit(None).cast("double") for c in ("kcal_100g", "protein_100g", "carb_100g", "fat_100g", "serving_g")}).withColumns(
        {"food_id": F.lit(None).cast("bigint"), "emoji": F.lit(None).cast("string")})
    edited = cleaned.filter("instance_id = 'click_2' AND session % 2 = 0").select("session", "instance_id").distinct()
    removed = cleaned.filter("instance_id LIKE 'view%' AND grams > 500").select("session", "instance_id").distinct()
    return plate.merge_plate(batch, candidates, edited, removed).select(
        "session", "place.part", "place.pos", "instance_id", "name", "grams", _shots("shots").alias("shots"))


# A detection is searched by the name of the part that its place leads to; a part of every
# seventh size stands for a dish under a name of its own, which the search does not find.
_ASKED = "CASE WHEN p_size % 7 = 0 THEN concat(p_name, ' zzq') ELSE p_name END"


@query("resolve_detections", f"""
WITH {_MATCH}, {_CLEAN}, {_STAGED},
slots AS MATERIALIZED (SELECT p_partkey AS slot, {_ASKED} AS text FROM part),
j AS (SELECT c.*, m.food_id, m.found, CASE WHEN p.p_size > 20 THEN CAST(p.p_size AS DOUBLE) END AS serving_g
  FROM collapsed c LEFT JOIN slots t ON t.slot = c.pos % (SELECT max(p_partkey) FROM part) + 1
  LEFT JOIN asked q ON q.text = t.text LEFT JOIN match m ON m.query_id = q.query_id LEFT JOIN part p ON p.p_partkey = m.food_id)
SELECT session, instance_id, food_id, coalesce(found, name) AS name, CASE WHEN grams BETWEEN 1 AND 2000 THEN grams WHEN serving_g > 0 THEN serving_g ELSE 100.0 END AS grams,
  round(CASE WHEN food_id IS NULL THEN kcal_100g ELSE 1.5 END, 6) AS kcal_100g FROM j WHERE confidence >= 0.35""")
def resolve_detections(spark, sf):
    rows = plate.normalise_detections(detections(spark, sf), staged(spark, sf))
    part = roles.table(spark, sf, "part")
    facts = part.selectExpr("p_partkey AS food_id", "CASE WHEN p_size > 20 THEN CAST(p_size AS DOUBLE) END AS serving_g",
                            "1.5D AS kcal_100g", "0D AS protein_100g", "0D AS carb_100g", "0D AS fat_100g")
    named = name_matches(spark, sf, _ASKED).select("text", "food_id", "found").join(facts, "food_id")
    slot = (F.col("pos") % F.col("last") + 1).alias("slot")
    asked = rows.crossJoin(F.broadcast(part.agg(F.max("p_partkey").alias("last")))).select("session", "instance_id", slot)
    matches = asked.join(part.selectExpr("p_partkey AS slot", f"{_ASKED} AS text"), "slot").join(named, "text")
    return plate.resolve(rows, matches).select(
        "session", "instance_id", "food_id", "name", "grams", F.round("kcal_100g", 6).alias("kcal_100g"))


@query("plate_payload", f"""
WITH {_CLEAN}, {_STAGED} SELECT session, concat('{{"plate":[', string_agg(concat('{{"instance_id":"', instance_id, '","name":"', name, '"}}'), ',' ORDER BY pos), ']}}') AS payload FROM staged GROUP BY 1""")
def plate_payload(spark, sf):
    rows = staged(spark, sf).withColumn("place", F.col("pos")).withColumn("grams", F.lit(None).cast("double"))
    return plate.plate_summaries(rows)


@query("shot_lists", """
SELECT user_id, array_to_string([CAST(x AS VARCHAR) FOR x IN CASE WHEN len(l) = 0 THEN [8] ELSE l END], ',') AS shots FROM (
  SELECT user_id, list_sort([x FOR x IN list(DISTINCT CAST(day(ts) AS INTEGER) - 10) IF x BETWEEN 1 AND 8]) AS l FROM events GROUP BY 1)""")
def shot_lists(spark, sf):
    rows = roles.table(spark, sf, "events").groupBy("user_id").agg(
        F.collect_set((F.dayofmonth("ts") - 10).cast("int")).alias("s"))
    return rows.select("user_id", _shots(structured.usable_shots(F.col("s"), F.lit(8))).alias("shots"))
