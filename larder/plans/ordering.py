"""Orders as places, payload texts, counters and rules that other queries do not show."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import labels, text
from larder.operators import changes, intake, plate, review, scoring
from larder.operators.relational import indexed
from larder.plans import plates, roles
from larder.plans.catalogue import _GROUPED, grouped
from larder.plans.merges import ITEMS_SQL, _preps, items
from larder.plans.registry import query
from larder.plans.requests import _ATTRS, _ENRICH, _SYN, _enrich_candidates


@query("timeline_places", f"""
SELECT user_id, local_date, id, row_number() OVER (PARTITION BY user_id, local_date ORDER BY logged_at, id) AS place
FROM ({roles.LOG_SQL}) WHERE deleted = 0""")
def timeline_places(spark, sf):
    return intake.timeline(roles.log(spark, sf)).select("user_id", "local_date", "id", F.col("place").cast("bigint").alias("place"))


@query("enrich_places", f"""
WITH {_ENRICH}
SELECT merged_food_id, row_number() OVER (ORDER BY brand_flagged, merged_food_id) - 1 AS place FROM i
WHERE NOT human_verified AND (display_name IS NULL OR emoji IS NULL OR review_status = 'pending')
  AND merged_food_id IN (SELECT merged_food_id FROM prep)""")
def enrich_places(spark, sf):
    asked = _enrich_candidates(spark, sf).select("merged_food_id", "brand_flagged")
    return indexed(asked, scoring.enrich_order(), "place").select("merged_food_id", "place")


@query("item_places", f"""
WITH i AS ({ITEMS_SQL}) SELECT merged_food_id, row_number() OVER (ORDER BY n_foods DESC, merged_food_id) - 1 AS place FROM i WHERE n_foods >= 2""")
def item_places(spark, sf):
    return review.cluster_items(items(spark, sf), _preps(spark, sf)).select("merged_food_id", "place")


@query("item_places_head", f"""
WITH i AS ({ITEMS_SQL}) SELECT merged_food_id, row_number() OVER (ORDER BY n_foods DESC, merged_food_id) - 1 AS place FROM i
WHERE n_foods >= 2 ORDER BY n_foods DESC, merged_food_id LIMIT 25""")
def item_places_head(spark, sf):
    return review.cluster_items(items(spark, sf), _preps(spark, sf), k=25).select("merged_food_id", "place")


def _text(c: str) -> str:
    """A value as JSON, null where there is none."""
    return f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"


@query("enrich_payload", f"""
WITH {_ENRICH}, {_ATTRS}, {_SYN.format('fdc_id', '')},
said AS (SELECT merged_food_id, seq, prep_type, min(q) AS protein, max(q) AS carb FROM (
  SELECT l_partkey AS merged_food_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS seq, CASE l_returnflag WHEN 'A' THEN 'boiled' WHEN 'N' THEN 'raw' END AS prep_type, l_quantity AS q FROM lineitem) GROUP BY 1, 2, 3),
rows AS (SELECT s.merged_food_id, string_agg(concat('{{"prep":', {_text('prep_type')}, ',"m":[', round(protein, 1)::DOUBLE, ',', round(carb, 1)::DOUBLE, ',0.0],"d":[', to_json(description), ']}}'), ',' ORDER BY seq) AS p
  FROM said s JOIN f ON f.fdc_id = s.merged_food_id GROUP BY 1)
SELECT i.merged_food_id, concat('{{"base":', {_text('base_name')}, ',"kind":', {_text('food_kind')}, ',"cat":', {_text('i.food_category')},
  CASE WHEN coalesce(common_name, '') <> '' THEN concat(',"aka":', to_json(common_name)) ELSE '' END,
  CASE WHEN coalesce(extra_desc, '') <> '' THEN concat(',"also":', to_json(extra_desc)) ELSE '' END, ',"p":[', p, ']}}') AS payload
FROM i JOIN rows USING (merged_food_id) LEFT JOIN syn ON syn.key = i.merged_food_id LEFT JOIN f ON f.fdc_id = i.merged_food_id
WHERE NOT human_verified AND (display_name IS NULL OR emoji IS NULL OR review_status = 'pending')""")
def enrich_payload(spark, sf):
    """The request text of every open item, as it is sent."""
    return scoring.enrich_requests(_enrich_candidates(spark, sf))


@query("search_terms", f"""
WITH d AS (SELECT user_id AS session, event_id AS pos, {plates._K} AS k, event_type, value FROM events)
SELECT session, pos, CASE WHEN k % 4 = 0 THEN concat(event_type, ' dish ', k % 3, 's') WHEN k % 4 = 1 THEN concat(event_type, ' dish ', k % 3, 's') ELSE concat('term ', k) END AS search_term
FROM d WHERE k % 10 <> 9""")
def search_terms(spark, sf):
    """What a detection is searched by: its term, or its name where the term is blank or missing."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    keys = roles.table(spark, sf, "events").select(F.col("event_id").alias("pos"), k.alias("k"))
    term = F.when(F.col("k") % 4 == 0, F.lit("  ")).when(F.col("k") % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit(" term "), "k"))
    rows = plates.detections(spark, sf).drop("search_term").join(keys, "pos").withColumn("search_term", term).drop("k")
    return plate.cleaned(rows).select("session", "pos", F.trim("search_term").alias("search_term"))


_CATEGORY = """CASE p_size % 9 WHEN 0 THEN 'Dairy and Egg Products' WHEN 1 THEN 'Beef Products' WHEN 2 THEN 'Fruits and Fruit Juices'
  WHEN 3 THEN 'Sausages and Luncheon Meats' WHEN 4 THEN 'Vegetables' WHEN 5 THEN 'Ground MEAT dishes' WHEN 6 THEN NULL WHEN 7 THEN 'Cereal Grains' ELSE 'Nut Products' END"""


@query("fat_gate_categories", f"""
SELECT {_CATEGORY} AS category, CAST(p_size % 9 IN (0, 1, 3, 5) AS BIGINT) AS allowed, count(*) AS n FROM part GROUP BY 1, 2""")
def fat_gate_categories(spark, sf):
    rows = roles.table(spark, sf, "part").select(F.expr(_CATEGORY).alias("category"))
    return rows.groupBy("category", labels.is_meat_or_dairy(F.col("category")).cast("bigint").alias("allowed")).agg(
        F.count(F.lit(1)).alias("n"))


@query("relink_counts", f"""
WITH {_GROUPED}
SELECT count(*) FILTER (WHERE merged_food_id IS NOT NULL AND (p_size % 4 <> 0 OR p_size % 12 = 0)) AS relinked,
  count(*) FILTER (WHERE merged_food_id IS NOT NULL OR p_size % 4 = 0) AS linked FROM foods""")
def relink_counts(spark, sf):
    """Foods of which a quarter already are where the new grouping puts them, some of these under another preparation."""
    foods, _, _ = grouped(spark, sf)
    links = foods.filter("merged_food_id IS NOT NULL").select("fdc_id", "merged_food_id", "prep_id")
    stays = F.col("p_size") % 4 == 0
    before = foods.withColumns({
        "merged_food_id": F.when(stays, F.coalesce("merged_food_id", F.lit(-1))),
        "prep_id": F.when(stays, F.when(F.col("p_size") % 12 == 0, F.lit(-1)).otherwise(F.coalesce("prep_id", F.lit(-1))))})
    _, counts = changes.relink(before, links)
    return counts


# Letters of the Latin, Greek and Cyrillic scripts, one for each part, beside others.
_CODE = "(CASE WHEN p_partkey % 2 = 0 THEN 192 + p_partkey * 3 % 1100 ELSE 7680 + p_partkey % 512 END)"


@query("folded_letters", f"""
SELECT p_partkey, strip_accents(lower(concat('A', chr({_CODE}::INTEGER), 'é ', p_name))) AS folded FROM part
WHERE regexp_matches(chr({_CODE}::INTEGER), '\\p{{L}}')""")
def folded_letters(spark, sf):
    code = F.expr(_CODE)
    letter = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
    rows = roles.table(spark, sf, "part").select("p_partkey", "p_name", letter.alias("c")).filter(F.col("c").rlike("\\p{L}"))
    return rows.select("p_partkey", text.fold(F.concat(F.lit("A"), "c", F.lit("é "), "p_name")).alias("folded"))
