"""Releases, child tables, two-sided edits and reviews over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import schemas
from larder.functions import labels
from larder.operators import changes, review, scoring
from larder.plans import roles
from larder.plans.registry import query
from larder.schemas import ITEMS, conform
from larder.session import fresh_path
from larder.sources import tables
from larder.sources.buckets import BucketTable

CUT = "1999-01-01"

# Two releases of the customers: their last order before, and from, the cut.
_STATE = """SELECT o_custkey AS fdc_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS description,
  arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS food_category, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS fat_g,
  CAST(max(year(o_orderdate)) AS VARCHAR) AS source_version FROM orders WHERE o_orderdate {} TIMESTAMP '1999-01-01' GROUP BY 1"""
RELEASE_SQL = f"""old AS ({_STATE.format('<')}), new AS ({_STATE.format('>=')}),
both_ AS (SELECT n.fdc_id, o.description AS od, n.description AS nd, o.food_category AS oc, n.food_category AS nc, o.source_version AS ov, n.source_version AS nv,
  o.fat_g AS og, n.fat_g AS ng FROM old o JOIN new n USING (fdc_id)),
fresh AS (SELECT * FROM new WHERE fdc_id NOT IN (SELECT fdc_id FROM old))"""
_TRACKED = ("description", "food_category", "source_version")


def releases(spark, sf):
    orders = roles.table(spark, sf, "orders")
    last = F.struct("o_orderdate", "o_orderkey")

    def state(rows):
        return rows.groupBy(F.col("o_custkey").alias("fdc_id")).agg(
            F.max_by("o_orderstatus", last).alias("description"),
            F.max_by("o_orderpriority", last).alias("food_category"),
            F.max_by("o_totalprice", last).alias("fat_g"),
            F.max(F.year("o_orderdate")).cast("string").alias("source_version"))

    before = F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz")
    return state(orders.filter(before)), state(orders.filter(~before))


def _upsert(spark, sf):
    old, new = releases(spark, sf)
    return changes.upsert(old, new, "fdc_id", _TRACKED, ["fat_g"], version="source_version")


@query("release_diff_audit", f"""
WITH {RELEASE_SQL}
SELECT fdc_id, 'description' AS field, od AS old_value, nd AS new_value, 'auto' AS actor, nv AS source_version FROM both_ WHERE od IS DISTINCT FROM nd
UNION ALL SELECT fdc_id, 'food_category', oc, nc, 'auto', nv FROM both_ WHERE oc IS DISTINCT FROM nc
UNION ALL SELECT fdc_id, 'source_version', ov, nv, 'auto', nv FROM both_ WHERE ov IS DISTINCT FROM nv
UNION ALL SELECT fdc_id, 'ingest', NULL, description, 'auto', source_version FROM fresh""")
def release_diff_audit(spark, sf):
    return _upsert(spark, sf).audit.drop("run_id", "timestamp")


@query("audit_log_tail", f"""
WITH {RELEASE_SQL}, log AS (
SELECT fdc_id, 'description' AS field, od AS old_value, nd AS new_value FROM both_ WHERE od IS DISTINCT FROM nd
UNION ALL SELECT fdc_id, 'food_category', oc, nc FROM both_ WHERE oc IS DISTINCT FROM nc
UNION ALL SELECT fdc_id, 'source_version', ov, nv FROM both_ WHERE ov IS DISTINCT FROM nv
UNION ALL SELECT fdc_id, 'ingest', NULL, description FROM fresh)
SELECT *, (SELECT count(*) FROM log) AS logged FROM log ORDER BY fdc_id, field LIMIT 50""")
def audit_log_tail(spark, sf):
    """The audit rows of a merge, written in two parts, one of them twice, and read back."""
    audit, path = _upsert(spark, sf).audit.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")), fresh_path(spark, "audit")
    rows = schemas.conform(audit, schemas.AUDIT)
    for part, when in (("fresh", "field = 'ingest'"), ("changed", "field != 'ingest'"), ("fresh", "field = 'ingest'")):
        tables.append_log(rows.filter(when), path, part)
    log = tables.read_log(spark, path, schemas.AUDIT)
    total = log.agg(F.count(F.lit(1)).alias("logged"))
    return tables.log_tail(log).select("fdc_id", "field", "old_value", "new_value").crossJoin(F.broadcast(total))


@query("release_upsert", f"""
WITH {RELEASE_SQL}
SELECT fdc_id, CASE WHEN c THEN nd ELSE od END AS description, CASE WHEN c THEN nc ELSE oc END AS food_category,
  CASE WHEN c THEN ng ELSE og END AS fat_g, CASE WHEN c THEN nv ELSE ov END AS source_version
FROM (SELECT *, od IS DISTINCT FROM nd OR oc IS DISTINCT FROM nc OR ov IS DISTINCT FROM nv AS c FROM both_)
UNION ALL SELECT fdc_id, description, food_category, fat_g, source_version FROM fresh
UNION ALL SELECT fdc_id, description, food_category, fat_g, source_version FROM old WHERE fdc_id NOT IN (SELECT fdc_id FROM new)""")
def release_upsert(spark, sf):
    return _upsert(spark, sf).snapshot


# A small second release: customers who ordered in the last month of the table.
_LATE_SQL = f"""{RELEASE_SQL}, late AS (SELECT n.* FROM new n WHERE fdc_id IN (
  SELECT o_custkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY))"""


@query("release_buckets", f"""
WITH {_LATE_SQL}
SELECT fdc_id, description, food_category, fat_g, source_version FROM late
UNION ALL SELECT fdc_id, description, food_category, fat_g, source_version FROM old WHERE fdc_id NOT IN (SELECT fdc_id FROM late)""")
def release_buckets(spark, sf):
    """The release applied to a table in buckets, of which only the touched ones are written again."""
    old, new = releases(spark, sf)
    orders = roles.table(spark, sf, "orders")
    newest = orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("since"))
    recent = orders.crossJoin(F.broadcast(newest)).filter("o_orderdate >= since").select(F.col("o_custkey").alias("fdc_id"))
    stored = BucketTable(spark, fresh_path(spark, "customers"), "fdc_id")
    stored.create(old, 64)

    def upserted(before, rows):
        return changes.upsert(before, rows, "fdc_id", _TRACKED, ["fat_g"], version="source_version").snapshot

    stored.change(new.join(recent, "fdc_id", "left_semi"), upserted)
    return stored.read()


@query("children_buckets", """
WITH parents AS (SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY)
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM parents)
UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity + 1 FROM lineitem WHERE l_orderkey IN (SELECT k FROM parents) AND l_linenumber <> 2""")
def children_buckets(spark, sf):
    """Lines of the newest orders sent again, without their second ones; other orders' buckets stay as they are."""
    lines = roles.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    orders = roles.table(spark, sf, "orders")
    newest = orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("since"))
    parents = orders.crossJoin(F.broadcast(newest)).filter("o_orderdate >= since").select(F.col("o_orderkey").alias("l_orderkey"))
    stored = BucketTable(spark, fresh_path(spark, "lines"), "l_orderkey")
    stored.create(lines, 64)
    sent = lines.filter("l_linenumber <> 2").withColumn("l_quantity", F.col("l_quantity") + 1)
    # parents with no line left must be touched too: they come as the keys
    stored.change(parents, lambda before, keys: changes.replace_children(before, sent, keys, "l_orderkey"))
    return stored.read()


@query("release_counts", f"""
WITH {RELEASE_SQL}
SELECT (SELECT count(*) FROM fresh) AS inserted,
  (SELECT count(*) FROM both_ WHERE od IS DISTINCT FROM nd OR oc IS DISTINCT FROM nc OR ov IS DISTINCT FROM nv) AS updated,
  (SELECT count(*) FROM old WHERE fdc_id NOT IN (SELECT fdc_id FROM new)) AS untouched""")
def release_counts(spark, sf):
    return _upsert(spark, sf).counts


@query("release_vanished", f"WITH {RELEASE_SQL} SELECT fdc_id FROM old WHERE fdc_id NOT IN (SELECT fdc_id FROM new)")
def release_vanished(spark, sf):
    from larder.operators.relational import without

    old, new = releases(spark, sf)
    return without(old, new, "fdc_id").select("fdc_id")


@query("expansion_update", f"""
WITH {RELEASE_SQL}
SELECT fdc_id, coalesce(nd, od) AS description, coalesce(nv, ov) AS source_version FROM (
  SELECT o.fdc_id, o.description AS od, n.description AS nd, o.source_version AS ov, n.source_version AS nv FROM old o LEFT JOIN new n USING (fdc_id))""")
def expansion_update(spark, sf):
    old, new = releases(spark, sf)
    return changes.apply_fields(old, new, "fdc_id", ["description", "source_version"]).snapshot.select(
        "fdc_id", "description", "source_version")


@query("replace_children", """
WITH parents AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
rows AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_shipdate >= TIMESTAMP '1999-01-01' AS fresh FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM rows WHERE NOT fresh AND l_orderkey NOT IN (SELECT k FROM parents)
UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM rows WHERE fresh AND l_orderkey IN (SELECT k FROM parents)""")
def replace_children(spark, sf):
    lines = roles.table(spark, sf, "lineitem")
    before = F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")
    columns = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    parents = roles.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("l_orderkey"))
    return changes.replace_children(lines.filter(before).select(*columns), lines.filter(~before).select(*columns),
                                    parents, "l_orderkey")


@query("cleanup_log_known", """
SELECT l_partkey AS fdc_id, l_returnflag AS rule, l_linenumber AS n FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO')""")
def cleanup_log_known(spark, sf):
    rows = roles.table(spark, sf, "lineitem").selectExpr("l_partkey AS fdc_id", "l_returnflag AS rule", "l_linenumber AS n")
    known = roles.table(spark, sf, "part").filter("p_type <> 'PROMO'").select(F.col("p_partkey").alias("fdc_id"))
    return changes.known_only(rows, known)


# Two devices edited users' rows: errors and clicks on one, the rest on the other.
_SIDES = """side AS (SELECT user_id AS id, event_id AS updated_at, value, event_type, event_type IN ('error', 'click') AS is_local FROM events),
last AS (SELECT id, is_local, max(updated_at) AS updated_at, arg_max(value, updated_at) AS value, arg_max(event_type, updated_at) AS event_type FROM side GROUP BY 1, 2)"""


def _sides(spark, sf):
    rows = roles.table(spark, sf, "events").selectExpr(
        "user_id AS id", "event_id AS updated_at", "value", "event_type",
        "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS dirty")
    mine = F.col("event_type").isin("error", "click")
    last = [changes.latest_state(rows.filter(side), "id", ["updated_at"]) for side in (mine, ~mine)]
    return last[0], last[1]


@query("latest_state", """
SELECT user_id AS id, max(event_id) AS updated_at, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def latest_state(spark, sf):
    rows = roles.table(spark, sf, "events").selectExpr("user_id AS id", "event_id AS updated_at", "value", "event_type")
    return changes.latest_state(rows, "id", ["updated_at"])


@query("latest_wins_pull", f"""
WITH {_SIDES} SELECT id, max(updated_at) AS updated_at, arg_max(value, updated_at) AS value, arg_max(event_type, updated_at) AS event_type FROM last GROUP BY 1""")
def latest_wins_pull(spark, sf):
    local, remote = _sides(spark, sf)
    return changes.pull(local, remote).drop("dirty")


@query("dirty_push", f"""
WITH {_SIDES} SELECT id, updated_at, CAST(CASE WHEN event_type = 'error' AND value >= 5 THEN 1 ELSE 0 END AS BIGINT) AS dirty FROM last WHERE is_local""")
def dirty_push(spark, sf):
    local, _ = _sides(spark, sf)
    pushed = changes.push_queue(local).filter("value < 5")
    return changes.acknowledge(local, pushed).select("id", "updated_at", F.col("dirty").cast("bigint").alias("dirty"))


@query("touch_rule", f"""
WITH {_SIDES}, l AS (SELECT * FROM last WHERE is_local), r AS (SELECT * FROM last WHERE NOT is_local)
SELECT coalesce(r.id, l.id) AS id, CASE WHEN r.id IS NULL THEN l.updated_at WHEN r.value < 5 AND l.id IS NOT NULL THEN 99999999 WHEN r.value < 5 THEN -1 ELSE r.updated_at END AS updated_at,
  CAST(CASE WHEN r.id IS NULL THEN (CASE WHEN l.event_type = 'error' THEN 1 ELSE 0 END) WHEN r.value < 5 AND l.id IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS dirty
FROM l FULL JOIN r ON l.id = r.id""")
def touch_rule(spark, sf):
    local, remote = _sides(spark, sf)
    old = local.select("id", F.col("updated_at").alias("_o"))
    edits = remote.join(old, "id", "left").withColumn(
        "updated_at", F.when(F.col("value") < 5, F.coalesce("_o", F.lit(-1))).otherwise(F.col("updated_at"))).drop("_o")
    return changes.touched(local, edits, F.lit(99999999).cast("bigint")).select(
        "id", "updated_at", F.col("dirty").cast("bigint").alias("dirty"))


@query("soft_delete", f"""
WITH l AS ({roles.LOG_SQL}) SELECT id, grams, CAST(1 AS BIGINT) AS deleted, CAST(777 AS BIGINT) AS updated_at FROM l WHERE grams > 100 AND deleted = 0""")
def soft_delete(spark, sf):
    log = roles.log(spark, sf).withColumns({"dirty": F.lit(0), "updated_at": F.lit(0).cast("bigint")})
    ids = log.filter("grams > 100 AND deleted = 0")
    return changes.deletions(log, ids, F.lit(777).cast("bigint")).select(
        "id", "grams", F.col("deleted").cast("bigint").alias("deleted"), "updated_at")


@query("gram_edit", f"""
WITH l AS ({roles.LOG_SQL}) SELECT id, name, round(grams * 2, 6) AS grams, CAST(777 AS BIGINT) AS updated_at FROM l WHERE portion_label = 'cup'""")
def gram_edit(spark, sf):
    log = roles.log(spark, sf).withColumns({"dirty": F.lit(0), "updated_at": F.lit(0).cast("bigint")})
    edits = log.filter("portion_label = 'cup'").select("id", (F.col("grams") * 2).alias("grams"))
    return changes.gram_edits(log, edits, F.lit(777).cast("bigint")).select(
        "id", "name", F.round("grams", 6).alias("grams"), "updated_at")


# --- items under review ------------------------------------------------------
# Parts as items: what a scorer might have said about them is read off their columns.
_ITEMS = {
    "merged_food_id": "p_partkey", "food_category": "p_type",
    "display_name": "CASE WHEN p_size > 5 THEN concat(p_name, ' ', p_brand) END",
    "emoji": "CASE WHEN p_size > 10 THEN '🍗' END", "keywords": "p_brand",
    "confidence": "CASE WHEN p_size > 3 THEN CAST(p_size AS DOUBLE) / 50 END",
    "review_status": "CASE WHEN p_size < 8 THEN 'pending' WHEN p_size < 35 THEN 'needs_review' ELSE 'auto_approved' END",
    "human_verified": "p_brand = 'Brand#4'", "brand_flagged": "p_brand = 'Brand#3'",
    "source_version": "CAST(p_size AS VARCHAR(9))", "n_foods": "p_size", "n_preps": "p_size % 3",
}
ITEMS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _ITEMS.items()) + " FROM part"


def items(spark, sf):
    rows = roles.table(spark, sf, "part").selectExpr(*[f"{e} AS {n}" for n, e in _ITEMS.items()])
    return conform(rows, ITEMS)


def _preps(spark, sf):
    """Up to three preparations per item, from the return flags its lines carry."""
    return roles.table(spark, sf, "lineitem").selectExpr(
        "l_partkey AS merged_food_id", "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS seq",
        "CASE l_returnflag WHEN 'A' THEN 'boiled' WHEN 'N' THEN 'raw' END AS prep_type").distinct()


_PREPS_SQL = """preps AS (SELECT merged_food_id, string_agg(prep_type, ', ' ORDER BY seq) AS preps FROM (
  SELECT DISTINCT l_partkey AS merged_food_id, CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS seq, CASE l_returnflag WHEN 'A' THEN 'boiled' ELSE 'raw' END AS prep_type
  FROM lineitem WHERE l_returnflag IN ('A', 'N')) GROUP BY 1)"""


@query("review_queue", f"""
WITH i AS ({ITEMS_SQL}), {_PREPS_SQL}, f AS ({roles.FOODS_SQL})
SELECT q.merged_food_id, q.display_name, confidence, preps, description FROM (
  SELECT * FROM i WHERE review_status = 'needs_review' AND NOT human_verified ORDER BY confidence NULLS FIRST, merged_food_id LIMIT 500) q
LEFT JOIN preps USING (merged_food_id) LEFT JOIN f ON f.fdc_id = q.merged_food_id""")
def review_queue(spark, sf):
    return review.review_queue(items(spark, sf), _preps(spark, sf), roles.foods(spark, sf)).select(
        "merged_food_id", "display_name", "confidence", "preps", "description")


@query("largest_items", f"""
WITH i AS ({ITEMS_SQL}), {_PREPS_SQL}
SELECT merged_food_id, display_name, CAST(n_foods AS BIGINT) AS n_foods, preps FROM i LEFT JOIN preps USING (merged_food_id) WHERE n_foods >= 2""")
def largest_items(spark, sf):
    return review.cluster_items(items(spark, sf), _preps(spark, sf)).select(
        "merged_food_id", "display_name", F.col("n_foods").cast("bigint").alias("n_foods"), "preps")


_DECIDED = "CASE WHEN l_suppkey % 2 = 0 THEN concat('Named ', l_partkey) END"
_DECISIONS_SQL = f"""d AS (SELECT l_partkey AS id, arg_max(l_returnflag <> 'R', k) AS accept, arg_max(coalesce({_DECIDED}, ''), k) AS dn
  FROM (SELECT *, (l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS k FROM lineitem) GROUP BY 1),
j AS (SELECT i.*, d.id IS NOT NULL AS decided, coalesce(accept, false) AS ok, CASE WHEN accept AND dn <> '' THEN dn ELSE display_name END AS nn,
  CASE WHEN accept THEN 'verified' WHEN d.id IS NOT NULL THEN 'rejected' ELSE review_status END AS ns FROM i LEFT JOIN d ON d.id = merged_food_id)"""


def _decisions(spark, sf):
    rows = roles.table(spark, sf, "lineitem")
    last = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    said = F.coalesce(F.expr(_DECIDED), F.lit(""))
    return rows.groupBy(F.col("l_partkey").alias("merged_food_id")).agg(
        F.max_by(F.col("l_returnflag") != "R", last).alias("accept"), F.max_by(said, last).alias("display_name"),
    ).withColumns({"emoji": F.lit(None).cast("string"), "keywords": F.lit(None).cast("string")})


@query("human_review", f"""
WITH i AS ({ITEMS_SQL}), {_DECISIONS_SQL}
SELECT merged_food_id, nn AS display_name, ns AS review_status, CAST(decided OR human_verified AS BIGINT) AS human_verified FROM j""")
def human_review(spark, sf):
    return review.apply_review(items(spark, sf), _decisions(spark, sf)).snapshot.select(
        "merged_food_id", "display_name", "review_status", F.col("human_verified").cast("bigint").alias("human_verified"))


@query("human_review_audit", f"""
WITH i AS ({ITEMS_SQL}), {_DECISIONS_SQL}
SELECT merged_food_id AS fdc_id, 'display_name' AS field, display_name AS old_value, nn AS new_value FROM j WHERE decided AND display_name IS DISTINCT FROM nn
UNION ALL SELECT merged_food_id, 'review_status', review_status, ns FROM j WHERE decided AND review_status IS DISTINCT FROM ns
UNION ALL SELECT merged_food_id, 'human_verified', CAST(human_verified AS VARCHAR), 'true' FROM j WHERE decided AND NOT human_verified""")
def human_review_audit(spark, sf):
    return review.apply_review(items(spark, sf), _decisions(spark, sf)).audit.select(
        "fdc_id", "field", "old_value", "new_value")


@query("status_rollup", f"""
WITH i AS ({ITEMS_SQL}), f AS ({roles.FOODS_SQL})
SELECT data_type, review_status, count(*) AS n, CAST(sum(CASE WHEN i.brand_flagged THEN 1 ELSE 0 END) AS BIGINT) AS brand_flagged, CAST(sum(n_foods) AS BIGINT) AS foods
FROM i LEFT JOIN f ON f.fdc_id = merged_food_id GROUP BY 1, 2""")
def status_rollup(spark, sf):
    return review.status_summary(items(spark, sf), roles.foods(spark, sf))


@query("duplicate_names", f"""
WITH i AS ({ITEMS_SQL}), n AS (SELECT display_name, count(*) AS n FROM i WHERE display_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT display_name, n, merged_food_id FROM i JOIN n USING (display_name)""")
def duplicate_names(spark, sf):
    return review.duplicate_names(items(spark, sf))


@query("work_queue", f"""
WITH i AS ({ITEMS_SQL}) SELECT merged_food_id FROM i WHERE NOT human_verified AND (display_name IS NULL OR emoji IS NULL OR review_status = 'pending')""")
def work_queue(spark, sf):
    return items(spark, sf).filter(scoring.ENRICH_PENDING).select("merged_food_id")


_NEW_NAMES = f"""v AS (SELECT p_partkey AS id, upper(p_name) AS dn, CASE WHEN p_type = 'LARGE' THEN 'x' ELSE '🍗' END AS em, CAST(p_size AS DOUBLE) / 60 AS conf FROM part WHERE p_type <> 'MEDIUM'),
j AS (SELECT i.*, v.id IS NOT NULL AND NOT human_verified AS live, dn, em, conf,
  CASE WHEN em = 'x' OR brand_flagged THEN 'needs_review' WHEN conf >= 0.8 THEN 'auto_approved' ELSE 'needs_review' END AS ns FROM i LEFT JOIN v ON v.id = merged_food_id)"""


def _values(spark, sf):
    said = roles.table(spark, sf, "part").filter("p_type <> 'MEDIUM'").selectExpr(
        "p_partkey AS merged_food_id", "upper(p_name) AS display_name", "CASE WHEN p_type = 'LARGE' THEN 'x' ELSE '🍗' END AS emoji",
        "CAST(p_size AS DOUBLE) / 60 AS confidence", "p_brand = 'Brand#3' AS bf")
    issues = labels.naming_issues(F.col("display_name"), F.col("emoji"), F.lit(None).cast("string"))
    return said.withColumns({
        "commonness": F.lit(0.5), "keywords": F.lit("k"), "notes": F.array_join(issues, "; "),
        "review_status": labels.route(F.col("confidence"), F.col("bf"), F.size(issues) > 0)})


@query("apply_enrichment", f"""
WITH i AS ({ITEMS_SQL}), {_NEW_NAMES}
SELECT merged_food_id, CASE WHEN live THEN dn ELSE display_name END AS display_name, CASE WHEN live THEN ns ELSE review_status END AS review_status,
  CASE WHEN live THEN conf ELSE confidence END AS confidence FROM j""")
def apply_enrichment(spark, sf):
    return scoring.apply_enrichment(items(spark, sf), _values(spark, sf)).snapshot.select(
        "merged_food_id", "display_name", "review_status", "confidence")


@query("apply_enrichment_audit", f"""
WITH i AS ({ITEMS_SQL}), {_NEW_NAMES}
SELECT merged_food_id AS fdc_id, 'display_name' AS field, display_name AS old_value, dn AS new_value FROM j WHERE live AND display_name IS DISTINCT FROM dn
UNION ALL SELECT merged_food_id, 'emoji', emoji, em FROM j WHERE live AND emoji IS DISTINCT FROM em
UNION ALL SELECT merged_food_id, 'review_status', review_status, ns FROM j WHERE live AND review_status IS DISTINCT FROM ns
UNION ALL SELECT merged_food_id, 'llm_notes', NULL, 'not one emoji: x' FROM j WHERE live AND em = 'x'""")
def apply_enrichment_audit(spark, sf):
    audit = scoring.apply_enrichment(items(spark, sf), _values(spark, sf)).audit
    return audit.filter(F.col("field").isin("display_name", "emoji", "review_status", "llm_notes")).select(
        "fdc_id", "field", "old_value", "new_value")


@query("failure_routing", f"""
WITH i AS ({ITEMS_SQL}), e AS (SELECT doc_id AS id, substr(text, 1, 500) AS err FROM documents)
SELECT merged_food_id, CASE WHEN e.id IS NOT NULL AND NOT human_verified THEN 'needs_review' ELSE review_status END AS review_status,
  CAST(CASE WHEN human_verified THEN NULL ELSE length(err) END AS BIGINT) AS logged FROM i LEFT JOIN e ON e.id = merged_food_id""")
def failure_routing(spark, sf):
    bad = roles.table(spark, sf, "documents").select(F.col("doc_id").alias("merged_food_id"), F.col("text").alias("error"))
    merge = scoring.route_failures(items(spark, sf), bad)
    logged = merge.audit.select(F.col("fdc_id").alias("merged_food_id"), F.length("new_value").cast("bigint").alias("logged"))
    return merge.snapshot.join(logged, "merged_food_id", "left").select("merged_food_id", "review_status", "logged")


@query("constraint_rejects", f"""
WITH c AS ({roles.CUSTOM_SQL})
SELECT id, concat_ws(',', CASE WHEN serving_label IS NOT NULL AND serving_g IS NULL THEN 'serving_label' END, CASE WHEN emoji IS NOT NULL THEN 'emoji' END,
  CASE WHEN energy_kcal < 0 THEN 'energy_kcal' END, CASE WHEN protein_g < 0 THEN 'protein_g' END, CASE WHEN fat_g < 0 THEN 'fat_g' END) AS broken
FROM c WHERE emoji IS NOT NULL OR energy_kcal < 0""")
def constraint_rejects(spark, sf):
    _, bad = tables.split_by_rules(roles.custom_foods(spark, sf),
                                   tables.custom_food_rules(["energy_kcal", "protein_g", "fat_g"]))
    return bad.select("id", F.array_join("broken", ",").alias("broken"))


@query("row_rejects", f"""
WITH p AS ({roles.PORTIONS_SQL}),
i AS (SELECT concat('r', l_orderkey) AS recipe_id, l_linenumber AS seq, CASE WHEN l_linenumber NOT IN (2, 4) THEN l_partkey END AS food_id,
  CASE WHEN l_linenumber IN (2, 3) THEN concat('r', l_orderkey % 9) END AS custom_food_id FROM lineitem)
SELECT 'ingredient' AS kind, concat(recipe_id, '-', seq) AS id, concat_ws(',',
  CASE WHEN (food_id IS NULL) = (custom_food_id IS NULL) THEN 'one_reference' END, CASE WHEN custom_food_id = recipe_id THEN 'not_itself' END) AS broken
FROM i WHERE (food_id IS NULL) = (custom_food_id IS NULL) OR custom_food_id = recipe_id
UNION ALL SELECT 'portion', line_id, concat_ws(',', CASE WHEN gram_weight <= 0 THEN 'gram_weight' END, CASE WHEN trim(modifier) = '' THEN 'label' END)
FROM p WHERE gram_weight <= 0 OR trim(modifier) = ''
UNION ALL SELECT 'step', CAST(event_id AS VARCHAR), concat_ws(',', CASE WHEN event_type = 'view' THEN 'text' END, CASE WHEN round(value) = 0 THEN 'duration_s' END)
FROM events WHERE event_type = 'view' OR round(value) = 0""")
def row_rejects(spark, sf):
    """Lines as ingredients and portions, events as recipe steps, held to their rules."""
    lines = roles.table(spark, sf, "lineitem").selectExpr(
        "concat('r', l_orderkey) AS recipe_id", "concat('r', l_orderkey, '-', l_linenumber) AS id",
        "CASE WHEN l_linenumber NOT IN (2, 4) THEN l_partkey END AS food_id",
        "CASE WHEN l_linenumber IN (2, 3) THEN concat('r', l_orderkey % 9) END AS custom_food_id")
    portions = roles.portions(spark, sf).select(F.col("line_id").alias("id"), "gram_weight", F.col("modifier").alias("label"))
    steps = roles.table(spark, sf, "events").selectExpr(
        "CAST(event_id AS STRING) AS id", "CASE WHEN event_type = 'view' THEN ' ' ELSE event_type END AS text", "round(value) AS duration_s")
    kinds = {"ingredient": (lines, {n: rule() for n, rule in tables.INGREDIENT_RULES.items()}),
             "portion": (portions, tables.portion_rules()), "step": (steps, tables.step_rules())}
    bad = [tables.split_by_rules(rows, rules)[1].select(F.lit(kind).alias("kind"), "id", F.array_join("broken", ",").alias("broken"))
           for kind, (rows, rules) in kinds.items()]
    return bad[0].unionByName(bad[1]).unionByName(bad[2])


@query("audit_tail", """
SELECT event_id AS fdc_id, event_type AS field FROM events ORDER BY ts DESC, event_id, event_type LIMIT 50""")
def audit_tail(spark, sf):
    log = roles.table(spark, sf, "events").selectExpr("event_id AS fdc_id", "event_type AS field", "ts AS timestamp")
    return tables.log_tail(log).select("fdc_id", "field")
