"""Foods to items and preparations over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import cluster as c
from larder.operators import diagnostics, pivot
from larder.operators.changes import merge_clusters, relink
from larder.operators.scoring import first_descriptions
from larder.plans import roles
from larder.plans.nutrients import PIVOT, PIVOT_SQL, amounts
from larder.plans.registry import query
from larder.plans.texts import sql_key, sql_list, sql_written
from larder.session import materialise
from larder.fixed import COOKED_METHODS, MERGE_MACROS, PREP_TYPES
from larder.schemas import ITEMS, conform

_MACROS = {m: PIVOT[m] for m in MERGE_MACROS}


def cluster_foods(spark, sf):
    return pivot.macro_input(roles.foods(spark, sf), amounts(spark, sf), nutrients=_MACROS)


def clusters(spark, sf):
    return c.cluster(cluster_foods(spark, sf), hold=lambda df: materialise(df, "items"))


KEYED_SQL = f"""f AS ({roles.FOODS_SQL}),
keyed AS (SELECT f.*, CASE WHEN {sql_key('base_name')} = '' THEN concat(chr(0), fdc_id) ELSE {sql_key('base_name')} END AS base_key,
  {sql_written('base_name')} AS written, coalesce(food_kind, '') AS kind FROM f),
per_kind AS (SELECT base_key, kind, count(*) AS n FROM keyed GROUP BY 1, 2),
spelled AS (SELECT base_key, count(DISTINCT written) > 1 AS two FROM keyed WHERE base_name IS NOT NULL GROUP BY 1),
votes AS (SELECT base_key, count(*) AS n_kinds, arg_max(kind, (n, kind = 'ingredient', kind)) AS winner, CAST(sum(n) AS BIGINT) AS n_foods FROM per_kind GROUP BY 1),
ruled AS (SELECT votes.*, coalesce(two, false) AS two FROM votes LEFT JOIN spelled USING (base_key)),
grouped AS (SELECT keyed.*, CASE WHEN n_kinds > 1 AND NOT two THEN winner ELSE kind END AS item_kind FROM keyed JOIN ruled USING (base_key))"""

_P, _C, _F = "coalesce(protein_g, 0)", "coalesce(carb_g, 0)", "coalesce(fat_g, 0)"


def _gap(a: str, b: str) -> str:
    return f"abs({a} - {b}) / greatest(5.0, {a}, {b})"


def _fits(b: str, m: str) -> str:
    plain = "greatest(" + ", ".join(_gap(f"{b}.{x}", f"{m}.{x}") for x in ("mp", "mc", "mf")) + ")"
    lean = "greatest(" + ", ".join(
        _gap(f"{b}.{x} * 100 / greatest(1.0, 100.0 - {b}.mf)", f"{m}.{x} * 100 / greatest(1.0, 100.0 - {m}.mf)")
        for x in ("mp", "mc")) + ")"
    return f"(CASE WHEN {b}.vf THEN {lean} ELSE {plain} END) <= 0.2"


_METHODS = sql_list(COOKED_METHODS)
_AT = ("list_position([(g.parent IS NULL OR x[1].parent IS NULL OR g.parent = x[1].parent) AND "
       f"list_bool_and([{_fits('x[1].members[1]', 'm')} FOR m IN g.members]) FOR g IN acc], true)")

# The whole split in SQL: buckets, the ordered fold, absorption, the final order.
SPLIT_SQL = f"""{PIVOT_SQL}, {KEYED_SQL},
member AS (SELECT g.*, {_P} AS p, {_C} AS c, {_F} AS fat, coalesce(n_nutrients, 0) AS nn FROM grouped g LEFT JOIN wide USING (fdc_id)),
fatty AS (SELECT base_key, item_kind, bool_or(fat_percentage IS NOT NULL) AS vf, bool_or(brand_flagged) AS bf FROM member GROUP BY 1, 2),
bucket AS (SELECT base_key, item_kind, prep_label AS label, count(*) AS n, sum(p) AS sp, sum(c) AS sc, sum(fat) AS sf,
  round(sum(p) / count(*), 9) AS mp, round(sum(c) / count(*), 9) AS mc, round(sum(fat) / count(*), 9) AS mf,
  CASE WHEN prep_label IN {_METHODS} THEN 'cooked' ELSE prep_label END AS parent FROM member GROUP BY 1, 2, 3),
ordered AS (SELECT base_key, item_kind, list([{{'parent': parent, 'members': [{{'label': label, 'n': n, 'sp': sp, 'sc': sc, 'sf': sf, 'mp': mp, 'mc': mc, 'mf': mf, 'vf': vf}}]}}]
  ORDER BY label IS NULL, -mp, coalesce(label, '')) AS bs FROM bucket JOIN fatty USING (base_key, item_kind) GROUP BY 1, 2),
folded AS (SELECT base_key, item_kind, list_reduce(bs, lambda acc, x: CASE WHEN coalesce({_AT}, 0) > 0
  THEN [CASE WHEN i = {_AT} THEN {{'parent': coalesce(g.parent, x[1].parent), 'members': list_concat(g.members, x[1].members)}} ELSE g END FOR g, i IN acc]
  ELSE list_concat(acc, x) END) AS gs FROM ordered),
split0 AS (SELECT base_key, item_kind, unnest(gs) AS g FROM folded),
split1 AS (SELECT base_key, item_kind, row_number() OVER () AS pid, g.members AS ms,
  list_distinct([m.label FOR m IN g.members IF m.label IS NOT NULL]) AS named FROM split0),
split2 AS (SELECT *, CASE WHEN len(named) = 1 THEN named[1] WHEN len(named) > 1 THEN (CASE WHEN list_min(named) IN {_METHODS} THEN 'cooked' ELSE list_min(named) END) END AS label,
  len([x FOR x IN named IF x IN {_METHODS}]) > 0 AS states FROM split1),
shape AS (SELECT base_key, item_kind, count(*) FILTER (WHERE label = 'cooked' AND NOT states) AS loose, count(*) FILTER (WHERE label IN {_METHODS}) AS meth,
  min(pid) FILTER (WHERE label IN {_METHODS}) AS target FROM split2 GROUP BY 1, 2),
split3 AS (SELECT s.base_key, s.item_kind, CASE WHEN loose = 1 AND meth = 1 AND label = 'cooked' AND NOT states THEN target ELSE pid END AS pid, ms,
  CASE WHEN loose = 1 AND meth = 1 AND label = 'cooked' AND NOT states THEN NULL ELSE label END AS label FROM split2 s JOIN shape USING (base_key, item_kind)),
prep_label_of AS (SELECT pid, max(label) AS prep_type FROM split3 GROUP BY 1),
placed AS (SELECT base_key, item_kind, pid, unnest(ms).label AS bucket_label FROM split3),
linked AS (SELECT m.*, pid FROM member m JOIN placed b ON m.base_key = b.base_key AND m.item_kind = b.item_kind AND m.prep_label IS NOT DISTINCT FROM b.bucket_label),
prep1 AS (SELECT base_key, item_kind, pid, count(*) AS n_foods, sum(p) / count(*) AS protein_g, sum(c) / count(*) AS carb_g, sum(fat) / count(*) AS fat_g,
  arg_min(fdc_id, (-nn, length(description), fdc_id)) AS prep_id, arg_min(food_category, (-nn, length(description), fdc_id)) AS cat,
  arg_min(fdc_id, (-round(p + c + fat, 9), fdc_id)) AS lead FROM linked GROUP BY 1, 2, 3),
prep2 AS (SELECT *, row_number() OVER (PARTITION BY base_key, item_kind ORDER BY -(round(protein_g, 9) + round(carb_g, 9) + round(fat_g, 9)), lead) - 1 AS seq FROM prep1),
item AS (SELECT base_key, item_kind, arg_max(prep_id, (n_foods, -seq)) AS merged_food_id, arg_max(cat, (n_foods, -seq)) AS food_category,
  CAST(sum(n_foods) AS BIGINT) AS n_foods, count(*) AS n_preps FROM prep2 GROUP BY 1, 2)"""


@query("item_groups", f"""
WITH {KEYED_SQL} SELECT base_key, item_kind, count(*) AS n_foods, min(fdc_id) AS first_food, max(fdc_id) AS last_food
FROM grouped WHERE base_name IS NOT NULL GROUP BY 1, 2""")
def item_groups(spark, sf):
    keyed = c.identified(roles.foods(spark, sf)).filter(F.col("base_name").isNotNull())
    per_kind = keyed.groupBy("base_key", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("fdc_id").alias("lo"), F.max("fdc_id").alias("hi"))
    voted = c.voted_kinds(c.key_votes(keyed))
    return per_kind.join(voted, "base_key", "left").groupBy(
        "base_key", F.coalesce("voted", "kind").alias("item_kind")).agg(
        F.sum("n").alias("n_foods"), F.min("lo").alias("first_food"), F.max("hi").alias("last_food"))


@query("kind_vote", f"""
WITH {KEYED_SQL} SELECT base_key, winner AS voted FROM ruled WHERE n_kinds > 1 AND NOT two""")
def kind_vote(spark, sf):
    return c.voted_kinds(c.key_votes(c.identified(roles.foods(spark, sf))))


@query("kind_splits", f"WITH {KEYED_SQL} SELECT base_key, n_kinds FROM ruled WHERE n_kinds > 1 AND two")
def kind_splits(spark, sf):
    return diagnostics.kind_splits(roles.foods(spark, sf))


@query("spelling_splits", f"WITH {KEYED_SQL} SELECT base_key, n_foods FROM ruled WHERE two")
def spelling_splits(spark, sf):
    return diagnostics.spelling_splits(roles.foods(spark, sf))


_LEAKY = "CASE WHEN p_size > 30 AND p_type <> 'PROMO' THEN concat(CASE WHEN p_size > 40 THEN 'fried ' ELSE 'dried ' END, p_name) ELSE p_name END"


@query("leaked_words", f"""
WITH b AS (SELECT {_LEAKY} AS base_name, CASE WHEN p_brand < 'Brand#2' THEN 'dish' ELSE 'ingredient' END AS kind FROM part),
known AS (SELECT DISTINCT {sql_key('base_name')} AS k, kind FROM b),
leak AS (SELECT k, kind, unnest([w FOR w IN list_distinct(string_split(k, ' ')) IF w IN {sql_list(PREP_TYPES)}]) AS w FROM known)
SELECT DISTINCT k AS base_key FROM leak WHERE (array_to_string([x FOR x IN string_split(k, ' ') IF x <> w], ' '), kind) IN (SELECT (k, kind) FROM known)""")
def leaked_words(spark, sf):
    foods = roles.table(spark, sf, "part").selectExpr(
        "p_partkey AS fdc_id", f"{_LEAKY} AS base_name",
        "CASE WHEN p_brand < 'Brand#2' THEN 'dish' ELSE 'ingredient' END AS food_kind")
    return diagnostics.leaked_words(foods)


@query("prep_split", f"""
WITH {SPLIT_SQL}
SELECT merged_food_id, CAST(seq AS BIGINT) AS seq, prep_id, prep_type, p.n_foods, round(protein_g, 6) AS protein_g, round(carb_g, 6) AS carb_g, round(fat_g, 6) AS fat_g
FROM prep2 p JOIN item USING (base_key, item_kind) JOIN prep_label_of USING (pid)""")
def prep_split(spark, sf):
    return clusters(spark, sf).preps.select(
        "merged_food_id", F.col("seq").cast("bigint").alias("seq"), "prep_id", "prep_type",
        F.col("n_foods").cast("bigint").alias("n_foods"), *[F.round(m, 6).alias(m) for m in MERGE_MACROS])


@query("cluster_items", f"""
WITH {SPLIT_SQL},
dig AS (SELECT base_key, item_kind, bit_xor(('0x' || substr(md5(CAST(fdc_id AS VARCHAR)), 1, 15))::BIGINT) AS d1,
  bit_xor(('0x' || substr(md5(CAST(fdc_id AS VARCHAR)), 16, 15))::BIGINT) AS d2, max(source_version) AS source_version FROM grouped GROUP BY 1, 2)
SELECT merged_food_id, concat(n_foods, '-', to_hex(d1), '-', to_hex(d2)) AS member_key, n_foods, n_preps, food_category,
  CAST(vf AS BIGINT) AS variable_fat, CAST(bf AS BIGINT) AS brand_flagged, source_version
FROM item JOIN fatty USING (base_key, item_kind) JOIN dig USING (base_key, item_kind)""")
def cluster_items(spark, sf):
    return clusters(spark, sf).items.select(
        "merged_food_id", "member_key", F.col("n_foods").cast("bigint").alias("n_foods"),
        F.col("n_preps").cast("bigint").alias("n_preps"), "food_category",
        F.col("variable_fat").cast("bigint").alias("variable_fat"),
        F.col("brand_flagged").cast("bigint").alias("brand_flagged"), "source_version")


@query("cluster_links", f"""
WITH {SPLIT_SQL}
SELECT l.fdc_id, merged_food_id, prep_id FROM linked l JOIN prep2 p USING (pid) JOIN item i ON i.base_key = p.base_key AND i.item_kind = p.item_kind""")
def cluster_links(spark, sf):
    return clusters(spark, sf).links


@query("unstated_preps", f"""
WITH {SPLIT_SQL}
SELECT DISTINCT prep_id, prep_type FROM linked l JOIN prep2 p USING (pid) JOIN prep_label_of USING (pid)
WHERE prep_type IS NOT NULL AND l.prep_label IS NULL""")
def unstated_preps(spark, sf):
    got = clusters(spark, sf)
    return diagnostics.unstated_preps(roles.foods(spark, sf), got.preps, got.links)


@query("cluster_summary", f"""
WITH {SPLIT_SQL}, leak AS (SELECT DISTINCT k.base_key, k.kind, unnest([w FOR w IN list_distinct(string_split(base_key, ' ')) IF w IN {sql_list(PREP_TYPES)}]) AS w FROM keyed k)
SELECT (SELECT count(*) FROM f) AS foods, (SELECT count(*) FROM f WHERE base_name IS NULL) AS uncanonicalized,
  (SELECT count(*) FROM f WHERE food_kind = 'dish') AS dishes, (SELECT count(*) FROM item) AS items, (SELECT CAST(sum(n_preps) AS BIGINT) FROM item) AS preps,
  (SELECT count(*) FROM item WHERE n_foods > 1) AS multi_food_items, (SELECT count(*) FROM item WHERE n_preps > 1) AS multi_prep_items,
  (SELECT count(*) FROM fatty WHERE vf) AS variable_fat, (SELECT max(n_foods) FROM item) AS largest_item,
  (SELECT count(*) FROM ruled WHERE n_kinds > 1 AND two) AS kind_splits, (SELECT count(*) FROM ruled WHERE two) AS spelling_splits,
  (SELECT count(DISTINCT l.base_key) FROM leak l WHERE (array_to_string([x FOR x IN string_split(base_key, ' ') IF x <> w], ' '), kind) IN (SELECT (base_key, kind) FROM keyed)) AS leaked_words,
  (SELECT count(DISTINCT prep_id) FROM linked l JOIN prep2 p USING (pid) JOIN prep_label_of USING (pid) WHERE prep_type IS NOT NULL AND l.prep_label IS NULL) AS unstated_preps""")
def cluster_summary(spark, sf):
    foods = cluster_foods(spark, sf)
    return diagnostics.cluster_summary(foods, c.cluster(foods, hold=lambda df: materialise(df, "items")))


@query("cluster_members", f"""
WITH {SPLIT_SQL}
SELECT i.merged_food_id, CAST(seq AS BIGINT) AS seq, prep_type, CAST(l.fdc_id = prep_id AS BIGINT) AS representative, l.fdc_id, l.description,
  round(l.p0, 3) AS p, round(l.c0, 3) AS c, round(l.f0, 3) AS f
FROM (SELECT linked.*, w.protein_g / nullif(p + c + fat, 0) AS p0, w.carb_g / nullif(p + c + fat, 0) AS c0, w.fat_g / nullif(p + c + fat, 0) AS f0 FROM linked LEFT JOIN wide w USING (fdc_id)) l
JOIN prep2 pp USING (pid) JOIN item i ON i.base_key = pp.base_key AND i.item_kind = pp.item_kind JOIN prep_label_of USING (pid)""")
def cluster_members(spark, sf):
    foods = cluster_foods(spark, sf)
    got = c.cluster(foods, hold=lambda df: materialise(df, "items"))
    linked, _ = relink(foods.withColumns({"merged_food_id": F.lit(None).cast("bigint"), "prep_id": F.lit(None).cast("bigint")}), got.links)
    rows = diagnostics.members_of(linked.drop(*MERGE_MACROS), got.preps, foods)
    return rows.select("merged_food_id", F.col("seq").cast("bigint").alias("seq"), "prep_type",
                       F.col("representative").cast("bigint").alias("representative"), "fdc_id", "description", "p", "c", "f")


@query("identity_browser", f"""
WITH {KEYED_SQL},
head AS (SELECT base_key, min(food_kind) AS food_kind, count(*) AS n, coalesce(string_agg(DISTINCT prep_label, ', ' ORDER BY prep_label), '') AS labels FROM keyed GROUP BY 1 ORDER BY n DESC, base_key LIMIT 500),
first AS (SELECT base_key, description, row_number() OVER (PARTITION BY base_key ORDER BY length(description), fdc_id) AS rn FROM keyed)
SELECT h.base_key, h.food_kind, h.n, h.labels, string_agg(description, ' | ' ORDER BY rn) AS members
FROM head h JOIN first USING (base_key) WHERE rn <= 4 GROUP BY 1, 2, 3, 4""")
def identity_browser(spark, sf):
    return diagnostics.identity_browser(roles.foods(spark, sf))


@query("capped_descriptions", f"""
WITH f AS ({roles.FOODS_SQL}), r AS (SELECT food_category, description, row_number() OVER (PARTITION BY food_category ORDER BY length(description), fdc_id) AS rn FROM f)
SELECT food_category, string_agg(description, ' | ' ORDER BY rn) AS descs FROM r WHERE rn <= 4 GROUP BY 1""")
def capped_descriptions(spark, sf):
    rows = roles.foods(spark, sf).select(F.col("food_category"), "fdc_id", "description")
    return first_descriptions(rows, "food_category").select("food_category", F.array_join("descs", " | ").alias("descs"))


# The same foods before the last change: some members regrouped, some verified by hand.
_MERGE_SQL = f"""{SPLIT_SQL},
fresh AS (SELECT merged_food_id, CAST(n_foods AS VARCHAR) AS member_key, n_foods, n_preps FROM item),
old AS (SELECT p_partkey AS merged_food_id, CASE WHEN p_size > 20 THEN 'stale' ELSE coalesce(member_key, 'none') END AS member_key, p_name AS display_name, p_size > 35 AS human_verified
  FROM part LEFT JOIN fresh ON merged_food_id = p_partkey WHERE p_type <> 'SMALL'),
m AS (SELECT coalesce(o.merged_food_id, n.merged_food_id) AS id, o.member_key AS ok, n.member_key AS nk, o.display_name, coalesce(o.human_verified, false) AS hv,
  o.merged_food_id IS NULL AS created, n.merged_food_id IS NULL AS gone, n.n_foods AS nf FROM old o FULL JOIN fresh n ON o.merged_food_id = n.merged_food_id),
s AS (SELECT *, NOT created AND NOT gone AND NOT hv AND ok IS DISTINCT FROM nk AS moved FROM m)"""


def _merge(spark, sf):
    items = clusters(spark, sf).items.withColumn("member_key", F.col("n_foods").cast("string"))
    items = materialise(items, "fresh-items")
    old = roles.table(spark, sf, "part").filter("p_type <> 'SMALL'").withColumnRenamed(
        "p_partkey", "merged_food_id").join(items.select("merged_food_id", F.col("member_key").alias("mk")), "merged_food_id", "left").select(
        "merged_food_id", F.when(F.col("p_size") > 20, F.lit("stale")).otherwise(F.coalesce("mk", F.lit("none"))).alias("member_key"),
        F.col("p_name").alias("display_name"), (F.col("p_size") > 35).alias("human_verified"),
        F.lit("auto_approved").alias("review_status"), F.lit(1).alias("n_foods"))
    return merge_clusters(conform(old, ITEMS), items)


@query("merge_clusters", f"""
WITH {_MERGE_SQL}
SELECT id AS merged_food_id, CASE WHEN created OR (NOT gone AND NOT hv) THEN nk ELSE ok END AS member_key, display_name,
  CASE WHEN created OR moved THEN 'pending' ELSE 'auto_approved' END AS review_status, CAST(hv AS BIGINT) AS human_verified, CAST(gone AS BIGINT) AS dissolved,
  CAST(CASE WHEN created OR (NOT gone AND NOT hv) THEN nf ELSE 1 END AS BIGINT) AS n_foods FROM s WHERE NOT gone OR hv""")
def merged_clusters(spark, sf):
    return _merge(spark, sf).snapshot.select(
        "merged_food_id", "member_key", "display_name", "review_status", F.col("human_verified").cast("bigint").alias("human_verified"),
        F.col("dissolved").cast("bigint").alias("dissolved"), F.col("n_foods").cast("bigint").alias("n_foods"))


@query("merge_clusters_audit", f"""
WITH {_MERGE_SQL}
SELECT id AS fdc_id, 'group_dissolved' AS field, display_name AS old_value, NULL AS new_value, CASE WHEN hv THEN 'human' ELSE 'auto' END AS actor FROM s WHERE gone
UNION ALL SELECT id, 'member_key', ok, nk, 'auto' FROM s WHERE moved
UNION ALL SELECT id, 'group_created', NULL, nk, 'auto' FROM s WHERE created""")
def merge_audit(spark, sf):
    return _merge(spark, sf).audit.select("fdc_id", "field", "old_value", "new_value", "actor")


@query("merge_clusters_counts", f"""
WITH {_MERGE_SQL}
SELECT count(*) FILTER (WHERE created) AS created, count(*) FILTER (WHERE moved) AS requeued, count(*) FILTER (WHERE gone) AS dissolved FROM s""")
def merge_counts(spark, sf):
    return _merge(spark, sf).counts


