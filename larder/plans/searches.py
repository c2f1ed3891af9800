"""Bulk search over the standard tables: every part is an item, every part name a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import fixed
from larder.operators import catalog, search
from larder.plans import roles
from larder.plans.registry import query

TOKENS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
FIELDS = ("name", "prep", "aka", "members")


def sql_tokens(c: str) -> str:
    return TOKENS.format(c)


def bm25_sql(docs: str, key: str, fields: dict[str, float], queries: str, prefix: bool = True, every: bool = True,
             grams: bool = False) -> str:
    """The index, the matches and the score as plain SQL over a docs and a queries relation."""
    tok = (lambda c: f"[substr(lower({c}), i, 3) FOR i IN range(1, greatest(length({c}) - 1, 1))]") if grams else sql_tokens
    posts = " UNION ALL ".join(f"SELECT {key} AS item_id, unnest({tok(f)}) AS token, {w}::DOUBLE AS w FROM {docs}" for f, w in fields.items())
    size = " + ".join(f"coalesce(len({tok(f)}), 0)" for f in fields)
    terms = ("[g FOR g IN list_distinct([substr(lower(text), i, 3) FOR i IN range(1, greatest(length(text) - 1, 1))]) IF length(trim(g)) = 3]"
             if grams else sql_tokens('text'))
    match = "starts_with(token, term)" if prefix else "token = term"
    return f"""post AS ({posts}),
lens AS (SELECT {key} AS item_id, {size} AS len FROM {docs}), corpus AS (SELECT count(*) AS docs, avg(len) AS avg_len FROM lens),
term AS (SELECT query_id, term, count(*) AS times, len(list_distinct(any_value(ts))) AS n_terms FROM (SELECT query_id, {terms} AS ts, unnest({terms}) AS term FROM {queries}) GROUP BY 1, 2),
vocab AS (SELECT DISTINCT token FROM post), hit AS (SELECT DISTINCT term, token FROM (SELECT DISTINCT term FROM term) JOIN vocab ON {match}),
freq AS (SELECT term, item_id, sum(w) AS f FROM hit JOIN post USING (token) GROUP BY 1, 2), df AS (SELECT term, count(*) AS n FROM freq GROUP BY 1),
idf AS (SELECT term, CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END AS idf, avg_len FROM df, corpus),
part_score AS (SELECT term, item_id, -idf * (f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)) AS s FROM freq JOIN idf USING (term) JOIN lens USING (item_id)),
matched AS (SELECT query_id, item_id, sum(times * s) AS rank FROM term JOIN part_score USING (term) GROUP BY 1, 2 {'HAVING count(*) = max(n_terms)' if every else ''})"""


# Each part is an item of its own; its name, label, brand and type are the indexed text.
DOCS_SQL = f"""fd AS ({roles.FOODS_SQL}),
docs AS (SELECT p_partkey AS id, p_name AS name, coalesce(prep_label, '') AS prep, p_brand AS aka, concat(lower(p_type), ' ', description) AS members,
  lower(concat_ws(' ', p_name, coalesce(prep_label, ''), p_brand)) AS trgm FROM part JOIN fd ON fdc_id = p_partkey),
queries AS (SELECT min(p_partkey) AS query_id, concat(substr(split_part(p_name, ' ', 1), 1, 2), '  ', substr(split_part(p_name, ' ', 2), 1, 4)) AS text FROM part GROUP BY p_name),
typos AS (SELECT min(p_partkey) AS query_id, concat(substr(p_name, 1, 2), substr(p_name, 4, 1), substr(p_name, 3, 1), substr(p_name, 5)) AS text FROM part GROUP BY p_name)"""
WEIGHTS = {f: fixed.INDEX_WEIGHTS[f] for f in FIELDS}


def docs(spark, sf):
    foods = roles.foods(spark, sf).select(F.col("fdc_id").alias("p_partkey"), "prep_label", "description")
    return roles.table(spark, sf, "part").join(foods, "p_partkey").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.coalesce("prep_label", F.lit("")).alias("prep"),
        F.col("p_brand").alias("aka"), F.concat_ws(" ", F.lower("p_type"), "description").alias("members"),
        F.lower(F.concat_ws(" ", "p_name", F.coalesce("prep_label", F.lit("")), "p_brand")).alias("trgm"))


def _names(spark, sf):
    return roles.table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))


def queries(spark, sf):
    return _names(spark, sf).selectExpr(
        "query_id", "concat(substr(split_part(p_name, ' ', 1), 1, 2), '  ', substr(split_part(p_name, ' ', 2), 1, 4)) AS text")


def typos(spark, sf):
    return _names(spark, sf).selectExpr(
        "query_id", "concat(substr(p_name, 1, 2), substr(p_name, 4, 1), substr(p_name, 3, 1), substr(p_name, 5)) AS text")


def items(spark, sf):
    return roles.foods(spark, sf).select(
        F.col("fdc_id").alias("merged_food_id"), F.col("base_name").alias("display_name"), F.lit(None).cast("string").alias("emoji"),
        F.when(F.col("food_kind") == "dish", F.lit(0.9)).alias("commonness"), F.col("prep_label").alias("prep_type"), F.lit(1).alias("n_preps"))


def foods(spark, sf):
    none = F.lit(None).cast("double")
    return roles.foods(spark, sf).select(
        F.col("fdc_id").alias("food_id"), F.col("fdc_id").alias("merged_food_id"),
        F.when(F.col("brand_flagged"), F.concat("description", F.lit(" restaurant"))).otherwise(F.col("description")).alias("description"),
        *[none.alias(f"{c}_100g") for c in ("kcal", "protein", "fat", "carb")], none.alias("serving_g"), F.lit(None).cast("string").alias("serving_label"))


def _rounded(df, c="rank"):
    return df.select("query_id", "item_id", F.round(c, 6).alias(c))


@query("search_prefix", f"""
WITH {DOCS_SQL}, {bm25_sql('docs', 'id', WEIGHTS, 'queries')} SELECT query_id, item_id, round(rank, 6) AS rank FROM matched""")
def search_prefix(spark, sf):
    return _rounded(search.prefix_hits(queries(spark, sf), search.build_index(docs(spark, sf), "id", FIELDS)))


@query("search_trigram", f"""
WITH {DOCS_SQL}, {bm25_sql('docs', 'id', {'trgm': 1.0}, 'typos', prefix=False, every=False, grams=True)} SELECT query_id, item_id, round(rank, 6) AS rank FROM matched""")
def search_trigram(spark, sf):
    return _rounded(search.gram_hits(typos(spark, sf), search.build_gram_index(docs(spark, sf), "id", "trgm")))


@query("search_fuzzy", f"""
WITH {DOCS_SQL}, {bm25_sql('docs', 'id', {'trgm': 1.0}, 'typos', prefix=False, every=False, grams=True)},
r AS (SELECT query_id, round(rank, 6) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, item_id) AS place FROM matched)
SELECT query_id, place, rank FROM r WHERE place <= 30""")
def search_fuzzy(spark, sf):
    """The thirty best ranks of every misspelt name; most documents are never scored."""
    hits = search.fuzzy_hits(typos(spark, sf), search.build_gram_index(docs(spark, sf), "id", "trgm"), fixed.SEARCH_LIMIT)
    best = search.top_k(hits, ["query_id"], [F.col("rank"), F.col("item_id")], fixed.SEARCH_LIMIT, "place")
    return best.select("query_id", F.col("place").cast("bigint").alias("place"), F.round("rank", 6).alias("rank"))


# Names with a hyphen for the blank, in order and turned round: a phrase, then a second term.
_PHRASES_SQL = """asked AS (SELECT min(p_partkey) AS query_id, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b FROM part GROUP BY p_name),
phrased AS (SELECT query_id, a, substr(b, 1, 3) AS b FROM asked UNION ALL SELECT query_id + 1000000, b, a FROM asked)"""


@query("search_phrase", f"""
WITH {DOCS_SQL}, {_PHRASES_SQL}, {', '.join(f"{f} AS (SELECT id, {sql_tokens(f)} AS t, {WEIGHTS[f]}::DOUBLE AS w FROM docs)" for f in FIELDS)},
field AS ({' UNION ALL '.join(f'SELECT * FROM {f}' for f in FIELDS)}),
lens AS (SELECT id, sum(len(t)) AS len FROM field GROUP BY 1), corpus AS (SELECT count(*) AS docs, avg(len) AS avg_len FROM lens),
pair AS (SELECT id, w, t[i] AS a, t[i + 1] AS b FROM (SELECT id, w, t, unnest(range(1, len(t))) AS i FROM field)),
phrase AS (SELECT query_id, id, sum(w) AS pf FROM phrased JOIN pair ON phrased.a = pair.a AND starts_with(pair.b, phrased.b) GROUP BY 1, 2),
brand AS (SELECT id, sum(w * len(list_filter(t, lambda x: starts_with(x, 'brand')))) AS bf FROM field GROUP BY 1 HAVING bf > 0),
scored AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS pn, (SELECT count(*) FROM brand) AS bn FROM phrase)
SELECT query_id, id AS item_id, round(-(greatest(ln((docs - pn + 0.5) / (pn + 0.5)), 1e-6) * pf * 2.2::DOUBLE / (pf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))
  + greatest(ln((docs - bn + 0.5) / (bn + 0.5)), 1e-6) * bf * 2.2::DOUBLE / (bf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS rank FROM scored JOIN brand USING (id) JOIN lens USING (id), corpus""")
def search_phrase(spark, sf):
    words = "lower(split_part(p_name, ' ', {}))".format
    names = _names(spark, sf)
    asked = names.selectExpr("query_id", f"concat({words(1)}, '-', substr({words(2)}, 1, 3), ' brand') AS text").unionByName(
        names.selectExpr("query_id + 1000000 AS query_id", f"concat({words(2)}, '-', {words(1)}, ' brand') AS text"))
    return _rounded(search.prefix_hits(asked, search.build_index(docs(spark, sf), "id", FIELDS)))


@query("search_documents", f"""
WITH q AS (SELECT item_id AS query_id, text FROM benchmark), d AS (SELECT doc_id, source, text AS body FROM documents),
{bm25_sql('d', 'doc_id', {'source': 2.0, 'body': 1.0}, 'q')} SELECT query_id, item_id, round(rank, 6) AS rank FROM matched""")
def search_documents(spark, sf):
    corpus = roles.table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("body"))
    asked = roles.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = search.build_index(corpus, "doc_id", ("source", "body"))
    return _rounded(search.prefix_hits(asked, index, {"source": 2.0, "body": 1.0}))


RECENT_SQL = f"""recent AS (SELECT food_id AS item_id, count(*) AS n FROM ({roles.LOG_SQL}) WHERE deleted = 0 AND food_id IS NOT NULL AND local_date >= '2023-11-02' GROUP BY 1)"""
_FACTS = f"""item AS (SELECT fdc_id AS item_id, base_name AS display_name, CASE WHEN food_kind = 'dish' THEN 0.9::DOUBLE END AS commonness, prep_label AS prep_type,
  CASE WHEN brand_flagged THEN concat(description, ' restaurant') ELSE description END AS description FROM fd),
{RECENT_SQL}"""


def score_sql(rank: str, text: str) -> str:
    return f"""round({rank} * (1 + coalesce(commonness, 0.4::DOUBLE) + 0.3::DOUBLE * CAST(coalesce(prep_type = 'cooked', false) AS INTEGER) + 1.5::DOUBLE * (least(coalesce(n, 0), 3) / 3.0::DOUBLE)
  + 0.6::DOUBLE * CAST(lower(coalesce(display_name, description)) = lower(trim({text})) AS INTEGER) - 0.3::DOUBLE * CAST(contains(lower(concat(coalesce(display_name, ''), ' ', description)), 'restaurant') AS INTEGER)), 9)"""


@query("search_composite", f"""
WITH {DOCS_SQL}, {bm25_sql('docs', 'id', WEIGHTS, 'queries')}, {_FACTS},
s AS (SELECT query_id, item_id, {score_sql('rank', 'text')} AS score FROM matched JOIN queries USING (query_id) JOIN item USING (item_id) LEFT JOIN recent USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS rn FROM s)
SELECT query_id, item_id AS food_id, round(score, 6) AS score, rn AS place FROM r WHERE rn <= 10""")
def search_composite(spark, sf):
    index = search.build_index(docs(spark, sf), "id", FIELDS)
    hits = search.primary_search(queries(spark, sf), index, items(spark, sf), foods(spark, sf), roles.log(spark, sf), roles.AS_OF)
    return hits.select("query_id", "food_id", F.round("score", 6).alias("score"), F.col("rn").cast("bigint").alias("place"))


@query("recency_counts", f"""
SELECT food_id % 7 AS item_id, count(*) AS n FROM ({roles.LOG_SQL}) JOIN part ON p_partkey = food_id WHERE deleted = 0 AND local_date >= '2023-11-02' GROUP BY 1""")
def recency_counts(spark, sf):
    members = roles.table(spark, sf, "part").selectExpr("p_partkey AS food_id", "p_partkey % 7 AS merged_food_id")
    return search.recent_counts(roles.log(spark, sf), members, roles.AS_OF)


# Own foods are searched by the start of each nation's name and by dish numbers.
_CUSTOM = f"""c AS (SELECT * FROM ({roles.CUSTOM_SQL}) WHERE deleted = 0),
cq AS (SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 2 = 0 THEN concat('DISH ', n_nationkey) WHEN n_nationkey % 3 = 0 THEN concat('#00000', n_nationkey) ELSE substr(CAST(n_nationkey AS VARCHAR), 1, 1) END AS text FROM nation),
crecent AS (SELECT custom_food_id AS id, count(*) AS n, max(logged_at) AS last_at FROM ({roles.LOG_SQL}) WHERE deleted = 0 AND custom_food_id IS NOT NULL AND local_date >= '2023-11-02' GROUP BY 1),
cr AS (SELECT query_id, c.id, c.name, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(n, 0) DESC, last_at DESC NULLS LAST, c.name, c.id) AS rn
  FROM cq JOIN c ON contains(lower(concat(c.name, ' ', coalesce(c.brand, ''))), lower(cq.text)) LEFT JOIN crecent USING (id))"""


def custom_queries(spark, sf):
    return roles.table(spark, sf, "nation").selectExpr(
        "n_nationkey AS query_id", "CASE WHEN n_nationkey % 2 = 0 THEN concat('DISH ', n_nationkey) WHEN n_nationkey % 3 = 0 THEN concat('#00000', n_nationkey) ELSE substr(CAST(n_nationkey AS STRING), 1, 1) END AS text")


@query("search_custom", f"WITH {_CUSTOM} SELECT query_id, id, name, rn AS place FROM cr WHERE rn <= 20")
def search_custom(spark, sf):
    hits = search.custom_search(custom_queries(spark, sf), roles.custom_foods(spark, sf), roles.log(spark, sf), roles.AS_OF)
    return hits.select("query_id", "id", "name", F.col("rn").cast("bigint").alias("place"))


def _prefixed(sql: str, p: str) -> str:
    """The bm25 relations under other names, so two of them fit in one statement."""
    import re
    for name in ("post", "lens", "corpus", "term", "vocab", "hit", "freq", "df", "idf", "part_score", "matched"):
        sql = re.sub(rf"\b{name} AS \(", f"{p}_{name} AS (", sql)
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {p}_{name}", sql)
    sql = sql.replace(", corpus)", f", {p}_corpus)")
    return sql


_FULL = f"""WITH {DOCS_SQL}, {_FACTS}, {_CUSTOM},
both_q AS (SELECT query_id, text FROM queries UNION ALL SELECT query_id + 1000000, text FROM typos UNION ALL SELECT query_id + 2000000, text FROM cq),
{_prefixed(bm25_sql('docs', 'id', WEIGHTS, 'both_q'), 'a')},
s1 AS (SELECT query_id, item_id, {score_sql('rank', 'text')} AS score FROM a_matched JOIN both_q USING (query_id) JOIN item USING (item_id) LEFT JOIN recent USING (item_id)),
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS rn FROM s1) WHERE rn <= 30),
short AS (SELECT * FROM both_q WHERE query_id NOT IN (SELECT query_id FROM r1 GROUP BY 1 HAVING count(*) >= 5)),
{_prefixed(bm25_sql('docs', 'id', {'trgm': 1.0}, 'short', prefix=False, every=False, grams=True), 'b')},
s2 AS (SELECT query_id, item_id, {score_sql('rank', 'text')} AS score FROM b_matched JOIN both_q USING (query_id) JOIN item USING (item_id) LEFT JOIN recent USING (item_id)),
r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS rn FROM s2) WHERE rn <= 30),
all_c AS (SELECT b.query_id, c.id, row_number() OVER (PARTITION BY b.query_id ORDER BY coalesce(n, 0) DESC, last_at DESC NULLS LAST, c.name, c.id) AS rn
  FROM both_q b JOIN c ON contains(lower(concat(c.name, ' ', coalesce(c.brand, ''))), lower(trim(b.text))) LEFT JOIN crecent USING (id))
SELECT query_id, CAST(0 AS BIGINT) AS tier, rn AS place, CAST(NULL AS BIGINT) AS food_id, id AS custom_food_id FROM all_c WHERE rn <= 20
UNION ALL SELECT query_id, 1, rn, item_id, NULL FROM r1
UNION ALL SELECT query_id, 2, rn, item_id, NULL FROM r2 WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.query_id = r2.query_id AND r1.item_id = r2.item_id)"""


@query("search_full", _FULL)
def search_full(spark, sf):
    corpus = docs(spark, sf)
    asked = queries(spark, sf).unionByName(typos(spark, sf).withColumn("query_id", F.col("query_id") + 1000000)).unionByName(
        custom_queries(spark, sf).withColumn("query_id", (F.col("query_id") + 2000000).cast("bigint")))
    hits = search.search(asked, search.build_index(corpus, "id", FIELDS), search.build_gram_index(corpus, "id", "trgm"),
                         items(spark, sf), foods(spark, sf), roles.log(spark, sf), roles.custom_foods(spark, sf), roles.AS_OF)
    return hits.select("query_id", F.col("tier").cast("bigint").alias("tier"), F.col("rn").cast("bigint").alias("place"), "food_id", "custom_food_id")


@query("preps_nested", f"""
WITH f AS (SELECT fdc_id AS food_id, min(fdc_id) OVER (PARTITION BY food_category, base_name) AS merged, prep_label, min(fdc_id) OVER (PARTITION BY food_category, base_name, prep_label) AS prep_id FROM ({roles.FOODS_SQL})),
p AS (SELECT merged, string_agg(concat(food_id, ':', coalesce(prep_label, 'plain')), ' ' ORDER BY food_id) AS preps, count(*) AS n FROM f WHERE food_id = prep_id GROUP BY 1)
SELECT merged AS food_id, preps, CAST(0 AS BIGINT) AS prep_index FROM p WHERE n > 1""")
def preps_nested(spark, sf):
    base = roles.foods(spark, sf).select(F.col("fdc_id").alias("food_id"), F.col("prep_label").alias("prep_type"), "food_category", "base_name")
    item = base.groupBy("food_category", "base_name").agg(F.min("food_id").alias("merged_food_id"))
    prep = base.groupBy("food_category", "base_name", "prep_type").agg(F.min("food_id").alias("prep_id"))
    none = F.lit(None).cast("double")
    same = [base[c].eqNullSafe(item[c]) for c in ("food_category", "base_name")]
    rows = base.join(item, same).select(base["*"], "merged_food_id")
    rows = rows.join(prep, [rows[c].eqNullSafe(prep[c]) for c in ("food_category", "base_name", "prep_type")]).select(rows["*"], "prep_id")
    rows = rows.withColumns({f"{c}_100g": none for c in ("kcal", "protein", "fat", "carb")}).withColumns({"serving_g": none, "serving_label": F.lit(None).cast("string")})
    hits = rows.select(F.col("merged_food_id").alias("food_id")).distinct()
    out = catalog.attach_preparations(hits, rows).filter(F.col("preps").isNotNull())
    return out.select("food_id", F.array_join(F.transform("preps", lambda p: F.concat(p["food_id"].cast("string"), F.lit(":"), p["prep"])), " ").alias("preps"),
                      F.col("prep_index").cast("bigint").alias("prep_index"))
