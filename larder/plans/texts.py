"""Text rules over product names and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import fixed
from larder.functions import labels, text
from larder.operators.diagnostics import token_frequencies
from larder.operators.relational import seeded_sample
from larder.plans import roles
from larder.plans.registry import query


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_map(pairs: dict[str, str], of: str) -> str:
    return "CASE " + of + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " END"


def sql_singular(w: str) -> str:
    """The identity singular of one word, spelled out."""
    return f"""CASE WHEN length({w}) < 4 OR regexp_matches({w}, '(ss|us|is)$') THEN {w}
      WHEN {sql_map(fixed.IRREGULAR_PLURALS, w)} IS NOT NULL THEN {sql_map(fixed.IRREGULAR_PLURALS, w)}
      WHEN NOT ends_with({w}, 's') THEN {w}
      WHEN length({w}) > 4 AND ends_with({w}, 'ies') THEN concat({w}[:-4], 'y')
      WHEN regexp_matches({w}, '(ch|sh|x|z|ss|o)es$') THEN {w}[:-3] ELSE {w}[:-2] END"""


def sql_suffix(w: str) -> str:
    return f"""CASE WHEN length({w}) > 4 AND ends_with({w}, 'es') THEN {w}[:-3]
      WHEN length({w}) > 3 AND ends_with({w}, 's') AND NOT ends_with({w}, 'ss') THEN {w}[:-2] ELSE {w} END"""


def sql_key_words(c: str) -> str:
    plain = f"regexp_replace(lower({c}), '\\d+(\\.\\d+)?\\s*%\\s*(lean|fat|milkfat)?', ' ', 'g')"
    return (f"[x FOR x IN [{sql_singular('w')} FOR w IN regexp_extract_all({plain}, '[a-z]+')] "
            f"IF x NOT IN {sql_list(fixed.KEY_STOPWORDS)}]")


def sql_key(c: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct({sql_key_words(c)})), ' '), '')"


# Distinct words in written order, for telling spellings apart.
def sql_written(c: str) -> str:
    ws = sql_key_words(c)
    return f"array_to_string([x FOR x, i IN {ws} IF list_position({ws}, x) = i], ' ')"


_WORD_LIST = "regexp_extract_all(lower({}), '[a-z]+')"


def sql_words(c: str) -> str:
    return _WORD_LIST.format(c)


@query("token_frequency", """
SELECT unnest(regexp_extract_all(lower(text), '[a-z/&'']+')) AS token, CAST(count(*) AS BIGINT) AS count
FROM documents GROUP BY 1""")
def token_frequency(spark, sf):
    return token_frequencies(roles.table(spark, sf, "documents"), "text")


def _expanded(d: str) -> str:
    """The rules without lookaround, which the oracle's dialect lacks: both sides consumed, twice where needed."""
    s = d
    s = f"regexp_replace({s}, '(^|[^\\w/])w/o($|[^\\w/])', '\\1without\\2', 'gi')"
    s = f"regexp_replace({s}, '(^|[^\\w/])w/([^o]|$)', '\\1with \\2', 'gi')"
    s = f"regexp_replace({s}, '\\bNFS\\b', 'not further specified', 'g')"
    s = f"regexp_replace({s}, '\\bNS\\b', 'not specified', 'g')"
    for short, full in (("prep", "prepared"), ("reg", "regular"), ("incl", "including"), ("approx", "approximately")):
        s = f"regexp_replace({s}, '\\b{short}\\b\\.?', '{full}', 'gi')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


@query("expand_abbrev", f"""
WITH f AS ({roles.FOODS_SQL}) SELECT fdc_id, {_expanded("description")} AS description FROM f""")
def expand_abbrev(spark, sf):
    d = F.col("description")
    return roles.foods(spark, sf).select(
        "fdc_id", labels.guarded(d, labels.expand_abbreviations(d)).alias("description"))


@query("expand_documents", f"SELECT doc_id, md5({_expanded('text')}) AS digest FROM documents")
def expand_documents(spark, sf):
    # The oracle's \\s and \\w are ASCII, so are the documents' blanks and abbreviations.
    return roles.table(spark, sf, "documents").select(
        "doc_id", F.md5(labels.expand_abbreviations(F.col("text"))).alias("digest"))


_HITS = " UNION ALL ".join(
    f"SELECT fdc_id, 'abbrev:{name}' AS rule, unnest(regexp_extract_all(description, '{pattern}', {group})) AS old_text, '{new}' AS new_text FROM f"
    for name, pattern, group, new in (
        ("w/o", "(?i)(?:^|[^\\w/])(w/o)(?:$|[^\\w/])", 1, "without"),
        ("w/", "(?i)(?:^|[^\\w/])(w/)(?:[^o]|$)", 1, "with"),
        ("NFS", "\\bNFS\\b", 0, "not further specified"), ("NS", "\\bNS\\b", 0, "not specified"),
        ("prep", "(?i)\\bprep\\b\\.?", 0, "prepared"), ("reg", "(?i)\\breg\\b\\.?", 0, "regular"),
        ("incl", "(?i)\\bincl\\b\\.?", 0, "including"), ("approx", "(?i)\\bapprox\\b\\.?", 0, "approximately")))


@query("expand_log", f"WITH f AS ({roles.FOODS_SQL}) {_HITS}")
def expand_log(spark, sf):
    return roles.foods(spark, sf).select("fdc_id", F.inline(labels.substitutions(F.col("description"))))


@query("token_guard", f"""
WITH f AS (SELECT fdc_id, description AS a, regexp_replace(description, 'raw|salt|, [a-z]+ed', '', 'g') AS b FROM ({roles.FOODS_SQL}))
SELECT fdc_id, array_to_string(list_sort([w FOR w IN list_distinct({sql_words('a')})
  IF w IN {sql_list(fixed.PRESERVE_TOKENS)} AND NOT list_contains({sql_words('b')}, w)]), ' ') AS lost FROM f""")
def token_guard(spark, sf):
    d = F.col("description")
    cut = F.regexp_replace(d, "raw|salt|, [a-z]+ed", "")
    return roles.foods(spark, sf).select("fdc_id", F.array_join(labels.lost_tokens(d, cut), " ").alias("lost"))


@query("fat_percent_extract", f"""
WITH f AS ({roles.FOODS_SQL}) SELECT fdc_id, coalesce(
  TRY_CAST(nullif(regexp_extract(description, '(?i)(\\d+(?:\\.\\d+)?)\\s*%\\s*(?:milk\\s*fat|milkfat)', 1), '') AS DOUBLE),
  TRY_CAST(nullif(regexp_extract(description, '(?i)(\\d+(?:\\.\\d+)?)\\s*%\\s*fat\\b', 1), '') AS DOUBLE),
  round(100.0 - TRY_CAST(nullif(regexp_extract(description, '(?i)(\\d+(?:\\.\\d+)?)\\s*%\\s*lean\\b', 1), '') AS DOUBLE), 2)
) AS fat_percentage FROM f""")
def fat_percent_extract(spark, sf):
    return roles.foods(spark, sf).select("fdc_id", labels.fat_percentage(F.col("description")).alias("fat_percentage"))


def _brand_sql() -> str:
    import re
    tokens = "|".join(re.sub(r"([.+*?()|&\\-])", r"\\\1", t.strip()).replace("'", "''") for t in fixed.BRAND_TOKENS)
    return f"regexp_matches({{0}}, '(?i)(^|[^\\w])({tokens})($|[^\\w])')"


_CAPS_SQL = ("len([t FOR t IN [trim(w, '.''') FOR w IN regexp_extract_all({0}, '[A-Z][A-Z''\\.]{{2,}}')] "
             f"IF length(t) >= 3 AND t NOT IN {sql_list(fixed.ALLCAPS_WHITELIST)}]) > 0")


@query("brand_flag", f"""
WITH f AS ({roles.FOODS_SQL})
SELECT fdc_id, CAST(data_type = 'sr_legacy_food' AND ({_brand_sql().format("description")} OR {_CAPS_SQL.format("description")}) AS BIGINT) AS flagged FROM f""")
def brand_flag(spark, sf):
    return roles.foods(spark, sf).select("fdc_id", labels.is_branded(
        F.col("description"), F.col("data_type")).cast("bigint").alias("flagged"))


@query("shouted_documents", f"""
SELECT lang, count(*) AS n, CAST(sum(CASE WHEN {_CAPS_SQL.format("text")} THEN 1 ELSE 0 END) AS BIGINT) AS shouted FROM documents GROUP BY 1""")
def shouted_documents(spark, sf):
    return roles.table(spark, sf, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(labels.has_shouted_word(F.col("text"))).alias("shouted"))


@query("identity_key", f"""
WITH f AS ({roles.FOODS_SQL}) SELECT fdc_id, {sql_key("base_name")} AS base_key FROM f""")
def identity_key(spark, sf):
    return roles.foods(spark, sf).select("fdc_id", text.identity_key(F.col("base_name")).alias("base_key"))


@query("document_words_singular", f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT word, {sql_singular("word")} AS noun, {sql_suffix("word")} AS stem FROM w""")
def document_words_singular(spark, sf):
    # Distinct words first: the rule runs once per word, not once per use.
    words = roles.table(spark, sf, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", text.singular_noun(F.col("word")).alias("noun"),
                        text.singular_suffix(F.col("word")).alias("stem"))


_STATED = (f"[w FOR w IN list_distinct({sql_words('description')}) IF NOT list_contains(coalesce({sql_words('base_name')}, []), w)]")


@query("prep_label_fix", f"""
WITH f AS (SELECT fdc_id, description, base_name, food_kind, CASE WHEN prep_label IN ('cooked', 'boiled') THEN 'cooked' WHEN prep_label = 'fried' THEN 'fried' END AS prep
  FROM ({roles.FOODS_SQL})),
s AS (SELECT *, {_STATED} AS stated FROM f),
n AS (SELECT *, [w FOR w IN stated IF w IN {sql_list(fixed.COOKED_METHODS)}] AS named FROM s)
SELECT fdc_id, CASE WHEN prep = 'cooked' AND len(named) = 1 THEN named[1]
  WHEN prep IS NULL AND food_kind = 'ingredient' AND NOT contains(lower(description), 'from raw')
    AND len([w FOR w IN stated IF w IN ('raw', 'unprepared', 'uncooked')]) > 0 THEN 'raw' ELSE prep END AS prep_label FROM n""")
def prep_label_fix(spark, sf):
    prep = F.when(F.col("prep_label").isin("cooked", "boiled"), F.lit("cooked")).when(
        F.col("prep_label") == "fried", F.lit("fried"))
    return roles.foods(spark, sf).select("fdc_id", labels.corrected_label(
        prep, F.col("description"), F.col("base_name"), F.col("food_kind")).alias("prep_label"))


_AMOUNT_TEXT = {
    "duck": "concat(CAST(l_linenumber AS VARCHAR), CASE WHEN l_returnflag = 'A' THEN concat(' ', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '/4') WHEN l_returnflag = 'R' THEN ' x' ELSE '.5 1/0' END)",
}


@query("parse_quantity", f"""
WITH a AS (SELECT DISTINCT {_AMOUNT_TEXT["duck"]} AS t FROM lineitem),
p AS (SELECT t, unnest(regexp_split_to_array(trim(t), '\\s+')) AS part FROM a),
v AS (SELECT t, CASE WHEN contains(part, '/') THEN
  coalesce(coalesce(TRY_CAST(split_part(part, '/', 1) AS DOUBLE), 0) / nullif(TRY_CAST(split_part(part, '/', 2) AS DOUBLE), 0), 0)
  ELSE coalesce(TRY_CAST(part AS DOUBLE), 0) END AS x FROM p)
SELECT t AS typed, round(sum(x), 6) AS amount FROM v GROUP BY 1""")
def parse_quantity(spark, sf):
    typed = F.expr(_AMOUNT_TEXT["duck"].replace("VARCHAR", "STRING"))
    rows = roles.table(spark, sf, "lineitem").select(typed.alias("typed")).distinct()
    return rows.select("typed", F.round(text.parse_amount(F.col("typed")), 6).alias("amount"))


@query("format_quantity", """
WITH q AS (SELECT DISTINCT l_quantity AS q, round(l_quantity * 3.7, 2) AS g FROM lineitem)
SELECT q, g, CAST(CAST(q AS BIGINT) AS VARCHAR) AS qty,
  CASE WHEN g >= 100 THEN CAST(CAST(round(g) AS BIGINT) AS VARCHAR)
       WHEN round(g * 10) / 10 = round(round(g * 10) / 10) THEN CAST(CAST(round(g) AS BIGINT) AS VARCHAR)
       ELSE CAST(round(g * 10) / 10 AS VARCHAR) END AS grams FROM q""")
def format_quantity(spark, sf):
    rows = roles.table(spark, sf, "lineitem").selectExpr("l_quantity AS q", "round(l_quantity * 3.7D, 2) AS g").distinct()
    return rows.select("q", "g", text.format_amount(F.col("q")).alias("qty"), text.format_grams(F.col("g")).alias("grams"))


@query("slug_id", """
SELECT s_suppkey AS id, regexp_replace(substr(regexp_replace(regexp_replace(lower(trim(t)), '[^a-z0-9]+', '_', 'g'), '^_', ''), 1, 40), '_+$', '') AS slug
FROM (SELECT s_suppkey, concat('  ', s_name, ' -- ', n_name, ' / ', s_acctbal, ' !') AS t FROM supplier JOIN nation ON n_nationkey = s_nationkey)""")
def slug_id(spark, sf):
    rows = roles.table(spark, sf, "supplier").join(
        roles.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    raw = F.concat(F.lit("  "), "s_name", F.lit(" -- "), "n_name", F.lit(" / "), F.col("s_acctbal").cast("string"), F.lit(" !"))
    return rows.select(F.col("s_suppkey").alias("id"), text.slug(raw).alias("slug"))


@query("slug_documents", """
SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '^_', ''), 1, 40), '_+$', '') AS slug FROM documents""")
def slug_documents(spark, sf):
    return roles.table(spark, sf, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("name_key", f"""
WITH t AS (SELECT fdc_id, [x FOR x IN regexp_split_to_array(lower(description), '[^\\p{{L}}\\p{{Nd}}]+') IF x <> ''] AS ws FROM ({roles.FOODS_SQL}))
SELECT fdc_id, array_to_string(list_sort([{sql_suffix('w')} FOR w IN ws]), ' ') AS name_key FROM t""")
def name_key(spark, sf):
    return roles.foods(spark, sf).select("fdc_id", text.name_key(F.col("description")).alias("name_key"))


@query("trigrams", f"""
WITH d AS (SELECT fdc_id, lower(description) AS t FROM ({roles.FOODS_SQL})),
g AS (SELECT fdc_id, unnest([substr(t, i, 3) FOR i IN range(1, greatest(length(t) - 1, 2))]) AS gram FROM d)
SELECT gram, count(DISTINCT fdc_id) AS foods FROM g WHERE length(trim(gram)) = 3 GROUP BY 1""")
def trigrams(spark, sf):
    return roles.foods(spark, sf).select(F.explode(text.trigrams(F.col("description"))).alias("gram")).groupBy(
        "gram").agg(F.count(F.lit(1)).alias("foods"))


@query("composed_name", f"""
WITH f AS ({roles.FOODS_SQL}), n AS (SELECT food_category, count(DISTINCT prep_label) AS n FROM f GROUP BY 1)
SELECT fdc_id, CASE WHEN n > 5 THEN concat(coalesce(base_name, description), ' · ', coalesce(prep_label, 'plain')) ELSE coalesce(base_name, description) END AS name
FROM f JOIN n USING (food_category)""")
def composed_name(spark, sf):
    foods = roles.foods(spark, sf)
    n = foods.groupBy("food_category").agg((F.count_distinct("prep_label") - 4).alias("n"))
    shown = text.shown_name(F.col("base_name"), F.col("description"))
    return foods.join(n, "food_category").select(
        "fdc_id", text.composed_name(shown, F.col("prep_label"), F.col("n")).alias("name"))


@query("identity_tidy", """
SELECT doc_id, md5(nullif(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^[ ,;]+|[ ,;]+$', '', 'g'), '')) AS digest FROM documents""")
def identity_tidy(spark, sf):
    return roles.table(spark, sf, "documents").select("doc_id", F.md5(text.tidy_identity(F.col("text"))).alias("digest"))


@query("keyword_clean", """
WITH t AS (SELECT doc_id, [lower(trim(x, ' ')) FOR x IN regexp_split_to_array(text, '[.,]')] AS ts FROM documents),
f AS (SELECT doc_id, [x FOR x IN ts IF length(x) BETWEEN 1 AND 40] AS fs FROM t)
SELECT doc_id, array_to_string([x FOR x, i IN fs IF list_position(fs, x) = i][1:20], '; ') AS keywords FROM f""")
def keyword_clean(spark, sf):
    return roles.table(spark, sf, "documents").select(
        "doc_id", F.array_join(text.clean_keywords(F.split("text", "[.,]")), "; ").alias("keywords"))


_EMOJI = "CASE event_type WHEN 'view' THEN '🍗' WHEN 'click' THEN '🍗🍗' WHEN 'signup' THEN ':)' WHEN 'purchase' THEN '👍🏽' ELSE '' END"


@query("emoji_check", f"""
SELECT event_type, CAST(event_type IN ('view', 'purchase') AS BIGINT) AS single,
  CASE event_type WHEN 'view' THEN '🍗' WHEN 'click' THEN '🍗🍗' WHEN 'signup' THEN ':)' WHEN 'purchase' THEN '👍🏽' ELSE '' END AS lead, count(*) AS n
FROM events GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY event_type"))
def emoji_check(spark, sf):
    e = F.expr(_EMOJI)
    return roles.table(spark, sf, "events").select(
        "event_type", text.is_single_emoji(e).cast("bigint").alias("single"),
        text.leading_emoji(F.concat(e, F.lit(" dish"))).alias("lead")).groupBy("event_type", "single", "lead").agg(
        F.count(F.lit(1)).alias("n"))


@query("code_fence", """
SELECT conv_id, turn, md5(trim(text, E' \\t\\n\\r')) AS digest FROM conversations""")
def code_fence(spark, sf):
    # Odd turns come fenced, even ones plain; both must give the same text back.
    wrapped = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return roles.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(text.strip_code_fence(wrapped)).alias("digest"))


@query("seeded_sample", f"""
WITH f AS ({roles.FOODS_SQL}) SELECT fdc_id, description FROM f ORDER BY md5(concat(fdc_id, ':', 7)), fdc_id LIMIT 20""")
def sample(spark, sf):
    return seeded_sample(roles.foods(spark, sf).select("fdc_id", "description"), "fdc_id", 20, seed=7)


@query("route_confidence", """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'needs_review' WHEN coalesce(n_chars / 1000.0, 0) >= 0.8 THEN 'auto_approved' ELSE 'needs_review' END AS status
FROM labels JOIN documents USING (doc_id)""")
def route_confidence(spark, sf):
    rows = roles.table(spark, sf, "labels").join(roles.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", labels.route(F.col("n_chars") / 1000.0, F.col("toxic") == 1, F.lit(False)).alias("status"))


@query("cross_check", f"""
WITH n AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN concat('Fried ', p_name) WHEN p_size % 4 = 1 THEN split_part(p_name, ' ', 2) ELSE p_name END AS shown,
  CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_size > 40 THEN concat('fried ', p_name) ELSE p_name END AS base, CASE WHEN p_type = 'LARGE' THEN 'no' ELSE '🍗' END AS emoji FROM part),
w AS (SELECT *, list_distinct({sql_words('shown')}) AS nw, coalesce(list_distinct({sql_words('base')}), []) AS bw FROM n),
a AS (SELECT *, list_sort([x FOR x IN nw IF x IN {sql_list(fixed.NAME_PREP_WORDS)} AND NOT list_contains(bw, x)]) AS added FROM w)
SELECT id, concat_ws('; ', CASE WHEN emoji = 'no' THEN 'not one emoji: no' END,
  CASE WHEN len(added) > 0 THEN concat('preparation words added: ', array_to_string(added, ' ')) END,
  CASE WHEN base IS NOT NULL AND len(nw) < len(bw) THEN concat('qualifiers dropped from: ', base) END) AS issues FROM a""")
def cross_check(spark, sf):
    rows = roles.table(spark, sf, "part").selectExpr(
        "p_partkey AS id",
        "CASE WHEN p_size % 4 = 0 THEN concat('Fried ', p_name) WHEN p_size % 4 = 1 THEN split_part(p_name, ' ', 2) ELSE p_name END AS shown",
        "CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_size > 40 THEN concat('fried ', p_name) ELSE p_name END AS base",
        "CASE WHEN p_type = 'LARGE' THEN 'no' ELSE '🍗' END AS emoji")
    issues = labels.naming_issues(F.col("shown"), F.col("emoji"), F.col("base"))
    return rows.select("id", F.array_join(issues, "; ").alias("issues"))


@query("name_similarity", f"""
WITH p AS (SELECT DISTINCT p_name FROM part), n AS (SELECT n_name FROM nation),
d AS (SELECT p_partkey AS id, [x FOR x IN regexp_split_to_array(lower(p_name), '[^a-z0-9]+') IF x <> ''] AS a,
  [x FOR x IN regexp_split_to_array(lower(concat(p_type, ' ', split_part(p_name, ' ', 2), 's')), '[^a-z0-9]+') IF x <> ''] AS b FROM part),
s AS (SELECT id, list_distinct([{sql_suffix('w')} FOR w IN a]) AS a, list_distinct([{sql_suffix('w')} FOR w IN b]) AS b FROM d)
SELECT id, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS similarity FROM s""".replace(
    "WITH p AS (SELECT DISTINCT p_name FROM part), n AS (SELECT n_name FROM nation),\nd AS", "WITH d AS"))
def name_similarity(spark, sf):
    a, b = F.col("p_name"), F.concat_ws(" ", "p_type", F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("s")))
    return roles.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(
        text.dice(text.name_tokens(a), text.name_tokens(b)), 6).alias("similarity"))
