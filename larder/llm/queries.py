"""One query per operator, each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder.llm import (
    backoff, bpe, codes, edits, flatgraph, langid, lexical, minhash, pii, planes, sql, toolcalls, urlfilter, winnow,
)
from larder.session import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_flat_graph_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scored(_table(spark, sf_dir, "documents"))


def op3_byte_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Workspace(spark, "token-ids").path("store")
    planes.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), store)
    return planes.checked(spark, store)


def op4_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text before and after three edits whose places follow its length."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    state = edits.trees(_table(spark, sf_dir, "documents"), ranks, pattern)
    n = F.length("text")

    def edit(place: Column, deleted: int, inserted: Column) -> Column:
        return F.struct(F.floor(place).cast("long").alias("place"), F.lit(deleted).cast("long").alias("n_deleted"),
                        inserted.alias("inserted"))

    planned = F.array(edit(n / 3, 5, F.lit("")), edit(2 * n / 3, 0, F.lit(" (revised) 2024")),
                      edit(F.lit(0), 0, F.concat(F.lit("["), n.cast("string"), F.lit("] "))))
    after = edits.edited(state.withColumn("edits", planned), ranks, pattern)
    return after.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"),
                        "n_encoded", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op5_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"),
                       public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns read as tool calls and the user turns after them as their results."""
    turns = _table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    number = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"))
    named = turns.withColumn("call_id", F.concat(number, F.col("turn").cast("string")))
    calls = named.filter("role = 'assistant'").select(
        "call_id", "conv_id", "turn", F.expr(CALL_NAME).alias("name"), F.expr(CALL_ARGUMENTS).alias("arguments"),
        F.when(F.expr("n % 29 = 0"), F.array("call_id"))
        .when(F.expr("turn > 2 and n % 2 = 0"), F.array(F.concat(number, (F.col("turn") - 2).cast("string"))))
        .otherwise(F.array().cast("array<string>")).alias("depends"))
    results = turns.filter("role = 'user' and turn > 0").select(
        F.concat(number, (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    return toolcalls.formatted(calls, results, TOOLS)


TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True), "timeout": ("number", False)},
    "calculate": {"terms": ("array", True), "exact": ("boolean", False)},
}

CALL_NAME = """CASE WHEN n % 19 = 0 THEN 'unlisted' WHEN n % 3 = 0 THEN 'search' WHEN n % 3 = 1 THEN 'fetch'
                    ELSE 'calculate' END"""

CALL_ARGUMENTS = """CASE
    WHEN n % 3 = 0 THEN concat('{"query": "', regexp_extract(text, '[A-Za-z]+', 0), '", "limit": ',
        CASE WHEN n % 11 = 0 THEN '"many"' ELSE CAST(n % 50 AS STRING) END, '}')
    WHEN n % 3 = 1 AND n % 13 = 0 THEN '{"timeout": 2.5}'
    WHEN n % 3 = 1 THEN concat('{"url": "https://example.org/', regexp_extract(text, '[A-Za-z]+', 0),
        '", "timeout": ', CAST(n % 7 AS STRING), CASE WHEN n % 17 = 0 THEN ', "verbose": true' ELSE '' END, '}')
    ELSE concat('{"terms": [', CAST(n AS STRING), ', ', CAST(n % 9 AS STRING), '], "exact": ',
        CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END, CASE WHEN n % 23 = 0 THEN '' ELSE '}' END) END"""


def op8_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_dated_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures dated by their id, against lists whose entries and dates follow the hosts seen."""
    pages = _table(spark, sf_dir, "pages")
    start = F.lit("2024-01-01").cast("date")
    captures = pages.select("page_id", "url", F.date_add(start, F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("domain")).filter("domain is not null").distinct()
    parents = hosts.select(F.regexp_extract("domain", r"([^.]+\.[^.]+)$", 1).alias("domain")).filter("domain != ''").distinct()

    def drawn(domains: DataFrame, name: str) -> DataFrame:
        x = F.conv(F.substring(F.md5("domain"), 1, 8), 16, 10).cast("long")
        return domains.select("domain", F.lit(name).alias("list"), x.alias("x"))

    def events(rows: DataFrame, when: str, action: str, day: str) -> DataFrame:
        return rows.filter(when).select("list", "domain", F.lit(action).alias("action"),
                                        F.date_add(start, F.expr(day).cast("int")).alias("day"))

    block, allow, wide = drawn(hosts, "block"), drawn(hosts, "allow"), drawn(parents, "block")
    history = [events(block, "x % 4 = 0", "add", "x % 200"), events(block, "x % 12 = 0", "remove", "x % 200 + 60"),
               events(block, "x % 24 = 0", "add", "x % 200 + 120"), events(allow, "x % 10 = 1", "add", "x % 300"),
               events(wide, "x % 3 = 0", "add", "x % 150")]
    dated = history[0]
    for more in history[1:]:
        dated = dated.unionByName(more)
    return urlfilter.judged(captures, urlfilter.intervals(dated))


def op11_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_boosted_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["exact"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    base = listed(F.filter("spans", lambda s: s["exact"]))
    return found.select("doc_id", *[count(k) for k in pii.KINDS],
                        F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_limb_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes.compressed(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", codes.code_text(F.col("codes")).alias("code"), "error", "label_error",
                        "codebooks_sha256")


QUERIES = {f.__name__: f for f in (
    op1_flat_graph_near_dedup, op2_backoff_automaton, op3_byte_planes, op4_edited_token_counts,
    op5_string_kernel_language, op6_byte_bpe, op7_tool_call_linking, op8_winnowing_decontamination,
    op9_minhash_near_dedup, op10_dated_url_lists, op11_norm_bucket_search, op12_boosted_personal_data,
    op13_limb_vector_codes,
)}
SQL = {
    "op1_flat_graph_near_dedup": sql.VECTOR_LINKS,
    "op7_tool_call_linking": sql.TOOL_CALLS,
    "op8_winnowing_decontamination": sql.CONTAMINATION,
    "op9_minhash_near_dedup": sql.NEAR_DUPLICATES,
    "op10_dated_url_lists": sql.URL_LISTS,
    "op11_norm_bucket_search": sql.LEXICAL_RANKS,
    "op13_limb_vector_codes": sql.VECTOR_CODES,
}
