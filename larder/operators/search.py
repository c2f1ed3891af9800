"""Ranked text search for a whole table of queries at once.

The index is stored: each item's tokens in order, postings, and the vocabulary with its
document counts. A query term is resolved against the vocabulary (small next to the
postings), then each matched word meets the postings by plain equality, so there is no scan
per query and no cross join. Words that occur almost everywhere are split over several
tasks. The documents of a term that matches one word are counted in the vocabulary; those
of one that matches several are counted from the postings, of which nothing is stored.

All terms of a query must be met. Its rarest few, those about as rare as the rarest, are read first; what they leave of the
items narrows the postings before the common terms are read at all. A token with
punctuation inside is a phrase: its words must follow one another in one field. Fuzzy
search needs any gram, so common grams are left out where they cannot lift an item that
has no rarer one into the best (``fuzzy_hits``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder import fixed
from larder.functions import dates, labels, text
from larder.functions.maths import composite_rank
from larder.operators.relational import salted_join, top_k, without
from larder.session import materialise

Hold = Callable[[DataFrame, str], DataFrame]

#: Terms of a query that are read before the postings are narrowed, if no more than so many times as common as its rarest.
NARROW, COMMON = 3, 4
#: Documents that the rarest grams of a query should reach to set its threshold, per wanted one.
SEEDS = 8
#: Words, or scored rows, that one task gathers.
TASK_ROWS = 1 << 19


@dataclass(frozen=True)
class Index:
    texts: DataFrame       # item_id, len, tokens_<field> in order (word index)
    postings: DataFrame    # token, item_id, occurrences per column
    vocabulary: DataFrame  # token, n (documents), most (greatest occurrences)
    fields: tuple[str, ...]

    @property
    def lengths(self) -> DataFrame:
        return self.texts.select("item_id", "len")


def spread(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """Rows by a hash of the keys, in as many parts as ``total`` rows need tasks."""
    return rows.repartition(max(1, -(-total // TASK_ROWS)), *keys)


def _asked_rows(terms: DataFrame) -> int:
    """Rows that (query, term) pairs bring in, from the documents of each term."""
    return terms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _counted(texts: DataFrame, columns: Mapping[str, Column], hold: Hold) -> tuple[DataFrame, DataFrame]:
    """Postings and vocabulary of the words in some columns of the stored texts.

    A document's words are counted where it lies: the texts are dealt into parts of
    about as many words, so no task holds more, however few files they came in.
    """
    fields = tuple(columns)
    words = texts.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    each = spread(texts, words, "item_id").select("item_id", F.explode(_tagged(columns)).alias("t"))
    postings = hold(each.groupBy(F.col("t.token").alias("token"), "item_id").agg(
        *[F.count_if(F.col("t.field") == f).alias(f"tf_{f}") for f in fields]), "postings")
    total = sum((F.col(f"tf_{f}") for f in fields), F.lit(0))
    return postings, hold(postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.max(total).alias("most")), "vocabulary")


def _tagged(columns: Mapping[str, Column]) -> Column:
    def with_field(tokens: Column, field: str) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(field).alias("field")))

    return F.flatten(F.array(*[with_field(c, f) for f, c in columns.items()]))


def build_index(docs: DataFrame, key: str, fields: tuple[str, ...], hold: Hold = materialise) -> Index:
    """Word index over several text columns of one document per item; the texts are cut once."""
    none = F.array().cast("array<string>")
    # a table of few files would be cut by as few tasks
    cut = docs.repartition(key).select(F.col(key).alias("item_id"), *[
        F.coalesce(text.index_tokens(F.col(f)), none).alias(f"tokens_{f}") for f in fields])
    size = sum((F.size(f"tokens_{f}") for f in fields), F.lit(0))
    texts = hold(cut.withColumn("len", size), "texts")
    tokens = {f: F.col(f"tokens_{f}") for f in fields}
    postings, vocabulary = _counted(texts, tokens, hold)
    return Index(texts, postings, vocabulary, fields)


def build_gram_index(docs: DataFrame, key: str, column: str, hold: Hold = materialise) -> Index:
    """Trigram index over one text column."""
    grams = F.coalesce(text.all_trigrams(F.col(column)), F.array().cast("array<string>"))
    cut = docs.repartition(key).select(F.col(key).alias("item_id"), grams.alias("grams"))
    texts = hold(cut.withColumn("len", F.size("grams")), "texts")
    postings, vocabulary = _counted(texts, {column: F.col("grams")}, hold)
    return Index(texts, postings, vocabulary, (column,))


def query_terms(queries: DataFrame, terms: Column) -> DataFrame:
    """(query_id, term, n_terms, times): distinct terms, and how often each is asked for."""
    each = queries.select("query_id", terms.alias("ts")).select(
        "query_id", F.explode("ts").alias("term"), F.size(F.array_distinct("ts")).alias("n_terms"))
    return each.groupBy("query_id", "term").agg(F.max("n_terms").alias("n_terms"), F.count(F.lit(1)).alias("times"))


def prefix_matches(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, token): words of the vocabulary each distinct term is a prefix of.

    A word stands under each of its beginnings that is as long as some term, so the join
    is on the whole term: nothing is left to check, and no short key gathers many words.
    """
    wanted = terms.select("term").distinct()
    # One row: the lengths that occur among the terms.
    lengths = wanted.agg(F.collect_set(F.length("term")).alias("lengths"))
    keyed = vocabulary.crossJoin(F.broadcast(lengths)).select(
        "token", F.explode(_heads(F.col("token"), F.col("lengths"))).alias("term"))
    return keyed.join(wanted, "term", "left_semi").select("term", "token")


def _postings_of(index: Index, matches: DataFrame, *columns: Column | str) -> DataFrame:
    """Postings of the matched words; if those are few they are sent to every task, so no other posting is shuffled."""
    postings = index.postings.select("token", "item_id", *columns)
    words = matches.select("token").distinct()
    return postings.join(F.broadcast(words), "token", "left_semi") if words.count() <= TASK_ROWS else postings


def _heads(token: Column, lengths: Column) -> Column:
    """Beginnings of a word, of the lengths that occur among the terms."""
    return F.transform(F.filter(lengths, lambda n: n <= F.length(token)), lambda n: F.left(token, n))


def _counted_in_texts(index: Index, terms: DataFrame) -> DataFrame:
    """(term, n) for few terms, which every task gets: a document's distinct beginnings are looked up where it lies."""
    lengths = terms.agg(F.collect_set(F.length("term")).alias("lengths"))
    words = F.array_distinct(F.concat(*[F.col(f"tokens_{f}") for f in index.fields]))
    heads = F.array_distinct(F.flatten(F.transform(words, lambda t: _heads(t, F.col("lengths")))))
    each = index.texts.crossJoin(F.broadcast(lengths)).select(F.explode(heads).alias("term"))
    return each.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _documents(index: Index, matches: DataFrame) -> DataFrame:
    """(term, n): the documents that hold any word that a term matches."""
    terms = matches.select("term").distinct()
    if terms.count() <= TASK_ROWS:
        return _counted_in_texts(index, terms)
    sizes = matches.join(index.vocabulary.select("token", "n"), "token").groupBy("term").agg(
        F.count(F.lit(1)).alias("words"), F.max("n").alias("n"))
    several = matches.join(sizes.filter("words > 1").select("term"), "term", "left_semi")
    pairs = salted_join(index.postings.select("token", "item_id"), several, ["token"], index.vocabulary.select("token", "n"),
                        spread_by=["item_id"]).select("term", "item_id").distinct()
    return sizes.filter("words = 1").select("term", "n").unionByName(
        pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def _weighted(index: Index, weights: Mapping[str, float], of: Callable[[str], Column]) -> Column:
    return sum((of(f) * F.lit(float(weights.get(f, 1.0))) for f in index.fields), F.lit(0.0))


def term_hits(index: Index, matches: DataFrame, weights: Mapping[str, float], items: DataFrame | None = None) -> DataFrame:
    """(term, item_id, f): weighted occurrences of each term in each document that has it.

    With ``items`` only the postings of those are read on.
    """
    postings = _postings_of(index, matches, _weighted(index, weights, lambda f: F.col(f"tf_{f}")).alias("f"))
    if items is not None:
        postings = postings.join(items, "item_id", "left_semi")
    return salted_join(postings, matches, ["token"], index.vocabulary.select("token", "n"), spread_by=["item_id"]).groupBy(
        "term", "item_id").agg(F.sum("f").alias("f"))


def phrase_hits(index: Index, phrases: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(term, item_id, f): weighted occurrences of phrases, words in a row of which the last is a prefix.

    Items come from the postings of a phrase's rarest whole word and are then read in order.
    """
    wanted = phrases.select("term").distinct().withColumn("ws", F.split("term", " "))
    whole = wanted.select("term", F.explode(F.slice("ws", 1, F.size("ws") - 1)).alias("token"))
    rare = whole.join(index.vocabulary.select("token", "n"), "token").groupBy("term").agg(
        F.min_by("token", F.struct("n", "token")).alias("token"))
    near = salted_join(index.postings.select("token", "item_id"), rare, ["token"], index.vocabulary.select("token", "n"),
                       spread_by=["item_id"]).join(wanted, "term").select("term", "ws", "item_id")

    def occurrences(field: str) -> Column:
        tokens, n = F.col(f"tokens_{field}"), F.size("ws")
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(
            F.array().cast("array<int>"))
        # the first word is looked at first: few places are compared whole
        fits = F.filter(starts, lambda i: (F.get(tokens, i - 1) == F.col("ws")[0])
                        & (F.slice(tokens, i, n - 1) == F.slice("ws", 1, n - 1))
                        & F.get(tokens, i + n - 2).startswith(F.get("ws", n - 1)))
        return F.size(fits)

    found = index.texts.join(near, "item_id").select("term", "item_id", _weighted(index, weights, occurrences).alias("f"))
    return found.filter("f > 0")


def _idf(n: Column, docs: Column) -> Column:
    odds = F.log((docs - n + 0.5) / (n + 0.5))
    return F.when(odds <= 0, F.lit(fixed.BM25_IDF_FLOOR)).otherwise(odds)


def _part(f: Column, length: Column, mean: Column) -> Column:
    """What occurrences count for, damped by the document's length; below k1 + 1."""
    norm = fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * length / mean)
    return (f * (fixed.BM25_K1 + 1)) / (f + norm)


def _weighed(terms: DataFrame, seen: DataFrame, index: Index) -> DataFrame:
    """Terms with the documents that hold them (n), their idf, and the corpus figures.

    Terms that no document holds are gone. The score is Okapi BM25; the document
    frequency is the term's own, over every word it matched. A term that is asked for
    several times counts as often.
    """
    corpus = index.lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"), F.min("len").alias("min_len"))
    return terms.join(seen, "term").crossJoin(F.broadcast(corpus)).withColumn(
        "idf", F.col("times") * _idf(F.col("n"), F.col("docs")))


def _summed(rows: DataFrame) -> DataFrame:
    """(query_id, item_id, rank, found, n_terms); the score is negated, so smaller is better."""
    score = -F.col("idf") * _part(F.col("f"), F.col("len"), F.col("avg_len"))
    return rows.groupBy("query_id", "item_id").agg(
        F.sum(score).alias("rank"), F.count(F.lit(1)).alias("found"), F.max("n_terms").alias("n_terms"))


def prefix_hits(queries: DataFrame, index: Index, weights: Mapping[str, float] = fixed.INDEX_WEIGHTS,
                hold: Hold = materialise) -> DataFrame:
    """(query_id, item_id, rank): documents holding every term as a word prefix, or as a phrase."""
    terms = query_terms(queries, text.query_tokens(F.col("text")))
    words, phrases = terms.filter(~F.col("term").contains(" ")), terms.filter(F.col("term").contains(" "))
    # read by every step below, and as a stored table known to be small where it is
    matches = hold(prefix_matches(words, index.vocabulary), "matches")
    seen = _documents(index, matches)
    direct = None
    if not phrases.isEmpty():
        direct = hold(phrase_hits(index, phrases, weights), "phrases")
        seen = seen.unionByName(direct.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    per_query = Window.partitionBy("query_id")
    placed = hold(_weighed(terms, seen, index).withColumns({
        "place": F.row_number().over(per_query.orderBy("n", "term")), "held": F.count(F.lit(1)).over(per_query),
        "least": F.min("n").over(per_query)})
        .withColumn("leads", (F.col("place") <= NARROW) & (F.col("n") <= COMMON * F.col("least")))
        .withColumn("n_leads", F.count_if("leads").over(per_query))
        .filter("held = n_terms").select("query_id", "term", "n_terms", "leads", "n_leads", "n", "idf", "avg_len"), "terms")
    first, rest = placed.filter("leads"), placed.filter("NOT leads")

    def hits(of: DataFrame, items: DataFrame | None = None) -> DataFrame:
        own = of.select("term").distinct()
        found = term_hits(index, matches.join(own, "term", "left_semi"), weights, items)
        if direct is None:
            return found
        some = direct if items is None else direct.join(items, "item_id", "left_semi")
        return found.unionByName(some.join(own, "term", "left_semi"))

    few = hold(hits(first), "hits")
    asked = first.select("query_id", "term", "n_terms", "n_leads", "idf", "avg_len")
    counts = first.groupBy("term").agg(F.max("n").alias("n"))
    total = _asked_rows(first)
    narrow = spread(salted_join(few, asked, ["term"], counts, spread_by=["item_id"]), total, "item_id")
    left = hold(narrow.groupBy("query_id", "item_id").agg(
        F.count(F.lit(1)).alias("found"), F.max("n_leads").alias("n_leads")).filter(
        "found = n_leads").select("query_id", "item_id"), "left")
    # what is still to be looked up, rather than all that any query asks of an item
    due = left.join(rest.select("query_id", "term", "n_terms", "n_leads", "idf", "avg_len"), "query_id")
    others = hits(rest, left.select("item_id").distinct()).join(due, ["term", "item_id"])
    rows = narrow.join(left, ["query_id", "item_id"], "left_semi").unionByName(others.select(*narrow.columns))
    return _summed(rows.join(index.lengths, "item_id")).filter(
        F.col("found") == F.col("n_terms")).select("query_id", "item_id", "rank")


def _gram_terms(queries: DataFrame, index: Index) -> DataFrame:
    terms = query_terms(queries, F.array_distinct(F.transform(text.trigrams(F.col("text")), text.fold)))
    return _weighed(terms, index.vocabulary.withColumnRenamed("token", "term"), index)


def _gram_rows(terms: DataFrame, index: Index) -> DataFrame:
    """Postings of grams: (query_id, item_id, len, f and what scores it), an item's rows in one task."""
    postings = index.postings.select(F.col("token").alias("term"), "item_id", F.col(f"tf_{index.fields[0]}").cast("double").alias("f"))
    sizes = index.vocabulary.select(F.col("token").alias("term"), "n")
    asked = terms.select("query_id", "term", "n_terms", "idf", "avg_len")
    rows = salted_join(postings, asked, ["term"], sizes, spread_by=["item_id"])
    return spread(rows, _asked_rows(terms), "item_id").join(index.lengths, "item_id")


def gram_hits(queries: DataFrame, index: Index, hold: Hold = materialise) -> DataFrame:
    """(query_id, item_id, rank): documents sharing any gram with the query, all of them."""
    rows = _gram_rows(hold(_gram_terms(queries, index), "terms"), index)
    return _summed(rows).select("query_id", "item_id", "rank")


def fuzzy_hits(queries: DataFrame, index: Index, k: int, share: float = 1.0, hold: Hold = materialise) -> DataFrame:
    """(query_id, item_id, rank): the documents that can be among a query's k best by shared grams, and others.

    Exact for the k best: a document is left out only if its score is below ``share`` of
    the k-th best. A query's rarest grams are read first and give its threshold, the k-th
    best score they reach. Every gram has a greatest score that it can add; the most common
    grams, as long as theirs add up to less than the threshold, bring in no document. They
    are read only for the documents that a rarer gram brought in and that may still pass.
    """
    most = F.col("idf") * _part(F.col("most").cast("double"), F.col("min_len"), F.col("avg_len"))
    ordered = Window.partitionBy("query_id").orderBy("n", "term").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("query_id").orderBy(F.desc("n"), F.desc("term"))
    terms = hold(_gram_terms(queries, index).withColumn("most", most).withColumns({
        "reached": F.coalesce(F.sum("n").over(ordered), F.lit(0)), "tail": F.sum("most").over(back)}), "terms")
    seeds = _gram_rows(terms.filter(F.col("reached") < SEEDS * k), index)
    best = top_k(_summed(seeds), ["query_id"], [F.col("rank"), F.col("item_id")], k)
    # widened a little, as sums of doubles may differ by their order
    need = hold(best.filter(F.col("rn") == k).select("query_id", (-F.col("rank") * share * (1 - 1e-9)).alias("need")), "need")
    judged = terms.join(need, "query_id", "left").withColumn("need", F.coalesce("need", F.lit(0.0)))
    leading, common = judged.filter(F.col("tail") >= F.col("need")), judged.filter(F.col("tail") < F.col("need"))
    brought = _gram_rows(leading, index)
    bound = common.groupBy("query_id").agg(F.sum("most").alias("more"), F.max("need").alias("need"))
    score = F.col("idf") * _part(F.col("f"), F.col("len"), F.col("avg_len"))
    partial = brought.groupBy("query_id", "item_id", "len").agg(F.sum(score).alias("own")).join(bound, "query_id", "left")
    open_ = hold(partial.filter(F.col("more").isNull() | (F.col("own") + F.col("more") >= F.col("need"))).select(
        "query_id", "item_id", "len", "own"), "open")
    postings = index.postings.select("item_id", F.col("token").alias("term"), F.col(f"tf_{index.fields[0]}").cast("double").alias("f"))
    grams = postings.join(common.select("term").distinct(), "term", "left_semi")
    added = grams.join(open_, "item_id").join(common.select("query_id", "term", "idf", "avg_len"), ["query_id", "term"]).groupBy(
        "query_id", "item_id").agg(F.sum(score).alias("added"))
    return open_.join(added, ["query_id", "item_id"], "left").select(
        "query_id", "item_id", (-(F.col("own") + F.coalesce("added", F.lit(0.0)))).alias("rank"))


def recent_counts(log: DataFrame, foods: DataFrame, as_of: str, days: int = fixed.RANKING_DAYS) -> DataFrame:
    """(item_id, n): live entries per item since the cut-off, whatever member was logged.

    Entries are counted per food before they meet the catalogue.
    """
    live = log.filter((F.col("deleted") == 0) & F.col("food_id").isNotNull()
                      & (F.col("local_date") >= dates.days_before(as_of, days)))
    per_food = live.groupBy("food_id").agg(F.count(F.lit(1)).alias("n"))
    return per_food.join(foods.select("food_id", "merged_food_id"), "food_id").groupBy(
        F.col("merged_food_id").alias("item_id")).agg(F.sum("n").alias("n"))


def ranked(hits: DataFrame, queries: DataFrame, items: DataFrame, foods: DataFrame,
           recent: DataFrame, k: int | None) -> DataFrame:
    """Index hits re-ranked by what the item is and how often it was logged.

    The whole set is scored before it is cut: the best answer may lie deep in the
    index order.
    """
    facts = (
        items.select(F.col("merged_food_id").alias("item_id"), "display_name", "emoji", "commonness",
                     "prep_type", "n_preps")
        .join(foods.select(F.col("food_id").alias("item_id"), "description", "kcal_100g", "protein_100g",
                           "fat_100g", "carb_100g", "serving_g", "serving_label"), "item_id")
        .join(recent.withColumnRenamed("n", "recent"), "item_id", "left")
        .withColumn("name", text.shown_name(F.col("display_name"), F.col("description")))
        .withColumn("penalised", labels.is_penalised(F.col("display_name"), F.col("description")))
    )
    wanted = queries.select("query_id", F.lower(F.trim("text")).alias("_text"))
    # The large side comes first in both; the runtime splits what is skewed.
    rows = hits.join(facts, "item_id").join(wanted, "query_id")
    score = composite_rank(F.col("rank"), F.col("commonness"), F.col("prep_type"), F.col("recent"),
                           F.lower("name") == F.col("_text"), F.col("penalised"))
    rows = rows.withColumn("score", F.round(score, 9)).select(
        "query_id", F.col("item_id").alias("food_id"), "name", "emoji", "kcal_100g", "protein_100g",
        "fat_100g", "carb_100g", "serving_g", "serving_label", "n_preps", "score")
    if k is None:
        return rows
    return top_k(rows, ["query_id"], [F.col("score"), F.col("food_id")], k)


def primary_search(queries: DataFrame, index: Index, items: DataFrame, foods: DataFrame,
                   log: DataFrame, as_of: str, k: int = fixed.MATCH_LIMIT) -> DataFrame:
    """Word-prefix search only: what detections are matched against."""
    return ranked(prefix_hits(queries, index), queries, items, foods, recent_counts(log, foods, as_of), k)


def _substring_pairs(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, id): texts that contain the query, ignoring case.

    Both sides meet on the query's rarest-looking piece it must share, its first
    three characters (fewer when shorter), and the match is then checked whole.
    """
    def pieces(c: Column) -> Column:
        def of(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))),
                               lambda i: F.substring(c, i, F.lit(n)))
        return F.array_distinct(F.concat(of(1), of(2), of(3)))

    wanted = queries.select("query_id", F.lower(F.trim("text")).alias("q")).filter(F.col("q") != "")
    wanted = wanted.withColumn("p", F.left("q", F.lit(3)))
    # Only pieces some query starts with are kept, before the texts are repeated.
    starts = wanted.select("p").distinct()
    pieces_of = texts.select("id", "t", F.explode(pieces(F.col("t"))).alias("p")).join(
        starts, "p", "left_semi")
    sizes = pieces_of.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return salted_join(pieces_of, wanted, ["p"], sizes, spread_by=["id"]).filter(
        F.col("t").contains(F.col("q"))).select("query_id", "id")


def custom_search(queries: DataFrame, custom_foods: DataFrame, log: DataFrame, as_of: str,
                  k: int = fixed.CUSTOM_LIMIT, days: int = fixed.RANKING_DAYS) -> DataFrame:
    """Own foods whose name or brand contains the query, most and latest logged first."""
    live = custom_foods.filter(F.col("deleted") == 0)
    texts = live.select("id", F.lower(F.concat_ws(" ", "name", F.coalesce("brand", F.lit("")))).alias("t"))
    since = dates.days_before(as_of, days)
    recent = log.filter((F.col("deleted") == 0) & F.col("custom_food_id").isNotNull()
                        & (F.col("local_date") >= since)).groupBy(F.col("custom_food_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("logged_at").alias("last_at"))
    facts = live.select("id", "name", "emoji", F.col("energy_kcal").alias("kcal_100g"),
                        F.col("protein_g").alias("protein_100g"), F.col("fat_g").alias("fat_100g"),
                        F.col("carb_g").alias("carb_100g"), "serving_g", "serving_label")
    rows = _substring_pairs(queries, texts).join(facts.join(recent, "id", "left"), "id")
    order = [F.coalesce("n", F.lit(0)).desc(), F.col("last_at").desc_nulls_last(), F.col("name"), F.col("id")]
    return top_k(rows, ["query_id"], order, k)


def search(queries: DataFrame, index: Index, grams: Index, items: DataFrame, foods: DataFrame,
           log: DataFrame, custom_foods: DataFrame, as_of: str, k: int = fixed.SEARCH_LIMIT) -> DataFrame:
    """Own foods, then word matches, then, where words gave fewer than five, fuzzy ones.

    The passes are appended, never mixed: their ranks are not comparable. ``tier`` is
    0, 1 or 2 and ``rn`` the place within it.
    """
    recent = recent_counts(log, foods, as_of)
    first = materialise(ranked(prefix_hits(queries, index), queries, items, foods, recent, k), "first")
    enough = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= fixed.FALLBACK_BELOW)
    short = materialise(without(queries, enough, "query_id"), "short")
    # What an item is multiplies its rank: the most and the least it can be multiplied by.
    fuzzy = ranked(fuzzy_hits(short, grams, k, fixed.LEAST_FACTOR / fixed.GREATEST_FACTOR), short, items, foods, recent, k)
    second = without(fuzzy, first, ["query_id", "food_id"])
    own = custom_search(queries, custom_foods, log, as_of)
    shared = ["query_id", "name", "emoji", "kcal_100g", "protein_100g", "fat_100g", "carb_100g",
              "serving_g", "serving_label", "rn"]

    def tier(df: DataFrame, n: int, food_id: str | None, custom: str | None) -> DataFrame:
        return df.select(
            F.lit(n).alias("tier"), *shared,
            (F.col(food_id) if food_id else F.lit(None)).cast("bigint").alias("food_id"),
            (F.col(custom) if custom else F.lit(None)).cast("string").alias("custom_food_id"),
        )

    return tier(own, 0, None, "id").unionByName(tier(first, 1, "food_id", None)).unionByName(
        tier(second, 2, "food_id", None))
