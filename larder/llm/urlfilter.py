"""URL filters by dated lists.

A list says on dates that a domain is added or removed. Each entry's dates become
validity intervals, from the day it is added to the day before it is removed. A capture
is judged by the entries that were active on the day it was fetched, for its host and
every parent domain of it; the longest listed domain decides, and of equal ones "allow".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without port, user and trailing dot; null where the URL names none."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(url, _HOST, 1), r"\.$", "")), F.lit(""))


def intervals(events: DataFrame) -> DataFrame:
    """(list, domain, since, until) from events (list, domain, day, action add or remove).

    until is the first day on which the entry no longer holds, null while it still does.
    An addition while the entry holds, or a removal while it does not, changes nothing. Of
    several events of one day the addition counts. Events with a null are ignored. The
    history of one domain in one list is sorted in one task; it has a row per day at most.
    """
    days = (events.filter("list is not null and domain is not null and day is not null")
            .filter(F.col("action").isin("add", "remove"))
            .groupBy("list", F.lower("domain").alias("domain"), "day")
            .agg(F.max(F.col("action") == "add").alias("on")))
    own = Window.partitionBy("list", "domain").orderBy("day")
    changes = days.withColumn("before", F.coalesce(F.lag("on").over(own), F.lit(False))).filter(
        F.col("on") != F.col("before"))
    return (changes.withColumn("until", F.lead("day").over(own)).filter("on")
            .select("list", "domain", F.col("day").alias("since"), "until"))


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more; an address stands for itself."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.rlike(r"^[0-9.]+$|^\["), F.array(host)).otherwise(parents)


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
           day_col: str = "fetched") -> DataFrame:
    """Per capture: its id, host, fetched, verdict, matched, since. entries as ``intervals`` gives them.

    verdict is block, allow or none; matched is the domain that decided and since the day
    its entry became active. A null URL or day, or a URL without a host, has verdict
    none. Repeated captures come back each. Lists other than block and allow are ignored.

    Captures are brought down to distinct hosts and days first, so a host that holds a
    third of all captures meets the lists once a day; the answers go back by host and
    day, of which each has one row.
    """
    rows = captures.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                           F.col(day_col).cast("date").alias("fetched"))
    asked = rows.filter("host is not null and fetched is not null").select("host", "fetched").distinct()
    domains = asked.select("host", "fetched", F.explode(suffixes(F.col("host"))).alias("domain"))
    lists = entries.filter(F.col("list").isin("allow", "block"))
    active = domains.join(lists, "domain").filter(
        (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = active.groupBy("host", "fetched").agg(F.max(F.struct(
        F.length("domain").alias("n"), (F.col("list") == "allow").alias("allow"), "domain", "since")).alias("best"))
    verdict = F.when(F.col("best").isNull(), "none").when(F.col("best.allow"), "allow").otherwise("block")
    return rows.join(best, ["host", "fetched"], "left").select(
        "page_id", "host", "fetched", verdict.alias("verdict"), F.col("best.domain").alias("matched"),
        F.col("best.since").alias("since"))
