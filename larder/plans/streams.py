"""Streams over the events table, drained and read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from larder import fixed
from larder.operators import scoring
from larder.plans.registry import query
from larder.session import fresh_path
from larder.streaming import intake, plate
from larder.streaming.sinks import read_batches, table_stream, write_batches

EVENTS = StructType([
    StructField("event_id", LongType()), StructField("ts", TimestampNTZType()), StructField("user_id", LongType()),
    StructField("event_type", StringType()), StructField("value", DoubleType()), StructField("props", StringType()),
])


#: Files that the table is cut into, in no order of time; each is a micro-batch.
FILES = 4


def cut_events(spark, sf, files=FILES):
    path = fresh_path(spark, "events")
    rows = spark.read.schema(EVENTS).parquet(f"{sf}/events.parquet")
    rows.repartition(files, F.xxhash64("event_id")).write.parquet(path)
    return path


def events(spark, sf):
    return table_stream(spark, cut_events(spark, sf), EVENTS, files_per_batch=1)


def stamped(rows):
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_day_totals", """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS local_date, CAST(round(sum(CAST(value AS DECIMAL(28, 6)))) AS BIGINT) AS kcal, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_day_totals(spark, sf):
    entries = events(spark, sf).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("local_date"), F.col("value").alias("kcal"))
    path = fresh_path(spark, "days")
    write_batches(entries, path, intake.day_parts, merge=intake.merged_sums(intake.DAY), fanout=3)
    return intake.day_totals(read_batches(spark, path, intake.day_parts(entries).schema))


@query("stream_hour_window", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour_start, user_id, round(sum(value), 4) AS kcal, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_hour_window(spark, sf):
    entries = stamped(events(spark, sf)).select("ts", "user_id", F.col("value").alias("kcal"))
    path = fresh_path(spark, "hours")
    write_batches(entries, path, intake.hour_parts, merge=intake.merged_sums(intake.HOUR), fanout=3)
    rows = intake.hour_totals(read_batches(spark, path, intake.hour_parts(entries).schema))
    return rows.select(F.date_format("hour_start", "yyyy-MM-dd HH").alias("hour_start"), "user_id", F.round("kcal", 4).alias("kcal"), "n")


@query("stream_dedup", """
SELECT user_id AS id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(DISTINCT props) AS n FROM events GROUP BY 1, 2""")
def stream_dedup(spark, sf):
    pushed = stamped(events(spark, sf)).select(F.col("user_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "props", "ts")
    keys, path = ["id", "day", "props"], fresh_path(spark, "pushed")
    each = lambda rows: intake.first_of_each(rows, keys)
    write_batches(pushed, path, each, merge=each, fanout=3)
    rows = intake.first_of_each(read_batches(spark, path, pushed.schema), keys)
    return rows.groupBy("id", "day").agg(F.count(F.lit(1)).alias("n"))


@query("stream_pull", """
SELECT user_id AS id, max(event_id) AS updated_at, arg_max(value, event_id) AS value FROM events GROUP BY 1""")
def stream_pull(spark, sf):
    """Pulled in two runs: the second goes on where the first one stopped."""
    source, path = cut_events(spark, sf), fresh_path(spark, "pull")
    for files in ("part-0000[01]*", "part-*"):
        remote = table_stream(spark, f"{source}/{files}", EVENTS, files_per_batch=1).select(
            F.col("user_id").alias("id"), F.col("event_id").alias("updated_at"), "value")
        write_batches(remote, path, intake.pulled_parts, merge=intake.merged_pulls(), fanout=3)
    return intake.pulled(read_batches(spark, path, remote.schema))


_PLATE_SQL = """
WITH d AS (SELECT user_id AS session, concat(event_type, '_', CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) AS instance_id, event_id AS seq, value, day(ts) % 8 + 1 AS shot,
  CASE WHEN event_type = 'error' THEN 'removed' WHEN event_type = 'signup' AND value > 20 THEN 'edited' ELSE 'detected' END AS kind FROM events),
e AS (SELECT session, replace(replace(instance_id, 'error', 'view'), 'signup', 'click') AS instance_id, seq, value, shot, kind FROM d)
SELECT CAST(session AS VARCHAR) AS session, instance_id, min(seq) FILTER (WHERE kind = 'detected') AS first_seen,
  round(coalesce(arg_max(value, seq) FILTER (WHERE kind = 'edited'), arg_max(value, seq) FILTER (WHERE kind = 'detected')), 6) AS grams,
  string_agg(DISTINCT CAST(shot AS VARCHAR), ',' ORDER BY CAST(shot AS VARCHAR)) FILTER (WHERE kind = 'detected') AS shots, CAST(coalesce(bool_or(kind = 'removed'), false) AS BIGINT) AS removed
FROM e GROUP BY 1, 2 HAVING count(*) FILTER (WHERE kind = 'detected') > 0"""


def _plate_events(spark, sf):
    return _plate_rows(events(spark, sf)).drop("ts")


def _plate_rows(rows):
    kind = F.when(F.col("event_type") == "error", F.lit("removed")).when(
        (F.col("event_type") == "signup") & (F.col("value") > 20), F.lit("edited")).otherwise(F.lit("detected"))
    item = F.concat(F.col("event_type"), F.lit("_"), (F.get_json_object("props", "$.k").cast("bigint") % 5).cast("string"))
    return rows.select(
        F.col("user_id").cast("string").alias("session"),
        F.replace(F.replace(item, F.lit("error"), F.lit("view")), F.lit("signup"), F.lit("click")).alias("instance_id"),
        kind.alias("kind"), F.col("event_id").alias("seq"), F.lit("dish").alias("name"), F.col("value").alias("grams"),
        (F.dayofmonth("ts") % 8 + 1).alias("shot"), "ts")


def _rounded(plates, *more):
    return plates.select("session", "instance_id", "first_seen", F.round("grams", 6).alias("grams"), "shots",
                         F.col("removed").cast("bigint").alias("removed"), *more)


@query("stream_plate", _PLATE_SQL)
def stream_plate(spark, sf):
    said, path = _plate_events(spark, sf), fresh_path(spark, "plates")
    write_batches(said, path, plate.plate_parts, merge=plate.merged_parts, fanout=3)
    return _rounded(plate.plate_of(plate.merged_parts(read_batches(spark, path, plate.plate_parts(said).schema))))


#: An item's plate ends after two days without a reply; replies may come up to a day late.
IDLE, DELAY = timedelta(days=2), timedelta(days=1)


def _drained(spark, sf, on_time="true"):
    """Replies come in files by time, those that are not ``on_time`` all in one at the end.

    The folder of the drained plates, the schemas of parts and of replies.
    """
    source = spark.read.schema(EVENTS).parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    said, files, path = _plate_rows(source), fresh_path(spark, "timed"), fresh_path(spark, "plates")
    said.filter(on_time).repartitionByRange(FILES, "ts").write.parquet(files)
    for last in range(FILES):
        stream = table_stream(spark, f"{files}/part-0000[0-{last}]*", said.schema, files_per_batch=1)
        plate.drain_expiring(stream, path, IDLE, DELAY, fanout=3)
    if on_time != "true":
        said.filter(f"NOT ({on_time})").coalesce(1).write.mode("append").parquet(files)
        plate.drain_expiring(table_stream(spark, f"{files}/part-*", said.schema), path, IDLE, DELAY, fanout=3)
    return path, plate.timed_parts(said, IDLE).schema, said.schema


_SAID_SQL = """
d AS (SELECT user_id AS session, concat(event_type, '_', CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) AS instance_id, event_id AS seq, ts, value, day(ts) % 8 + 1 AS shot,
  CASE WHEN event_type = 'error' THEN 'removed' WHEN event_type = 'signup' AND value > 20 THEN 'edited' ELSE 'detected' END AS kind FROM events),
e AS (SELECT CAST(session AS VARCHAR) AS session, replace(replace(instance_id, 'error', 'view'), 'signup', 'click') AS instance_id, seq, ts, value, shot, kind FROM d)"""


@query("stream_plate_expiring", f"""
WITH {_SAID_SQL},
gap AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY session, instance_id ORDER BY ts, seq) >= INTERVAL 2 DAY, false) AS opens FROM e),
island AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY session, instance_id ORDER BY ts, seq) AS n FROM gap)
SELECT session, instance_id, min(seq) FILTER (WHERE kind = 'detected') AS first_seen,
  round(coalesce(arg_max(value, seq) FILTER (WHERE kind = 'edited'), arg_max(value, seq) FILTER (WHERE kind = 'detected')), 6) AS grams,
  string_agg(DISTINCT CAST(shot AS VARCHAR), ',' ORDER BY CAST(shot AS VARCHAR)) FILTER (WHERE kind = 'detected') AS shots, CAST(bool_or(kind = 'removed') AS BIGINT) AS removed,
  CAST(max(ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS BIGINT) AS ended
FROM island GROUP BY session, instance_id, n HAVING count(*) FILTER (WHERE kind = 'detected') > 0""")
def stream_plate_expiring(spark, sf):
    path, parts, _ = _drained(spark, sf)
    plates = plate.expiring_plates(spark, path, parts, IDLE, DELAY)
    return _rounded(plates, F.col("ended").cast("bigint").alias("ended"))


@query("stream_late_replies", f"""
WITH {_SAID_SQL},
late AS (SELECT * FROM e WHERE seq % 17 = 0 AND ts < (SELECT max(ts) FROM e WHERE seq % 17 <> 0) - INTERVAL 1 DAY)
SELECT 'late' AS place, session, count(*) AS n, sum(seq)::BIGINT AS seqs FROM late GROUP BY session
UNION ALL SELECT 'plate', session, count(*), min(seq) FROM (SELECT session, instance_id, min(seq) FILTER (WHERE kind = 'detected') AS seq FROM e
  WHERE seq % 17 <> 0 OR ts >= (SELECT max(ts) FROM e WHERE seq % 17 <> 0) - INTERVAL 1 DAY GROUP BY 1, 2) WHERE seq IS NOT NULL GROUP BY session""")
def stream_late_replies(spark, sf):
    """What came after the watermark lies in the side table; what came before it on the plates."""
    path, parts, replies = _drained(spark, sf, "seq % 17 <> 0")
    late = plate.late_replies(spark, path, replies).groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs")).withColumn("place", F.lit("late"))
    plates = plate.expiring_plates(spark, path, parts, IDLE, DELAY).groupBy("session").agg(
        F.count_distinct("instance_id").alias("n"), F.min("first_seen").alias("seqs")).withColumn("place", F.lit("plate"))
    return late.unionByName(plates).select("place", "session", "n", "seqs")


@query("stream_empty_replies", """
WITH k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT CAST(user_id AS VARCHAR) AS session, concat(event_type, '_', k % 5) AS instance_id, min(event_id) AS first_seen, round(arg_max(value, event_id), 6) AS grams,
  string_agg(DISTINCT CAST(day(ts) % 8 + 1 AS VARCHAR), ',' ORDER BY CAST(day(ts) % 8 + 1 AS VARCHAR)) AS shots, CAST(0 AS BIGINT) AS removed
FROM k WHERE k % 3 <> 0 AND k % 7 <> 1 GROUP BY 1, 2""")
def stream_empty_replies(spark, sf):
    """Replies as they are sent: a third of them empty, some no list at all; neither leaves a trace."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    item = F.struct(F.concat(F.col("event_type"), F.lit("_"), (k % 5).cast("string")).alias("id"), F.lit("dish").alias("name"),
                    F.col("value").alias("grams"))
    replies = stamped(events(spark, sf)).select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), (F.dayofmonth("ts") % 8 + 1).alias("shot"), "ts",
        F.when(k % 3 == 0, F.lit("[]")).when(k % 7 == 1, F.lit("no food here")).otherwise(F.to_json(F.array(item))).alias("reply"))
    said, path = plate.reply_rows(replies), fresh_path(spark, "replies")
    write_batches(said, path, plate.plate_parts, merge=plate.merged_parts, fanout=3)
    return _rounded(plate.plate_of(plate.merged_parts(read_batches(spark, path, plate.plate_parts(said).schema))))


@query("stream_scored", "SELECT event_id, upper(event_type) AS content FROM events")
def stream_scored(spark, sf):
    """Requests answered by a scorer in groups of at most 250, whose sizes it checks."""
    def scorer(payloads):
        return payloads.str.upper()

    def accepts(replies):
        return replies.withColumns({"ok": F.col("content").isNotNull(), "error": F.lit(None).cast("string")})

    def answer(rows):
        asked = rows.withColumn("payload", F.col("event_type"))
        sizes = asked.groupBy("group").count().filter(F.col("count") > fixed.FLUSH_EVERY)
        done, _ = scoring.score(asked.join(sizes, "group", "left_anti"), scorer, "event_id", accepts, attempts=1)
        return done.select("event_id", "content")

    path = fresh_path(spark, "scored")
    intake.scored_stream(events(spark, sf).select("event_id", "event_type"), answer, path, "event_id")
    return read_batches(spark, path, StructType([EVENTS["event_id"], StructField("content", StringType())])).drop("batch")
