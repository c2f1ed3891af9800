"""Streams over several micro-batches, restarts, and logs that keep what is appended."""

import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from larder import schemas
from larder.plans.streams import EVENTS, cut_events
from larder.sources import archives, tables
from larder.streaming import intake, plate
from larder.streaming.segments import Store
from larder.streaming.sinks import read_batches, table_stream, write_batches

FOLDER = "/root/testdata/sf0.001"


def test_every_row_is_counted_in_any_order(spark, tmp_path):
    stream = table_stream(spark, cut_events(spark, FOLDER), EVENTS, 1).select(
        F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("value").alias("kcal"))
    write_batches(stream, str(tmp_path), intake.hour_parts)
    parts = read_batches(spark, str(tmp_path), intake.hour_parts(stream).schema)
    assert parts.select("batch").distinct().count() == 4
    total = intake.hour_totals(parts).agg(F.sum("n")).first()[0]
    assert total == spark.read.parquet(f"{FOLDER}/events.parquet").count()


def test_pull_goes_on_after_a_restart(spark, tmp_path):
    source, path = cut_events(spark, FOLDER), str(tmp_path)
    schema = "id long, updated_at long, value double"
    assert intake.cursor(spark, path, spark.createDataFrame([], schema).schema) is None
    seen = []
    for files in ("part-00000*", "part-0000[01]*", "part-*", "part-*"):
        remote = table_stream(spark, f"{source}/{files}", EVENTS, 1).select(
            F.col("user_id").alias("id"), F.col("event_id").alias("updated_at"), "value")
        write_batches(remote, path, intake.pulled_parts)
        rows = read_batches(spark, path, remote.schema)
        seen.append((rows.select("batch").distinct().count(), intake.pulled(rows).count()))
    want = spark.read.parquet(f"{FOLDER}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("at"))
    assert {(r.id, r.updated_at) for r in intake.pulled(rows).collect()} == {(r.user_id, r["at"]) for r in want.collect()}
    assert [n for n, _ in seen] == [1, 2, 4, 4]
    assert intake.cursor(spark, path, remote.schema) == want.agg(F.max("at")).first()[0]


def small_files(spark, path, n, rows=40):
    """n files of users' amounts that add up to exact halves, and what they add up to."""
    draw, want = random.Random(n), {}
    frames = []
    for i in range(rows):
        user, cents = draw.randrange(4), draw.choice((10, 20, 30, 40, 115, 5))
        frames.append((user, "2024-01-01", cents / 100))
        want[user] = want.get(user, 0) + cents
    for user in list(want):
        frames.append((user, "2024-01-01", ((50 - want[user]) % 100) / 100))
        want[user] += (50 - want[user]) % 100
    draw.shuffle(frames)
    spark.createDataFrame(frames, "user_id long, local_date string, kcal double").repartition(n).write.parquet(path)
    return {u: int(Decimal(c).scaleb(-2).quantize(Decimal(1), ROUND_HALF_UP)) for u, c in want.items()}


@pytest.mark.parametrize("files", [1, 3, 11])
def test_halves_round_alike_however_rows_are_cut(spark, tmp_path, files):
    want = small_files(spark, f"{tmp_path}/in", files, 60)
    stream = table_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
    write_batches(stream, f"{tmp_path}/out", intake.day_parts, merge=intake.merged_sums(intake.DAY), fanout=3)
    got = intake.day_totals(read_batches(spark, f"{tmp_path}/out", intake.day_parts(stream).schema)).collect()
    assert {r.user_id: r.kcal for r in got} == want


def test_a_hundred_batches_lie_in_few_folders(spark, tmp_path):
    """Stopped and run again on the way, in the middle of a merge too."""
    store = Store(spark, str(tmp_path), fanout=4)
    rows = spark.createDataFrame([(1, "2024-01-01", 0.1, 1)], "user_id long, local_date string, kcal double, n long")
    part = rows.withColumn("kcal", F.col("kcal").cast("decimal(38,6)"))
    merge, most = intake.merged_sums(intake.DAY), 0
    for batch in range(100):
        if batch in (31, 64):
            # a merge that fails after the batch itself is stored: the batch is run again, and changes nothing
            with pytest.raises(ZeroDivisionError):
                store.add(part, batch, lambda rows: 1 / 0)
        store.add(part, batch, merge)
        store.add(part, batch, merge)
        most = max(most, len(store.manifest().segments))
    assert most <= 4 * 4 and len(store.files.names(f"{tmp_path}/data")) <= 3 * 4 + 4
    got = intake.day_totals(store.rows(part.schema)).first()
    assert (got.kcal, got.n) == (10, 100)


def test_late_replies_and_restarts_of_expiring_plates(spark, tmp_path):
    def reply(day, seq, item="a", kind="detected", shot=1):
        return ("s", item, kind, seq, "dish", float(seq), shot, datetime(2024, 1, day, 12))

    schema = ("session string, instance_id string, kind string, seq long, name string, grams double, shot long, ts timestamp")
    batches = [[reply(1, 1), reply(2, 2, shot=70)], [reply(2, 3), reply(6, 4, kind="edited"), reply(6, 5)],
               [reply(3, 6), reply(5, 7), reply(9, 8, "b", "removed")], [reply(20, 9)]]
    idle, delay, path = timedelta(days=2), timedelta(days=1), f"{tmp_path}/out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = table_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
        plate.drain_expiring(stream, path, idle, delay, fanout=2)
    parts = plate.timed_parts(stream, idle).schema
    got = sorted((r.first_seen, r.last_seen, r.grams, r.shots, r.ended) for r in plate.expiring_plates(spark, path, parts, idle, delay).collect())
    # the reply of the 3rd came behind the watermark of the 5th; that of the 5th joined the plate of the 6th
    assert got == [(1, 3, 3.0, "1,70", True), (5, 7, 4.0, "1", True), (9, 9, 9.0, "1", False)]
    assert [r.seq for r in plate.late_replies(spark, path, stream.schema).collect()] == [6]


def test_empty_replies_leave_nothing(spark):
    rows = [("s", 1, 1, "[]"), ("s", 2, 1, None), ("s", 3, 1, "oops"), ("t", 4, 2, '[{"id":"a","name":"x","grams":5}]'),
            ("t", 5, 3, '[{"name":"x"}]')]
    replies = spark.createDataFrame(rows, "session string, seq long, shot int, reply string").withColumn("ts", F.current_timestamp())
    got = plate.running_plate(plate.reply_rows(replies)).collect()
    assert [(r.session, r.instance_id, r.grams) for r in got] == [("t", "a", 5.0)]


def test_of_equal_stamps_the_first_stays(spark):
    rows = spark.createDataFrame([(1, 5, "old", 0), (1, 5, "new", 1), (2, 1, "x", 0), (2, 2, "y", 1)],
                                 "id long, updated_at long, value string, batch int")
    assert sorted((r.id, r.value) for r in intake.pulled(rows).collect()) == [(1, "old"), (2, "y")]


def test_shots_of_any_number(spark):
    rows = spark.createDataFrame([("s", "a", "detected", n, "x", 1.0, shot) for n, shot in enumerate((3, 64, 70, 1000, 3))],
                                 "session string, instance_id string, kind string, seq long, name string, grams double, shot long")
    assert plate.running_plate(rows).first().shots == "3,64,70,1000"
    halves = plate.plate_parts(rows.filter("seq < 2")).unionByName(plate.plate_parts(rows.filter("seq >= 2")))
    assert plate.plate_of(plate.merged_parts(halves)).first().shots == "3,64,70,1000"


def test_logs_keep_every_part(spark, tmp_path):
    path = str(tmp_path / "log")

    def rows(low, high):
        return schemas.conform(spark.range(low, high).select(
            F.col("id").alias("fdc_id"), F.lit("f").alias("field"), F.lit("r").alias("run_id"),
            F.current_timestamp().alias("timestamp")), schemas.AUDIT)

    for part, low, high in (("a", 0, 991), ("b", 991, 2152), ("a", 0, 991)):
        tables.append_log(rows(low, high), path, part)
    log = tables.read_log(spark, path, schemas.AUDIT)
    assert log.count() == 2152
    assert [r.fdc_id for r in tables.log_tail(log, 3).select("fdc_id").collect()] == [0, 1, 2]


def test_quoted_line_ends_and_repeated_names(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "food.csv").write_text('id,description\n1,"two\nlines"\n2,plain\n')
    assert [r.description for r in archives.csv_text(spark, str(tmp_path / "food.csv")).collect()] == ["two\nlines", "plain"]
    (tmp_path / "x" / "food.csv").write_text("id,description\n")
    with pytest.raises(ValueError):
        archives.needed_files(spark, str(tmp_path))


def test_a_local_session_has_a_folder(spark):
    from larder.session import Workspace, shared_folder
    work = Workspace(spark, "own")
    kept = work.keep(spark.range(3).toDF("id"), "rows")
    assert work.root.startswith(shared_folder(spark)) and kept.count() == 3
    folder = kept.inputFiles()[0].rpartition("/")[0]
    work.drop(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(folder).count()
