import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from timepoint.operators.adherence import match_schedule, on_time_flags
from timepoint.operators.ordered import previous_value
from timepoint.operators.stop_events import stop_events
from timepoint.streaming.feed import (
    feed_gap_monitor,
    run_to_table,
    stream_adherence,
    stream_dedup,
    stream_headway,
    stream_otp,
    stream_pings,
    stream_stop_events,
    with_dead_windows,
    with_open_windows,
)
from timepoint.streaming.keyed import keyed_headway, keyed_state, stream_match, with_open_departures

SCHEMA = "id INT, vehicle STRING, trip STRING, ts TIMESTAMP, speed DOUBLE"
KEYS = ["vehicle", "trip"]


def write_files(spark, path, files):
    """One file for each list of rows, older files first."""
    import os

    for i, rows in enumerate(files):
        out = f"{path}/f{i}.json"
        with open(out, "w") as f:
            f.write("\n".join(json.dumps(r) for r in rows))
        os.utime(out, (1_700_000_000 + i, 1_700_000_000 + i))


def row(i, clock, trip="T1", speed=1.0, day=26):
    return {"id": i, "vehicle": "v1", "trip": trip, "ts": f"2024-08-{day} {clock}", "speed": speed}


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(path))


@pytest.fixture
def feed(spark, tmp_path):
    files = [
        [row(1, "08:00:00"), row(2, "08:00:05")],
        [row(2, "08:00:05"), row(3, "08:00:10")],
        [row(4, "08:00:15"), row(5, "09:00:00", "T2")],
        [row(6, "08:00:00", day=28)],  # passes the watermark
        [row(8, "09:00:00", day=28)],
        [row(7, "08:30:00", "T2")],  # late
    ]
    path = tmp_path / "in"
    path.mkdir()
    write_files(spark, path, files)
    return path


def test_copies_go(spark, feed):
    df = stream_dedup(stream(spark, feed), ["id"], "ts", "1 hour")
    assert sorted(r.id for r in run_to_table(df, "t").collect()) == [1, 2, 3, 4, 5, 6, 8]


def test_stop_events_equal_batch_on_closed_days(spark, feed):
    once = stream_dedup(stream(spark, feed), ["id"], "ts", "1 hour")
    got = run_to_table(stream_stop_events(once, KEYS, "ts", ["id"]), "t")
    batch = spark.read.schema(SCHEMA).json(str(feed))
    closed = batch.where("ts < '2024-08-27'")
    want = stop_events(closed, KEYS, "ts", ["id"], "trip")
    assert sorted((r.trip, r.id) for r in got.collect()) == sorted((r.trip, r.id) for r in want.collect())
    assert batch.where("id = 7").count() == 1  # the late row is in the batch


def test_headways_over_micro_batches(spark, feed, tmp_path):
    df = stream(spark, feed).withColumn("at", F.unix_micros("ts"))
    q = stream_headway(df, ["vehicle"], "at", "gap", str(tmp_path / "o"), str(tmp_path / "c"), ["id"], 2)
    q.awaitTermination()
    got = sorted((r.id, r.gap) for r in spark.read.parquet(str(tmp_path / "o")).collect() if r.id != 7)
    batch = spark.read.schema(SCHEMA).json(str(feed)).withColumn("at", F.unix_micros("ts")).where("id <> 7")
    want = previous_value(batch, ["vehicle"], "at", "p", ["id"]).select("id", (F.col("at") - F.col("p")).alias("gap"))
    # The copy of report 2 arrives in a later file: its headway is 0 either way.
    assert got == sorted((r.id, r.gap) for r in want.collect())
    late = spark.read.parquet(str(tmp_path / "o")).where("id = 7").first()
    assert late.gap is None


def test_headways_survive_a_rerun(spark, feed, tmp_path):
    """Run in two sittings: the second goes on from the state of the first."""
    import shutil

    half = tmp_path / "half"
    half.mkdir()
    args = (["vehicle"], "at", "gap", str(tmp_path / "o"), str(tmp_path / "c"), ["id"])
    for i in range(3):
        shutil.copy2(feed / f"f{i}.json", half)
    for _ in range(2):
        df = stream(spark, half).withColumn("at", F.unix_micros("ts"))
        stream_headway(df, *args).awaitTermination()
        shutil.copy2(feed / "f3.json", half)
    got = {r.id: r.gap for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got[5] == 3_585_000_000 and got[6] == (47 * 3600) * 1_000_000
    assert spark.read.parquet(str(tmp_path / "o")).count() == 7


def test_adherence_and_windows(spark, feed):
    tt = spark.createDataFrame([("T1", 28_800)], "trip STRING, sched INT")
    secs = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    df = stream_adherence(stream(spark, feed).withColumn("obs", secs), tt, ["trip"], "sched", "obs")
    rows = {r.id: r for r in run_to_table(df, "t").collect()}
    assert rows[1].on_time and rows[8].late and rows[5].on_time is None
    otp = stream_otp(df.withWatermark("ts", "1 hour"), "ts")
    got = {r.span.start: r for r in run_to_table(otp, "t").collect()}
    first = got[dt.datetime(2024, 8, 26, 8)]
    assert (first.n, first.n_scheduled, first.on_time_perc) == (5, 5, 1.0)
    assert got[dt.datetime(2024, 8, 26, 9)].on_time_perc is None


def test_gap_monitor(spark, feed):
    polls = stream(spark, feed).withWatermark("ts", "1 hour")
    got = {r.span.start.hour: (r.n, r.missing) for r in run_to_table(feed_gap_monitor(polls, "ts"), "t").collect()}
    assert got == {8: (5, 715), 9: (1, 719)}


def test_landing_folder_as_stream(spark, tmp_path):
    folder = tmp_path / "2024-08-26" / "2024-08-26-08"
    folder.mkdir(parents=True)
    vehicle = {"trip": {"trip_id": "T"}, "vehicle": {"id": "v"}, "timestamp": "1724673600"}
    doc = {"header": {"timestamp": "1724673601"}, "entity": [{"id": "e", "vehicle": vehicle}]}
    (folder / "positions_data_20240826080003.json").write_text(json.dumps(doc))
    df = stream_pings(spark, str(tmp_path)).select("vehicle_id", "ts", "poll_ts")
    assert [tuple(r) for r in run_to_table(df, "t").collect()] == [
        ("v", dt.datetime(2024, 8, 26, 8), dt.datetime(2024, 8, 26, 8, 0, 3))
    ]


def test_flags_of_the_stream_are_those_of_the_batch(spark):
    df = spark.createDataFrame([(420,), (421,)], "delay INT")
    assert [r.on_time for r in on_time_flags(df).collect()] == [True, False]


def test_dead_and_open_windows(spark):
    polls = spark.sql("SELECT timestamp'2024-08-26 05:10:00' AS ts UNION ALL SELECT timestamp'2024-08-26 07:20:00'")
    closed = feed_gap_monitor(polls.limit(1), "ts", "1 hour", 3)
    rows = with_open_windows(closed, polls, lambda df: feed_gap_monitor(df, "ts", "1 hour", 3), "ts")
    got = {r.span.start.hour: (r.n, r.missing, r.share) for r in with_dead_windows(rows).collect()}
    assert got == {5: (1, 2, 1 / 3), 6: (0, 3, 0.0), 7: (1, 2, 1 / 3)}
    none = closed.limit(0)
    again = with_open_windows(none, polls, lambda df: feed_gap_monitor(df, "ts", "1 hour", 3), "ts")
    assert again.count() == 2 and with_dead_windows(none).count() == 0


def keyed(spark, path, out, checkpoint, delay="5 days", horizon_ms=10 * 86_400_000):
    """Runs the headways of what has landed; the progress of each micro-batch."""
    df = stream(spark, path).withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    rows = keyed_headway(df, ["vehicle", "trip"], "at", "gap", "ts", horizon_ms, ["id"])
    with keyed_state(spark):
        q = rows.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out))
        q.awaitTermination()
    return [p for p in q.recentProgress if p.numInputRows]


def test_keyed_headways_equal_those_of_the_batch_operator(spark, feed, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    progress = keyed(spark, feed, tmp_path / "o", tmp_path / "c")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = spark.read.parquet(str(tmp_path / "o"))
    df = stream(spark, feed).withColumn("at", F.unix_micros("ts"))
    stream_headway(df, KEYS, "at", "gap", str(tmp_path / "o2"), str(tmp_path / "c2"), ["id"]).awaitTermination()
    want = spark.read.parquet(str(tmp_path / "o2"))
    assert sorted(map(str, got.select("id", "gap").collect())) == sorted(map(str, want.select("id", "gap").collect()))
    # Only the groups of a micro-batch are touched: T1 and T2 in the third, one of them in every other.
    groups = [p.stateOperators[0].numRowsUpdated for p in progress]
    assert len(groups) == 6 and groups[2] > groups[0] and groups[-1] <= groups[0], groups


def test_keyed_headways_go_on_after_a_restart_and_forget_old_groups(spark, feed, tmp_path):
    import shutil

    half = tmp_path / "half"
    half.mkdir()
    for i in range(3):
        shutil.copy2(feed / f"f{i}.json", half)
    keyed(spark, half, tmp_path / "o", tmp_path / "c")
    shutil.copy2(feed / "f3.json", half)
    keyed(spark, half, tmp_path / "o", tmp_path / "c")
    got = {r.id: r.gap for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got[6] == (2 * 86400 - 15) * 1_000_000 and spark.read.parquet(str(tmp_path / "o")).count() == 7
    # With an hour to live, what was seen two days before the next batch but one is forgotten.
    keyed(spark, feed, tmp_path / "o3", tmp_path / "c3", "1 hour", 3_600_000)
    got = {r.id: r.gap for r in spark.read.parquet(str(tmp_path / "o3")).collect()}
    assert got[3] == 5_000_000 and 7 not in got  # later than the watermark: dropped


def test_keyed_headways_of_rows_without_a_time(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    rows = [[row(1, "08:00:00") | {"speed": 5.0}, row(2, "08:00:01") | {"speed": None}], [row(3, "08:00:02") | {"speed": 7.5}, row(4, "08:00:02") | {"speed": 4.0}]]
    write_files(spark, path, rows)
    df = stream(spark, path).withWatermark("ts", "1 day")
    with keyed_state(spark):
        got = run_to_table(keyed_headway(df, ["vehicle"], "speed", "gap", "ts", 86_400_000), "k")
    assert {r.id: r.gap for r in got.collect()} == {1: None, 2: None, 3: 2.5, 4: None}


def test_departures_that_nobody_served_leave_the_stream(spark, feed, tmp_path):
    planned = [("T1", f"2024-08-{d} 08:00:00") for d in (26, 27, 28, 29)] + [("T2", "2024-08-26 12:00:00"), ("T2", None), (None, "2024-08-26 08:00:00")]
    folder = tmp_path / "planned"
    spark.createDataFrame(planned, "trip STRING, due STRING").withColumn("due", F.col("due").cast("timestamp")).coalesce(1).write.parquet(str(folder))
    timetable = spark.read.parquet(str(folder))
    window = (["trip"], "due", "ts", "10 minutes", "30 minutes")
    due = spark.readStream.schema(timetable.schema).parquet(str(folder)).withWatermark("due", "1 hour")
    seen = stream(spark, feed).select("id", "trip", "ts").withWatermark("ts", "1 hour").where("id <> 7")
    closed = run_to_table(stream_match(due, seen, *window), "t")
    rows = lambda df: sorted((str(r.trip), str(r.due), r.id or 0) for r in df.select("trip", "due", "id").collect())
    # Days that the watermark has passed: as the match of the batch, buses that never came among them.
    day = lambda df, at: df.withColumn("day", F.to_date(at))
    landed = spark.read.schema(SCHEMA).json(str(feed)).select("id", "trip", "ts").where("id <> 7")
    near = landed.where(F.date_format("ts", "HH:mm") < "08:31")
    want = match_schedule(day(timetable, "due"), day(near, "ts"), ["trip", "day"], "due").where("due < '2024-08-28'")
    assert rows(closed.where("due < '2024-08-28'")) == rows(want) and ("T1", "2024-08-27 08:00:00", 0) in rows(closed)
    assert ("T1", "2024-08-29 08:00:00", 0) not in rows(closed)
    whole = with_open_departures(closed, timetable, ["trip"], "due")
    assert rows(whole) == rows(stream_match(timetable, landed, *window))
