"""Events replayed as a stream, and results written and read back.

A stream keeps its last windows open until a later row passes the watermark;
those come from a closing batch over the landed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.bindings import rounded, table, texts
from timepoint.bindings.punctuality import ADHERENCE_SQL, DAILY_OUT, daily_sql, study_rows
from timepoint.functions.clock import micros_of_day, wall_micros
from timepoint.operators.ordered import ROWS_PER_PIECE
from timepoint.operators.quality import outage_spells, poll_sessions, snapshot_counts
from timepoint.operators.rollups import SHARE_FLAGS, otp_daily
from timepoint.schemas import POLL, TIMETABLE, struct
from timepoint.session import new_scratch, written
from timepoint.sources.positions import flatten_positions
from timepoint.sources.sinks import combine_daily, stream_sink, write_daily, write_result, write_summary_csv
from timepoint.sources.tables import read_daily
from timepoint.sources.timetable import build_timetable
from timepoint.streaming.feed import (
    feed_gap_monitor,
    run_to_table,
    stream_adherence,
    stream_dedup,
    stream_headway,
    stream_otp,
    stream_stop_events,
    with_dead_windows,
    with_open_sessions,
    with_open_windows,
)
from timepoint.streaming.keyed import keyed_headway, keyed_state, stream_match, with_open_departures

DELAY = "1 hour"
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return reports(spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(folder))


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows at rest."""
    return reports(table(spark, folder, "events"))


def reports(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("vehicle_id"),
        F.col("event_type").alias("route_id"),
        F.from_json("props", "k BIGINT")["k"].alias("stop"),
        F.to_date("ts").alias("service_date"),
        wall_micros(F.col("ts")).alias("at_us"),
        micros_of_day(F.col("ts")).alias("day_us"),
    )


def twice(spark, folder):
    """Every report seen by two polls."""
    return event_stream(spark, folder).union(event_stream(spark, folder))


def dedup(spark, folder):
    df = stream_dedup(twice(spark, folder), ["event_id"], "ts", DELAY)
    return run_to_table(df.select("event_id", "vehicle_id", "at_us"), "dedup")


def last_stops(spark, folder):
    def last(df: DataFrame) -> DataFrame:
        keyed = df.select("vehicle_id", "ts", "event_id", "route_id", "at_us")
        return stream_stop_events(keyed, ["vehicle_id"], "ts", ["event_id"])

    closed = run_to_table(last(stream_dedup(twice(spark, folder), ["event_id"], "ts", DELAY)), "stops")
    rows = with_open_windows(closed, landed(spark, folder), last, "ts")
    return rows.select("vehicle_id", F.col("span.start").cast("date").cast("string").alias("service_date"),
                       "event_id", "route_id", "at_us")


def planned(spark, folder):
    """A static timetable: the mean time of day at each stop; one route has none."""
    e = table(spark, folder, "events").select(
        F.col("event_type").alias("route_id"),
        F.from_json("props", "k BIGINT")["k"].alias("stop"),
        micros_of_day(F.col("ts")).alias("day_us"),
    )
    return e.where("route_id <> 'error'").groupBy("route_id", "stop").agg(
        F.floor(F.sum(F.floor(F.col("day_us") / 1_000_000)) / F.count(F.lit(1))).alias("sched_secs")
    )


def _adherence(spark, folder, events, whole_seconds=False):
    secs = F.col("day_us") / 1_000_000
    timed = events.withColumn("obs_secs", F.floor(secs) if whole_seconds else secs)
    return stream_adherence(timed, planned(spark, folder), ["route_id", "stop"], "sched_secs", "obs_secs")


FLAGS = ["on_time", "on_time_5", "on_time_4", "on_time_20", "late", "late_5", "late_4", "late_20", "early", "early_1"]


def adherence_rows(spark, folder):
    return run_to_table(_adherence(spark, folder, event_stream(spark, folder)).select("event_id", "stop", *FLAGS), "adherence")


def otp_windows(spark, folder):
    def rates(df: DataFrame) -> DataFrame:
        # Whole seconds, so that sums of delays are exact in any order.
        return stream_otp(_adherence(spark, folder, df, whole_seconds=True), "ts", ["route_id"])

    closed = run_to_table(rates(event_stream(spark, folder).withWatermark("ts", DELAY)), "otp")
    rows = with_open_windows(closed, landed(spark, folder), rates, "ts")
    return rows.select(F.col("span.start").cast("string").alias("start"), *[c for c in rows.columns if c != "span"])


def headways(spark, folder):
    root = new_scratch(spark, "headway")
    df = event_stream(spark, folder).select("event_id", "route_id", "service_date", "at_us")
    stream_headway(
        df, ["route_id", "service_date"], "at_us", "headway_us", f"{root}/rows", f"{root}/checkpoint",
        ["event_id"], ROWS_PER_PIECE, 3 * 86_400_000_000,
    ).awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("event_id", "route_id", "headway_us")


def keyed_headways(spark, folder):
    df = event_stream(spark, folder).withWatermark("ts", DELAY).select("event_id", "route_id", "service_date", "at_us", "ts")
    rows = keyed_headway(df, ["route_id", "service_date"], "at_us", "headway_us", "ts", 3 * 86_400_000, ["event_id"])
    with keyed_state(spark):
        return run_to_table(rows.select("event_id", "route_id", "headway_us"), "keyed-headway")


#: Around a departure, where a report counts as its bus.
BEFORE, AFTER = "10 minutes", "30 minutes"


def departures(spark, folder):
    """The timetable of ``planned`` on every day from the first report of a route to its last, as a written table."""
    days = landed(spark, folder).groupBy("route_id").agg(F.min("service_date").alias("first"), F.max("service_date").alias("last"))
    daily = planned(spark, folder).join(days, "route_id").withColumn("day", F.explode(F.sequence("first", "last")))
    due = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("sched_secs"))
    return written(daily.select("route_id", "stop", due.cast("timestamp").alias("due"), wall_micros(due).alias("due_us")), "departures")


def departures_met(spark, folder):
    keys, window = ["route_id", "stop"], ("due", "ts", BEFORE, AFTER)
    timetable = departures(spark, folder)
    path = timetable.inputFiles()[0].rpartition("/")[0]
    due = spark.readStream.schema(timetable.schema).parquet(path).withWatermark("due", DELAY)
    seen = event_stream(spark, folder).withWatermark("ts", DELAY).select(*keys, "ts", "event_id")
    closed = run_to_table(stream_match(due, seen, keys, *window), "departures-met")
    return with_open_departures(closed, timetable, keys, "due").select("route_id", "stop", "due_us", "event_id")


def gap_monitor(spark, folder):
    """Windows so short that in some no report came."""

    def gaps(df: DataFrame) -> DataFrame:
        return feed_gap_monitor(df.select("ts"), "ts", "10 minutes", 3)

    closed = run_to_table(gaps(event_stream(spark, folder).withWatermark("ts", DELAY)), "gaps")
    rows = with_dead_windows(with_open_windows(closed, landed(spark, folder), gaps, "ts"), "10 minutes")
    return rows.select(F.col("span.start").cast("string").alias("start"), "n", "expected", "missing", "share")


#: A report of each kind is awaited every five minutes; fifteen without one are an outage.
STEP, GAP = 300, "15 minutes"


def _spells(sessions: DataFrame) -> DataFrame:
    spells = outage_spells(sessions, STEP, ["route_id"])
    return spells.withColumns({c: F.col(c).cast("string") for c in ("stopped", "resumed")})


def outages(spark, folder):
    return _spells(poll_sessions(landed(spark, folder).select("route_id", "ts"), "ts", GAP, ["route_id"]))


def outages_streamed(spark, folder):
    def sessions(df: DataFrame) -> DataFrame:
        return poll_sessions(df.select("route_id", "ts"), "ts", GAP, ["route_id"])

    closed = run_to_table(sessions(event_stream(spark, folder).withWatermark("ts", DELAY)), "sessions")
    return _spells(with_open_sessions(closed, landed(spark, folder), sessions, "ts", ["route_id"]))


def landing(spark, folder):
    """A stream landed by day and hour, then counted by folder."""
    root = new_scratch(spark, "landing")
    df = event_stream(spark, folder).select(
        "event_id", F.col("service_date").alias("day"), F.floor(F.col("day_us") / 3_600_000_000).alias("hour")
    )
    # A replay holds every hour at once, so the folders are spread over the tasks;
    # a live batch holds one hour and is better left as it comes.
    spread = df.repartition("day", "hour")
    stream_sink(spread, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    landed = spark.read.schema("event_id BIGINT, day DATE, hour BIGINT").parquet(f"{root}/rows")
    return texts(snapshot_counts(landed), ["day"])


def daily_tables(spark, folder):
    """The adherence table by service day, a range of it read back, and its daily rates."""
    root = new_scratch(spark, "daily")
    keep = ["time", "obs", "service_date", "observed_pct", "headway", *SHARE_FLAGS.values()]
    write_daily(combine_daily(study_rows(spark, folder).select(*keep)), f"{root}/adherence")
    days = read_daily(spark, f"{root}/adherence", "1996-01-01", "1997-12-31")
    write_result(otp_daily(days, observed="obs"), f"{root}/otp")
    out = spark.read.parquet(f"{root}/otp")
    rates = [*SHARE_FLAGS, "observed", "median_observed", "mean_headway", "median_headway"]
    return texts(rounded(out, 9, rates), ["service_date", "min_date", "max_date"])


def summary_file(spark, folder):
    """A report as CSV and back."""
    root = new_scratch(spark, "summary")
    df = table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    write_summary_csv(df, f"{root}/summary")
    return spark.read.schema("event_type STRING, n BIGINT").csv(f"{root}/summary", header=True)


def polls(spark, folder):
    """Events packed into the feed's nested form, then flattened."""
    e = table(spark, folder, "events")
    secs = (wall_micros(F.col("ts")) / 1_000_000).cast("decimal(18,6)").cast("string")
    vehicle = F.struct(
        F.struct(F.col("event_type"), F.col("event_type"), F.date_format("ts", "yyyyMMdd")),
        F.struct(F.col("value"), -F.col("value"), F.col("value") / 2),
        F.struct(F.col("user_id").cast("string"), F.col("event_type")),
        F.get_json_object("props", "$.k"),
        F.lit(1),
        secs,
    )
    entity = F.array(F.struct(F.col("event_id").cast("string"), vehicle))
    nested = e.select(
        F.lit("positions_data_20240826080003.json").alias("file"),
        F.lit(None).cast("timestamp_ntz").alias("poll_ts"),
        F.struct(secs).cast(struct(POLL)["header"].dataType).alias("header"),
        entity.cast(struct(POLL)["entity"].dataType).alias("entity"),
    )
    flat = flatten_positions(nested)
    return flat.select(
        F.col("entity_id").cast("bigint").alias("event_id"), "vehicle_id", "trip_id", "start_date", "stop_id",
        "lat", "lon", "speed_mps", "hour", "minute", "second", wall_micros(F.col("ts")).alias("local_us"),
    )


def timetables(spark, folder):
    """Orders packed as timetable responses of three trips with three stops, then built.

    A response has two entries for its direction; the stop list of the second is not taken.
    """
    o = table(spark, folder, "orders")
    day = F.dayofmonth("o_orderdate").cast("bigint")
    times = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.struct(
        (day * 3600 + i * F.month("o_orderdate") * 60).cast("bigint"), i == 0))

    def trip(suffix: str):
        return F.struct(
            F.concat(F.col("o_orderkey"), F.lit(suffix)), F.col("o_orderpriority"), F.col("o_custkey").cast("string"),
            F.lit(False), times,
        )

    def entry(names: list[str], *trips):
        stops = F.transform(F.array(*[F.lit(n) for n in names]), lambda s: F.struct(
            F.concat(s, F.col("o_custkey").cast("string")), F.upper(s)))
        return F.struct(
            F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.to_date("o_orderdate").cast("string"),
            F.lit("0"), F.array(*trips), stops,
        )

    entries = F.array(entry(["a", "b"], trip(""), trip("-b")), entry(["x", "y", "z"], trip("-c")))
    nested = o.select(entries.cast(struct(TIMETABLE)["data"].dataType).alias("data"))
    built = build_timetable(nested)
    return texts(built, ["service_date"]).select(
        "route_id", "service_date", "trip_id", "block_id", "sched_secs", "sched_hour", "sched_minute", "row",
        "is_wait_stop", "stop_id", "stop_name",
    )


QUERIES = {
    "stream_dedup": dedup,
    "stream_stop_events": last_stops,
    "stream_adherence": adherence_rows,
    "stream_otp": otp_windows,
    "stream_headway": headways,
    "stream_headway_keyed": keyed_headways,
    "stream_departures": departures_met,
    "feed_gap_monitor": gap_monitor,
    "outage_spells": outages,
    "outage_spells_streamed": outages_streamed,
    "stream_landing": landing,
    "daily_tables": daily_tables,
    "summary_csv": summary_file,
    "flatten_positions": polls,
    "flatten_timetable": timetables,
}

_EVENTS = """
WITH e AS (
  SELECT event_id, ts, user_id AS vehicle_id, event_type AS route_id,
         CAST(json_extract(props, '$.k') AS BIGINT) AS stop, epoch_us(ts) AS at_us,
         epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS day_us
  FROM events
)
"""
def _planned_sql(observed: str) -> str:
    return f"""{_EVENTS}, planned AS (
  SELECT route_id, stop, CAST(sum(day_us // 1000000) AS BIGINT) // count(*) AS sched_secs FROM e
  WHERE route_id <> 'error' GROUP BY route_id, stop
), a AS (
  SELECT e.*, {observed} - sched_secs AS delay FROM e LEFT JOIN planned ON e.stop = planned.stop AND e.route_id = planned.route_id
), f AS (
  SELECT *, delay BETWEEN -120 AND 420 AS on_time, delay BETWEEN -60 AND 300 AS on_time_5,
         delay BETWEEN -60 AND 240 AS on_time_4, delay <= 1200 AS on_time_20, delay > 420 AS late,
         delay > 300 AS late_5, delay > 240 AS late_4, delay > 1200 AS late_20, delay < -120 AS early,
         delay < -60 AS early_1 FROM a
)
"""


_PLANNED = _planned_sql("day_us / 1000000::DOUBLE")
_PLANNED_WHOLE = _planned_sql("day_us // 1000000")


_OUTAGES = """
WITH e AS (SELECT event_type AS route_id, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events)
SELECT route_id, CAST(before AS VARCHAR) AS stopped, CAST(ts AS VARCHAR) AS resumed, (epoch_us(ts) - epoch_us(before)) / 1000000 AS seconds,
       CAST(ceil((epoch_us(ts) - epoch_us(before)) / 300000000) - 1 AS BIGINT) AS missed
FROM e WHERE ts - before >= INTERVAL 15 MINUTE
"""

_HEADWAYS = f"""{_EVENTS} SELECT event_id, route_id, at_us - lag(at_us) OVER (
        PARTITION BY route_id, CAST(ts AS DATE) ORDER BY at_us, event_id) AS headway_us FROM e"""

ORACLES = {
    "stream_headway": _HEADWAYS,
    "stream_headway_keyed": _HEADWAYS,
    "stream_departures": f"""{_EVENTS}, planned AS (
          SELECT route_id, stop, CAST(sum(day_us // 1000000) AS BIGINT) // count(*) AS secs FROM e WHERE route_id <> 'error' GROUP BY ALL
        ), days AS (
          SELECT route_id, unnest(generate_series(CAST(min(CAST(ts AS DATE)) AS TIMESTAMP), CAST(max(CAST(ts AS DATE)) AS TIMESTAMP),
            INTERVAL 1 DAY)) AS day FROM e GROUP BY route_id
        ), d AS (SELECT route_id, stop, day + to_seconds(secs) AS due FROM planned JOIN days USING (route_id))
        SELECT d.route_id, d.stop, epoch_us(d.due) AS due_us, e.event_id FROM d LEFT JOIN e ON e.route_id = d.route_id
          AND e.stop = d.stop AND e.ts BETWEEN d.due - INTERVAL 10 MINUTE AND d.due + INTERVAL 30 MINUTE""",
    "outage_spells": _OUTAGES,
    "outage_spells_streamed": _OUTAGES,
    "stream_dedup": f"{_EVENTS} SELECT event_id, vehicle_id, at_us FROM e",
    "stream_stop_events": f"""{_EVENTS}, r AS (SELECT *, row_number() OVER (
          PARTITION BY vehicle_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM e)
        SELECT vehicle_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS service_date, event_id, route_id, at_us
        FROM r WHERE rn = 1""",
    "stream_adherence": f"{_PLANNED} SELECT event_id, stop, {', '.join(FLAGS)} FROM f",
    "stream_otp": f"""{_PLANNED_WHOLE} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, route_id,
        count(*) AS n, count(delay) AS n_scheduled,
        avg(CAST(on_time AS INT)) AS on_time_perc, avg(CAST(on_time_5 AS INT)) AS on_time_perc_5,
        avg(CAST(on_time_4 AS INT)) AS on_time_perc_4,
        avg(CAST(on_time_20 AS INT)) AS on_time_perc_20, avg(delay) AS mean_delay
        FROM f GROUP BY 1, 2""",
    "feed_gap_monitor": f"""{_EVENTS}, c AS (
          SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n FROM e GROUP BY 1
        ), spine AS (SELECT unnest(generate_series(min(start), max(start), INTERVAL 10 MINUTE)) AS start FROM c)
        SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, coalesce(n, 0) AS n, CAST(3 AS BIGINT) AS expected,
               greatest(3 - coalesce(n, 0), 0) AS missing, coalesce(n, 0) / 3 AS share
        FROM spine LEFT JOIN c USING (start)""",
    "stream_landing": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, hour(ts) AS hour, count(*) AS n
        FROM events GROUP BY 1, 2""",
    "daily_tables": f"""{ADHERENCE_SQL}, {daily_sql('')}
        SELECT CAST(service_date AS VARCHAR) AS service_date, time, {DAILY_OUT} FROM daily
        WHERE service_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""",
    "summary_csv": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "flatten_positions": """WITH e AS (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS lt FROM events)
        SELECT event_id, CAST(user_id AS VARCHAR) AS vehicle_id, event_type AS trip_id,
               strftime(ts, '%Y%m%d') AS start_date, CAST(json_extract(props, '$.k') AS VARCHAR) AS stop_id,
               value AS lat, -value AS lon, value / 2 AS speed_mps, hour(lt) AS hour, minute(lt) AS minute,
               CAST(second(lt) AS BIGINT) AS second, epoch_us(lt) AS local_us FROM e""",
    "flatten_timetable": """WITH s AS (SELECT *, unnest([0, 1, 2]) AS i, suffix
          FROM orders CROSS JOIN (VALUES (''), ('-b'), ('-c')) AS v(suffix)),
        t AS (SELECT *, CAST(day(o_orderdate) * 3600 + i * month(o_orderdate) * 60 AS BIGINT) AS secs FROM s)
        SELECT CAST(o_orderkey AS VARCHAR) AS route_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS service_date,
               CAST(o_orderkey AS VARCHAR) || suffix AS trip_id, CAST(o_custkey AS VARCHAR) AS block_id, secs AS sched_secs,
               secs // 3600 AS sched_hour, (secs % 3600) // 60 AS sched_minute, CAST(i + 1 AS BIGINT) AS row,
               i = 0 AS is_wait_stop,
               CASE i WHEN 0 THEN 'a' WHEN 1 THEN 'b' END || CAST(o_custkey AS VARCHAR) AS stop_id,
               CASE i WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS stop_name FROM t""",
}
