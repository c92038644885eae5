import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timepoint.functions.clock import bell_window, day_part, polling_hours, school_hours
from timepoint.operators.adherence import (
    DelayWindows,
    add_delay,
    add_headway,
    assess,
    headway_flags,
    late_early_flags,
    match_schedule,
    on_time_bounds,
    on_time_flags,
    trip_coverage,
)
from timepoint.operators.ordered import (
    in_pieces,
    split_hot,
    first_per_key,
    number_all_rows,
    number_rows,
    previous_value,
    sample_one,
    share_of_total,
)
from timepoint.operators.rollups import exact_median, otp_daily, otp_grains, otp_period

FLAGS = (
    "on_time on_time_5 on_time_4 on_time_20 late late_5 late_4 late_20 early early_1 "
    "optimistic_on_time pessimistic_on_time"
).split()
CASES = {
    -121: "FFFTFFFFTTFF",
    -120: "TFFTFFFFFTTT",
    -60: "TTTTFFFFFFTT",
    240: "TTTTFFFFFFTT",
    241: "TTFTFFTFFFTT",
    300: "TTFTFFTFFFTT",
    301: "TFFTFTTFFFTT",
    420: "TFFTFTTFFFTT",
    421: "FFFTTTTFFFFF",
    1200: "FFFTTTTFFFFF",
    1201: "FFFFTTTTFFFF",
    None: "..........TF",
}


@pytest.fixture(scope="module")
def flagged(spark):
    rows = [(i, 28_800, None if d is None else 28_800 + d) for i, d in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i INT, sched INT, obs INT").transform(add_delay, "sched", "obs")
    return df.transform(on_time_flags).transform(late_early_flags).transform(on_time_bounds, "obs").cache()


def test_flags(flagged):
    got = [[r[f] for f in FLAGS] for r in flagged.orderBy("i").collect()]
    want = [[{"T": True, "F": False, ".": None}[c] for c in line] for line in CASES.values()]
    assert got == want


def test_flag_totals(flagged):
    df = flagged.withColumns(
        {"observed_pct": F.lit(1.0), "headway": F.lit(None).cast("double"), "headway_adherence": F.lit(None).cast("boolean"),
         "service_date": F.lit("d"), "time": F.lit("morning")}
    )
    r = otp_daily(df, observed="obs").first()
    assert r.on_time_perc == 7 / 11 and r.observed == 11 / 12
    assert r.optimistic_on_time_perc == 8 / 12 and r.pessimistic_on_time_perc == 7 / 12
    assert r.mean_headway is None


def test_windows_are_parameters(spark):
    w = DelayWindows(on_time={"ok": (-60, 240)})
    df = spark.createDataFrame([(-61,), (240,)], "delay INT").transform(on_time_flags, "delay", w)
    assert [r.ok for r in df.collect()] == [False, True]


HEADWAYS = [("T1", 0, 1), ("T2", 10, 6), ("T3", 20, None), ("T4", 30, 30), ("T5", 40, 40)]


@pytest.mark.parametrize("piece", [None, 2, 1000])
def test_headways(spark, piece):
    df = spark.createDataFrame(HEADWAYS, "trip STRING, sched INT, obs INT").withColumn("stop", F.lit("s"))

    df = add_headway(df, ["stop"], "obs", "headway", ["trip"], 1.0, piece)
    df = add_headway(df, ["stop"], "sched", "scheduled_headway", ["trip"], 1.0, piece)
    got = {r.trip: r for r in df.transform(headway_flags).collect()}
    assert [got[t].headway for t in sorted(got)] == [None, 5, None, 24, 10]
    assert [got[t].scheduled_headway for t in sorted(got)] == [None, 10, 10, 10, 10]
    assert [got[t].over_spaced for t in sorted(got)] == [None, False, None, True, False]
    assert [got[t].bunched for t in sorted(got)] == [None, True, None, False, False]
    assert [got[t].headway_adherence for t in sorted(got)] == [None, False, None, False, True]


def test_coverage_counts_fan_out(spark):
    rows = [("a", r, 1 if r < 4 else None) for r in range(1, 5)]
    rows += [("b", 1, 1), ("b", 2, 1), ("b", 2, 1), ("b", 3, 1), ("b", 4, 1), (None, 2, 1)]
    df = spark.createDataFrame(rows, "trip STRING, row INT, obs INT")
    got = {r.trip: r.observed_pct for r in trip_coverage(df, ["trip"], "row", "obs").collect()}
    assert got == {"a": 0.75, "b": 1.25, None: 0.5}


def test_unmatched_rows_stay_and_key_types_meet(spark):
    tt = spark.createDataFrame([(1, 100), (2, 200), (3, None)], "trip INT, sched INT")
    ev = spark.createDataFrame([("1", 110), ("1", 120), ("9", 5)], "trip STRING, obs INT")
    got = match_schedule(tt, ev, ["trip"], "sched").orderBy("trip", "obs").collect()
    assert [(r.trip, r.obs, r.planned) for r in got] == [("1", 110, True), ("1", 120, True), ("2", None, True)]


@given(
    tt=st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=12),
    ev=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.integers(0, 9)), max_size=12),
)
@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
def test_split_match_equals_the_outer_join(spark, tt, ev):
    a = spark.createDataFrame(tt, "k INT, sched INT")
    b = spark.createDataFrame(ev, "k INT, obs INT")
    split = match_schedule(a, b, ["k"], "sched")
    whole = match_schedule(a, b, ["k"], "sched", split_hot=False)
    assert sorted(map(str, split.select(whole.columns).collect())) == sorted(map(str, whole.collect()))


@pytest.fixture
def tight(spark):
    """Thresholds at which small test data counts as skewed; nothing is broadcast."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark):
    """A third of the rows on one key."""
    return spark.range(0, 200_000, 1, 8).selectExpr("id", "IF(id % 3 = 0, 0, id % 5000) AS k", "id * 7 % 86400 AS at")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_split(spark, tight):
    df = hot(spark)
    assert "skew=true" in final_plan(trip_coverage(df.withColumn("row", F.col("at")), ["k"], "row", "at"))
    tt = spark.range(5000).selectExpr("id AS k", "id AS sched")
    assert "skew=true" in final_plan(match_schedule(tt, df.withColumnRenamed("at", "obs"), ["k"], "sched"))


@pytest.mark.parametrize("rows", [60_000, 120_000])
def test_hot_groups_are_ordered_in_pieces(spark, rows):
    """No task orders more than about a piece, however large the group is and however many values are equal."""
    df = spark.range(0, rows, 1, 8).selectExpr("id", "IF(id % 3 = 0, 0, id % 5000) AS k", "id * 7 % 50 AS at").cache()
    most = 2_000
    cold, large = split_hot(df, ["k"], most)
    assert {r.k for r in large.select("k").distinct().collect()} == {0} and cold.count() + large.count() == rows
    placed = in_pieces(large, ["k"], ["at", "id"], most)
    assert placed.groupBy("_piece").count().agg(F.max("count")).first()[0] <= 2 * most
    got = previous_value(df, ["k"], "at", "p", ["id"], most)
    want = previous_value(df, ["k"], "at", "p", ["id"])
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == rows
    df.unpersist()


rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-40, 40))), min_size=1, max_size=40
)
SLOW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@given(rows=rows_strategy, most=st.integers(1, 12))
@SLOW
def test_pieces_give_the_plain_window(spark, rows, most):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "i INT, k STRING, v INT").cache()
    whole = previous_value(df, ["k"], "v", "p", ["i"])
    parts = previous_value(df, ["k"], "v", "p", ["i"], most)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.select(whole.columns).collect()))
    known = df.where("v IS NOT NULL")
    a = number_rows(known, ["k"], ["v", "i"])
    b = number_rows(known, ["k"], ["v", "i"], rows_per_piece=most)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@given(rows=rows_strategy, most=st.sampled_from([1, 5, 100]))
@SLOW
def test_exact_median(spark, rows, most):
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k STRING, v DOUBLE")
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).where("m IS NOT NULL").collect()}
    assert {r.k: r.median for r in exact_median(df, ["k"], "v", rows_per_piece=most).collect()} == want


def test_number_all_rows(spark):
    df = spark.range(1000).select((F.lit(5000) - F.col("id") * 3).alias("v")).repartition(7)
    got = number_all_rows(df, ["v"]).orderBy("v").collect()
    assert [r.row for r in got] == list(range(1, 1001))


def test_first_row_sample_and_share(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 5), ("b", 3, 4)], "k STRING, o INT, v INT")
    assert sorted(map(tuple, first_per_key(df, ["k"], ["o"]).collect())) == [("a", 1, 5), ("b", 3, 4)]
    one = sample_one(df, ["k"], "o", "seed")
    assert one.count() == 2 and one.collect() == sample_one(df, ["k"], "o", "seed").collect()
    shares = share_of_total(df, "v", "pct", "all")
    assert sorted((r.pct, r.all) for r in shares.collect()) == [(10.0, 10), (40.0, 10), (50.0, 10)]
    assert share_of_total(df.where("v < 0"), "v", "pct").count() == 0


@pytest.fixture(scope="module")
def adherence(spark):
    tt = spark.range(400).selectExpr(
        "CAST(id AS STRING) AS trip_id", "CAST(id % 4 AS STRING) AS route_id", "CAST(id % 3 AS STRING) AS stop_id",
        "DATE '2024-08-26' + CAST(id % 5 AS INT) AS service_date", "18000 + id * 100 AS sched_secs",
        "1L AS row", "'b' AS block_id",
    )
    ev = spark.range(400).where("id % 6 > 0").selectExpr(
        "CAST(id AS STRING) AS trip_id", "CAST(18000 + id * 100 + (id * 37) % 900 - 200 AS DOUBLE) AS obs_secs"
    )
    df = assess(tt, ev, ["trip_id"], ["stop_id", "route_id"], ["trip_id"], tie=["trip_id"])
    hour = F.floor(F.col("sched_secs") / 3600)
    return df.withColumn("time", day_part(hour)).cache()


def test_pieces_do_not_change_adherence(spark, adherence):
    assert adherence.where("headway IS NOT NULL").count() > 300
    assert adherence.where("observed_pct = 0").count() == 67


def test_bounds_enclose_the_observed_share(adherence):
    for r in otp_daily(adherence, ["route_id"]).collect():
        assert r.pessimistic_on_time_perc <= r.optimistic_on_time_perc
        if r.on_time_perc is not None:
            assert r.pessimistic_on_time_perc <= r.on_time_perc <= r.optimistic_on_time_perc


def test_late_on_time_early_partition_the_observed(adherence):
    seen = adherence.where("obs_secs IS NOT NULL")
    split = seen.where("CAST(late AS INT) + CAST(on_time AS INT) + CAST(early AS INT) = 1")
    assert seen.count() == split.count() == 333


def test_grains_equal_the_separate_reports(adherence):
    grains = otp_grains(adherence, "route_id", "stop_id")
    for grain, by in (("system", []), ("line", ["route_id"]), ("stop", ["stop_id"])):
        one = otp_daily(adherence, by)
        cols = sorted(one.columns)
        same = grains.where(F.col("grain") == grain).select(cols)
        assert sorted(map(str, same.collect())) == sorted(map(str, one.select(cols).collect()))


def test_strict_period_keeps_a_missing_day_missing(spark, adherence):
    daily = otp_daily(adherence)
    hole = daily.withColumn("on_time_perc", F.when(F.col("service_date") != F.lit("2024-08-26").cast("date"), F.col("on_time_perc")))
    loose = {r.time: r for r in otp_period(hole).collect()}
    strict = {r.time: r for r in otp_period(hole, strict=True).collect()}
    assert all(r.on_time_perc is not None and r.n_days_used == r.n_days - 1 for r in loose.values())
    assert all(r.on_time_perc is None and r.mean_headway is not None for r in strict.values())


def test_both_headways_share_one_exchange_when_whole(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS sched", "id * 2 AS obs")
    df = add_headway(df, ["k"], "obs", "h", ["sched"])
    df = add_headway(df, ["k"], "sched", "s", ["sched"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1


def test_day_parts_and_windows(spark):
    df = spark.createDataFrame(
        [(14, 20), (14, 21), (16, 59), (17, 0), (5, 59), (6, 0)], "h INT, m INT"
    )
    assert [r[0] for r in df.select(school_hours(F.col("h"), F.col("m"))).collect()] == [
        False, True, True, False, False, True
    ]
    parts = df.select(day_part(F.col("h"), morning=(6, 7, 8), otherwise=None)).collect()
    assert [r[0] for r in parts] == ["afternoon"] * 3 + [None, None, "morning"]
    times = spark.createDataFrame([(26_100,), (26_101,), (27_899,), (27_900,)], "t INT")
    got = times.select(bell_window(F.lit("morning"), F.col("t"), F.lit(27_900), F.lit(0), 30)).collect()
    assert [r[0] for r in got] == [False, True, True, False]
    clock = spark.sql("SELECT explode(array(TIMESTAMP_NTZ '2024-08-26 03:59:00', TIMESTAMP_NTZ '2024-08-26 04:00:00',"
                      "TIMESTAMP_NTZ '2024-08-26 23:59:00', TIMESTAMP_NTZ '2024-08-27 00:30:00')) AS t")
    assert [r[0] for r in clock.select(polling_hours(F.col("t"))).collect()] == [False, True, True, False]
