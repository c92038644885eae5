import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timepoint.functions.clock import SCHOOL_MORNING_HOURS, day_part
from timepoint.operators.arrivals import (
    arrival_stats_wide,
    attach_classes,
    bell_classes,
    bus_capacity,
    collapse_mean,
    hourly_buses,
    near_bell,
    near_school_share,
    part_buses,
)
from timepoint.operators.joins import attach_bells
from timepoint.operators.people import ratio_of_totals
from timepoint.operators.reshape import pivot_sums, stack, unpivot_wide
from timepoint.operators.rides import valid_county_stops
from timepoint.operators.trips import latest_feasible_departure, trip_summary
from timepoint.plans.children import children_reports, located_tracts
from timepoint.plans.county_rides import county_reports
from timepoint.plans.on_time import on_time_reports
from timepoint.plans.school_capacity import arrivals_over_period, capacity_report, daily_arrivals, stops_near_schools
from timepoint.plans.school_trips import (
    departures,
    enrollment_pairs,
    router_points,
    trip_reports,
    trips_to_model,
)

SLOW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
CROSSING = "**RAILROAD CROSSING - PROCEED WITH CAUTION**"
COUNTY = "route STRING, source_file STRING, stop INT, location STRING, time DOUBLE, students DOUBLE"


def clock(text):
    h, m = text.split(":")
    return float(h) * 3600 + float(m) * 60


def county(spark, *files):
    stops = [(1, "Corner", "06:30", 0), (2, "Corner", "06:40", 3), (3, "Corner", "06:50", 1),
             (4, CROSSING, "06:55", 0), (5, "School", "07:00", -4)]
    rows = [(r, f, s, l, clock(t), float(n)) for r, f in files for s, l, t, n in stops]
    return spark.createDataFrame(rows, COUNTY)


def test_county_rides(spark):
    df = county(spark, ("R AM", "f"), ("R AM", "g"), ("R", "f"), ("Z NON-TRANSPORTED ZONE AM", "f"))
    out = county_reports(df)
    routes = out["morning_routes"].collect()
    assert [(r.route, r.source_file, r.avg_time, r.students) for r in routes] == [("R AM", "f", 17.5, 4.0)]
    assert routes[0].avg_boarding_time == clock("06:42") + 30 and routes[0].avg_alighting_time == clock("07:00")
    total = out["morning_total"].first()
    assert (total.n, total.avg_time, total.students, total.students_per_route) == (1, 17.5, 4.0, 4.0)
    assert [(r.route, r.n, r.students) for r in out["untagged"].collect()] == [("R", 3, 4.0)]
    zone = out["morning_zone_spans"].collect()
    assert [(r.n, r.students, r.net_time) for r in zone] == [(3, 3.0, 20.0)]
    assert out["afternoon_total"].first().n == 0
    assert out["morning_zone_total"].first().unweighted_avg_time == 15.0
    assert out["untagged_total"].first().n == 1
    assert {r.net_students for r in out["spans"].collect()} == {0.0}


def test_last_stop_of_route_or_of_table(spark):
    rows = [("A AM", "f", 1, "x", 0.0, 2.0), ("A AM", "f", 2, "x", 60.0, 0.0),
            ("B AM", "f", 1, "x", 0.0, 2.0), ("B AM", "f", 3, "x", 60.0, 0.0)]
    df = spark.createDataFrame(rows, COUNTY)
    assert valid_county_stops(df).count() == 2
    assert valid_county_stops(df, scope="table").count() == 3


def leg(trip, seg, mode, minutes, route=None, total=45.0, wait=0.0):
    return (f"t{trip}", "s", seg, mode, route, minutes, minutes * 100, wait, total, total * 100)


LEGS = "from_id STRING, to_id STRING, segment INT, mode STRING, route STRING, segment_duration DOUBLE, distance DOUBLE, wait DOUBLE, total_duration DOUBLE, total_distance DOUBLE"


def test_trip_reports(spark):
    legs = spark.createDataFrame(
        [leg(1, 1, "WALK", 5.0), leg(1, 2, "BUS", 20.0, "R1", wait=5.0), leg(1, 3, "WALK", 2.0),
         leg(1, 4, "BUS", 10.0, "R2"), leg(1, 5, "WALK", 3.0), leg(2, 1, "WALK", 15.0, total=15.0)],
        LEGS,
    ).repartition(3)
    pairs = spark.createDataFrame(
        [("t1", "s", 10, "School", "1", 28_800, 25_000, 45.0), ("t2", "s", 30, "School", "1", 28_800, 27_000, 15.0),
         ("t3", "s", 5, "Other", "2", 27_900, 24_000, None)],
        "from_id STRING, to_id STRING, students INT, name STRING, prog_no STRING, opening_secs INT, "
        "latest_departure INT, travel_time DOUBLE",
    )
    routes = spark.createDataFrame(
        [("R1", "Line 1", "1"), ("R2", "Line 2", "2"), ("R3", None, "3")], "route STRING, name STRING, short_name STRING"
    )
    out = trip_reports(legs, pairs, routes)
    t1 = out.trips.where("from_id = 't1'").first()
    assert t1.modes == ["WALK", "BUS", "WALK", "BUS", "WALK"] and t1.routes == [None, "R1", None, "R2", None]
    assert t1.short_names == [None, "1", None, "2", None]
    assert (t1.trip_legs, t1.bus_time, t1.walk_time, t1.wait, t1.total_duration) == (5, 30.0, 10.0, 5.0, 45.0)
    assert t1.total_distance == 4500 * 0.000621371
    p = out.profile.first()
    assert p.enrollment_approx == 45 and p.total_duration == 22.5
    assert p.bus_use_pct == pytest.approx(1000 / 45) and p.subway_use_pct == 0.0
    assert p.transfers == pytest.approx(10 / 45) and p.legs == pytest.approx((50 + 30) / 45)
    assert p.pct_students_greater_than_0_transfer == pytest.approx(1000 / 45)
    assert p.median_walk_time == 12.5
    c = out.city.first()
    assert c.n == 3 and c.pct_over_30_total_duration == pytest.approx(100 / 3)
    assert c.pct_over_30_bus_time == 0 and c.pct_over_0_transfers == pytest.approx(100 / 3)
    assert {r.name: r.n for r in out.by_school.collect()} == {"School": 2, "Other": 1}
    assert out.by_tract.count() == 3
    assert {r.name: r.max_total_duration for r in out.longest.collect()} == {"School": 45.0, "Other": None}
    assert [(r.route, r.total_routes, r.total_students) for r in out.popular_routes.collect()] == [
        ("R1", 1, 10), ("R2", 1, 10)
    ]
    shares = out.used_routes.collect()
    assert [r.pct_of_trips for r in shares] == [50.0, 50.0] and {r.sum for r in shares} == {100.0}
    assert out.departures_all.first().median_departure == 25_000
    assert out.departures_by_bell.count() == 2
    assert out.travel_times.first().median_travel_time == 30.0


def probe(hhmm, p50):
    return ("h", "s", int(clock(hhmm)), p50)


def test_latest_departure(spark):
    pairs = spark.createDataFrame([("h", "s", 28_800), ("x", "s", 28_800)], "from_id STRING, to_id STRING, opening_secs INT")
    probes = spark.createDataFrame(
        [probe("07:00", 50), probe("07:10", 44), probe("07:20", 40), probe("07:30", 20), probe("06:50", None)],
        "from_id STRING, to_id STRING, departure_time INT, travel_time_p50 INT",
    )
    got = {r.from_id: r for r in departures(probes, pairs).collect()}
    assert got["h"].latest_departure == clock("07:10") and got["h"].travel_time == 44
    assert got["h"].arrival_time == clock("07:54")
    assert got["x"].latest_departure == clock("07:00") and got["x"].travel_time is None


def test_probes_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """However few bytes the trips have, no task holds many more probes than it should."""
    from timepoint.bindings import trips

    orders = "id AS o_orderkey", "id AS o_custkey", "'HIGH' AS o_orderpriority", "TIMESTAMP_NTZ '2024-05-06 00:00:00' AS o_orderdate"
    spark.range(4000).selectExpr(*orders).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(4000).selectExpr("id AS l_orderkey", "CAST(id % 50 AS DOUBLE) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(trips, "PROBES_PER_PIECE", 3000, raising=False)
    held = trips.probes(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert held[0] < 6000 and held[1] == 60_000
    assert trips.latest_departure(spark, str(tmp_path)).where("n_probes > 0").count() == 4000


@given(runs=st.lists(st.lists(st.sampled_from([True, False, None]), min_size=1, max_size=15), min_size=1, max_size=6))
@SLOW
def test_latest_departure_equals_a_loop(spark, runs):
    rows = [(k, d, ok, d) for k, run in enumerate(runs) for d, ok in enumerate(run)]
    df = spark.createDataFrame(rows + rows, "k INT, d INT, ok BOOLEAN, t INT")
    got = {r.k: r.latest_departure for r in latest_feasible_departure(df, ["k"], "d", "ok", "t").collect()}
    for k, run in enumerate(runs):
        kept = None
        for d, ok in enumerate(run):
            if ok is False:
                break
            kept = d if ok else kept
        assert got[k] == kept


def test_trip_summary_has_no_list_unless_asked(spark):
    legs = spark.createDataFrame([leg(1, 1, "WALK", 5.0)], LEGS)
    assert "modes" not in trip_summary(legs, ["from_id"]).columns


def test_enrollment_and_places(spark):
    wide = spark.createDataFrame(
        [("p1", "High East", "40", 12.0, None, 0.0)],
        "prog_no STRING, program STRING, enrollment STRING, x24510010100 DOUBLE, x24510010200 DOUBLE, x24510010300 DOUBLE",
    )
    pairs = enrollment_pairs(wide)
    assert sorted((r.census_tract, r.students, r.program_join) for r in pairs.collect()) == [
        ("24510010100", 12.0, "high_east"), ("24510010200", 5.0, "high_east")
    ]
    schools = spark.sql("SELECT 'p1' AS prog_no, 39.1D AS school_lat, -76.1D AS school_lon")
    homes = spark.sql("SELECT '24510010100' AS census_tract, 39.2D AS tract_lat, -76.2D AS tract_lon")
    bells = spark.sql("SELECT 'p1' AS prog_no, 28800 AS opening_secs, 52800 AS closing_secs")
    trips = trips_to_model(pairs, schools, homes, bells)
    ends = router_points(trips).orderBy("census_tract", "coord_type").collect()
    assert [(r.coord_type, r.lat) for r in ends] == [
        ("home_tract_lat_lon", 39.2), ("school_lat_lon", 39.1), ("home_tract_lat_lon", None), ("school_lat_lon", 39.1)
    ]


@given(values=st.dictionaries(st.tuples(st.integers(0, 4), st.sampled_from("abc")), st.integers(1, 9), min_size=1))
@SLOW
def test_unpivot_undoes_pivot(spark, values):
    df = spark.createDataFrame([(k, n, v) for (k, n), v in values.items()], "k INT, n STRING, v INT")
    wide = pivot_sums(df, ["k"], "n", "v", ["a", "b", "c"])
    back = unpivot_wide(wide, ["k"], "n", "v").where("v IS NOT NULL")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_stack_fills_missing_columns(spark):
    df = stack(spark.sql("SELECT 1 AS a, 2 AS b"), spark.sql("SELECT 3 AS b, 4 AS c"))
    assert sorted(map(str, df.collect())) == ["Row(a=1, b=2, c=None)", "Row(a=None, b=3, c=4)"]


def test_children(spark):
    def acs(a, b):
        rows = [("a", "B01001_003", a - 1), ("a", "B01001_027", 1), ("a", "B01001_001", 999), ("b", "B01001_030", b)]
        return spark.createDataFrame([(g, v, float(e)) for g, v, e in rows], "geoid STRING, variable STRING, estimate DOUBLE")

    ring = "array(struct({x} AS x, 0D AS y), struct({x} + 1D AS x, 0D AS y), struct({x} + 1D AS x, 1D AS y), struct({x} AS x, 1D AS y))"
    shapes = spark.sql(f"SELECT 'a' AS geoid, {ring.format(x='0D')} AS ring UNION ALL SELECT 'b', {ring.format(x='4D')}")
    xwalk = spark.sql("SELECT 'a' AS geoid, 'Canton' AS area")
    new, old = (located_tracts(acs(*v), shapes, shapes, xwalk) for v in ((30, 70), (50, 50)))
    out = children_reports(old, new)
    got = {r.area: (r.pct_diff, r.pct_total_2023, r.total_kids_2010) for r in out["change"].collect()}
    assert got == {"Canton": (-20.0, 30.0, 50.0), None: (20.0, 70.0, 50.0)}
    assert [(r.side, r.pct_total) for r in out["side_2023"].collect()] == [("east", 70.0), ("west", 30.0)]


def test_ratio_of_totals(spark):
    df = spark.createDataFrame([(10, 1), (20, 2), (5, 0)], "m INT, w INT")
    assert ratio_of_totals(df, "m", "w", "r").first().r == 35 / 3
    assert ratio_of_totals(df.where("w = 0"), "m", "w", "r").first().r is None


def test_bus_counts(spark):
    rows = [("S", 7, "v1", "T1"), ("S", 7, "v1", "T1"), ("S", 8, "v1", "T1"), ("S", 7, "v2", "T2")]
    df = spark.createDataFrame(rows, "school STRING, hour INT, vehicle STRING, trip STRING")
    assert {r.hour: r.n for r in hourly_buses(df, ["school"], "hour", ["vehicle", "trip"]).collect()} == {7: 2, 8: 1}
    part = part_buses(df, ["school"], "hour", ["vehicle", "trip"], F.lit("morning")).first()
    assert (part.n, part.n_unique) == (3, 2)


def _visits(spark):
    """Arrivals at twenty stops by trips that pass several, with twice-seen, unnamed and late ones."""
    from random import Random

    r = Random(3)
    rows = []
    for _ in range(3000):
        hour, minute = r.choice((5, 6, 7, 7, 8, 14, 15, 15, 16)), r.randrange(60)
        secs = None if r.random() < 0.03 else float(hour * 3600 + minute * 60)
        rows.append((str(r.randrange(20)), r.choice(("d1", "d2", None)), r.choice(("v1", "v2", "v3", None)), f"t{r.randrange(4)}", hour, minute, secs))
    return spark.createDataFrame(
        rows, "stop_id STRING, service_date STRING, vehicle_id STRING, trip_id STRING, obs_hour BIGINT, obs_minute BIGINT, obs_secs DOUBLE"
    )


def test_arrivals_by_sets_of_stops_are_those_of_the_join(spark):
    """Schools with several, one-sided and missing bells, and pairs given twice: counts as of the rows joined to every school."""
    from random import Random

    r = Random(5)
    arrivals = _visits(spark)
    near = [(str(r.randrange(20)), r.choice((*[f"s{i}" for i in range(15)], None))) for _ in range(90)]
    bells = [(f"s{i}", r.choice((27_000, 28_800, None)), r.choice((52_200, 54_000, None))) for i in range(12) for _ in range(1 + i % 3)]
    near, bells = spark.createDataFrame(near, "stop_id STRING, school STRING"), spark.createDataFrame(
        bells, "school STRING, opening_secs INT, closing_secs BIGINT"
    )
    part = day_part(F.col("obs_hour"), morning=SCHOOL_MORNING_HOURS, otherwise=None)
    met = attach_bells(arrivals.join(near.distinct(), "stop_id"), bells, ["school"], "opening_secs", "closing_secs")
    kept = near_bell(met, "obs_hour", "obs_minute", "obs_secs", "opening_secs", "closing_secs", 60)
    wanted = part_buses(kept, ["school", "service_date"], "obs_hour", ["vehicle_id", "trip_id"], part)
    got = daily_arrivals(arrivals, near, bells, 60)
    assert got.schema.simpleString() == wanted.schema.simpleString()
    assert got.count() > 30 and sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_arrivals_are_not_multiplied_by_schools(spark):
    """A hundred schools at each stop with the same bells: an arrival stays one row until it is counted."""
    arrivals = _visits(spark).where("obs_secs IS NOT NULL")
    belled = spark.range(20).crossJoin(spark.range(100).select(F.concat(F.lit("s"), "id").alias("school"))).select(
        F.col("id").cast("string").alias("stop_id"), "school", F.lit(28_800).alias("opening_secs"), F.lit(54_000).alias("closing_secs")
    )
    part = day_part(F.col("obs_hour"), morning=SCHOOL_MORNING_HOURS, otherwise=None)
    classes = bell_classes(belled, "stop_id", "school", "opening_secs", "closing_secs")
    met = attach_classes(arrivals, classes, "stop_id", part, "opening_secs", "closing_secs")
    assert met.count() == arrivals.where(part.isNotNull()).count()


def test_statistics_of_one_day(spark):
    df = spark.sql("SELECT 'S' AS school, DATE '2024-08-26' AS service_date, 'morning' AS time, 4L AS n")
    r = arrival_stats_wide(df, ["school"]).first()
    assert (r.avg_n_morning, r.sd_n_morning, r.avg_n_afternoon) == (4.0, None, None)
    two = spark.createDataFrame([("S", 1.0, None), ("S", 2.0, 3.0)], "school STRING, a DOUBLE, b DOUBLE")
    assert tuple(collapse_mean(two, "school").first()) == ("S", 1.5, 3.0)


def test_capacity(spark):
    df = spark.sql("SELECT 0D AS within_pct, 1500 AS enrollment, 20D AS m UNION ALL SELECT NULL, 100, 1D")
    got = bus_capacity(df, "enrollment", {"morning": "m"}, (60,)).orderBy(F.desc("enrollment")).collect()
    assert got[0].capacity_60_morning == 80.0
    assert got[1].capacity_60_morning == pytest.approx(60 / (100 * (1 - 0.1214193)) * 100)
    homes = spark.createDataFrame([("S", 3, False), ("S", 1, True), ("T", 2, False)], "s STRING, n INT, near BOOLEAN")
    assert sorted(map(tuple, near_school_share(homes, "s", "n", "near").collect())) == [("S", 4, 1, 25.0), ("T", 2, 0, 0.0)]


PINGS = (
    "vehicle_id STRING, label STRING, trip_id STRING, route_id STRING, stop_id STRING, start_date STRING, "
    "ts TIMESTAMP_NTZ, hour BIGINT, minute BIGINT, lat DOUBLE, lon DOUBLE, source_file STRING"
)


def test_from_pings_to_seats(spark, tmp_path):
    """The whole way: pings and timetable to rates, then to buses and seats at a school."""
    import datetime as dt

    def at(day, hhmm, sec=0):
        h, m = map(int, hhmm.split(":"))
        return dt.datetime(2024, 8, day, h, m, sec)

    sched = {"T1": "07:30", "T2": "07:40", "T3": "07:50", "T4": "15:00"}
    tt = spark.createDataFrame(
        [("R1", "Line 1", dt.date(2024, 8, d), "0", t, "B", int(clock(c)), int(clock(c)) // 3600, 1, "100")
         for d, (t, c) in itertools.product((26, 27), sched.items())],
        "route_id STRING, route_name STRING, service_date DATE, direction_id STRING, trip_id STRING, block_id STRING, "
        "sched_secs BIGINT, sched_hour BIGINT, row BIGINT, stop_id STRING",
    )
    seen = [(26, "T1", "07:31"), (26, "T1", "07:32"), (26, "T2", "07:50"), (26, "T4", "14:59"), (27, "T1", "07:30")]
    pings = spark.createDataFrame(
        [(f"v{t}", "L", t, "R1", "100_x", f"202408{d}", at(d, c), at(d, c).hour, at(d, c).minute, 39.3, -76.6, "f")
         for d, t, c in seen],
        PINGS,
    )
    routes = spark.createDataFrame([("Line 1", "1")], "name STRING, short_name STRING")
    out = on_time_reports(pings, tt, str(tmp_path), routes=routes)
    rows = {(r.service_date.day, r.trip_id): r for r in out.adherence.collect()}
    assert len(rows) == 8
    assert rows[26, "T1"].delay == 120.0 and rows[26, "T1"].on_time and rows[26, "T2"].late
    assert rows[26, "T2"].headway == 18.0 and rows[26, "T2"].over_spaced
    assert rows[26, "T3"].on_time is None and rows[26, "T3"].optimistic_on_time and not rows[26, "T3"].pessimistic_on_time
    system = {r.time: r for r in out.system.collect()}
    assert system["morning"].n_days == 2 and system["morning"].n_rows == 6
    assert system["morning"].on_time_perc == (0.5 + 1.0) / 2
    assert system["morning"].observed == pytest.approx((2 / 3 + 1 / 3) / 2)
    assert {(r.route_name, r.short_name) for r in out.by_line.collect()} == {("Line 1", "1")}
    assert out.by_stop.count() == 2

    stops = spark.sql("SELECT '100' AS stop_id, -76.6D AS lon, 39.3D AS lat UNION ALL SELECT '200', -76.7D, 39.3D")
    schools = spark.sql("SELECT 'High' AS school, -76.601D AS school_lon, 39.3D AS school_lat")
    near = stops_near_schools(stops, schools)
    assert [tuple(r) for r in near.collect()] == [("100", "High")]
    bells = spark.createDataFrame([("High", clock("07:52"), clock("14:45"))], "school STRING, opening_secs DOUBLE, closing_secs DOUBLE")
    daily = daily_arrivals(out.adherence, near, bells)
    assert sorted((r.service_date.day, r.time, r.n) for r in daily.collect()) == [
        (26, "afternoon", 1), (26, "morning", 2), (27, "morning", 1)
    ]
    period = arrivals_over_period(daily)
    r = period.first()
    assert (r.n_days, r.median_morning, r.max_morning, r.median_afternoon) == (2, 1.5, 2, 1.0)
    homes = spark.createDataFrame(
        [("High", 30, -76.6, 39.3, -76.601, 39.3), ("High", 10, -76.7, 39.3, -76.601, 39.3)],
        "school STRING, students INT, lon DOUBLE, lat DOUBLE, school_lon DOUBLE, school_lat DOUBLE",
    )
    enrollment = spark.sql("SELECT 'High' AS school, 80 AS enrollment")
    c = capacity_report(homes, period, enrollment).first()
    assert c.within_pct == 75.0 and c.capacity_60_morning == 1.5 * 60 / 20 * 100
    assert c.capacity_25_afternoon == 25 / 20 * 100
