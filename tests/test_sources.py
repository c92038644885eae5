import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from timepoint.functions.clock import clock_parts, clock_seconds, local_time, service_seconds
from timepoint.functions.text import clean_names, percent_number, recode, snake, word_count
from timepoint.operators.quality import snapshot_gaps
from timepoint.operators.stop_events import prepare_pings, stop_events, stop_events_slowest
from timepoint.plans.school_capacity import attendance_table, school_parcels
from timepoint.sources import sinks, tables
from timepoint.sources.calendar import STUDY_END, STUDY_START, is_service_day, service_calendar
from timepoint.sources.positions import flatten_positions, read_snapshots, snapshot_folders, standardize_columns
from timepoint.sources.timetable import build_timetable, direction_stops, flatten_timetable, read_timetable


def poll(entities):
    return {"header": {"timestamp": "1724673600"}, "entity": entities, "foo": 1}


def entity(i, secs, trip=True, stop="100_a", speed=1.5, camel=False):
    trip_keys = ("tripId", "routeId", "startDate") if camel else ("trip_id", "route_id", "start_date")
    v = {
        "position": {"latitude": 39.3, "longitude": -76.6, "speed": speed},
        "vehicle": {"id": f"v{i}", "label": f"L{i}"},
        "stopId" if camel else "stop_id": stop,
        "currentStopSequence" if camel else "current_stop_sequence": 3,
        "timestamp": str(secs),
    }
    if trip:
        v["trip"] = dict(zip(trip_keys, ("T1", "R1", "20240826")))
    return {"id": f"e{i}", "vehicle": v}


def land(root, stamp, doc):
    day, hour = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}", stamp[8:10]
    folder = root / day / f"{day}-{hour}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"positions_data_{stamp}.json").write_text(json.dumps(doc))


@pytest.mark.parametrize("camel", [False, True])
def test_poll_files(spark, tmp_path, camel):
    doc = poll([entity(1, 1724673600, camel=camel), entity(2, 1724673605.25, trip=False, camel=camel)])
    land(tmp_path, "20240826080003", doc)
    land(tmp_path, "20240826040003", doc)  # outside the wanted hours
    land(tmp_path, "20240827080003", doc)  # another day
    snaps = read_snapshots(spark, str(tmp_path), ["2024-08-26"], camel_case=camel)
    assert "foo" not in snaps.columns
    assert [r.poll_ts for r in snaps.collect()] == [dt.datetime(2024, 8, 26, 8, 0, 3)]
    rows = flatten_positions(snaps).orderBy("entity_id").collect()
    assert [r.ts for r in rows] == [dt.datetime(2024, 8, 26, 8), dt.datetime(2024, 8, 26, 8, 0, 5, 250000)]
    assert [(r.hour, r.minute, r.second) for r in rows] == [(8, 0, 0), (8, 0, 5)]
    assert [r.trip_id for r in rows] == ["T1", None]
    assert rows[0].vehicle_id == "v1" and rows[0].stop_id == "100_a" and rows[0].lat == 39.3
    assert snapshot_folders(read_snapshots(spark, str(tmp_path), hours=None)).count() == 3


def test_wanted_hours_prune_the_listing(spark, tmp_path):
    for hour in ("04", "05", "16", "17"):
        land(tmp_path, f"20240826{hour}0000", poll([entity(1, 1)]))
    files = read_snapshots(spark, str(tmp_path)).inputFiles()
    assert sorted(f[-11:-9] for f in files) == ["05", "16"]


def test_clock_change_night_keeps_both_instants(spark):
    df = spark.createDataFrame([("1730611800",), ("1730615400",)], "s STRING")
    got = [r[0] for r in df.select(local_time(F.col("s"), "America/New_York")).collect()]
    assert got == [dt.datetime(2024, 11, 3, 1, 30)] * 2


def test_service_seconds_pass_midnight(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-08-27 00:30:00.5' AS ts, DATE '2024-08-26' AS d")
    assert df.select(service_seconds(F.col("ts"), F.col("d"))).first()[0] == 88_200.5


def test_standardize_columns(spark):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("a INT, b STRING, c DOUBLE")
    df = standardize_columns(spark.sql("SELECT 1 AS z, '5' AS a, 2 AS c"), schema)
    assert df.schema.simpleString() == "struct<a:int,b:string,c:double>"
    assert tuple(df.first()) == (5, None, 2.0)


def test_stop_event_rules(spark):
    rows = [("v1", f"08:00:{s:02d}", sp, "T1") for s, sp in ((0, 3), (5, 0), (10, 0), (15, 4))]
    rows += [("v2", "08:00:00", 1, None), ("v3", None, 1, "T1")]
    df = spark.createDataFrame(
        [(v, "L", t, "R1", "100_a", "20240826", ts, float(sp)) for v, ts, sp, t in rows],
        "vehicle_id STRING, label STRING, trip_id STRING, route_id STRING, stop_id STRING, start_date STRING, "
        "ts STRING, speed_mps DOUBLE",
    )
    pings = prepare_pings(df)
    assert [(r.vehicle_id, r.ts, r.stop_id) for r in stop_events(pings).collect()] == [("v1", "08:00:15", "100")]
    slow = stop_events_slowest(pings.where("vehicle_id = 'v1'"))
    assert sorted(r.ts for r in slow.collect()) == ["08:00:05", "08:00:10"]
    # A NULL trip is a group of its own for the slowest rule.
    assert stop_events_slowest(pings).where("vehicle_id = 'v2'").count() == 1


def timetable_doc():
    times = [{"timeSecs": s, "isWaitStop": s == 28800} for s in (28800, 29100, 90000)]
    trip = {"trip_id": "T1", "trip_headsign": "Out", "block_id": "B", "is_added_service": False, "times": times}
    stops = [{"stopId": s, "stopName": s.lower()} for s in "ABC"]
    entry = {
        "route_id": "R1", "route_name": "Line 1", "service_date": "2024-08-26", "schedule_direction_id": "0",
        "schedule_times_for_trip": [trip], "schedule_stops": stops,
    }
    again = dict(entry, schedule_times_for_trip=[], schedule_stops=stops[:1])
    return {"data": [entry, again]}


def test_timetable(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(timetable_doc(), indent=1))
    raw = read_timetable(spark, str(tmp_path / "r.json"))
    rows = build_timetable(raw).orderBy("row").collect()
    assert [(r.row, r.sched_hour, r.stop_id) for r in rows] == [(1, 8, "A"), (2, 8, "B"), (3, 25, "C")]
    assert flatten_timetable(raw).count() == 3 and direction_stops(raw).count() == 3


def test_calendar(spark):
    assert service_calendar(spark).count() == 84
    week = service_calendar(spark, "2024-08-26", "2024-09-06", ["2024-09-02"], [])
    assert week.count() == 9
    every = spark.sql(f"SELECT explode(sequence(DATE '{STUDY_START}', DATE '{STUDY_END}')) AS d")
    assert every.where(is_service_day(F.col("d"))).count() == 84


def test_gaps_show_as_zero(spark):
    df = spark.sql("SELECT DATE '2024-08-26' AS day, 5L AS hour")
    got = {(r.hour): r.n for r in snapshot_gaps(df, df.select("day"), range(5, 8)).collect()}
    assert got == {5: 1, 6: 0, 7: 0}


def test_clock_helpers(spark):
    df = spark.createDataFrame([("7:45",), ("25:10:05",), ("soon",), (None,)], "t STRING")
    assert [r[0] for r in df.select(clock_seconds(F.col("t"))).collect()] == [27_900, 90_605, None, None]
    parts = clock_parts(F.lit(90_605))
    assert tuple(spark.range(1).select(*parts.values()).first()) == (25, 10, 5)


def test_names():
    assert [snake(n) for n in ("stopId", "TYPE_Alt", "Prog No.", "24510010100", "GEOID_Tract_2020", "% used")] == [
        "stop_id", "type_alt", "prog_no", "x24510010100", "geoid_tract_2020", "percent_used",
    ]


def test_clean_names_keeps_repeats_apart(spark):
    assert clean_names(spark.sql("SELECT 1 AS `a b`, 2 AS `A.B`")).columns == ["a_b", "a_b_2"]


def test_text_expressions(spark):
    df = spark.sql("SELECT 'The Green School Of' AS s, '12.5%' AS p, 'x' AS q")
    got = df.select(word_count(F.col("s")), percent_number(F.col("p")), percent_number(F.col("q")),
                    recode(F.col("q"), {"x": "y"}), recode(F.col("q"), {})).first()
    assert tuple(got) == (4, 12.5, None, "y", "x")


def test_routes_stops_bells(spark, tmp_path):
    doc = {"data": {"routes": [{"id": "1", "name": "Gold", "shortName": "C G", "color": "fff"}]}}
    for n in ("a", "b"):
        (tmp_path / f"{n}.json").write_text(json.dumps(doc))
    routes = tables.read_routes(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert routes.columns == ["id", "name", "short_name", "color"]
    assert [r.short_name for r in routes.collect()] == ["CG", "CG"]
    assert tables.distinct_route_ids(routes).count() == 1
    (tmp_path / "stops.csv").write_text(
        "X,Y,Jurisdiction,TYPE_Alt,Stop_Number,Stop_Name\n"
        "1,2,City,Local bus,10,A\n,2,City,BUS,11,B\n1,2,County,BUS,12,C\n1,2,City,Rail,13,D\n"
    )
    stops = tables.read_stops(spark, str(tmp_path / "stops.csv"), "City")
    assert [(r.stop_number, r.type_alt) for r in stops.collect()] == [("10", "Local bus")]
    (tmp_path / "bells.csv").write_text("school_number,am_bell,pm_bell,early\n007,07:45:00,14:40,12:00\n")
    bell = tables.read_bell_times(spark, str(tmp_path / "bells.csv")).first()
    assert (bell.school_number, bell.opening_secs, bell.closing_secs) == ("007", 27_900, 52_800)


def test_county_crosswalk_legs_cells(spark, tmp_path):
    (tmp_path / "county.csv").write_text(
        "route,source_file,stop,location,time,students\nR AM,f,1,Corner,06:30:00,3\nR AM,f,two,Corner,23400,x\n"
    )
    rows = tables.read_county_stops(spark, str(tmp_path / "county.csv")).orderBy(F.desc("stop")).collect()
    assert [(r.stop, r.time, r.students) for r in rows] == [(1, 23_400.0, 3.0), (None, 23_400.0, None)]
    (tmp_path / "xw.csv").write_text("a,b\n24510010100,Canton\n")
    assert tuple(tables.read_crosswalk(spark, str(tmp_path / "xw.csv")).first()) == ("24510010100", "Canton")
    legs = tmp_path / "legs"
    legs.mkdir()
    head = "from_id,to_id,to_lat,to_lon,departure_time,total_duration,total_distance,segment,mode,"
    head += "segment_duration,wait,distance,route\n"
    for i in (1, 2):
        (legs / f"{i}.csv").write_text(head + f"x2451{i},stop:school,39.1,-76.5,07:00:00,30,900,1,WALK,30,0,900,\n")
    got = tables.read_trip_legs(spark, str(legs)).orderBy("from_id").collect()
    assert [(r.from_id, r.to_id, r.to_lat, r.to_lon, r.route) for r in got] == [
        ("24511", "school", 39.1, -76.5, None), ("24512", "school", 39.1, -76.5, None)
    ]
    (tmp_path / "cells.csv").write_text("x,y,value\n0,0,10\n1,1,4000\n5,5,9000\n")
    cells = tables.read_cells(spark, str(tmp_path / "cells.csv"))
    inside = tables.min_value_cells(tables.raster_points(cells, (0, 0, 2, 2)))
    assert [(r.x, r.value) for r in inside.collect()] == [(1.0, 4000.0)]


def test_enrollment_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text(
        "Heading,,,,\nof,,,,\nfive,,,,\nlines,,,,\nhere,,,,\n"
        "Prog No,Program,Enrollment,24510010100,24510010200\np1,\"High, East\",40,12,*\np2,West,*,7,\np3,South,,,3\n\n"
    )
    ids = ["prog_no", "program", "enrollment"]
    rows = tables.read_enrollment_wide(spark, str(tmp_path / "e.csv"), ids).orderBy("prog_no").collect()
    assert [tuple(r) for r in rows] == [
        ("p1", "High, East", "40", 12.0, None), ("p2", "West", "*", 7.0, None), ("p3", "South", None, None, 3.0)
    ]


def test_enrollment_folder(spark, tmp_path):
    """Each file has its own heading; one with another header is an error."""
    for i in (1, 2):
        (tmp_path / f"{i}.csv").write_text("h\n\nId,N\n" + "\n".join(f"{i}{k},*" for k in range(3)))
    rows = tables.read_enrollment_wide(spark, str(tmp_path), ["id"], heading_rows=2).collect()
    assert sorted(tuple(r) for r in rows) == [(f"{i}{k}", None) for i in (1, 2) for k in range(3)]
    (tmp_path / "3.csv").write_text("h\n\nId,M\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        tables.read_enrollment_wide(spark, str(tmp_path), ["id"], heading_rows=2)


def test_attendance(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "Digital Harbor High School,,,\n,80%,85.5%,-5.5%\nHigh,,,\nSome Other School,70%,71%,-1%\n"
    )
    got = attendance_table(tables.read_attendance(spark, str(tmp_path / "a.csv"))).orderBy("school").collect()
    assert [tuple(r) for r in got] == [
        ("Digital Harbor High", 80.0, 85.5, -5.5), ("Some Other School", 70.0, 71.0, -1.0)
    ]


def test_polygons(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    hole = [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 0.5]]
    feature = {"properties": {"name": "a", "n": 1}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}}
    multi = {"properties": {"name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}
    (tmp_path / "p.geojson").write_text(json.dumps({"features": [feature, feature, multi]}))
    rows = tables.read_polygons(spark, str(tmp_path / "p.geojson"), ["name", "n"]).orderBy("name", "part").collect()
    assert [(r.name, r.n, r.part, len(r.ring), len(r.holes)) for r in rows] == [
        ("a", "1", 0, 5, 1), ("b", None, 0, 5, 0), ("b", None, 1, 5, 0)
    ]


def test_parcels_to_schools(spark):
    df = spark.createDataFrame(
        [("Crossroads School, The", 1), ("Crossroads School, The", 1), ("North, South", 2)],
        "schools_at_parcel STRING, parcel INT",
    )
    got = sorted((r.school_name, r.parcel) for r in school_parcels(df).collect())
    assert got == [("North", 2), ("South", 2), ("The Crossroads School", 1)]


def test_daily_folders_replace_only_their_days(spark, tmp_path):
    path = str(tmp_path / "daily")
    day = "CAST(date_add(DATE '2024-08-26', CAST(id % 3 AS INT)) AS DATE) AS service_date"
    sinks.write_daily(sinks.combine_daily(spark.range(30).selectExpr("id", day)), path)
    sinks.write_daily(spark.range(3, 4).selectExpr("id + 100 AS id", day), path)
    df = tables.read_daily(spark, path)
    assert df.count() == 21
    pruned = tables.read_daily(spark, path, "2024-08-27", "2024-08-27")
    assert pruned.count() == 10
    assert "PartitionFilters: [isnotnull(service_date" in pruned._jdf.queryExecution().toString()


def test_report_files(spark, tmp_path):
    sinks.write_summary_csv(spark.range(3), str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("*.csv"))) == 1
    sinks.write_result(spark.range(3), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3


def test_scratch_is_removed_after_use(spark):
    import os

    from timepoint.session import new_scratch, scratch_root, scratch_space, written

    with scratch_space(spark) as outer:
        kept = written(spark.range(5).toDF("id"), "kept")
        with scratch_space(spark) as inner:
            assert written(spark.range(3).toDF("id"), "t").count() == 3 and os.path.isdir(inner.removeprefix("file:"))
        assert not os.path.exists(inner.removeprefix("file:")) and kept.count() == 5
    assert not os.path.exists(outer.removeprefix("file:"))
    assert new_scratch(spark, "x").startswith(scratch_root(spark))
