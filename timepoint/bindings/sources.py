"""Clean-up and reshaping steps of the readers, on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from timepoint.bindings import table
from timepoint.functions.clock import clock_parts, clock_seconds, date_key
from timepoint.functions.stats import metres_to_miles, mps_to_mph
from timepoint.functions.text import (
    clean_names,
    percent_number,
    recode,
    school_level,
    slug,
    strip_prefix,
    word_count,
)
from timepoint.operators.joins import keep_days, not_in, recode_join, zip_rows
from timepoint.operators.ordered import ROWS_PER_PIECE, first_per_key, number_rows
from timepoint.operators.quality import snapshot_gaps
from timepoint.operators.reshape import (
    endpoints_to_rows,
    explode_list,
    impute_masked,
    pivot_sums,
    split_to_rows,
    stack,
    unpivot_wide,
)
from timepoint.schemas import struct
from timepoint.sources.calendar import is_service_day, service_calendar
from timepoint.sources.positions import standardize_columns
from timepoint.sources.tables import (
    city_bus_stops,
    clean_routes,
    distinct_route_ids,
    enrollment_numbers,
)
from timepoint.sources.timetable import timetable_stop_names

HOLIDAYS = ("2024-01-01", "2024-01-15")


def service_days(spark, folder):
    """Events on service days: the calendar as a predicate."""
    day = F.to_date("ts")
    df = table(spark, folder, "events").where(is_service_day(day, HOLIDAYS, ()))
    return df.groupBy(day.cast("string").alias("service_date")).agg(F.count(F.lit(1)).alias("n"))


def service_days_joined(spark, folder):
    """The same through the calendar table, and the days left out."""
    events = table(spark, folder, "events").withColumn("date", F.to_date("ts"))
    days = service_calendar(spark, "2023-12-30", "2024-02-05", HOLIDAYS, ())
    kept = keep_days(events, days, "date").groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    left_out = not_in(events.select("date").distinct(), days, "date").withColumn("n", F.lit(0).cast("bigint"))
    return kept.unionByName(left_out).withColumn("date", F.col("date").cast("string"))


def gaps(spark, folder):
    events = table(spark, folder, "events").select(
        F.to_date("ts").alias("day"), F.hour("ts").cast("bigint").alias("hour")
    )
    return snapshot_gaps(events, events.select("day").distinct(), range(0, 24)).withColumn(
        "day", F.col("day").cast("string")
    )


PROPS = "event_id BIGINT, k BIGINT, missing STRING, event_type STRING"


def json_props(spark, folder):
    """Parse, flatten, fill the column list, normalise the names."""
    parsed = table(spark, folder, "events").select(
        F.col("event_id"), F.from_json("props", "k BIGINT, extra STRING").alias("p"), "event_type", "value"
    )
    flat = parsed.select("event_id", "p.*", "event_type", "value")
    fixed = standardize_columns(flat, struct(PROPS))
    return clean_names(fixed.toDF("eventId", "K", "missing Field", "event.type"))


def turn_positions(spark, folder):
    """Number the turns and join what is listed for the role's first position."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.length("text").alias("len"))
    trips = number_rows(turns, ["conv_id"], ["turn"], "row", ROWS_PER_PIECE)
    listed = first_per_key(trips.select("row", "role", "conv_id", "turn"), ["row", "role"], ["conv_id", "turn"])
    names = listed.select("row", "role", F.col("conv_id").alias("first_conv"))
    joined = timetable_stop_names(trips, names, ["row", "role"])
    return joined.select("conv_id", "turn", "role", "row", "first_conv", F.col("len").cast("bigint"))


def route_list(spark, folder):
    """Lists of three services stacked, cleaned, with their distinct ids counted."""
    part = table(spark, folder, "part")
    a = part.select(F.col("p_brand").alias("id"), F.col("p_type").alias("name"), F.col("p_name").alias("short_name"))
    s = table(spark, folder, "supplier")
    b = s.select(F.col("s_name").alias("id"), F.col("s_name").alias("short_name"))
    n = table(spark, folder, "nation")
    c = n.select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.col("n_name").alias("short_name"))
    routes = clean_routes(stack(a, b, c))
    per_id = routes.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("name").alias("n_named"),
        F.min("short_name").alias("first_short"),
    )
    return distinct_route_ids(routes).join(per_id, "id")


def city_stops(spark, folder):
    """Placed rows of one segment whose type mentions a word, in any case."""
    c = table(spark, folder, "customer").select(
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("X"),
        F.col("c_nationkey").cast("double").alias("Y"),
        F.col("c_mktsegment").alias("TYPE_Alt"),
        F.when(F.col("c_acctbal") < 7000, "inner").otherwise("outer").alias("Jurisdiction"),
        F.col("c_custkey").alias("stop_id"),
    )
    return city_bus_stops(c, "inner", "build").select("stop_id", "X", "Y")


# A small renaming of part types.
TYPE_NAMES = {"ECONOMY": "Economy, Basic", "PROMO": "Promotion, Sale", "LARGE": "Big"}


def recode_names(spark, folder):
    part = table(spark, folder, "part")
    df = part.withColumn("kind", recode(F.col("p_type"), TYPE_NAMES))
    return df.where(school_level(F.col("kind"), "Basic|Sale|MEDIUM")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("p_size").cast("bigint")).alias("size")
    )


def recode_by_table(spark, folder):
    """The renaming as a table: nation keys to names, unknown ones kept."""
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("place"))
    n = table(spark, folder, "nation").where(F.col("n_regionkey") < 2).select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label")
    )
    return recode_join(c, "place", n, "code", "label").groupBy("place").agg(F.count(F.lit(1)).alias("n"))


def slug_text(spark, folder):
    """Text expressions: slug, word count, prefix removal, percent text."""
    part = table(spark, folder, "part")
    return part.select(
        "p_partkey",
        slug(F.col("p_name")).alias("join_name"),
        word_count(F.col("p_name")).cast("bigint").alias("words"),
        strip_prefix(F.col("p_brand"), "Brand#").alias("brand"),
        percent_number(F.concat(F.col("p_size").cast("string"), F.lit("%"))).alias("pct"),
        percent_number(F.col("p_name")).alias("no_number"),
    )


def split_rows(spark, folder):
    """Lists in text to rows, after the renaming that adds separators."""
    part = table(spark, folder, "part").select("p_partkey", recode(F.col("p_type"), TYPE_NAMES).alias("kinds"))
    return split_to_rows(part, "kinds", "kind").groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys")
    )


def list_rows(spark, folder):
    """URL steps as a list column, one row for each distinct step."""
    pages = table(spark, folder, "pages").select("page_id", F.split("url", "/").alias("step"))
    steps = explode_list(pages.withColumn("step", F.array_distinct("step")), "step")
    return steps.groupBy("step").agg(F.count(F.lit(1)).alias("n"))


def units_and_clock(spark, folder):
    """Unit factors, clock parts past midnight, clock text and date keys."""
    parts = clock_parts(F.col("secs"))
    df = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.col("l_linenumber").cast("bigint").alias("line"),
        (F.col("l_quantity").cast("bigint") * 2000 + F.col("l_linenumber")).alias("secs"),
        F.col("l_quantity").alias("q"),
        "l_shipdate",
    )
    text = F.format_string("%d:%02d:%02d", parts["hour"], parts["minute"], parts["second"])
    return df.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "line",
        *[c.alias(n) for n, c in parts.items()],
        clock_seconds(text).alias("secs_again"),
        mps_to_mph(F.col("q")).alias("mph"),
        metres_to_miles(F.col("q")).alias("miles"),
        date_key(F.col("l_shipdate")).alias("date_key"),
    )


TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _sizes_wide(spark, folder):
    part = table(spark, folder, "part").withColumn("p_type", F.concat(F.lit("x"), "p_type"))
    return pivot_sums(part, ["p_brand"], "p_type", "p_size", [f"x{t}" for t in TYPES])


def unpivot_masked(spark, folder):
    """Wide counts with masked cells to rows: mask, read as number, unpivot, impute."""
    wide = _sizes_wide(spark, folder)
    wide = wide.withColumns(
        {
            f"x{t}": F.when(F.col(f"x{t}") < 300, F.lit("*")).otherwise(F.col(f"x{t}").cast("string"))
            for t in TYPES
        }
    )
    numbers = enrollment_numbers(wide, ["p_brand"])
    return impute_masked(unpivot_wide(numbers, ["p_brand"], "kind", "students"), "students", known="kind")


def pivot_variables(spark, folder):
    part = table(spark, folder, "part")
    return pivot_sums(part, ["p_brand"], "p_type", "p_size", TYPES)


def zip_join(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_name")
    s = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return zip_rows(c, s, ["c_custkey"], ["s_suppkey"])


def endpoints(spark, folder):
    """Home and school point of each pair as two rows."""
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    od = c.join(n, "c_nationkey", "left")
    ends = {
        "home": (F.col("c_acctbal"), F.col("c_custkey").cast("double")),
        "school": (F.col("n_regionkey").cast("double"), F.col("c_nationkey").cast("double")),
    }
    return endpoints_to_rows(od, ends, ["c_custkey", "n_name"])


QUERIES = {
    "service_days": service_days,
    "service_days_joined": service_days_joined,
    "snapshot_gaps": gaps,
    "json_props": json_props,
    "turn_positions": turn_positions,
    "route_list": route_list,
    "city_stops": city_stops,
    "recode_names": recode_names,
    "recode_by_table": recode_by_table,
    "slug_text": slug_text,
    "split_rows": split_rows,
    "list_rows": list_rows,
    "units_and_clock": units_and_clock,
    "unpivot_masked": unpivot_masked,
    "pivot_variables": pivot_variables,
    "zip_join": zip_join,
    "endpoints": endpoints,
}

_KINDS = """CASE p_type WHEN 'ECONOMY' THEN 'Economy, Basic' WHEN 'PROMO' THEN 'Promotion, Sale'
            WHEN 'LARGE' THEN 'Big' ELSE p_type END"""
_WIDE = ", ".join(f"sum(p_size) FILTER (WHERE p_type = '{t}') AS \"{t}\"" for t in TYPES)

ORACLES = {
    "service_days": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS service_date, count(*) AS n FROM events
        WHERE isodow(ts) < 6 AND CAST(ts AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15') GROUP BY 1""",
    "service_days_joined": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
        CASE WHEN isodow(CAST(ts AS DATE)) < 6 AND CAST(ts AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15')
              AND CAST(ts AS DATE) BETWEEN DATE '2023-12-30' AND DATE '2024-02-05'
             THEN count(*) ELSE 0 END AS n FROM events GROUP BY CAST(ts AS DATE)""",
    "snapshot_gaps": """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
        s AS (SELECT day, hour FROM d, (SELECT unnest(range(0, 24)) AS hour)),
        c AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT CAST(s.day AS VARCHAR) AS day, s.hour AS hour, coalesce(c.n, 0) AS n
        FROM s LEFT JOIN c ON s.day = c.day AND s.hour = c.hour""",
    "json_props": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
        CAST(NULL AS VARCHAR) AS missing_field, event_type FROM events""",
    "turn_positions": """WITH t AS (SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS len,
          CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS row FROM conversations)
        SELECT conv_id, turn, role, row, len,
               first_value(conv_id) OVER (PARTITION BY row, role ORDER BY conv_id, turn) AS first_conv FROM t""",
    "route_list": """WITH r AS (
          SELECT p_brand AS id, p_type AS name, replace(p_name, ' ', '') AS short_name FROM part
          UNION ALL SELECT s_name, NULL, replace(s_name, ' ', '') FROM supplier
          UNION ALL SELECT n_name, n_name, replace(n_name, ' ', '') FROM nation)
        SELECT id, count(*) AS n, count(name) AS n_named, min(short_name) AS first_short FROM r GROUP BY id""",
    "city_stops": """SELECT c_custkey AS stop_id, c_acctbal AS X, CAST(c_nationkey AS DOUBLE) AS Y FROM customer
        WHERE c_acctbal > 0 AND c_acctbal < 7000 AND contains(upper(c_mktsegment), 'BUILD')""",
    "recode_names": f"""WITH k AS (SELECT {_KINDS} AS kind, p_size FROM part)
        SELECT kind, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM k
        WHERE regexp_matches(kind, 'Basic|Sale|MEDIUM') GROUP BY kind""",
    "recode_by_table": """SELECT coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS place, count(*) AS n
        FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON c_nationkey = n_nationkey
        GROUP BY 1""",
    "slug_text": """SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS join_name,
        CAST(len(regexp_extract_all(p_name, '\\w+')) AS BIGINT) AS words, replace(p_brand, 'Brand#', '') AS brand,
        CAST(p_size AS DOUBLE) AS pct, TRY_CAST(replace(p_name, '%', '') AS DOUBLE) AS no_number FROM part""",
    "split_rows": f"""WITH k AS (SELECT p_partkey, unnest(string_split({_KINDS}, ', ')) AS kind FROM part)
        SELECT kind, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM k GROUP BY kind""",
    "list_rows": """WITH s AS (SELECT unnest(list_distinct(string_split(url, '/'))) AS step FROM pages)
        SELECT step, count(*) AS n FROM s GROUP BY step""",
    "units_and_clock": """WITH s AS (SELECT *, CAST(l_quantity AS BIGINT) * 2000 + l_linenumber AS secs FROM lineitem)
        SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS line, secs // 3600 AS hour,
               (secs % 3600) // 60 AS minute, secs % 60 AS second, secs AS secs_again,
               l_quantity * 2.23694::DOUBLE AS mph, l_quantity * 0.000621371::DOUBLE AS miles,
               strftime(l_shipdate, '%Y%m%d') AS date_key FROM s""",
    "unpivot_masked": f"""WITH w AS (SELECT p_brand, {_WIDE} FROM part GROUP BY p_brand),
        l AS (UNPIVOT w ON {', '.join('"' + t + '"' for t in TYPES)} INTO NAME kind VALUE v),
        a AS (SELECT p_brand, kind FROM (SELECT DISTINCT p_brand FROM part),
              (SELECT unnest([{', '.join("'" + t + "'" for t in TYPES)}]) AS kind))
        SELECT a.p_brand, a.kind, CAST(CASE WHEN v IS NULL OR v < 300 THEN 5 ELSE v END AS DOUBLE) AS students
        FROM a LEFT JOIN l ON a.p_brand = l.p_brand AND a.kind = l.kind
        WHERE v IS NULL OR v < 300 OR v > 0""",
    "pivot_variables": "SELECT p_brand, "
    + ", ".join(f"CAST(sum(p_size) FILTER (WHERE p_type = '{t}') AS BIGINT) AS \"{t}\"" for t in TYPES)
    + " FROM part GROUP BY p_brand",
    "zip_join": """WITH c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer),
        s AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier)
        SELECT CAST(c.rn AS BIGINT) AS row_number, c_custkey, c_name, s_suppkey, s_name
        FROM c LEFT JOIN s ON c.rn = s.rn""",
    "endpoints": """SELECT c_custkey, n_name, 'home' AS coord_type, c_acctbal AS lat, CAST(c_custkey AS DOUBLE) AS lon
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT c_custkey, n_name, 'school', CAST(n_regionkey AS DOUBLE), CAST(c_nationkey AS DOUBLE)
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
}
