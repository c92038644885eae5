"""The remaining inputs: lists, CSV tables, polygons, grid cells, daily results."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint import schemas
from timepoint.functions.clock import clock_seconds
from timepoint.functions.text import clean_names, strip_prefix
from timepoint.operators.reshape import stack

# Parcel names that differ from the school list.
PARCEL_NAMES = {
    "Crossroads School, The": "The Crossroads School",
    "Belair-Edison School, The": "The Belair-Edison School",
    "Dallas F. Nicholas, Sr., Elementary School": "Dallas F. Nicholas Sr. Elementary School",
    "Green School Of Baltimore, The": "The Green School Of Baltimore",
    "Reach! Partnership School, The": "The Reach! Partnership School",
    "Dr. Bernard Harris, Sr., Elementary School": "Dr. Bernard Harris Sr. Elementary School",
    "Historic Samuel Coleridge-Taylor Elementary School, The, Joseph C. Briscoe Academy": (
        "The Historic Samuel Coleridge-Taylor Elementary School, The Joseph C. Briscoe Academy"
    ),
}
# School names of the attendance extract and their full forms.
ATTENDANCE_NAMES = {
    "Baltimore Leadership School for Young": "Baltimore Leadership School for Young Women",
    "Bard High School Early College Baltimore": "Bard Early College High School Baltimore",
    "Benjamin Franklin High School at Masonville": "Benjamin Franklin High at Masonville Cove",
    "Carver Vocational-Technical High School": "Carver Vocational-Technical High",
    "City Neighbors High School": "City Neighbors High",
    "Digital Harbor High School": "Digital Harbor High",
    "Edmondson-Westside High School": "Edmondson-Westside High",
    "Forest Park High School": "Forest Park High",
    "Frederick Douglass High School": "Frederick Douglass High",
    "Patterson High School": "Patterson High",
    "Paul Laurence Dunbar High School": "Paul Laurence Dunbar High",
    "Reginald F. Lewis High School": "Reginald F. Lewis High",
    "Western High School": "Western High",
}


def _csv(spark: SparkSession, path, schema, header: bool = True, **options: str) -> DataFrame:
    # Columns go by position in the declared schema; a short or long row is kept.
    return spark.read.schema(schema).options(enforceSchema="true", **options).csv(path, header=header)


def clean_routes(routes: DataFrame) -> DataFrame:
    return routes.withColumn("short_name", F.replace("short_name", F.lit(" "), F.lit("")))


def read_routes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Route lists of all services, stacked, blanks out of the short name."""
    lists = [
        clean_names(
            spark.read.schema(schemas.ROUTES)
            .option("multiLine", "true")
            .json(p)
            .select(F.inline("data.routes"))
        )
        for p in paths
    ]
    return clean_routes(stack(*lists))


def distinct_route_ids(routes: DataFrame, col: str = "id") -> DataFrame:
    return routes.select(col).distinct()


def city_bus_stops(stops: DataFrame, jurisdiction: str, type_like: str = "BUS") -> DataFrame:
    """Stops with coordinates, of one jurisdiction, whose type mentions buses."""
    placed = F.col("X").isNotNull() & F.col("Y").isNotNull()
    wanted = (F.col("Jurisdiction") == jurisdiction) & F.upper("TYPE_Alt").contains(type_like.upper())
    return stops.where(placed & wanted)


def read_stops(spark: SparkSession, path: str, jurisdiction: str, type_like: str = "BUS") -> DataFrame:
    return clean_names(city_bus_stops(_csv(spark, path, schemas.STOPS), jurisdiction, type_like))


def enrollment_numbers(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Wide tract columns as numbers; masked text becomes NULL."""
    wide = [c for c in df.columns if c not in set(ids)]
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in wide})


def read_enrollment_wide(spark: SparkSession, path: str, ids: Sequence[str], heading_rows: int = 5) -> DataFrame:
    """The wide enrolment table behind its heading rows; every row after them stays, whatever is masked in it.

    Heading and header lines are told by their place in the file.  Which columns exist is only known from the header
    line, so that one line of each file is read first; all files must have the same.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    # A file's first lines are in its first block, and lines of a block are numbered in order.
    starts = lines.where("_block = 0").groupBy("_file").agg(F.min("_line").alias("_first"))
    placed = lines.join(starts, "_file").withColumn("_at", F.col("_line") - F.col("_first"))
    in_head = (F.col("_block") == 0) & (F.col("_at") <= heading_rows)
    headers = [r.value for r in placed.where(in_head & (F.col("_at") == heading_rows)).select("value").distinct().take(2)]
    if len(headers) != 1:
        raise ValueError(f"{path}: {'no header line' if not headers else 'files with different headers'}")
    columns = next(csv.reader(headers))
    schema = ", ".join(f"c{i} STRING" for i in range(len(columns)))
    parsed = placed.where(~in_head & (F.trim("value") != "")).select(F.from_csv("value", schema).alias("r")).select("r.*")
    return enrollment_numbers(clean_names(parsed.toDF(*columns)), ids)


def read_attendance(spark: SparkSession, path: str) -> DataFrame:
    """Four unnamed text columns; ``line`` keeps the order of the file."""
    return _csv(spark, path, schemas.ATTENDANCE, header=False).withColumn(
        "line", F.monotonically_increasing_id()
    )


def read_bell_times(spark: SparkSession, path: str) -> DataFrame:
    """Bell table; times as seconds of the day next to the text."""
    bells = _csv(spark, path, schemas.BELL_TIMES)
    return bells.withColumns(
        {"opening_secs": clock_seconds(F.col("am_bell")), "closing_secs": clock_seconds(F.col("pm_bell"))}
    )


def county_numbers(df: DataFrame) -> DataFrame:
    """Numbers where the text is one; times as seconds, given as such or as a clock."""
    at = F.coalesce(F.col("time").try_cast("double"), clock_seconds(F.col("time")).cast("double"))
    return df.withColumns(
        {
            "stop": F.col("stop").try_cast("bigint"),
            "students": F.col("students").try_cast("double"),
            "time": at,
        }
    )


def read_county_stops(spark: SparkSession, path: str) -> DataFrame:
    return county_numbers(_csv(spark, path, schemas.COUNTY_STOPS))


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.CROSSWALK).toDF("geoid", "area")


def clean_legs(legs: DataFrame) -> DataFrame:
    return legs.withColumns(
        {
            "from_id": strip_prefix(F.col("from_id"), "x"),
            "to_id": strip_prefix(F.col("to_id"), "stop:"),
        }
    )


def read_trip_legs(spark: SparkSession, folder: str) -> DataFrame:
    """All itinerary files of a folder in one scan; ``segment`` numbers the legs."""
    return clean_legs(_csv(spark, folder, schemas.TRIP_LEGS))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.CELLS)


def raster_points(cells: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Grid cells inside (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = bbox
    return cells.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def min_value_cells(cells: DataFrame, threshold: float = 3000, value: str = "value") -> DataFrame:
    return cells.where(F.col(value) > threshold)


def read_polygons(spark: SparkSession, path: str, keep: Sequence[str]) -> DataFrame:
    """GeoJSON polygons and multipolygons as rings with holes.

    One row for each polygon part: the kept properties, ``part`` number, outer
    ``ring`` and ``holes``.  Whole-feature repeats are dropped.
    """
    raw = spark.read.schema(schemas.FEATURES).option("multiLine", "true").json(path)
    feature = raw.select(F.explode("features").alias("f")).select(
        *[F.try_element_at("f.properties", F.lit(k)).alias(k) for k in keep],
        F.col("f.geometry.type").alias("kind"),
        F.col("f.geometry.coordinates").alias("coordinates"),
    )
    feature = feature.distinct()
    rings = "array<array<array<double>>>"
    parts = F.when(F.col("kind") == "Polygon", F.array(F.from_json("coordinates", rings))).otherwise(
        F.from_json("coordinates", f"array<{rings}>")
    )

    def points(ring):
        return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    exploded = feature.select(*keep, F.posexplode(parts).alias("part", "rings"))
    return exploded.select(
        *keep,
        "part",
        points(F.col("rings")[0]).alias("ring"),
        F.transform(F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(1))), points).alias("holes"),
    )


def read_daily(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None, date: str = "service_date"
) -> DataFrame:
    """Daily results, all or a date range; the range prunes partitions."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col(date) >= F.lit(first).cast("date"))
    if last is not None:
        df = df.where(F.col(date) <= F.lit(last).cast("date"))
    return df
