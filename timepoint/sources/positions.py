"""Vehicle positions: landing folders of poll files to a table of pings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timepoint.functions.clock import local_time
from timepoint.schemas import POLL, POLL_CAMEL, struct

# Feed zone, hours read for the study, file-name form.
FEED_ZONE = "America/New_York"
WANTED_HOURS = tuple(range(5, 17))
POLL_NAME = r"positions_data_(\d{14})"


def landing_glob(folder: str, dates: Sequence[str] | None, hours: Sequence[int] | None) -> str:
    """``folder/{days}/{days}-{hours}/*.json``: only wanted folders are listed at all."""
    day = "{" + ",".join(dates) + "}" if dates else "*"
    hour = "{" + ",".join(f"*-{h:02d}" for h in hours) + "}" if hours is not None else "*"
    return f"{folder.rstrip('/')}/{day}/{hour}/*.json"


def poll_ts(path: Column) -> Column:
    """Local poll time from the file name."""
    return F.to_timestamp_ntz(F.regexp_extract(path, POLL_NAME, 1), F.lit("yyyyMMddHHmmss"))


def standardize_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the listed columns in their order: missing ones NULL, others gone."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def as_snapshots(raw: DataFrame) -> DataFrame:
    """Polls in snake_case with file and poll time; casts nested fields by position."""
    named = raw.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in struct(POLL).fields})
    file = F.col("_metadata.file_path")
    return named.select("*", file.alias("file"), poll_ts(file).alias("poll_ts"))


def read_snapshots(
    spark: SparkSession,
    folder: str,
    dates: Sequence[str] | None = None,
    hours: Sequence[int] | None = WANTED_HOURS,
    camel_case: bool = False,
) -> DataFrame:
    """Poll files of the wanted days and hours.  The read schema fills and drops columns."""
    schema = POLL_CAMEL if camel_case else POLL
    return as_snapshots(spark.read.schema(schema).json(landing_glob(folder, dates, hours)))


def stream_snapshots(
    spark: SparkSession, folder: str, files_per_trigger: int = 10_000, camel_case: bool = False
) -> DataFrame:
    """The landing folder as a stream; new files are found as they arrive."""
    reader = (
        spark.readStream.schema(POLL_CAMEL if camel_case else POLL)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", files_per_trigger)
    )
    return as_snapshots(reader.json(folder))


def flatten_positions(snapshots: DataFrame, zone: str = FEED_ZONE) -> DataFrame:
    """One row for each vehicle report, with UTC instant, local time and its parts."""
    e = F.col("e.vehicle")
    secs = e["timestamp"]
    flat = snapshots.select("file", "poll_ts", "header", F.explode("entity").alias("e")).select(
        F.col("e.id").alias("entity_id"),
        e["vehicle"]["id"].alias("vehicle_id"),
        e["vehicle"]["label"].alias("label"),
        e["trip"]["trip_id"].alias("trip_id"),
        e["trip"]["route_id"].alias("route_id"),
        e["trip"]["start_date"].alias("start_date"),
        e["stop_id"].alias("stop_id"),
        e["current_stop_sequence"].alias("current_stop_sequence"),
        e["position"]["latitude"].alias("lat"),
        e["position"]["longitude"].alias("lon"),
        e["position"]["speed"].alias("speed_mps"),
        F.timestamp_seconds(secs.try_cast("decimal(18,6)")).alias("ts_utc"),
        local_time(secs, zone).alias("ts"),
        local_time(F.col("header.timestamp"), zone).alias("header_ts"),
        "poll_ts",
        F.col("file").alias("source_file"),
    )
    return flat.withColumns(
        {
            "hour": F.hour("ts").cast("bigint"),
            "minute": F.minute("ts").cast("bigint"),
            "second": F.second("ts").cast("bigint"),
        }
    )


def snapshot_folders(snapshots: DataFrame) -> DataFrame:
    """Day and hour of each poll, for the completeness count."""
    return snapshots.select(
        F.to_date("poll_ts").alias("day"), F.hour("poll_ts").cast("bigint").alias("hour"), "file"
    )
