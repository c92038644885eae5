"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_daily(df: DataFrame, path: str, date: str = "service_date") -> None:
    """One folder for each service day; only the days present in ``df`` are replaced.

    Rows are not gathered by day first: a day may be larger than a task.
    """
    writer = df.write.partitionBy(date).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def combine_daily(df: DataFrame, date: str = "service_date") -> DataFrame:
    """Few files a day before ``write_daily``: rows of a day are brought together,
    in as many tasks as the size of the day asks for."""
    return df.hint("rebalance", date)


def write_summary_csv(df: DataFrame, path: str) -> None:
    """A report of a few rows as one CSV file; ``repartition`` keeps the work before it parallel."""
    df.repartition(1).write.mode("overwrite").csv(path, header=True)


def write_result(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def stream_sink(
    df: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ("day", "hour"), available_now: bool = True
) -> StreamingQuery:
    """Append a stream to folders by day and hour, exactly once by its checkpoint."""
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if by:
        writer = writer.partitionBy(*by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.format("parquet").start(path)
