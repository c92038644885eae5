"""Every operator bound to the supplied tables, each with its SQL twin.

The library speaks of trips, stops and vehicles; these modules give the
supplied tables those roles.  ``QUERIES`` maps a name to (spark, folder) ->
DataFrame, ``ORACLES`` the same name to SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int, cols: Sequence[str]) -> DataFrame:
    """Round averages of fractions, whose last bit depends on the order of adding."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def texts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Dates as ISO text."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def registry() -> tuple[dict, dict]:
    from timepoint.bindings import (
        arrivals,
        endtoend,
        files,
        headways,
        people,
        punctuality,
        rides,
        sources,
        space,
        streams,
        trips,
    )

    queries, oracles = {}, {}
    for module in (punctuality, headways, sources, arrivals, space, trips, rides, people, streams, endtoend, files):
        clash = queries.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
