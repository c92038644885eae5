"""Streams that keep state by key: headways across micro-batches, departures that nobody served.

State lies in the state store, so a micro-batch writes what it changed and no
more, and what the watermark has passed is forgotten by timers.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType

from timepoint.operators.ordered import same_keys_join

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started meanwhile keep their state in RocksDB and write changes only."""
    before = {key: spark.conf.get(key, None) for key in STORE}
    try:
        for key, value in STORE.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class LastArrival(StatefulProcessor):
    """Keeps the last arrival of a group until its timer forgets it."""

    def __init__(self, at: str, out: str, event_time: str, tie: Sequence[str], horizon_ms: int, state: StructType, whole: bool):
        self.at, self.out, self.event_time, self.tie = at, out, event_time, list(tie)
        self.horizon_ms, self.state, self.dtype = horizon_ms, state, "Int64" if whole else "Float64"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(rows), ignore_index=True)
        group = group.sort_values([self.at, *self.tie], kind="stable", na_position="first", ignore_index=True)
        times = group[self.at].astype(self.dtype)
        before = times.shift()
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None:
            before = before.fillna(last).clip(lower=last).where(times >= last)
        yield group.assign(**{self.out: times - before})
        if not times.isna().all():
            newest = times.max() if last is None else max(times.max(), last)
            self.last.update((newest.item() if hasattr(newest, "item") else newest,))
            self._keep_until(int(group[self.event_time].max().timestamp() * 1000) + self.horizon_ms)

    def _keep_until(self, expiry: int) -> None:
        """One timer for each group, the furthest."""
        timers = list(self.handle.listTimers())
        if not timers or expiry > max(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(expiry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_headway(
    df: DataFrame, keys: Sequence[str], at: str, out: str, event_time: str, horizon_ms: int, tie: Sequence[str] = ()
) -> DataFrame:
    """Time since the previous arrival of the group, its last arrival being state of the group.

    The rows are those of ``stream_headway``: a row older than the last arrival
    of an earlier micro-batch gets NULL, and so does one without a time.  ``df``
    must carry a watermark on ``event_time``, past which rows are dropped; a
    group is forgotten once the watermark is ``horizon_ms`` past its newest row.
    Start the query inside ``keyed_state``.

    The rows of one group in one micro-batch are ordered in one task, so limit
    a micro-batch where it is read (``maxFilesPerTrigger``); a replay of days
    with hot groups is better served by ``stream_headway``, which orders them in
    pieces.
    """
    kind = df.schema[at].dataType
    state = StructType().add("at", kind)
    processor = LastArrival(at, out, event_time, tie, horizon_ms, state, isinstance(kind, IntegralType))
    return df.groupBy(*keys).transformWithStateInPandas(
        processor, StructType([*df.schema.fields]).add(out, kind), outputMode="Append", timeMode="EventTime"
    )


def in_window(due: str, seen: str, before: str, after: str) -> Column:
    """Whether a sighting lies within the window around a departure, bounds inclusive."""
    start, end = (F.col(due) - F.expr(f"INTERVAL {before}")), (F.col(due) + F.expr(f"INTERVAL {after}"))
    return (F.col(seen) >= start) & (F.col(seen) <= end)


def stream_match(
    timetable: DataFrame, events: DataFrame, keys: Sequence[str], due: str, seen: str, before: str, after: str
) -> DataFrame:
    """Each departure with every sighting in its window; with none, once its window has closed: a bus that never came.

    ``timetable`` is a stream by the time a departure is ``due``, ``events`` one
    by the time it was ``seen``; both carry a watermark, and the window bounds
    how long either is kept.  Departures without a time are left out.  Beside
    the keys the two have no column in common.  At rest the same call gives
    the same rows, open windows included.
    """
    seen_keys = {key: f"_seen_{key}" for key in keys}
    same = [F.col(key) == F.col(name) for key, name in seen_keys.items()]
    near = reduce(Column.__and__, [*same, in_window(due, seen, before, after)])
    joined = timetable.where(F.col(due).isNotNull()).join(events.withColumnsRenamed(seen_keys), near, "left")
    return joined.drop(*seen_keys.values())


def with_open_departures(closed: DataFrame, timetable: DataFrame, keys: Sequence[str], due: str) -> DataFrame:
    """Rows a stream has given out, and the departures it still waits for, from the landed timetable.

    Sightings are given out as they come, so a departure without a row has none so far.
    """
    given = closed.select(*keys, due).distinct()
    waiting = same_keys_join(timetable.where(F.col(due).isNotNull()), given, [*keys, due], "left_anti")
    return closed.unionByName(waiting, allowMissingColumns=True)
