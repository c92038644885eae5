"""Outage spells against a plain loop, with late polls between two runs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from timepoint.operators.quality import outage_spells, poll_sessions


def test_outage_spells(spark):
    pick, start = random.Random(8), dt.datetime(2024, 9, 2)
    seconds = {k: sorted(pick.sample(range(0, 40_000, 10), 150)) for k in ("a", "b")} | {"once": [5]}
    rows = [(k, start + dt.timedelta(seconds=s)) for k, at in seconds.items() for s in at] * 2
    pick.shuffle(rows)
    polls = spark.createDataFrame(rows, "feed string, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp"))
    sessions = poll_sessions(polls, "ts", "600 seconds", ["feed"])
    assert sessions.agg(F.sum("n_polls")).first()[0] == len(rows)
    got = {(r.feed, r.from_, r.seconds, r.missed) for r in outage_spells(sessions, 300, ["feed"]).select(
        "feed", F.unix_seconds("stopped").alias("from_"), "seconds", "missed").collect()}
    zero = int(start.replace(tzinfo=dt.timezone.utc).timestamp())
    want = {(k, zero + a, float(b - a), -(-(b - a) // 300) - 1) for k, at in seconds.items() for a, b in zip(at, at[1:]) if b - a >= 600}
    assert got == want and len(want) > 20
