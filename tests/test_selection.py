"""Medians by selection against sorted loops."""

import random
import statistics
from collections import defaultdict

import pytest

from timepoint.operators.rollups import otp_daily
from timepoint.operators.selection import medians, weighted_median


def plain_weighted(pairs):
    pairs = sorted((v, w) for v, w in pairs if v is not None and w is not None and w > 0)
    whole, upto, first = sum(w for _, w in pairs), 0, None
    for v, w in pairs:
        upto += w
        if first is None and 2 * upto >= whole:
            first = v
        if 2 * upto > whole:
            return (first + v) / 2
    return None


def groups(seed):
    """Hot groups with ties, equal values, far outliers and nulls; a null key; small groups."""
    pick = random.Random(seed)
    shapes = {
        "hot": lambda: pick.gauss(0, 1e6), "ties": lambda: pick.choice([1.5, 2.5, 2.5, 1e12]), "same": lambda: 7.25,
        None: lambda: pick.expovariate(1e-9), "few": lambda: pick.random(), "edge": lambda: pick.choice([0.0, 1.0]),
    }
    sizes = {"hot": 900, "ties": 500, "same": 300, None: 400, "few": 9, "edge": 200}
    return [
        (k, pick.choice(["x", "y", None]), None if pick.random() < 0.05 else shapes[k](), pick.choice([None, 0, 1, 1, 2, 5]))
        for k, n in sizes.items() for _ in range(n)
    ]


@pytest.mark.parametrize("gather", [3, 40, 10_000])
@pytest.mark.parametrize("weight", [None, "w"])
def test_medians_at_two_grains(spark, gather, weight):
    rows = groups(gather)
    df = spark.createDataFrame(rows, "k string, g string, v double, w bigint")
    got = {(r["_grain"], r.k, r.g): r.median for r in medians(df, [["k"], ["k", "g"]], "v", weight=weight, gather=gather).collect()}
    held = defaultdict(list)
    for k, g, v, w in rows:
        held[0, k, None].append((v, w if weight else 1))
        held[1, k, g].append((v, w if weight else 1))
    want = {key: m for key, pairs in held.items() if (m := plain_weighted(pairs)) is not None}
    assert got == want
    if weight is None:
        assert got[0, "hot", None] == statistics.median(v for k, _, v, _ in rows if k == "hot" and v is not None)


def test_half_of_the_weight_at_a_border(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 5.0, 1), ("a", 9.0, 1), ("b", 4.0, 3), ("c", None, 3), ("d", 4.0, 0)], "k string, v double, w bigint")
    for gather in (1, 100):
        assert {r.k: r.weighted_median for r in weighted_median(df, ["k"], "v", "w", gather=gather).collect()} == {"a": 3.0, "b": 4.0}


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert medians(df, [["k"], []], "v").count() == 0


def test_daily_reports_with_a_fine_clock(spark):
    flags = ["on_time", "on_time_5", "on_time_4", "on_time_20", "optimistic_on_time", "pessimistic_on_time", "headway_adherence"]
    rows = [("2024-09-02", "AM" if i % 2 else "PM", float(i) if i % 3 else None, 50.0, (i * 37 % 601) / 7 if i % 5 else None, *[i % 4 == 0] * 7) for i in range(500)]
    df = spark.createDataFrame(rows, "service_date string, time string, obs_secs double, observed_pct double, headway double, " + ", ".join(f"{f} boolean" for f in flags))
    plain = {r.time: r.asDict() for r in otp_daily(df).collect()}
    assert {r.time: r.asDict() for r in otp_daily(df, fine_clock=True).collect()} == plain
