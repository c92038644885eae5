"""Shards of equal weight by histogram sort.

Rows are ordered by a key. Splitters between shards are found without moving rows: the weights below probed key
boundaries are summed exactly over all partitions, and the probes refined inside the intervals that still hold a
target, until each splitter is within the tolerance of its target. Then every row's place is known up to the order
within its piece, and the rows are exchanged once.

Each shard is cut into pieces by weight and by rows, so that no task sorts a whole shard or a mass of light rows; slots follow from the counts of the pieces before.
The key ends with a digest of the row's number, so rows that are equal in all else can be parted too.

Defined results: a null weight counts as zero, a null key sorts first; equal keys (equal texts) lie beside each other,
in one shard unless a splitter must cut them; a single row heavier than the tolerance stays whole; an empty table gives
none; columns whose names clash are kept, the new ones are named by the caller.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timepoint.llm.common import column, free_name, written

TOLERANCE = 0.0005
PIECES = 16
DIGITS = 2


def hex_key(value: Column) -> Column:
    """A signed number as 16 hex digits in its order; null first."""
    shifted = value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
    return F.coalesce(F.lower(F.lpad(F.hex(shifted), 16, "0")), F.lit("0" * 16))


def common_start(a: str, b: str) -> str:
    return os.path.commonprefix([a, b])


def splitters(keyed: DataFrame, key: str, weights: dict[str, Column], targets: list[tuple[str, float]], tolerance: dict[str, float]) -> list[str]:
    """For each target (a weight's name, how much of it) a key; the rows below it weigh that, give or take the tolerance.

    A probe is a prefix of the key; one pass sums the weights of all probes under the prefixes that are still open. A probe
    of one key is not refined, and from the least and greatest key of a probe all digits that its rows share are skipped.
    """
    found: list[str | None] = [None] * len(targets)
    # Of each open target the prefix of the interval it lies in, and the weight below that interval.
    open_at = dict.fromkeys(range(len(targets)), ("", 0))
    k = column(keyed, key)
    while open_at:
        prefixes = sorted({p for p, _ in open_at.values()})
        probe = F.coalesce(*[F.when(k.startswith(p), F.substring(k, 1, len(p) + DIGITS)) for p in prefixes])
        sums = keyed.groupBy(probe.alias("probe")).agg(
            F.count("*").alias("rows"), F.min(k).alias("least"), F.max(k).alias("greatest"), *[F.sum(w).alias(n) for n, w in weights.items()]
        )
        by_prefix: dict[str, list] = {p: [] for p in prefixes}
        for r in sorted(sums.where("probe is not null").collect(), key=lambda r: r.probe):  # at most 256 for each open prefix
            by_prefix[prefixes[bisect_right(prefixes, r.probe) - 1]].append(r)  # open prefixes are apart from each other
        for i, (prefix, below) in list(open_at.items()):
            (name, target), probes = targets[i], by_prefix[prefix]
            ends = [below + s for s in accumulate(r[name] for r in probes)]
            at = min(bisect_right(ends, target), len(probes) - 1)
            r = probes[at]
            if r[name] <= tolerance[name] or r.least == r.greatest:
                # The nearer end of the probe's interval; all keys under a prefix lie below the prefix and a "g".
                found[i] = f"{r.probe}g" if ends[at] - target < target - (ends[at] - r[name]) else r.probe
                del open_at[i]
            else:
                open_at[i] = (common_start(r.least, r.greatest), ends[at] - r[name])
    return found


def piece_of(key: Column, cuts: list[str], first: int = 0) -> Column:
    """How many cuts are at or below the key, by binary search."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(key < cuts[mid], piece_of(key, cuts[:mid], first)).otherwise(piece_of(key, cuts[mid + 1 :], first + mid + 1))


def histogram_sort(
    rows: DataFrame,
    key: Column,
    weight: Column,
    shards: int,
    *,
    shard: str = "shard",
    slot: str = "slot",
    tolerance: float = TOLERANCE,
    pieces: int = PIECES,
) -> DataFrame:
    """The rows with their shard, from 0, and slot, gapless from 0 in the order of the key (hex digits of one length).

    ``tolerance`` is a share of a shard's weight.
    """
    k, w, p = (free_name(rows, f"sort_{x}") for x in ("key", "weight", "piece"))
    number = F.lower(F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0"))
    marked = rows.withColumn(k, F.concat(key, number)).withColumn(w, F.coalesce(weight, F.lit(0)).cast("long"))
    keyed = written(marked, "keyed")  # the row numbers have to stay what they are
    total, n = keyed.agg(F.sum(column(keyed, w)), F.count("*")).first()
    # Pieces are cut by weight and by rows, so that neither heavy rows nor many light ones pile up in a task.
    parts, sizes = shards * pieces, {"weight": total or 0, "rows_": n}
    aims = [(name, i) for name, size in sizes.items() for i in range(1, parts) if size]
    targets = [(name, sizes[name] * i / parts) for name, i in aims]
    weights = {"weight": column(keyed, w), "rows_": F.lit(1)}
    ends = splitters(keyed, k, weights, targets, {name: tolerance * size / shards for name, size in sizes.items()})
    shard_ends = [e for (name, i), e in zip(aims, ends) if name == "weight" and i % pieces == 0]
    cuts = sorted(set(ends))
    shard_of = [bisect_right(shard_ends, c) for c in ["", *cuts]]
    placed = keyed.withColumn(p, piece_of(column(keyed, k), cuts))
    counts = {r[0]: r[1] for r in placed.groupBy(column(placed, p)).count().collect()}  # one row for a piece
    before, own = [], [0] * shards
    for i, s in enumerate(shard_of):
        before.append(own[s])
        own[s] += counts.get(i, 0)
    order = F.row_number().over(Window.partitionBy(column(placed, p)).orderBy(column(placed, k)))
    of_piece = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), column(placed, p) + 1)
    out = placed.withColumn(slot, of_piece(before, "long") + order - 1).withColumn(shard, of_piece(shard_of, "int"))
    return out.drop(k, w, p)
