"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank and cut into blocks of neighbours. A block, and each upper node over
``FANOUT`` nodes below it, holds the masked pattern of the bits that all fingerprints under it share. Two nodes are
compared by the differences on the bits both share; a pair of nodes beyond the distance is pruned with all that is
under it, others are opened level by level, as equi joins on the parent. Only the pairs of blocks that remain compare
fingerprints bit by bit.

No links are listed within a block or between two blocks: each block is first reduced to its own components, and a
pair of blocks gives at most one link for two of them. Equal fingerprints are one from the start. Components of the
links come from alternating star joins, each round in a written table.

Defined results: null and wordless texts have fingerprint zero, which links like any other; fewer words than a shingle
make one shingle; the component id is the smallest id reachable, null ids being ignored where there is another; rows
are never merged, so a repeated row gives a repeated result; an empty table gives none. Extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timepoint.llm.common import column, columns_of, free_name, released, written

SHINGLE = 3
DISTANCE = 2
SEED = 42
BLOCK = 256
FANOUT_BITS = 4


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, as a signed number."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, ends = b" ".join(words), []
        at = -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]
    counts = np.zeros(64, np.int64)
    all_hashes = np.array(hashes, np.uint64)
    for i in range(0, len(all_hashes), 1 << 16):  # 64 bytes for each hash, whatever the text's length
        part = all_hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(text: Column, size: int = SHINGLE) -> Column:
    """Column function for ``fingerprint``."""

    @F.arrow_udf("bigint")
    def made(texts: pa.Array) -> pa.Array:
        return released(pa.array([fingerprint(t.as_py(), size) for t in texts], pa.int64()))

    return made.asNondeterministic()(text)


def gray_rank(bits: Column) -> Column:
    """The place of a fingerprint in Gray order, as a signed number in the same order."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component, for links a-b among n members."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs within the distance; both sides have at most a block's members."""
    # Unsigned: of a signed number, the bits of its absolute value would be counted.
    return np.nonzero(np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= distance)


def blocks(points: DataFrame, distance: int, size: int) -> DataFrame:
    """Neighbours in Gray order: slice, place, members and their component within the block, shared bits."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, rest, number = 0, np.zeros(0, np.int64), None
        for batch in batches:
            if len(batch):
                number = int(batch["slice"].iloc[0])
            rest = np.concatenate([rest, batch["bits"].to_numpy(np.int64)])
            while len(rest) >= size:
                yield block(number, place, rest[:size])
                place, rest = place + 1, rest[size:]
        if len(rest):
            yield block(number, place, rest)

    def block(number: int, place: int, members: np.ndarray) -> pd.DataFrame:
        own = members[_roots(len(members), *_near(members, members, distance))]
        ones, zeros = np.bitwise_and.reduce(members), np.bitwise_or.reduce(members)
        return pd.DataFrame({"slice": [number], "place": [place], "bits": [members], "own": [own], "shared": [~(ones ^ zeros)], "value": [ones]})

    ranked = points.select("bits", gray_rank(F.col("bits")).alias("rank"))
    return (
        ranked.repartitionByRange("rank").sortWithinPartitions("rank")
        .select("bits", F.spark_partition_id().alias("slice"))
        .mapInPandas(cut, "slice int, place int, bits array<bigint>, own array<bigint>, shared bigint, value bigint")
    )


def _numbered(cut: DataFrame) -> tuple[DataFrame, int]:
    """Blocks numbered through in Gray order, from the number of blocks in each slice (one row for a slice)."""
    counts = sorted((r.slice, r.n) for r in cut.groupBy("slice").agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for number, n in counts:
        starts[number], total = total, total + n
    if not starts:
        return cut.withColumn("node", F.lit(0).cast("long")), 0
    spark = cut.sparkSession
    offsets = spark.createDataFrame(list(starts.items()), "slice int, start bigint")
    return cut.join(F.broadcast(offsets), "slice").withColumn("node", F.col("start") + F.col("place")), total


def near_blocks(numbered: DataFrame, total: int, distance: int) -> DataFrame:
    """Pairs of blocks (a < b) that may hold fingerprints within the distance, by descent through the nodes."""
    leaves = numbered.select("node", "shared", "value")
    levels = max(1, math.ceil(math.log(max(total, 2), 1 << FANOUT_BITS)))
    pairs = numbered.sparkSession.createDataFrame([(0, 0)], "a bigint, b bigint")
    for level in range(levels - 1, -1, -1):
        up = FANOUT_BITS * level
        nodes = leaves
        if level:
            nodes = (
                leaves.groupBy(F.shiftright("node", up).alias("node"))
                .agg(F.bit_and("value").alias("ones"), F.bit_or(F.col("value").bitwiseOR(F.bitwise_not("shared"))).alias("any"))
                .select("node", F.bitwise_not(F.col("ones").bitwiseXOR(F.col("any"))).alias("shared"), F.col("ones").alias("value"))
            )
        below = nodes.withColumn("parent", F.shiftright("node", FANOUT_BITS))
        left = below.select(F.col("parent").alias("a"), *[F.col(c).alias(f"l_{c}") for c in ("node", "shared", "value")])
        right = below.select(F.col("parent").alias("b"), *[F.col(c).alias(f"r_{c}") for c in ("node", "shared", "value")])
        both = F.col("l_shared").bitwiseAND(F.col("r_shared"))
        differ = F.bit_count(F.col("l_value").bitwiseXOR(F.col("r_value")).bitwiseAND(both))
        opened = pairs.join(left, "a")
        on = (opened["b"] == right["b"]) & (F.col("l_node") <= F.col("r_node")) & (differ <= distance)
        pairs = opened.join(right, on).select(F.col("l_node").alias("a"), F.col("r_node").alias("b"))
        if level and total > (1 << (2 * FANOUT_BITS)):
            pairs = written(pairs, "node-pairs")
    return pairs.where("a < b")


def block_links(numbered: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """Links between components of two blocks, one for each two that meet, as (u, v) with u > v."""
    left = numbered.select(F.col("node").alias("a"), F.col("bits").alias("a_bits"), F.col("own").alias("a_own"))
    right = numbered.select(F.col("node").alias("b"), F.col("bits").alias("b_bits"), F.col("own").alias("b_own"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for a, x, b, y in zip(*(batch.column(c) for c in ("a_bits", "a_own", "b_bits", "b_own"))):
                i, j = _near(a.values.to_numpy(), b.values.to_numpy(), distance)
                if len(i):
                    ends = np.stack([x.values.to_numpy()[i], y.values.to_numpy()[j]], axis=1)
                    found.append(np.unique(np.sort(ends[ends[:, 0] != ends[:, 1]], axis=1), axis=0))
            links = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 1]), pa.array(links[:, 0])], ["u", "v"])

    met = pairs.join(left, "a").join(right, "b").select("a_bits", "a_own", "b_bits", "b_own")
    return met.mapInArrow(compare, "u bigint, v bigint")


def components(links: DataFrame) -> DataFrame:
    """The smallest member (``root``) of the component of each linked ``node``, for links (u, v) with u > v.

    Alternates large and small stars until nothing changes. Each round aggregates and joins; no list of neighbours is
    ever built, so a hub of any size is only a skewed join key.
    """
    edges = written(links.distinct(), "links")
    seen = None
    while True:
        # Large star: every neighbour above a node moves to the smallest around it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every neighbour below a node, and the node, move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def classes(bits: DataFrame, *, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """For each distinct fingerprint (column ``bits``) the ``root`` of its component."""
    points = written(bits.select("bits").distinct(), "fingerprints")
    cut = written(blocks(points, distance, block), "blocks")
    numbered, total = _numbered(cut)
    inside = cut.select(F.explode(F.arrays_zip("bits", "own")).alias("m")).select("m.bits", "m.own")
    pairs = written(near_blocks(numbered, total, distance), "block-pairs")
    roots = components(block_links(numbered, pairs, distance))
    return inside.join(roots, inside["own"] == roots["node"], "left").select("bits", F.coalesce("root", "own").alias("root"))


def with_components(prints: DataFrame, *, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """For each fingerprint of ``prints`` (doc_id, bits): root, component_id (smallest doc_id) and n_first, the rows that have it."""
    of = classes(prints, distance=distance, block=block)
    ids = prints.groupBy("bits", "doc_id").agg(F.count("*").alias("n"))
    first = (
        ids.join(of, "bits").groupBy("root", "doc_id").agg(F.sum("n").alias("n"))
        .groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n")).alias("f"))
        .select("root", F.col("f.doc_id").alias("component_id"), F.col("f.n").alias("n_first"))
    )
    return of.join(first, "root")


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: doc_id, bits (its fingerprint), component_id."""
    prints = written(
        docs.select(column(docs, doc_id).alias("doc_id"), fingerprints(column(docs, text), shingle).alias("bits")), "prints"
    )
    return prints.join(with_components(prints, distance=distance, block=block), "bits").select("doc_id", "bits", "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents, one of each component: that with the smallest id. All columns stay.

    Where rows repeat that id within a component, one of them stays.
    """
    bits, root, first, rows = (free_name(docs, f"sim_{x}") for x in ("bits", "root", "first", "rows"))
    marked = docs.withColumn(bits, fingerprints(column(docs, text), shingle))
    prints = written(marked.select(column(docs, doc_id).alias("doc_id"), F.col(bits).alias("bits")), "prints")
    of = written(with_components(prints, distance=distance), "classes")
    named = of.select(F.col("bits").alias(bits), F.col("root").alias(root), F.col("component_id").alias(first), F.col("n_first").alias(rows))
    kept = marked.join(named, bits).where(column(docs, doc_id).eqNullSafe(F.col(first)))
    if of.where("n_first > 1").isEmpty():
        return columns_of(kept, docs)
    # Repeated rows of one id: one of them, taken where they are before any shuffle.
    again = kept.where(F.col(rows) > 1).groupBy(root).agg(F.first(F.struct(*[column(docs, c) for c in docs.columns])).alias("row"))
    return columns_of(kept.where(F.col(rows) == 1), docs).unionByName(again.select("row.*"))


def hex_digits(bits: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


