"""Merkle manifest of a table, kept as blocks in van Emde Boas layout.

Rows are leaves of one tree for each group (a source), 16 wide; the roots of these trees, in the order of their names,
are the leaves of one more tree, whose root stands for the table. Trees are cut into aligned subtrees of ``LEVELS``
levels of hashing (4096 leaves), the *blocks*. A block holds its nodes in one byte string, laid out recursively: the
upper half of its levels first, then the subtrees of the lower half one after another, each laid out the same way. The
place of a node is arithmetic (``address``), and both building and the retrieval of siblings use nothing else, so what
lies near in the tree lies near in memory at every scale. Roots of blocks are the leaves of the tier of blocks above.

On Spark: rows are ranked by a range sort and the row counts of its slices, so a group of any size is spread; a block
is a group of at most 4096 rows; each tier is one shuffle of 4096 times fewer rows than the one below. The levels of a
proof above its block are the same for the whole block and handed down once for each block.

Defined results: nulls are hashed as ``-``, an empty string as ``0:``; a null group is the first one, apart from the
empty name; rows with equal ids are ordered by digest, so repeated rows are leaves beside each other; a lone leaf is the
root of its tree; an empty table has no leaves and the root None. Extra columns change nothing; names of any kind work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from timepoint.llm.common import column, released, written

FAN_BITS = 4
FAN = 1 << FAN_BITS
#: Levels of hashing inside a block.
LEVELS = 3
DIGEST = 32
PROOF = "array<struct<at:int,others:binary>>"
_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.binary())]))


def size(depths: int) -> int:
    """Nodes of a full subtree with so many depths."""
    return ((1 << (FAN_BITS * depths)) - 1) // (FAN - 1)


def address(depths: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places in the layout of nodes ``index`` at ``depth`` (0: the root) of a subtree with ``depths`` depths."""
    if depths == 1:
        return np.zeros_like(index)
    top = depths // 2
    if depth < top:
        return address(top, depth, index)
    low, shift = depths - top, FAN_BITS * (depth - top)
    return size(top) + (index >> shift) * size(low) + address(low, depth - top, index & ((1 << shift) - 1))


def widths(n: int, levels: int) -> list[int]:
    """Nodes at each depth over ``n`` leaves, the root's first."""
    out = [n]
    for _ in range(levels):
        out.append(-(-out[-1] // FAN))
    return out[::-1]


def hashed(digests: bytes) -> bytes:
    """The digest of a run of digests, which are hashed as hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def build(leaves: bytes, levels: int) -> bytes:
    """The nodes of a block over its leaves' digests, in layout; nothing is kept after the last node in use."""
    n = widths(len(leaves) // DIGEST, levels)
    places = [address(levels + 1, d, np.arange(w)) for d, w in enumerate(n)]
    nodes = np.zeros((max(int(p.max()) for p in places) + 1, DIGEST), np.uint8)
    nodes[places[-1]] = np.frombuffer(leaves, np.uint8).reshape(-1, DIGEST)
    for d in range(levels, 0, -1):
        below, run = nodes[places[d]].tobytes(), FAN * DIGEST
        made = b"".join(hashed(below[i : i + run]) for i in range(0, len(below), run))
        nodes[places[d - 1]] = np.frombuffer(made, np.uint8).reshape(-1, DIGEST)
    return nodes.tobytes()


def siblings(nodes: bytes, n: int, levels: int) -> Iterator[list[dict]]:
    """Of each leaf of a block the place in its run and the run's other digests, level by level up to the block's root."""
    held = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    by_depth = []
    for d, w in enumerate(widths(n, levels)):
        if d:
            row, run, parts = held[address(levels + 1, d, np.arange(w))].tobytes(), FAN * DIGEST, []
            for i in range(w):
                start, own = i // FAN * run, i * DIGEST
                parts.append({"at": i % FAN, "others": row[start:own] + row[own + DIGEST : start + run]})
            by_depth.append(parts)
    for i in range(n):
        yield [by_depth[d][i >> (FAN_BITS * (levels - 1 - d))] for d in range(levels - 1, -1, -1)]


def fold(leaf: bytes, proof: list[dict]) -> bytes:
    """The root that a leaf and the siblings on its way give."""
    for step in proof:
        cut = step["at"] * DIGEST
        leaf = hashed(step["others"][:cut] + leaf + step["others"][cut:])
    return leaf


@F.arrow_udf(BinaryType())
def _built(leaves: pa.Array, levels: pa.Array) -> pa.Array:
    return released(pa.array([build(b"".join(x.as_py()), k.as_py()) for x, k in zip(leaves, levels)], pa.binary()))


@F.arrow_udf(BinaryType())
def _folded(leaves: pa.Array, proofs: pa.Array) -> pa.Array:
    return released(pa.array([fold(x.as_py(), p.as_py()) for x, p in zip(leaves, proofs)], pa.binary()))


def folded_root(leaf: Column, proof: Column) -> Column:
    """Column function for ``fold``."""
    return _folded(leaf, proof)


def digest_of(*values: Column) -> Column:
    """The leaf of a row: each value as its length in UTF-8 bytes, a colon and itself, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tree_key(group: Column) -> Column:
    """A name for each group, null first and then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with their ``rank`` within the tree, from 0, and ``n``, the rows of the tree."""
    slices = written(rows.repartitionByRange(tree, *order).withColumn("slice", F.spark_partition_id()), "slices")
    parts = Window.partitionBy(tree)  # a row for each slice that a tree reaches into
    counts = (
        slices.groupBy(tree, "slice").agg(F.count("*").alias("own"))
        .withColumn("before", F.sum("own").over(parts.orderBy("slice")) - F.col("own"))
        .withColumn("n", F.sum("own").over(parts))
    )
    within = slices.withColumn("rank", F.row_number().over(Window.partitionBy(tree, "slice").orderBy(*order)) - 1)
    return within.join(counts.drop("own"), [tree, "slice"]).withColumn("rank", F.col("rank") + F.col("before")).drop("slice", "before")


def tiers(leaves: DataFrame, carried: list[str]) -> list[DataFrame]:
    """The blocks of every tier over ranked leaves (tree, rank, n, digest and ``carried``), lowest tier first.

    A block has tree, block, whole (its tree's nodes on this tier), n, levels, nodes, and in the lowest tier its
    ``leaves``. The last tier of a tree is one block.
    """
    found, nodes, per_block = [], leaves, FAN_BITS * LEVELS
    levels = F.lit(0)
    for k in range(LEVELS, 0, -1):
        levels = F.when((F.col("whole") > (1 << (FAN_BITS * (k - 1)))) & (F.col("whole") <= (1 << (FAN_BITS * k))), k).otherwise(levels)
    levels = F.when(F.col("whole") > (1 << per_block), LEVELS).otherwise(levels)
    while True:
        row = F.struct("rank", "digest", *(carried if not found else []))
        blocks = (
            nodes.groupBy("tree", F.shiftright("rank", per_block).alias("block"))
            .agg(F.first("n").alias("whole"), F.sort_array(F.collect_list(row)).alias("leaves"))
            .withColumn("levels", levels)
            .withColumn("nodes", _built(F.col("leaves.digest"), F.col("levels")))
            .withColumn("n", F.size("leaves"))
        )
        found.append(written(blocks if not found else blocks.drop("leaves"), "blocks"))
        cut = found[-1].where(F.col("whole") > (1 << per_block))
        if cut.isEmpty():
            return found
        nodes = cut.select(
            "tree", F.col("block").alias("rank"), F.ceil(F.col("whole") / (1 << per_block)).alias("n"), root_of("nodes").alias("digest")
        )


def root_of(nodes: str) -> Column:
    """The root is the first node of the layout."""
    return F.substring(nodes, 1, DIGEST)


def _proofs(blocks: DataFrame, fields: list[str], kinds: str, keep: list[str]) -> DataFrame:
    """The leaves of blocks (with ``up``, the proof of the block's root, and ``keep``), each with its whole ``proof``."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = {c: batch.column(c)[r] for c in batch.schema.names}
                up, n = block["up"].as_py(), block["n"].as_py()
                ways = [own + up for own in siblings(block["nodes"].as_py(), n, block["levels"].as_py())]
                leaves = block["leaves"].values
                same = [pa.array([block[c].as_py()], block[c].type) for c in keep]
                for at in range(0, n, 256):  # so that little is held at once
                    part = leaves.slice(at, 256)
                    zeros = pa.array(np.zeros(len(part), np.int32))
                    own = [part.field(f) for f in fields]
                    yield released_batch([*[c.take(zeros) for c in same], *own, pa.array(ways[at : at + 256], _ARROW)], [*keep, *fields, "proof"])

    return blocks.select("up", "n", "nodes", "levels", "leaves", *keep).mapInArrow(opened, f"{kinds}, proof {PROOF}")


def released_batch(columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    released(columns[-1])
    return pa.RecordBatch.from_arrays(columns, names)


def _handed_down(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest blocks with ``up``, the proof of their root; ``above`` has tree, subroot and ``up`` for the root of each tree."""
    per_block = FAN_BITS * LEVELS
    up = None
    for t in range(len(found) - 1, -1, -1):
        lone = found[t].where(F.col("whole") <= (1 << per_block)).join(above, "tree")
        here = lone if up is None else lone.unionByName(found[t].where(F.col("whole") > (1 << per_block)).join(up, ["tree", "block"]))
        if not t:
            return here
        numbers = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((F.col("block") * (1 << per_block) + i).alias("block")))
        opened = _proofs(here.withColumn("leaves", numbers), ["block"], "tree string, subroot string, block bigint", ["tree", "subroot"])
        up = written(opened.select("tree", "subroot", "block", F.col("proof").alias("up")), "handed-down")


@dataclass
class Manifest:
    """Blocks of the groups' trees and of the tree over their roots, by tier; the root in hex."""

    groups: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    carried: list[str]

    def proofs(self) -> DataFrame:
        """Of each leaf tree, subroot, rank, digest, what it carries, and ``proof``: places and siblings up to the root."""
        kinds = {f.name: f.dataType.simpleString() for f in self.groups[0].schema["leaves"].dataType.elementType}
        roots = self.top[-1].select("tree", F.lit("").alias("subroot"), F.array().cast(PROOF).alias("up"))
        of_group = _proofs(_handed_down(self.top, roots), ["group"], "`group` string", [])
        above = of_group.select(F.col("group").alias("tree"), F.col("proof").alias("up")).join(self.subroots(), "tree")
        fields = ["rank", "digest", *self.carried]
        listed = ", ".join(f"`{f}` {kinds[f]}" for f in fields)
        blocks = _handed_down(self.groups, written(above, "handed-down"))
        return _proofs(blocks, fields, f"tree string, subroot string, {listed}", ["tree", "subroot"])

    def subroots(self) -> DataFrame:
        """The root of each group's tree, as ``subroot`` in hex."""
        last = [b.where(F.col("whole") <= (1 << (FAN_BITS * LEVELS))) for b in self.groups]
        out = last[0].select("tree", "nodes")
        for b in last[1:]:
            out = out.unionByName(b.select("tree", "nodes"))
        return out.select("tree", F.lower(F.hex(root_of("nodes"))).alias("subroot"))


def manifest(rows: DataFrame, group: Column, doc_id: Column, digest: Column, carried: dict[str, Column] | None = None) -> Manifest:
    """The manifest of the rows: a tree for each group over the digests in the order of the ids."""
    extra = carried or {}
    narrow = rows.select(
        tree_key(group).alias("tree"), doc_id.alias("id"), digest.alias("digest"), *[c.alias(n) for n, c in extra.items()]
    )
    groups = tiers(ranked(narrow, "tree", ["id", "digest"]).drop("id"), list(extra))
    bare = Manifest(groups, [], None, list(extra))
    names = bare.subroots().select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.unhex("subroot").alias("digest"))
    top = tiers(ranked(names, "tree", ["group"]), ["group"])
    root = top[-1].select(F.lower(F.hex(root_of("nodes"))).alias("root")).first()
    return Manifest(groups, top, root and root["root"], list(extra))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def audit(docs: DataFrame, fields: list[str], *, doc_id: str = "doc_id", source: str = "source", text: str = "text", tampered: Column) -> DataFrame:
    """One row per document: its leaf, subroot, root and proof, and the root that its present content gives.

    The manifest is made of the rows as they are; where ``tampered`` holds, the content checked against it has the
    text's A-Z in lower case.
    """
    of = {c: column(docs, c) for c in fields}
    digest = digest_of(*of.values())
    changed = F.when(tampered & column(docs, text).isNotNull(), digest_of(*(of | {text: F.translate(of[text], _UPPER, _UPPER.lower())}).values()))
    made = manifest(docs, column(docs, source), column(docs, doc_id), digest, {"doc_id": column(docs, doc_id), "claim": changed})
    hex_of = lambda c: F.lower(F.hex(c))
    listed = F.concat_ws("", F.transform("proof", lambda p: hex_of(p["others"])))
    root = F.lit(made.root)
    return (
        made.proofs()
        .select(
            "doc_id", hex_of(F.col("digest")).alias("leaf"), "subroot", root.alias("root"), F.sha2(listed, 256).alias("proof_sha256"),
            hex_of(folded_root(F.coalesce("claim", "digest"), F.col("proof"))).alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
