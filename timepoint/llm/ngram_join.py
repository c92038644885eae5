"""Jaccard join of texts on word n-grams by prefixes with token combinations.

A text is the set of its n-grams (64-bit hashes, its *tokens*). Tokens are put in one order, rare first, and in classes by
frequency: those of class k are indexed by combinations of k tokens of one group (a group is a share of the class by
hash), so rare tokens by themselves and frequent ones only together. A text's prefix is extended until its tokens give
``size - overlap + 1``, where the first k - 1 tokens of a group of class k give nothing. Two texts that reach the overlap
then share a whole combination in some group: of the prefix that ends first at most ``size - overlap`` tokens are missing
in the other text, and all the others are in the other's prefix as well. The number of groups follows the text's size, by
powers of two; a text is indexed under every power that a partner can have.

Frequencies are counted by Spark over every text, for every second token by hash (the order puts the others last), in 2^32
counters. What is sent is of fixed size: a map of ``MARKS`` bits of the counters above one, and at most ``HEAVY`` counters
of frequent tokens. They steer order and classes only; any counts give the same links.

Equal sets are one from the start, told apart by 128-bit digests. Candidates share an entry of the index and have sizes
within the threshold; all are verified on the whole sets. ``similar_pairs`` verifies every candidate. ``near_duplicates``
needs components only: the texts of an entry are first held against the one whose tokens are most common, then those that
are not in the entry's largest component yet against all of the entry. That is done block by block on parity maps of the
sets, whose difference is never more than that of the sets. Of all that may reach the threshold and are in other components
each text proposes two: the nearest, and one of the smallest component, so that rows grow with the entries, not with their
square. The few texts that still have more candidates after ``ROUNDS`` are held against these with their tokens, inside the
tasks; each component gives one link there and another round follows, until there are none.

Defined results: a text with fewer words than n is one token, the whole sequence; null and wordless texts have no tokens
and link with nothing; the component id is the smallest id reachable, null ids being ignored where there is another; rows
are never merged, so a repeated row gives a repeated result; an empty table gives none. Extra columns are not carried.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timepoint.llm.common import column, released, written
from timepoint.llm.simhash import components

SIZE = 4
#: The threshold is a share of a hundred: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
#: Documents above which a token is frequent (more if there would be over HEAVY such tokens), and very frequent.
FREQUENT, STEP = 128, 64
HEAVY = 1 << 20
MARK_BITS = 28
#: Every second token is counted.
COUNTED = np.uint64(1)
#: Words a worker remembers the hash of; sets whose entries a task has listed.
REMEMBERED = 300_000
LISTED = 100_000
#: Texts of an entry in one block, and their tokens.
BLOCK = 256
LONG = 1 << 17
#: Rounds in which each text proposes two others, before every pair of different components is tried.
ROUNDS = 2
#: 64-bit words of a set's parity map, and of the second map of a set of more tokens than the first has bits.
PARITY = 16
WIDE = 128
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Words(dict):
    """Hashes of words met so far; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = made
        return made


_words = Words()


def tokens(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct n-grams of a text as sorted hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    factors = np.resize(_FACTORS, n) * np.arange(1, 2 * n, 2, dtype=np.uint64)
    mixed = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        mixed += h[k : len(h) - n + 1 + k] * factors[k]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def set_id(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def counter_of(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(32)).astype(np.uint32)


def parity(found: np.ndarray, words: int = PARITY) -> bytes:
    """Of each bit whether an odd number of tokens fall on it: two sets differ by at least as many tokens as bits."""
    at = (found >> np.uint64(11)) % np.uint64(64 * words)
    odd = np.bincount(at.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_overlap(size: int, threshold: int) -> int:
    """Tokens that a partner of any size has to share with a set of this size."""
    return -(-threshold * size // 100)


def least_size(threshold: int) -> int:
    """The smallest set that can link with a different one."""
    return -(-threshold // (100 - threshold)) if threshold < 100 else 1 << 62


def group_numbers(power: int, threshold: int) -> tuple[int, int]:
    """Groups of the classes 2 and 3 for sets of 2^power tokens and more.

    A group of class k can hold back k - 1 tokens; together they must leave the smallest set indexed here enough to give.
    Where they cannot (a few tokens and a low threshold) there are none, and every token is indexed by itself.
    """
    smallest = max(least_size(threshold), least_overlap(1 << power, threshold))
    room = least_overlap(smallest, threshold) - 1
    if room < 3:
        return 0, 0
    wanted = (100 - threshold) / 100 * 1.4 * (1 << power)
    second = max(1, min(round(wanted), room // 2))
    return second, max(1, min(round(0.8 * wanted), (room - second) // 2))


class Index:
    """Order, classes and entries of sets, for one table of frequencies."""

    def __init__(self, frequencies: Frequencies, threshold: int):
        self.known, self.threshold = frequencies, threshold

    def entries(self, found: np.ndarray) -> tuple[set[int], int]:
        """The index entries of a set, as 64-bit hashes, and how common its tokens are."""
        n, threshold = len(found), self.threshold
        if n < least_size(threshold):
            return set(), 0
        level, kind = self.known.of(found)
        order = np.lexsort((found, level))
        need = n - least_overlap(n, threshold) + 1
        first = order[:need]
        common = int(1000 * level.sum(dtype=np.int64) // n)
        if (kind[first] == 1).all():
            return set(found[first[level[first] > 0]].tolist()), common
        out: set[int] = set()
        ordered, kinds, levels = found[order].tolist(), kind[order].tolist(), level[order].tolist()
        low, high = least_overlap(n, threshold), 100 * n // threshold
        for power in range(low.bit_length() - 1, high.bit_length()):
            out |= self._extended(ordered, kinds, levels, need, power)
        return out, common

    def _extended(self, ordered: list[int], kinds: list[int], levels: list[int], need: int, power: int) -> set[int]:
        second, third = group_numbers(power, self.threshold)
        groups: dict[tuple[int, int], list[int]] = {}
        out = set()
        for token, kind, level in zip(ordered, kinds, levels):
            if kind == 1 or not second:
                if level:  # what only one text has finds nothing
                    out.add(token)
                need -= 1
            else:
                members = groups.setdefault((kind, (token & 0xFFFFFFFF) % (second if kind == 2 else third)), [])
                members.append(token)
                need -= len(members) >= kind
            if not need:
                break
        for (kind, group), members in groups.items():
            for chosen in itertools.combinations(sorted(members), kind):
                out.add(xxhash.xxh3_64_intdigest(np.array([power, kind, group, *chosen], np.uint64).tobytes()))
        return out


class Frequencies:
    """Which counters are above one, and the frequent ones with their numbers."""

    def __init__(self, marked: np.ndarray, heavy: np.ndarray, numbers: np.ndarray, frequent: int):
        self.marked, self.heavy, self.numbers, self.frequent = marked, heavy, numbers, frequent

    def of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level (0: in one text only; the order puts low ones first) and class of each token."""
        counter = counter_of(found)
        bit = counter >> np.uint32(32 - MARK_BITS)
        level = (self.marked[bit >> np.uint32(6)] >> (bit & np.uint32(63)).astype(np.uint64) & np.uint64(1)).astype(np.uint8)
        kind = np.ones(len(found), np.uint8)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, counter), len(self.heavy) - 1)
            number = np.where(self.heavy[at] == counter, self.numbers[at], 1)
            level += np.minimum(4 * np.log2(number), 250).astype(np.uint8)
            kind += (number > 1).astype(np.uint8) + (number > STEP * self.frequent).astype(np.uint8)
        not_counted = (found & COUNTED) == 0
        level[not_counted], kind[not_counted] = 255, 2
        return level, kind


def frequencies(docs: DataFrame, size: int, frequent: int = FREQUENT) -> Frequencies:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = [np.zeros(0, np.uint64)]
                for text in batch.column("text").slice(at, 256):
                    found = tokens(text.as_py(), size)
                    if new_set(set_id(found), listed):
                        own.append(found[(found & COUNTED) > 0])
                counters = counter_of(np.concatenate(own)).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(counters)], ["counter"])

    counts = docs.mapInArrow(made, "counter int").groupBy("counter").agg(F.count("*").alias("n")).where("n > 1")
    counts = written(counts, "counts")
    word = F.shiftrightunsigned("counter", 32 - MARK_BITS + 6).alias("word")
    bit = F.expr(f"shiftleft(1L, shiftrightunsigned(counter, {32 - MARK_BITS}) & 63)")
    words = counts.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2^MARK_BITS / 64 rows at most
    marked = np.zeros((1 << MARK_BITS) // 64, np.int64)
    marked[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    while counts.where(F.col("n") > frequent).count() > HEAVY:
        frequent *= 4
    top = counts.where(F.col("n") > frequent).toArrow()
    heavy, numbers = top.column("counter").to_numpy().view(np.uint32), top.column("n").to_numpy()
    order = np.argsort(heavy)
    return Frequencies(marked.view(np.uint64), heavy[order], numbers[order], frequent)


def new_set(sid: bytes | None, listed: set[bytes]) -> bool:
    """Whether the set is not empty and not among those this task has met (the last ``LISTED``)."""
    if sid is None or sid in listed:
        return False
    if len(listed) >= LISTED:
        listed.clear()
    listed.add(sid)
    return True


_SETS = "n_shingles bigint, sid binary, common int, sigs array<bigint>, tokens array<bigint>, parity binary, wide binary"


def indexed(docs: DataFrame, size: int, threshold: int, **order: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, sid (digest of its set) and, where the set has entries that others may have
    too and was not met in the task before, these (sigs), its tokens and their parity maps."""
    sent = docs.sparkSession.sparkContext.broadcast(frequencies(docs, size, **order))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, listed = Index(sent.value, threshold), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield part(index, listed, batch.slice(at, 256))

    def part(index: Index, listed: set[bytes], batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, common, sigs, sets, maps, wide = [], [], [], [], [], [], []
        for text in batch.column("text"):
            found = tokens(text.as_py(), size)
            sid = set_id(found)
            own, score = index.entries(found) if new_set(sid, listed) else ((), 0)
            n.append(len(found))
            ids.append(sid)
            common.append(score)
            sigs.append(np.fromiter(own, np.uint64, len(own)).view(np.int64))
            sets.append(found.view(np.int64) if own else np.zeros(0, np.int64))
            maps.append(parity(found) if own else None)
            wide.append(parity(found, WIDE) if own and len(found) > 64 * PARITY else None)
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(common, pa.int32())]
        columns += [lists(sigs), lists(sets), pa.array(maps, pa.binary()), pa.array(wide, pa.binary())]
        released(columns[-1])
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *[c.split()[0] for c in _SETS.split(", ")]])

    return written(docs.mapInArrow(made, f"doc_id {kind}, {_SETS}"), "indexed")


def lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts)))


def shared_entries(rows: DataFrame) -> DataFrame:
    """The entries that two different sets have: sig, sid, n (size of the set), m (sets of the entry), hub and hub_n.

    Of entries that the same sets have, told by two 64-bit digests of them, one stays.
    """
    entries = rows.where(F.size("sigs") > 0).select(F.explode("sigs").alias("sig"), "sid", F.col("n_shingles").cast("int").alias("n"), "common")
    entries = entries.repartition("sig").distinct()
    hub = F.max(F.struct("common", "sid", "n"))
    same = [F.bit_xor(F.xxhash64(F.lit(k), "sid")).alias(f"same{k}") for k in (1, 2)]
    shared = entries.groupBy("sig").agg(F.count("*").alias("m"), hub.alias("h"), *same).where("m > 1")
    shared = shared.groupBy("m", "h", "same1", "same2").agg(F.min("sig").alias("sig"))
    return written(entries.join(shared, "sig").select("sig", "sid", "n", "m", F.col("h.sid").alias("hub"), F.col("h.n").alias("hub_n")), "shared-entries")


def sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tokens and parity maps of each of the wanted sets (sid)."""
    of = ("tokens", "parity", "wide")
    own = rows.where(F.size("sigs") > 0).select("sid", *of).join(wanted.select("sid").distinct(), "sid", "left_semi")
    return written(own.groupBy("sid").agg(*[F.first(c).alias(c) for c in of]), "sets")


def of_like_size(a: Column, b: Column, threshold: int) -> Column:
    return (100 * F.least(a, b)) >= (threshold * F.greatest(a, b))


def ordered_pair(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def reaches(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of the distinct pairs (u, v) whose sets reach the threshold."""
    left = sets.select(F.col("sid").alias("u"), F.col("tokens").alias("x"))
    right = sets.select(F.col("sid").alias("v"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    found = pairs.join(left, "u").join(right, "v").select("u", "v", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return found.where(100 * F.col("both") >= threshold * (F.col("sum") - F.col("both"))).select("u", "v")


def in_blocks(texts: DataFrame, *more: str) -> DataFrame:
    """The texts of each entry (sig, sid, n, root, parity, wide, and ``more``) in blocks of about ``BLOCK``, fewer where tokens are long."""
    number = F.count("*") / BLOCK
    counts = texts.groupBy("sig").agg((F.greatest(number, F.sum("n") / LONG) if "tokens" in more else number).alias("blocks"))
    dealt = texts.join(counts, "sig").withColumn("block", F.pmod(F.xxhash64("sid"), F.ceil("blocks")))
    dealt = dealt.repartition("sig")  # for the join of blocks too, whose runs a skew join would cut
    return dealt.groupBy("sig", "block").agg(F.collect_list(F.struct("sid", "n", "root", "parity", "wide", *more)).alias("texts"))


def block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The blocks of ``left`` (a) with those of ``right`` (b) in the same entry.

    A merge join gives the rows of a block a (sig, place) one after another, a run. In any other order more rows would be
    made of them, with the same links; nothing is written or sorted for the square of the blocks.
    """
    a = left.select("sig", F.col("block").alias("place"), F.col("texts").alias("a"))
    return a.hint("merge").join(right.select("sig", F.col("texts").alias("b")), "sig").select("sig", "place", "a", "b")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, bool]]:
    """The rows of block pairs, each as a batch, with sig, and whether it begins a run."""
    last = None
    for batch in batches:
        for at, key in enumerate(zip(batch.column("sig").to_pylist(), batch.column("place").to_pylist())):
            yield batch.slice(at, 1), key[0], key != last
            last = key


def members(blocks: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
    """Sizes, ids, roots, parity maps and wide ones (bytes, or None) of the texts of each block."""
    flat = blocks.flatten()
    n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
    words = [np.frombuffer(b"".join(flat.field(f).to_pylist()), np.uint64).reshape(len(n), -1) for f in ("sid", "root", "parity")]
    words.append(np.array([*flat.field("wide").to_pylist(), None], object)[:-1])
    end = 0
    for length in blocks.value_lengths().to_pylist():
        start, end = end, end + length
        yield n[start:end], *[w[start:end] for w in words]


def may_link(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Which texts of a and b have different ids and roots and may reach the threshold, and by how many bits their maps differ."""
    (n, ids, root, bits, wide), (m, b_ids, b_root, b_bits, b_wide) = a, b
    sizes = n[:, None] + m[None, :]
    least = -(-threshold * sizes // (100 + threshold))
    keep = (ids[:, None] != b_ids[None]).any(axis=2) & (root[:, None] != b_root[None]).any(axis=2)
    keep &= least <= np.minimum(n[:, None], m[None, :])
    most = sizes - 2 * least
    differ = np.bitwise_count(bits[:, None] ^ b_bits[None]).sum(axis=2, dtype=np.int32)
    keep &= differ <= most
    large = np.flatnonzero(m > 64 * PARITY)
    for i in np.flatnonzero((n > 64 * PARITY) & keep[:, large].any(axis=1)).tolist():
        own = large[keep[i, large]]
        others = np.frombuffer(b"".join(b_wide[own]), np.uint64).reshape(len(own), -1)
        differ[i, own] = np.bitwise_count(others ^ np.frombuffer(wide[i], np.uint64)).sum(axis=1)
        keep[i, own] = differ[i, own] <= most[i, own]
    return keep, differ


def candidates(texts: DataFrame, threshold: int) -> DataFrame:
    """All distinct pairs (u, v) of texts that share an entry and may reach the threshold.

    A pair of blocks is one row; only its pairs that pass all bounds are made.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[bytes, bytes]] = set()
            for at in range(batch.num_rows):
                (a,), (b,) = members(batch.column("a").slice(at, 1)), members(batch.column("b").slice(at, 1))
                x, y = np.nonzero(may_link(a, b, threshold)[0])
                found.update((max(p, q), min(p, q)) for p, q in zip(map(bytes, a[1][x]), map(bytes, b[1][y])))
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    blocks = in_blocks(texts)
    met = blocks.select("sig", F.col("texts").alias("a")).join(blocks.select("sig", F.col("texts").alias("b")), "sig")
    return met.select("a", "b").mapInArrow(compare, "u binary, v binary").distinct()


class Nearest:
    """Of each text of a block: how many others of its entry it may link with, the nearest of them, and one of the smallest root."""

    def __init__(self, texts: tuple[np.ndarray, ...]):
        n = len(texts[0])
        self.texts, self.number = texts, np.zeros(n, np.int64)
        self.differ, self.root = np.full(n, 1 << 30, np.int32), np.full(n, ~np.uint64(0))
        self.nearest, self.least = np.zeros((n, 2), np.uint64), np.zeros((n, 2), np.uint64)

    def meet(self, others: tuple[np.ndarray, ...], threshold: int) -> None:
        keep, differ = may_link(self.texts, others, threshold)
        own = np.flatnonzero(keep.any(axis=1))
        if not len(own):
            return
        keep, ids = keep[own], others[1]
        first = self.number[own] == 0
        self.number[own] += keep.sum(axis=1)
        differ = np.where(keep, differ[own], 1 << 30)
        roots = np.where(keep, others[2][None, :, 0], ~np.uint64(0))
        for values, best, of in ((differ, self.differ, self.nearest), (roots, self.root, self.least)):
            at = values.argmin(axis=1)
            at = np.where(keep[np.arange(len(own)), at], at, keep.argmax(axis=1))  # a root may have the highest value
            value = values[np.arange(len(own)), at]
            better = first | (value < best[own])
            best[own[better]], of[own[better]] = value[better], ids[at[better]]

    def rows(self, sig: int) -> Iterator[tuple[int, bytes, bytes, bool]]:
        for at in np.flatnonzero(self.number).tolist():
            own, others = bytes(self.texts[1][at]), {bytes(self.nearest[at]), bytes(self.least[at])}
            for other in others:
                yield sig, own, other, bool(self.number[at] > len(others))


_PROPOSED = "sig bigint, sid binary, other binary, cut boolean"


def _proposed(rows: list[tuple[int, bytes, bytes, bool]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.bool_())
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["sig", "sid", "other", "cut"])


def nearest_between(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """Of each text of ``left`` at most two of ``right`` that it may link with, as ``proposals``: a block meets one after another."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for row, sig, begins in runs(batches):
            if begins:
                if own:
                    yield _proposed([*own.rows(last)])
                own, last = Nearest(*members(row.column("a"))), sig
            own.meet(*members(row.column("b")), threshold)
        if own:
            yield _proposed([*own.rows(last)])

    return block_pairs(in_blocks(left), in_blocks(right)).mapInArrow(across, _PROPOSED)


def proposals(texts: DataFrame, threshold: int) -> DataFrame:
    """Of each text outside its entry's largest component at most two others that it may link with (sig, sid, other), and
    whether there are more (cut). An entry of one block is one row."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(at, 256)
                outside = part.column("texts").flatten().field("outside").to_numpy(zero_copy_only=False)
                end = 0
                for sig, block in zip(part.column("sig").to_pylist(), members(part.column("texts"))):
                    start, end = end, end + len(block[0])
                    own = Nearest(tuple(x[outside[start:end]] for x in block))
                    own.meet(block, threshold)
                    rows += own.rows(sig)
                yield _proposed(rows)

    small, large = texts.where(F.col("own") <= BLOCK), texts.where(F.col("own") > BLOCK)
    outside = (F.col("root") != F.col("largest")).alias("outside")
    small = small.groupBy("sig").agg(F.collect_list(F.struct("sid", "n", "root", "parity", "wide", outside)).alias("texts"))
    return small.mapInArrow(within, _PROPOSED).unionByName(nearest_between(large.where("root != largest"), large, threshold))


def links_between(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) of different roots, between texts of ``left`` and ``right`` (both with tokens) that share an entry.

    One for each root that a block of ``left`` has in an entry, where there is one; all candidates are verified here till then.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linked: set[bytes] = set()
        for row, _, begins in runs(batches):
            if begins:
                linked = set()
            (a,), (b,) = members(row.column("a")), members(row.column("b"))
            x, y = (row.column(c).flatten().field("tokens") for c in ("a", "b"))
            keep, differ = may_link(a, b, threshold)
            found = []
            for i in np.flatnonzero(keep.any(axis=1)).tolist():
                root, own = bytes(a[2][i]), x[i].values.to_numpy()
                if root in linked:
                    continue
                others = np.flatnonzero(keep[i])
                for k in others[differ[i, others].argsort()].tolist():
                    if reaches(own, y[k].values.to_numpy(), threshold):
                        pair = bytes(a[1][i]), bytes(b[1][k])
                        found.append((max(pair), min(pair)))
                        linked.add(root)
                        break
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    met = block_pairs(in_blocks(left, "tokens"), in_blocks(right, "tokens"))
    return met.mapInArrow(compare, "u binary, v binary").distinct()


def similar_pairs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, threshold: int = THRESHOLD, **order: int) -> tuple[DataFrame, DataFrame]:
    """The join: every pair of different sets that reach the threshold, as (u, v), and which document has which set."""
    rows = indexed(narrow(docs, doc_id, text), size, threshold, **order)
    shared = shared_entries(rows)
    sets = sets_of(rows, shared)
    texts = shared.join(sets.select("sid", "parity", "wide"), "sid").withColumn("root", F.col("sid"))
    pairs = written(candidates(texts, threshold), "candidates")
    return verified(pairs, sets, threshold), rows.select("doc_id", "n_shingles", "sid")


def narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))


def _roots(shared: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Roots of the components of all sets that link, by verified links enough to connect them."""
    like = of_like_size(F.col("n"), F.col("hub_n"), threshold)
    pairs = shared.where((F.col("sid") != F.col("hub")) & like).select(*ordered_pair(F.col("sid"), F.col("hub"))).distinct()
    tested = written(pairs, "candidates")
    roots = written(components(written(verified(tested, sets, threshold), "links")), "roots")
    for _ in range(ROUNDS):
        texts = _open_entries(shared, roots, sets)
        found = written(proposals(texts, threshold), "proposals")
        if found.isEmpty():  # entries have one component each, or what they have more of is too far apart
            return roots
        pairs = found.select(*ordered_pair(F.col("sid"), F.col("other"))).distinct().join(tested, ["u", "v"], "left_anti")
        pairs = written(pairs, "candidates")
        new = written(verified(pairs, sets, threshold), "links")
        cut = found.where("cut").select("sig", "sid").distinct()
        any_new, any_cut = not new.isEmpty(), not cut.isEmpty()
        if any_new:
            roots = _joined(roots, new)
        if not any_cut:  # every candidate was verified
            return roots
        if not any_new:
            break
        shared = texts  # an entry that has become one component stays one
        tested = tested.unionByName(pairs)
    # A pair that was not verified has a text that had more candidates than it proposed.
    shared = written(texts.join(cut.select("sig").distinct(), "sig", "left_semi"), "cut-entries")
    while True:
        texts = _open_entries(shared, roots, sets)
        left = texts.join(cut, ["sig", "sid"], "left_semi")
        met = written(nearest_between(texts, left, threshold).select("sig", "sid").distinct(), "met")
        if met.isEmpty():
            return roots
        right = texts.join(met, ["sig", "sid"], "left_semi")
        new = written(links_between(*[x.join(sets.select("sid", "tokens"), "sid") for x in (left, right)], threshold), "links")
        if new.isEmpty():
            return roots
        roots = _joined(roots, new)


def _joined(roots: DataFrame, new: DataFrame) -> DataFrame:
    """The roots with the components of new links put together."""
    stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    return written(components(stars.unionByName(new)), "roots")


def _open_entries(shared: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """The texts of entries that hold several components, with their root, the entry's largest one, parity map, and number of texts (own)."""
    named = shared.select("sig", "sid", "n").join(roots, F.col("sid") == F.col("node"), "left")
    named = named.select("sig", "sid", "n", F.coalesce("root", "sid").alias("root"))
    named = written(named, "entries-with-roots")
    largest = (
        named.groupBy("sig", "root").agg(F.count("*").alias("k"))
        .groupBy("sig").agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots"), F.sum("k").alias("own"))
        .where("roots > 1").select("sig", "own", F.col("top.root").alias("largest"))
    )
    return written(named.join(largest, "sig").join(sets.select("sid", "parity", "wide"), "sid"), "open-entries")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, threshold: int = THRESHOLD, **order: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows = indexed(narrow(docs, doc_id, text), size, threshold, **order)
    shared = shared_entries(rows)
    roots = _roots(shared, sets_of(rows, shared), threshold)
    of = rows.select("doc_id", "n_shingles", "sid")
    first = of.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first"))
    named = first.join(roots, first["sid"] == roots["node"], "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    named = written(named, "classes")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = of.join(named.join(least, "root").select("sid", "component_id"), "sid", "left")
    own = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"))
