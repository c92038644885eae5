"""Alignment of the tokens of two tokenizers by anchors at white space.

Each text is encoded whole by both tokenizers: A is a byte-level BPE file of the ``tokenizers`` library, B a
``sentencepiece`` model with byte fallback. Offsets in bytes where both have a token's end and both go on with a token
that begins with a space are *anchors*: they are checked against the ends of both sides, not assumed. Anchors cut the
document into windows, pairs of short tuples of ids; how the tokens of a window group and overlap depends on its ids
alone, so each worker remembers the alignment of a window by its two tuples, up to ``REMEMBERED``; the only window of a
part between spaces is remembered with the part, by its text.

The tokens of a document are taken only if their bytes, joined, are the space and the text on both sides. Tokens are
linked where their bytes overlap; the count of an id pair is the number of documents that hold it linked.

Alignments are written once, the links as distinct pair codes with their number. Counts are summed by Spark. If the
distinct pairs of the corpus are at most ``SENT_PAIRS`` (checked; 16 bytes each) they are sent to the executors as
sorted arrays; beyond that the links are joined with them by pair.

Defined results: a text that is null or empty, or whose bytes differ, has no tokens; rows are never merged or dropped; a
repeated row counts as a document of its own; an empty table gives none. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timepoint.llm.bpe import byte_letters
from timepoint.llm.common import column, read_text, released, written

#: Parts, and windows, of a generation; the parts of the last generation are kept beside those of the present one.
REMEMBERED = 400_000
#: Windows of more tokens are aligned afresh each time.
LONG = 64
#: Bytes of text that are encoded at a time.
AT_ONCE = 1 << 18
SENT_PAIRS = 4_000_000
#: A pair's code is the id of A times this, plus the id of B.
B_IDS = 1 << 24
#: A space after white space; where a space follows anything else.
DOUBLED, STARTS = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")
_pairs: dict[str, TokenPair] = {}
#: n_a, n_b, groups, their number, codes of the links.
Aligned = tuple[int, int, str, int, bytes]


class Side:
    """The tokens of one vocabulary in bytes."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length, self.names = [len(t) for t in tokens], [str(i) for i in range(len(tokens))]
        self.lengths = np.array(self.length, np.int64)
        self.spaced = np.array([t.startswith(b" ") for t in tokens])

    def bytes_of(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def spell(self, lists: list[list[int]], texts: list[bytes]) -> list[bool]:
        """Of each list of ids whether its bytes are the text: all at once, and one by one only if some are not."""
        ids = np.fromiter(chain.from_iterable(lists), np.int64)
        ends = np.cumsum([0, *map(len, lists)])
        upto = np.concatenate([[0], np.cumsum(self.lengths[ids])])[ends]
        if np.array_equal(np.diff(upto), list(map(len, texts))) and self.bytes_of(ids.tolist()) == b"".join(texts):
            return [True] * len(texts)
        return [self.bytes_of(x) == t for x, t in zip(lists, texts)]


def byte_level(tokenizer: Tokenizer) -> Side:
    """Tokens whose letters stand for bytes."""
    of_letter = {letter: b for b, letter in enumerate(byte_letters())}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        tokens[i] = bytes(of_letter[c] for c in t) if all(c in of_letter for c in t) else t.encode()
    return Side(tokens)


def pieces(model: sentencepiece.SentencePieceProcessor) -> Side:
    """Pieces with U+2581 as space; ``<0xHH>`` is a byte."""
    ids = range(model.get_piece_size())
    name = model.id_to_piece
    return Side([bytes([int(name(i)[3:5], 16)]) if model.is_byte(i) else name(i).replace("▁", " ").encode() for i in ids])


def window(ids_a: Sequence[int], ids_b: Sequence[int], a: Side, b: Side) -> tuple[str, int, bytes]:
    """Groups as text, their number, and the codes of the overlapping pairs, for two sides that start and end together."""
    links, groups = [], []
    length_a, length_b, name_a, name_b = a.length, b.length, a.names, b.names
    i = j = first_a = first_b = 0
    end_a, end_b, last = length_a[ids_a[0]], length_b[ids_b[0]], len(ids_a) - 1
    while True:
        links.append(ids_a[i] * B_IDS + ids_b[j])
        if end_a < end_b:
            i += 1
            end_a += length_a[ids_a[i]]
        elif end_b < end_a:
            j += 1
            end_b += length_b[ids_b[j]]
        else:
            one_a = name_a[ids_a[i]] if i == first_a else ",".join([name_a[k] for k in ids_a[first_a : i + 1]])
            one_b = name_b[ids_b[j]] if j == first_b else ",".join([name_b[k] for k in ids_b[first_b : j + 1]])
            groups.append(f"{one_a}|{one_b}")
            if i == last:  # the sides end together
                return ";".join(groups), len(groups), array("q", links).tobytes()
            i, j = i + 1, j + 1
            first_a, first_b = i, j
            end_a += length_a[ids_a[i]]
            end_b += length_b[ids_b[j]]


def parts_of(text: str) -> list[str]:
    """What follows each space of the space and the text that has no white space before it."""
    whole = f" {text}"
    return text.split(" ") if DOUBLED.search(whole) is None else [p[1:] for p in STARTS.split(whole)]


class TokenPair:
    """Both tokenizers, and the parts and windows met so far.

    Neither vocabulary has a token that goes on over a space after another character (A never does; B is checked), so
    each part between such spaces is encoded by itself, once; a file for which this does not hold gets whole texts.
    """

    def __init__(self, file_a: str, model_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(file_a)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.a, self.b = byte_level(self.tokenizer), pieces(self.model)
        spec = json.loads(file_a)
        by_words = (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex") and not spec["normalizer"]
        self.by_parts = bool(by_words) and not any(b" " in t.lstrip(b" ") for t in self.b.tokens)
        self.spaced_a, self.spaced_b = self.a.spaced.tolist(), self.b.spaced.tolist()
        self.parts: dict[str, Aligned | None] = {}
        self.last_parts: dict[str, Aligned | None] = {}
        self.windows: dict[tuple[bytes, bytes], tuple[str, int, bytes]] = {}

    def learn(self, parts: set[str]) -> dict[str, Aligned | None]:
        """The alignment of a space and each part; None where the bytes of a side are not the part's."""
        if len(self.parts) > REMEMBERED:
            self.last_parts, self.parts = self.parts, {}
        new = [p for p in parts if p not in self.parts]
        if self.last_parts:
            self.parts.update({p: self.last_parts[p] for p in new if p in self.last_parts})
            new = [p for p in new if p not in self.parts]
        spaced = [f" {p}" for p in new]
        ours = [e.ids for e in self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]
        # The model gives no tokens for the empty text; a last space is a piece of its own.
        theirs = [ids if p else [self.model.piece_to_id("▁")] for p, ids in zip(new, self.model.encode(new, num_threads=1))]
        texts = [t.encode() for t in spaced]
        for p, x, y, same_a, same_b in zip(new, ours, theirs, self.a.spell(ours, texts), self.b.spell(theirs, texts)):
            self.parts[p] = (len(x), len(y), *self.aligned(x, y)) if same_a and same_b else None
        return self.parts

    def window(self, ids_a: list[int], ids_b: list[int]) -> tuple[str, int, bytes]:
        """The alignment of a window, remembered by its two tuples of ids."""
        if len(ids_a) + len(ids_b) > LONG:
            return window(ids_a, ids_b, self.a, self.b)
        key = (array("i", ids_a).tobytes(), array("i", ids_b).tobytes())
        if (got := self.windows.get(key)) is None:
            if len(self.windows) >= REMEMBERED:
                self.windows.clear()
            got = self.windows[key] = window(ids_a, ids_b, self.a, self.b)
        return got

    def aligned(self, ids_a: list[int], ids_b: list[int]) -> tuple[str, int, bytes]:
        """Groups as text, their number, and the code of every link, window by window."""
        spaced_a, spaced_b = self.spaced_a, self.spaced_b
        if not any([spaced_a[i] for i in ids_a[1:]]) or not any([spaced_b[i] for i in ids_b[1:]]):
            # One window: of a part, which is remembered itself; a whole text is not met again.
            return window(ids_a, ids_b, self.a, self.b)
        # Starts of space-marked tokens, in bytes; those that both sides have are the anchors.
        x, y = np.array(ids_a), np.array(ids_b)
        at_x, at_y = np.nonzero(self.a.spaced[x[1:]])[0], np.nonzero(self.b.spaced[y[1:]])[0]
        ends_x, ends_y = np.cumsum(self.a.lengths[x])[at_x], np.cumsum(self.b.lengths[y])[at_y]
        at_x, at_y = at_x[np.isin(ends_x, ends_y, assume_unique=True)], at_y[np.isin(ends_y, ends_x, assume_unique=True)]
        cut_x, cut_y = [0, *(at_x + 1).tolist(), len(ids_a)], [0, *(at_y + 1).tolist(), len(ids_b)]
        found = [self.window(ids_a[a:b], ids_b[c:d]) for a, b, c, d in zip(cut_x, cut_x[1:], cut_y, cut_y[1:])]
        groups, numbers, links = zip(*found)
        return ";".join(groups), sum(numbers), b"".join(links)

    def batch(self, texts: list[str | None]) -> Iterator[tuple]:
        """Of each text n_a, n_b, n_groups, n_links, groups, and its distinct pairs with their numbers.

        A part begins where both sides go on with a space-marked token, so its start is an anchor, and the windows of a text
        are those of its parts.
        """
        cut = [(parts_of(t) if self.by_parts else [t]) if t else [] for t in texts]
        known = self.learn(set().union(*cut))
        for parts in cut:
            found = [known[p] for p in parts]
            if not found or None in found:
                yield 0, 0, 0, 0, None, np.zeros(0, np.int64), np.zeros(0, np.int64)
            else:
                n_a, n_b, groups, numbers, links = zip(*found)
                codes = np.frombuffer(b"".join(links), np.int64)
                yield sum(n_a), sum(n_b), sum(numbers), len(codes), ";".join(groups), *np.unique(codes, return_counts=True)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])).cast(kind))


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string, pairs array<bigint>, times array<int>"


class Aligner:
    """Aligns documents with two vocabulary files, which the driver reads and sends."""

    def __init__(self, spark: SparkSession, path_a: str, path_b: str):
        with open(path_b, "rb") as f:
            sent, key = spark.sparkContext.broadcast((read_text(path_a), f.read())), uuid.uuid4().hex

        def own() -> TokenPair:
            if key not in _pairs:
                _pairs.clear()
                _pairs[key] = TokenPair(*sent.value)
            return _pairs[key]

        self.own = own

    def documents(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", groups: bool = True) -> DataFrame:
        """One row per document: its id, counts, groups (``a1,a2|b1;..`` or only their digest) and linked pairs."""
        own = self.own
        rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
        kind = rows.schema["doc_id"].dataType.simpleString()

        def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts, start, held = batch.column("doc_id"), batch.column("text"), 0, 0
                for i in range(len(texts)):
                    held += texts[i].as_buffer().size if texts[i].is_valid else 0
                    if held >= AT_ONCE or i + 1 == len(texts):
                        yield made(ids.slice(start, i + 1 - start), texts.slice(start, i + 1 - start).to_pylist())
                        start, held = i + 1, 0

        def made(ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            n_a, n_b, n_groups, n_links, listed, pairs, times = map(list, zip(*own().batch(texts)))
            digests = ["" if g is None else hashlib.sha256(g.encode()).hexdigest() for g in listed]
            columns = [ids, *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]]
            columns += [pa.array(listed if groups else [None] * len(listed), pa.string()), pa.array(digests)]
            columns += [lists(pairs, pa.int64()), lists(times, pa.int32())]
            released(columns[-1])
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *[c.split()[0] for c in ALIGNED.split(", ")]])

        return rows.mapInArrow(align, f"doc_id {kind}, {ALIGNED}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Of each linked pair of ids the documents that hold it (n), and whether no other pair of its A id has more (best)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = written(counts, "pair-counts").withColumn("a", F.floor(F.col("pair") / B_IDS))
    highest = counts.groupBy("a").agg(F.max("n").alias("high"))
    return counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("high")).alias("best"))


def scored(aligned: DataFrame, *, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """The aligned documents with n_best (links whose pair is the best of its A id) and count_sum (counts over links)."""
    counts = written(pair_counts(aligned), "pair-counts")
    if counts.count() > sent_pairs:
        return _scored_by_join(aligned, counts)
    table = counts.orderBy("pair").toArrow()
    sent = aligned.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("pair", "n", "best")])

    @F.arrow_udf("struct<n_best:bigint,count_sum:bigint>")
    def score(pairs: pa.Array, times: pa.Array) -> pa.Array:
        codes, n, best = sent.value
        ends = np.concatenate([[0], np.cumsum(np.asarray(pairs.value_lengths()))])
        at, times = np.searchsorted(codes, pairs.flatten().to_numpy()), times.flatten().to_numpy().astype(np.int64)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[at], times * n[at])]
        return released(pa.StructArray.from_arrays([pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums], ["n_best", "count_sum"]))

    return aligned.withColumn("score", score("pairs", "times")).withColumns({c: F.col(f"score.{c}") for c in ("n_best", "count_sum")}).drop("score")


def _scored_by_join(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same without sending the counts; ``aligned`` has a ``row`` number of its own."""
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.*")
    links = links.join(counts, F.col("pairs") == F.col("pair"))
    sums = links.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_best", "count_sum")}
    return aligned.join(sums, "row", "left").withColumns(zero)


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, **options) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    rows = Aligner(spark, path_a, path_b).documents(docs, groups=False).drop("groups")
    aligned = written(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    return scored(aligned, **options)
