"""BPE encoding and decoding with a vocabulary file of the ``tokenizers`` library (word ends marked, bytes as letters).

A word is held as a contiguous array of part boundaries with the merge rank of each pair of neighbours. Again and again
the lowest rank is sought (leftmost of equals), the boundary inside that pair deleted, and the two ranks beside it
refreshed, until no pair has a rank. The array is short for words; a piece of over ``LONG`` bytes (a run of letters
without a space) keeps the same array as linked neighbours with a heap of ranks, which gives the same merges.

The steps before it follow the file: special tokens are cut out of the raw text, then NFC, lower case by character, and
the file's split pattern. Letters that Unicode added after the tokenizer library was built are taken as letters. The file is read by the driver and sent to the executors
(a vocabulary, 1.6 MB, whatever the data). Each worker remembers the words it met, up to ``REMEMBERED``.

Defined results: null and empty texts have no tokens and decode to the empty text; rows are never merged or dropped.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.llm.common import column, read_text, released

LONG = 200
REMEMBERED = 200_000
ROWS = 256
NO_RANK = 1 << 60
# White space as the file's patterns mean it; Python's own class has four control characters more.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_coders: dict[str, WordCoder] = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class WordCoder:
    """Encodes and decodes texts with one vocabulary file."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.listed = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.string())
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}"))
        self.letters = byte_letters()
        self.known = Words(self)

    def packed(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each."""
        if not text:
            return b""
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
                continue
            # White space only parts words, so the file's replacement of it changes nothing.
            # Lower case goes by character, so a capital sigma never becomes the final one.
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += map(self.known.__getitem__, self.split.findall(plain))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def word(self, word: str) -> bytes:
        text = "".join([self.letters[b] for b in word.encode()])
        parts = merged_long if len(text) > LONG else merged
        get = self.ids.get
        return array("i", [i for p in parts(text, self.suffix, self.ranks) if (i := get(p)) is not None]).tobytes()

    def encode_batch(self, texts: pa.Array) -> pa.Array:
        packed = [self.packed(t.as_py()) for t in texts]
        ends = np.cumsum([0, *[len(p) // 4 for p in packed]], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))

    def decode_batch(self, lists: pa.Array) -> pa.Array:
        """The tokens of each list joined by a space, as the library does for a file without a decoder.

        Null lists are empty; null ids, and ids that the file has not, are left out.
        """
        ids = lists.flatten()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        inside = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(self.listed)))
        tokens = self.listed.take(pc.if_else(inside, ids, pa.scalar(None, pa.int32())))
        missing = tokens.is_null().to_numpy(zero_copy_only=False)
        if missing.any():
            before = np.concatenate([[0], np.cumsum(~missing)])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sizes, tokens = np.diff(before[ends]), tokens.drop_null()
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens), " ")

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


class Words(dict):
    """The packed ids of words met so far; the memory is emptied when it is full, and long pieces are not kept."""

    def __init__(self, coder: WordCoder):
        super().__init__()
        self.coder = coder

    def __missing__(self, word: str) -> bytes:
        ids = self.coder.word(word)
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


def by_parts(batch: pa.Array, made: Callable[[pa.Array], pa.Array], kind: pa.DataType) -> pa.Array:
    """``made`` of some rows at a time, so that only their intermediate values are held at once."""
    parts = [made(batch.slice(i, ROWS)).cast(kind) for i in range(0, len(batch), ROWS)]
    return released(pa.concat_arrays(parts) if parts else pa.array([], kind))


def merged(text: str, suffix: str, ranks: dict) -> list[str]:
    """The parts of a word after all merges, by scans of its array of ranks."""
    if not text:
        return []
    whole, get = text + suffix, ranks.get
    bounds = [*range(len(text)), len(whole)]  # the last part holds the word's end mark
    letters = [*text[:-1], text[-1] + suffix]
    at = [get(pair, NO_RANK) for pair in zip(letters, letters[1:])]  # at[i]: of the pair that meets at bounds[i + 1]
    while at:
        low = min(at)
        if low == NO_RANK:
            break
        i = at.index(low)
        del at[i], bounds[i + 1]
        start, end = bounds[i], bounds[i + 1]
        part = whole[start:end]
        if i:
            at[i - 1] = get((whole[bounds[i - 1] : start], part), NO_RANK)
        if i < len(at):
            at[i] = get((part, whole[end : bounds[i + 2]]), NO_RANK)
    return [whole[a:b] for a, b in zip(bounds, bounds[1:])]


def merged_long(text: str, suffix: str, ranks: dict) -> list[str]:
    """As ``merged``, for long pieces: the lowest rank comes from a heap instead of a scan."""
    parts: list[str | None] = [*text[:-1], text[-1] + suffix]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= n or parts[j] != right:
            continue
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (p := (parts[k], parts[after[k]])) in ranks:
                heapq.heappush(heap, (ranks[p], k, *p))
    return [p for p in parts if p is not None]


class Coder:
    """Column functions for one vocabulary file, whose path the driver reads."""

    def __init__(self, spark: SparkSession, path: str):
        sent, key = spark.sparkContext.broadcast(read_text(path)), uuid.uuid4().hex

        def coder() -> WordCoder:
            if key not in _coders:
                _coders.clear()
                _coders[key] = WordCoder(sent.value)
            return _coders[key]

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            own = coder()
            return by_parts(texts, own.encode_batch, pa.list_(pa.int32()))

        @F.arrow_udf("string")
        def decode(ids: pa.Array) -> pa.Array:
            own = coder()
            return by_parts(ids, own.decode_batch, pa.string())

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = coder()
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):  # so that little is held at once
                    part = batch.slice(at, ROWS)
                    ids = own.encode_batch(part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, own.decode_batch(ids)], ["doc_id", "ids", "decoded"])
                released(ids)

        self._both = both
        self._encode, self._decode = encode.asNondeterministic(), decode.asNondeterministic()

    def encode(self, text: Column) -> Column:
        """Ids of a text."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """Text of a list of ids, special tokens included."""
        return self._decode(ids)

    def documents(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per document: doc_id, ids, and the text that the ids decode to."""
        rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(self._both, f"doc_id {kind}, ids array<int>, decoded string")
