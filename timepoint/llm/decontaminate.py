"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

A window is ten consecutive words of an item (the whole item, where it has fewer words but some). The windows of all
items make one automaton, which passes once over the normalised text of each document; the ends of its matches lead to
word numbers, and those to places in the document as it was.

The items are sent to the executors, so their size, with that of their ids, is checked: beyond ``words_per_automaton`` the
distinct pairs of id and text are dealt by their hash into several sets, one automaton and one pass each, with the findings
so far kept in a written table between passes. A text under many ids is so dealt over the sets like any other items.

Defined results: null and wordless texts have no words and no hits; a wordless item has no window; items with a null id
hit words but are not listed; an id in several rows of the items is listed once; document rows are never merged, so a
repeated row gives a repeated result; an empty item table leaves every document clean. Extra columns are not carried.
"""

from __future__ import annotations

import math
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timepoint.llm.common import WORD, column, plain_words, released, written

WINDOW = 10
WORDS_PER_AUTOMATON = 1_000_000
FOUND = "struct<n_words: bigint, first: array<int>, last: array<int>, items: array<string>, spans: array<struct<start: int, end: int>>>"
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("first", pa.list_(pa.int32())),
        ("last", pa.list_(pa.int32())),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)
_built: dict[str, object] = {}


def automaton(items: list[tuple[str | None, str | None]], size: int):
    """The automaton of all windows; a match gives the window's length in words and the ids that have it."""
    windows: dict[bytes, tuple[int, set]] = {}
    for item_id, text in items:
        words = plain_words(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            part = words[i : i + size]
            windows.setdefault(b" ".join(part), (len(part), set()))[1].add(item_id)
    machine = ahocorasick.Automaton()
    for window, (length, ids) in windows.items():
        machine.add_word(f" {window.decode('latin-1')} ", (length, ids - {None}))
    machine.make_automaton()
    return machine if windows else None


def passages(text: str | None, machine) -> tuple[list[bytes], list[tuple[int, int]], set]:
    """Words, merged runs of hit words (first, last), and the ids of the items found."""
    words = plain_words(text)
    if not words or machine is None:
        return words, [], set()
    ends = np.cumsum([len(w) + 1 for w in words])
    runs, ids = [], set()
    for end, (length, found) in machine.iter(f" {b' '.join(words).decode('latin-1')} "):
        last = int(np.searchsorted(ends, end))
        ids |= found
        runs.append((last - length + 1, last))
    return words, merge_runs(runs), ids


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


def places(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Code points of the runs in the text as it stands, end exclusive."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    return [{"start": spans[a][0], "end": spans[b][1]} for a, b in runs]


def _scanner(items, size: int):
    """A column function (text, findings so far) -> findings, for the broadcast items."""
    key = uuid.uuid4().hex

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array, sofar: pa.Array) -> pa.Array:
        if key not in _built:
            _built.clear()
            _built[key] = automaton(items.value, size)
        rows = []
        for text, old in zip(texts, sofar):
            text, old = text.as_py(), old.as_py()
            words, runs, ids = passages(text, _built[key])
            if old:
                runs = merge_runs(runs + list(zip(old["first"], old["last"])))
                ids |= set(old["items"])
            rows.append(
                {
                    "n_words": len(words),
                    "first": [a for a, _ in runs],
                    "last": [b for _, b in runs],
                    "items": sorted(ids),
                    "spans": places(text, runs) if runs else [],
                }
            )
        return released(pa.array(rows, _ARROW))

    return scan.asNondeterministic()


def with_findings(
    docs: DataFrame,
    benchmark: DataFrame,
    into: str,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    words_per_automaton: int = WORDS_PER_AUTOMATON,
) -> DataFrame:
    """The documents with the findings (``FOUND``) in column ``into``."""
    items = benchmark.select(column(benchmark, item_id).cast("string").alias("id"), column(benchmark, item_text).alias("text"))
    items = written(items.where(F.col("text").isNotNull()).distinct(), "items")
    # Spaces and other parting characters are at least as many as words, less one; ids count by the same measure.
    size = items.agg(F.sum((F.octet_length("text") + F.coalesce(F.octet_length("id"), F.lit(0))) / 2 + 1)).first()[0] or 0
    parts = max(1, math.ceil(size / words_per_automaton))
    out, sofar = docs, F.lit(None).cast(FOUND)
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part) if parts > 1 else items
        sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in mine.collect()])
        if part:
            out = written(out, "findings")
            sofar = column(out, into)
        out = out.withColumn(into, _scanner(sent, window)(column(out, text), sofar))
    return out


def n_hit(found: Column) -> Column:
    """Words inside any occurrence of a window."""
    return F.aggregate(
        F.zip_with(found["first"], found["last"], lambda a, b: (b - a + 1).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x
    )


def find_passages(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (their ids, sorted as strings), spans (places in the text)."""
    text = options.get("text", "text")
    rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
    found = with_findings(rows, benchmark, "found", **{**options, "text": "text"})
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit(F.col("found")).alias("n_hit"),
        F.col("found.items").alias("items"), F.col("found.spans").alias("spans"),
    )
