"""Licence scans by a positional index of rare words.

Templates are licence notices and texts with mandatory key phrases. Their words are weighed by inverse document frequency
over all documents; the postings of a word are its places in each template. A template stands at a start of a document if
words of at least ``min_share`` of its weight are in place there, give or take ``SLACK`` words, and every key phrase is.
A document looks up its own rarest words of each template: what it lacks is lost already, and it takes as many of the rest,
rarest first, as weigh more than may still be lost without the ``min_rare`` - 1 heaviest of them. So wherever the template
stands, ``min_rare`` of these words say where it starts (one, for templates too short for that): their places are
intersected by relative position, and only such starts are compared word by word. No start is missed, whichever words a
notice has lost. The base phrases are templates that must stand there whole.

The index is some hundred words, whatever the data; document frequencies are counted for those words only, over whole
texts of all documents.

Defined results: null and wordless texts have no words and no matches; ties in document frequency go by the word;
overlapping matches of one template or of several all count; rows are never merged; an empty table gives none. Extra
columns are not carried.
"""

from __future__ import annotations

import math
import operator
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timepoint.llm.common import column, plain_words

MIN_RARE = 2
MIN_SHARE = 0.8
#: What rounding may add to a sum of weights.
EPSILON = 1e-9
#: Words by which a place may be off.
SLACK = 2
#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, notice, and the phrases that must stand in it.
NOTICES = [
    ("mit", "under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met", ["redistribution and use in source and binary forms"]),
    ("gpl-2.0", "GNU General Public License, version 2", ["general public license version 2"]),
    ("gpl-3.0", "GNU General Public License, version 3", ["general public license version 3"]),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation",
     ["gnu general public license"]),
    ("lgpl", "GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl", "GNU Affero General Public License", ["affero general public license"]),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ["with or without fee"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty", ["as is without any express or implied warranty"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("cc-by-4.0", "licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0", ["cc by nc sa 4 0"]),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International", ["creative commons attribution 4 0"]),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
     "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
     "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
     ["merchantability", "noninfringement"]),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
     "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
     "following disclaimer in the documentation and/or other materials provided with the distribution.",
     ["redistributions of source code must retain", "redistributions in binary form must reproduce"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
     "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
     ["apache org licenses license 2 0"]),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ["cc0 1 0"]),
]
MATCH = "struct<label: string, base: boolean, start: bigint, words: int, share: double>"
_ARROW = pa.list_(
    pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int32()), ("share", pa.float64())])
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool = False


def templates(base: dict[str, str] = BASE, notices: list = NOTICES) -> list[Template]:
    exact = [Template(label, tuple(plain_words(p)), (tuple(plain_words(p)),), True) for p, label in base.items()]
    return exact + [Template(label, tuple(plain_words(t)), tuple(tuple(plain_words(k)) for k in keys)) for label, t, keys in notices]


def stands(words: list[bytes], part: tuple[bytes, ...]) -> bool:
    """Whether the part's words stand consecutively."""
    return any(tuple(words[i : i + len(part)]) == part for i in range(len(words) - len(part) + 1))


class Index:
    """Places and weights of the templates' words, for document frequencies ``df`` of ``n`` documents."""

    def __init__(self, listed: list[Template], df: dict[bytes, int], n: int, min_rare: int, min_share: float):
        self.listed, self.min_rare = listed, min_rare
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for t in listed for w in t.words}
        self.places: list[dict[bytes, list[int]]] = []
        self.rare_first: list[list[tuple[bytes, float]]] = []
        self.total: list[float] = []
        self.may_lose: list[float] = []
        for t in listed:
            places: dict[bytes, list[int]] = defaultdict(list)
            for place, w in enumerate(t.words):
                places[w].append(place)
            self.places.append(dict(places))
            self.rare_first.append([(w, self.idf[w] * len(places[w])) for w in sorted(places, key=lambda w: (-self.idf[w], w))])
            self.total.append(sum(self.idf[w] for w in t.words))
            self.may_lose.append(EPSILON if t.base else (1 - min_share) * self.total[-1] + EPSILON)

    def looked_up(self, number: int, present: set[bytes]) -> tuple[list[bytes], int] | None:
        """The rarest words of a document that has these of the template's, and how many have to agree; None if the
        template cannot stand in it."""
        left = self.may_lose[number]
        for w, weight in self.rare_first[number]:
            if w not in present:
                left -= weight
                if left < 0:
                    return None
        chosen, weights = [], []
        needed = 1 if self.listed[number].base else self.min_rare
        for w, weight in self.rare_first[number]:
            if w in present:
                chosen.append(w)
                weights.append(weight)
                if sum(sorted(weights)[: len(weights) - needed + 1]) > left:
                    return chosen, needed
        return chosen, 1

    def share(self, number: int, words: list[bytes], start: int) -> float | None:
        """The share of the template's weight that stands at a start, if it is enough and the key phrases are there."""
        t, lost = self.listed[number], 0.0
        for place, w in enumerate(t.words, start):
            if w not in words[max(0, place - SLACK) : max(0, place + SLACK + 1)]:
                lost += self.idf[w]
                if lost > self.may_lose[number]:
                    return None
        here = words[max(0, start - SLACK) : max(0, start + len(t.words) + SLACK)]
        return min(1.0, 1 - lost / self.total[number]) if all(stands(here, k) for k in t.keys) else None

    def matches(self, words: list[bytes]) -> list[tuple[str, bool, int, int, float]]:
        """(label, base, first word, number of words, weighted share that stands) by place."""
        present = self.idf.keys() & set(words)
        possible = [(i, *found) for i in range(len(self.listed)) if (found := self.looked_up(i, present))] if present else []
        at: dict[bytes, list[int]] = {w: [] for _, chosen, _ in possible for w in chosen}
        if at:
            for place, w in enumerate(words):
                if w in at:
                    at[w].append(place)
        found = []
        for number, chosen, needed in possible:
            t, places = self.listed[number], self.places[number]
            own: list[tuple[float, int, int]] = []
            if t.base:
                starts = (a - places[chosen[0]][0] for a in at[chosen[0]])
                found += [(t.label, True, s, len(t.words), 1.0) for s in starts if s >= 0 and tuple(words[s : s + len(t.words)]) == t.words]
                continue
            agreeing: Counter[int] = Counter()
            for w in chosen:
                agreeing.update({a - p + d for a in at[w] for p in places[w] for d in range(-SLACK, SLACK + 1)})
            for start in sorted(s for s, n in agreeing.items() if n >= needed):
                if (share := self.share(number, words, start)) is None:
                    continue
                exact = sum(map(operator.eq, t.words[max(0, -start) :], words[max(0, start) : start + len(t.words)]))
                match = (share, exact, max(0, start))
                if own and match[2] - own[-1][2] <= SLACK:  # the same place again
                    own[-1] = max(own[-1], match, key=lambda m: m[:2])
                else:
                    own.append(match)
            found += [(t.label, False, start, len(t.words), share) for share, _, start in own]
        return sorted(found, key=lambda m: (m[2], m[0], m[1]))


def document_frequencies(docs: DataFrame, text: str, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """Of the vocabulary's words over all documents, and the number of documents."""

    @F.arrow_udf("array<string>")
    def present(texts: pa.Array) -> pa.Array:
        return pa.array([[w.decode() for w in vocabulary.intersection(plain_words(t.as_py()))] for t in texts], pa.list_(pa.string()))

    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), present.asNondeterministic()(column(docs, text)))).alias("w"))
    counts = {r.w: r.n for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}  # no more rows than the vocabulary
    n = counts.pop("", 0)
    return {w.encode(): c for w, c in counts.items()}, n


def find_licenses(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    listed: list[Template] | None = None,
    min_rare: int = MIN_RARE,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """One row per document: doc_id, n_words, and matches, an array of label, base, start (word), words and share."""
    listed = templates() if listed is None else listed
    df, n = document_frequencies(docs, text, {w for t in listed for w in t.words})
    sent = docs.sparkSession.sparkContext.broadcast(Index(listed, df, n, min_rare, min_share))

    @F.arrow_udf(f"struct<n_words: bigint, matches: array<{MATCH}>>")
    def scan(texts: pa.Array) -> pa.Array:
        index, rows = sent.value, []
        for t in texts:
            words = plain_words(t.as_py())
            found = [dict(zip(("label", "base", "start", "words", "share"), m)) for m in index.matches(words)]
            rows.append({"n_words": len(words), "matches": found})
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("matches", _ARROW)]))

    found = docs.select(column(docs, doc_id).alias("doc_id"), scan.asNondeterministic()(column(docs, text)).alias("found"))
    return found.select("doc_id", "found.n_words", "found.matches")
