"""Quality rules: base counts, and the divergence of a text's histograms from its language's reference.

All of it is built-in column functions. Each text has a histogram of character classes and one of the common words of
its language; the references are the means of the histograms, as shares, of all documents of the language that pass the
base rules (over all languages, for the classes of languages without a word list), so each text weighs one whatever its
length. A text is rejected where the Jensen-Shannon distance (base 2, so 0 to 1) of a histogram from its reference passes
a limit, provided the text is long enough for the histogram to mean anything. The limit of the common words stays below
the distance that a text without any of them has, so it can be passed at every length that is judged.

Statistics are computed once and written with the rows; references are a few summed rows; verdicts are then arithmetic
on columns. Nothing within a text costs more than a sort of its words.

Defined results: null and empty texts have no words and fail the base rules; a language that is null or has no word
list is held against the classes of all documents only; rows are never merged, so a repeated row gives a repeated
result; an empty table gives none. Extra columns stay in ``keep_good`` and are not carried by ``quality``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timepoint.llm.common import column, columns_of, free_name, written

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "be"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "ist", "nicht", "ein"],
    "fr": ["de", "la", "le", "les", "et", "des", "que", "du", "un", "dans", "qui", "une"],
    "es": ["de", "la", "que", "el", "en", "los", "se", "del", "las", "un", "por", "con"],
}
MIN_WORDS = 50
#: Words, and characters in words, from which a histogram is judged.
GUARD_WORDS = 50
GUARD_CHARS = 400
#: Distances beyond which a text is rejected; common words have the slack over the root of the word count besides,
#: since a short text strays by chance, but never more than a share of the distance of a text without common words.
MAX_CLASSES = 0.35
MAX_COMMON = 0.2
SLACK = 1.0
REACH = 0.9
#: Symbols, capitals, digits and marks; the rest are letters and all else.
CLASSES = ("#*$%&|<>", "A-Z", "0-9", r"!\x22'()+,./:;=?@\[\]\\^_`{}~-")
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = r"\x20\x09-\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def of_class(text: Column, pattern: str) -> Column:
    """Characters of a class, given the class of all others."""
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", "")).cast("long")


def repeated_window_words(words: Column) -> Column:
    """Words in three-word windows that the text has twice or more (windows are told apart by 64-bit hash)."""

    def covered(hashes: Column) -> Column:
        def places(ordered: Column) -> Column:
            """Starts of windows that have an equal beside them in hash order, in text order."""
            beside = F.transform(
                ordered,
                lambda w, k: F.when(
                    w["h"].eqNullSafe(F.get(ordered, k - 1)["h"]) | w["h"].eqNullSafe(F.get(ordered, k + 1)["h"]), w["at"]
                ),
            )
            return F.sort_array(F.array_compact(beside))

        def width(starts: Column) -> Column:
            """Each start covers up to the next one, three words at most."""
            return F.aggregate(
                F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1), s + 3) - s)),
                F.lit(0),
                lambda total, n: total + n,
            )

        ordered = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        repeated = let(ordered, lambda o: let(places(o), width))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(repeated)

    def windows(ws: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
        )

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows(words), covered)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{_SPACE}]"))
    return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long")


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def with_rest(counts: Column, whole: Column) -> Column:
    """The counts, and what is left of the whole."""
    return let(counts, lambda c: F.concat(c, F.array(whole - total(c))))


def common_counts(words: Column, lang: Column) -> Column:
    """How often each common word of the language occurs, as listed, and all other words; null without a word list."""
    n, out = F.size(words).cast("long"), F.lit(None).cast("array<bigint>")
    for name, listed in COMMON_WORDS.items():
        counts = F.array(*[n - F.size(F.array_remove(words, w)) for w in listed])
        out = F.when(lang == name, with_rest(counts, n)).otherwise(out)
    return out


def statistics(text: Column, lang: Column) -> Column:
    """Counts of a text as a struct; every part of it in one pass over the row."""

    def of_words(t: Column, ws: Column) -> Column:
        chars = F.length(F.array_join(ws, "")).cast("long")
        return let(F.array(*[of_class(t, c) for c in CLASSES]), lambda known: F.struct(
            F.size(ws).cast("long").alias("n_words"), chars.alias("word_chars"), F.get(known, F.lit(0)).alias("n_symbols"),
            duplicate_lines(t).alias("n_dup_lines"), repeated_window_words(ws).alias("n_repeat_words"),
            with_rest(known, chars).alias("classes"), common_counts(ws, lang).alias("common"),
        ))

    words = lambda t: F.regexp_extract_all(t, F.lit(f"[^{_SPACE}]+"), F.lit(0))
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda ws: of_words(t, ws)))


def references(rows: DataFrame, stats: str, lang: str) -> dict[str | None, dict[str, list[float]]]:
    """Summed shares of each language with a word list, and under None of all documents, over those that pass the base rules."""
    s = column(rows, stats)
    n = {"classes": len(CLASSES) + 1, "common": len(COMMON_WORDS["en"]) + 1}
    share = lambda h: let(total(s[h]).cast("double"), lambda t: F.when(t > 0, F.transform(s[h], lambda c: c / t))).alias(h)
    passing = rows.where(~base_failed(s)).select(F.when(column(rows, lang).isin(*COMMON_WORDS), column(rows, lang)).alias("key"), *map(share, n))
    sums = [F.sum(F.get(h, F.lit(i))).alias(f"{h}{i}") for h, size in n.items() for i in range(size)]
    found: dict[str | None, dict[str, list[float]]] = {None: {"classes": [0.0] * n["classes"]}}
    for r in sorted(passing.groupBy("key").agg(*sums).collect(), key=lambda r: r["key"] or ""):  # a row for each word list, and one
        own = {h: [r[f"{h}{i}"] or 0.0 for i in range(size)] for h, size in n.items()}
        found[None]["classes"] = [a + b for a, b in zip(found[None]["classes"], own["classes"])]
        if r["key"] is not None:
            found[r["key"]] = own
    return found


def farthest(reference: list[float]) -> float | None:
    """Distance of a text that has none of the common words."""
    whole = sum(reference)
    if not whole:
        return None
    q = reference[-1] / whole
    # All of the text is in the last bin, and the reference's other bins stand alone.
    last = math.log2(2 / (1 + q)) + (q * math.log2(2 * q / (1 + q)) if q else 0.0)
    return math.sqrt((last + 1 - q) / 2)


def shares(counts: list[float]) -> Column:
    """A reference as shares, null where nothing was counted."""
    whole = sum(counts)
    return F.array(*[F.lit(c / whole) for c in counts]) if whole else F.lit(None).cast("array<double>")


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram from shares; null for an empty or missing one."""

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def divergence(p: Column, q: Column) -> Column:
        return (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2

    def of_total(n: Column) -> Column:
        terms = F.zip_with(F.transform(counts, lambda c: c / n), reference, divergence)
        return F.when((n > 0) & reference.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))))

    return let(total(counts).cast("double"), of_total)


def base_failed(stats: Column, min_words: int = MIN_WORDS) -> Column:
    return (stats["n_words"] < min_words) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def distances(rows: DataFrame, stats: str, lang: str) -> tuple[Column, Column, Column]:
    """Of the character classes and of the common words, each null where the text is too short to judge; how far the latter reaches."""
    refs, s, named = references(rows, stats, lang), column(rows, stats), column(rows, lang)
    classes, common, reach = shares(refs[None]["classes"]), F.lit(None).cast("array<double>"), F.lit(None).cast("double")
    for name, ref in refs.items():
        if name is not None:
            classes = F.when(named == name, shares(ref["classes"])).otherwise(classes)
            common = F.when(named == name, shares(ref["common"])).otherwise(common)
            reach = F.when(named == name, F.lit(farthest(ref["common"]))).otherwise(reach)
    return (
        F.when(s["word_chars"] >= GUARD_CHARS, js_distance(s["classes"], classes)),
        F.when(s["n_words"] >= GUARD_WORDS, js_distance(s["common"], common)),
        reach,
    )


def with_verdict(
    rows: DataFrame, stats: str, lang: str, *, max_classes: float = MAX_CLASSES, max_common: float = MAX_COMMON, slack: float = SLACK
) -> DataFrame:
    """The rows with base_failed, class_distance, common_distance and kept in a struct in place of the statistics."""
    s, (classes, common, reach) = column(rows, stats), distances(rows, stats, lang)
    counts = [s[c].alias(c) for c in ("n_words", *BASE)]
    judged = rows.withColumn(stats, F.struct(*counts, base_failed(s).alias("base_failed"), classes.alias("class_distance"), common.alias("common_distance")))
    v = column(judged, stats)
    limit = F.least(max_common + slack / F.sqrt(v["n_words"].cast("double")), REACH * reach)
    near = (F.coalesce(v["class_distance"], F.lit(0.0)) <= max_classes) & (v["common_distance"].isNull() | (v["common_distance"] <= limit))
    return judged.withColumn(stats, v.withField("kept", ~v["base_failed"] & near))


def quality(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, class_distance and common_distance."""
    rows = written(
        docs.select(
            column(docs, doc_id).alias("doc_id"), column(docs, lang).alias("lang"),
            statistics(column(docs, text), column(docs, lang)).alias("stats"),
        ),
        "statistics",
    )
    judged = with_verdict(rows, "stats", "lang", **limits)
    return judged.select("doc_id", "stats.*")


def keep_good(docs: DataFrame, *, text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """The documents that pass, with all their columns."""
    stats = free_name(docs, "stats")
    rows = written(docs.withColumn(stats, statistics(column(docs, text), column(docs, lang))), "statistics")
    judged = with_verdict(rows, stats, lang, **limits)
    return columns_of(judged.where(column(judged, stats)["kept"]), docs)
