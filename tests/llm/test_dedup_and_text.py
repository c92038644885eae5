"""SimHash, decontamination and BPE against plain versions."""

import hashlib
import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from timepoint.llm import bpe, decontaminate, simhash
from timepoint.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", "   \n", "one", "one two", "é" * 30, "a " * 5000, "x" * 20000, "\x00\x1f \x85nbsp\xa0", "İıſK ΑΣ"]


def documents(spark, texts, **extra):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable, by all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(prints), 2):
        if (a ^ b).bit_count() <= 2:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (d, _) in enumerate(prints):
        ids.setdefault(root(i), []).append(d)
    return [(d, min((x for x in ids[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(prints)]


@pytest.mark.parametrize("text", [*ODD_TEXTS, "The cat sat on the mat and THE CAT SAT again", " ".join(map(str, range(70000)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_simhash_query_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    got = QUERIES["op8_simhash"](spark, SF).collect()
    assert {(r.doc_id, r.fingerprint) for r in got} == {(d, f"{p:016x}") for d, p in prints}
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(plain_components(prints))


@pytest.mark.parametrize("block", [4, 256])
def test_components_of_chains_clusters_and_ties(spark, block):
    pick = random.Random(block)
    centres = [pick.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = []
    for c in centres:
        for _ in range(25):
            for b in pick.sample(range(64), pick.choice([0, 1, 2, 3])):
                c ^= 1 << b
            prints.append(c)
    prints += prints[:40]
    ids = [None, None, *range(5, len(prints) + 3)]
    ids[-1] = ids[-2]
    rows = [(d, p - (1 << 64) if p >> 63 else p) for d, p in zip(ids, prints)]
    frame = spark.createDataFrame(rows, "doc_id bigint, bits bigint")
    got = frame.join(simhash.with_components(frame, block=block), "bits").select("doc_id", "component_id").collect()
    want = plain_components(list(zip(ids, prints)))
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_simhash_of_odd_and_repeated_rows(spark):
    docs = documents(spark, ODD_TEXTS).withColumn("bits", F.lit("mine")).withColumn("sim_root", F.lit(1))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert [got[i] for i in range(3)] == [0, 0, 0] and len(got) == len(ODD_TEXTS)
    kept = simhash.keep_one(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.keep_one(docs.limit(0)).count()
    nameless = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert {r.component_id for r in simhash.near_duplicates(nameless).collect()} == {None}
    assert simhash.keep_one(nameless).count() == len(set(got.values()))


# Decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items, size=10):
    words, hit, ids = plain_words(text), set(), set()
    for item_id, item in items:
        wanted = plain_words(item)
        for part in [wanted[i : i + size] for i in range(max(1, len(wanted) - size + 1))] if wanted else []:
            for i in range(len(words) - len(part) + 1):
                if words[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    ids.add(item_id)
    return len(words), len(hit), sorted(str(i) for i in ids if i is not None)


def test_decontamination_query_against_plain_search(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d in docs:
        n, hit, ids = plain_hits(d.text, items)
        want.append((d.doc_id, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    got = [tuple(r)[:6] for r in QUERIES["op5_decontamination"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and any(r[5] for r in got)


ITEMS = [
    (1, "To be, or not to be: that is the question whether"), (2, "short item"), (2, "Short   ITEM"), (10, "or not to be"),
    (None, "nameless thing"), (4, ""), (5, None), (6, "..."), (7, "été là"), (8, "a a"), (9, "to be or not to be that is the question whether tis nobler"),
]
TEXTS = [
    *ODD_TEXTS, "He said: TO BE or not to be that is - the Question, whether tis nobler in the mind", "a a a b a", "(Short) item shorter items",
    "a nameless thing", "ÉTÉ LÀ été là", "short\nitem " * 3000,
]


@pytest.mark.parametrize("bound", [1_000_000, 20])
def test_decontamination_of_odd_texts(spark, bound):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("n_hit", F.lit(1))
    docs = documents(spark, TEXTS).withColumn("found", F.lit(1)).withColumn("items", F.lit(1))
    got = decontaminate.find_passages(docs, bench, words_per_automaton=bound).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == {i: plain_hits(t, ITEMS) for i, t in enumerate(TEXTS)}
    text = TEXTS[len(ODD_TEXTS)]
    spans = next(r.spans for r in got if r.doc_id == len(ODD_TEXTS))
    assert [text[s.start : s.end] for s in spans] == ["TO BE or not to be that is - the Question, whether tis nobler"]


def test_decontamination_without_items_or_documents(spark):
    docs, none = documents(spark, TEXTS), spark.createDataFrame([], "item_id bigint, text string")
    assert {r.n_hit for r in decontaminate.find_passages(docs, none).collect()} == {0}
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.find_passages(docs.limit(0), bench).count() == 0


def test_items_sent_are_bounded_also_for_one_text_under_many_ids(spark, monkeypatch):
    rows = [(f"id{i:04}", "one item text of some words") for i in range(300)] * 2 + [(f"null{i}", None) for i in range(900)] + [(None, "other words")] * 900
    bench = spark.createDataFrame(rows, "item_id string, text string")
    docs = spark.createDataFrame([(1, "here is one item text of some words"), (2, "and other words"), (3, None)], "doc_id bigint, text string")
    sent, scanner = [], decontaminate._scanner
    monkeypatch.setattr(decontaminate, "_scanner", lambda items, size: sent.append(items.value) or scanner(items, size))
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.find_passages(docs, bench, words_per_automaton=2000).collect()}
    assert got == {1: (6, [f"id{i:04}" for i in range(300)]), 2: (2, []), 3: (0, [])}
    assert sum(map(len, sent)) == 301 and 1 < len(sent) < 5
    assert all(sum((len(i or "") + len(t)) / 2 + 1 for i, t in items) <= 1.25 * 2000 for items in sent)


# BPE


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary())


def test_bpe_query_against_the_library(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        text = library.decode(e.ids, skip_special_tokens=False)
        ids = " ".join(map(str, e.ids))
        want.append((r.doc_id, len(e.ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op9_bpe"](spark, SF).collect())) == sorted(want)


def test_bpe_of_odd_texts(spark, library):
    texts = [*ODD_TEXTS, "<|endoftext|>a<|STARTOFTEXT|>b<|startoftext|>", "It's we'LL 12½ ok!!...", "a\x1cb　c ", "😀🇫🇷é"]
    coder = bpe.Coder(spark, vocabulary())
    docs = documents(spark, texts).withColumn("ids", F.lit("mine"))
    got = docs.select("doc_id", coder.encode(F.col("text")).alias("n")).withColumn("back", coder.decode(F.col("n"))).collect()
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n, r.back) == (ids, library.decode(ids, skip_special_tokens=False))
        assert r.n == ids
    rows = coder.documents(docs.unionByName(docs)).collect()
    assert sorted((r.doc_id, r.ids, r.decoded) for r in rows) == sorted(2 * [(r.doc_id, r.n, r.back) for r in got])
    assert docs.limit(0).select(coder.encode(F.col("text"))).count() == 0 == coder.documents(docs.limit(0)).count()


def test_short_and_long_words_merge_alike():
    coder = bpe.WordCoder(bpe.read_text(vocabulary()))
    pick = random.Random(3)
    for _ in range(300):
        word = "".join(pick.choice("ethainorsd") for _ in range(pick.randint(1, 90)))
        assert bpe.merged(word, "</w>", coder.ranks) == bpe.merged_long(word, "</w>", coder.ranks)
