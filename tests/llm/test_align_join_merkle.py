"""Alignment, n-gram join and Merkle manifest against plain versions."""

import bisect
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timepoint.llm import align, merkle, ngram_join
from timepoint.llm.bpe import byte_letters
from timepoint.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
ODD_TEXTS = [
    None, "", " ", "   \n", "one", " a  b ", "tail ", "x \n y\t\tz", "é" * 30, "a " * 3000, "x" * 5000, "\x00\x1f \x85nbsp\xa0  w",
    "<|endoftext|> <s> </s> <0x41>", "▁x ▁▁ y", "日本語 テキスト 😀 👩‍👩‍👧 é", "İıſK ΑΣ don't we'LL", "12 345  6789 $%&", "a\x1c b\x1d  c",
]


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or ""), "clash") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, `Row` string")


# Alignment


def plain_alignment(texts):
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    of = {c: i for i, c in enumerate(byte_letters())}

    def bytes_b(i):
        m = re.fullmatch("<0x(..)>", b.id_to_piece(i))
        return bytes([int(m[1], 16)]) if m else b.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, parts):
        ends = list(itertools.accumulate(map(len, parts)))
        return [(e - len(p), e, i) for e, p, i in zip(ends, parts, ids)]

    rows, held, df = [], [], collections.Counter()
    for text in texts:
        x = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        px, py = [bytes(of[c] for c in a.id_to_token(i)) for i in x], [bytes_b(i) for i in y]
        if not text or b"".join(px) != f" {text}".encode() or b"".join(py) != f" {text}".encode():
            rows.append((0, 0, 0, 0, ""))
            held.append([])
            continue
        sx, sy, links, first = spans(x, px), spans(y, py), [], 0
        for s, e, i in sx:
            while sy[first][1] <= s:
                first += 1
            links += [(i, k) for p, _, k in itertools.takewhile(lambda t: t[0] < e, itertools.islice(sy, first, None))]
        cuts = sorted({e for _, e, _ in sx} & {e for _, e, _ in sy})
        sides = [[[] for _ in cuts] for _ in range(2)]
        for side, out in zip((sx, sy), sides):
            for _, e, i in side:
                out[bisect.bisect_left(cuts, e)].append(i)
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in zip(*sides))
        rows.append((len(x), len(y), len(cuts), len(links), hashlib.sha256(said.encode()).hexdigest()))
        held.append(links)
        df.update(set(links))
    high = collections.Counter()
    for (i, _), n in df.items():
        high[i] = max(high[i], n)
    return [(*r[:4], sum(df[k] == high[k[0]] for k in ks), sum(df[k] for k in ks), r[4]) for r, ks in zip(rows, held)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("sent", [align.SENT_PAIRS, 0])
def test_alignment_of_odd_texts(spark, sent):
    texts = [*ODD_TEXTS, *ODD_TEXTS[:6], "the one and only " * 5]
    got = align.align(spark, documents(spark, texts), *PATHS, sent_pairs=sent).orderBy("doc_id").select(*COLUMNS).collect()
    assert list(map(tuple, got)) == plain_alignment(texts)


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = QUERIES["op11_alignment"](spark, SF).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in docs]
    assert [tuple(r[c] for c in COLUMNS) for r in got] == plain_alignment([r.text for r in docs])


def test_parts_are_encoded_as_in_the_whole_text():
    with open(PATHS[1], "rb") as f:
        pair = align.TokenPair(open(PATHS[0], encoding="utf-8").read(), f.read())
    assert pair.by_parts
    pick, letters = random.Random(5), ["a", "The", "é", " ", "  ", "\n", " \t", "日", "'s", "9", "▁", "\x1c", "\xa0", "ß", ".", "😀", "ǅ", "́"]
    texts = ["".join(pick.choices(letters, k=pick.randint(1, 40))) for _ in range(1500)]
    whole_a = [e.ids for e in pair.tokenizer.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
    for t, (n_a, n_b, _, _, groups, _, _), x, y in zip(texts, pair.batch(texts), whole_a, pair.model.encode(texts)):
        if pair.a.bytes_of(x) == pair.b.bytes_of(y) == f" {t}".encode():
            sides = [g.split("|") for g in groups.split(";")]
            assert [",".join(s) for s in zip(*sides)] == [",".join(map(str, x)), ",".join(map(str, y))], t
            assert (n_a, n_b) == (len(x), len(y))
        else:
            assert groups is None, t


def test_parts_outlive_a_full_memory(monkeypatch):
    """Frequent parts are not encoded anew when the memory turns over, and what a batch asks for is all there."""
    monkeypatch.setattr(align, "REMEMBERED", 3)
    with open(PATHS[1], "rb") as f:
        pair = align.TokenPair(open(PATHS[0], encoding="utf-8").read(), f.read())
    first = dict(pair.learn({"the", "and", "of", "bus", ""}))
    assert pair.learn({"the", "school", ""})["the"] is first["the"]
    assert pair.learn({"stop", "tram"}).keys() >= {"stop", "tram"}
    got = pair.learn({"the", "line", "of"})
    assert got["the"] is first["the"] and got["of"] == first["of"]
    assert len(pair.parts) + len(pair.last_parts) <= 12


def test_tokens_that_do_not_spell_their_text_are_told_one_by_one():
    side = align.Side([b" a", b"b", b"", b" "])
    assert side.spell([[0, 1], [3], []], [b" ab", b" ", b""]) == [True, True, True]
    assert side.spell([[0, 1], [0]], [b" a", b"b a"]) == [False, False]
    assert side.spell([[0], [0, 1], [2]], [b" a", b" ac", b""]) == [True, False, True]


def test_alignment_of_an_empty_table(spark):
    for sent in (0, 5):
        assert align.align(spark, documents(spark, []), *PATHS, sent_pairs=sent).count() == 0


# N-gram join


def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset())
    return out


def plain_join(texts, ids):
    sets = plain_sets(texts)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = set()
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * len(sets[i] | sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
            if sets[i] != sets[j]:
                links.add(frozenset((sets[i], sets[j])))
    least = {}
    for i, d in enumerate(ids):
        old = least.get(root(i))
        least[root(i)] = old if d is None else d if old is None else min(d, old)
    return sorted(((d, len(sets[i]), least[root(i)]) for i, d in enumerate(ids)), key=str), links


def clusters(seed, passage=60):
    """Near copies in chains and stars, boilerplate shared by all, short texts, repeated texts."""
    pick = random.Random(seed)
    word = lambda: f"w{pick.randrange(4000)}"
    shared = [word() for _ in range(passage)]
    texts = []
    for _ in range(6):
        base = [word() for _ in range(pick.choice([12, 40, 90, 200]))]
        if pick.random() < 0.7:
            base = shared + base
        for _ in range(25):
            own = list(base)
            for _ in range(pick.choice([0, 1, 1, 2, 4])):
                own[pick.randrange(len(own))] = word()
            if pick.random() < 0.3:
                base = own
            texts.append(" ".join(own))
    texts += [" ".join(shared[: pick.randint(3, passage)]) for _ in range(30)]
    texts += [f"{t}." for t in ("a b c", "a b c d e f g h i", "a b c d e f g h i j")] + texts[:9]
    return texts


@pytest.mark.parametrize("frequent", [1, 6, 128])
def test_near_duplicates_of_clusters(spark, frequent, monkeypatch):
    monkeypatch.setattr(ngram_join, "STEP", 3)
    texts = [*ODD_TEXTS, *clusters(frequent)]
    ids = [None, None, *range(5, len(texts) + 3)]
    ids[-1] = ids[-2]
    want, links = plain_join(texts, ids)
    docs = documents(spark, texts, ids)
    got = ngram_join.near_duplicates(docs, frequent=frequent)
    assert sorted(map(tuple, got.collect()), key=str) == want
    pairs, of = ngram_join.similar_pairs(docs, frequent=frequent)
    by_id = {r.sid: r for r in of.collect()}
    assert len({r.sid for r in of.collect()} - {None}) == len(set(plain_sets(texts)) - {frozenset()}) and by_id
    found = [frozenset((r.u, r.v)) for r in pairs.collect()]
    assert len(found) == len(set(found)) == len(links)


def test_blocks_of_an_entry(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    texts = clusters(77, passage=150)
    want, _ = plain_join(texts, range(len(texts)))
    assert sorted(map(tuple, ngram_join.near_duplicates(documents(spark, texts), frequent=2).collect()), key=str) == want


@pytest.mark.parametrize("number", [40, 120])
def test_each_text_proposes_two_whatever_the_blocks(spark, monkeypatch, number):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    ids = [hashlib.md5(str(k).encode()).digest() for k in range(number)]
    rows = [(1, x, 50, x, bytes(8 * ngram_join.PARITY), None, ids[0], number) for x in ids]
    schema = "sig bigint, sid binary, n int, root binary, parity binary, wide binary, largest binary, own bigint"
    texts = spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows], schema)
    found = ngram_join.proposals(texts, 85).collect()
    of = collections.Counter(bytes(r.sid) for r in found)
    assert set(of) == set(ids[1:]) and max(of.values()) <= 2
    assert all(r.cut and r.sid != r.other for r in found)


def test_links_that_parity_maps_do_not_show(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "LONG", 300)
    sets_of, links_between, called = ngram_join.sets_of, ngram_join.links_between, []
    blank = lambda rows, wanted: sets_of(rows, wanted).withColumn("parity", F.lit(bytes(8 * ngram_join.PARITY)))
    monkeypatch.setattr(ngram_join, "sets_of", blank)
    monkeypatch.setattr(ngram_join, "links_between", lambda *args: called.append(1) or links_between(*args))
    texts = clusters(77, passage=150)
    want, _ = plain_join(texts, range(len(texts)))
    assert sorted(map(tuple, ngram_join.near_duplicates(documents(spark, texts), frequent=2).collect()), key=str) == want
    assert called


def test_groups_leave_enough_to_give():
    for threshold in (60, 80, 85, 90, 95):
        for n in range(ngram_join.least_size(threshold), 3000):
            low, high = ngram_join.least_overlap(n, threshold), 100 * n // threshold
            for power in range(low.bit_length() - 1, high.bit_length()):
                second, third = ngram_join.group_numbers(power, threshold)
                assert n - second - 2 * third >= n - ngram_join.least_overlap(n, threshold) + 1, (threshold, n, power)


def test_levels_and_classes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", 30)
    texts = ["same words in all of these", *[f"same words in all of these {i}" for i in range(60)], "its own words are here", "its own words are there"]
    known = ngram_join.frequencies(documents(spark, texts).select("text"), 4, frequent=2)
    found = [ngram_join.tokens(t) for t in texts]
    number = collections.Counter(t for f in found for t in f.tolist())
    for f in found:
        for t, level, kind in zip(f.tolist(), *known.of(f)):
            if t & 1:
                assert (level > 0) == (number[t] > 1) and (kind > 1) == (number[t] > known.frequent)
            else:
                assert level == 255 and kind == 2


def test_parity_maps_bound_the_difference():
    pick = np.random.default_rng(3)
    for n in (1, 30, 3000):
        a, b = (np.unique(pick.integers(0, 4000, n, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        bits = [np.frombuffer(ngram_join.parity(x), np.uint64) for x in (a, b)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))


def test_join_of_an_empty_table(spark):
    assert ngram_join.near_duplicates(documents(spark, [])).count() == 0
    assert ngram_join.near_duplicates(documents(spark, [None, "", "alone"])).count() == 3


def test_join_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want, _ = plain_join([r.text for r in docs], [r.doc_id for r in docs])
    assert sorted(map(tuple, QUERIES["op12_ngram_join"](spark, SF).collect()), key=str) == want


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way(levels, i):
    for level in levels[:-1]:
        s = i // 16 * 16
        yield i - s, level[s : s + 16][: i - s] + level[s : s + 16][i - s + 1 :]
        i //= 16


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 4095, 4096])
def test_blocks(n):
    leaves = [H(str(i)) for i in range(n)]
    want = plain_levels(leaves)
    for levels in {len(want) - 1, merkle.LEVELS}:
        top = want[-1][0]
        for _ in range(levels - len(want) + 1):
            top = H(top)
        nodes = merkle.build(bytes.fromhex("".join(leaves)), levels)
        assert nodes[: merkle.DIGEST].hex() == top
        for leaf, proof in zip(leaves, merkle.siblings(nodes, n, levels)):
            assert merkle.fold(bytes.fromhex(leaf), proof).hex() == top and len(proof) == levels


def test_layout_has_one_place_for_each_node():
    for depths in range(1, 5):
        places = np.concatenate([merkle.address(depths, d, np.arange(16**d)) for d in range(depths)])
        assert sorted(places.tolist()) == list(range(merkle.size(depths)))
    # The upper half first, then one lower subtree after another, each in one run.
    assert merkle.address(4, 1, np.arange(16)).tolist() == list(range(1, 17))
    assert merkle.address(4, 3, np.arange(16)).tolist() == list(range(18, 34))


def test_manifest_of_many_tiers(spark, monkeypatch):
    """Blocks of 16 leaves, so that a hot group has three tiers; nulls, repeated rows and an empty name."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    groups = ["hot"] * 700 + [None] * 3 + [""] + [f"s{i}" for i in range(40)] + ["é"] * 17
    ids = [*range(len(groups) - 4), 5, 5, None, None]
    rows = [(i, g, None if i == 7 else f"t{i}") for i, g in zip(ids, groups)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumn("rank", F.lit("clash")).repartition(7)
    got = merkle.audit(docs, ["doc_id", "source", "text"], tampered=F.lit(False)).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = collections.defaultdict(list)
    for i, g, t in rows:
        leaves[g].append((i is not None, i or 0, H(field(i), field(g), field(t))))
    names = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([x[2] for x in sorted(leaves[g])]) for g in names}
    top = plain_levels([trees[g][-1][0] for g in names])
    want = []
    for k, g in enumerate(names):
        for i, (there, d, leaf) in enumerate(sorted(leaves[g])):
            others = [x for _, run in [*way(trees[g], i), *way(top, k)] for x in run]
            want.append((d if there else None, leaf, trees[g][-1][0], top[-1][0], H(*others), top[-1][0], True))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_tampering_shows_where_letters_change(spark):
    docs = documents(spark, ["Upper", "lower", None, "É"])
    got = merkle.audit(docs, ["doc_id", "source", "lang", "n_chars", "text"], tampered=F.lit(True)).orderBy("doc_id").collect()
    assert [r.verified for r in got] == [False, True, True, True]
    assert len({r.root for r in got}) == 1 and got[0].folded_root != got[0].root


def test_manifest_of_an_empty_table(spark):
    assert merkle.audit(documents(spark, []), ["doc_id", "source", "text"], tampered=F.lit(True)).count() == 0
