"""Licences, WARC archives, HTML extraction, chat formatting and shards against plain versions."""

import base64
import bisect
import hashlib
import html as markup
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pyarrow.fs
import pytest
import zstandard
from pyspark.sql import functions as F

from timepoint.llm import chat, html, licenses, shard, warc
from timepoint.llm.queries import CONTROL, QUERIES
from timepoint.session import new_scratch

SF = "/root/testdata/sf0.001"


def documents(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def plain(plan):
    return not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().toString())


# Licences

BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_places(words):
    return sorted((i, label) for p, label in BASE.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p)


NOTICES = [
    None, "", "...", "CC BY", "cc cc by by cc-by", "general general public license", "All rights reserved. ALL RIGHTS RESERVED!",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0 (the License)",
    "apache license", "by cc", "rights reserved all", "all rights reserved " * 2000, "É all rights réserved", "Released under the MIT License.",
    "Permission is hereby granted, free of charge, to any person who obtains a copy of this software and associated documentation files",
    "licence of the version 2 0 under apache", "Licensed under CC BY-NC 4.0",
]


def test_licenses_query_against_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op1_licenses"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        check_license(d.text, got[d.doc_id])


def check_license(text, r):
    words = words_of(text)
    places = base_places(words)
    assert (r.n_words, r.n_base) == (len(words), len(places))
    assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
    assert r.base_labels == ",".join(sorted({label for _, label in places}))
    labels = [x for x in r.labels.split(",") if x]
    assert labels == sorted(set(labels)) and {label for _, label in places} <= set(labels) and 0 <= r.score <= 1


def test_licenses_of_odd_texts(spark, tmp_path):
    docs = documents(spark, NOTICES).withColumn("matches", F.lit(1))
    docs.drop("matches").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op1_licenses"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(NOTICES):
        check_license(text, got[i])
    labels = {i: got[i].labels for i in got}
    assert labels[7] == "gpl,gpl-3.0" and labels[8] == "apache-2.0" and labels[9] == "" and labels[14] == "mit" and labels[15] == "mit"
    assert labels[16] == "" and labels[17] == "cc-by,cc-by-nc-4.0"
    assert licenses.find_licenses(docs).count() == len(NOTICES) and licenses.find_licenses(docs.limit(0)).count() == 0


def plain_matches(index, words):
    """Labels and shares of the templates that stand anywhere, every start of every template compared."""
    found = set()
    for t in index.listed:
        whole = sum(index.idf[w] for w in t.words)
        for s in range(-len(t.words), len(words) + 1):
            near = lambda i: words[max(0, s + i - licenses.SLACK) : max(0, s + i + licenses.SLACK + 1)]  # noqa: B023, E731
            here = words[max(0, s - licenses.SLACK) : max(0, s + len(t.words) + licenses.SLACK)]
            if t.base:
                if s >= 0 and tuple(words[s : s + len(t.words)]) == t.words:
                    found.add((t.label, True, len(t.words), 1.0))
                continue
            share = sum(index.idf[w] for i, w in enumerate(t.words) if w in near(i)) / whole
            if share >= licenses.MIN_SHARE - 1e-9 and all(b" ".join(k) in b" ".join(here) for k in t.keys):
                found.add((t.label, False, len(t.words), round(share, 6)))
    return found


def test_no_start_is_missed_whichever_words_are_lost():
    """The index against every start of every template, on notices with words lost, put in and swapped."""
    listed, rng = licenses.templates(), random.Random(7)
    vocabulary = sorted({w for t in listed for w in t.words})
    df = {w: rng.choice((0, 1, 3, 30, 900)) for w in vocabulary}
    index, hits = licenses.Index(listed, df, 1000, licenses.MIN_RARE, licenses.MIN_SHARE), 0
    for _ in range(250):
        words = []
        for t in rng.choices(listed, k=rng.choice((1, 2, 3))):
            part = list(t.words)
            for _ in range(rng.choice((0, 1, 2, len(part) // 4))):
                i = rng.randrange(len(part)) if part else 0
                part[i : i + rng.choice((0, 1, 1))] = rng.choice(([], [rng.choice(vocabulary)], [b"other"]))
            words += part + rng.choices([*vocabulary, b"other"], k=rng.choice((0, 5, 30)))
        got, want = index.matches(words), plain_matches(index, words)
        assert {m[:2] for m in got} == {m[:2] for m in want}, words
        assert {(m[0], m[1], m[3], round(m[4], 6)) for m in got} <= want
        best = lambda ms, k: {(m[0], m[k]): max(x[-1] for x in ms if (x[0], x[k]) == (m[0], m[k])) for m in ms}
        assert {k: round(v, 6) for k, v in best(got, 3).items()} == best(want, 2), words
        hits += len(want)
    assert hits > 300


def test_licence_scan_of_a_long_run_of_notices_is_quick():
    index = licenses.Index(licenses.templates(), {}, 10, licenses.MIN_RARE, licenses.MIN_SHARE)
    for notice, n in (("mit license", 0), ("under the mit license", 50_000)):
        words, start = notice.encode().split() * 50_000, time.monotonic()
        assert len(index.matches(words)) == n and time.monotonic() - start < 15


# WARC

PAGES = [
    (3, "http://a/", "<p>x</p>"), (1, "http://b/\r\nX: y", "<p>x</p>"), (2, None, None), (7, "u", ""), (None, "n", "<p>x</p>"), (5, "é", "é" * 100_000),
    (1, "http://b/", "<p>x</p>"), (None, None, "only"), (None, "z", "only"), (9, "crlf", "\r\n\r\nWARC/1.1\r\n"),
]


def expected_pages(rows, least=0):
    by = defaultdict(list)
    for page_id, _, text in rows:
        by[text or ""].append(page_id)
    out = []
    for page_id, _, text in rows:
        raw = (text or "").encode()
        ids = [i for i in by[text or ""] if i is not None]
        first = min(ids) if ids and len(by[text or ""]) > 1 and len(raw) >= least else page_id
        kind = "response" if first == page_id else "revisit"
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, first if kind == "revisit" else None))
    return out


def some_order(rows):
    return sorted(rows, key=str)


def test_warc_query_against_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert some_order(map(tuple, QUERIES["op2_warc"](spark, SF).collect())) == some_order(expected_pages(rows))


@pytest.mark.parametrize(("frame", "bundle", "least"), [(1 << 20, 1 << 28, 0), (300, 500, 5)])
def test_warc_round_trip_of_odd_pages(spark, frame, bundle, least):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("key", F.lit(1)).withColumn("first", F.lit(1))
    folder = new_scratch(spark, "warc")
    index = warc.write_archive(pages, folder, frame=frame, bundle=bundle, min_revisit_bytes=least)
    got = warc.read_archive(index, folder).collect()
    assert some_order(tuple(r)[:5] for r in got) == some_order(expected_pages(PAGES, least))
    assert Counter(bytes(r.payload) for r in got if r.record_type == "response") <= Counter((h or "").encode() for _, _, h in PAGES)
    # Every bundle is a plain Zstandard stream of the frames in its seek table.
    system, path = warc.place(folder)
    total = 0
    for info in system.get_file_info(pyarrow.fs.FileSelector(path)):
        with system.open_input_file(info.path) as file:
            table = warc.seek_table(file)
            plain_bytes = b"".join(warc.read_frame(file, t) for t in table)
            with zstandard.ZstdDecompressor().stream_reader(file.read_at(table[-1][0] + table[-1][1], 0), read_across_frames=True) as stream:
                assert stream.read() == plain_bytes
        total += plain_bytes.count(b"WARC-Record-ID: ")
    assert total == len(PAGES)


def test_warc_without_pages(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = new_scratch(spark, "warc")
    assert warc.read_archive(warc.write_archive(none, folder), folder).count() == 0


def test_damaged_record_is_noticed():
    raw = warc.record(1, "u", b"payload", False, None)
    assert warc.parsed(raw)["payload"] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


# HTML


def article_text(page):
    """The article of the supplied pages, by cutting it out."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(markup.unescape(re.sub(r"<[^>]+>", " ", inner)).split())


def test_html_query_gives_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op6_html"](spark, SF).collect():
        assert (r.text, r.url, r.n_chars) == (article_text(pages[r.page_id].html), pages[r.page_id].url, len(r.text))


LOREM = "The words of this paragraph are here so that it is long enough to be taken for the content of a page, and that is all. " * 2
TEMPLATES = [
    ("<body class='has-sidebar'><div id='header'>Site name</div><div class='nav'><a href='/'>Home</a> <a>About</a></div><div id='content'><h1>Title</h1>"
     f"<p>{LOREM}</p><p>Short.</p><p>{LOREM}</p></div><div class='sidebar'><p>{LOREM}</p></div><div id='comments'><p>{LOREM}</p></div><footer>c</footer>",
     f"Title {LOREM}Short. {LOREM}"),
    (f"<main><header><h1>Title</h1></header><section><p>{LOREM}<aside>{LOREM}</aside><form>Mail <input> <button>Go</button></form><p>Yes.</section></main>"
     f"<section class='comment-list'>{LOREM}</section>", f"Title {LOREM}Yes."),
    (f"<article><p>a < b &amp;&lt;c&gt;&nbsp;d<!-- no --><script>if (a<b) x('</p>')</script> <b>e</b>f\n g</p><span class=ad>buy</span><p title=it's>{LOREM}</p>"
     "<footer>f</footer></article><p>tail</p>", f"a < b &<c> d ef g {LOREM}"),
    ("<html><head><title>t</title></head><body><nav><a>x</a></nav><footer>y</footer></body></html>", ""),
    ("just text", "just text"), ("", ""), (None, ""), ("<article><p>one<p>two</article>", "one two"), ("<p", ""), ("<!-- open <p>x</p>", ""),
    ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"), (f"<ul><li><a href=x>{LOREM}</a></li></ul><p>{LOREM}</p>", LOREM),
]


def test_html_of_other_templates(spark):
    rows = [(i, "u", page, "x") for i, (page, _) in enumerate(TEMPLATES)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract_pages(pages).collect()}
    for i, (_, want) in enumerate(TEMPLATES):
        assert got[i] == " ".join(want.split()), i
    assert html.extract_pages(pages.limit(0)).count() == 0


PAGE = f"<h1>Title</h1><article><p>{LOREM}</p><p>Short.</p><p>{LOREM}</p></article><div class='sidebar'><p>{LOREM}</p></div>"
REST = f"<nav><a href='/'>Home</a></nav>%s<footer>{LOREM}</footer>"
WRAPPED = [
    *[(REST % f"<div {name}>{PAGE}</div>", f"{LOREM}Short. {LOREM}")
      for name in ("id=page class=right-sidebar", "class=comments-open", "class='two-column-sidebar sticky-footer'", "role=search")],
    (REST % f"<form action='/'><div id=nav-wrapper><div class=a>{PAGE.replace('article', 'div')}</div></div></form>", f"Title {LOREM}Short. {LOREM}"),
    (f"<fieldset><div class=menu-open><main><p>Short.</p></main></div></fieldset><p>{LOREM}</p>", "Short."),
    ("<div class=no-ads><div class=sidebar><article>Short.</article></div></div>", "Short."),
    # What is beside the article stays out, however long and whatever elements it has.
    (f"<div id=content><p>{LOREM}</p></div><div class=sidebar><article>{LOREM}</article><article>{LOREM}</article></div>", LOREM),
    (f"<div id=content><p>{LOREM}</p></div><div class=related><p>{LOREM * 2}</p></div>", LOREM),
    (f"<p>{LOREM}</p><div id=comments><article>{LOREM * 9}</article></div>", LOREM),
    (f"<ul><li>One thing</li><li>{'Other things ' * 20}</li></ul><div class=cookie-notice><p>{LOREM[:150]}</p></div>", "One thing " + "Other things " * 20),
    (f"<div style='display: none'><main>{LOREM}</main></div><nav><article>{LOREM}</article></nav><aside><main>{LOREM}</main></aside>", ""),
]


@pytest.mark.parametrize(("page", "want"), WRAPPED)
def test_html_of_pages_in_marked_wrappers(page, want):
    assert html.main_text(page) == " ".join(want.split())


UNCLOSED = [
    *[(f"<div>{tag}Menu<article><p>{LOREM}</p></article></div>", LOREM)
      for tag in ("<button>", "<button class=a>", "<object data=x>", "<canvas>", "<svg><path d=x>", "<noscript>", "<template>")],
    (f"<ul><li><select><option>a<option>b</ul><p>{LOREM}</p><form><select><option>a</select></form>", LOREM),
    (f"<nav><button>Menu</nav><p>{LOREM}</p><button>Send</button>", LOREM),
    (f"<p><a href=x><button>Menu</a></p><p>{LOREM}</p>", LOREM),
    (f"<p>{LOREM}<math><mi>x</mi><mo>=</mo><semantics><mn>2</mn><annotation>x=2</annotation></semantics></math> so.</p>", f"{LOREM}x=2 so."),
    # Closed ones are left out with all they hold, and part no block.
    (f"<p>Is <button><div>one</div><p>two</p></button>it <select><option>a<option>b</select>so? <svg><title>t</title><text>x</text></svg>{LOREM}</p>",
     f"Is it so? {LOREM}"),
    (f"<article><p>{LOREM}</p><button><div>one</button> two</article>", f"{LOREM}two"),
    (f"<noscript><p>{LOREM}</p></noscript><template><article>{LOREM}</article></template><p>{LOREM}</p>", LOREM),
    (f"<p>{LOREM}</p><script>var a = '<p>'", LOREM), (f"<p>{LOREM}</p><textarea><p>{LOREM}</p>", LOREM),
]


@pytest.mark.parametrize("shape", [
    "<ul><li>" * 20_000 + "</span>" * 20_000, "<div>" * 20_000 + "</b>" * 20_000, "<b>" + "<div>" * 20_000 + "</b>" * 20_000,
    "<section><p>" * 20_000 + "</i></section>" * 20_000, "<div>" * 20_000 + "<li>x" * 20_000, "<button>" * 20_000 + "<p>x" * 20_000,
])
def test_html_in_linear_time(shape):
    start = time.process_time()
    html.main_text(f"<article><p>{'The end of the story is in the book. ' * 9}{shape}")
    assert time.process_time() - start < 3


def test_long_blocks_poor_in_stop_words_are_not_content_by_length():
    names = "Alpha Bravo Charlie Delta Echo Foxtrot Golf Hotel India Juliett Kilo Lima Mike " * 4
    prose = "It was the best of the times and it was the worst of the times, as they say in the book that is on the table. " * 2
    assert html.by_text(html.Block(None, text=prose)) is True and html.by_text(html.Block(None, text=names)) is None
    menu = f"<div><a href=a>One</a></div><div><a href=b>Two</a></div><div>{names}</div><div><a href=c>Three</a></div>"
    page = f"<html><body><table><tr><td>{menu}</td><td><p>{prose}</p><p>{names}</p><p>{prose}</p></td></tr></table></body></html>"
    assert html.main_text(page) == " ".join(f"{prose} {names} {prose}".split())


@pytest.mark.parametrize(("page", "want"), UNCLOSED)
def test_html_of_elements_that_are_left_out(page, want):
    assert html.main_text(page) == " ".join(want.split())


# Chat


def expected_chats(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha(said), len(loss), sha(loss)))
    return some_order(out)


def test_chat_query_against_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)]
    df = QUERIES["op7_chat"](spark, SF)
    assert some_order(tuple(r)[:5] for r in df.collect()) == expected_chats(rows) and plain(df)


TURNS = [
    (1, 0, "user", "\\1 \\0 < [ \\\\"), (1, 1, "assistant", "</s><s>user\nno"), (1, 1, "assistant", "</s><s>user\nno"), (1, None, "assistant", None),
    (2, 5, None, "a\n\nb"), (2, 3, "sys\ntem", "[/INST]"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (4, 0, "assistant", ""),
    *[(9, i, "assistant" if i % 2 else "user", f"turn {i} " * 5) for i in range(70)],
]


def test_chat_of_odd_turns(spark, tmp_path):
    turns = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").withColumn("tree", F.lit(1)).withColumn("score", F.lit("s"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op7_chat"](spark, str(tmp_path)).collect()
    assert some_order(tuple(r)[:5] for r in got) == expected_chats([*TURNS, (-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)])
    assert chat.conversations(chat.messages_of_turns(turns.limit(0))).count() == 0


def test_every_branch_is_a_conversation(spark):
    pick = random.Random(5)
    rows, parents = [("t", 0, None, "user", "m0", 0.0)], {0: None}
    for i in range(1, 60):
        parents[i] = pick.choice([p for p in parents if p < i])
        rows.append(("t", i, parents[i], "assistant" if i % 2 else "user", f"m{i}", float(pick.randint(0, 3))))
    rows += [("u", 1, 2, "user", "loop", 1.0), ("u", 2, 1, "user", "loop", 1.0), ("u", 3, 2, "user", "off a loop", 1.0), ("v", 8, 99, "user", "orphan", 1.0), rows[5]]
    messages = spark.createDataFrame(rows, "tree string, message bigint, parent bigint, role string, text string, score double")
    score = {r[1]: r[5] for r in rows if r[0] == "t"}
    want = {}
    for leaf in set(parents) - set(parents.values()):
        path = [leaf]
        while parents[path[-1]] is not None:
            path.append(parents[path[-1]])
        want[leaf] = [f"m{m}" for m in reversed(path)], sum(score[m] for m in path)
    got = chat.conversations(messages)
    read = got.withColumn("turns", chat.read_turns(F.col("formatted"))).where("tree = 't'").collect()
    assert {r.leaf: [t.text for t in r.turns] for r in read} == {k: v[0] for k, v in want.items()}
    assert [r.leaf for r in sorted(read, key=lambda r: r["rank"])] == sorted(want, key=lambda k: (-want[k][1], k))
    assert {(r.tree, r.leaf) for r in got.where("tree <> 't'").collect()} == {("v", 8)}
    best = chat.conversations(messages, per_tree=2).where("tree = 't'").collect()
    assert {r.leaf for r in best} == {r.leaf for r in read if r["rank"] <= 2}


# Shards


def check_shards(got, rows, n=8, slack=None):
    assert some_order((r[0], r[1], r[2]) for r in got) == some_order(rows)
    by, total = defaultdict(list), sum(r[1] for r in rows)
    for r in got:
        by[r[4]].append(r)
    for s, members in by.items():
        assert 0 <= s < n and sorted(r[5] for r in members) == list(range(len(members)))
    largest = max((r[1] for r in rows), default=0)
    for s in range(n):
        assert abs(sum(r[1] for r in by[s]) - total / n) <= largest + (slack or 0.001 * total / n)


def sized(text):
    raw = (text or "").encode()
    return len(raw) + 1, zlib.crc32(raw)


def test_sharding_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, *sized(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = QUERIES["op10_sharding"](spark, sf)
    got = [tuple(r) for r in df.collect()]
    check_shards(got, rows)
    assert {(r[3], r[6]) for r in got} == {("bytes", None)} and plain(df)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    shards = defaultdict(set)
    for r in got:
        shards[texts[r[0]]].add(r[4])
    assert sum(len(s) > 1 for s in shards.values()) <= 7  # only a splitter parts equal texts


@pytest.mark.parametrize("texts", [
    [], ["a"], [None] * 50, ["same"] * 400, ["x" * 50_000, *map(str, range(300)), None, "", "é"], [f"t{i % 3}" for i in range(300)],
])
def test_sharding_of_odd_tables(spark, tmp_path, texts):
    docs = documents(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 7))
    docs.withColumn("sort_key", F.lit(1)).withColumn("size", F.lit("mine")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, *sized(r.text)) for r in docs.collect()]
    check_shards([tuple(r) for r in QUERIES["op10_sharding"](spark, str(tmp_path)).collect()], rows)


def test_few_passes_and_pieces_bounded_in_rows(spark, monkeypatch):
    """A heavy text, a text repeated very often and a third of null texts: at most 6 passes, no piece with a mass of rows."""
    texts = ["x" * 400_000, *["again and again"] * 3000, *[f"text number {i} " * 9 for i in range(3000)], *[None] * 3000]
    rows = documents(spark, texts).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.octet_length("text").alias("n"))
    passes, found = [], []
    real, probed = shard.piece_of, shard.common_start
    monkeypatch.setattr(shard, "piece_of", lambda key, cuts, first=0: (found.append(cuts) if not found else None) or real(key, cuts, first))
    monkeypatch.setattr(shard, "common_start", lambda a, b: passes.append(1) or probed(a, b))
    group = type(rows).groupBy
    probes = []
    monkeypatch.setattr(type(rows), "groupBy", lambda self, *c: (probes.append(1) if "probe" in str(c) else None) or group(self, *c))
    key = F.concat(shard.hex_key(F.col("h")), shard.hex_key(F.col("doc_id")))
    got = shard.histogram_sort(rows, key, F.coalesce("n", F.lit(0)) + 1, 8).select("doc_id", "n", "shard", "slot").collect()
    assert 2 <= len(probes) <= 6
    keys = sorted(r[0] for r in rows.select(key).collect())
    ends = [bisect.bisect_left(keys, c) for c in found[0]]
    assert max(b - a for a, b in zip([0, *ends], [*ends, len(keys)])) <= 2 * len(keys) / 128
    check_shards([(r.doc_id, (r.n or 0) + 1, 0, "bytes", r.shard, r.slot, None) for r in got], [(i, len(t or "") + 1, 0) for i, t in enumerate(texts)])


def test_archive_is_read_by_several_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"{i} " * 200) for i in range(400)], "page_id bigint, url string, html string")
    index = warc.write_archive(pages, str(tmp_path / "a"), frame=4096)
    read = warc.read_archive(index, str(tmp_path / "a"), read_bytes=1 << 16)
    assert read.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 2
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in read.collect()) == [(i, f"{i} " * 200) for i in range(400)]


def test_histogram_sort_keeps_columns_and_order(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 10).alias("sort_key"), F.lit(1).alias("sort_piece"))
    got = shard.histogram_sort(rows, shard.hex_key(F.col("id")), F.lit(1), 4, shard="part", slot="at", pieces=3).collect()
    assert [(r.id, r.sort_key) for r in sorted(got, key=lambda r: (r.part, r["at"]))] == [(i, i % 10) for i in range(1000)]
