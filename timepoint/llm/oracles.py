"""SQL twins of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from timepoint.llm import quality

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a text with A-Z in lower case, as the scans take them.
_PLAIN = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BITS = "".join(f"{i:04b}" for i in range(16))
_BASE32 = f"{_UPPER}234567"


def _five(i: str) -> str:
    """Number of the i-th group of five bits."""
    return " + ".join(f"CAST(substr(bits, 5 * {i} + {k + 1}, 1) AS INT) * {16 >> k}" for k in range(5))


OP2 = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda j:
    substr('{_BITS}', 4 * (instr('0123456789abcdef', substr(h, j, 1)) - 1) + 1, 4)), '') AS bits FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + {_five('i')}, 1)), '') AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM b
"""


def _js(counts: str, total: str, reference: str, bins: int) -> str:
    """Jensen-Shannon distance of a list of counts from a list of summed counts."""

    def part(a: str, b: str) -> str:
        return f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"

    terms = []
    for i in range(1, bins + 1):
        p = f"({counts}[{i}]::DOUBLE / {total})"
        q = f"({reference}[{i}]::DOUBLE / list_sum({reference}))"
        terms.append(f"({part(p, q)} + {part(q, p)}) / 2")
    return f"CASE WHEN {total} > 0 AND list_sum({reference}) > 0 THEN sqrt(greatest(0::DOUBLE, {' + '.join(terms)})) END"


_SPACE = r"\x20\x09-\x0D"
_MARKS = quality.CLASSES[3].replace("'", "''")
_KNOWN = ", ".join(f"CAST(length(regexp_replace(t, '[^{c}]', '', 'g')) AS BIGINT)" for c in (*quality.CLASSES[:3], _MARKS))
_COMMON = " ".join(
    f"WHEN lang = '{name}' THEN [{', '.join(f'''len(list_filter(ws, lambda w: w = '{w}'))''' for w in words)}]"
    for name, words in quality.COMMON_WORDS.items()
)
_LANGS = ", ".join(f"'{name}'" for name in quality.COMMON_WORDS)
_SUMS = ", ".join(f"coalesce(sum(classes[{i}]::DOUBLE / nullif(list_sum(classes), 0)), 0)" for i in range(1, 6))
_COMMON_SUMS = ", ".join(f"coalesce(sum(common[{i}]::DOUBLE / nullif(list_sum(common), 0)), 0)" for i in range(1, 14))
_NONE = f"[{'0, ' * 12}1]"

OP3 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS ws FROM documents
), g AS (
  SELECT rid, pos, ws[pos:pos + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS pos FROM d)
), rep AS (
  SELECT rid, count(DISTINCT pos + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g), range(3) AS r(k)
  WHERE c > 1 GROUP BY rid
), s AS (
  SELECT d.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines,
         coalesce(rep.n, 0) AS n_repeat_words, [{_KNOWN}] AS known, CASE {_COMMON} END AS words
  FROM d LEFT JOIN rep USING (rid)
), h AS (
  SELECT *, list_append(known, word_chars - list_sum(known)) AS classes, list_append(words, n_words - list_sum(words)) AS common,
         n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
), every AS (
  SELECT [{_SUMS}] AS classes FROM h WHERE NOT base_failed
), own AS (
  SELECT lang, [{_SUMS}] AS classes, [{_COMMON_SUMS}] AS common FROM h WHERE lang IN ({_LANGS}) AND NOT base_failed GROUP BY lang
), m AS (
  SELECT h.*, coalesce(own.classes, every.classes) AS rc, own.common AS rw
  FROM h CROSS JOIN every LEFT JOIN own ON h.lang = own.lang
), j AS (
  SELECT *, known[1] AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CASE WHEN word_chars >= {quality.GUARD_CHARS} THEN {_js('classes', 'word_chars', 'rc', 5)} END AS class_distance,
         CASE WHEN n_words >= {quality.GUARD_WORDS} THEN {_js('common', 'n_words', 'rw', 13)} END AS common_distance,
         {_js(_NONE, '1', 'rw', 13)} AS reach
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(class_distance, 6) AS class_distance, round(common_distance, 6) AS common_distance,
       NOT base_failed AND coalesce(class_distance, 0) <= {quality.MAX_CLASSES}
         AND (common_distance IS NULL OR common_distance <= least({quality.MAX_COMMON} + {quality.SLACK} / sqrt(n_words), {quality.REACH} * reach)) AS kept
FROM j
"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN} AS ws FROM documents),
it AS (SELECT item_id, {_PLAIN} AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM (
    SELECT item_id, ws, least(10, len(ws)) AS k, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM it WHERE len(ws) > 0)
), dw AS (
  SELECT rid, k, p, array_to_string(ws[p:p + k - 1], ' ') AS w FROM (
    SELECT rid, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM iw))
), hit AS (
  SELECT rid, p, dw.k AS k, item_id FROM dw JOIN iw ON dw.w = iw.w AND dw.k = iw.k
), n AS (
  SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + k - 1)) AS pos FROM hit) GROUP BY rid
), ids AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS listed
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN ids USING (rid)
"""


def _marked(text: str, signs: str) -> str:
    """Length of a text with a code for each of the signs."""
    return f"length({text}) + length(regexp_replace({text}, '[^{signs}]', '', 'g'))"


OP7 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(8 + {_marked('text', chr(92) * 2 + '<' + chr(92) + '[')} + {_marked('role', chr(92) * 2 + '<' + chr(92) + '[' + chr(92) + 'n')}) AS BIGINT)
           AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes: the reflected polynomial, one byte after another."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    octets = f"list_transform(range(0, strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({octets}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


#: 16 to the power of so many levels is more than any table has.
_LEVELS = 8


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _tree(name: str, leaves: str) -> str:
    """Levels of trees (tree, i, d), all runs joined, up to the level where each tree has one node."""
    out = [f"{name}0 AS (SELECT tree, i, d, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(_LEVELS):
        out.append(f"{name}r{k} AS (SELECT tree, i // 16 AS i, any_value(n) AS n, string_agg(d, '' ORDER BY i) AS run FROM {name}{k} GROUP BY ALL)")
        out.append(
            f"{name}{k + 1} AS (SELECT tree, i, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS d, "
            f"CASE WHEN n = 1 THEN 1 ELSE (n + 15) // 16 END AS n FROM {name}r{k})"
        )
    return ", ".join(out)


def _climb(name: str, start: str, keep: str) -> str:
    """From a node (tree, i, f) the siblings on its way up as text, and what it folds to."""
    out, at = [], start
    for k in range(_LEVELS):
        out.append(
            f"{name}c{k} AS (SELECT {keep}, s.tree, s.i // 16 AS i, CASE WHEN r.n = 1 THEN way ELSE way || left(run, CAST(64 * (s.i % 16) AS INT)) || "
            f"substr(run, CAST(64 * (s.i % 16) AS INT) + 65) END AS way, CASE WHEN r.n = 1 THEN f ELSE sha256(left(run, CAST(64 * (s.i % 16) AS INT)) || f || "
            f"substr(run, CAST(64 * (s.i % 16) AS INT) + 65)) END AS f FROM {at} s JOIN {name}r{k} r ON s.tree = r.tree AND s.i // 16 = r.i)"
        )
        at = f"{name}c{k}"
    return ", ".join(out)


_LEAF = " || ".join(_field(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"

OP13 = f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_LEAF} || {_field('text')}) AS d,
         CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN sha256({_LEAF} || {_field(_LOWER)}) END AS claim FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM d
), {_tree('g', 'leaves')}, subroots AS (
  SELECT '' AS tree, tree AS name, d, row_number() OVER (ORDER BY tree) - 1 AS i FROM g{_LEVELS}
), {_tree('t', 'subroots')}, start AS (
  SELECT doc_id, d AS leaf, tree, i, '' AS way, coalesce(claim, d) AS f FROM leaves
), {_climb('g', 'start', 's.doc_id, s.leaf')}, up AS (
  SELECT c.doc_id, c.leaf, s.d AS subroot, s.tree, s.i, c.way, c.f FROM gc{_LEVELS - 1} c JOIN subroots s ON s.name = c.tree
), {_climb('t', 'up', 's.doc_id, s.leaf, s.subroot')}
SELECT doc_id, leaf, subroot, r.d AS root, sha256(way) AS proof_sha256, f AS folded_root, f = r.d AS verified
FROM tc{_LEVELS - 1} c, t{_LEVELS} r
"""

ORACLES = {"op2_warc": OP2, "op3_quality": OP3, "op5_decontamination": OP5, "op7_chat": OP7, "op13_merkle": OP13}
