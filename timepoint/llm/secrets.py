"""Secret scans with automata inferred from labelled credentials.

Base rules find credentials of three kinds; what they find is labelled with its kind. For each kind a prefix tree of
labelled credentials (as sequences of character classes) is folded into a probabilistic automaton: states whose
stopping and outgoing frequencies are compatible by the Hoeffding bound are merged, with all that follows them
(state merging in the manner of ALERGIA), those of one depth first, so that a fixed length stays part of a format. Every token of a text that is as long as a labelled credential can be, words and
numbers too, is scored by the log-likelihood ratio, per character, of the best kind's automaton against a bigram model of
classes in ordinary tokens; both score where the token ends too. Candidates that reach a kind's ``threshold``, and ``EVIDENCE`` over all their characters, are
added as ``<kind>-like`` spans; below 16 characters it is the latter that decides.

The fit uses at most ``per_kind`` labelled credentials of each kind and ``ordinary`` tokens of some length (``PER_TEXT`` of a text,
and the first ``LONGEST`` characters of each), those of smallest hash over the whole table, so it depends neither on the
order of rows nor on the number of tasks. All texts are scanned whole.

Defined results: null and empty texts have no spans; no labelled credentials (or no tokens) mean no added spans; a
candidate within base spans is left out, one that reaches beyond them is scored whole and they stay; rows are never merged or dropped; extra columns stay in
``with_secrets`` and are not carried by ``find_secrets``.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timepoint.llm.common import column, released, written

KINDS = ("assign", "access", "hex")
PER_KIND = 2_000
ORDINARY = 20_000
ALPHA = 0.05
#: Least length of a labelled value, and of a candidate.
MIN_LENGTH = 6
THRESHOLD = 0.5
#: Least log-likelihood ratio of a whole token: in a few characters many words look like a credential.
EVIDENCE = 8.0
DEVIATIONS = 3.0
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
HEX = re.compile(r"[0-9a-f]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_BYTES = bytes(ord("x") if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_TOKEN_BYTES = bytes(b if b < 128 and CANDIDATE.match(chr(b)) else 32 for b in range(256))
SPAN = "struct<kind: string, start: int, end: int>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_ORDER = {k: i for i, k in enumerate((*KINDS, *[f"{k}-like" for k in KINDS]))}
MARK = "[REDACTED]"
PER_TEXT = 8
ORDINARY_LENGTH = 6
LONGEST = 256
#: Sequences of classes whose kind a worker remembers at a time, and how long they are at most.
REMEMBERED = 100_000
REMEMBERED_LENGTH = 64
END = "$"
#: Classes of characters; what the smoothing adds to the count of each after a state, and to that of the stop.
LETTERS = 6
UNSEEN = (0.5, 0.05)
#: Least likelihood of a stop: what ends where hardly any labelled credential does has not their format.
LEAST_STOP = 0.001


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the listed order; leftmost and non-overlapping for each kind."""
    raw = text.encode()
    found: list[tuple[int, int, int]] = []
    # A pattern runs only over texts that hold what every match of it holds.
    low = raw.lower()
    if any(word in low for word in _WORDS):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_LENGTH]
    if b"AKIA" in raw:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in raw.translate(_HEX_BYTES):
        found += [(*m.span(), 2) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda f: (f[0], f[2]))]


def long_tokens(text: str, min_length: int) -> set[str]:
    """The distinct candidate tokens that are long enough."""
    return {t.decode() for t in text.encode().translate(_TOKEN_BYTES).split() if len(t) >= min_length}


def credentials(text: str) -> list[tuple[str, str]]:
    """The labelled credentials of a text: (kind, value)."""
    spans = base_spans(text)
    return [(k, ASSIGN.match(text, a)[2] if k == "assign" else text[a:b]) for a, b, k in spans]


def _class(c: str) -> str:
    return "d" if c.isdigit() else "h" if "a" <= c <= "f" else "l" if c.islower() else "H" if "A" <= c <= "F" else "L" if c.isupper() else "s"


_CLASSES = {i: _class(chr(i)) for i in range(128)}


def classes(value: str) -> str:
    """A letter for each character (of ASCII): digit, letters a-f and others in both cases, signs."""
    return value.translate(_CLASSES)


class Automaton:
    """A probabilistic automaton folded from the prefix tree of sequences.

    States of one depth are folded first, so that each depth pools what all labelled credentials show there; only then are
    states of different depths held against each other. A tree's deep states have a credential or two and would fit
    anything: folded at once, a format of fixed length became a loop of any length.
    """

    def __init__(self, sequences: list[str], alpha: float = ALPHA):
        self.out: list[Counter] = [Counter()]
        self.to: list[dict[str, int]] = [{}]
        for s in sequences:
            state = 0
            for c in s:
                self.out[state][c] += 1
                if c not in self.to[state]:
                    self.to[state][c] = len(self.out)
                    self.out.append(Counter())
                    self.to.append({})
                state = self.to[state][c]
            self.out[state][END] += 1
        self.alpha = alpha
        self.folded = list(range(len(self.out)))
        self.apart: set[tuple[int, int]] = set()
        self._fold()

    def _state(self, a: int) -> int:
        """The state that ``a`` was folded into."""
        while self.folded[a] != a:
            self.folded[a] = a = self.folded[self.folded[a]]
        return a

    def _differ(self, a: int, b: int) -> bool:
        """Whether any frequency of the two states differs by more than the bound."""
        n, m = self.out[a].total(), self.out[b].total()
        if not n or not m:
            return False
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(self.out[a][c] / n - self.out[b][c] / m) > bound for c in self.out[a].keys() | self.out[b].keys())

    def _compatible(self, red: int, blue: int) -> bool:
        """Whether the states, and what follows the same letters after both, are alike."""
        pairs, came = [(red, blue)], {(red, blue): None}
        while pairs:
            pair = pairs.pop()
            a, b = pair
            if a == b:
                continue
            if pair in self.apart or self._differ(a, b):
                while pair:  # so are all pairs that lead here
                    self.apart.add(pair)
                    pair = came[pair]
                return False
            for c in self.to[a].keys() & self.to[b].keys():
                after = self._state(self.to[a][c]), self._state(self.to[b][c])
                if after not in came:
                    came[after] = pair
                    pairs.append(after)
        return True

    def _merge(self, red: int, blue: int) -> None:
        """Fold blue into red, and what follows the same letter after both."""
        self.apart.clear()
        pairs = [(red, blue)]
        while pairs:
            a, b = map(self._state, pairs.pop())
            if a == b:
                continue
            self.folded[b] = a
            self.out[a] += self.out[b]
            for c, target in self.to[b].items():
                if c in self.to[a]:
                    pairs.append((self.to[a][c], target))
                else:
                    self.to[a][c] = target

    def _kept(self, states: list[int]) -> list[int]:
        """The states, those seen most first, without those that are compatible with one before, which join the nearest."""
        red: list[int] = []
        for blue in sorted(states, key=lambda q: -self.out[q].total()):
            if self._state(blue) != blue:
                continue
            red = [r for r in red if self._state(r) == r]
            near = [r for r in red if self._compatible(r, blue)]
            if near:
                self._merge(min(near, key=lambda r: self._distance(r, blue)), blue)
            else:
                red.append(blue)
        return [r for r in red if self._state(r) == r]

    def _distance(self, a: int, b: int) -> float:
        n, m = self.out[a].total() or 1, self.out[b].total() or 1
        return sum(abs(self.out[a][c] / n - self.out[b][c] / m) for c in self.out[a].keys() | self.out[b].keys())

    def _fold(self) -> None:
        layers, states = [0], [0]
        while layers:
            below = [self._state(q) for p in layers for _, q in sorted(self.to[p].items())]
            layers = self._kept(list(dict.fromkeys(below)))
            states += layers
        self.states = self._kept(states)
        for state in self.states:
            self.to[state] = {c: self._state(q) for c, q in self.to[state].items()}
        self.expected = {state: self._expected(state) for state in self.states}

    def _expected(self, state: int) -> tuple[float, float]:
        """Mean and variance of the log-likelihood of what comes after the state."""
        n = self.out[state].total()
        logs = [(k / n, self._log(state, c)) for c, k in self.out[state].items()]
        mean = sum(p * x for p, x in logs)
        return mean, sum(p * (x - mean) ** 2 for p, x in logs)

    def score(self, sequence: str) -> tuple[float, float]:
        """Log-likelihood of the characters and of the stop after them (none for a stop that is too unlikely), and by how many standard deviations it is above what
        the automaton expects on that path (at least one unit each). An unknown edge falls back to the start."""
        total = mean = variance = 0.0
        state = 0
        for c in (*sequence, END):
            total += self._log(state, c)
            mean += self.expected[state][0]
            variance += self.expected[state][1]
            before, state = state, self.to[state].get(c, 0)
        if self._log(before, END) < math.log(LEAST_STOP):
            return -math.inf, -math.inf
        return total, (total - mean) / math.sqrt(max(1.0, variance))

    def _log(self, state: int, c: str) -> float:
        out = self.out[state]
        return math.log((out[c] + UNSEEN[c == END]) / (out.total() + LETTERS * UNSEEN[0] + UNSEEN[1]))


class Bigrams:
    """Classes of ordinary tokens, each given the one before it."""

    def __init__(self, sequences: list[str]):
        self.after: dict[str, Counter] = defaultdict(Counter)
        for s in sequences:
            for a, b in zip(f"{END}{s}", f"{s}{END}"):
                self.after[a][b] += 1

    def score(self, sequence: str) -> float:
        total = 0.0
        for a, b in zip(f"{END}{sequence}", f"{sequence}{END}"):
            seen = self.after.get(a, Counter())
            total += math.log((seen[b] + 0.5) / (seen.total() + 4))
        return total


class Model:
    """Automata of the kinds and the model of ordinary tokens."""

    def __init__(self, labelled: list[tuple[str, str]], ordinary: list[str], threshold: float = THRESHOLD, alpha: float = ALPHA):
        by_kind: dict[str, list[str]] = defaultdict(list)
        for kind, value in sorted(labelled):
            by_kind[kind].append(classes(value))
        self.automata = {k: Automaton(v, alpha) for k, v in sorted(by_kind.items())}
        self.ordinary = Bigrams([classes(t) for t in ordinary])
        self.threshold = threshold
        self.remembered: dict[str, str | None] = {}

    def kind(self, token: str) -> str | None:
        """The kind whose format the token has most likely, if any: as likely as its path in the automaton, within a few
        deviations, and likelier than an ordinary token by the threshold, and by the least evidence as a whole."""
        sequence = classes(token)
        if len(sequence) > REMEMBERED_LENGTH:
            return self._kind(sequence)
        if sequence not in self.remembered:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            self.remembered[sequence] = self._kind(sequence)
        return self.remembered[sequence]

    def _kind(self, sequence: str) -> str | None:
        least = self.ordinary.score(sequence) + max(self.threshold * len(sequence), EVIDENCE)
        scored = [(*a.score(sequence), k) for k, a in self.automata.items()]
        fit = [(s, k) for s, above, k in scored if above >= -DEVIATIONS and s >= least]
        return max(fit)[1] if fit else None


def candidates(text: str, model: Model, min_length: int) -> list[tuple[int, int, str]]:
    """The tokens long enough that have a kind's format, with that kind."""
    kinds = {t: kind for t in long_tokens(text, min_length) if (kind := model.kind(t))}
    return [(*m.span(), kinds[m[0]]) for m in CANDIDATE.finditer(text) if m[0] in kinds] if kinds else []


def beyond(tokens: list[tuple[int, int, str]], spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those of the tokens that do not lie within the spans (by start)."""
    covered: list[list[int]] = []
    for a, b, _ in spans:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    starts = [a for a, _ in covered]
    free = []
    for a, b, kind in tokens:
        i = bisect.bisect_right(starts, a)  # the runs before i begin no later than the token
        if not i or covered[i - 1][1] < b:
            free.append((a, b, kind))
    return free


def all_spans(text: str | None, model: Model | None, min_length: int = MIN_LENGTH) -> list[tuple[int, int, str]]:
    """Base spans and added ones (``<kind>-like``) by start, then kind as listed; added kinds follow."""
    spans = base_spans(text) if text else []
    if not text or model is None:
        return spans
    added = [(a, b, f"{k}-like") for a, b, k in beyond(candidates(text, model, min_length), spans)]
    return sorted(spans + added, key=lambda s: (s[0], _ORDER[s[2]]))


def ordinary_tokens(text: str, min_length: int, most: int) -> list[str]:
    """Of the distinct long tokens that are in no base span, the ``most`` of smallest hash."""
    secret = " ".join(text[a:b] for a, b, _ in base_spans(text))
    tokens = [t for t in long_tokens(text, min_length) if t not in secret]
    return heapq.nsmallest(most, tokens, key=lambda t: (zlib.crc32(t.encode()), t))


def fit(
    docs: DataFrame, *, text: str = "text", per_kind: int = PER_KIND, ordinary: int = ORDINARY, **options
) -> Model | None:
    """The model of this table's credentials; None where there are none, or no ordinary tokens beside them."""

    @F.arrow_udf("array<struct<kind: string, value: string>>")
    def labelled(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            t = t.as_py() or ""
            found = dict.fromkeys(credentials(t)) | dict.fromkeys(("", x) for x in ordinary_tokens(t, ORDINARY_LENGTH, PER_TEXT))
            rows.append([{"kind": k, "value": v[:LONGEST]} for k, v in found])
        return released(pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))))

    found = written(docs.select(F.explode(labelled.asNondeterministic()(column(docs, text))).alias("f")).select("f.*").distinct(), "labelled")

    hashed = F.xxhash64("value")
    sizes = {r.kind: r["count"] for r in found.groupBy("kind").count().collect()}  # the kinds, and one

    def sample(kind: str, n: int) -> list[str]:
        """Those of smallest hash."""
        rows = found.where(F.col("kind") == kind)
        if sizes.get(kind, 0) > 4 * n:
            # About twice as many lie below this hash, so that tasks need not send n rows each.
            few = rows.where(hashed < int(2 * n / sizes[kind] * 2**64) - 2**63)
            rows = few if few.count() >= n else rows
        return [r.value for r in rows.orderBy(hashed, "value").limit(n).collect()]

    known = [(k, v) for k in KINDS for v in sample(k, per_kind)]
    plain = sample("", ordinary)
    return Model(known, plain, **options) if known and plain else None


def listed(spans: list[tuple[int, int, str]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for a, b, k in spans]


def cut(text: str, spans: list[tuple[int, int, str]], mark: str = MARK) -> str:
    """The text with each run of overlapping spans (by start) replaced by a mark."""
    kept, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            kept += [text[at:a], mark]
        at = max(at, b)
    return "".join([*kept, text[at:]])


def with_secrets(docs: DataFrame, into: str, *, text: str = "text", min_length: int = MIN_LENGTH, mark: str | None = None, **options) -> DataFrame:
    """The documents with ``spans`` (of ``SPAN``) and ``redacted`` in a struct, by a model fitted on the same table.

    ``redacted`` is the text with marks in place of the secrets; null where there are none, and without ``mark``.
    """
    model = fit(docs, text=text, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # states of a bounded sample

    @F.arrow_udf(f"struct<spans: array<{SPAN}>, redacted: string>")
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            t = t.as_py()
            spans = all_spans(t, sent.value, min_length)
            rows.append({"spans": listed(spans), "redacted": cut(t, spans, mark) if spans and mark is not None else None})
        return released(pa.array(rows, pa.struct([("spans", _SPANS), ("redacted", pa.string())])))

    return docs.withColumn(into, scan.asNondeterministic()(column(docs, text)))


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id and spans, an array of kind, start and end in code points, end exclusive."""
    rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
    return with_secrets(rows, "found", **options).select("doc_id", "found.spans")
