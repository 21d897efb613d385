"""Secret scan: fixed patterns, and automata inferred from the credentials they find.

Base spans are matches of three patterns (assignments, access keys, hex runs).
Their values, labelled by the pattern's kind, are the examples of a grammar
inference: a prefix tree over character classes whose states are merged where
a Hoeffding bound finds their symbol and stop frequencies compatible. Each kind
gets a probabilistic automaton. All other runs of ``LEAST`` credential
characters and more, the class and least length of the examples, are candidates
in every text and scored whole: log-likelihood of the best automaton, less that
of ordinary runs (a bigram model over the same classes), by character. Dots at a
run's edges end sentences and are not part of it.

The examples come from a bounded sample of documents (``fit_docs`` in number,
by hash of the id) and at most ``fit_values`` whole values of each kind, and
``FIT_ORDINARY`` ordinary runs, those with the smallest hashes; longer ones than
``FIT_LENGTH`` are no examples. All documents are scanned, and values of any
length scored.

Defined cases: null and empty texts have no spans (counts 0, empty strings);
very long texts are scanned whole; an empty table gives no rows; null ids are
kept; repeated rows give repeated rows; spans of one start stand in the order of
kinds; without any example only base spans are found; further columns, whatever
their names, are left out (or carried by ``redact``).
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, pick, scratch, stored

KINDS = ("assign", "access", "hex", "inferred")
FIT_DOCS = 20_000
FIT_VALUES = 300
FIT_ORDINARY = 10_000
FIT_LENGTH = 256
LEAST = 12
ALPHA = 0.05
MARGIN = 0.35  # nats by character over ordinary runs
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{{{LEAST - 2},}}[A-Za-z0-9+/_=-]")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) in code points, by start, then kind as listed.

    Hex runs and access keys of the asked lengths lie inside runs of the wider
    class, and a shorter access key holds no longer one, so both are searched
    with their lengths; an assignment is matched whole first, then dropped if
    its value is short, since a dropped match still uses up its characters.
    """
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    for run in _RUN.finditer(text):
        for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
            out += [(m.start(), m.end(), kind, m[0]) for m in pattern.finditer(text, run.start(), run.end())]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str]]:
    """Runs of credential characters that meet no base span."""
    taken = [(a, b) for a, b, _, _ in base]
    k = 0
    for m in _CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if not any(b > m.start() for a, b in itertools.takewhile(lambda s: s[0] < m.end(), itertools.islice(taken, k, None))):
            yield m.start(), m.end(), m[0]


def _classes() -> dict[int, str]:
    out = {}
    for name, chars in (("d", "0123456789"), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("H", "ABCDEF"), ("U", "GHIJKLMNOPQRSTUVWXYZ")):
        out |= {ord(c): name for c in chars}
    return out


_CLASSES = _classes()
ALPHABET = "dhlHU+/_.=-"


def symbols(value: str) -> str:
    return value.translate(_CLASSES)


class Automaton:
    """Deterministic probabilistic automaton: states merged out of a prefix tree."""

    def __init__(self, values: Iterable[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]  # symbol (or "" for the end) to times
        for v in values:
            s = 0
            for c in symbols(v):
                self.count[s][c] += 1
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                s = self.next[s][c]
            self.count[s][""] += 1
        self._root = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            n, m = sum(self.count[a].values()), sum(self.count[b].values())
            if not n or not m:
                continue
            bound = self._root * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for c in {*self.count[a], *self.count[b]}:
                if abs(self.count[a][c] / n - self.count[b][c] / m) > bound:
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a] if c in self.next[b]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            self.count[a].update(self.count[b])
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _infer(self) -> None:
        red = [0]
        while True:
            inside = set(red)
            edges = [(s, c, t) for s in red for c, t in self.next[s].items() if t not in inside]
            if not edges:
                break
            s, c, t = max(edges, key=lambda e: (sum(self.count[e[2]].values()), -e[2]))
            for r in red:
                if self._alike(r, t):
                    self.next[s][c] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
        self.states = len(red)
        number = {s: i for i, s in enumerate(red)}
        k = len(ALPHABET) + 1
        self.table = []
        for s in red:
            n = sum(self.count[s].values())
            logs = {c: math.log((self.count[s][c] + 0.1) / (n + 0.1 * k)) for c in (*ALPHABET, "")}
            self.table.append((logs, {c: number[t] for c, t in self.next[s].items()}))

    def score(self, marks: str) -> float:
        """Log-likelihood of a string of class symbols, by symbol (its end counts as one)."""
        total, s = 0.0, 0
        for c in marks:
            logs, to = self.table[s]
            total += logs[c]
            s = to.get(c, 0)
        return (total + self.table[s][0][""]) / (len(marks) + 1)


class Model:
    """The automata by kind, and the bigrams of ordinary runs."""

    def __init__(self, values: dict[str, list[str]], ordinary: list[str], alpha: float = ALPHA):
        self.automata = {k: Automaton(v, alpha) for k, v in sorted(values.items()) if v}
        pairs, single = Counter(), Counter()
        for v in ordinary:
            m = "^" + symbols(v) + "$"
            pairs.update(zip(m, m[1:]))
            single.update(m[:-1])
        k = len(ALPHABET) + 1
        self.plain = {(a, b): math.log((pairs[a, b] + 1) / (single[a] + k)) for a in "^" + ALPHABET for b in ALPHABET + "$"}

    def likely(self, value: str) -> float:
        """Format likelihood over ordinary runs, nats by character; minus infinity without examples."""
        return self._marked(symbols(value))

    @functools.lru_cache(maxsize=1 << 16)  # ordinary runs have few forms
    def _marked(self, marks: str) -> float:
        own = "^" + marks + "$"
        plain = sum(self.plain[p] for p in zip(own, own[1:])) / (len(marks) + 1)
        return max((a.score(marks) for a in self.automata.values()), default=-math.inf) - plain


def _sampled(docs: DataFrame, fit_docs: int) -> DataFrame:
    """About ``fit_docs`` documents by hash of the id; all if there are fewer."""
    m = max(1, docs.count() // max(1, fit_docs))
    return docs.where(F.pmod(F.xxhash64("id"), F.lit(m)) == 0)


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_values: int = FIT_VALUES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Automata from at most ``fit_values`` distinct values of each kind, against ordinary runs."""

    def values(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = set()
        for t in b.column(1).to_pylist():
            if t:
                base = base_spans(t)
                found.update((k, v) for _, _, k, v in base)
                found.update(("", v) for _, _, v in candidates(t, base))
        rows = sorted(x for x in found if len(x[1]) <= FIT_LENGTH)
        yield batch(pa.schema([("kind", pa.string()), ("value", pa.string())]), [r[0] for r in rows], [r[1] for r in rows])

    found = map_batches(_sampled(pick(docs, id_col, text_col).toDF("id", "text"), fit_docs), values, "kind string, value string").distinct()
    held: dict[str, list[str]] = {}
    with scratch(docs.sparkSession):
        found = stored(found, "values")  # read once for each kind
        for kind in ("", *KINDS[:3]):  # a bounded top-k each
            held[kind] = [r[0] for r in found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(fit_values if kind else FIT_ORDINARY).select("value").collect()]
    return Model({k: v for k, v in held.items() if k}, held[""])


def spans_of(text: str | None, model: Model | None, margin: float = MARGIN) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, in order."""
    if not text:
        return [], []
    found = base_spans(text)
    base = [(a, b, k) for a, b, k, _ in found]
    more = [(a, b, "inferred") for a, b, v in candidates(text, found) if model.likely(v) > margin] if model else []
    return base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2])))


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row for each document: counts by kind, all spans as structs, and the base spans' text form."""
    model = model or fit(docs, id_col=id_col, text_col=text_col)
    docs = pick(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit_values
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [spans_of(t, sent.value, margin) for t in b.column(1).to_pylist()]
        schema = pa.schema([b.schema.field(0), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("found", span)])
        yield batch(
            schema, b.column(0), *([sum(s[2] == k for s in every) for _, every in rows] for k in KINDS), [_listed(base) for base, _ in rows],
            [[{"kind": k, "start": s, "end": e} for s, e, k in every] for _, every in rows],
        )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_batches(docs, run, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, {counts}, base string, found array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, mark: str = "[secret]") -> DataFrame:
    """All columns of ``docs``, with every span of the text replaced by ``mark``."""
    model = model or fit(docs, id_col=id_col, text_col=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [masked(t, spans_of(t, sent.value, margin)[1], mark) for t in b.column(at).to_pylist()]
        cols = [*b.columns]
        cols[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return map_batches(docs, run, docs.schema)


def masked(text: str | None, spans: list[tuple[int, int, str]], mark: str) -> str | None:
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a >= end:
            out += [text[at:a] if at <= a else "", mark]
        at = end = max(end, b)
    return "".join([*out, text[at:]])

