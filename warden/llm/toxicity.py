"""Toxicity by a weighted grammar of finite-state transducers.

A text is cut into clauses at ``. ! ? ; :`` and line ends. The lexical transducer turns the
words of a clause into marks: insult (I), threat (T), target (Y), negation (N),
reported speech (R), or nothing. Clause transducers then run over the marks in
composition: negation and reported speech change the state in which an insult
or threat is read, for a few words; a target beside it aims it; a second bare
insult makes a pair. The document transducer reads the clauses in order and
accepts a clause with a bare insult only after another one: one word by itself,
in a clause or in a whole text, is no match. What is accepted is a set of
pattern classes (``PATTERNS``), each with a weight; a text's score is the
logistic of the weighted counts of its matches.

The lexicon is a hand-written one for four languages, and words, or beginnings
of words (of ``STEMS`` letters), that labelled texts show to be insults
(log-odds of document counts). The weights are fitted by logistic regression on
the pattern counts. Both use at most about ``fit_docs`` labelled documents (by
hash of the id) outside the held-out fold. Labels, languages, sources and ids
are never part of a score.

Defined cases: null and empty texts score as a text without a match; very long
texts are read whole, clause by clause; empty tables give no rows, and a grammar
with its prior weights; without labels the prior weights hold; of several labels
of one document the greatest counts; repeated rows give repeated rows with equal
scores, and count once for each row in a fit; a score at the threshold is toxic;
null ids are kept, and count as not held out; labels that are null are not used;
extra columns, whatever their names, are left out (or carried by ``reject``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, fold_of, map_batches, pick

FIT_DOCS = 10_000
MIN_DOCS = 3
MIN_ODDS = 3.0
MIN_GAIN = 8.0  # nats: what chance gives a few of a million parts
STEMS = (5, 7)  # letters of the learned beginnings of words
THRESHOLD = 0.7
REACH = 4  # words over which negation and reported speech hold

#: Hand-written marks, by language.
LEXICON = {
    "I": "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns fool jerk vermin filth imbecile "
    "idioten dummkopf abschaum dreck widerlich versager trottel nutzlos erbärmlich idiote imbécile ordure minable dégoûtant crétin nul "
    "idiota imbécil basura escoria asqueroso patético inútil estúpido payaso",
    "T": "kill hurt destroy beat punish shoot stab burn töten umbringen zerstören schlagen tuer détruire frapper brûler matar destruir golpear quemar",
    "Y": "you your yours he she they him them this these du dich dir ihr euch er sie tu toi vous vos il elle ils tú te usted ustedes él ella ellos",
    "N": "not never no isn't aren't nicht nie kein keine pas jamais aucun non no nunca jamás ningún",
    "R": "said says called wrote quoted claims claimed reported sagte schrieb nannte behauptet dit disait écrit appelé dijo escribió llamó dicen",
}
#: Pattern classes, with the weights before any fit.
PATTERNS = ("insult_pair", "insult_again", "insult_target", "insult_negated", "insult_reported", "threat_target", "threat_insult", "learned_pair", "learned_again", "learned_target")
PRIOR = (2.5, 2.0, 3.0, 0.8, 0.8, 1.5, 3.0, 2.5, 2.0, 3.0)
PRIOR_BIAS = -2.5
_CLAUSE = re.compile(r"[.!?;:\n\r]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")


def lexicon() -> dict[str, str]:
    """Word to mark; threats yield to insults, and so on in the order of the listing."""
    out: dict[str, str] = {}
    for mark in "ITYNR":
        for w in LEXICON[mark].split():
            out.setdefault(w, mark)
    return out


class Clause:
    """Reads marks with their word places; ``out`` has the pattern classes of the clause's matches, ``pending`` its bare insults."""

    def __init__(self) -> None:
        self.negated = self.reported = self.target = -REACH - 1
        self.pending: list[tuple[int, str]] = []  # matches that a target may still follow
        self.threat = -REACH - 1
        self.out: list[str] = []

    def read(self, place: int, mark: str) -> None:
        if mark == "N":
            self.negated = place
        elif mark == "R":
            self.reported = place
        elif mark == "Y":
            self.target = place
            self.pending = [(p, x) for p, x in self.pending if self._aim(place - p, x)]
            if place - self.threat <= REACH:
                self.out.append("threat_target")
                self.threat = -REACH - 1
        elif mark == "T":
            if place - self.target <= REACH:
                self.out.append("threat_target")
            else:
                self.threat = place
        else:
            learned = mark == "L"
            if place - self.threat <= REACH:
                self.out.append("threat_insult")
                self.threat = -REACH - 1
            if place - self.negated <= 2:
                self.out.append("insult_negated")
            elif place - self.reported <= REACH:
                self.out.append("insult_reported")
            elif place - self.target <= REACH:
                self.out.append("learned_target" if learned else "insult_target")
            else:
                self.pending.append((place, "learned" if learned else "insult"))

    def _aim(self, gap: int, name: str) -> bool:
        """A target within reach turns a plain match into an aimed one; else it stays pending."""
        if gap > REACH:
            return True
        self.out.append(f"{name}_target")
        return False


class Document:
    """Reads clauses in order: a bare insult counts with another one, in its clause or in an earlier one."""

    def __init__(self) -> None:
        self.open, self.out = False, []

    def read(self, clause: Clause) -> None:
        bare = [name for _, name in clause.pending]
        self.out += clause.out
        if bare and self.open:
            self.out.append(f"{bare[0]}_again")
        self.out += [f"{name}_pair" for name in bare[1:]]
        self.open |= bool(bare)


def strength(count: int) -> float:
    """One match speaks for itself, more of them add slowly."""
    return 1 + 0.3 * math.log(count) if count else 0.0


@dataclass
class Grammar:
    """Lexicon and weights."""

    words: dict[str, str] = field(default_factory=lexicon)
    stems: dict[str, str] = field(default_factory=dict)
    weights: tuple[float, ...] = PRIOR
    bias: float = PRIOR_BIAS

    def counts(self, text: str | None) -> list[int]:
        """Matches by pattern class over the text's clauses."""
        out, document = [0] * len(PATTERNS), Document()
        get, stem, core = self.words.get, self.stems.get, "ITL"
        mark = (lambda w: get(w) or stem(w[:7]) or stem(w[:5])) if self.stems else get
        for part in _CLAUSE.split(text.lower()) if text else ():
            words = _WORD.findall(part)
            marks = [(i, m) for i, w in enumerate(words) if (m := mark(w))]
            if not any(m in core for _, m in marks):
                continue
            clause = Clause()
            for i, m in marks:
                clause.read(i, m)
            document.read(clause)
        for name in document.out:
            out[PATTERNS.index(name)] += 1
        return out

    def score(self, counts: list[int]) -> float:
        z = self.bias + sum(w * strength(c) for w, c in zip(self.weights, counts, strict=True) if c)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _learned(train: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """Words, and beginnings of words, whose document counts speak for label 1: counted in Spark.

    What comes back is bounded by the sample: ``MIN_DOCS`` documents of it hold each part.
    """
    words = "filter(array_distinct(split(lower(text), '[^\\\\p{L}\\\\p{N}]+')), w -> length(w) > 2)"
    stems = [f"array_distinct(transform(filter({words}, w -> length(w) > {n}), w -> concat(substring(w, 1, {n}), '*')))" for n in STEMS]
    parts = train.selectExpr("label", f"explode(concat({', '.join([words, *stems])})) AS part")
    n = train.agg(F.sum("label").alias("one"), F.count("label").alias("all")).first()
    if not n["one"] or n["one"] == n["all"]:
        return {}, {}
    base = n["one"] / n["all"]
    one, zero = F.col("one"), F.col("zero")
    share = one / (one + zero)
    odds = F.log(share + 1e-3) - F.log(1 - share + 1e-3) - math.log(base / (1 - base))
    gain = one * F.log(share / base) + F.when(zero > 0, zero * F.log((1 - share) / (1 - base))).otherwise(0.0)  # log-likelihood over the base rate's
    found = parts.groupBy("part").agg(F.sum("label").alias("one"), F.sum(1 - F.col("label")).alias("zero"))
    found = found.where((one >= MIN_DOCS) & (odds >= MIN_ODDS) & (gain >= MIN_GAIN))
    top = [r[0] for r in found.select("part").collect()]
    return {w: "L" for w in top if w[-1] != "*"}, {w[:-1]: "L" for w in top if w[-1] == "*"}


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, pull: float = 0.05, steps: int = 60, floor: float = 0.0) -> np.ndarray:
    """Newton steps on the penalized likelihood; weights (the last is the bias) are pulled to ``start``, none below ``floor``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * (w - start)
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        w[:-1] = np.maximum(w[:-1], floor)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """Lexicon and weights from labelled documents outside the held-out fold, about ``fit_docs`` of them."""
    marked = pick(labels, id_col, label_col).toDF("id", "label").where("id is not null and label is not null").groupBy("id").agg(F.max(F.col("label").cast("int")).alias("label"))
    marked = marked.where(fold_of(F.col("id")) != 1)
    m = max(1, marked.count() // max(1, fit_docs))
    marked = marked.where(F.pmod(F.xxhash64("id"), F.lit(m)) == 0)
    train = pick(docs, id_col, text_col).toDF("id", "text").join(marked, "id").select("text", "label").where("text is not null")
    words, stems = _learned(train)
    grammar = Grammar({**words, **lexicon()}, stems)
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def count(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [sent.value.counts(t) for t in b.column(0).to_pylist()]
        yield batch(pa.schema([("label", pa.int32()), ("counts", pa.list_(pa.int32()))]), b.column(1), rows)

    # texts with equal counts are one row with a weight, so little comes back
    rows = map_batches(train, count, "label int, counts array<int>").groupBy("label", "counts").count().collect()
    if not any(r["label"] for r in rows) or all(r["label"] for r in rows):
        return grammar
    x = np.array([[strength(c) for c in r["counts"]] for r in rows])
    y, n = np.array([r["label"] for r in rows], float), np.array([r["count"] for r in rows], float)
    w = logistic(np.repeat(x, n.astype(int), axis=0), np.repeat(y, n.astype(int)), np.array([*PRIOR, PRIOR_BIAS]))
    return Grammar(grammar.words, grammar.stems, tuple(w[:-1].tolist()), float(w[-1]))


def toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, matches): the score and the matched clauses by pattern class."""
    docs = pick(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [sent.value.counts(t) for t in b.column(1).to_pylist()]
        schema = pa.schema([b.schema.field(0), ("score", pa.float64()), ("matches", pa.list_(pa.int64()))])
        yield batch(schema, b.column(0), [round(sent.value.score(r), 9) for r in rows], rows)

    return map_batches(docs, run, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, score double, matches array<long>")


def reject(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents that score below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(grammar)
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = pa.array([sent.value.score(sent.value.counts(t)) < threshold for t in b.column(at).to_pylist()], pa.bool_())
        yield b.filter(keep)

    return map_batches(docs, run, docs.schema)
