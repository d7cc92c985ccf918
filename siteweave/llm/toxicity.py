"""Toxicity from a weighted lexicon, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, batches, prepare, texts, tidy, with_schema

#: Labelled documents that the fit reads of either label, at most; drawn by a hash of their ids.
FIT_ROWS = 4000
#: Toxic documents that a term is in at least, how often its rate there is that of the others, and its log-likelihood ratio at least.
LEAST_DOCS, LIFT, EVIDENCE = 5, 8, 25.0
#: Letters that a word start has at least and at most; whole words may be longer.
SHORTEST, LONGEST = 3, 14
#: A longer form of a term is taken if it has this share of the evidence.
ENOUGH = 0.8
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "loser bracket", "stupid easy", "idiot proof")

# Look-alikes of Latin letters, and digits written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}


def folding() -> dict[int, str]:
    """A translation table: lower case, look-alikes and digits to letters, other marks to spaces."""
    table = {i: " " if not chr(i).isalnum() else chr(i).lower() for i in range(0x250)}
    table |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
    table |= {i: " " for i in range(0x2000, 0x2070)} | {0x3000: " "}
    table |= {i: "" for i in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    for a, b in (LOOKALIKES | DIGITS).items():
        table[ord(a)] = b
        if len(a.upper()) == 1 and not a.isdigit():
            table[ord(a.upper())] = b
    return table


FOLD = folding()


def folded(text: str) -> str:
    """The text in folded letters, with a space in front and behind."""
    return f" {text.translate(FOLD)} "


@dataclass
class Lexicon:
    """weights: of " word " (a whole word) and " stem" (the start of a word). scale: centre, spread and coefficients of the logistic score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] = (-3.0, 1.0, 1.0)

    def matcher(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase in self.exceptions:
            automaton.add_word(f" {phrase} ", (0.0, len(phrase) + 2))
        for term, weight in self.weights.items():
            automaton.add_word(term, (weight, len(term)))
        automaton.make_automaton()
        return automaton

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "exceptions": self.exceptions, "coefficients": self.coefficients})


def features(automaton, text: str) -> tuple[float, float]:
    """log(1 + weight of the matches), log(1 + that weight for each 1000 words).

    A match inside an exception phrase does not count; of matches that overlap in a word, the
    heaviest counts.
    """
    t = folded(text)
    hits = [(end - size + 1, end, weight) for end, (weight, size) in automaton.iter(t)]
    if not hits:
        return 0.0, 0.0
    shields = sorted((a, b) for a, b, w in hits if not w)
    starts, ends = [a for a, _ in shields], list(accumulate((b for _, b in shields), max))
    best: dict[int, float] = {}
    for a, b, w in hits:
        if w:
            k = bisect_right(starts, a)
            if not k or ends[k - 1] < b:
                best[a] = max(w, best.get(a, 0.0))
    total = sum(best.values())
    words = t.count(" ") or 1
    return float(np.log1p(total)), float(np.log1p(1000 * total / words))


def terms_of(text: str) -> set[str]:
    """The whole words and the word starts of a text, each as the pattern that finds it."""
    out = set()
    for w in set(folded(text).split()):
        if len(w) >= SHORTEST:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST + 1)))
    return out


def evidence(a: int, b: int, p: int, q: int) -> float:
    """The log-likelihood ratio of a term in a of p toxic and b of q other documents."""
    part = lambda x, n, r: x * np.log(x / (n * r)) if x else 0.0
    r = (a + b) / (p + q)
    return 2 * float(part(a, p, r) + part(b, q, r) + part(p - a, p, 1 - r) + part(q - b, q, 1 - r))


def chosen(toxic: dict[str, int], clean: dict[str, int], p: int, q: int) -> dict[str, float]:
    """Weights of the terms to keep, of those in toxic[t] of p toxic and clean[t] of q other documents.

    A term counts if it passes LEAST_DOCS, LIFT and EVIDENCE. Of a word and its starts one is kept:
    the longest whose evidence is ENOUGH of the most, so that a start is taken only where several
    words bear it out. The weight is the smoothed log ratio of the rates.
    """
    weight = {t: float(np.log((a + 0.5) / (p + 1)) - np.log((clean.get(t, 0) + 0.5) / (q + 1))) for t, a in toxic.items() if a >= LEAST_DOCS and clean.get(t, 0) * p * LIFT <= a * q}
    known = {t: e for t in weight if (e := evidence(toxic[t], clean.get(t, 0), p, q)) >= EVIDENCE}
    names = sorted(known)
    weights: dict[str, float] = {}
    taken: set[str] = set()
    for term in sorted(known, key=lambda t: (-known[t], -len(t), t)):
        bare = term.rstrip()
        if bare in taken or any(bare[:k] in weights for k in range(SHORTEST + 1, len(bare) + 1)) or bare + " " in weights:
            continue
        family = names[bisect_left(names, bare) : bisect_left(names, bare + "\U0010ffff")]
        best = max((t for t in family if known[t] >= ENOUGH * known[term]), key=lambda t: (len(t), known[t], t))
        weights[best] = weight[best]
        taken.update(best.rstrip()[:k] for k in range(SHORTEST + 1, len(best.rstrip()) + 1))
    return weights


def _sample(docs: DataFrame, labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """Labelled documents, at most rows of either label; equal texts count once. Bounded, so broadcast."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null").dropDuplicates(["k"])
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(rows) for y in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    return docs.join(chosen, F.col("d") == F.col("k")).select("x", "y").groupBy(F.xxhash64("x").alias("h"), "y").agg(F.first("x").alias("x")).select("x", "y")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon whose terms and weights come from labelled documents.

    At most rows documents of either label are read. The terms, words or starts of words, are those
    of chosen(). A logistic curve over two features, the matched weight and the weight per length, is
    then fitted to the same sample. Labels without a document, nulls among keys and labels, and
    repeated labels of a key but one are ignored; equal texts count once. Without documents of both
    labels the lexicon is empty and every score is low.
    """
    from ..session import checkpointed

    prepare(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    sample = checkpointed(_sample(slim, labels, key, label, rows))

    @tidy
    def counted(items):
        n: Counter = Counter()
        for batch in batches(items):
            for x in batch.column(0).to_pylist():
                n.update(terms_of(x))
        if n:
            keys = list(n)
            for i in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_pydict({"term": keys[i : i + 50_000], "n": pa.array([n[k] for k in keys[i : i + 50_000]], pa.int64())})

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, q = sizes.get(1, 0), sizes.get(0, 0)
    if not p or not q:
        return Lexicon(exceptions=exceptions)
    often = sample.where("y = 1").select("x").mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    toxic = {r["term"]: r["n"] for r in often.collect()}  # each document has a bounded share of a bounded sample's terms
    known = frozenset(toxic)

    @tidy
    def checked(items):
        n: Counter = Counter()
        for batch in batches(items):
            for x in batch.column(0).to_pylist():
                n.update(terms_of(x) & known)
        if n:
            yield pa.RecordBatch.from_pydict({"term": list(n), "n": pa.array(list(n.values()), pa.int64())})

    clean = {r["term"]: r["n"] for r in sample.where("y = 0").select("x").mapInArrow(checked, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    weights = chosen(toxic, clean, p, q)
    lexicon = Lexicon(weights, exceptions)

    @tidy
    def measured(items):
        automaton = lexicon.matcher()
        for batch in batches(items):
            f = [features(automaton, x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"a": pa.array([v[0] for v in f], pa.float64()), "b": pa.array([v[1] for v in f], pa.float64()), "y": batch.column(1)})

    table = sample.mapInArrow(measured, "a double, b double, y int").toPandas().sort_values(["y", "a", "b"])
    lexicon.coefficients = tuple(_logistic(table[["a", "b"]].to_numpy(), table["y"].to_numpy()))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a logistic curve with a ridge on the slopes."""
    a = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    c = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ c)
        c = c + step
        if np.abs(step).max() < 1e-9:
            break
    return c


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5, else 0), from whole texts.

    A map where the rows lie. Null and empty texts have no match and get the score of none; columns
    named score or predicted are replaced; rows repeat as in docs.
    """
    prepare(docs.sparkSession)

    @tidy
    def scored(items):
        automaton = lexicon.matcher()
        c0, c1, c2 = lexicon.coefficients
        for batch in batches(items):
            out = []
            for x in texts(batch.column(text)):
                a, b = features(automaton, x)
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, c0 + c1 * a + c2 * b)))))
            s = pa.array(out, pa.float64())
            yield appended(batch, {"score": s, "predicted": pa.array([int(v >= 0.5) for v in out], pa.int32())})

    return docs.mapInArrow(scored, with_schema(docs, {"score": "double", "predicted": "int"}))
