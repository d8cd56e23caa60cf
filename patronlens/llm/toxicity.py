"""Toxicity scores from a weighted lexicon matched over folded text.

Folding undoes disguises: compatibility forms, case, look-alike letters of other scripts
and digits or signs in place of letters (only in words that also have letters). Terms are
whole words or, ending in ``*``, word beginnings. Their weights are log odds between
toxic and clean labelled texts; only terms whose excess is beyond chance are kept. One
Aho-Corasick automaton finds all terms and exception phrases in a pass over each whole
text; a term inside an exception phrase does not count. The sum of weights, divided by
the logarithm of the length in words, goes through a logistic curve fitted on the same
labelled texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from patronlens.llm.common import arrow_pass, read

# The starting lexicon, phrases that are no insult, and the foldings.
SEED_TERMS = (
    "idiot", "moron", "stupid", "dumb", "loser", "trash", "scum", "clown", "pathetic", "worthless", "disgusting",
    "imbecile", "jerk", "creep", "hate", "ugly", "vermin", "filth", "bastard", "asshole", "bitch", "retard",
)
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof", "class clown", "hate crime")
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
LOOK_ALIKES = dict(
    zip(
        "авеёкмнорстухіѕјԁӏ" + "αβεικνορτυχ",
        "abeekmhopctyxisjdl" + "abeikvoptux",
        strict=True,
    )
)

SAMPLE_ROWS = 12_000  # labelled texts that the lexicon and the curve are fitted on, at most
MAX_TERMS = 4_000
PREFIXES = (4, 5, 6)
SURPRISE = 11.0  # least log likelihood ratio of a term
LEAST_WEIGHT = 2.5
SEED_WEIGHT = 4.0  # at least, of a starting term that no clean labelled text holds
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W_]+")
_LETTERS = str.maketrans(LOOK_ALIKES)
_SIGNS = str.maketrans(DIGITS)
_SIGN, _LETTER = re.compile(r"[0-9@$!]"), re.compile(r"[^\W\d_]")
_REMEMBERED = 100_000  # folded words that a worker keeps
_folded: dict[str, str] = {}


def fold(text: str) -> str:
    """Words of the text, undisguised, with one space around each."""
    if len(_folded) > _REMEMBERED:
        _folded.clear()
    return f" {' '.join(filter(None, map(_folded_word, text.split())))} "


def _folded_word(word: str) -> str:
    """A run of characters without white space: folded, and split where it has other signs."""
    known = _folded.get(word)
    if known is None:
        plain = word.lower() if word.isascii() else unicodedata.normalize("NFKC", word).lower().translate(_LETTERS)
        if _SIGN.search(plain) and _LETTER.search(plain):
            plain = plain.rstrip("!.,;:?").translate(_SIGNS)
        known = _folded[word] = " ".join(_WORD.findall(plain))
    return known


def terms(folded: str) -> set[str]:
    """The candidate terms of a folded text: its words and their beginnings."""
    found = set(folded.split())
    return found | {f"{w[:k]}*" for w in found for k in PREFIXES if len(w) > k}


@dataclass
class Lexicon:
    """Weights by term, exception phrases and the curve; small enough to go with every task."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -3.0
    slope: float = 4.0
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            built = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                pattern = f" {term[:-1]}" if term.endswith("*") else f" {term} "
                built.add_word(pattern, (len(pattern), weight))
            for phrase in self.exceptions:
                pattern = fold(phrase)
                built.add_word(pattern, (len(pattern), None))
            if len(built):
                built.make_automaton()
            self._automaton = built
        return self._automaton

    def strength(self, text: str | None) -> float:
        """Summed weights over the logarithm of the length; 0 for empty text."""
        folded, built = fold(text or ""), self.automaton()
        if not len(built):
            return 0.0
        hits: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, weight) in built.iter(folded):
            start = end - length + 1
            if weight is None:
                excused.append((start, end))
            else:
                hits[start] = max(weight, hits.get(start, weight))
        total = sum(w for at, w in hits.items() if not any(a <= at < b for a, b in excused)) if excused else sum(hits.values())
        return total / math.log(math.e + folded.count(" "))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * self.strength(text)))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``limit`` labelled texts outside the held-out quarter, as (text, toxic).

    Several labels of one document count as toxic if one does; null labels don't count.
    The ids go to every task: 12 bytes a row, so 150 kB at the standard limit.
    """
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "doc_id").select("text", "toxic")


def _count_terms(batch: pa.RecordBatch):
    toxic, clean, n = Counter(), Counter(), [0, 0]
    for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
        (toxic if label else clean).update(terms(fold(text or "")))
        n[label] += 1
    names = [*(toxic.keys() | clean.keys())]
    yield {
        "term": pa.array(["", *names], pa.string()),
        "t": pa.array([n[1], *(toxic[x] for x in names)], pa.int64()),
        "c": pa.array([n[0], *(clean[x] for x in names)], pa.int64()),
    }


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS) -> Lexicon:
    """The lexicon and curve for the labelled texts; without labels, the starting lexicon."""
    rows = training_rows(docs, labels, limit)
    counts = arrow_pass(rows, _count_terms, "term string, t long, c long").groupBy("term").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c")
    )
    totals = counts.filter("term = ''").first()
    n_toxic, n_clean = (totals["t"], totals["c"]) if totals else (0, 0)
    base = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    n, t = F.col("t") + F.col("c"), F.col("t")
    weight = F.log((t + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    surprise = t * F.log(t / n / base) + F.col("c") * F.log((F.col("c") + 1e-9) / n / (1 - base))
    strong = (
        counts.filter((F.col("term") != "") & (t > 0))
        .withColumns({"weight": weight, "surprise": surprise})
        .filter((F.col("surprise") >= SURPRISE) & (F.col("weight") >= LEAST_WEIGHT))
        .orderBy(F.desc("surprise"), "term")
        .limit(max_terms)
    )
    weights = {r["term"]: r["weight"] for r in strong.collect()}
    seeds = {r["term"]: (r["t"], r["c"]) for r in counts.filter(F.col("term").isin(*SEED_TERMS)).collect()}
    for term in SEED_TERMS:
        t, c = seeds.get(term, (0, 0))
        prior = math.log((t + 3) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        if c == 0:  # no label speaks against the term
            prior = max(prior, SEED_WEIGHT)
        if prior >= LEAST_WEIGHT:
            weights.setdefault(term, min(prior, 6.0))
    lexicon = Lexicon(weights)
    if n_toxic and n_clean:
        bias, slope = _curve(rows, lexicon)
        if slope > 0:  # else no term tells the sample's classes apart, and the starting curve stays
            lexicon.bias, lexicon.slope = bias, slope
    return lexicon


def _curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float]:
    """Bias and slope of a logistic fit over the bounded sample."""

    def strengths(batch: pa.RecordBatch):
        yield {
            "x": np.array([lexicon.strength(t) for t in batch.column("text").to_pylist()], dtype=np.float64),
            "y": batch.column("toxic").cast(pa.float64()),
        }

    sample = np.array(arrow_pass(rows, strengths, "x double, y double").collect(), dtype=np.float64)
    return logistic_fit(sample[:, 0], sample[:, 1])


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.5) -> tuple[float, float]:
    """Bias and slope (never negative) of a logistic curve, by Newton steps that are halved until they help.

    The ridge keeps the slope finite where the classes are apart.
    """
    x = np.c_[np.ones(len(x)), x]
    beta = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * b @ b)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        gradient = x.T @ (p - y) + ridge * beta
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(2), gradient)
        scale = 1.0
        while loss(beta - scale * step) > loss(beta) and scale > 1e-6:
            scale /= 2
        beta = beta - scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None) -> DataFrame:
    """Per row ``row`` (a struct of its columns or those of ``keep``, so names never clash) and ``score``, 0 to 1.

    Null and empty texts get the least score. Rows are judged one by one: repeated rows
    get the same score, an empty table gives no rows.
    """
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col("text").cast("string").alias("text")
    )

    def build(batch: pa.RecordBatch):
        yield {
            "row": batch.column("row"),
            "score": np.array([lexicon.score(t) for t in batch.column("text").to_pylist()], dtype=np.float64),
        }

    return arrow_pass(packed, build, StructType([packed.schema["row"], StructField("score", DoubleType())]))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    result = score(docs, learn(docs, read(spark, folder, "labels")), ["doc_id"])
    return result.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
