"""Toxicity by a weighted lexicon: folded text, one Aho-Corasick pass, normalised by length.

The lexicon (words, stems and exception phrases) and the three coefficients of the score are fitted on a
bounded sample of labelled documents; scoring covers every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.llm.common import TEXT_ROWS, columns, map_batches, map_text, materialize

#: Characters that are drawn like a Latin letter, and digits or signs written for one.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ſ": "s"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
FOLD = str.maketrans(HOMOGLYPHS | DIGITS)
WORD = re.compile(r"[^\W_]+")
INVISIBLE = re.compile("[­​-‏⁠﻿]")

#: Labelled rows that the fit reads at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
STEMS = (4, 5, 6)


def fold(text: str | None) -> str:
    """Words in lower case with look-alikes folded, each between single spaces."""
    text = (text or "").lower()
    if not text.isascii() and INVISIBLE.search(text):
        text = INVISIBLE.sub("", text)
    return f" {' '.join(WORD.findall(text.translate(FOLD)))} "


class Lexicon:
    """Terms with weights: ' word ' matches the whole word and ' stem' any word that starts so; exceptions take hits away."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], coefficients: list[float]):
        self.weights, self.exceptions, self.coefficients = weights, exceptions, coefficients

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        if not len(found):
            return None
        found.make_automaton()
        return found


def hits(automaton: ahocorasick.Automaton | None, folded: str) -> list[tuple[int, float]]:
    """Start and weight of each word that the lexicon holds (its heaviest term), but in exception phrases."""
    if automaton is None:
        return []
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        else:
            best[start] = max(best.get(start, 0.0), weight)
    out, at, reach = [], 0, -1
    spared.sort()
    for s, w in sorted(best.items()):
        while at < len(spared) and spared[at][0] <= s:
            reach = max(reach, spared[at][1])
            at += 1
        if s >= reach:
            out.append((s, w))
    return out


def features(automaton: ahocorasick.Automaton | None, text: str | None) -> tuple[float, float, float]:
    """Total weight (log), and weight by root of the length and by the length in words."""
    folded = fold(text)
    total, words = sum(w for _, w in hits(automaton, folded)), max(1, folded.count(" ") - 1)
    return float(np.log1p(total)), total / words**0.5, total / words


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Coefficients of a ridge logistic regression, the constant first (Newton's method)."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _terms(text: str | None) -> set[str]:
    """Words and stems."""
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for k in STEMS for w in words if len(w) >= k}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, least_docs: int = 3, least_odds: float = 0.3, z: float = 3.0) -> Lexicon:
    """A lexicon from at most ``sample_rows`` labelled documents.

    A term weighs as much as the log odds of the shares of toxic and clean documents that hold it, less ``z`` standard
    errors, and enters from ``least_docs`` toxic documents and ``least_odds`` on; what a stem covers is left out. Rows
    without id or label are left out, an id with several labels has the largest, repeated documents count each. No
    labels or one class: an empty lexicon.
    """
    spark = docs.sparkSession
    labels = columns(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = materialize(columns(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").select("text", "toxic").repartition(max(1, min(64, sample_rows // 500))), "labelled")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sum(n for y, n in sizes.items() if y > 0), sum(n for y, n in sizes.items() if y <= 0)
    if not toxic or not clean:
        return Lexicon({}, [], [0.0 if toxic else -10.0, 0.0, 0.0, 0.0])

    def emit(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:  # sums of few documents at a time: Spark adds them up
            bad, good = Counter(), Counter()
            for text, y in zip(b["text"], b["toxic"], strict=True):
                (bad if y > 0 else good).update(_terms(text))
            keys = list(bad | good)
            yield {"term": keys, "bad": [bad[t] for t in keys], "good": [good[t] for t in keys]}

    counted = map_batches(sample, emit, "term string, bad long, good long", TEXT_ROWS).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    surely = odds - z * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    entries = counted.where(F.col("bad") >= least_docs).withColumn("weight", surely).where(F.col("weight") >= least_odds)
    weights = {r.term: r.weight for r in entries.select("term", "weight").collect()}  # at most the sample's terms over least_docs
    stems = [t for t in weights if not t.endswith(" ")]
    shortest = {t for t in stems if not any(t[:n] in weights for n in range(5, len(t)))}
    weights = {t: w for t, w in weights.items() if t in shortest or (t.endswith(" ") and not any(t[: n + 1] in shortest for n in STEMS))}

    shared = spark.sparkContext.broadcast(Lexicon(weights, [], []))

    def phrases(batches: Iterator[dict]) -> Iterator[dict]:
        automaton, bad, good = shared.value.automaton(), Counter(), Counter()
        for b in batches:
            for text, y in zip(b["text"], b["toxic"], strict=True):
                folded = fold(text)
                for start, _ in hits(automaton, folded):
                    end = folded.find(" ", start + 1)
                    before, word, after = folded[folded.rfind(" ", 0, start) + 1 : start], folded[start + 1 : end], folded[end + 1 : folded.find(" ", end + 1)]
                    for phrase in {f"{before} {word}", f"{word} {after}"}:
                        if len(phrase.split()) == 2:
                            (bad if y > 0 else good)[phrase] += 1
        keys = list(bad | good)
        yield {"phrase": keys, "bad": [bad[k] for k in keys], "good": [good[k] for k in keys]}

    seen = map_batches(sample, phrases, "phrase string, bad long, good long").groupBy("phrase").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    exceptions = sorted(r.phrase for r in seen.where((F.col("good") >= least_docs) & (F.col("good") / clean > F.col("bad") / toxic)).select("phrase").collect())

    shared2 = spark.sparkContext.broadcast(Lexicon(weights, exceptions, []))

    def measure(batches: Iterator[dict]) -> Iterator[dict]:
        automaton = shared2.value.automaton()
        for b in batches:
            a, r, n = zip(*[features(automaton, t) for t in b["text"]], strict=True) if b["text"] else ((), (), ())
            yield {"a": a, "r": r, "n": n, "y": [float(y > 0) for y in b["toxic"]]}

    got = map_batches(sample, measure, "a double, r double, n double, y double").toPandas()  # at most sample_rows rows of four numbers
    return Lexicon(weights, exceptions, logistic(got[["a", "r", "n"]].to_numpy(), got["y"].to_numpy()).tolist())


def _scorer(lexicon: Lexicon) -> Callable[[list[str | None]], np.ndarray]:
    automaton, beta = lexicon.automaton(), np.array(lexicon.coefficients)
    return lambda texts: 1 / (1 + np.exp(-np.clip(np.array([(1.0, *features(automaton, t)) for t in texts]).reshape(-1, 4) @ beta, -30, 30)))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score`` (0 to 1) for every row of ``docs(doc_id, text)``.

    A null text is empty, repeated rows are scored each, null ids stay null, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        scores = _scorer(shared.value)
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": scores(b["text"])}

    return map_batches(columns(docs, doc_id="long", text="string"), run, "doc_id long, score double", TEXT_ROWS)


def without_toxic(docs: DataFrame, lexicon: Lexicon, at: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever they are called, that score under ``at``; a null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make() -> Callable[[str | None], str | None | bool]:
        scores = _scorer(shared.value)
        return lambda text: text if scores([text])[0] < at else False

    return map_text(docs, make)
