"""Toxicity by a weighted lexicon.

Texts are folded (lower case, look-alike letters and digits read as Latin letters, everything else between words a single
space) and run through one Aho-Corasick automaton. Lexicon entries match at the start of a word, so inflected and compound
forms count; a match inside an exception phrase does not. The score is a logistic function of the weighted matches per
word and of their sum.

Weights, exceptions and the two coefficients are learned from labelled documents: at most `sample_docs` of them, chosen by
a hash, take part (the documented bound of the fit). Candidates are word starts that are much more frequent in toxic documents;
from these a greedy cover keeps those that explain toxic documents not explained yet, so that words that merely travel with
them (copies of one document, a language) are left out. Scoring reads every document whole.

Defined results: a missing or empty text scores as no match does; labels that are missing are not used, documents
labelled twice with different labels are left out of the fit; without a label of either class every score is 0; rows that
repeat are scored each; an empty table gives an empty result; other columns are not read and cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import materialise, whole_text

SAMPLE_DOCS = 12_000
CANDIDATES = 2_000
SHORTEST, LONGEST = 4, 10
#: Cyrillic and Greek letters, digits and signs that are read as the Latin letter they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "ⅰ": "i", "ⅼ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
}
#: Marks between words; a sign that stands for a letter counts as one only inside a word.
_BLANKS = {c: " " for c in map(chr, range(128)) if not c.isalnum() and c not in "@$!"} | {c: " " for c in " «»“”„‘’–—…·•¿¡"}
_INVISIBLE = {c: "" for c in "­​‌‍⁠﻿"}
_FULL_WIDTH = {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
_LETTERS = str.maketrans(_BLANKS | _INVISIBLE | _FULL_WIDTH | {k: v for k, v in LOOKALIKES.items() if k not in "@$!"})
_SIGNS = {c: LOOKALIKES[c] for c in "@$!"}


def fold(text: str) -> str:
    """' word word ... word ' in folded letters."""
    text = text.lower().translate(_LETTERS)
    if "@" in text or "$" in text or "!" in text:
        for sign, letter in _SIGNS.items():
            if sign in text:
                text = _inner(text, sign, letter)
    return " " + " ".join(text.split()) + " "


def _inner(text: str, sign: str, letter: str) -> str:
    """A sign between two letters is a letter, elsewhere a blank."""
    parts = text.split(sign)
    out = [parts[0]]
    for before, after in zip(parts, parts[1:]):
        out.append(letter if before[-1:].isalnum() and after[:1].isalnum() else " ")
        out.append(after)
    return "".join(out)


@dataclass
class Lexicon:
    """weights: word starts; exceptions: folded phrases in which they do not count; scale: intercept, per word, in all."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    scale: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for stem, weight in self.weights.items():
            found.add_word(" " + stem, (len(stem) + 1, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found


def weighted(automaton, folded: str) -> float:
    """Sum of the weights of matches outside exceptions; of several starts of one word the heaviest counts."""
    if not len(automaton):
        return 0.0
    hits: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded):
        start = end + 1 - length
        if weight is None:
            free.append((start, end))
        else:
            hits[start] = max(weight, hits.get(start, 0.0))
    if free and hits:
        covered = sorted(free)
        hits = {s: w for s, w in hits.items() if not _inside(covered, s)}
    return sum(hits.values())


def _inside(covered: list[tuple[int, int]], start: int) -> bool:
    from bisect import bisect_right

    at = bisect_right(covered, (start, math.inf)) - 1
    while at >= 0 and covered[at][0] > start - 200:
        if covered[at][0] <= start < covered[at][1]:
            return True
        at -= 1
    return False


def measures(total: float, n_words: int) -> tuple[float, float]:
    return min(5.0, 100.0 * total / (n_words + 10.0)), min(10.0, math.log1p(total))


def score(lexicon: Lexicon, total: float, n_words: int) -> float:
    rate, amount = measures(total, n_words)
    a, b, c = lexicon.scale
    z = max(-40.0, min(40.0, a + b * rate + c * amount))
    return 1.0 / (1.0 + math.exp(-z))


def starts(folded: str) -> Counter:
    """How often each word start of 4 to 10 letters occurs."""
    words = Counter(folded.split())
    out: Counter = Counter()
    for w, n in words.items():
        if len(w) >= SHORTEST and w.isalpha():
            for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
                out[w[:k]] += n
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, sample_docs: int) -> DataFrame:
    """`doc_id, toxic, f` (folded text) of at most about `sample_docs` usable labelled documents with distinct texts."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(usable)
    marks = marks.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).where("toxic = high").drop("high")
    n = marks.count()
    if n > sample_docs:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample_docs / n))
    marks = materialise(marks)  # bounded by sample_docs, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("t")).join(F.broadcast(marks), "doc_id")

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "toxic": frame["toxic"], "f": [fold(t) for t in frame["t"]]})

    return materialise(rows.mapInPandas(folded, "doc_id long, toxic int, f string").dropDuplicates(["f"]))


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> Lexicon:
    """Fits the lexicon. `usable` is a condition on doc_id that says which labels may be seen."""
    sample = labelled_sample(docs, labels, F.lit(True) if usable is None else usable, sample_docs)
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = size.get(1, 0), size.get(0, 0)
    if not positive or not negative:
        return Lexicon({}, (), (-40.0, 0.0, 0.0))

    def listed(only: frozenset[str] | None):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for doc, toxic, f in zip(frame["doc_id"], frame["toxic"], frame["f"]):
                    n = f.count(" ") - 1
                    rows += [(doc, toxic, n, s, k) for s, k in starts(f).items() if only is None or s in only]
                yield pd.DataFrame(rows, columns=["doc_id", "toxic", "n_words", "stem", "k"])

        return run

    shape = "doc_id long, toxic int, n_words long, stem string, k long"
    support = max(3, math.ceil(0.005 * positive))
    # stems with enough toxic documents: at most (stems of a document) / 0.005 of them
    frequent = sample.where("toxic = 1").mapInPandas(listed(None), shape).groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    known = frozenset(r["stem"] for r in frequent.select("stem").collect())
    counts = sample.mapInPandas(listed(known), shape).groupBy("stem", "toxic").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("k") / (F.col("n_words") + 10)).alias("rate"))
    wide = counts.groupBy("stem").agg(
        *[F.sum(F.when(F.col("toxic") == y, F.col(c)).otherwise(0)).alias(f"{c}{y}") for y in (0, 1) for c in ("docs", "rate")]
    )
    ratio = F.log((F.col("rate1") / positive + 1e-6) / (F.col("rate0") / negative + 1e-6))
    best = wide.withColumn("weight", ratio).where(F.col("weight") > math.log(5)).orderBy((F.col("docs1") * F.col("weight")).desc(), "stem")
    candidates = {r["stem"]: r["weight"] for r in best.limit(CANDIDATES).collect()}
    where = sample.mapInPandas(listed(frozenset(candidates)), shape).collect()
    weights = _cover(where, candidates, positive, negative)
    exceptions = _exceptions(sample, weights, support)
    return _scaled(sample, Lexicon(weights, exceptions))


def _cover(rows, candidates: dict[str, float], positive: int, negative: int, passes: int = 3) -> dict[str, float]:
    """Greedy cover: the start that reaches the most toxic documents not reached yet, less what it reaches of the others.

    A document is reached where a start makes up at least half a percent of its words. Further passes begin again with
    what is left of the starts and ask for more support, so that a second and third word of the same documents come in.
    """
    hit: dict[str, tuple[set, set]] = {}
    for r in rows:
        if r["k"] / (r["n_words"] + 10) >= 0.005:
            hit.setdefault(r["stem"], (set(), set()))[r["toxic"]].add(r["doc_id"])
    everything, out = set().union(*(p for _, p in hit.values())) if hit else set(), {}
    for at in range(passes):
        left, least = set(everything), max(3, (0.02 if at else 0.005) * positive)
        hit = {s: h for s, h in hit.items() if not at or len(h[0]) / negative <= 0.02 * len(h[1]) / positive}
        while hit:
            # of starts with equal reach the longest is the most particular
            gain, _, stem = max((len(p & left) / positive - 2 * len(n) / negative, len(s), s) for s, (n, p) in hit.items())
            reached = hit.pop(stem)[1] & left
            if gain <= 0 or len(reached) < least:
                break
            out[stem] = round(candidates[stem], 4)
            left -= reached
            hit = {s: h for s, h in hit.items() if not s.startswith(stem) and not stem.startswith(s)}
    return out


def _exceptions(sample: DataFrame, weights: dict[str, float], support: int) -> tuple[str, ...]:
    """Whole words and two-word phrases around a match that are found in ordinary documents, and hardly ever in toxic ones."""
    if not weights:
        return ()
    automaton = Lexicon(weights).automaton()

    def around(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for toxic, f in zip(frame["toxic"], frame["f"]):
                seen = set()
                for end, (length, _) in automaton.iter(f):
                    start = end + 1 - length
                    close = f.index(" ", end)
                    word = f[start + 1 : close]
                    before = f[f.rfind(" ", 0, start) + 1 : start] if start else ""
                    after = f[close + 1 : f.find(" ", close + 1)] if close + 1 < len(f) else ""
                    seen |= {word, f"{before} {word}".strip(), f"{word} {after}".strip()}
                rows += [(toxic, p) for p in seen if len(p) < 80]
            yield pd.DataFrame(rows, columns=["toxic", "phrase"])

    n = sample.mapInPandas(around, "toxic int, phrase string").groupBy("phrase").agg(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1"))
    kept = n.where((F.col("n0") >= support) & (F.col("n0") >= 10 * F.col("n1"))).orderBy(F.col("n0").desc(), "phrase").limit(CANDIDATES)
    return tuple(r["phrase"] for r in kept.collect())


def _scaled(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Fits the coefficients by Newton steps on one row of two measures per sampled document."""
    automaton = lexicon.automaton()

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(y, *measures(weighted(automaton, f), f.count(" ") - 1)) for y, f in zip(frame["toxic"], frame["f"])]
            yield pd.DataFrame(rows, columns=["y", "rate", "amount"])

    # bounded by the sample; in one order, so that the sums do not depend on how rows arrive
    rows = np.array(sorted(tuple(r) for r in sample.mapInPandas(measured, "y int, rate double, amount double").collect()), dtype=float)
    x, y = np.column_stack([np.ones(len(rows)), rows[:, 1:]]), rows[:, 0]
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return Lexicon(lexicon.weights, lexicon.exceptions, tuple(float(b) for b in beta))


def score_documents(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, score, n_words, matched` (sum of the weights), one row per document. The lexicon is small: see CANDIDATES."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_words", pa.int64()), ("matched", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            scores, sizes, sums = [], [], []
            for t in batch.column(1).cast(pa.binary()):
                f = fold(t.as_py().decode("utf-8", "replace"))
                total, n = weighted(automaton, f), max(0, f.count(" ") - 1) if f.strip() else 0
                scores.append(score(lexicon, total, n))
                sizes.append(n)
                sums.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(sizes, pa.int64()), pa.array(sums)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t")).mapInArrow(run, "doc_id long, score double, n_words long, matched double")
