"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding: compatibility characters (mathematical, circled, full-width letters) become plain, lower case,
look-alikes of Latin letters and digits in their place become those letters, invisible characters go,
other ASCII characters that aren't letters become spaces. So an entry of the lexicon, a space and the
start of a word, matches `Idiot`, `1d10t` and the Cyrillic look-alike alike. Accents stay, as they tell
words of most languages apart (without them 15 of 97 held-out toxic texts of sf0.1 are missed instead of
7); a text that has some is matched without them, too, and the larger sum counts, so `ïdïöt` is found.
The longest entry from a place counts, and exception phrases are entries of weight zero: `trash can`
hides `trash`. A few are given; more are learned, pairs of neighbouring words one of which is an entry,
found in at least `support` texts of the sample and nearly always in texts that aren't toxic.

The lexicon is learned: word starts of 3 to 8 letters in a bounded sample of labelled texts
(`sample` rows, of the least hashed ids), counted by label in the cluster; an entry has at least
`support` (and a hundredth) of the toxic texts and `precision`, and its weight is the smoothed
log-odds; at most `entries` come to the driver, those with most toxic texts. The score is logistic in
the sum of weights and in that sum over the length in words, fitted on numbers of the same sample.

Null and empty texts have no matches; they get the score of a text without any. Repeated labels of a
doc_id count once, toxic if any is; labels that are null or neither 0 nor 1 and null ids teach nothing.
Of several texts of one labelled id the least teaches. Without toxic labels, or without any, every score
is 0. Very long texts are folded and matched whole. Repeated documents each get their row; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spantail.llm.common import byte_slices, drop, in_arrow, others, written

#: Letters of a word's start.
SHORTEST, LONGEST = 3, 8
#: What an entry would match wrongly.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash talk", "clown fish", "pond scum", "loser bracket", "moron test")
#: Digits and signs that stand for letters.
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Letters of other scripts that look like Latin ones.
_ALIKE = dict(zip("аеорсухіјѕһԁкмтвнԛԝαειοκνρτυχωɑɡɩ", "aeopcyxijshdkmtbhqwaeioknptuxwagi", strict=True))


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {i: " " for i in range(128) if not chr(i).isalpha()}
    table |= {ord(a): b for a, b in (_SIGNS | _ALIKE).items()}
    table |= dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
    return table


_FOLD = _table()
_BARE = _FOLD | dict.fromkeys(range(0x300, 0x370))


def fold(text: str | None) -> str:
    """The text as it is matched, with a space in front."""
    text = text or ""
    return " " + (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower().translate(_FOLD)


def without_accents(text: str | None) -> str:
    """The folded text without accents."""
    return " " + unicodedata.normalize("NFKD", text or "").lower().translate(_BARE)


def _starts(texts: pa.Array) -> Iterator[set[str]]:
    """The word starts of each text."""
    for text in texts.to_pylist():
        yield {w[:k] for w in set(fold(text).split()) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


class Lexicon:
    """Entries with weights, matched longest first."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            self.automaton.add_word(fold(phrase), 0.0)
        for start, weight in weights.items():
            self.automaton.add_word(" " + start, weight)
        self.automaton.make_automaton()

    def pairs(self, text: str | None) -> set[str]:
        """Pairs of neighbouring words one of which has an entry's start."""
        words = fold(text).split()
        hit = [next(self.automaton.iter_long(" " + w), None) is not None for w in words]
        return {f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if hit[i] or hit[i + 1]}

    def match(self, text: str | None) -> tuple[float, int]:
        """The sum of weights, and the number of words."""
        folded = fold(text)
        forms = [folded] if folded.isascii() else [folded, without_accents(text)]
        return max(sum(w for _, w in self.automaton.iter_long(f)) for f in forms), len(folded.split())


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(1000 * total / np.maximum(words, 1))], 1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w, hold = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold + 1e-6 * np.eye(len(w)), x.T @ (y - p) - hold @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label is never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sums(total: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x[0] for x in total], float), np.array([x[1] for x in total], np.int64)


def _weights(counts: dict[str, tuple[int, int]], bad: int, good: int) -> dict[str, float]:
    """Log-odds of word starts. Of starts that continue each other, the longest that keeps nearly all toxic texts stands for the shorter, and a shorter one as precise for the longer."""
    covered = {s[:k] for s, (b, _) in counts.items() for k in range(SHORTEST, len(s)) if s[:k] in counts and b >= 0.95 * counts[s[:k]][0]}
    kept = {s: b / (b + g) for s, (b, g) in counts.items() if s not in covered}
    out = {}
    for s, rate in kept.items():
        if not any(kept.get(s[:k], 0) >= rate for k in range(SHORTEST, len(s))):
            out[s] = math.log((counts[s][0] + 0.5) / (bad + 1)) - math.log((counts[s][1] + 0.5) / (good + 1))
    return {s: w for s, w in out.items() if w > 0}


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 10_000, support: int = 4, precision: float = 0.8, entries: int = 5000) -> tuple[dict[str, float], np.ndarray, tuple[str, ...]] | None:
    """The lexicon, the coefficients and the exception phrases, or None if the labels teach nothing."""
    spark = documents.sparkSession
    told = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    told = told.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(told), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    texts, path = written(texts.select("text", "toxic"), "sample")

    def counted(of: Callable[[], Callable[[pa.Array], Iterator[set[str]]]]) -> DataFrame:
        """start, bad and good: texts of the sample of either label that have it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            each = of()
            for part in byte_slices(batches, 0):
                seen = (Counter(), Counter())
                for starts, toxic in zip(each(part.column(0)), part.column(1).to_pylist(), strict=True):
                    seen[toxic].update(starts)
                both = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([seen[1][s] for s in both], pa.int64()), pa.array([seen[0][s] for s in both], pa.int64())], ["start", "bad", "good"])

        return in_arrow(texts, run, "start string, bad long, good long").groupBy("start").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))

    totals = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    least = max(support, bad // 100)
    best = counted(lambda: _starts).where((F.col("bad") >= least) & (F.col("bad") >= precision * (F.col("bad") + F.col("good")))).orderBy(F.desc("bad"), "good", "start").limit(entries).collect() if bad else []
    weights = _weights({r.start: (r.bad, r.good) for r in best}, bad, good)
    if not weights:
        drop(spark, path)
        return None
    held = spark.sparkContext.broadcast(weights)

    def pairs() -> Callable[[pa.Array], Iterator[set[str]]]:
        lexicon = Lexicon(held.value, ())
        return lambda part: map(lexicon.pairs, part.to_pylist())

    harmless = counted(pairs).where((F.col("good") >= support) & (F.col("good") >= 0.95 * (F.col("bad") + F.col("good")))).orderBy(F.desc("good"), "start").limit(entries).collect()
    exceptions = tuple(r.start for r in harmless)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(held.value, (*EXCEPTIONS, *exceptions))
        for part in byte_slices(batches, 0):
            total, words = _sums([lexicon.match(t) for t in part.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(words), part.column(1)], ["total", "words", "toxic"])

    rows = np.array(in_arrow(texts, measure, "total double, words long, toxic int").collect(), float)
    drop(spark, path)
    return weights, fit(features(rows[:, 0], rows[:, 1]), rows[:, 2]), exceptions


def toxicity(df: DataFrame, model: tuple[dict[str, float], np.ndarray, tuple[str, ...]] | None, keep: list[str] | None = None, text_col: str = "text", exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """The columns `keep` of df (all, if None) and score, from 0 to 1; a column of that name is replaced."""
    kept = others(df.columns if keep is None else keep, "score")
    if model is None:
        return df.select(*kept, F.lit(0.0).alias("score"))
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, coefficients, learned = held.value
        lexicon = Lexicon(weights, (*exceptions, *learned))
        for part in byte_slices(batches, 0):
            total, words = _sums([lexicon.match(t) for t in part.column(0).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(features(total, words) @ coefficients, -30, 30)))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(score)], [*kept, "score"])

    rows = df.select(F.col(text_col).alias("__text"), *kept)
    return in_arrow(rows, run, rows.drop("__text").schema.add("score", "double"))
