"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= g) = logistic(threshold_g - w.x) with one weight vector and ordered thresholds. x is hashed text: words that occur, trigrams of character classes
(style), and bins of repetition. The expected grade and the probability of the best grade (the tail) decide what is kept.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import likely_sampled, release_memory, trimmed

#: Hashed word space, character classes, and the bins of repetition that follow them in the weight vector.
WORDS, CLASSES, BINS, PREFIX = 1 << 18, 16, 64, 5
STYLE = CLASSES**3
DIMENSIONS = WORDS + STYLE + BINS

# classes: 0 space, 1 lower, 2 upper, 3 digit, 4 longer UTF-8; punctuation shares the rest by code
_CLASS = np.array([0 if b <= 32 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b >= 128 else 5 + b % 11 for b in range(256)], np.uint16)
_STRIP = ".,;:!?()[]{}\"'|%*#$&<>"


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a whole text's features."""
    text = text or ""
    words = text.lower().split()
    distinct = {w.strip(_STRIP) for w in set(words)}
    # words and, since related words share it, the beginning of longer ones
    keys = [w.encode("utf-8", "surrogatepass") for w in distinct] + [b"^" + p.encode("utf-8", "surrogatepass") for p in {w[:PREFIX] for w in distinct if len(w) > PREFIX}]
    index = np.unique(np.fromiter((zlib.crc32(k) & (WORDS - 1) for k in keys), np.int64, len(keys)))
    raw = _CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    if len(raw):
        raw = raw[np.concatenate([[True], raw[1:] != raw[:-1]])]
    style = np.bincount(raw[:-2] * 256 + raw[1:-1] * 16 + raw[2:], minlength=STYLE) if len(raw) > 2 else np.zeros(STYLE)
    used = np.flatnonzero(style)
    strength = np.sqrt(style[used])
    strength /= max(1e-12, np.sqrt((strength**2).sum()))
    n = len(words)
    echoes = sum(map(operator.eq, words, words[1:])) / n if n else 0.0
    variety = len(set(words)) / n if n else 0.0
    scale = min(7, int(np.log2(n + 1) / 2))
    bins = [min(7, int(echoes * 40)), 8 + scale, 16 + 8 * min(3, scale // 2) + min(7, int(variety * 8)), 48 + min(15, int(16 * text.count("\n") / (n + 1)))]
    return np.concatenate([index, WORDS + used, WORDS + STYLE + np.array(bins)]), np.concatenate([np.ones(len(index)), 3 * strength, np.ones(len(bins))])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Weights of the features that were learned, and ordered thresholds."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, weights: np.ndarray, grade_count: int, penalty: float = 5e-4, rounds: int = 200, rate: float = 0.1):
        self.weights = np.zeros(DIMENSIONS, np.float32)
        if not len(rows):
            self.thresholds = np.linspace(-1, 1, grade_count - 1)
            return
        seen = np.zeros(DIMENSIONS, np.int32)
        for index, _ in rows:
            seen[index] += 1
        used = np.flatnonzero(seen >= 3)
        place = np.full(DIMENSIONS, -1, np.int32)
        place[used] = np.arange(len(used))
        kept = [place[index] >= 0 for index, _ in rows]
        at = np.concatenate([place[index[k]] for (index, _), k in zip(rows, kept)])
        values = np.concatenate([v[k] for (_, v), k in zip(rows, kept)])
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [int(k.sum()) for k in kept])
        share = weights / weights.sum()
        cumulative = np.clip(np.array([share[grades <= g].sum() for g in range(grade_count - 1)]), 1e-3, 1 - 1e-3)
        # thresholds are the first and the logs of the steps to the next, so that they stay ordered
        cuts = np.log(cumulative / (1 - cumulative))
        steps = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
        state = np.concatenate([np.zeros(len(used)), steps])
        mean, square = np.zeros_like(state), np.zeros_like(state)
        for t in range(1, rounds + 1):
            w, cuts = state[: len(used)], np.cumsum(np.concatenate([state[len(used) : len(used) + 1], np.exp(state[len(used) + 1 :])]))
            score = np.bincount(row, weights=values * w[at], minlength=len(rows))
            padded = np.concatenate([[-np.inf], cuts, [np.inf]])
            with np.errstate(over="ignore"):
                high, low = _logistic(padded[grades + 1] - score), _logistic(padded[grades] - score)
            high, low = np.where(grades == grade_count - 1, 1.0, high), np.where(grades == 0, 0.0, low)
            p = np.maximum(high - low, 1e-12)
            dh, dl = high * (1 - high) / p, low * (1 - low) / p
            d_score = share * (dh - dl)  # of the loss
            d_cuts = np.array([(share * dl)[grades == g + 1].sum() - (share * dh)[grades == g].sum() for g in range(grade_count - 1)])
            tails = np.cumsum(d_cuts[::-1])[::-1]
            grad = np.concatenate([np.bincount(at, weights=values * d_score[row], minlength=len(used)) + penalty * w, tails[:1], tails[1:] * np.exp(state[len(used) + 1 :])])
            mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
            state = state - rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8) * min(1.0, 2 * (1 - t / rounds) + 0.02)
        self.weights[used] = state[: len(used)]
        self.thresholds = np.cumsum(np.concatenate([state[len(used) : len(used) + 1], np.exp(state[len(used) + 1 :])]))

    def predict(self, text: str | None) -> tuple[float, float]:
        """(expected grade, probability of the best grade)."""
        index, values = features(text)
        above = 1 - _logistic(self.thresholds - float(self.weights[index] @ values))
        return float(above.sum()), float(above[-1])


@trimmed
def _sampled(batches):
    for batch in batches:
        rows = [features(t) for t in batch["text"]]
        yield pd.DataFrame({"grade": batch["grade"].to_numpy(), "index": [r[0].astype(np.int32).tobytes() for r in rows], "value": [r[1].astype(np.float32).tobytes() for r in rows]})


def _grader(model: Model):
    """The model as a column function: only texts go to Python, and two numbers come back."""

    @F.pandas_udf("struct<expected_grade double, tail_probability double>")
    def graded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["expected_grade", "tail_probability"], dtype=float)
        release_memory()

    return graded


def train(documents: DataFrame, ratings: DataFrame, grade_count: int, documents_per_grade: int) -> Model:
    """Fit on a bounded sample: of each grade the ``documents_per_grade`` rated ids of smallest hash, weighted back to the grades' true shares."""
    ratings = ratings.where(f"doc_id is not null and grade between 0 and {grade_count - 1}").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    totals = {r["grade"]: r["count"] for r in ratings.groupBy("grade").count().collect()}  # a row per grade
    order = Window.partitionBy("grade").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id")
    picked = ratings.where(likely_sampled(F.col("grade"), totals, documents_per_grade)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= documents_per_grade).select("doc_id", "grade")
    sample = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # grade_count x documents_per_grade narrow rows at most
    found = sample.select("grade", "text").mapInPandas(_sampled, "grade int, index binary, value binary").limit(2 * grade_count * documents_per_grade).collect()
    rows = [(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32)) for r in found]
    grades = np.array([r["grade"] for r in found], np.int64)
    seen = np.maximum(1, np.bincount(grades, minlength=grade_count))
    weights = np.array([totals.get(g, 0) / seen[g] for g in grades], np.float64)
    return Model(rows, grades, weights, grade_count)


def grade_documents(documents: DataFrame, ratings: DataFrame, grade_count: int = 3, documents_per_grade: int = 2000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Expected grade and tail probability of every whole text of ``documents`` (doc_id, text), learned from ``ratings`` (doc_id, grade 0..grade_count-1).

    Returns one row per input row: the columns named in ``keep``, expected_grade (0 to grade_count - 1) and tail_probability (of the best grade).

    Null texts count as empty. Ratings with null id or grade are ignored; of several ratings of one id the lowest counts. Without any usable rating all
    documents get the same middling grade. Repeated rows get equal results, and extra columns are passed through only if kept.
    """
    model = train(documents, ratings, grade_count, documents_per_grade)
    release_memory()  # of the sample, on the driver
    graded = documents.select(F.struct(*keep).alias("kept"), _grader(model)(F.col("text")).alias("graded"))
    return graded.select("kept.*", "graded.expected_grade", "graded.tail_probability")
