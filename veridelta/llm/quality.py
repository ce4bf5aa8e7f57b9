"""A quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and the unlabelled corpus are all that is learnt from, the class prior included. With squared loss, the unbiased risk

    R(w) = -prior * E_P[z] + E_U[(1 + z)^2] / 4,    z = w.x

and its non-negativity bound, E_U[(1 + z)^2] >= prior * E_P[(1 + z)^2], need only first and second moments of the
features. Spark sums those over every document in one aggregate; what comes to the driver is a matrix whose size
is the number of features, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, tune

#: Trusted positives that a fit uses, about, of more; chosen by the hash of doc_id.
LABELLED_BOUND = 2_000_000
#: The class prior that the first fit supposes, rounds of fit and estimate, parts of the score, and the share of positives that a threshold must keep.
FIRST_PRIOR, ROUNDS, BINS, KEPT = 0.5, 2, 200, 0.6
#: Ridge added to the second moments.
RIDGE = 1e-4
#: Characters and words of plain prose that every text's shares are smoothed with.
SMOOTH_CHARS, SMOOTH_WORDS = 60, 12
NAMES = [
    "one", "upper", "symbols", "digits", "bars", "bangs", "stops", "distinct_words", "distinct_lines", "marks", "brackets", "plain_ends",
    "capital_words", "marked_ends",
]


def features(text: str | None) -> np.ndarray:
    """Shape of a text: shares of character classes, repetition, word ends. Texts without words have the constant alone.

    Nothing in it depends on the language or grows with the length, so short and long texts are judged alike.
    """
    out = np.zeros(len(NAMES), np.float32)
    out[0] = 1
    words = (text or "").split()
    if not words:
        return out
    h = np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=256)
    upper = int(h[65:91].sum())
    letters = upper + int(h[97:123].sum() + h[128:].sum())
    symbols = int(h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum())
    lines, count = text.split("\n"), len(words)
    stops = int(h[46] + h[44])
    ends = [w[-1] for w in words]
    plain = sum(map(str.isalpha, ends))
    stopped = ends.count(".") + ends.count(",")
    chars, some = int(h.sum()) + SMOOTH_CHARS, count + SMOOTH_WORDS  # shares of few characters or words lean towards those of plain prose
    out[1:] = (
        (upper + 0.03 * SMOOTH_CHARS) / (letters + SMOOTH_CHARS), (symbols + 0.025 * SMOOTH_CHARS) / chars, h[48:58].sum() / chars, h[124] / chars, h[33] / chars,
        (stops + 0.025 * SMOOTH_CHARS) / chars, (len(set(words)) + SMOOTH_WORDS) / some, (len(set(lines)) + 2) / (len(lines) + 2),
        (h[35:39].sum() + h[42]) / chars, (h[60] + h[61] + h[62] + h[123] + h[125]) / chars, (plain + 0.85 * SMOOTH_WORDS) / some,
        sum(map(str.isupper, words)) / some, (count - plain - stopped) / some,
    )
    return out


def feature_column(text: Column) -> Column:
    """The features of a text as an array."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return of(text)


def with_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the features of every row's whole text."""
    tune(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), feature_column(F.col(text)).alias("x"))


def moments(rows: DataFrame, x: str = "x") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean of x, mean of x x'). Products are summed in each task first; one row of sums leaves a task."""
    size = len(NAMES)

    def sums(frames):
        n, total, square = 0, np.zeros(size), np.zeros((size, size))
        for frame in frames:
            if len(frame):
                m = np.stack(frame[x].to_numpy()).astype(np.float64)
                n, total, square = n + len(m), total + m.sum(axis=0), square + m.T @ m
        yield pd.DataFrame({"n": [n], "v": [np.concatenate([total, square.ravel()])]})

    partial = rows.select(x).mapInPandas(sums, "n long, v array<double>")
    flat = partial.select("n", F.posexplode("v").alias("i", "value"))
    got = flat.groupBy("i").agg(F.sum("value").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()  # features + features^2 rows
    n = got[0]["n"] if got else 0
    values = np.array([r["s"] for r in got]) if got else np.zeros(size + size * size)
    values = values / max(1, n)
    return n, values[:size], values[size:].reshape(size, size)


@dataclass(frozen=True)
class QualityModel:
    """Weights, and the class prior they were fitted with."""

    weights: np.ndarray
    prior: float

    def score(self, x: Column) -> Column:
        """From 0 to 1, 0.5 where the classifier is undecided."""
        terms = [F.get(x, F.lit(i)).cast("double") * F.lit(float(w)) for i, w in enumerate(self.weights)]
        z = terms[0]
        for t in terms[1:]:
            z = z + t
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * z))


def solve(prior: float, positive: np.ndarray, positive_square: np.ndarray, mean: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Weights of least non-negative unbiased risk.

    The risk prior * E_P[(1 - z)^2] / 4 + max(0, negatives' part) is the larger of two convex quadratics: its first term
    alone, and the unbiased risk. So its minimum is that of a convex combination of the two: the unbiased risk's where that is the
    larger one there, the first term's likewise, or else the combination at whose minimum both are equal, found by bisection.
    """
    ridge = RIDGE * np.eye(len(mean))

    def at(share: float) -> tuple[np.ndarray, float]:
        w = np.linalg.solve(share * prior * positive_square + (1 - share) * square + ridge, share * prior * positive + (1 - share) * (2 * prior * positive - mean))
        negatives = (1 + 2 * w @ mean + w @ square @ w) / 4 - prior * (1 + 2 * w @ positive + w @ positive_square @ w) / 4
        return w, float(negatives)

    w, negatives = at(0.0)
    if negatives >= 0:
        return w
    w, negatives = at(1.0)
    if negatives <= 0:
        return w
    low, high = 0.0, 1.0  # the negatives' part grows with the share of the first term
    for _ in range(60):
        share = (low + high) / 2
        w, negatives = at(share)
        low, high = (share, high) if negatives < 0 else (low, share)
    return w


def fit(rows: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", label: str = "quality", bound: int = LABELLED_BOUND) -> QualityModel:
    """Fits on (doc_id, x) rows: all of them are the unlabelled set; trusted positives are training labels of 1.

    ``train`` says of a doc_id whether its label may be looked at. The class prior is estimated from the positives and
    the unlabelled set alone, by ``estimate_prior``; no label of 0 is used for anything. Null labels and null ids are passed over; of a repeated
    id one positive label is enough. Without any positive the model scores 0.5 everywhere. Of more positives than ``bound``, about so many are used, those of
    the smallest hashes.
    """
    known = labels.where((F.col(label) == 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id")).where(train).distinct()
    total = known.count()
    if not total:
        return QualityModel(np.zeros(len(NAMES)), 0.0)
    if total > bound:
        known = known.where(F.shiftrightunsigned(F.xxhash64("__id"), 11) < F.lit(int(bound / total * (1 << 53))))
    trusted = rows.join(known, F.col("doc_id") == F.col("__id"))
    found, positive, positive_square = moments(trusted)
    if not found:
        return QualityModel(np.zeros(len(NAMES)), 0.0)
    _, mean, square = moments(rows)
    prior = FIRST_PRIOR
    for _ in range(ROUNDS):
        model = QualityModel(solve(prior, positive, positive_square, mean, square), prior)
        prior = estimate_prior(histogram(trusted, model), histogram(rows, model))
    return QualityModel(solve(prior, positive, positive_square, mean, square), prior)


def histogram(rows: DataFrame, model: QualityModel) -> np.ndarray:
    """How many rows have a score in each of BINS equal parts from 0 to 1."""
    part = F.least(F.floor(model.score(F.col("x")) * BINS), F.lit(BINS - 1)).cast("int")
    out = np.zeros(BINS)
    for r in rows.groupBy(part.alias("bin")).agg(F.count("*").alias("n")).collect():  # BINS rows
        out[r["bin"]] = r["n"]
    return out


def estimate_prior(positive: np.ndarray, every: np.ndarray) -> float:
    """The share of positives among all rows, from histograms of a score over trusted positives and over all rows.

    Above any threshold there are at least as many rows as the positives among them, so the share of all rows above it, over the share of positives above it,
    is never less than the prior, and is the prior where no negative scores so high. The smallest such ratio is taken over thresholds that
    most positives (KEPT) exceed, where their share is certain.
    """
    above = lambda counts: counts[::-1].cumsum()[::-1] / max(1.0, counts.sum())
    p, u = above(positive), above(every)
    ratios = u[p >= KEPT] / p[p >= KEPT]
    return float(min(max(ratios.min(initial=1.0), 0.01), 0.99))


def in_training(doc_id: Column) -> Column:
    """The fold whose labels may be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, fitted on the training fold's labels."""
    rows = materialize(with_features(docs, doc_id, text), "quality-features")
    model = fit(rows, labels, in_training(F.col("__id")), doc_id)
    score = rows.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), model.score(F.col("x")).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
