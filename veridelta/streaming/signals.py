"""Streaming forms: watermarked counts, and changepoint detection whose state is one series' run lengths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from veridelta.operators.signal import HAZARD, NEIGHBOURHOOD

STATE = "weight array<double>, mu array<double>, beta array<double>, run array<long>, seen long, period long"
#: Runs of a smaller posterior are forgotten.
LEAST = 1e-30
OUTPUT = "key string, period long, value double, tau int, confidence double"


def step(weight: np.ndarray, mu: np.ndarray, beta: np.ndarray, run: np.ndarray, x: float, prior: tuple[float, float, float, float], hazard: float, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One point's update of a run-length posterior, the same as the batch fold's; ``run`` holds the lengths of the runs that are kept."""
    mu0, kappa0, alpha0, beta0 = prior
    k, a = kappa0 + run, alpha0 + run / 2
    scale2 = beta * (k + 1) / (a * k)
    ratio = np.array([math.exp(math.lgamma(v + 0.5) - math.lgamma(v)) for v in a])
    joint = weight * ratio / np.sqrt(2 * a * math.pi * scale2) * (1 + (x - mu) ** 2 / (2 * a * scale2)) ** (-(a + 0.5))
    new = np.append(joint.sum() / hazard, joint * (1 - 1 / hazard))
    new /= new.sum()
    kept = new >= least
    return new[kept], np.append(mu0, (k * mu + x) / (k + 1))[kept], np.append(beta0, beta + k * (x - mu) ** 2 / (2 * (k + 1)))[kept], np.append(0, run + 1)[kept]


def change(weight: np.ndarray, run: np.ndarray, seen: int) -> tuple[int, float]:
    """``signal.changepoint`` of the runs that are kept, after ``seen`` points."""
    weight, run = weight[run > 0], run[run > 0]
    length = run[weight.argmax()]
    return int(seen - length + 2), float(weight[np.abs(run - length) <= NEIGHBOURHOOD].sum())


def windowed_counts(events: DataFrame, key: str, time: str, width: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(key, period, value): counts by key and window; periods are windows' starts in seconds, rows later than ``lateness`` are left out."""
    counts = events.withWatermark(time, lateness).groupBy(F.window(time, width), F.col(key).alias("key")).agg(F.count("*").cast("double").alias("value"))
    return counts.select(F.col("key").cast("string").alias("key"), F.unix_timestamp("window.start").alias("period"), "value")


def streaming_changepoints(values: DataFrame, prior: tuple[float, float, float, float], hazard: float = HAZARD, least: float = LEAST) -> DataFrame:
    """OUTPUT rows for each new (key, period, value): the run-length posterior so far, kept as state.

    Points of a key are taken in the order of their periods within a batch; one that isn't later than the last taken is
    left out, so a replayed batch changes nothing. Runs whose posterior falls under ``least`` are forgotten, whatever their
    length; the number of points seen is kept, so tau is a place in the whole series. In a stable series that may be
    none of them: state then grows with the series.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            weight, mu, beta, run, seen, last = *map(np.array, state.get[:4]), *state.get[4:]
        else:
            weight, mu, beta, run, seen, last = np.array([1.0]), np.array([prior[0]]), np.array([prior[3]]), np.array([0]), 0, None
        rows = []
        for period, value in pd.concat(list(frames)).sort_values("period")[["period", "value"]].itertuples(index=False):
            if last is not None and period <= last:
                continue
            weight, mu, beta, run = step(weight, mu, beta, run, float(value), prior, hazard, least)
            last, seen = int(period), seen + 1
            tau, confidence = change(weight, run, seen)
            rows.append((key[0], last, float(value), tau, confidence))
        if last is not None:
            state.update((weight.tolist(), mu.tolist(), beta.tolist(), run.tolist(), seen, last))
        yield pd.DataFrame(rows, columns=["key", "period", "value", "tau", "confidence"])

    return values.groupBy("key").applyInPandasWithState(update, OUTPUT, STATE, "append", "NoTimeout")


def alert_stream(changepoints: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Points whose series has a likely change."""
    return changepoints.where((F.col("confidence") > threshold) & (F.col("tau") > 1))
