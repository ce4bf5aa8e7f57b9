"""Signal: Bayesian online changepoint detection for each series, materiality, the gate and its priorities.

A run-length posterior needs every earlier point of its series, so a series is the unit of work: ``applyInPandas`` by
series, with state that is linear in its length. Series are many and short; none spans tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions.columns import half_even

#: Expected run lengths, thresholds, neighbourhood, windows and the sparse bar.
HAZARD, TOPIC_HAZARD = 15.0, 10.0
POSTERIOR, TOPIC_POSTERIOR = 0.75, 0.6
NEIGHBOURHOOD, RECENT_WEEKS, RECENT_MONTHS, SPARSE, LOOK_BACK, SAME_EVENT = 2, 12, 3, 8, 6, 2


def prior_of(series: np.ndarray) -> tuple[float, float, float, float]:
    """(mu, kappa, alpha, beta) from the series itself."""
    mean = float(series.mean())
    spread = float(series.var()) if len(series) > 1 else max(mean * mean * 0.01, 1.0)
    return mean, 1.0, 2.0, max(spread, 1e-6)


def shrunk_prior(baseline: np.ndarray) -> tuple[float, float, float, float]:
    """(mu, kappa, alpha, beta) from a sibling population, held more loosely."""
    return float(baseline.mean()), 0.5, 1.5, max(float(baseline.var()), 1e-6)


def run_lengths(series: np.ndarray, prior: tuple[float, float, float, float], hazard: float = HAZARD) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of run lengths 1, 2, ... after the last point, posterior of run length 1 after each point).

    A run's kappa and alpha depend on its length alone, so the state is three vectors. Posteriors are normalised with
    the mass 1/hazard of a run that begins next, which is then left out: they add up to 1 - 1/hazard.
    """
    mu0, kappa0, alpha0, beta0 = prior
    n = len(series)
    index = np.arange(n + 1)
    kappa, alpha = kappa0 + index, alpha0 + index / 2
    gamma_ratio = np.array([math.exp(math.lgamma(a + 0.5) - math.lgamma(a)) for a in alpha])
    weight, mu, beta = np.array([1.0]), np.array([mu0]), np.array([beta0])
    first = np.empty(n)
    for t, x in enumerate(series):
        k, a = kappa[: t + 1], alpha[: t + 1]
        scale2 = beta * (k + 1) / (a * k)
        density = gamma_ratio[: t + 1] / np.sqrt(2 * a * math.pi * scale2) * (1 + (x - mu) ** 2 / (2 * a * scale2)) ** (-(a + 0.5))
        joint = weight * density
        weight = np.append(joint.sum() / hazard, joint * (1 - 1 / hazard))
        weight /= weight.sum()
        beta = np.append(beta0, beta + k * (x - mu) ** 2 / (2 * (k + 1)))
        mu = np.append(mu0, (k * mu + x) / (k + 1))
        first[t] = weight[1]
    return weight[1:], first


def changepoint(last: np.ndarray) -> tuple[int, float]:
    """(tau, confidence): T - j + 1 for the likeliest index j, the first of equals, and the mass around it."""
    j = int(last.argmax())
    near = last[max(0, j - NEIGHBOURHOOD) : j + NEIGHBOURHOOD + 1]
    return len(last) - j + 1, float(near.sum())


def burst_onset(first: np.ndarray) -> tuple[int, float]:
    """(tau, confidence): where a run of length 1 is likeliest, from the second point on."""
    if len(first) < 2:
        return 0, 0.0
    i = 1 + int(first[1:].argmax())
    return i + 1, float(first[i])


def impact(values: np.ndarray, tau: int) -> tuple[float, float]:
    """(share, amount) that the mean from tau on differs by from the mean of up to six points before."""
    n = len(values)
    if n < 2:
        return 0.0, 0.0
    i = min(max(tau - 1, 1), n - 1)
    base, recent = float(values[max(0, i - LOOK_BACK) : i].mean()), float(values[i:].mean())
    return (0.0, 0.0) if base == 0 else ((recent - base) / base, recent - base)


RESULT = "kpi string, region string, period_unit string, n_observations int, n_trimmed int, sparse_history boolean, tau int, confidence double, impact_pct double, impact_abs double"


def detect(series: DataFrame, hazard: float = HAZARD) -> DataFrame:
    """RESULT rows of (kpi, region, period_unit, period, value[, baseline array<double>]) series.

    Null values are trimmed and counted. A series of fewer than eight points is sparse; with a baseline of more than
    four points it takes the shrunk prior. A series without any value gives no row.
    """
    has_baseline = "baseline" in series.columns

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("period")
        values = frame["value"].dropna().to_numpy(np.float64)
        columns = [c.split(" ")[0] for c in RESULT.split(", ")]
        if not len(values):
            return pd.DataFrame(columns=columns).astype({"n_observations": "int32", "n_trimmed": "int32", "tau": "int32", "sparse_history": bool, "confidence": float, "impact_pct": float, "impact_abs": float})
        sparse = len(values) < SPARSE
        baseline = frame["baseline"].iloc[0] if has_baseline else None
        shrink = sparse and baseline is not None and len(baseline) > 4
        prior = shrunk_prior(np.asarray(baseline, np.float64)) if shrink else prior_of(values)
        tau, confidence = changepoint(run_lengths(values, prior, hazard)[0])
        share, amount = impact(values, tau)
        head = frame.iloc[0]
        return pd.DataFrame([(head["kpi"], head["region"], head["period_unit"], len(values), len(frame) - len(values), sparse, tau, confidence, share, amount)], columns=columns)

    return series.groupBy("kpi", "region", "period_unit").applyInPandas(one, RESULT)


def gate(results: DataFrame, kpis: DataFrame) -> DataFrame:
    """Adds both materialities, the gate and a narrative; ``kpis`` has (kpi, pct_threshold, abs_threshold), for a KPI and its parts, as in ``kpi (part)``.

    Confidence is rounded to 4 digits half-even for what is shown, but judged as it is.
    """
    n = F.col("n_observations")
    window = F.when(F.col("period_unit") == "month", RECENT_MONTHS).otherwise(RECENT_WEEKS)
    statistical = (F.col("confidence") > POSTERIOR) & (F.col("tau") > 1) & (F.col("tau") > n - window)
    business = (F.abs("impact_pct") >= F.col("pct_threshold")) | F.coalesce(F.abs("impact_abs") >= F.col("abs_threshold"), F.lit(False))
    limits = kpis.select(F.col("kpi").alias("__of"), "pct_threshold", "abs_threshold")
    out = results.join(limits, F.regexp_replace("kpi", r" \(.*\)$", "") == F.col("__of")).drop("__of")
    out = out.withColumn("statistical_materiality", statistical).withColumn("business_materiality", business)
    out = out.withColumn("gate_passed", F.col("statistical_materiality") & F.col("business_materiality") & ~F.col("sparse_history"))
    told = (
        F.when(F.col("sparse_history"), F.concat(F.lit("Only "), n.cast("string"), F.lit(" observations: too little history to gate on.")))
        .when(F.col("gate_passed"), F.format_string("Material: a change around period %d, %.1f%% impact.", F.col("tau"), F.col("impact_pct") * 100))
        .when(~F.col("statistical_materiality"), "Noise: no recent changepoint is likely enough.")
        .otherwise("Real but small: the change is below the business thresholds.")
    )
    return out.withColumn("narrative", told).drop("pct_threshold", "abs_threshold")


def same_events(movements: DataFrame) -> DataFrame:
    """(kpi, region, same_event_as): the other KPIs of the region that moved within two calendar weeks; movements without any are left out."""
    other = movements.select(F.col("region").alias("__r"), F.col("kpi").alias("__k"), F.col("calendar_week").alias("__w"))
    near = (F.col("region") == F.col("__r")) & (F.col("kpi") != F.col("__k")) & (F.abs(F.col("calendar_week") - F.col("__w")) <= SAME_EVENT)
    return movements.join(other, near).groupBy("kpi", "region").agg(F.array_sort(F.collect_list("__k")).alias("same_event_as"))


def impact_at(series: DataFrame, period: int) -> DataFrame:
    """(kpi, region, impact_pct, impact_abs) of each series from a period on; points are counted as they are, periods without one aren't."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("period")
        share, amount = impact(frame["value"].to_numpy(np.float64), 1 + int((frame["period"] < period).sum()))
        return pd.DataFrame([(frame["kpi"].iloc[0], frame["region"].iloc[0], share, amount)], columns=["kpi", "region", "impact_pct", "impact_abs"])

    return series.groupBy("kpi", "region").applyInPandas(one, "kpi string, region string, impact_pct double, impact_abs double")


def prioritize(gated: DataFrame) -> DataFrame:
    """Ranks what passed the gate by |impact| times confidence, and lists what else moved in the same region within two weeks.

    ``gated`` has calendar_week besides the gate's columns. Ties go to the smaller KPI name, then region.
    """
    score = F.abs(half_even(F.col("impact_abs"), 2)) * half_even(F.col("confidence"), 4)
    passed = gated.where("gate_passed").withColumn("priority_score", half_even(score, 2))
    ranked = passed.withColumn("priority_rank", F.row_number().over(Window.orderBy(F.desc("priority_score"), "kpi", "region")))
    same = same_events(passed)
    return ranked.join(same, ["kpi", "region"], "left").withColumn("same_event_as", F.coalesce("same_event_as", F.array().cast("array<string>")))
