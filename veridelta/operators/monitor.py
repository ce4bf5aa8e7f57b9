"""Monitoring: drift of what runs report, calibration of what they claimed, and alerts on what is new."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions.columns import half_even

#: Added to each share, runs that a baseline needs, floors of an urgent alert.
EPS, MIN_RUNS, URGENT_IMPACT, URGENT_CONFIDENCE = 1e-4, 5, 0.05, 0.8


def psi(baseline: DataFrame, current: DataFrame, value: str = "value", buckets: int = 10) -> float | None:
    """Population stability index of two columns; None without enough values, infinite where a constant has moved.

    Edges are the baseline's exact quantiles, at most 11 numbers; counts are one aggregate for each side. Current
    values outside of the baseline's range are left out, as its definition here has it.
    """
    a = baseline.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    b = current.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    (n_a, mean_a), (n_b, mean_b) = (x.agg(F.count("*"), F.avg("v")).first() for x in (a, b))
    if n_a < 2 or n_b < 1:
        return None
    k = max(2, min(buckets, n_a // 5, n_b // 5))
    edges = sorted(set(a.agg(F.percentile("v", F.array(*[F.lit(i / k) for i in range(k + 1)]))).first()[0]))
    if len(edges) < 3:
        return 0.0 if math.isclose(mean_a, mean_b, rel_tol=1e-5, abs_tol=1e-6) else math.inf

    def counts(rows: DataFrame) -> list[int]:
        inside = [(F.col("v") >= lo) & ((F.col("v") <= hi) if i == len(edges) - 2 else (F.col("v") < hi)) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
        return list(rows.agg(*[F.count(F.when(c, 1)) for c in inside]).first())

    was, now = counts(a), counts(b)
    shares = [(x / sum(was) + EPS, y / max(sum(now), 1) + EPS) for x, y in zip(was, now, strict=True)]
    return sum((q - p) * math.log(q / p) for p, q in shares)


def psi_verdict_column(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), "UNKNOWN").when(value < 0.10, "STABLE").when(value < 0.25, "MODERATE_SHIFT").otherwise("SIGNIFICANT_DRIFT")


def psi_by_key(pairs: DataFrame, keys: list[str], buckets: int = 10) -> DataFrame:
    """(keys, n_baseline, n_current, psi): the index of many metrics in one plan. ``pairs`` has keys, is_current and value.

    Quantile edges are found per key, values are put in buckets by the number of edges below them, and shares compared. With
    fewer than three edges the baseline is all but constant: the index is then 0 if the means are alike, else infinite.
    """
    rows = pairs.where(F.col("value").isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count(F.when(~F.col("is_current"), 1)).alias("n_baseline"), F.count(F.when(F.col("is_current"), 1)).alias("n_current"), F.avg(F.when(~F.col("is_current"), F.col("value"))).alias("__was"), F.avg(F.when(F.col("is_current"), F.col("value"))).alias("__now"))
    k = F.greatest(F.lit(2), F.least(F.lit(buckets), F.floor(F.col("n_baseline") / 5), F.floor(F.col("n_current") / 5))).cast("int")
    base = rows.where(~F.col("is_current")).groupBy(*keys).agg(*[F.percentile("value", F.array(*[F.lit(i / n) for i in range(n + 1)])).alias(f"q{n}") for n in range(2, buckets + 1)])
    pick = F.coalesce(*[F.when(F.col("__k") == n, F.array_sort(F.array_distinct(f"q{n}"))) for n in range(2, buckets + 1)])
    edges = sizes.where("n_baseline >= 2 and n_current >= 1").withColumn("__k", k).join(base, keys).select(*keys, "n_baseline", "n_current", "__was", "__now", pick.alias("__edges"))
    inside = rows.join(edges, keys).where((F.size("__edges") >= 3) & F.col("value").between(F.get("__edges", F.lit(0)), F.get("__edges", F.size("__edges") - 1)))
    bucket = F.least(F.size(F.filter("__edges", lambda e: e <= F.col("value"))) - 1, F.size("__edges") - 2)
    counts = inside.groupBy(*keys, bucket.alias("__bucket")).agg(F.count(F.when(~F.col("is_current"), 1)).alias("__a"), F.count(F.when(F.col("is_current"), 1)).alias("__b"))
    every = edges.where(F.size("__edges") >= 3).select(*keys, "n_baseline", "n_current", F.explode(F.sequence(F.lit(0), F.size("__edges") - 2)).alias("__bucket")).join(counts, [*keys, "__bucket"], "left")
    whole = Window.partitionBy(*keys)
    p = F.coalesce("__a", F.lit(0)) / F.sum("__a").over(whole) + EPS
    q = F.coalesce("__b", F.lit(0)) / F.greatest(F.coalesce(F.sum("__b").over(whole), F.lit(0)), F.lit(1)) + EPS
    moved = F.abs(F.col("__was") - F.col("__now")) > F.greatest(F.lit(1e-5) * F.greatest(F.abs("__was"), F.abs("__now")), F.lit(1e-6))
    constant = edges.where(F.size("__edges") < 3).select(*keys, "n_baseline", "n_current", F.when(moved, F.lit(math.inf)).otherwise(0.0).alias("psi"))
    spread = every.withColumn("__p", p).withColumn("__q", q).groupBy(*keys, "n_baseline", "n_current").agg(F.sum((F.col("__q") - F.col("__p")) * F.log(F.col("__q") / F.col("__p"))).alias("psi"))
    return spread.unionByName(constant)


def pooled(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, value): the numbers of JSON arrays in a text column, one row each; null or malformed texts and null entries have none."""
    return rows.select(*keys, F.explode(F.from_json(column, "array<double>")).alias("value")).where("value is not null")


def sides(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows of both tables with a side: both, only_before or only_after."""
    seen = before.distinct().withColumn("__b", F.lit(1)).unionByName(after.distinct().withColumn("__b", F.lit(2)))
    which = F.when(F.sum("__b") == 3, "both").when(F.sum("__b") == 1, "only_before").otherwise("only_after")
    return seen.groupBy(*before.columns).agg(which.alias("side"))


def assess_drift(snapshots: DataFrame, run_id: str) -> DataFrame:
    """(metric, psi, verdict, n_baseline, n_current, mean_baseline, mean_current) of a run against all others, with an overall row of the worst verdict. An infinite index is null beside its verdict.

    ``snapshots`` has run_id, created_at and the arrays l1_posteriors, did_effects and did_mdes. With fewer than five
    earlier runs every verdict is UNKNOWN; with enough, unknown metrics, even all of them, don't keep the overall one from being STABLE.
    """
    metrics = ["l1_posteriors", "did_effects", "did_mdes"]
    tall = None
    for m in metrics:
        one = snapshots.select("run_id", F.lit(m).alias("metric"), F.explode(m).alias("value"))
        tall = one if tall is None else tall.unionByName(one)
    enough = snapshots.where(F.col("run_id") != run_id).select("run_id").distinct().agg((F.count("*") >= MIN_RUNS).alias("enough"))
    pairs = tall.withColumn("is_current", F.col("run_id") == run_id)
    found = psi_by_key(pairs, ["metric"])
    means = pairs.groupBy("metric").agg(F.avg(F.when(~F.col("is_current"), F.col("value"))).alias("mean_baseline"), F.avg(F.when(F.col("is_current"), F.col("value"))).alias("mean_current"))
    every = snapshots.sparkSession.createDataFrame([(m,) for m in metrics], "metric string").join(found, "metric", "left").join(means, "metric", "left").join(enough, F.lit(True))
    each = every.select("metric", F.when(F.col("enough"), F.col("psi")).alias("psi"), "n_baseline", "n_current", "mean_baseline", "mean_current").withColumn("verdict", psi_verdict_column(F.col("psi")))
    each = each.withColumn("psi", F.when(~F.col("psi").isin(math.inf, -math.inf), F.col("psi")))  # told by the verdict alone
    rank = F.when(F.col("verdict") == "SIGNIFICANT_DRIFT", 3).when(F.col("verdict") == "MODERATE_SHIFT", 2).when(F.col("verdict") == "STABLE", 1).otherwise(0)
    overall = each.join(enough, F.lit(True)).agg(F.max_by("verdict", rank).alias("__worst"), F.max("psi").alias("psi"), F.first("enough").alias("enough"))
    overall = overall.withColumn("verdict", F.when(F.col("enough") & (F.col("__worst") == "UNKNOWN"), "STABLE").otherwise(F.col("__worst")))
    overall = overall.select(F.lit("overall").alias("metric"), "psi", *[F.lit(None).cast(t).alias(c) for c, t in (("n_baseline", "long"), ("n_current", "long"), ("mean_baseline", "double"), ("mean_current", "double"))], "verdict")
    return each.unionByName(overall)


def gate_rates(snapshots: DataFrame, run_id: str) -> DataFrame:
    """(rate_baseline, rate_current): the share of series that passed the gate, on average over all other runs, and in this one."""
    mine = F.col("run_id") == run_id
    return snapshots.agg(F.avg(F.when(~mine, F.col("l1_gate_pass_rate"))).alias("rate_baseline"), F.avg(F.when(mine, F.col("l1_gate_pass_rate"))).alias("rate_current"))


def brier(predictions: DataFrame) -> DataFrame:
    """(n, brier) of (predicted, outcome) rows."""
    return predictions.agg(F.count("*").alias("n"), F.avg((F.col("predicted") - F.col("outcome")) ** 2).alias("brier"))


def reliability(predictions: DataFrame, bins: int = 5) -> DataFrame:
    """(bucket_lo, bucket_hi, n, mean_predicted, observed, gap) by bins of equal width, the last closed at 1."""
    known = predictions.where(F.col("predicted").between(0, 1))
    bucket = F.least(F.floor(F.col("predicted") * bins), F.lit(bins - 1))
    got = known.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.avg("predicted").alias("p"), F.avg(F.col("outcome").cast("double")).alias("o"))
    r = lambda c: half_even(c, 3)
    return got.select((F.col("b") / bins).alias("bucket_lo"), ((F.col("b") + 1) / bins).alias("bucket_hi"), "n", r(F.col("p")).alias("mean_predicted"), r(F.col("o")).alias("observed"), r(F.col("o") - F.col("p")).alias("gap"))


def isotonic(predictions: DataFrame, points: int = 11) -> DataFrame | None:
    """(raw, recalibrated): the monotone fit of outcomes on predictions at equally spaced points; None below three rows.

    The fit pools neighbours on the driver, so predictions are first rounded to a thousandth: however many rows there are, it gets 1,001 sums at most.
    """
    rows = predictions.select(F.round(F.col("predicted").cast("double"), 3).alias("predicted"), F.col("outcome").cast("double").alias("label"))
    if rows.limit(3).count() < 3:
        return None
    grouped = rows.groupBy("predicted").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    features = VectorAssembler(inputCols=["predicted"], outputCol="features")
    model = IsotonicRegression(weightCol="weight").fit(features.transform(grouped))
    asked = predictions.sparkSession.range(points).select((F.col("id") / (points - 1)).alias("predicted"))
    return model.transform(features.transform(asked)).select(half_even(F.col("predicted"), 2).alias("raw"), half_even(F.col("prediction"), 3).alias("recalibrated"))


def simulated_backtest(spark, n: int = 40, seed: int = 99) -> DataFrame:
    """(kind, predicted, outcome): made-up predictions that come true about as often as they say."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("rep_attrition", "fulfillment", "pricing", "marketing")]), (F.col("id") % 4 + 1).cast("int"))
    predicted = F.round(0.35 + 0.6 * F.rand(seed), 3)
    return spark.range(n).select(kinds.alias("kind"), predicted.alias("predicted"), F.rand(seed + 1).alias("u")).select("kind", "predicted", (F.col("u") < F.col("predicted")).cast("int").alias("outcome"))


def hit_rates(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("kind").agg(F.count("*").alias("n"), F.avg(F.col("outcome").cast("double")).alias("hit_rate"))


def urgency(impact: Column, confidence: Column) -> Column:
    return F.when((F.abs(impact) >= URGENT_IMPACT) & (confidence >= URGENT_CONFIDENCE), "urgent_push").otherwise("routine_push")


def new_movements(movements: DataFrame, run_id: str, runs: DataFrame, legacy: bool = False) -> DataFrame:
    """Movements of a run that the run before didn't have.

    The run before is the last of ``runs`` (run_id, seq); the legacy way looks for it among the movements, and so passes over
    runs without any. Without one, everything is new.
    """
    listed = movements.select("run_id", "seq").distinct() if legacy else runs
    mine = listed.where(F.col("run_id") == run_id).agg(F.max("seq").alias("__now"))
    prior = listed.where(F.col("run_id") != run_id).join(mine, F.lit(True)).where("__now is null or seq < __now").agg(F.max_by("run_id", "seq").alias("__prior"))
    before = movements.join(prior, F.col("run_id") == F.col("__prior"), "left_semi").select("kpi", "region").distinct()
    return movements.where(F.col("run_id") == run_id).join(before, ["kpi", "region"], "left_anti")


def route_alerts(new: DataFrame, kpis: DataFrame, roles: DataFrame) -> DataFrame:
    """A row for each new movement and role whose domains hold its KPI's: channel, urgency and message.

    Urgent alerts take the role's first channel if it has more than one; all else goes to the dashboard.
    """
    urgent = urgency(F.col("business_impact_pct"), F.col("confidence"))
    rows = new.withColumn("urgency", urgent).join(kpis.select("kpi", "domain"), "kpi").join(roles.select("role", "domains", "channels"), F.array_contains("domains", F.col("domain")))
    channel = F.when((F.col("urgency") == "urgent_push") & (F.size("channels") > 1), F.get("channels", F.lit(0))).otherwise("dashboard")
    message = F.format_string("%s in %s newly cleared the materiality gate: %+.1f%% impact at %.2f confidence.", "kpi", "region", F.col("business_impact_pct") * 100, F.col("confidence"))
    return rows.select("run_id", "kpi", "region", "week", "business_impact_pct", "confidence", "role", channel.alias("channel"), "urgency", message.alias("message"), F.lit(True).alias("simulated"))
