"""Adjudication: difference in differences, parallel trends, power, false discovery, precedence and dose response.

Every estimator is a set of sums by hypothesis, so one plan handles a whole family of hypotheses; only the power gate's
root finding and Student's t need Python, on one row for each hypothesis.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions import stats
from veridelta.functions.columns import average_rank, half_even, normal_two_sided

#: Significance, discovery rate, pre-trend level, plausible effect and correlation, clusters per side, strata.
ALPHA, FDR, PRETREND, PLAUSIBLE, PLAUSIBLE_RHO, CLUSTERS, STRATA, ONSET = 0.05, 0.10, 0.10, 0.10, 0.5, 4, 6, 0.6
H = ["hypothesis_id"]


def logged(panel: DataFrame) -> DataFrame:
    """The panel with y, the logarithm of a value of at least 1."""
    return panel.withColumn("y", F.log(F.greatest(F.col("value"), F.lit(1.0))))


def did(panel: DataFrame) -> DataFrame:
    """(hypothesis_id, n_treatment_units, n_control_units, effect, se, z, p, clustered) of log values on post and treat x post with unit effects.

    Unit effects are removed by demeaning (Frisch, Waugh and Lovell). Post and treatment take two values, so all sums follow from
    each unit's counts, means and squares before and after, which one aggregate gives: the panel is read and shuffled once, and the rest works on
    a row for each unit. Errors are clustered by unit with four units on both sides, else HC1. Effect, error and p are null where nothing
    identifies them.
    """
    c = F.col
    after, y = c("post") == 1, c("y")
    each = lambda when: (F.coalesce(F.avg(F.when(when, y)), F.lit(0.0)), F.coalesce(F.var_pop(F.when(when, y)), F.lit(0.0)))
    (mean1, var1), (mean0, var0) = each(after), each(~after)
    units = logged(panel).groupBy(*H, "unit", "treat").agg(F.count("*").alias("m"), F.count(F.when(after, 1)).alias("s"), mean1.alias("y1"), mean0.alias("y0"), var1.alias("v1"), var0.alias("v0"))
    units = units.withColumn("xx", c("s") * (c("m") - c("s")) / c("m")).withColumn("xy", c("xx") * (c("y1") - c("y0")))
    whole = Window.partitionBy(*H)  # units of a hypothesis
    treated = lambda e: F.when(c("treat") == 1, e).otherwise(0.0)
    total = lambda e, n: F.sum(e).over(whole).alias(n)
    units = units.select("*", total(c("xx"), "a11"), total(treated(c("xx")), "a12"), total(c("xy"), "b1"), total(treated(c("xy")), "b2")).withColumn("a22", c("a12"))
    det = c("a11") * c("a22") - c("a12") * c("a12")
    units = units.withColumn("det", F.when(det > 1e-9, det))
    units = units.withColumn("k1", (c("a22") * c("b1") - c("a12") * c("b2")) / c("det")).withColumn("k2", (c("a11") * c("b2") - c("a12") * c("b1")) / c("det"))
    share, slope = c("s") / c("m"), c("k1") + treated(c("k2"))
    middle = share * c("y1") + (1 - share) * c("y0")
    left = c("v1") + (c("y1") - middle - slope * (1 - share)) ** 2, c("v0") + (c("y0") - middle + slope * share) ** 2  # mean squared errors after and before
    units = units.withColumn("g", (c("xy") - slope * c("xx")) ** 2).withColumn("h", (1 - share) ** 2 * c("s") * left[0] + share**2 * (c("m") - c("s")) * left[1])
    all_ = units.groupBy(*H).agg(
        F.sum("m").alias("n"), F.count(F.when(c("treat") == 1, 1)).alias("n_treatment_units"), F.count(F.when(c("treat") == 0, 1)).alias("n_control_units"),
        F.sum("g").alias("c11"), F.sum(treated(c("g"))).alias("c22"), F.sum("h").alias("h11"), F.sum(treated(c("h"))).alias("h22"), *[F.first(x).alias(x) for x in ("a11", "a12", "a22", "det", "k1", "k2")],
    )
    all_ = all_.withColumn("c12", c("c22")).withColumn("h12", c("h22")).withColumn("units", c("n_treatment_units") + c("n_control_units"))
    all_ = all_.withColumn("clustered", (c("n_treatment_units") >= CLUSTERS) & (c("n_control_units") >= CLUSTERS))
    n, k, g = c("n"), c("units") + 2, c("units")
    hc1 = F.when(n > k, n / (n - k))
    scale = F.when(c("clustered"), g / (g - 1) * (n - 1) / F.when(n > k, n - k)).otherwise(hc1)
    m = {i: F.when(c("clustered"), c(f"c{i}")).otherwise(c(f"h{i}")) for i in ("11", "12", "22")}
    v = scale * (c("a12") ** 2 * m["11"] - 2 * c("a11") * c("a12") * m["12"] + c("a11") ** 2 * m["22"]) / c("det") ** 2
    out = all_.withColumn("se", F.when((c("units") >= 2) & v.isNotNull(), F.sqrt(F.greatest(v, F.lit(0.0)))))
    out = out.withColumn("effect", F.when(c("se").isNotNull(), c("k2"))).withColumn("z", F.when(c("se") > 0, c("effect") / c("se")))
    return out.withColumn("p", normal_two_sided(c("z"))).select(*H, "n_treatment_units", "n_control_units", "effect", "se", "z", "p", "clustered")


def parallel_trends(panel: DataFrame) -> DataFrame:
    """(hypothesis_id, slope_gap, pretrend_z, pretrend_p, pretrend_ok): whether both sides' log values had one slope before.

    Treatment is binary, so the interaction is the difference of two slopes, and its variance a sum over both sides: clustered
    by unit with four units on both, else HC1.
    With fewer than two earlier periods there is no answer: nulls, which block nothing.
    """
    pre = logged(panel).where("post = 0").withColumn("t", (F.dense_rank().over(Window.partitionBy(*H).orderBy("period")) - 1).cast("double"))
    side = Window.partitionBy(*H, "treat")
    pre = pre.withColumn("tc", F.col("t") - F.avg("t").over(side)).withColumn("yc", F.col("y") - F.avg("y").over(side))
    slopes = pre.groupBy(*H, "treat").agg(F.sum(F.col("tc") ** 2).alias("sxx"), (F.sum(F.col("tc") * F.col("yc")) / F.nullif(F.sum(F.col("tc") ** 2), F.lit(0.0))).alias("slope"), F.count("*").alias("m"), F.max("t").alias("last"))
    error = pre.join(slopes, [*H, "treat"]).withColumn("s", (F.col("yc") - F.col("slope") * F.col("tc")) * F.col("tc"))
    units = error.groupBy(*H, "treat", "unit").agg(F.sum("s").alias("g"), F.sum(F.col("s") ** 2).alias("h"))
    sides = units.groupBy(*H, "treat").agg(F.sum(F.col("g") ** 2).alias("g2"), F.sum("h").alias("h2"), F.count("*").alias("units")).join(slopes, [*H, "treat"])
    sign = F.when(F.col("treat") == 1, 1.0).otherwise(-1.0)
    both = sides.groupBy(*H).agg(
        F.sum(sign * F.col("slope")).alias("gap"), F.sum(F.col("g2") / F.col("sxx") ** 2).alias("vg"), F.sum(F.col("h2") / F.col("sxx") ** 2).alias("vh"),
        F.sum("m").alias("n"), F.count("slope").alias("sides"), F.max("last").alias("last"), F.sum("units").alias("g"), F.min("units").alias("least"),
    )
    n, g = F.col("n"), F.col("g")
    clustered = (F.col("least") >= CLUSTERS) & (F.col("sides") == 2)
    spare = F.when(n > 4, n - 4)
    se = F.sqrt(F.when(clustered, F.col("vg") * g / (g - 1) * (n - 1) / spare).otherwise(F.col("vh") * n / spare))
    usable = (F.col("sides") == 2) & (F.col("last") >= 1)
    z = F.when(usable & (se > 0), F.col("gap") / se)
    return both.select(*H, F.when(usable, F.col("gap")).alias("slope_gap"), z.alias("pretrend_z"), normal_two_sided(z).alias("pretrend_p")).withColumn("pretrend_ok", F.col("pretrend_p") >= PRETREND)


def benjamini_hochberg(tests: DataFrame, family: list[str], p: str = "p", key: str = "hypothesis_id") -> DataFrame:
    """Adds p_bh: the step-up adjusted p within a family; null p are outside of it. A family is one call's hypotheses: a few rows."""
    known = F.col(p).isNotNull()
    size = F.count(F.col(p)).over(Window.partitionBy(*family))
    rank = F.row_number().over(Window.partitionBy(*family, known).orderBy(F.col(p), F.col(key)))
    raw = F.when(known, F.col(p) * size / rank)
    down = Window.partitionBy(*family, known).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("__raw", raw).withColumn("__rank", rank).withColumn("p_bh", F.when(known, F.least(F.lit(1.0), F.min("__raw").over(down)))).drop("__raw", "__rank")


def power_gate(panel: DataFrame) -> DataFrame:
    """(hypothesis_id, treated_sd, n_treated, n_controls, mde): the effect that the panel could find; null where it can't be told."""
    rows = logged(panel)
    inside = F.col("y") - F.avg("y").over(Window.partitionBy(*H, "treat", "unit"))
    rows = rows.withColumn("d", inside)
    treated = F.col("treat") == 1
    sums = rows.groupBy(*H).agg(F.stddev_samp(F.when(treated, F.col("d"))).alias("treated_sd"), F.count(F.when(treated, 1)).alias("n_treated"), F.count(F.when(~treated, 1)).alias("n_controls"))

    @F.pandas_udf("double")
    def effect(n: pd.Series, m: pd.Series) -> pd.Series:
        found = [stats.detectable_effect(int(a), int(b)) for a, b in zip(n, m, strict=True)]
        return pd.Series([None if f == float("inf") else f for f in found], dtype="float64")

    return sums.withColumn("mde", F.when(F.col("treated_sd") > 0, effect("n_treated", "n_controls") * F.col("treated_sd")))


def verdicts(panel: DataFrame, family: Column | None = None) -> DataFrame:
    """One row for each hypothesis of a panel: estimates, adjusted p and the verdict, decided on rounded effect and power.

    The family of the discovery rate is the panel's hypotheses, or those that share a value of ``family``.
    """
    tests = did(panel).join(parallel_trends(panel), H, "left").join(power_gate(panel).select(*H, "mde"), H, "left")
    tests = benjamini_hochberg(tests.withColumn("family", family if family is not None else F.lit("all")), ["family"])
    effect, mde = half_even(F.col("effect"), 2), half_even(F.col("mde"), 2)
    weak = mde.isNull() | (mde > PLAUSIBLE)
    blocked = F.coalesce(~F.col("pretrend_ok"), F.lit(False))
    verdict = (
        F.when(F.col("effect").isNull() | F.col("p").isNull(), "INCONCLUSIVE").when(blocked, "INCONCLUSIVE")
        .when(F.col("p_bh") <= FDR, F.when(effect < 0, "SURVIVED").otherwise("KILLED")).when(weak, "INCONCLUSIVE").otherwise("KILLED")
    )
    reason = (
        F.when(F.col("effect").isNull() | F.col("p").isNull(), "the panel identifies no effect").when(blocked, "the sides' trends differed before")
        .when(F.col("p_bh") <= FDR, F.when(effect < 0, "significant, in the predicted direction").otherwise("significant, against the mechanism"))
        .when(weak, "not significant, and too weak to find a plausible effect").otherwise("not significant, though a plausible effect would have been found")
    )
    return tests.withColumn("did_effect", effect).withColumn("did_se", half_even(F.col("se"), 2)).withColumn("mde", mde).withColumn("plausible_effect", F.lit(PLAUSIBLE)).withColumn("verdict", verdict).withColumn("reason", reason).drop("effect", "se")


def precedence(onsets: DataFrame) -> DataFrame:
    """Adds the verdict on (topic_tau, topic_confidence, kpi_tau, kpi_confidence): a cause can't come after its effect; ties count as before."""
    sure = (F.col("topic_confidence") > ONSET) & (F.col("kpi_confidence") > ONSET)
    return onsets.withColumn("verdict", F.when(~sure, "INCONCLUSIVE").when(F.col("topic_tau") <= F.col("kpi_tau"), "SURVIVED").otherwise("KILLED"))


def dose_strata(dose: DataFrame, outcome: DataFrame, pre: tuple, post: tuple) -> DataFrame:
    """(region, channel, dose_change, outcome_change): relative changes of mean period totals; a region's outcome stands for each channel.

    ``dose`` has (region, channel, period, value), ``outcome`` (region, period, value).
    """

    def change(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        totals = rows.groupBy(*keys, "period").agg(F.sum("value").cast("double").alias("v"))
        was, now = (F.avg(F.when(F.col("period").between(*w), F.col("v"))) for w in (pre, post))
        return totals.groupBy(*keys).agg(was.alias("__a"), now.alias("__b")).select(*keys, ((F.col("__b") - F.col("__a")) / F.nullif(F.col("__a"), F.lit(0.0))).alias(name)).where(F.col(name).isNotNull())

    return change(dose, ["region", "channel"], "dose_change").join(change(outcome, ["region"], "outcome_change"), "region")


def dose_response(strata: DataFrame) -> DataFrame:
    """(n, rho, p, mde_rho, verdict): Spearman's correlation of dose and outcome over a few strata, with ties averaged."""
    ranked = strata.withColumn("__one", F.lit(1)).withColumn("a", average_rank(["__one"], "dose_change")).withColumn("b", average_rank(["__one"], "outcome_change"))
    rho = ranked.agg(F.count("*").alias("n"), F.corr("a", "b").alias("rho"))

    @F.pandas_udf("double")
    def p_of(n: pd.Series, r: pd.Series) -> pd.Series:
        def one(k, x):
            if k < 3 or pd.isna(x):
                return None
            return 0.0 if abs(x) >= 1 else stats.t_two_sided(x * ((k - 2) / (1 - x * x)) ** 0.5, k - 2)

        return pd.Series([one(int(k), x) for k, x in zip(n, r, strict=True)], dtype="float64")

    reach = F.when(F.col("n") > 3, F.tanh(F.lit(stats.Z_975 + stats.Z_80) / F.sqrt(F.col("n") - 3)))
    out = rho.withColumn("p", p_of("n", "rho")).withColumn("mde_rho", reach)
    good = (F.col("rho") > 0) & (F.col("p") < ALPHA)
    return out.withColumn("verdict", F.when(F.col("n") < STRATA, "INCONCLUSIVE").when(good, "SURVIVED").when(F.col("mde_rho") > PLAUSIBLE_RHO, "INCONCLUSIVE").otherwise("KILLED"))
