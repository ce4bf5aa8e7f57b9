"""Investigations: which movements are looked into, with which claims and as whom; and a run from a gated series to verdicts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta.contract import CONTRACT, kpi_table
from veridelta.operators import adjudicate, predicate, signal


@dataclass(frozen=True)
class Investigation:
    """A region's KPI, the role that asks, its windows by calendar (week or month), and the claims to test, most wanted first."""

    region: str
    kpi: str
    role: str
    windows: dict[str, tuple]
    claims: tuple[dict, ...] = field(default=())

    def checked(self) -> list[predicate.Predicate]:
        """The claims, each validated; PredicateRejected if one can't be tested."""
        return [predicate.validate(c) for c in self.claims]


def kpi_series(panel: DataFrame, reps: DataFrame, categories: DataFrame, kpis: list[str], young: list[tuple[str, str, int]] = ()) -> DataFrame:
    """(kpi, region, period_unit, period, value, baseline): every series that is watched, for ``signal.detect``.

    ``panel`` has (region, week) and a column for each of the weekly ``kpis``; a null is a point that is trimmed. ``reps`` has (region, month,
    rep_attributed_revenue), a monthly series at its own cadence. ``young`` names (region, category, first week) of categories too new to have a prior of
    their own: theirs is drawn from all other categories' weeks in the region, their ``baseline``, out of ``categories`` (region, product_category, week, revenue).
    """
    named = ", ".join(f"'{k}', cast(`{k}` as double)" for k in kpis)
    weekly = panel.selectExpr("region", "week as period", f"stack({len(kpis)}, {named}) as (kpi, value)").withColumn("period_unit", F.lit("week"))
    months = reps.groupBy("region", "month").agg(F.sum("rep_attributed_revenue").cast("double").alias("value"))
    place = F.row_number().over(Window.partitionBy("region").orderBy("month"))  # a region's months
    monthly = months.select("region", place.alias("period"), F.lit("rep_attributed_revenue").alias("kpi"), "value", F.lit("month").alias("period_unit"))
    series = weekly.unionByName(monthly).withColumn("baseline", F.lit(None).cast("array<double>"))
    if not young:
        return series
    wanted = panel.sparkSession.createDataFrame(list(young), "region string, category string, since int")
    met = categories.join(wanted, "region")
    own = met.where((F.col("product_category") == F.col("category")) & (F.col("week") >= F.col("since")))
    others = met.where(F.col("product_category") != F.col("category")).groupBy("region", "category").agg(F.sort_array(F.collect_list(F.col("revenue").cast("double"))).alias("baseline"))  # weeks of a region's categories
    sparse = own.join(others, ["region", "category"], "left").select("region", F.col("week").alias("period"), F.concat(F.lit("new_category_revenue ("), "category", F.lit(")")).alias("kpi"), F.col("revenue").cast("double").alias("value"), F.lit("week").alias("period_unit"), "baseline")
    return series.unionByName(sparse)


def dose_test(spark: SparkSession, claim: dict, regions: list[str], role: str, pre: tuple, post: tuple, contract: dict = CONTRACT) -> DataFrame:
    """(n, rho, p, mde_rho, verdict) of a dose-response claim: the role is checked, its queries are compiled and run, and the strata judged.

    A region that the role may not see, or a claim of another kind, raises before any plan is made. Strata are regions by the claim's channels.
    """
    checked = predicate.validate(claim)
    if checked.archetype != "dose_response":
        raise predicate.PredicateRejected(f"{checked.archetype} isn't tested by dose")
    channels = sorted({*checked.treatment.values, *checked.control.values})
    queries = [(region, predicate.compile_dose(region, channels, pre[0], post[1], role, contract)) for region in regions]
    doses = outcomes = None
    for region, (dose, outcome) in queries:
        a = spark.sql(dose[0].rpartition(" ORDER BY ")[0], args=dose[1]).select(F.lit(region).alias("region"), F.col("unit").alias("channel"), "period", "value")
        b = spark.sql(outcome[0].rpartition(" ORDER BY ")[0], args=outcome[1]).select(F.lit(region).alias("region"), "period", "value")
        doses, outcomes = (a, b) if doses is None else (doses.unionByName(a), outcomes.unionByName(b))
    strata = adjudicate.dose_strata(doses, outcomes, pre, post)
    # relative changes that differ by rounding alone are ties
    return adjudicate.dose_response(strata.withColumn("dose_change", F.round("dose_change", 12)).withColumn("outcome_change", F.round("outcome_change", 12)))


def visible(facts: DataFrame, roles: DataFrame, region: str = "region", rep: str = "rep_id") -> DataFrame:
    """The facts that each role may see, by a join on regions; the rep is null where the role has no grant for it.

    ``roles`` has (role, regions, rep_detail), as ``contract.role_table``. A fact is a row for each role that sees it; no role sees a null region.
    """
    scope = roles.select("role", "rep_detail", F.explode(F.array_distinct("regions")).alias(region))
    met = facts.join(scope, region)
    return met.withColumn(rep, F.when(F.col("rep_detail") == "allow", F.col(rep))).drop("rep_detail")


def registry_table(spark: SparkSession, registry: list[Investigation]) -> DataFrame:
    """(region, kpi, role, hypothesis_id, preference): a row for each claim of each investigation."""
    rows = [(i.region, i.kpi, i.role, c["hypothesis_id"], k) for i in registry for k, c in enumerate(i.claims)]
    return spark.createDataFrame(rows, "region string, kpi string, role string, hypothesis_id string, preference int")


def attach(results: DataFrame, registry: DataFrame) -> DataFrame:
    """The results of series with the role and the number of claims of their investigation, null where none is registered."""
    per = registry.groupBy("region", "kpi").agg(F.first("role").alias("role"), F.count("*").alias("n_claims"))
    return results.join(per, ["region", "kpi"], "left")


def first_survivors(verdicts: DataFrame, registry: DataFrame) -> DataFrame:
    """(region, kpi, hypothesis_id): of each investigation the surviving claim that stands first in its own order."""
    survived = verdicts.where("verdict = 'SURVIVED'").select("hypothesis_id").distinct()
    return registry.join(survived, "hypothesis_id").groupBy("region", "kpi").agg(F.min_by("hypothesis_id", "preference").alias("hypothesis_id"))


def run(spark: SparkSession, series: DataFrame, registry: list[Investigation], contract: dict = CONTRACT, kpis: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(gated results, verdicts): changepoints of all series, the gate, and verdicts on the claims of those that passed.

    The gate decides what is looked into: an investigation whose series did not pass compiles and reads nothing. Each claim is
    compiled under its investigation's role, which is checked before any plan is made. Without a passing
    series there are no verdicts (None). The compiled queries read the registered views.
    """
    gated = signal.gate(signal.detect(series), kpis if kpis is not None else kpi_table(spark, contract))
    passed = {(r["region"], r["kpi"]) for r in gated.where("gate_passed").select("region", "kpi").collect()}  # one row for each series at most
    panel = None
    for one in registry:
        if (one.region, one.kpi) not in passed:
            continue
        for claim in one.checked():
            rows = predicate.unit_panel(spark, predicate.compile_predicate(claim, one.region, one.role, one.windows, contract))
            rows = rows.withColumn("period", F.col("period").cast("string"))
            panel = rows if panel is None else panel.unionByName(rows)
    return gated, None if panel is None else adjudicate.verdicts(panel)
