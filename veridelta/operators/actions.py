"""Actions: operational capacity, projections, recommendations, routing, briefs and feedback."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.contract import CONTRACT
from veridelta.functions.columns import half_even

#: Fixed value: the standard normal's 95 % quantile, for bands of 90 %.
BAND = 1.645


def rep_capacity(reps: DataFrame, contract: dict = CONTRACT) -> DataFrame:
    """(region, month, n_departed, accounts_needed, headroom, fits, shortfall) of each region's latest month.

    Accounts of departed reps have to fit under the remaining reps' ceiling.
    """
    limit = contract["constraints"]["max_accounts_per_rep"]
    last = reps.groupBy("region").agg(F.max("month").alias("__last"))
    now = reps.join(last, "region").where(F.col("month") == F.col("__last"))
    gone = F.col("attrition_date").isNotNull()
    sums = now.groupBy("region", "month").agg(F.count(F.when(gone, 1)).alias("n_departed"), F.coalesce(F.sum(F.when(gone, F.col("assigned_accounts"))), F.lit(0)).alias("accounts_needed"), F.coalesce(F.sum(F.when(~gone, F.greatest(F.lit(0), F.lit(limit) - F.col("assigned_accounts")))), F.lit(0)).alias("headroom"))
    return sums.withColumn("fits", F.col("accounts_needed") <= F.col("headroom")).withColumn("shortfall", F.greatest(F.lit(0), F.col("accounts_needed") - F.col("headroom")))


def center_capacity(ops: DataFrame, contract: dict = CONTRACT) -> DataFrame:
    """(fulfillment_center, month, days_to_clear, days_with_overtime, fits) of each centre's latest month; null days where a backlog never clears."""
    limits = contract["constraints"]
    latest = ops.groupBy("fulfillment_center").agg(F.max_by(F.struct("month", "orders_backlog", "daily_incoming_orders", "daily_processing_capacity_orders"), "month").alias("o")).select("fulfillment_center", "o.*")
    boost = 1 + limits["max_overtime_capacity_boost_pct"] / 100

    def days(capacity: Column) -> Column:
        spare = capacity - F.col("daily_incoming_orders")
        return F.when(spare > 0, F.col("orders_backlog") / spare)

    out = latest.withColumn("days_to_clear", days(F.col("daily_processing_capacity_orders"))).withColumn("days_with_overtime", days(F.col("daily_processing_capacity_orders") * boost))
    return out.select("fulfillment_center", "month", "days_to_clear", "days_with_overtime", F.coalesce(F.col("days_with_overtime") <= limits["backlog_clear_target_days"], F.lit(False)).alias("fits"))


def counterfactual(panel: DataFrame, pre: tuple[int, int], recent: tuple[int, int], weeks_ahead: int = 4) -> DataFrame:
    """(region, week, scenario, value, ci_low, ci_high): the recent level going on, and a straight recovery to the earlier one."""
    was, now = F.col("week").between(*pre), F.col("week").between(*recent)
    base = panel.groupBy("region").agg(F.max("week").alias("last"), F.avg(F.when(was, F.col("revenue"))).alias("pre"), F.avg(F.when(now, F.col("revenue"))).alias("level"), F.coalesce(F.stddev_samp(F.when(was, F.col("revenue"))), F.lit(0.0)).alias("sd"))
    steps = base.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(weeks_ahead))))
    both = steps.select("region", (F.col("last") + F.col("i")).alias("week"), "sd", F.explode(F.create_map(F.lit("no_action"), F.col("level"), F.lit("recovery"), F.col("level") + F.col("i") / weeks_ahead * (F.col("pre") - F.col("level")))).alias("scenario", "value"))
    return both.select("region", "week", "scenario", "value", (F.col("value") - BAND * F.col("sd")).alias("ci_low"), (F.col("value") + BAND * F.col("sd")).alias("ci_high"))


def delivery_channel(has_action: Column, confidence: Column, channels: Column) -> tuple[Column, Column]:
    """(channel, urgency): urgent only with an action of high confidence and a channel that pushes; unknown roles read the dashboard."""
    push = F.coalesce(F.size(channels) > 1, F.lit(False)) & has_action
    urgent = push & F.coalesce(F.startswith(confidence, F.lit("High")), F.lit(False))
    return F.when(push, F.get(channels, F.lit(0))).otherwise("dashboard"), F.when(urgent, "urgent_push").when(push, "routine_push").otherwise("pull_only")


def survivors(verdicts: DataFrame, region: str, kpi: str) -> DataFrame:
    """Surviving verdicts of one investigation."""
    tagged = verdicts.withColumn("region", F.coalesce("region", F.lit("West"))).withColumn("kpi", F.coalesce("kpi", F.lit("revenue")))
    return tagged.where((F.col("region") == region) & (F.col("kpi") == kpi) & (F.col("verdict") == "SURVIVED"))


def primaries(rows: DataFrame, by: str, p: str = "p_bh", name: str = "hypothesis_id") -> DataFrame:
    """(by, name): of each group the row with the smallest p, a missing one counting as 1, of equals the smallest name."""
    return rows.groupBy(by).agg(F.min_by(name, F.struct(F.coalesce(F.col(p), F.lit(1.0)).alias("p"), F.col(name).alias("name"))).alias(name))


def primary(rows: DataFrame) -> dict | None:
    """The survivor with the smallest adjusted p; a missing one counts as 1."""
    found = rows.orderBy(F.coalesce("p_bh", F.lit(1.0)), "hypothesis_id").first()
    return found.asDict(recursive=True) if found else None


def treatment_values(spark: SparkSession, hypotheses: list[str], fixtures: list[dict], generated: list[dict]) -> DataFrame:
    """(hypothesis_id, treatment): what each hypothesis was tested on; fixtures come before generated predicates."""
    ranked = [(r["hypothesis_id"], r["treatment"]["in"], k) for k, source in enumerate((fixtures, generated)) for r in source if r["hypothesis_id"] in set(hypotheses)]
    rows = spark.createDataFrame(ranked, "hypothesis_id string, treatment array<string>, k int")
    return rows.groupBy("hypothesis_id").agg(F.min_by("treatment", "k").alias("treatment"))


def action_key(region: str, evidence: dict, context: dict | None, config: dict) -> str:
    """24 hex digits that name a recommendation by all that it depends on."""
    return hashlib.sha256(json.dumps([region, evidence, context, config], sort_keys=True, default=str).encode()).hexdigest()[:24]


def operational_context(dim: str, region: str, treatment: list[str], sources: dict[str, DataFrame], contract: dict = CONTRACT) -> dict | None:
    """The capacity figures that belong to a dimension; None for dimensions without any or where the source is missing."""
    if dim == "rep_id" and sources.get("crm_headcount") is not None:
        row = rep_capacity(sources["crm_headcount"].where(F.col("region") == region), contract).first()
    elif dim == "fulfillment_center" and sources.get("fulfillment_center_ops") is not None:
        row = center_capacity(sources["fulfillment_center_ops"].where(F.col("fulfillment_center").isin(treatment)), contract).first()
    else:
        row = None
    return row.asDict() if row else None


def fallback_action(region: str, best: dict, context: dict | None) -> dict:
    """A recommendation by rule: medium confidence with operational figures, else low; phased where it doesn't fit."""
    if context is None:
        what = f"Investigate {best['hypothesis_id']} in {region} with its owners."
    elif context["fits"]:
        what = f"Act on {best['hypothesis_id']} in {region} now: there is capacity for it."
    elif "shortfall" in context:
        what = f"Act on {best['hypothesis_id']} in {region} in phases: {context['shortfall']} accounts have no room yet."
    else:
        what = f"Escalate {best['hypothesis_id']} in {region}: the backlog does not clear in time even with overtime."
    return {"has_action": True, "action": what, "confidence": "Medium" if context else "Low", "hypothesis_id": best["hypothesis_id"], "operational_context": context}


def recommend(ledger, region: str, kpi: str, verdicts: DataFrame, treatment: list[str], sources: dict[str, DataFrame], proposer=None, config: dict | None = None, contract: dict = CONTRACT) -> dict:
    """The recommendation for an investigation, from the cache if all its inputs are the same; ``proposer`` may word it, and falls back to the rule."""
    best = primary(survivors(verdicts, region, kpi))
    if best is None:
        return {"has_action": False}
    context = operational_context(best.get("dim"), region, treatment, sources, contract)
    key = action_key(region, {"hypothesis_id": best["hypothesis_id"], "verdict": best["verdict"], "p_bh": best.get("p_bh")}, context, config or {})
    hit = ledger.cache_get("action", key)
    if hit is not None:
        return json.loads(hit)
    start = time.perf_counter()
    made = fallback_action(region, best, context)
    if proposer is not None:
        try:
            made |= proposer(best, context)
        except (ValueError, KeyError, OSError) as e:
            made["note"] = f"the proposer failed: {e}"
    ledger.cache_put("action", key, (config or {}).get("backend", "none"), json.dumps(made, default=str))
    with ledger.span(f"{int(time.time())}", "action_recommendation", is_llm_call=proposer is not None, latency_ms=(time.perf_counter() - start) * 1000):
        pass
    return made


def brief(persona: str, headline: str, verdicts: list[dict], action: dict, telemetry: list[dict] | None = None) -> str:
    """A persona's text: an operations manager gets the evidence, an executive the headline, an engineer the statistics."""
    survived = [v for v in verdicts if v["verdict"] == "SURVIVED"]
    lines = [headline]
    if persona == "exec_vp":
        lines += [f"{len(survived)} of {len(verdicts)} explanations survive." if survived else "No explanation survives yet."]
    elif persona == "engineer":
        lines += [f"{v['hypothesis_id']}: {v['verdict']} effect={v.get('did_effect')} se={v.get('did_se')} p={v.get('p')} p_bh={v.get('p_bh')} mde={v.get('mde')}" for v in verdicts]
        lines += [f"{t['stage']}: {t['latency_ms']:.0f} ms" for t in telemetry or []]
    else:
        lines += [f"{v['verdict']}: {v['hypothesis_id']}. {v.get('reason') or ''}".rstrip() for v in verdicts]
    if action.get("has_action"):
        lines.append(f"Action ({action['confidence']} confidence): {action['action']}")
    return "\n".join(lines)


def submit_feedback(ledger, run_id: str, original_id: str, role: str, text: str, counter: dict, adjudicate) -> dict:
    """Tests an analyst's counter-predicate as a family of one and logs both; the original is downgraded if the counter survives.

    ``adjudicate`` turns a raw predicate into its one-row verdict table, and raises for what it rejects or denies.
    """
    from veridelta.operators.ledger import latest_verdicts

    known = latest_verdicts(ledger.read("ledger")).where(F.col("hypothesis_id") == original_id).select("verdict").first()
    outcome = adjudicate(counter)
    row = outcome.first()
    ledger.write_verdicts(run_id, outcome)
    ledger.append_rows("feedback", [{"run_id": run_id, "original_hypothesis_id": original_id, "original_verdict": known[0] if known else None, "analyst_role": role, "correction_text": text, "counter_hypothesis_id": row["hypothesis_id"], "counter_verdict": row["verdict"]}])
    return {"counter_verdict": row["verdict"], "downgraded": row["verdict"] == "SURVIVED"}


def series_of(panel: DataFrame, region: str, kpi: str) -> DataFrame:
    """(period, value) of a KPI in a region, in order; an unknown KPI is an error."""
    if kpi not in panel.columns:
        raise ValueError(f"unknown KPI {kpi}")
    period = "week" if "week" in panel.columns else "month"
    return panel.where(F.col("region") == region).select(F.col(period).alias("period"), F.col(kpi).alias("value")).orderBy("period")


def summary_for_role(gated: DataFrame, role: str, kpis: DataFrame, contract: dict = CONTRACT) -> DataFrame:
    """The signal results of the KPIs whose domains a role may see; a result's KPI is its name's first word."""
    domains = contract["entitlements"].get(role, {}).get("domains", [])
    return gated.withColumn("__name", F.split("kpi", " ")[0]).join(kpis.select(F.col("kpi").alias("__name"), "domain"), "__name").where(F.col("domain").isin(domains)).drop("__name", "domain")


def rounded(rows: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Half-even rounding of some columns, for what is shown."""
    for c in columns:
        rows = rows.withColumn(c, half_even(F.col(c), digits))
    return rows
