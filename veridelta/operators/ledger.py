"""The append-only ledger: a Parquet folder for each table, and the views over them that a user asks for.

Rows are never changed. A cache's latest row for a key wins, and its hits are rows of their own, so that no row needs an
update; clearing a cache appends a row that hides what was before.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta import contract as contracts
from veridelta.functions.columns import half_even
from veridelta.sources.tables import is_missing

#: Columns of each table besides created_at and seq.
TABLES = {
    "ledger": "run_id string, hypothesis_id string, test_archetype string, verdict string, reason string, did_effect_pct double, did_pvalue_raw double, did_pvalue_bh double, mde_pct double, plausible_effect_pct double, predicted_direction string, predicted_magnitude_pct double, scored_outcome string, treatment_sql_hash string, control_sql_hash string, treatment_sql string, control_sql string, dim string",
    "telemetry": "run_id string, stage string, is_llm_call boolean, model string, tokens_in bigint, tokens_out bigint, latency_ms double, estimated_cost_usd double",
    "feedback": "run_id string, original_hypothesis_id string, original_verdict string, analyst_role string, correction_text string, counter_hypothesis_id string, counter_verdict string",
    "run_snapshots": "run_id string, l1_posteriors array<double>, l1_gate_pass_rate double, did_effects array<double>, did_mdes array<double>",
    "entitlement_checks": "run_id string, check_type string, role string, scope string, region string, allowed boolean, reason string",
    "gated_movements": "run_id string, kpi string, region string, week int, business_impact_pct double, confidence double",
    "alerts": "run_id string, kpi string, region string, week int, business_impact_pct double, confidence double, role string, channel string, urgency string, message string, simulated boolean",
    "delivery_log": "run_id string, role string, persona string, channel string, urgency string, message_preview string, simulated boolean",
    "cache": "cache string, cache_key string, model string, result_json string, kind string",
}


def schema_of(name: str) -> str:
    return TABLES[name] + ", created_at timestamp, seq decimal(38,0)"


class Ledger:
    """Tables under one folder. One writer at a time; readers need no lock."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.batch = spark, folder, time.time_ns() // 1_000_000

    def read(self, name: str) -> DataFrame:
        """A table; empty where nothing was written. Columns that an older file lacks are null."""
        try:
            return self.spark.read.schema(schema_of(name)).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if not is_missing(e):
                raise
            return self.spark.createDataFrame([], schema_of(name))

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows; columns that they lack are null, others are dropped. seq grows from batch to batch and within one."""
        self.batch = max(self.batch + 1, time.time_ns() // 1_000_000)
        fields = self.spark.createDataFrame([], TABLES[name]).schema.fields
        have = {c.lower() for c in rows.columns}
        cells = [(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        stamped = rows.select(*cells, F.current_timestamp().alias("created_at"), (F.lit(self.batch).cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + F.monotonically_increasing_id()).cast("decimal(38,0)").alias("seq"))
        stamped.write.mode("append").parquet(f"{self.folder}/{name}")

    def append_rows(self, name: str, rows: list[dict]) -> None:
        fields = self.spark.createDataFrame([], TABLES[name]).schema
        self.append(name, self.spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields))

    def write_verdicts(self, run_id: str, verdicts: DataFrame) -> None:
        """Verdict rows in per cent; direction and magnitude are predicted by survivors alone."""
        survived = F.col("verdict") == "SURVIVED"
        pct = lambda c: half_even(F.col(c) * 100, 4)
        self.append("ledger", verdicts.select(
            "*", F.lit(run_id).alias("run_id"), pct("did_effect").alias("did_effect_pct"), F.col("p").alias("did_pvalue_raw"), F.col("p_bh").alias("did_pvalue_bh"), pct("mde").alias("mde_pct"), pct("plausible_effect").alias("plausible_effect_pct"),
            F.when(survived, "decrease").alias("predicted_direction"), F.when(survived, F.abs(pct("did_effect"))).alias("predicted_magnitude_pct"), F.lit("uncalibrated").alias("scored_outcome"),
        ))

    @contextmanager
    def span(self, run_id: str, stage: str, is_llm_call: bool = False, model: str | None = None, tokens_in: int = 0, tokens_out: int = 0, cost: float = 0.0, latency_ms: float | None = None) -> Iterator[None]:
        """Times a stage and appends it to the telemetry, also when it fails."""
        start = time.perf_counter()
        try:
            yield
        finally:
            taken = latency_ms if latency_ms is not None else (time.perf_counter() - start) * 1000
            self.append_rows("telemetry", [{"run_id": run_id, "stage": stage, "is_llm_call": is_llm_call, "model": model, "tokens_in": tokens_in, "tokens_out": tokens_out, "latency_ms": taken, "estimated_cost_usd": cost}])

    def check(self, run_id: str | None, role: str, region: str | None, scope: str, kind: str, contract: dict = contracts.CONTRACT) -> None:
        """An entitlement check (kind "dim" or "domain") that is logged, then raised if denied."""
        call = (contracts.check_entitlement, role, region, scope, contract) if kind == "dim" else (contracts.check_domain, role, scope, contract)
        ok, reason = contracts.allowed(*call)
        self.append_rows("entitlement_checks", [{"run_id": run_id, "check_type": kind, "role": role, "scope": scope, "region": region, "allowed": ok, "reason": reason}])
        if not ok:
            raise contracts.EntitlementDenied(reason)

    def snapshot(self, run_id: str, gated: DataFrame, verdicts: DataFrame) -> None:
        """A run's posteriors, the share of series that passed the gate, and absolute and detectable effects of the claims that panels tested (placebo, specificity)."""
        if "test_archetype" in verdicts.columns:
            verdicts = verdicts.where(F.col("test_archetype").isin("placebo", "specificity"))
        left = gated.agg(F.collect_list("confidence").alias("l1_posteriors"), F.avg(F.col("gate_passed").cast("double")).alias("l1_gate_pass_rate"))
        right = verdicts.agg(F.collect_list(F.abs("did_effect")).alias("did_effects"), F.collect_list("mde").alias("did_mdes"))  # one number for each series and hypothesis of a run
        self.append("run_snapshots", left.join(right, F.lit(True)).withColumn("run_id", F.lit(run_id)))

    def movements(self, run_id: str, gated: DataFrame) -> None:
        passed = gated.where("gate_passed")
        self.append("gated_movements", passed.select(F.lit(run_id).alias("run_id"), "kpi", "region", F.col("tau").alias("week"), F.col("impact_pct").alias("business_impact_pct"), "confidence"))

    def alerts(self, run_id: str, routed: DataFrame) -> None:
        """Appends routed alerts (kpi, region, week, business_impact_pct, confidence, role, channel, urgency[, message]), all of them simulated."""
        self.append("alerts", routed.withColumn("run_id", F.lit(run_id)).withColumn("simulated", F.lit(True)))

    def deliver(self, run_id: str, role: str, channel: str, urgency: str, message: str, contract: dict = contracts.CONTRACT) -> None:
        """A simulated delivery; 280 characters of its message are kept."""
        persona = contract["entitlements"].get(role, {}).get("persona")
        self.append_rows("delivery_log", [{"run_id": run_id, "role": role, "persona": persona, "channel": channel, "urgency": urgency, "message_preview": message[:280], "simulated": True}])

    def cache_put(self, cache: str, key: str, model: str, result_json: str) -> None:
        self.append_rows("cache", [{"cache": cache, "cache_key": key, "model": model, "result_json": result_json, "kind": "put"}])

    def cache_get(self, cache: str, key: str) -> str | None:
        """The latest value of a key, and a hit for it; None if there is none."""
        found = cache_view(self.read("cache")).where((F.col("cache") == cache) & (F.col("cache_key") == key)).select("result_json").first()
        if found is None:
            return None
        self.append_rows("cache", [{"cache": cache, "cache_key": key, "kind": "hit"}])
        return found[0]

    def cache_clear(self, cache: str) -> None:
        self.append_rows("cache", [{"cache": cache, "kind": "clear"}])

    def tail(self, name: str, limit: int) -> DataFrame:
        return self.read(name).orderBy(F.desc("seq")).limit(limit)


def cache_view(rows: DataFrame) -> DataFrame:
    """(cache, cache_key, model, result_json, hit_count, last_hit_at) from a cache's puts, hits and clears."""
    cleared = rows.where("kind = 'clear'").groupBy("cache").agg(F.max("seq").alias("__cleared"))
    live = rows.where("kind != 'clear'").join(cleared, "cache", "left").where("__cleared is null or seq > __cleared")
    put = F.col("kind") == "put"
    agg = live.groupBy("cache", "cache_key").agg(
        F.max_by(F.when(put, F.struct("model", "result_json")), F.when(put, F.col("seq"))).alias("v"), F.count(F.when(~put, 1)).alias("hit_count"), F.max(F.when(~put, F.col("created_at"))).alias("last_hit_at"),
    )
    return agg.where("v is not null").select("cache", "cache_key", "v.model", "v.result_json", "hit_count", "last_hit_at")


def run_id() -> str:
    return uuid.uuid4().hex[:8]


def merge_verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both verdict tables, columns by name; rows without a region or KPI get the first investigation's."""
    both = old.unionByName(new, allowMissingColumns=True)
    for name, value in (("region", "West"), ("kpi", "revenue")):
        both = both.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in both.columns else F.lit(value))
    return both


def with_fresh_ids(old: DataFrame, new: DataFrame, key: str = "hypothesis_id") -> DataFrame:
    """New rows, those whose id is taken renamed to <id>_llm2, _llm3 and so on, after any such names that exist."""
    stem, number = F.regexp_replace(key, r"_llm\d+$", ""), F.regexp_extract(key, r"_llm(\d+)$", 1)
    taken = old.select(stem.alias("__stem"), F.when(number == "", 1).otherwise(number.cast("int")).alias("__n")).groupBy("__stem").agg(F.max("__n").alias("__last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*new.columns), F.to_json(F.struct(*new.columns))))
    rows = new.withColumn("__place", place).join(taken, F.col(key) == F.col("__stem"), "left")
    count = F.coalesce("__last", F.lit(0)) + F.col("__place")
    return rows.withColumn(key, F.when(count > 1, F.concat(F.col(key), F.lit("_llm"), count.cast("string"))).otherwise(F.col(key))).drop("__place", "__stem", "__last")


def tail(rows: DataFrame, n: int = 200) -> DataFrame:
    """The last ``n`` rows of a log, latest first."""
    return rows.orderBy(F.desc("seq")).limit(n)


def recent_telemetry(rows: DataFrame, n: int = 200) -> DataFrame:
    """The last ``n`` rows of the telemetry, latest first, with in_latest_run: whether they belong to the pipeline run that was written last."""
    newest = rows.where(session_kind("run_id") == "pipeline").agg(F.max_by("run_id", "seq").alias("__run"))
    return tail(rows, n).join(newest, F.lit(True)).withColumn("in_latest_run", F.coalesce(F.col("run_id") == F.col("__run"), F.lit(False))).drop("__run")


def with_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column begins with a prefix, such as the adversarial runs of a log."""
    return rows.where(F.col(column).startswith(prefix))


def latest_verdicts(ledger: DataFrame) -> DataFrame:
    """The last row of each hypothesis."""
    columns = [c for c in ledger.columns if c != "hypothesis_id"]
    return ledger.groupBy("hypothesis_id").agg(F.max_by(F.struct(*columns), "seq").alias("__v")).select("hypothesis_id", *[F.col(f"__v.{c}").alias(c) for c in columns])


def contradictions(ledger: DataFrame, legacy: bool = False) -> DataFrame:
    """(n_survivors, n_evidence, survivors, kind): whether several hypotheses survive, and on the same evidence or on independent.

    The last verdict of each hypothesis counts; the legacy way takes its last survival, whatever came later. No row with
    fewer than two survivors.
    """
    rows = latest_verdicts(ledger.where("verdict = 'SURVIVED'")) if legacy else latest_verdicts(ledger).where("verdict = 'SURVIVED'")
    found = rows.agg(F.count("*").alias("n_survivors"), F.countDistinct(F.struct("treatment_sql_hash", "control_sql_hash")).alias("n_evidence"), F.array_sort(F.collect_list("hypothesis_id")).alias("survivors"))
    return found.where("n_survivors >= 2").withColumn("kind", F.when(F.col("n_evidence") == 1, "SAME_EVIDENCE_RETEST").otherwise("INDEPENDENT_CONTRADICTION"))


def telemetry_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens, cost and latency, of model calls and of the rest, by keys."""
    model = F.col("is_llm_call")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_stages"), F.count(F.when(model, 1)).alias("n_llm_calls"), F.count(F.when(~model, 1)).alias("n_deterministic"), F.sum(F.when(model, F.col("tokens_in")).otherwise(0)).alias("tokens_in"),
        F.sum(F.when(model, F.col("tokens_out")).otherwise(0)).alias("tokens_out"), F.sum("estimated_cost_usd").alias("cost_usd"), F.sum("latency_ms").alias("latency_ms"),
    )


def session_kind(run: str):
    """Whether a run id is a pipeline's (8 hex digits) or a session's."""
    return F.when(F.col(run).rlike("^[0-9a-f]{8}$"), "pipeline").otherwise("session")
