"""The other side's case: for each surviving claim a rival is proposed, checked, and tested with it in one family.

A model, or any other callable, proposes; it decides nothing. A rival goes through the same validation, entitlement, panel and false-discovery
correction as what it challenges. Where it survives too, the claim is contested and no longer counts as surviving.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.contract import CONTRACT, EntitlementDenied
from veridelta.operators import adjudicate, predicate, proposer
from veridelta.operators.ledger import Ledger
from veridelta.sources.tables import materialize

#: How the ids of rivals begin; a log's adversarial rows are found by it.
PREFIX = "h_adversarial_"


@dataclass(frozen=True)
class Case:
    """A surviving claim with its region, the role that asks and its windows, and the rival that was found for it, or why there is none."""

    claim: predicate.Predicate
    region: str
    role: str
    windows: dict[str, tuple]
    rival: predicate.Predicate | None = None
    reason: str = ""


def _differs(rival: predicate.Predicate, claim: predicate.Predicate) -> None:
    """A rival must tell another story than the claim: not the same units against each other."""
    if rival.treatment == claim.treatment and rival.control == claim.control:
        raise predicate.PredicateRejected("the rival restates the claim")
    if rival.treatment.dim == claim.treatment.dim and set(rival.treatment.values) & set(claim.treatment.values):
        raise predicate.PredicateRejected("the rival blames units that the claim blames")


def find_rival(ledger: Ledger, ask: Callable[[str], tuple[str, int, int]] | None, case: Case, context: dict, allowed: dict[str, list[str]], config: proposer.ProposerConfig = proposer.ProposerConfig(), contract: dict = CONTRACT, run_id: str = "challenge") -> Case:
    """The case with a rival that is valid, differs and may be tested by the role; without one, with the reason.

    Answers are asked for as often as ``proposer.propose`` does; a rival that is found is kept in the ledger's cache by claim and context, so a run that
    broke off goes on without asking again. Every call is in the telemetry.
    """
    survivor = case.claim.nested()
    key = proposer.topic_key(survivor, context, "challenge")
    hit = ledger.cache_get("challenge", key)
    if hit is not None:
        return _with(case, predicate.validate(json.loads(hit)), "")

    def fitting(found: predicate.Predicate) -> None:
        _differs(found, case.claim)
        try:
            predicate.compile_predicate(found, case.region, case.role, case.windows, contract)
        except (EntitlementDenied, KeyError) as e:
            raise predicate.PredicateRejected(f"it can't be tested: {e}") from e

    made = proposer.propose(ask, proposer.challenge_prompt(survivor, context, allowed), allowed, extra=fitting)
    if ask is not None:
        with ledger.span(run_id, "adversarial_challenge", True, config.model, made["tokens_in"], made["tokens_out"], proposer.hosted_cost(made["tokens_in"], made["tokens_out"]), made["latency_ms"]):
            pass
    if made["predicate"] is None:
        return _with(case, None, made["reason"])
    named = made["predicate"] | {"hypothesis_id": PREFIX + case.claim.hypothesis_id}  # one rival for a claim, found by its name
    ledger.cache_put("challenge", key, config.model or config.backend, json.dumps(named))
    return _with(case, predicate.validate(named), "")


def _with(case: Case, rival: predicate.Predicate | None, reason: str) -> Case:
    return Case(case.claim, case.region, case.role, case.windows, rival, reason)


def joint_panel(spark: SparkSession, cases: list[Case], contract: dict = CONTRACT) -> DataFrame:
    """The unit panels of all claims and their rivals, one plan over the registered views."""
    panel = None
    for case in cases:
        for claim in filter(None, (case.claim, case.rival)):
            rows = predicate.unit_panel(spark, predicate.compile_predicate(claim, case.region, case.role, case.windows, contract)).withColumn("period", F.col("period").cast("string"))
            panel = rows if panel is None else panel.unionByName(rows)
    return panel


def standings(verdicts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(hypothesis_id, rival_id, standing, verdict, rival_verdict) of each survivor; ``pairs`` has (hypothesis_id, rival_id), null without a rival.

    contested: the rival survives as well, and the claim is downgraded to INCONCLUSIVE. weakened: with the rival in its family the claim itself no
    longer survives, and keeps that verdict. upheld: it survives and the rival doesn't. unchallenged: no rival was found, or no panel could test the claim.
    """
    own = verdicts.select("hypothesis_id", F.col("verdict").alias("joint"))
    other = verdicts.select(F.col("hypothesis_id").alias("rival_id"), F.col("verdict").alias("rival_verdict"))
    met = pairs.join(own, "hypothesis_id", "left").join(other, "rival_id", "left")
    rival_survives = F.coalesce(F.col("rival_verdict") == "SURVIVED", F.lit(False))
    standing = (
        F.when(F.col("rival_id").isNull() | F.col("joint").isNull(), "unchallenged").when(F.col("joint") != "SURVIVED", "weakened").when(rival_survives, "contested").otherwise("upheld")
    )
    verdict = F.when(standing == "unchallenged", F.coalesce("joint", F.lit("SURVIVED"))).when(standing == "contested", "INCONCLUSIVE").otherwise(F.col("joint"))
    return met.select("hypothesis_id", "rival_id", standing.alias("standing"), verdict.alias("verdict"), "rival_verdict")


def challenge(spark: SparkSession, ledger: Ledger, ask, cases: list[Case], context: dict, allowed: dict[str, list[str]], run_id: str, config: proposer.ProposerConfig = proposer.ProposerConfig(), contract: dict = CONTRACT) -> tuple[DataFrame, DataFrame] | None:
    """(standings, verdicts) of the surviving claims in ``cases`` and their rivals; None without a case.

    All claims and rivals are one family of the false-discovery rate. The rivals' verdicts and the downgraded claims are appended to the ledger under ``run_id``.
    """
    if not cases:
        return None
    found = [find_rival(ledger, ask, c, context, allowed, config, contract, run_id) for c in cases]  # one for each survivor: a handful
    # a few rows each, read many times: by every test, the ledger and the caller
    panel = materialize(joint_panel(spark, found, contract).coalesce(8), "joint-panel")
    verdicts = materialize(adjudicate.verdicts(panel).coalesce(1), "joint-verdicts")
    pairs = spark.createDataFrame([(c.claim.hypothesis_id, c.rival.hypothesis_id if c.rival else None) for c in found], "hypothesis_id string, rival_id string")
    told = standings(verdicts, pairs)
    down = verdicts.join(told.where("standing = 'contested'").select("hypothesis_id"), "hypothesis_id").withColumn("verdict", F.lit("INCONCLUSIVE")).withColumn("reason", F.lit("a rival explanation survives the same test"))
    ledger.write_verdicts(run_id, verdicts.where(F.col("hypothesis_id").startswith(PREFIX)).unionByName(down))
    return told, verdicts
