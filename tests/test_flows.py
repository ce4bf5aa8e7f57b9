"""Challenges, watched series, dose tests by role and the smaller operators, on planted rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridelta import contract
from veridelta.functions.columns import power_law_between_ends
from veridelta.operators import challenge, graph, investigations, localise, monitor, predicate, reconcile, signal
from veridelta.operators.ledger import Ledger, with_prefix
from veridelta.sources import files

VALUES = {"fulfillment_center": ["a", "b", "c", "d", "e"], "product_category": ["p", "q", "r", "s", "t"]}
WINDOWS = {"week": ((1, 6), (9, 14))}


def claim(name, dim, treated, control=None):
    return {
        "hypothesis_id": name, "mechanism": "it broke", "test_archetype": "placebo", "treatment": {"dim": dim, "in": treated}, "control": {"dim": dim, "in": control or [v for v in VALUES[dim] if v not in treated]},
        "outcome": {"metric": "revenue", "expect": "decline"}, "temporal": {"cause_onset": "2025-01-01", "kpi_onset": "2025-01-08"}, "refutes_if": {"condition": "no fall", "rationale": "then nothing broke"},
    }


@pytest.fixture(scope="module")
def sales(spark):
    """Centre a loses sales from week 9 on, and so does category p, which sells elsewhere too."""
    rng = np.random.default_rng(1)
    rows = []
    for w in range(1, 15):
        for c in VALUES["fulfillment_center"]:
            for p in VALUES["product_category"]:
                lost = w >= 9 and (c == "a" or p == "p")
                rows.append(("West", w, p, c, float(1000 * (0.5 if lost else 1) * (1 + 0.01 * rng.normal()))))
    return spark.createDataFrame(rows, "region string, week int, product_category string, fulfillment_center string, gross_revenue double").persist()


def cases():
    checked = [predicate.validate(claim("h_centre", "fulfillment_center", ["a"])), predicate.validate(claim("h_other", "fulfillment_center", ["b", "c"], ["d", "e"]))]
    return [challenge.Case(c, "West", "platform_engineer", WINDOWS) for c in checked]


def test_a_rival_that_survives_downgrades_the_claim(spark, sales, tmp_path):
    files.register_views({"pos_transactions": sales})
    asked = []

    def ask(prompt):
        asked.append(prompt)
        head = json.loads(prompt.split("\n")[0])
        if head["survivor"]["hypothesis_id"] == "h_other":
            return json.dumps(claim("x", "fulfillment_center", ["b", "c"], ["d", "e"])), 5, 5  # restates the claim, every time
        return ("no json", 1, 1) if len(asked) == 1 else (json.dumps(claim("anything", "product_category", ["p"])), 10, 20)

    book = Ledger(spark, str(tmp_path / "ledger"))
    told, verdicts = challenge.challenge(spark, book, ask, cases(), {"kpi": "revenue"}, VALUES, "r1")
    got = {r["hypothesis_id"]: (r["rival_id"], r["standing"], r["verdict"], r["rival_verdict"]) for r in told.collect()}
    assert got["h_centre"] == ("h_adversarial_h_centre", "contested", "INCONCLUSIVE", "SURVIVED")
    assert got["h_other"][:2] == (None, "unchallenged") and len(asked) == 2 + 3
    assert {r["hypothesis_id"] for r in verdicts.collect()} == {"h_centre", "h_other", "h_adversarial_h_centre"}
    kept = {(r["hypothesis_id"], r["verdict"], r["run_id"]) for r in book.read("ledger").collect()}
    assert kept == {("h_adversarial_h_centre", "SURVIVED", "r1"), ("h_centre", "INCONCLUSIVE", "r1")}
    assert with_prefix(book.read("ledger"), "hypothesis_id", challenge.PREFIX).count() == 1
    assert book.read("telemetry").where("stage = 'adversarial_challenge'").count() == 2
    again = challenge.find_rival(book, lambda _: pytest.fail("it is in the ledger"), cases()[0], {"kpi": "revenue"}, VALUES)
    assert again.rival.hypothesis_id == "h_adversarial_h_centre"


def test_standings(spark):
    verdicts = spark.createDataFrame([("a", "SURVIVED"), ("b", "SURVIVED"), ("c", "KILLED"), ("d", "SURVIVED"), ("ra", "KILLED"), ("rb", "SURVIVED"), ("rc", "SURVIVED")], "hypothesis_id string, verdict string")
    pairs = spark.createDataFrame([("a", "ra"), ("b", "rb"), ("c", "rc"), ("d", None), ("gone", "ra")], "hypothesis_id string, rival_id string")
    got = {r["hypothesis_id"]: (r["standing"], r["verdict"]) for r in challenge.standings(verdicts, pairs).collect()}
    assert got == {"a": ("upheld", "SURVIVED"), "b": ("contested", "INCONCLUSIVE"), "c": ("weakened", "KILLED"), "d": ("unchallenged", "SURVIVED"), "gone": ("unchallenged", "SURVIVED")}


def test_a_role_without_access_is_told_before_anything_is_asked_of_the_data(spark, tmp_path):
    case = challenge.Case(predicate.validate(claim("h", "fulfillment_center", ["a"])), "West", "regional_vp", WINDOWS)
    values = VALUES | {"rep_id": ["r1", "r2"]}
    rival = claim("x", "product_category", ["p"]) | {"treatment": {"dim": "rep_id", "in": ["r1"]}, "control": {"dim": "rep_id", "in": ["r2"]}}
    found = challenge.find_rival(Ledger(spark, str(tmp_path / "l")), lambda _: (json.dumps(rival), 1, 1), case, {}, values)
    assert found.rival is None and "rep_detail" in found.reason
    none = challenge.find_rival(Ledger(spark, str(tmp_path / "l")), None, case, {}, values)
    assert none.rival is None and none.reason == "no backend"


def test_watched_series(spark):
    rng = np.random.default_rng(2)
    panel = spark.createDataFrame([("West", w, float(100 + rng.normal()), None if w == 3 else float(w)) for w in range(1, 15)], "region string, week int, revenue double, marketing_attributed_revenue_share double")
    reps = spark.createDataFrame([("West", f"2025-{m:02d}", "r", 5.0 * m) for m in (3, 1, 2)], "region string, month string, rep_id string, rep_attributed_revenue double")
    cats = spark.createDataFrame([("West", c, w, float(10 + w + 30 * (c == "new" and w == 14))) for c in ("new", "old", "older") for w in range(1, 15)], "region string, product_category string, week int, revenue double")
    kpis = ["revenue", "marketing_attributed_revenue_share"]
    series = investigations.kpi_series(panel, reps, cats, kpis, [("West", "new", 10), ("West", "absent", 1)])
    rows = series.collect()
    assert [(r["period"], r["value"]) for r in sorted(rows, key=lambda r: r["period"]) if r["kpi"] == "rep_attributed_revenue"] == [(1, 5.0), (2, 10.0), (3, 15.0)]
    young = sorted((r["period"], r["value"], len(r["baseline"])) for r in rows if r["kpi"] == "new_category_revenue (new)")
    assert young == [(w, 10.0 + w + 30 * (w == 14), 28) for w in range(10, 15)]
    found = {r["kpi"]: r for r in signal.gate(signal.detect(series), contract.kpi_table(spark)).collect()}
    assert set(found) == {*kpis, "rep_attributed_revenue", "new_category_revenue (new)"} and found["marketing_attributed_revenue_share"]["n_trimmed"] == 1
    values, base = np.array([v for _, v, _ in young]), np.array([10.0 + w for w in range(1, 15)] * 2)
    last, _ = signal.run_lengths(values, signal.shrunk_prior(base), signal.HAZARD)
    assert found["new_category_revenue (new)"]["confidence"] == pytest.approx(signal.changepoint(last)[1]) and found["new_category_revenue (new)"]["sparse_history"]
    assert investigations.kpi_series(panel.limit(0), reps.limit(0), cats.limit(0), kpis, [("West", "new", 10)]).count() == 0


def test_dose_by_role(spark):
    spend = [(r, c, w, float(10 + k + (w > 3) * (k + 3 * i))) for i, r in enumerate(("West", "East")) for k, c in enumerate("xyz") for w in range(1, 7)]
    files.register_views({"marketing_spend": spark.createDataFrame(spend, "region string, channel string, week int, spend_usd double"), "pos_transactions": spark.createDataFrame([(r, w, 100.0 + 5 * i * (w > 3)) for i, r in enumerate(("West", "East")) for w in range(1, 7)], "region string, week int, gross_revenue double")})
    dose = claim("h", "fulfillment_center", ["a"]) | {"test_archetype": "dose_response", "treatment": {"dim": "channel", "in": ["x", "y"]}, "control": {"dim": "channel", "in": ["y", "z"]}}
    got = investigations.dose_test(spark, dose, ["West", "East"], "regional_vp", (1, 3), (4, 6)).first()
    assert got["n"] == 6 and got["rho"] > 0
    with pytest.raises(contract.EntitlementDenied):
        investigations.dose_test(spark, dose, ["West", "East"], "ops_manager_west", (1, 3), (4, 6))
    with pytest.raises(contract.EntitlementDenied):
        investigations.dose_test(spark, dose, ["West"], "marketing_analyst", (1, 3), (4, 6))
    with pytest.raises(predicate.PredicateRejected):
        investigations.dose_test(spark, claim("h", "fulfillment_center", ["a"]), ["West"], "regional_vp", (1, 3), (4, 6))


def test_one_maturity_rule_for_views_and_panels(spark):
    rows = [("West", w, c, 1.0, 1) for c, first in (("old", 1), ("new", 5)) for w in range(first, 15)]
    sales = spark.createDataFrame(rows, "region string, week int, product_category string, gross_revenue double, units int")
    files.register_views({"pos_transactions": sales}, min_weeks=8)
    seen = {(r["product_category"], r["week"]) for r in spark.table("pos_transactions").collect()}
    assert seen == {("old", w) for w in range(1, 15)} | {("new", w) for w in (13, 14)}
    files.register_views({"pos_transactions": sales})
    assert spark.table("pos_transactions").count() == len(rows)


def test_what_a_role_sees(spark):
    facts = spark.createDataFrame([("West", "r1"), ("East", "r2"), (None, "r3"), ("North", "r4")], "region string, rep_id string")
    got = {(r["role"], r["region"], r["rep_id"]) for r in investigations.visible(facts, contract.role_table(spark)).collect()}
    assert got == {("ops_manager_west", "West", "r1"), *((role, x, rep if role == "platform_engineer" else None) for role in ("regional_vp", "marketing_analyst", "platform_engineer") for x, rep in (("West", "r1"), ("East", "r2")))}


def test_smaller_operators(spark):
    texts = spark.createDataFrame([("a", "[1, 2.5, null]"), ("a", None), ("b", "no json"), ("b", "[]"), ("a", "[7]")], "k string, numbers string")
    assert sorted((r["k"], r["value"]) for r in monitor.pooled(texts, ["k"], "numbers").collect()) == [("a", 1.0), ("a", 2.5), ("a", 7.0)]
    months = spark.createDataFrame([("West", "2025-01", 1.0), ("West", "2025-03", 3.0), ("East", "2025-09", 9.0)], "region string, month string, revenue double")
    got = {(r["region"], r["month"]): r["revenue"] for r in localise.reindexed(months, ["region"], "month", ["2025-01", "2025-02"]).collect()}
    assert got == {("West", "2025-01"): 1.0, ("West", "2025-02"): None, ("East", "2025-01"): None, ("East", "2025-02"): None}
    ends = lambda rows: spark.createDataFrame(rows, "x double, y double").agg(power_law_between_ends(F.col("x"), F.col("y"))).first()[0]
    assert ends([(2.0, 5.0), (40.0, 500.0), (20.0, 1.0), (0.0, 9.0), (80.0, 0.0), (None, 3.0)]) == pytest.approx(math.log(100) / math.log(20))
    assert ends([(2.0, 5.0)]) is None and ends([(0.0, 5.0)]) is None
    panel = spark.createDataFrame([("b", 1), ("a", 10), ("a", 2)], "region string, week int").repartition(3)
    assert [tuple(r) for r in reconcile.ordered(panel).collect()] == [("a", 2), ("a", 10), ("b", 1)]
    deltas = spark.createDataFrame([("x", 3.0), ("y", -2.0), ("z", -2.0)], "player string, delta double")
    assert [r["player"] for r in localise.ascending(deltas).collect()] == ["y", "z", "x"]
    reached = spark.createDataFrame([("n3", 2), ("n1", 1), ("n2", 1)], "node string, hops int")
    assert [r["node"] for r in graph.by_hops(reached).collect()] == ["n1", "n2", "n3"]


def test_an_infinite_index_is_null_beside_its_verdict(spark):
    rows = [(f"r{k}", k, [0.5, 0.5, 0.5], [0.1 * k, 0.2], [0.05]) for k in range(6)] + [("now", 9, [0.9, 0.9], [0.1, 0.3], [0.05])]
    snapshots = spark.createDataFrame(rows, "run_id string, created_at long, l1_posteriors array<double>, did_effects array<double>, did_mdes array<double>")
    got = {r["metric"]: (r["psi"], r["verdict"]) for r in monitor.assess_drift(snapshots, "now").collect()}
    assert got["l1_posteriors"] == (None, "SIGNIFICANT_DRIFT") and got["overall"][1] == "SIGNIFICANT_DRIFT" and got["overall"][0] is not None
