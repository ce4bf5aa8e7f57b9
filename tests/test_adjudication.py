"""Predicates, entitlements and verdicts on planted panels, against ordinary least squares in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridelta import contract
from veridelta.contract import EntitlementDenied, allowed, check_domain, check_entitlement
from veridelta.operators import adjudicate, predicate


def raw(**changes):
    base = {
        "hypothesis_id": "h1", "mechanism": "a centre was slow", "test_archetype": "placebo", "treatment": {"dim": "fulfillment_center", "in": ["WEST_DC"]},
        "control": {"dim": "fulfillment_center", "in": ["EAST_DC", "CENTRAL_DC"]}, "outcome": {"metric": "revenue", "expect": "decline"},
        "temporal": {"cause_onset": "2025-08-04", "kpi_onset": "2025-08-11"}, "refutes_if": {"condition": "both fall alike", "rationale": "a shared fall has another cause"},
    }
    return base | changes


def test_rejections():
    assert predicate.validate(raw()).hypothesis_id == "h1"
    for bad in (raw(refutes_if={"condition": "  ", "rationale": "r"}), raw(refutes_if={"condition": "c", "rationale": " "}), raw(refutes_if={"condition": "c"}), raw(outcome={"metric": "revenue", "expect": "something"}), raw(temporal={"cause_onset": "soon", "kpi_onset": "2025-08-11"}), raw(control={"dim": "channel", "in": ["x"]}), raw(control={"dim": "fulfillment_center", "in": ["WEST_DC"]}), raw(outcome={"metric": "units", "expect": ""}), raw(treatment={"dim": "nowhere", "in": ["x"]}), {}):
        with pytest.raises(predicate.PredicateRejected):
            predicate.validate(bad)
    with pytest.raises(predicate.PredicateRejected, match="treatment.in .*; .*refutes_if.rationale"):  # all faults at once
        predicate.validate(raw(treatment={"dim": "channel", "in": []}, refutes_if={"condition": "c"}))
    assert predicate.validate(predicate.validate(raw()).nested()).nested() == raw()
    with pytest.raises(predicate.PredicateRejected):
        predicate.validate_semantics(predicate.validate(raw()), {"fulfillment_center": ["WEST_DC"]})


def test_entitlements_deny_by_default():
    assert allowed(check_entitlement, "ops_manager_west", "West", "rep_id") == (True, "")
    for role, region, dim in (("nobody", "West", "channel"), ("ops_manager_west", "East", "channel"), ("regional_vp", "West", "rep_id"), ("platform_engineer", "West", "salary")):
        assert not allowed(check_entitlement, role, region, dim)[0]
    grid = {(r, k): allowed(check_domain, r, k)[0] for r in contract.CONTRACT["entitlements"] for k in contract.CONTRACT["kpis"]}
    assert sum(grid.values()) == 5 + 4 + 1 + 5 and not grid["marketing_analyst", "revenue"]
    assert not allowed(check_domain, "regional_vp", "profit")[0]


def test_denied_before_any_plan(spark):
    windows = {"week": ((1, 2), (3, 4)), "month": (("a", "b"), ("c", "d"))}
    with pytest.raises(EntitlementDenied):  # there is no view to read, so a plan would fail otherwise
        predicate.compile_predicate(predicate.validate(raw()), "West", "marketing_analyst", windows)
    ok = predicate.compile_predicate(predicate.validate(raw()), "West", "ops_manager_west", windows)
    again = predicate.compile_predicate(predicate.validate(raw()), "West", "ops_manager_west", windows)
    assert ok.hashes == again.hashes and len(ok.hashes[0]) == 16 and ok.hashes[0] != ok.hashes[1]
    assert "WEST_DC" not in ok.treatment[0]


def test_values_are_only_parameters(spark):
    rows = spark.createDataFrame([("West", "x'; drop", 1, 5.0), ("West", "WEST_DC", 1, 7.0), ("West", "WEST_DC", 4, 9.0), ("West", "WEST_DC", 2, 3.0)], "region string, fulfillment_center string, week int, gross_revenue double")
    rows.createOrReplaceTempView("pos_transactions")
    sql, params = predicate.compile_units("fulfillment_center", "West", ["x'; drop"], 1, 4)
    assert [tuple(r) for r in spark.sql(sql, args=params).collect()] == [("x'; drop", 1, 5.0)]
    made = predicate.Compiled(predicate.validate(raw()), "West", (1, 1), (4, 4), predicate.compile_units("fulfillment_center", "West", ["WEST_DC"], 1, 4), (sql, params))
    panel = {(r["unit"], r["period"]): (r["treat"], r["post"]) for r in predicate.unit_panel(spark, made).collect()}
    assert panel == {("WEST_DC", 1): (1, 0), ("WEST_DC", 4): (1, 1), ("x'; drop", 1): (0, 0)}


def planted(spark, name, units_t, units_c, effect, noise, seed=0, pre=5, post=5, slope=0.0, scale=1000.0):
    rng, rows = np.random.default_rng(seed), []
    for u in range(units_t + units_c):
        treat = int(u < units_t)
        for t in range(pre + post):
            y = np.log(scale * (1 + u)) + treat * (t >= pre) * effect + treat * slope * t + noise * rng.normal() + 0.05 * (t >= pre)
            rows.append((name, f"u{u}", t, float(np.exp(y)), treat, int(t >= pre)))
    return spark.createDataFrame(rows, "hypothesis_id string, unit string, period int, value double, treat int, post int")


def ols(x, y, groups=None):
    a = np.linalg.inv(x.T @ x)
    b = a @ x.T @ y
    e, (n, k) = y - x @ b, x.shape
    if groups is None:
        return b, a @ (x.T * e**2) @ x @ a * n / (n - k)
    s = np.array([(x[groups == g] * e[groups == g, None]).sum(axis=0) for g in np.unique(groups)])
    m = len(s)
    return b, a @ (s.T @ s) @ a * m / (m - 1) * (n - 1) / (n - k)


@pytest.mark.parametrize("sides", [(1, 2), (4, 5)])
def test_estimators_match_least_squares(spark, sides):
    panel = planted(spark, "h", *sides, -0.2, 0.1, seed=4)
    p = panel.toPandas()
    dummies = (p["unit"].to_numpy()[:, None] == np.unique(p["unit"])[None, :]).astype(float)
    x = np.c_[p["post"], p["treat"] * p["post"], dummies]
    b, v = ols(x, np.log(p["value"].to_numpy()), p["unit"].to_numpy() if sides[0] >= 4 else None)
    got = adjudicate.did(panel).first()
    assert got["clustered"] == (sides[0] >= 4) and got["effect"] == pytest.approx(b[1]) and got["se"] == pytest.approx(v[1, 1] ** 0.5)
    q = p[p["post"] == 0]
    x = np.c_[np.ones(len(q)), q["treat"], q["period"], q["treat"] * q["period"]]
    b, v = ols(x, np.log(q["value"].to_numpy()), q["unit"].to_numpy() if sides[0] >= 4 else None)
    pre = adjudicate.parallel_trends(panel).first()
    assert pre["slope_gap"] == pytest.approx(b[3]) and pre["pretrend_z"] == pytest.approx(b[3] / v[3, 3] ** 0.5)


def test_verdicts_of_planted_frames(spark):
    frames = [
        planted(spark, "broad_decline", 1, 2, 0.0, 0.02, seed=1), planted(spark, "real_loss", 2, 3, -0.3, 0.02, seed=2), planted(spark, "noisy", 1, 2, 0.0, 0.5, seed=3),
        planted(spark, "pretrend", 1, 2, -0.3, 0.01, seed=6, slope=-0.1), planted(spark, "wrong_way", 2, 3, 0.3, 0.02, seed=2), planted(spark, "departed", 4, 2, float(np.log(0.05)), 0.05, seed=5, pre=2, post=2),
    ]
    panel = frames[0]
    for f in frames[1:]:
        panel = panel.unionByName(f)
    got = {r["hypothesis_id"]: r["verdict"] for r in adjudicate.verdicts(panel).collect()}
    assert got == {"broad_decline": "KILLED", "real_loss": "SURVIVED", "noisy": "INCONCLUSIVE", "pretrend": "INCONCLUSIVE", "wrong_way": "KILLED", "departed": "SURVIVED"}


def test_unidentified_panels(spark):
    one = planted(spark, "alone", 1, 0, 0.0, 0.1)
    row = adjudicate.verdicts(one).first()
    assert row["verdict"] == "INCONCLUSIVE" and row["did_effect"] is None
    short = adjudicate.parallel_trends(planted(spark, "short", 1, 2, 0.0, 0.1, pre=1)).first()
    assert short["pretrend_p"] is None and short["pretrend_ok"] is None


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.03, None, 0.5]
    rows = spark.createDataFrame([(f"h{i}", 1, p) for i, p in enumerate(ps)], "hypothesis_id string, family int, p double")
    got = {r["hypothesis_id"]: r["p_bh"] for r in adjudicate.benjamini_hochberg(rows, ["family"]).collect()}
    assert got["h0"] == pytest.approx(0.04) and got["h1"] == got["h2"] == pytest.approx(0.04 * 4 / 3) and got["h3"] is None and got["h4"] == 0.5
    assert all(got[f"h{i}"] >= p for i, p in enumerate(ps) if p)


def test_dose_and_precedence(spark):
    dose = spark.createDataFrame([(r, c, t, float(10 + i + 5 * j)) for i, r in enumerate("abc") for j, c in enumerate("wxyz") for t in range(6)], "region string, channel string, period int, value double")
    outcome = spark.createDataFrame([(r, t, 100.0 - (t >= 3) * 10 * (i + 1)) for i, r in enumerate("abc") for t in range(6)], "region string, period int, value double")
    strata = adjudicate.dose_strata(dose.withColumn("value", F.col("value") + F.col("period")), outcome, (0, 2), (3, 5))
    got = adjudicate.dose_response(strata).first()
    assert got["n"] == 12 and got["mde_rho"] == pytest.approx(0.7324, abs=1e-4) and got["verdict"] in ("INCONCLUSIVE", "SURVIVED")
    onsets = spark.createDataFrame([(30, 0.9, 32, 0.8), (32, 0.9, 32, 0.8), (34, 0.9, 32, 0.8), (30, 0.5, 32, 0.8)], "topic_tau int, topic_confidence double, kpi_tau int, kpi_confidence double")
    assert [r["verdict"] for r in adjudicate.precedence(onsets).collect()] == ["SURVIVED", "SURVIVED", "KILLED", "INCONCLUSIVE"]
