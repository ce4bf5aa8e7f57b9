"""Reconciliation, topics, monitoring, ledger, actions, graph, generators and proposals on small frames."""

import json
import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridelta import contract
from veridelta.contract import EntitlementDenied
from veridelta.operators import actions, adjudicate, graph, investigations, ledger, localise, methods, monitor, predicate, proposer, reconcile, signal, topics
from veridelta.sources import files, generate


def test_maturity_is_strict(spark):
    rows = spark.createDataFrame([("Old", w, 1.0, 1, "West") for w in (1, 40)] + [("New", w, 1.0, 1, "West") for w in (34, 41, 42)] + [(None, 3, 1.0, 1, "West")], "product_category string, week int, gross_revenue double, units int, region string")
    assert sorted((r["product_category"], r["week"]) for r in reconcile.mature(rows).collect()) == [("New", 42), ("Old", 1), ("Old", 40)]


def test_months_and_tiers(spark):
    assert reconcile.complete_months(date(2025, 1, 6), date(2025, 3, 30)) == ["2025-01", "2025-02"]
    assert reconcile.complete_months(date(2025, 1, 6), date(2025, 3, 31)) == ["2025-01", "2025-02", "2025-03"]
    rows = spark.createDataFrame([(1, 0.98, True), (2, 0.98, False), (3, 0.5, True), (4, None, False)], "i int, completeness double, system_of_record boolean")
    assert [r["quality_tier"] for r in reconcile.tiered(rows).orderBy("i").collect()] == ["high", "medium", "low", "n/a"]


def test_join_losses(spark):
    a = spark.createDataFrame([("m1", "W"), ("m2", "W"), ("m1", "W")], "month string, region string")
    b = spark.createDataFrame([("m1", "W")], "month string, region string")
    assert tuple(reconcile.join_loss("j", a, b, ["month", "region"]).first()) == ("j", 2, 1, 0.5)


@pytest.fixture(scope="module")
def world(spark):
    pos = generate.pos_transactions(spark).cache()
    return {"pos": pos, "crm": generate.crm_headcount(pos), "gl": generate.finance_gl_extract(pos), "marketing": generate.marketing_spend(spark), "tickets": generate.support_tickets(spark)}


def test_generated_world(spark, world, tmp_path):
    assert world["pos"].count() > 9000 and world["marketing"].count() == 480 and world["crm"].count() == 110 and world["tickets"].count() == 68
    files.write_csv(world["marketing"], f"{tmp_path}/marketing_spend.csv")
    back = files.read_source(spark, str(tmp_path), "marketing_spend")
    assert back.exceptAll(world["marketing"]).count() == 0 and files.read_if_there(spark, str(tmp_path), "fulfillment_center_ops") is None
    files.write_artifact(back.limit(3), f"{tmp_path}/a.json")
    assert files.read_artifact(spark, f"{tmp_path}/a.json").count() == 3 and files.read_artifact(spark, f"{tmp_path}/none.json") is None
    pos, gl, tickets = generate.inject_anomaly(world["pos"], world["gl"], world["tickets"])
    total = lambda df: df.agg(F.sum("gross_revenue")).first()[0]
    assert total(pos) < total(world["pos"]) and tickets.count() == 76
    assert generate.inject_anomaly(pos, gl, tickets)[2].count() == 76


def test_from_sources_to_verdict(spark, world):
    """The planted attrition survives; the claim that one centre caused the West's decline is killed."""
    weeks = reconcile.region_weeks(reconcile.mature(world["pos"].withColumn("week", generate.week_of(F.col("date"), "2025-01-06"))))
    tall = weeks.select(F.lit("revenue").alias("kpi"), "region", F.lit("week").alias("period_unit"), F.col("week").alias("period"), F.col("revenue").alias("value"))
    found = {r["region"]: r for r in signal.gate(signal.detect(tall), contract.kpi_table(spark)).collect()}
    assert found["West"]["gate_passed"] and not found["East"]["gate_passed"]
    claims = reconcile.source_gaps(world["pos"].withColumn("month", F.date_format("date", "yyyy-MM")), world["gl"].withColumnRenamed("gl_revenue_usd", "gl_revenue"))
    assert reconcile.agreement_claim(claims).first()["verdict"] == "DISAGREES"
    files.register_views({"pos_transactions": world["pos"].withColumn("week", generate.week_of(F.col("date"), "2025-01-06")), "crm_headcount": world["crm"]})
    windows = {"week": ((26, 30), (32, 36)), "month": (("2025-06", "2025-07"), ("2025-08", "2025-09"))}
    base = {"mechanism": "m", "outcome": {"metric": "revenue", "expect": "decline"}, "temporal": {"cause_onset": "2025-08-04", "kpi_onset": "2025-08-11"}, "refutes_if": {"condition": "no gap", "rationale": "a shared fall has another cause"}}
    reps = base | {"hypothesis_id": "h_rep_attrition", "test_archetype": "specificity", "treatment": {"dim": "rep_id", "in": ["W1", "W2", "W3", "W4"]}, "control": {"dim": "rep_id", "in": ["W5", "W6"]}}
    center = base | {"hypothesis_id": "h_shipping_delay", "test_archetype": "placebo", "treatment": {"dim": "fulfillment_center", "in": ["WEST_DC"]}, "control": {"dim": "fulfillment_center", "in": ["EAST_DC", "CENTRAL_DC"]}}
    panel = None
    for r in (reps, center):
        one = predicate.unit_panel(spark, predicate.compile_predicate(predicate.validate(r), "West", "ops_manager_west", windows)).withColumn("period", F.col("period").cast("string"))
        panel = one if panel is None else panel.unionByName(one)
    got = {r["hypothesis_id"]: r for r in adjudicate.verdicts(panel).collect()}
    assert got["h_rep_attrition"]["verdict"] == "SURVIVED" and got["h_rep_attrition"]["did_effect"] == pytest.approx(math.log(0.05), abs=0.02)
    assert got["h_shipping_delay"]["verdict"] in ("KILLED", "INCONCLUSIVE")
    registry = [investigations.Investigation("West", "revenue", "ops_manager_west", windows, (center, reps)), investigations.Investigation("East", "revenue", "nobody", windows, ({"no": "claim"},))]
    gated, verdicts = investigations.run(spark, tall, registry)  # the East didn't pass: its claim isn't even read
    assert {r["hypothesis_id"]: r["verdict"] for r in verdicts.collect()} == {h: r["verdict"] for h, r in got.items()}
    table = investigations.registry_table(spark, registry[:1])
    assert [tuple(r) for r in investigations.first_survivors(verdicts, table).collect()] == [("West", "revenue", "h_rep_attrition")]
    assert {r["region"]: r["n_claims"] for r in investigations.attach(gated, table).collect()} == {"West": 2, "East": None, "Central": None}
    assert investigations.run(spark, tall.where("region = 'East'"), registry)[1] is None
    with pytest.raises(contract.EntitlementDenied):
        predicate.compile_dose("East", ["Search"], 1, 4, "ops_manager_west")


def test_clusters(spark):
    base = np.eye(4)
    rows = [(i, "g", [float(x) for x in base[i % 4] + 0.05 * np.sin(i + np.arange(4))]) for i in range(40)] + [(99, "g", None)]
    frame = spark.createDataFrame(rows, "id int, g string, v array<double>")
    got = {r["id"]: r["cluster"] for r in topics.cluster_texts(frame, "g", "id", "v").collect()}
    assert got == {i: i % 4 for i in range(40)}
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5))
    rows = [(i, "g" if i % 3 else "h", [float(x) for x in centres[rng.integers(6)] * rng.uniform(0.5, 2) + 0.6 * rng.normal(size=5)]) for i in range(90)] + [(200 + i, "g", [0.0] * 5) for i in range(2)] + [(300, "h", [1.0, 0.0, 0.0, 0.0, 0.0])] * 3
    frame = spark.createDataFrame(rows, "id int, g string, v array<double>")
    whole = sorted((r["g"], r["id"], r["cluster"]) for r in topics.cluster_texts(frame, "g", "id", "v", threshold=0.4).collect())
    for cell, block in ((10, 16), (25, 2048)):  # groups over the cell, in rounds and blocks, as whole
        assert sorted((r["g"], r["id"], r["cluster"]) for r in topics.cluster_texts(frame, "g", "id", "v", threshold=0.4, cell=cell, block=block).collect()) == whole
    assert 4 < len({c for _, _, c in whole}) < 60
    chain = [(i, "g", [float(np.cos(0.3 * i)), float(np.sin(0.3 * i))]) for i in range(18)]  # each is near the next alone: one part, cut by the rounds
    frame = spark.createDataFrame(chain, "id int, g string, v array<double>")
    ends = [sorted((r["id"], r["cluster"]) for r in topics.cluster_texts(frame, "g", "id", "v", threshold=0.1, **size).collect()) for size in ({}, {"cell": 5, "block": 4})]
    assert ends[0] == ends[1] and len({c for _, c in ends[0]}) > 2
    assert topics.agglomerate(np.array([[1.0, 0], [0.9, 0.1], [0, 1]]), np.ones(3), 0.65).tolist() == [0, 0, 2]


def test_terms(spark):
    docs = spark.createDataFrame([(1, 0, "The billing refund was late"), (2, 0, "billing refund again"), (3, 1, "snow storm and snow")], "id int, c int, text string")
    got = {(r["c"], r["rank"]): r["term"] for r in topics.cluster_terms(docs, "c", "id", "text", 3).collect()}
    assert {got[0, 1], got[0, 2], got[0, 3]} == {"billing", "billing refund", "refund"} and got[1, 1] == "snow"


def test_onsets_and_candidates(spark):
    rows = [("late", w) for w in [34] * 4 + [35] * 2] + [("early", 20)] * 6 + [("tiny", 3)]
    frame = spark.createDataFrame(rows, "topic string, week int")
    counts = topics.weekly_counts(frame, ["topic"], 40)
    assert counts.count() == 120
    found = topics.onsets(counts, ["topic"]).join(frame.groupBy("topic").agg(F.count("*").alias("n_texts")), "topic")
    got = {r["topic"]: r for r in topics.candidates(found, 32).collect()}
    assert set(got) == {"late", "early"} and got["late"]["tau"] == 34 and not got["late"]["became_candidate"] and got["early"]["became_candidate"]


def test_psi(spark):
    frame = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "value double")
    base = list(np.linspace(0, 1, 60))
    assert monitor.psi(frame(base), frame(base)) == pytest.approx(0)
    assert monitor.psi(frame(base), frame([5.0] * 60)) > 0.25 and monitor.psi(frame([1.0]), frame(base)) is None
    assert monitor.psi(frame([1.0] * 9), frame([1.0])) == 0.0 and math.isinf(monitor.psi(frame([1.0] * 9), frame([2.0])))
    pairs = frame(base).withColumn("is_current", F.lit(False)).unionByName(frame([x**2 for x in base]).withColumn("is_current", F.lit(True))).withColumn("k", F.lit("a"))
    assert monitor.psi_by_key(pairs, ["k"]).first()["psi"] == pytest.approx(monitor.psi(frame(base), frame([x**2 for x in base])))


def test_drift(spark):
    rows = [(f"r{i}", [0.1 * j for j in range(8)], [0.01 * j for j in range(6)], [0.1]) for i in range(6)] + [("now", [0.1 * j for j in range(8)], [9.0] * 6, None)]
    snaps = spark.createDataFrame(rows, "run_id string, l1_posteriors array<double>, did_effects array<double>, did_mdes array<double>")
    got = {r["metric"]: r["verdict"] for r in monitor.assess_drift(snaps, "now").collect()}
    assert got["l1_posteriors"] == "STABLE" and got["did_effects"] == "SIGNIFICANT_DRIFT" == got["overall"] and got["did_mdes"] == "UNKNOWN"
    few = {r["metric"]: r["verdict"] for r in monitor.assess_drift(snaps.where("run_id in ('r1', 'now')"), "now").collect()}
    assert set(few.values()) == {"UNKNOWN"}
    rows = [(f"r{i}", [0.5] * 4, [2.0], None, 0.5) for i in range(6)] + [("now", [0.5] * 4, [3.0], None, 0.25)]
    snaps = spark.createDataFrame(rows, "run_id string, l1_posteriors array<double>, did_effects array<double>, did_mdes array<double>, l1_gate_pass_rate double")
    got = {r["metric"]: r for r in monitor.assess_drift(snaps, "now").collect()}  # constants: unmoved and moved
    assert got["l1_posteriors"]["psi"] == 0 and got["l1_posteriors"]["verdict"] == "STABLE" and (got["l1_posteriors"]["mean_baseline"], got["did_effects"]["mean_current"]) == (0.5, 3.0)
    assert got["did_effects"]["psi"] is None and got["did_effects"]["verdict"] == "SIGNIFICANT_DRIFT" == got["overall"]["verdict"]
    unknown = snaps.withColumn("l1_posteriors", F.lit(None).cast("array<double>")).withColumn("did_effects", F.lit(None).cast("array<double>"))
    assert {r["metric"]: r["verdict"] for r in monitor.assess_drift(unknown, "now").collect()} == {"l1_posteriors": "UNKNOWN", "did_effects": "UNKNOWN", "did_mdes": "UNKNOWN", "overall": "STABLE"}
    assert tuple(monitor.gate_rates(snaps, "now").first()) == (0.5, 0.25)


def test_calibration(spark):
    rows = [(0.1, 0), (0.3, 1), (0.35, 0), (0.6, 1), (0.7, 0), (0.8, 1), (1.0, 1)]
    frame = spark.createDataFrame(rows, "predicted double, outcome int")
    assert monitor.brier(frame).first()["brier"] == pytest.approx(np.mean([(p - o) ** 2 for p, o in rows]))
    bins = {r["bucket_lo"]: r["n"] for r in monitor.reliability(frame).collect()}
    assert bins == {0.0: 1, 0.2: 2, 0.6: 2, 0.8: 2}
    curve = [r["recalibrated"] for r in monitor.isotonic(frame).orderBy("raw").collect()]
    assert curve == sorted(curve) and curve[0] == 0 and curve[-1] == 1 and monitor.isotonic(frame.limit(2)) is None
    back = monitor.simulated_backtest(spark)
    assert back.count() == 40 and monitor.hit_rates(back).count() == 4


def test_alerts(spark):
    rows = [("r1", 1, "revenue", "West"), ("r3", 3, "revenue", "West"), ("r3", 3, "units_sold", "East")]
    moved = spark.createDataFrame(rows, "run_id string, seq long, kpi string, region string").withColumn("week", F.lit(1)).withColumn("business_impact_pct", F.lit(-0.1)).withColumn("confidence", F.lit(0.85))
    runs = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 3)], "run_id string, seq long")
    assert monitor.new_movements(moved, "r3", runs).count() == 2  # the run before had none
    assert [r["kpi"] for r in monitor.new_movements(moved, "r3", runs, legacy=True).collect()] == ["units_sold"]
    assert monitor.new_movements(moved, "r1", runs).count() == 1
    sent = monitor.route_alerts(monitor.new_movements(moved, "r1", runs), contract.kpi_table(spark), contract.role_table(spark))
    assert {(r["role"], r["channel"]) for r in sent.collect()} == {("ops_manager_west", "slack_channel"), ("regional_vp", "email_digest"), ("platform_engineer", "dashboard")}


@pytest.fixture
def book(spark, tmp_path):
    return ledger.Ledger(spark, str(tmp_path))


def verdict_rows(spark, rows):
    return spark.createDataFrame(rows, "hypothesis_id string, verdict string, did_effect double, p double, p_bh double, mde double, plausible_effect double, treatment_sql_hash string, control_sql_hash string, dim string")


def test_ledger(spark, book):
    assert book.read("ledger").count() == 0
    book.write_verdicts("r1", verdict_rows(spark, [("a", "SURVIVED", -0.3, 0.01, 0.02, 0.1, 0.1, "t", "c", "rep_id"), ("b", "SURVIVED", -0.2, 0.01, 0.02, 0.1, 0.1, "t", "c", "rep_id")]))
    first = book.read("ledger").where("hypothesis_id = 'a'").first()
    assert first["did_effect_pct"] == -30.0 and first["predicted_direction"] == "decrease" and first["scored_outcome"] == "uncalibrated"
    assert ledger.contradictions(book.read("ledger")).first()["kind"] == "SAME_EVIDENCE_RETEST"
    book.write_verdicts("r2", verdict_rows(spark, [("a", "SURVIVED", -0.3, 0.01, 0.02, 0.1, 0.1, "t2", "c", "rep_id")]))
    assert ledger.contradictions(book.read("ledger")).first()["kind"] == "INDEPENDENT_CONTRADICTION"
    book.write_verdicts("r3", verdict_rows(spark, [("a", "KILLED", 0.1, 0.5, 0.5, 0.1, 0.1, "t3", "c", "rep_id")]))
    assert ledger.contradictions(book.read("ledger")).first() is None
    assert ledger.contradictions(book.read("ledger"), legacy=True).first()["n_survivors"] == 2
    with pytest.raises(EntitlementDenied):
        book.check("r1", "nobody", "West", "rep_id", "dim")
    book.check("r1", "regional_vp", None, "revenue", "domain")
    assert sorted(r["allowed"] for r in book.read("entitlement_checks").collect()) == [False, True]
    with pytest.raises(RuntimeError), book.span("r1", "stage"):
        raise RuntimeError
    assert book.read("telemetry").first()["latency_ms"] >= 0
    book.deliver("r1", "regional_vp", "dashboard", "pull_only", "x" * 400)
    assert len(book.read("delivery_log").first()["message_preview"]) == 280 and book.tail("ledger", 1).first()["run_id"] == "r3"


def test_cache(book):
    assert book.cache_get("action", "k") is None
    book.cache_put("action", "k", "m", "1")
    book.cache_put("action", "k", "m", "2")
    assert book.cache_get("action", "k") == "2" and ledger.cache_view(book.read("cache")).first()["hit_count"] == 1
    book.cache_clear("action")
    assert book.cache_get("action", "k") is None


def test_merging_verdicts(spark):
    old = spark.createDataFrame([("h", "KILLED"), ("h_llm2", "KILLED")], "hypothesis_id string, verdict string")
    new = spark.createDataFrame([("h",), ("g",)], "hypothesis_id string")
    assert sorted(r[0] for r in ledger.with_fresh_ids(old, new).select("hypothesis_id").collect()) == ["g", "h_llm3"]
    both = ledger.merge_verdicts(old, new.withColumn("region", F.lit("Central")))
    assert {(r["region"], r["kpi"]) for r in both.collect()} == {("West", "revenue"), ("Central", "revenue")}


def test_actions(spark, book):
    reps = spark.createDataFrame([("West", "2025-08", "2025-08-01", 12), ("West", "2025-08", None, 15), ("West", "2025-07", None, 1)], "region string, month string, attrition_date string, assigned_accounts int")
    row = actions.rep_capacity(reps).first()
    assert (row["n_departed"], row["accounts_needed"], row["headroom"], row["fits"], row["shortfall"]) == (1, 12, 5, False, 7)
    ops = generate.fulfillment_center_ops(spark)
    got = {r["fulfillment_center"]: r["fits"] for r in actions.center_capacity(ops).collect()}
    assert got == {"WEST_DC": True, "EAST_DC": True, "CENTRAL_DC": False}
    verdicts = spark.createDataFrame([("a", "SURVIVED", None, "rep_id", None, None), ("b", "SURVIVED", 0.01, "rep_id", "West", "revenue"), ("c", "KILLED", 0.001, "rep_id", "West", "revenue")], "hypothesis_id string, verdict string, p_bh double, dim string, region string, kpi string")
    made = actions.recommend(book, "West", "revenue", verdicts, [], {"crm_headcount": reps})
    assert made["hypothesis_id"] == "b" and made["confidence"] == "Medium" and "7 accounts" in made["action"]
    assert actions.recommend(book, "West", "revenue", verdicts, [], {"crm_headcount": reps}) == made
    assert actions.recommend(book, "East", "revenue", verdicts, [], {}) == {"has_action": False}
    assert "b" in actions.brief("ops_manager", "Down", [{"verdict": "SURVIVED", "hypothesis_id": "b"}], made)
    rows = spark.createDataFrame([(True, "High", ["a", "b"]), (True, "Low", ["a", "b"]), (False, "High", ["a", "b"]), (True, "High", ["x"]), (True, "High", None)], "has boolean, conf string, ch array<string>")
    channel, kind = actions.delivery_channel(F.col("has"), F.col("conf"), F.col("ch"))
    assert [tuple(r) for r in rows.select(channel, kind).collect()] == [("a", "urgent_push"), ("a", "routine_push"), ("dashboard", "pull_only"), ("dashboard", "pull_only"), ("dashboard", "pull_only")]
    with pytest.raises(ValueError):
        actions.series_of(spark.createDataFrame([("West", 1, 2.0)], "region string, week int, revenue double"), "West", "profit")


def test_feedback(spark, book):
    book.write_verdicts("r1", verdict_rows(spark, [("a", "SURVIVED", -0.3, 0.01, 0.02, 0.1, 0.1, "t", "c", "rep_id")]))
    out = actions.submit_feedback(book, "r2", "a", "regional_vp", "look again", {}, lambda raw: verdict_rows(spark, [("a2", "SURVIVED", -0.3, 0.01, 0.02, 0.1, 0.1, "t", "c", "rep_id")]))
    assert out == {"counter_verdict": "SURVIVED", "downgraded": True} and book.read("feedback").first()["original_verdict"] == "SURVIVED"


def test_graph(spark):
    verdicts = spark.createDataFrame([("h1", "rep_id", "SURVIVED", "placebo"), ("h2", "rep_id", "KILLED", "specificity"), ("h3", "channel", "KILLED", "placebo"), ("h4", "x", "KILLED", "precedence")], "hypothesis_id string, dim string, verdict string, test_archetype string")
    nodes, edges = graph.contract_graph(spark, verdicts, {"revenue": {"sources": ["pos_transactions", "missing"], "drivers": ["units_sold"]}})
    assert nodes.where("id = 'hyp:h1'").count() == 1 and edges.where("target = 'source:missing'").count() == 0
    assert {(r["neighbour"], r["direction"]) for r in graph.related(edges, "dim:rep_id").collect()} == {("hyp:h1", "in"), ("hyp:h2", "in"), ("source:crm_headcount", "out")}
    hops = {r["node"]: r["hops"] for r in graph.blast_radius(edges, "hyp:h1", 2).collect()}
    assert hops["dim:rep_id"] == 1 and hops["hyp:h2"] == 2 and "hyp:h1" not in hops
    assert {r["hypothesis_id"]: (r["same_dim"], r["same_archetype"]) for r in graph.shared_mechanism(verdicts, "h1").collect()} == {"h2": (True, False), "h3": (False, True)}


def test_methods_and_proposals(spark, book):
    rows = methods.methods(spark)
    methods.assert_no_model_numbers(rows)
    with pytest.raises(AssertionError):
        methods.assert_no_model_numbers(rows.withColumn("is_quantitative", F.lit(True)))
    assert methods.by_category(rows).where("category = 'llm'").first()["n"] == 2
    config = proposer.ProposerConfig().updated(backend="hosted", api_key="s")
    assert config.public() == {"backend": "hosted", "model": None, "has_api_key": True} and proposer.hosted_cost(1000, 1000) == pytest.approx(0.018)
    good = json.dumps({"hypothesis_id": "h", "mechanism": "m", "test_archetype": "placebo", "treatment": {"dim": "channel", "in": ["a"]}, "control": {"dim": "channel", "in": ["b"]}, "outcome": {"metric": "revenue", "expect": "decline"}, "temporal": {"cause_onset": "2025-01-01", "kpi_onset": "2025-01-02"}, "refutes_if": {"condition": "x", "rationale": "y"}})
    answers = iter(["not json", good])
    ask = lambda text: (next(answers), 10, 5)
    made = proposer.propose_for_topic(book, ask, {"t": 1}, {}, {"channel": ["a", "b"]}, config)
    assert made["attempts"] == 2 and made["tokens_in"] == 20 and made["predicate"]["treatment"]["in"] == ["a"]
    again = proposer.propose_for_topic(book, ask, {"t": 1}, {}, {"channel": ["a", "b"]}, config)
    assert again["cached"] and again["tokens_in"] == 0 and book.read("telemetry").count() == 1
    assert proposer.propose_for_topic(book, None, {"t": 2}, {}, {})["reason"] == "no backend"


def test_region_loss(spark):
    rows = spark.createDataFrame([("W", "a", 10.0), ("W", "b", 4.0), ("W", "c", 6.0)], "region string, month string, gross_revenue double")
    assert localise.region_loss(rows, ["a"], ["b", "c"]).first()["loss"] == -5.0
