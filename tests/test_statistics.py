"""Distributions, signal and localisation against plain versions and planted frames."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridelta import contract
from veridelta.functions import stats
from veridelta.functions.columns import half_even, mid_month_week, month_of_week, normal_two_sided, ratio, week_of
from veridelta.operators import localise, signal
from veridelta.streaming import signals


def test_normal_p(spark):
    zs = [0.0, 0.3, -1.96, 2.5758, 5.0, -8.0, 20.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_two_sided(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), abs=1e-12)
    assert spark.range(1).select(normal_two_sided(F.lit(None).cast("double"))).first()[0] is None


def test_calendar_and_ratio(spark):
    row = spark.sql("select date '2025-01-05' as a, date '2025-01-06' as b, date '2025-08-18' as c").select(week_of(F.col("a"), "2025-01-06"), week_of(F.col("b"), "2025-01-06"), week_of(F.col("c"), "2025-01-06"), month_of_week(F.lit(5), "2025-01-06"), mid_month_week(F.lit("2025-02"), "2025-01-06"), ratio(F.lit(3), F.lit(0)), half_even(F.lit(0.125), 2)).first()
    assert list(row) == [0, 1, 33, "2025-02", 6, 0.0, 0.12]


def test_t_and_power():
    assert stats.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.detectable_effect(10, 10) == pytest.approx(1.32495, abs=1e-4)
    assert math.isinf(stats.detectable_effect(1, 10))
    assert stats.correlation_mde(12) == pytest.approx(0.7324, abs=1e-4) and math.isinf(stats.correlation_mde(3))
    assert [stats.psi_verdict(x) for x in (0.0, 0.1, 0.25, None)] == ["STABLE", "MODERATE_SHIFT", "SIGNIFICANT_DRIFT", "UNKNOWN"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e4, 1e4), min_size=1, max_size=40), st.sampled_from([10.0, 15.0]))
def test_run_lengths_keep_the_mass_of_no_hazard(values, hazard):
    series = np.array(values)
    last, first = signal.run_lengths(series, signal.prior_of(series), hazard)
    assert last.sum() == pytest.approx(1 - 1 / hazard) and len(last) == len(first) == len(values)
    tau, confidence = signal.changepoint(last)
    assert 1 <= tau <= len(values) + 1 and 0 <= confidence <= 1 - 1 / hazard + 1e-9


def series(spark, kpi, region, values, unit="week", baseline=None):
    rows = [(kpi, region, unit, i + 1, None if v is None else float(v), None if baseline is None else [float(x) for x in baseline]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "kpi string, region string, period_unit string, period int, value double, baseline array<double>")


def test_gate_on_planted_series(spark):
    rng = np.random.default_rng(3)
    noise = 50000 * (1 + 0.02 * rng.normal(size=40))
    shift = np.where(np.arange(40) >= 31, noise * 0.8, noise)
    sparse = [100.0, 101, 99, 150, 151, None, 149]
    rows = series(spark, "revenue", "West", shift).unionByName(series(spark, "revenue", "East", noise)).unionByName(series(spark, "new_category_revenue", "West", sparse, baseline=[100.0, 90, 110, 105, 95]))
    got = {(r["kpi"], r["region"]): r for r in signal.gate(signal.detect(rows), contract.kpi_table(spark)).collect()}
    west = got["revenue", "West"]
    assert west["gate_passed"] and abs(west["tau"] - 32) <= 2 and west["impact_pct"] < -0.1
    assert not got["revenue", "East"]["gate_passed"]
    small = got["new_category_revenue", "West"]
    assert small["sparse_history"] and not small["gate_passed"] and small["n_trimmed"] == 1 and small["n_observations"] == 6


def test_priorities_and_same_event(spark):
    rows = [("revenue", "West", 32, 0.8, -0.1, -5000.0, True, 32), ("units_sold", "West", 33, 0.8, -0.1, -50.0, True, 33), ("revenue", "East", 10, 0.9, -0.1, -9000.0, True, 10), ("units_sold", "East", 10, 0.9, 0.0, -1.0, False, 10)]
    gated = spark.createDataFrame(rows, "kpi string, region string, tau int, confidence double, impact_pct double, impact_abs double, gate_passed boolean, calendar_week int")
    got = signal.prioritize(gated).orderBy("priority_rank").collect()
    assert [(r["kpi"], r["region"], r["same_event_as"]) for r in got] == [("revenue", "East", []), ("revenue", "West", ["units_sold"]), ("units_sold", "West", ["revenue"])]


def test_streaming_equals_batch(spark, tmp_path):
    values = np.r_[np.full(12, 10.0), np.full(8, 30.0)] + np.arange(20) % 3
    prior = signal.prior_of(values)
    pd.DataFrame({"key": "a", "period": range(20), "value": values}).iloc[:13].to_parquet(tmp_path / "1.parquet")
    pd.DataFrame({"key": "a", "period": range(20), "value": values}).iloc[13:].to_parquet(tmp_path / "2.parquet")
    source = spark.readStream.schema("key string, period long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = signals.streaming_changepoints(source, prior).writeStream.format("memory").queryName("changes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("changes").orderBy("period").collect()
    for n, r in enumerate(got, 1):
        tau, confidence = signal.changepoint(signal.run_lengths(values[:n], prior)[0])
        assert (r["tau"], r["confidence"]) == (tau, pytest.approx(confidence))
    assert len(got) == 20


def test_long_streams_equal_batch(spark, tmp_path):
    """A stable series of 2,500 points, then a change: neither old runs nor the place in the series are lost."""
    values = np.r_[np.full(2500, 10.0), np.full(100, 30.0)] + np.arange(2600) % 3
    prior = signal.prior_of(values)
    for k, part in enumerate((slice(0, 1500), slice(1500, 2600))):
        pd.DataFrame({"key": "a", "period": range(2600), "value": values}).iloc[part].to_parquet(tmp_path / f"{k}.parquet")
    source = spark.readStream.schema("key string, period long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = signals.streaming_changepoints(source, prior).writeStream.format("memory").queryName("long_changes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["period"] + 1: r for r in spark.table("long_changes").collect()}
    for n in (1999, 2000, 2001, 2300, 2500, 2501, 2510, 2600):
        tau, confidence = signal.changepoint(signal.run_lengths(values[:n], prior)[0])
        assert (got[n]["tau"], got[n]["confidence"]) == (tau, pytest.approx(confidence))
    assert len(got) == 2600 and abs(got[2600]["tau"] - 2501) <= 2


def test_streaming_counts(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 01:00", "2024-01-01 02:00", "2024-01-02 01:00", "2024-01-09 01:00"]).astype("datetime64[us]"), "kind": ["a", "a", "a", "b"]})
    rows.to_parquet(tmp_path / "e.parquet")
    counts = signals.windowed_counts(spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path)), "kind", "ts")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["value"] for r in spark.table("counts").collect()) == [1.0, 2.0]


@pytest.fixture(scope="module")
def sales(spark):
    rng = np.random.default_rng(5)
    rows = [("West", c, w, int(rng.integers(5, 50)), float(rng.integers(100, 900))) for c in ("A", "B", "C") for w in (1, 2, 3, 5, 6, 7) for _ in range(30)]
    return spark.createDataFrame(rows, "region string, product_category string, week int, units int, gross_revenue double")


def test_bridge_adds_up(sales):
    r = localise.price_volume_bridge(sales, ["region"], (1, 3), (5, 7)).first()
    assert r["volume_effect"] + r["price_effect"] == pytest.approx(r["revenue_post"] - r["revenue_pre"]) and r["mix_effect"] == pytest.approx(0, abs=1e-6)


def test_shapley(spark, sales):
    deltas = {r["player"]: r["delta"] for r in localise.category_deltas(sales, [], "product_category", (1, 3), (5, 7)).collect()}
    pdf = sales.toPandas()
    assert sum(deltas.values()) == pytest.approx(pdf[pdf.week >= 5].gross_revenue.sum() - pdf[pdf.week <= 3].gross_revenue.sum())
    members = [(1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "a"), (3, "b"), (4, "b"), (4, "b")]
    players = ["a", "b", "c"]
    frame = spark.createDataFrame(members, "m int, p string")
    got = {r["player"]: r["value"] for r in localise.shapley_exact(localise.coverage_worth(frame, players, "m", "p"), players).collect()}
    worth = lambda s: len({m for m, p in members if p in s})
    for p in players:
        orders = list(itertools.permutations(players))
        assert got[p] == pytest.approx(sum(worth(o[: o.index(p) + 1]) - worth(o[: o.index(p)]) for o in orders) / len(orders))
    with pytest.raises(ValueError):
        localise.shapley_exact(frame, list("abcdefghi"))


def test_bootstrap_covers_the_point(sales):
    point = {r["player"]: r["delta"] for r in localise.category_deltas(sales, [], "product_category", (1, 3), (5, 7)).collect()}
    for r in localise.bootstrap_deltas(sales, "product_category", (1, 3), (5, 7), 200).collect():
        assert r["low"] < point[r["player"]] < r["high"]


def test_bootstrap_is_the_same_however_rows_are_dealt(sales):
    """The same bounds from one task and from many, with equal rows drawn each for itself."""
    sales = sales.unionByName(sales.limit(5))
    bounds = lambda df: {r["player"]: (round(r["low"], 6), round(r["high"], 6)) for r in localise.bootstrap_deltas(df, "product_category", (1, 3), (5, 7), 100).collect()}
    assert bounds(sales.coalesce(1)) == bounds(sales.repartition(7))
    assert localise.bootstrap_deltas(sales.limit(0), "product_category", (1, 3), (5, 7), 100).count() == 0


def test_poisson_draws():
    draws = localise.poisson_draws(np.arange(4000, dtype=np.int64) * 2**31 - 5, 200)
    assert abs(draws.mean() - 1) < 0.01 and abs(draws.var() - 1) < 0.02
    shares = np.bincount(draws.ravel(), minlength=4)[:4] / draws.size
    assert np.allclose(shares, [math.exp(-1), math.exp(-1), math.exp(-1) / 2, math.exp(-1) / 6], atol=0.003)
    assert abs(np.corrcoef(draws[0], draws[1])[0, 1]) < 0.05 and abs(np.corrcoef(draws[:, 0], draws[:, 1])[0, 1]) < 0.2


def test_rep_shares(spark):
    reps = spark.createDataFrame([("West", "2025-07", "W1", 100.0), ("West", "2025-08", "W1", 20.0), ("West", "2025-07", "W2", 50.0), ("West", "2025-09", "W2", 60.0)], "region string, month string, rep_id string, rep_attributed_revenue double")
    loss = spark.createDataFrame([("West", -100.0)], "region string, loss double")
    got = {r["rep_id"]: (r["delta"], r["share"]) for r in localise.rep_shares(reps, ["2025-07"], ["2025-08", "2025-09"], loss).collect()}
    assert got == {"W1": (-80.0, 0.8), "W2": (10.0, -0.1)}
