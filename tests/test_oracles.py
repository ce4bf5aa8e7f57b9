"""Every registered query of the library's own operators against its SQL, over the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from veridelta import contract
from veridelta.operators import signal
from veridelta.plans import adjudication, bookkeeping, extended, flows, monitoring, movements, reconciliation, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, duck, tmp_path, name):
    out = f"{tmp_path}/out"
    registry.QUERIES[name](spark, SF).write.parquet(out)
    ours = duck.sql(f"select * from '{out}/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in sorted(ours.columns))
    assert sorted(ours.columns) == sorted(duck.sql(registry.ORACLE[name]).columns)
    duck.execute(f"create or replace temp table expected as select {columns} from ({registry.ORACLE[name]})")
    missing = duck.sql(f"select * from expected except all select {columns} from '{out}/*.parquet'").fetchall()
    extra = duck.sql(f"select {columns} from '{out}/*.parquet' except all select * from expected").fetchall()
    assert not missing and not extra


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_gate_of_every_series_against_a_plain_fold(spark):
    """The changepoint of each series by the posterior's definition, a point at a time over plain lists."""
    series = {}
    for r in movements.weekly_series(spark, SF).collect():
        series.setdefault((r["kpi"], r["region"], r["period_unit"]), []).append((r["period"], r["value"]))
    limits = {r["kpi"]: (r["pct_threshold"], r["abs_threshold"]) for r in contract.kpi_table(spark).collect()}
    got = {(r["kpi"], r["region"], r["period_unit"]): r for r in registry.QUERIES["gate_all"](spark, SF).collect()}
    assert set(got) == set(series)
    for key, points in sorted(series.items())[::5]:
        values = np.array([v for _, v in sorted(points) if v is not None])
        last, _ = signal.run_lengths(values, signal.prior_of(values), signal.HAZARD)
        tau, confidence = len(last) - int(np.argmax(last)) + 1, float(last[max(0, int(np.argmax(last)) - signal.NEIGHBOURHOOD) : int(np.argmax(last)) + signal.NEIGHBOURHOOD + 1].sum())
        start = min(max(tau - 1, 1), len(values) - 1)
        base, recent = values[max(0, start - signal.LOOK_BACK) : start].mean(), values[start:].mean()
        pct, amount = limits[key[0]]
        window = signal.RECENT_MONTHS if key[2] == "month" else signal.RECENT_WEEKS
        statistical = confidence > signal.POSTERIOR and tau > 1 and tau > len(values) - window
        business = base != 0 and (abs(recent / base - 1) >= pct or (amount is not None and abs(recent - base) >= amount))
        r = got[key]
        assert (r["tau"], r["statistical_materiality"], r["business_materiality"]) == (tau, statistical, business)
        assert r["gate_passed"] == (statistical and business and len(values) >= signal.SPARSE)
