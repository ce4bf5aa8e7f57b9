"""The gate on a stream against a fold, late rows, restarts, and the interval join of two streams."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from veridelta.functions import table_functions
from veridelta.operators import localise, signal
from veridelta.streaming import gate

PRIOR = (100.0, 1.0, 2.0, 9.0)
DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "region string, ts timestamp, amount double"


@pytest.fixture
def stateful(spark):
    name, provider = gate.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    yield spark
    spark.conf.set(name, before)


def write(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{k}")


def run(spark, folder, out, name):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    closed = gate.gate_stream(rows, "region", "ts", "amount", PRIOR, seconds=86400, lateness="1 day")
    query = closed.writeStream.format("parquet").option("checkpointLocation", f"{out}/{name}-state").outputMode("append").trigger(availableNow=True).start(f"{out}/{name}")
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(gate.CLOSED).parquet(f"{out}/{name}").collect())


def test_periods_close_once_and_a_restart_changes_nothing(stateful, tmp_path):
    rng = np.random.default_rng(3)
    days = {d: [round(float(x), 2) for x in rng.normal(50 if d < 14 else 40, 0.5, 2)] for d in range(20)}
    at = lambda d, h: DAY + timedelta(days=d, hours=h)
    files = [[("West", at(d, h), v) for d in range(k, k + 5) for h, v in zip((3, 9), days[d], strict=True)] for k in (0, 5, 10, 15)]
    files[2] += [("West", at(2, 5), 7.0), ("West", at(1, 5), 7.0), (None, at(11, 1), 1.0), ("West", None, 1.0), ("East", at(14, 1), 5.0)]
    folder = str(tmp_path / "in")
    for k, rows in enumerate(files[:2]):
        write(stateful, folder, k, rows)
    first = run(stateful, folder, str(tmp_path), "restarted")
    for k, rows in enumerate(files[2:], 2):
        write(stateful, folder, k, rows)
    got = run(stateful, folder, str(tmp_path), "restarted")
    assert set(first) < set(got)
    whole = run(stateful, folder, str(tmp_path), "at-once")
    without_late = lambda rows: [(*r[:4], *r[5:]) for r in rows]  # noqa: E731  which period tells of late rows hangs on the batches, how many there are doesn't
    assert without_late(whole) == without_late(got) and sum(r[4] for r in whole) == sum(r[4] for r in got)
    base = int(DAY.timestamp()) // 86400
    west = [r for r in got if r[0] == "West"]
    assert [r[1] - base for r in west] == list(range(len(west))) and 17 <= len(west) <= 19
    assert [round(r[2], 4) for r in west] == [round(sum(days[d]), 4) for d in range(len(west))] and all(r[3] == 2 for r in west)
    assert sum(r[4] for r in west) == 2  # both late rows, told once
    for k, r in enumerate(west, 1):
        tau, confidence = signal.changepoint(signal.run_lengths(np.array([x[2] for x in west[:k]]), PRIOR)[0])
        assert r[5] == tau and r[6] == pytest.approx(confidence)
    assert [r[5] for r in west if r[8]] and len({r[5] for r in west if r[8]}) == len([r for r in west if r[8]])


def test_causes_of_two_streams(stateful, tmp_path):
    at = lambda d: DAY + timedelta(days=d)
    stateful.createDataFrame([("West", at(20)), ("West", at(40)), ("East", at(20))], "key string, moved_at timestamp").write.parquet(str(tmp_path / "m"))
    stateful.createDataFrame([("West", at(5), "a"), ("West", at(6), "b"), ("West", at(20), "c"), ("West", at(21), "d"), (None, at(20), "e"), ("East", at(19), "f")], "key string, caused_at timestamp, what string").write.parquet(str(tmp_path / "c"))
    streams = [stateful.readStream.schema(stateful.read.parquet(str(tmp_path / x)).schema).parquet(str(tmp_path / x)) for x in "mc"]
    query = gate.causes_before(*streams).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert sorted((r["key"], r["what"]) for r in stateful.read.parquet(str(tmp_path / "out")).collect()) == [("East", "f"), ("West", "b"), ("West", "c")]


def test_table_functions(spark):
    table_functions.register(spark)
    rows = [("West", p, 100.0 + p % 3 - 20 * (p > 12)) for p in range(1, 17)] + [("West", 17, None), ("Empty", 1, None), (None, 1, 5.0), (None, 2, 6.0)]
    series = spark.createDataFrame(rows, "region string, period int, value double").repartition(3)
    call = "select * from changepoints(TABLE(select * from {t}) PARTITION BY (region) ORDER BY period)"
    got = {r["region"]: r for r in spark.sql(call, t=series).collect()}
    values = np.array([v for r, _, v in rows if r == "West" and v is not None])
    tau, confidence = signal.changepoint(signal.run_lengths(values, signal.prior_of(values))[0])
    assert set(got) == {"West", None} and (got["West"]["n_observations"], got["West"]["tau"]) == (16, tau) and got["West"]["confidence"] == pytest.approx(confidence)
    assert spark.sql(call, t=series.limit(0)).count() == 0
    with pytest.raises(AnalysisException, match="the table lacks value"):
        spark.sql(call, t=series.drop("value"))
    with pytest.raises(AnalysisException, match="named as a result"):
        spark.sql(call, t=series.withColumn("tau", F.lit(1)))
    sales = spark.createDataFrame([("a", 1, 10, 100.0), ("a", 2, 5, 60.0), ("a", 5, 8, 72.0), ("b", 1, 0, None), ("b", 9, 1, 1.0), ("c", 9, 1, 1.0)], "region string, week int, units int, gross_revenue double")
    told = spark.sql("select * from price_volume(TABLE(select * from {t}) PARTITION BY (region), 1, 2, 5, 6)", t=sales)
    plain = localise.price_volume_bridge(sales, ["region"], (1, 2), (5, 6))
    assert sorted(map(str, told.collect())) == sorted(map(str, plain.select(told.columns).collect()))
