"""Interval, as-of and full-outer joins and the lattice against plain loops, with nulls, ties, hot keys and empty tables."""

import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veridelta.operators import joins, lattice

POINTS, WINDOWS = "k string, t long, p int, _level int", "k string, a long, b long, w int, bucket int"


def interval_case(seed, n=300, m=60):
    rng = random.Random(seed)
    points = [(rng.choice(["x", "x", "x", "y", None]), rng.choice([None, *range(-50, 400, 3)] + [rng.randint(-100, 2**40)]), i, 0) for i in range(n)]
    windows = []
    for i in range(m):
        a = rng.randint(-60, 300)
        windows.append((rng.choice(["x", "y", "z", None]), a, a + rng.choice([0, 0, 1, 7, 64, 65, 300, 2**41, -5]), i, 0))
    windows += [("x", None, 5, 900, 0), ("x", 5, None, 901, 0), windows[0], ("x", -(2**62), 2**62, 902, 0)]
    return points + points[:5], windows


@pytest.mark.parametrize("on", [["k"], []])
def test_intervals_against_a_loop(spark, on):
    points, windows = interval_case(3)
    p, w = spark.createDataFrame(points, POINTS), spark.createDataFrame(windows, WINDOWS)
    w = w if on else w.drop("k")
    got = joins.interval_join(p, w, "t", "a", "b", on)
    expected = sorted((x[2], y[3]) for x, y in itertools.product(points, windows) if x[1] is not None and None not in y[1:3] and y[1] <= x[1] <= y[2] and (not on or (x[0] is not None and x[0] == y[0])))
    assert sorted((r["p"], r["w"]) for r in got.collect()) == expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joins.interval_join(p.limit(0), w, "t", "a", "b", on).count() == joins.interval_join(p, w.limit(0), "t", "a", "b", on).count() == 0


def test_a_long_window_touches_two_buckets(spark):
    """A window of 2^50 meets a point in at most two rows, whatever the shortest window is."""
    p = spark.range(2000).select(F.col("id").alias("t"))
    w = spark.createDataFrame([(0, 2**50, 1), (5, 5, 2)], "a long, b long, w int")
    assert {r["w"]: r["count"] for r in joins.interval_join(p, w, "t", "a", "b").groupBy("w").count().collect()} == {1: 2000, 2: 1}


@pytest.mark.parametrize("width", [None, 1, 7, 10**6])
@pytest.mark.parametrize("tolerance", [None, 20])
def test_asof_against_a_loop(spark, width, tolerance):
    rng = random.Random(5)
    facts = [(rng.choice(["hot", "hot", "hot", "b", "none", None]), rng.choice([None, *range(0, 200, 2)]), i, "row") for i in range(250)]
    facts += [("hot", 100, 1000 + i, "tie") for i in range(60)] + facts[:3]
    states = [(rng.choice(["hot", "b", None]), rng.choice([None, *range(0, 200, 9)]), rng.choice([None, *range(5)]), i) for i in range(40)] + [("hot", 50, 3, 7), ("hot", 50, 3, 9)]
    f, s = spark.createDataFrame(facts, "k string, t long, id int, _t string"), spark.createDataFrame(states, "k string, since long, level int, s int")
    got = joins.asof_join(f.repartition(3), s, "t", "since", ["k"], tolerance, width)
    low = lambda x: (x is not None, x)  # noqa: E731  nulls first
    expected = []
    for k, t, i, tag in facts:
        fit = [x for x in states if k is not None and x[0] == k and None not in (t, x[1]) and x[1] <= t]
        best = max(fit, key=lambda x: (x[1], low(x[2]), x[3]), default=None)
        if best is not None and tolerance is not None and t - best[1] > tolerance:
            best = None
        expected.append((k, t, i, tag, *(best[1:] if best else (None, None, None))))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert got.columns == ["k", "t", "id", "_t", "since", "level", "s"]


def test_asof_of_empty_tables(spark):
    f, s = spark.createDataFrame([("a", 1)], "k string, t long"), spark.createDataFrame([], "k string, since long, v int")
    assert [tuple(r) for r in joins.asof_join(f, s, "t", "since", ["k"]).collect()] == [("a", 1, None, None)]
    assert joins.asof_join(f.limit(0), s, "t", "since", ["k"]).count() == 0


def test_balance_adds_up(spark):
    left = spark.createDataFrame([("a", 100), ("a", 0), ("b", 200), (None, 7), ("c", 50), ("e", 0), ("f", None), ("g", 100)], "k string, x int")
    right = spark.createDataFrame([("a", 100), ("b", 199), (None, 3), ("d", 11), ("e", 5), ("f", 1), ("g", 97), ("c", 10)], "k string, y int")
    rows = joins.balanced(left, right, ["k"], "x", "y")
    got = {(r["k"], r["side"]): (r["x"], r["y"], r["agreement"]) for r in rows.collect()}
    assert got == {
        ("a", "both"): (100, 100, "equal"), ("b", "both"): (200, 199, "within"), ("g", "both"): (100, 97, "near"), ("c", "both"): (50, 10, "beyond"), ("d", "right"): (None, 11, "unmatched"),
        (None, "left"): (7, None, "unmatched"), (None, "right"): (None, 3, "unmatched"), ("e", "both"): (0, 5, "beyond"), ("f", "both"): (None, 1, "unknown"),
    }
    totals = {(r["agreement"], r["side"]): (r["n"], r["left_total"], r["right_total"]) for r in joins.balance_totals(rows, "x", "y").collect()}
    assert totals.pop(("all", "all")) == (9, 457, 426)
    assert tuple(map(sum, zip(*totals.values(), strict=True))) == (9, 457, 426)
    empty = joins.balanced(left.limit(0), right.limit(0), ["k"], "x", "y")
    assert joins.balance_totals(empty, "x", "y").count() == 0


SALES = "week int, a string, b string, gross_revenue decimal(18,4)"


def sales(spark, rows):
    return spark.createDataFrame([(w, a, b, Decimal(v)) for w, a, b, v in rows], SALES)


def test_cells_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.randint(1, 6), rng.choice(["p", "q", None]), rng.choice(["u", "v", None]), rng.randint(1, 90)) for _ in range(200)]
    got = lattice.cells(sales(spark, rows), ["a", "b"], (1, 2), (4, 5)).collect()
    expected = {}
    for w, a, b, v in rows:
        for cell in range(4):
            if w in (1, 2, 4, 5):
                key = (a if cell & 1 else None, b if cell & 2 else None, cell)
                x = expected.setdefault(key, [0, 0])
                x[w > 3] += v
    assert {(r["a"], r["b"], r["cell"]): [int(r["before"]), int(r["after"])] for r in got} == expected
    assert len(got) == len(expected) and all(r["delta"] == r["after"] - r["before"] and r["level"] == r["cell"].bit_count() for r in got)
    assert lattice.cells(sales(spark, []), ["a", "b"], (1, 2), (4, 5)).count() == 0


def test_root_cause_is_the_narrowest_cell_that_explains(spark):
    """All of the loss is in (p, null); a real null is a cell of its own, not a sum over all."""
    rows = [(1, a, b, 100) for a in ("p", "q") for b in ("u", None)] + [(4, a, b, 10 if (a, b) == ("p", None) else 100) for a in ("p", "q") for b in ("u", None)]
    found = lattice.root_causes(lattice.cells(sales(spark, rows), ["a", "b"], (1, 1), (4, 4)), ["a", "b"]).collect()
    assert [(r["a"], r["b"], r["cell"], r["explained"]) for r in found] == [("p", None, 3, 1.0)]
    even = [(w, a, b, 100 - 10 * (w == 4)) for w in (1, 4) for a in ("p", "q") for b in ("u", "v")]
    found = lattice.root_causes(lattice.cells(sales(spark, even), ["a", "b"], (1, 1), (4, 4)), ["a", "b"]).collect()
    assert (None, None, 0) in {(r["a"], r["b"], r["cell"]) for r in found}  # nothing below has four fifths of it
    still = [(w, "p", "u", 100) for w in (1, 4)]
    assert lattice.root_causes(lattice.cells(sales(spark, still), ["a", "b"], (1, 1), (4, 4)), ["a", "b"]).count() == 0


def test_sketches_merge_as_if_made_at_once(spark):
    from veridelta.operators import sketches

    rng = random.Random(2)
    rows = [(w, rng.choice([None, *range(3000)]), rng.choice([None, 1.0, rng.lognormvariate(3, 1)])) for w in range(8) for _ in range(2500)] + [(9, None, None)]
    df = spark.createDataFrame(rows, "week int, key int, amount double")
    weekly = sketches.sketched(df, ["week"], "key", "amount")
    whole = sketches.merged(weekly.where("week < 9"), []).select("n", "total", sketches.distinct_of(F.col("keys")).alias("d"), sketches.quantile_of(F.col("amounts"), 0.5).alias("m")).first()
    keys, amounts = {k for _, k, _ in rows if k is not None}, sorted(a for *_, a in rows if a is not None)
    assert whole["n"] == 20000 and abs(whole["d"] - len(keys)) <= sketches.distinct_error() * len(keys)
    low, high = sum(a < whole["m"] for a in amounts) / len(amounts), sum(a <= whole["m"] for a in amounts) / len(amounts)
    assert low - sketches.rank_error() <= 0.5 <= high + sketches.rank_error()
    empty = weekly.where("week = 9").select("n", "total", sketches.distinct_of(F.col("keys")).alias("d"), sketches.quantile_of(F.col("amounts"), 0.5).alias("m")).first()
    assert tuple(empty) == (1, None, 0, None)
    assert sketches.sketched(df.limit(0), ["week"], "key", "amount").count() == 0
