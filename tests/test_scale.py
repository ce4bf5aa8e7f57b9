"""What keeps the queries' cost in proportion to their input: facts read once, sweeps in place of pairs, blocks that needn't be repeated."""

import math
import random
import re
from collections import Counter
from decimal import Decimal
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridelta.operators import joins, topics
from veridelta.plans import flows, movements, reconciliation, registry  # noqa: F401  each registers its queries

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["panel_weekly", "panel_ordered", "kpi_series", "claim_bounds", "gate_all", "sketched_quarters"])
def test_the_panel_reads_a_cube_of_the_facts(spark, name):
    assert "l_orderkey" not in plan_of(registry.QUERIES[name](spark, SF))


def plain_totals(points, windows):
    out = {}
    for g, t, v in points:
        for w, a, b in windows:
            if None not in (t, a, b) and a <= t <= b:
                x = out.setdefault(g, [0, set(), None])
                x[0], x[1] = x[0] + 1, x[1] | ({w} - {None})
                x[2] = x[2] if v is None else (x[2] or 0) + v
    return {g: (n, len(w), v) for g, (n, w, v) in out.items()}


def test_totals_of_intervals_against_a_loop(spark):
    rng = random.Random(4)
    points = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 300, 5)]), rng.choice([None, Decimal(rng.randint(-9, 99))])) for _ in range(200)] + [("far", 2**50, Decimal(1)), ("early", -(2**50), Decimal(1))]
    windows = [(rng.choice([None, *range(30)]), a, a + rng.choice([0, 0, 3, 40, -2])) for a in (rng.randint(-60, 320) for _ in range(80))] + [(90, -(2**62), 2**62), (91, None, 5), (92, 5, None), (93, 295, 2**63 - 1)]
    p, w = spark.createDataFrame(points + points[:9], "g string, t long, v decimal(18,4)"), spark.createDataFrame(windows + windows[:5], "id int, a long, b long")
    got = joins.interval_totals(p, w, "t", "a", "b", "id", "g", "v")
    assert {r["g"]: (r["hits"], r["windows"], r["total"]) for r in got.collect()} == plain_totals(points + points[:9], windows + windows[:5])
    assert joins.interval_totals(p.limit(0), w, "t", "a", "b", "id", "g", "v").count() == joins.interval_totals(p, w.limit(0), "t", "a", "b", "id", "g", "v").count() == 0


def test_totals_of_a_crowd_make_no_pairs(spark):
    """200,000 points inside each of 200,000 windows: 4e10 pairs, which a join can't make."""
    p = spark.range(200_000).select(F.lit("x").alias("g"), F.col("id").alias("t"), F.lit(1).cast("decimal(18,4)").alias("v"))
    w = spark.range(200_000).select("id", F.lit(0).cast("long").alias("a"), F.lit(10**6).alias("b").cast("long"))
    assert [tuple(r) for r in joins.interval_totals(p, w, "t", "a", "b", "id", "g", "v").collect()] == [("x", 4 * 10**10, 200_000, Decimal(4 * 10**10))]


@pytest.mark.parametrize("bound", [0, 25, 10**6])
def test_asof_of_small_and_hot_keys(spark, monkeypatch, bound):
    """Keys that are sorted in one task and keys by buckets give the same; small ones need one shuffle of facts."""
    monkeypatch.setattr(joins, "KEY_ROWS", bound)
    rng = random.Random(8)
    facts = [(rng.choice(["hot"] * 9 + ["b", "none", None]), rng.choice([None, *range(90)]), i) for i in range(200)]
    states = [(rng.choice(["hot", "b", None]), rng.choice([None, *range(0, 90, 7)]), i) for i in range(40)]
    f, s = spark.createDataFrame(facts, "k string, t long, id int"), spark.createDataFrame(states, "k string, since long, v int")
    expected = []
    for k, t, i in facts:
        best = max(((x, v) for g, x, v in states if g is not None and g == k and None not in (x, t) and x <= t), default=(None, None))
        expected.append((k, t, i, *(best if best[0] is not None and t - best[0] <= 10 else (None, None))))
    got = joins.asof_join(f, s, "t", "since", ["k"], tolerance=10)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    if bound > 1000:
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("least", [-1.0, 0.2, 0.5, 0.9, 1.1])
def test_joined_within_by_tiles(least):
    """Parts by tiles of five are those of a plain walk over all pairs; a whole comparison held the square of a group."""
    rng = np.random.default_rng(6)
    mean = rng.normal(size=(43, 6))
    mean /= np.linalg.norm(mean, axis=1)[:, None]
    near, plain = mean @ mean.T >= least, list(range(43))
    for _ in plain:
        plain = [min([plain[i], *(plain[j] for j in range(43) if near[i, j])]) for i in range(43)]
    assert topics.joined_within(mean, least, tile=5).tolist() == topics.joined_within(mean, least).tolist() == plain


def test_blocks_are_sized_by_their_numbers(spark):
    """5,000 vectors of 64 numbers are one block, which isn't sent to pairs of blocks; blocks of 2,048 sent each vector three times."""
    rows = spark.createDataFrame([(i,) for i in range(40)], "c long").select(F.lit("g").alias("g"), "c", F.array(F.lit(1.0)).alias("s"), F.lit(1.0).alias("w"))
    assert topics.blocks_of(5000, 64) == 1 and topics.blocks_of(40_000, 64) == 3 and topics.blocks_of(5000, 0, 2048) == 3
    blocks = spark.createDataFrame([("g", topics.blocks_of(40, 64))], "g string, k int")
    assert topics._dealt(rows, blocks).count() == 40


def plain_terms(rows: list[tuple], top: int) -> list[tuple]:
    """(cluster, rank, term, weight) as the SQL of tfidf_terms has it: counts by key and cluster, norms by key."""
    counts, sizes = Counter(), Counter(c for _, c, _ in rows)
    for k, c, text in rows:
        words = re.findall(r"\w{2,}", (text or "").lower())
        counts.update((k, c, t) for t in [*words, *(f"{x} {y}" for x, y in zip(words, words[1:]))])
    df = Counter(t for _, _, t in counts)
    weight = {(k, c, t): n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for (k, c, t), n in counts.items()}
    norm, sums = Counter(), Counter()
    for (k, _, _), w in weight.items():
        norm[k] += w * w
    for (k, c, t), w in weight.items():
        if k is not None and c is not None:
            sums[c, t] += w / math.sqrt(norm[k])
    out = []
    for c in {c for c, _ in sums}:
        best = sorted((-round(s / sizes[c], 9), t) for (d, t), s in sums.items() if d == c)[:top]
        out += [(c, i + 1, t, -w) for i, (w, t) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 22, 2000, 150])
def test_terms_by_blocks(spark, block):
    """Terms by blocks are those of all texts at once: in one block and in many, with clusters of one text, keys of several clusters (which were
    counted once for each row) and nulls."""
    rng = random.Random(4)
    words = ["die", "été", "snow", "x", "of", "a1", "_b", "straße", "ΣΊΣΥΦΟΣ", "rain", "数据", *(f"w{i}" for i in range(60))]
    text = lambda n: "".join(rng.choice(words[: rng.choice([6, 71])]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    rows = [(i, rng.choice(["hot"] * 5 + ["b", "c"]) if i < 120 else f"own {i}", text(rng.randrange(40))) for i in range(150)]
    rows += [(3, rows[3][1], text(9)), (4, "b", text(9)), (4, "c", text(9)), (4, "own 130", text(9)), (5, None, text(9)), (None, "b", text(9)), (None, "b", text(9)), (300, "c", None), (301, "hot", ""), (302, None, text(5)), (303, "own 303", "x - x")]
    frame = spark.createDataFrame(rows, "id int, c string, text string")
    got = topics.cluster_terms(frame, "c", "id", "text", 3, stop_words=[], block=block)
    assert sorted((r["c"], r["rank"], r["term"], r["weight"]) for r in got.collect()) == [(c, i, t, pytest.approx(w, abs=1.1e-9)) for c, i, t, w in plain_terms(rows, 3)]
    assert topics.cluster_terms(frame.where("id < 0"), "c", "id", "text", 3).count() == 0


def test_terms_move_by_block(spark):
    """A block of 50 texts alike sends each of its terms once; each text sent its own."""
    rows = spark.createDataFrame([(i % 2, i, "c", "the snow and the rain") for i in range(100)], "block long, k int, c string, text string")
    sent = topics._document_counts(rows, 1, ["and"])
    assert [(r["block"], r["terms"].split("\n"), set(np.frombuffer(r["df"], np.int64))) for r in sent.orderBy("block").collect()] == [(b, ["rain", "snow", "snow the", "the", "the rain", "the snow"], {50}) for b in (0, 1)]
    over = topics._over_blocks(sent).collect()
    assert [set(np.frombuffer(r["df"], np.int64)) for r in over] == [{100}, {100}]


@pytest.mark.parametrize("n, size, threshold", [(1, 3, 0.5), (2, 2, 0.9), (60, 2, 0.3), (300, 4, 2.0), (400, 8, 0.5)])
def test_merging_in_rounds_without_the_square(n, size, threshold):
    """Rounds over the clusters that are left give the labels of one merge at a time."""
    rng = np.random.default_rng(n)
    weight, mean = rng.integers(1, 4, n).astype(float), rng.normal(size=(n, size))
    sums = mean / np.linalg.norm(mean, axis=1)[:, None] * weight[:, None]
    assert topics.merge_rounds(sums, weight, threshold).tolist() == topics.agglomerate(sums, weight, threshold).tolist()
    alike = np.round(sums)  # ties end too
    assert len(topics.merge_rounds(alike, weight, threshold)) == n


def test_only_what_lost_its_nearest_looks_again(spark, monkeypatch):
    """Every round compared all clusters with all; now those whose nearest was merged, with those that are near to any."""
    rng = np.random.default_rng(3)
    rows = [(i, "g", [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, g string, v array<double>")
    nearest, seen = topics._nearest, []

    def counted(clusters, *rest):
        seen.append((clusters.count(), clusters.where("n is null").count()))
        return nearest(clusters, *rest)

    whole = sorted(map(tuple, topics.cluster_texts(frame, "g", "id", "v", threshold=0.3).collect()))
    monkeypatch.setattr(topics, "_nearest", counted)
    assert sorted(map(tuple, topics.cluster_texts(frame, "g", "id", "v", threshold=0.3, cell=4, block=30).collect())) == whole
    assert len(seen) > 1 and seen[0] == (60, 60) and all(asks < left for left, asks in seen[1:])


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_challenges_read_the_cube_once(spark):
    """What is told of the claims comes from written verdicts; it computed every panel from the cube again, for each test and each reader."""
    told = registry.QUERIES["challenged_claims"](spark, SF)
    assert told.count() == 4 and not any("sales-cube" in f for f in told.inputFiles())
