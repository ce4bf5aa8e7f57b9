"""Approximate nearest neighbours by cosine with multiprobe p-stable hashing.

Unit vectors are hashed by floors of Gaussian projections. A query visits, in each table, its own bucket and those
perturbed by steps of one in some coordinates, in the order of their estimated success: the sum of squared distances
from the query's projections to the borders crossed. A table's buckets are dealt to parts; a query is sent once to each part with
the list of buckets that it visits there, and tasks score buckets as blocks. Each block gives its best per query, and the
tables' candidates are merged and ranked by exact cosines in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TABLES, HASHES, WIDTH, SEED = 6, 5, 1.6, 7
#: Queries in the calibration sample, and the recall of their nearest that the number of probes must reach.
SAMPLE, TARGET = 200, 0.96
#: Vectors of a bucket in one block; larger buckets are cut into blocks that are scored apart.
BLOCK = 2048
#: Parts that a table's buckets are dealt to.
PARTS = 16
#: Two scores that differ by no more may be in the wrong order by rounding, and are both kept.
ROUNDING = 1e-9


def perturbations() -> np.ndarray:
    """Every combination of steps -1, 0, 1 in the coordinates of a bucket."""
    return np.array(list(product((0, -1, 1), repeat=HASHES)), np.int64)


def projections(vectors: np.ndarray) -> np.ndarray:
    """(rows, tables, hashes) projections in units of the bucket width; the same for equal dimensions everywhere."""
    dim = vectors.shape[1]
    rng = np.random.default_rng([SEED, dim])
    a = rng.normal(size=(dim, TABLES * HASHES))
    shift = rng.uniform(size=TABLES * HASHES)
    return (vectors @ a / WIDTH + shift).reshape(len(vectors), TABLES, HASHES)


def bucket_code(cells: np.ndarray) -> np.ndarray:
    """One long for the cells of a bucket."""
    return ((cells + 512) * (1024 ** np.arange(HASHES))).sum(axis=-1)


def probe_order(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For projections (..., hashes): the codes of all perturbed buckets, most promising first, and their scores."""
    cell = np.floor(at)
    low = at - cell
    steps = perturbations()
    cost = np.where(steps == 0, 0, np.where(steps < 0, low[..., None, :], 1 - low[..., None, :])) ** 2
    cost = cost.sum(axis=-1)
    order = np.argsort(cost, axis=-1, kind="stable")
    codes = bucket_code(cell.astype(np.int64)[..., None, :] + steps)
    return np.take_along_axis(codes, order, -1), np.take_along_axis(cost, order, -1)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def stack(column: pd.Series) -> np.ndarray:
    """A matrix of vectors of equal dimension."""
    return np.stack([np.asarray(x, np.float64) for x in column])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length 1, without overflow."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def by_dimension(frame: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """Parts of a frame whose vectors have the same dimension: others are never compared."""
    for _, part in frame.groupby(frame[column].map(len), sort=False):
        yield part


def best(scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``keep`` largest scores, and of all that come within ROUNDING of the last of them."""
    if scores.shape[1] <= keep:
        return np.nonzero(scores > -np.inf)
    last = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1 : keep]
    return np.nonzero((scores >= last - ROUNDING) & (scores > -np.inf))


def calibrate(distinct: DataFrame, k: int) -> int:
    """Probes in each table that find TARGET of the k nearest of a sample of vectors.

    The sample is the SAMPLE vectors with the smallest hashes. Their true neighbours come from one pass over all
    vectors, which keeps a few per task and query; then the place of each neighbour's bucket in its query's probing
    order says how many probes would have found it. More than there are perturbed buckets means that hashing can't reach the
    target on these vectors.
    """
    sample = distinct.orderBy(F.xxhash64("group"), "group").limit(SAMPLE).select("group", "v").collect()  # SAMPLE rows
    if not sample:
        return 1
    asked = pd.DataFrame({"q": [r["group"] for r in sample], "qv": [r["v"] for r in sample]})
    sent = distinct.sparkSession.sparkContext.broadcast(asked)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(p["q"].to_numpy(), v := unit(stack(p["qv"])), probe_order(projections(v))[0]) for p in by_dimension(sent.value, "qv")]
        for frame in frames:
            for part in by_dimension(frame, "v") if len(frame) else ():
                vectors, groups = unit(stack(part["v"])), part["group"].to_numpy()
                there = bucket_code(np.floor(projections(vectors)).astype(np.int64))
                for names, queries, codes in parts:
                    if queries.shape[1] != vectors.shape[1]:
                        continue
                    scores = queries @ vectors.T
                    scores[names[:, None] == groups[None, :]] = -np.inf
                    row, col = best(scores, k)
                    place = (codes[row] == there[col][:, :, None]).argmax(axis=-1) + np.where((codes[row] == there[col][:, :, None]).any(axis=-1), 0, codes.shape[-1])
                    yield pd.DataFrame({"q": names[row], "score": scores[row, col], "place": place.min(axis=1)})

    found = distinct.select("group", "v").mapInPandas(scan, "q long, score double, place long")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "place"))).where(f"r <= {k}")
    places = np.array([r["place"] for r in ranked.select("place").collect()])  # k * SAMPLE rows
    if not len(places):
        return 1
    return int(np.quantile(places, TARGET, method="higher")) + 1


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by cosine among all other rows, ties to smaller ids.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part; nor do null ids. Vectors
    of different dimensions are never neighbours. With fewer candidates than k, all come out: a query whose buckets hold
    too few is held against all vectors, block by block.
    Equal vectors are hashed and scored once, with their k + 1 smallest ids, so that a common vector doesn't fill
    a bucket. A row is no neighbour of itself, nor of another row with its id. ``probes`` in each table come from
    ``calibrate`` if not given.
    """
    asks = F.coalesce(is_query, F.lit(False))
    rows = vectors.where(usable(F.col(embedding)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), asks.alias("asks"))
    rows = rows.withColumn("key", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))
    first = Window.partitionBy("key").orderBy("id")
    few = rows.dropDuplicates(["key", "id"]).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)  # limited before the shuffle, too
    groups = few.groupBy("key").agg(F.min("id").alias("group"), F.max_by("v", -F.col("r")).alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    groups = materialize(groups, "distinct-vectors")
    asking = rows.where("asks").select("key", F.col("id").alias("query_id")).distinct()
    queries = groups.join(asking.select("key").distinct(), "key", "left_semi").select(F.col("group").alias("q"), F.col("v").alias("qv"))
    probes = probes or calibrate(groups, k)
    if probes > 3**HASHES:  # probing can't reach the target here: every vector is in reach of every query, and recall is 1
        index, visits = everywhere(groups, "group", "v", PARTS), everywhere(queries, "q", "qv", 1)
    else:
        index, visits = place_index(groups), place_queries(queries, probes)
    near = materialize(score_buckets(index, visits, k + 1), "candidates")
    found = near.groupBy("q").agg(F.countDistinct("group").alias("n"))
    few = queries.join(found, "q", "left").where(F.coalesce("n", F.lit(0)) <= k).select("q", "qv")  # itself is one of those found
    few = materialize(few, "short-of-candidates")
    if not few.isEmpty():  # fewer than asked for were in reach: those queries are held against all vectors
        near = near.unionByName(score_buckets(everywhere(groups, "group", "v", PARTS), everywhere(few, "q", "qv", 1), k + 1))
    pairs = near.groupBy("q", "group").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "group"))
    last = pairs.withColumn("r", place).where(F.col("r") <= k + 1).groupBy("q").agg(F.min("score").alias("least"))
    top = pairs.join(last, "q").where(F.col("score") >= F.col("least") - ROUNDING).select("q", "group")
    exact = top.join(queries, "q").join(groups.select("group", "v", "ids"), "group").select("q", "ids", cosine(F.col("qv"), F.col("v")).alias("score"))
    each = exact.select("q", F.explode("ids").alias("id"), "score")
    listed = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    answers = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("found")).join(groups.select(F.col("group").alias("q"), "key"), "q").select("key", "found")
    own = asking.join(answers, "key")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, components added in their order."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = [F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))) for v in (a, b)]
    return dot / (norm[0] * norm[1])


def _schema(frame: DataFrame, name: str, vector: str) -> str:
    return f"t long, part long, codes array<long>, {name} long, {vector} {dict(frame.dtypes)[vector]}"


def place_index(groups: DataFrame) -> DataFrame:
    """(t, part, codes, group, v): every distinct vector in its bucket of each table; t also tells the dimension, codes has that bucket alone."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for some in by_dimension(frame, "v") if len(frame) else ():
                codes = bucket_code(np.floor(projections(unit(stack(some["v"])))).astype(np.int64))
                base = TABLES * len(some["v"].iloc[0])
                for t in range(TABLES):
                    yield pd.DataFrame({"t": base + t, "part": part_of(codes[:, t]), "codes": list(codes[:, t : t + 1]), "group": some["group"], "v": some["v"]})

    return groups.select("group", "v").mapInPandas(place, _schema(groups, "group", "v"))


def part_of(codes: np.ndarray) -> np.ndarray:
    """The part that a bucket is dealt to."""
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PARTS


def place_queries(queries: DataFrame, probes: int) -> DataFrame:
    """(t, part, codes, q, qv): the parts that hold buckets that a query visits in each table, with the most promising ``probes`` buckets."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in by_dimension(frame, "qv") if len(frame) else ():
                for i in range(0, len(part), 256):
                    some = part.iloc[i : i + 256].reset_index(drop=True)
                    codes = np.sort(probe_order(projections(unit(stack(some["qv"]))))[0][:, :, :probes], axis=-1)
                    base, there = TABLES * len(some["qv"].iloc[0]), part_of(codes)
                    for t in range(TABLES):
                        for p in range(PARTS):
                            visited = there[:, t] == p
                            mine = np.flatnonzero(visited.any(axis=1))
                            if len(mine):
                                yield pd.DataFrame({"t": base + t, "part": p, "codes": [codes[r, t][visited[r]] for r in mine], "q": some["q"].to_numpy()[mine], "qv": some["qv"].to_numpy()[mine]})

    return queries.mapInPandas(place, _schema(queries, "q", "qv"))


def everywhere(rows: DataFrame, name: str, vector: str, parts: int) -> DataFrame:
    """Rows of one bucket for each dimension, which all queries visit; vectors are dealt to several parts, queries go to all."""
    part = F.pmod(F.xxhash64(name), F.lit(PARTS)) if parts > 1 else F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))
    return rows.select((-F.size(vector) - 1).cast("long").alias("t"), part.alias("part"), F.array(F.lit(0).cast("long")).alias("codes"), name, vector)


def score_buckets(index: DataFrame, visits: DataFrame, keep: int) -> DataFrame:
    """(q, group, score): for each query and block of a part, the best ``keep`` of the vectors in buckets that it visits, and those all but equal to the last.

    A part of more than BLOCK vectors, or visits, is cut into blocks of each; every pair of blocks is a task's group.
    """
    vectors = index.groupBy("t", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nv"))
    asked = visits.groupBy("t", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nq"))
    sizes = materialize(vectors.join(asked, ["t", "part"]), "part-sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, ["t", "part"]).select("t", "part", F.get("codes", F.lit(0)).alias("code"), "group", "v", F.pmod(F.xxhash64("group"), F.col("nv")).cast("int").alias("bv"), every("nq").alias("bq"))
    right = visits.join(sizes, ["t", "part"]).select("t", "part", "codes", "q", "qv", F.pmod(F.xxhash64("q"), F.col("nq")).cast("int").alias("bq"), every("nv").alias("bv"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"q": [], "group": [], "score": []}).astype({"q": "int64", "group": "int64"})
        if not len(a) or not len(b):
            return nothing
        a = a.sort_values("code", kind="stable")
        code, group, vectors = a["code"].to_numpy(), a["group"].to_numpy(), unit(stack(a["v"]))
        queries, names = unit(stack(b["qv"])), b["q"].to_numpy()
        visit, who = np.concatenate(b["codes"].to_numpy()), np.repeat(np.arange(len(b)), b["codes"].map(len).to_numpy())
        order = np.argsort(visit, kind="stable")
        visit, who = visit[order], who[order]
        found = []
        for c in np.unique(code):
            asking = who[np.searchsorted(visit, c) : np.searchsorted(visit, c, side="right")]
            s, e = np.searchsorted(code, c), np.searchsorted(code, c, side="right")
            if len(asking):
                scores = queries[asking] @ vectors[s:e].T
                row, col = best(scores, keep)
                found.append((asking[row], s + col, scores[row, col]))
        if not found:
            return nothing
        who, at, value = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-value, who))  # the best of each query over its buckets in the block
        who, at, value = who[order], at[order], value[order]
        first = np.searchsorted(who, who)
        place = np.arange(len(who)) - first
        last = value[np.minimum(first + keep - 1, np.searchsorted(who, who, side="right") - 1)]
        kept = (place < keep) | (value >= last - ROUNDING)
        return pd.DataFrame({"q": names[who[kept]], "group": group[at[kept]], "score": value[kept]})

    by = ["t", "part", "bv", "bq"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(score, "q long, group long, score double")
