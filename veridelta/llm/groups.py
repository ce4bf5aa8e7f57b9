"""Links inside groups of any size: no task gets a whole hot group, and no pair of a group is passed over."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

#: Rows of small groups that a comparison gets at once.
BATCH = 2048
#: (frame of whole groups, first rows of the groups and the end, whether only rows that ask are compared) -> places of linked rows.
Compare = Callable[[pd.DataFrame, np.ndarray, bool], tuple[np.ndarray, np.ndarray]]


def whole_groups(frames: Iterator[pd.DataFrame], by: list[str], batch: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups, of ``batch`` rows or more if there are so many, with the groups' first rows and the end."""
    held: list[pd.DataFrame] = []
    rows = 0

    def parts(frame: pd.DataFrame) -> np.ndarray:
        ids = frame[by].to_numpy()
        return np.r_[np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]), len(frame)]

    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        rows += len(frame)
        if rows >= batch:
            whole = pd.concat(held, ignore_index=True)
            starts = parts(whole)
            held = [whole.iloc[starts[-2] :]]
            rows = len(held[0])
            if len(starts) > 2:
                yield whole.iloc[: starts[-2]], starts[:-1]
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, parts(whole)


def _same(by: list[str]) -> Column:
    same = F.lit(True)
    for k in by:
        same &= F.col(k) == F.col(f"__{k}")
    return same


def group_links(rows: DataFrame, by: list[str], chunk: int, compare: Compare, weight: Column | None = None, most: int = 1, batch: int = BATCH) -> DataFrame:
    """Links (a, b) between nodes that give the same components as comparing all pairs of each group would.

    ``rows`` has the long columns ``by`` and node, each node once in a group, and what ``compare`` reads; it is read several times.
    A group of up to ``chunk`` rows (and ``most`` of ``weight``) is one task's work. A larger one is dealt at random
    into chunks, twice; the links found in them usually join nearly all of it. What is then left apart from the group's
    largest component is compared with the whole group, chunk by chunk, so the links are those of all pairs, while
    a hot group costs its size times a chunk and times the rows that stayed apart, not the square of its size.
    """
    count = F.ceil(F.count("*") / chunk)
    parts = count if weight is None else F.greatest(count, F.ceil(F.sum(weight) / F.lit(most)))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), parts.cast("int").alias("k")).where("n > 1")
    sizes = materialize(sizes.select(*[F.col(k).alias(f"__{k}") for k in by], "k"), "group-sizes")
    names = rows.columns
    shared = rows.join(sizes, _same(by)).select(*names, "k")

    def compared(work: DataFrame, cells: list[str], asks: bool) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame, starts in whole_groups(frames, [*by, *cells], batch):
                a, b = compare(frame, starts, asks)
                nodes = frame["node"].to_numpy()
                yield pd.DataFrame({"a": nodes[a], "b": nodes[b]})

        keys = [*by, *cells]
        return work.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long").where("a != b").distinct()

    def dealt(frame: DataFrame, seed: int) -> DataFrame:
        return frame.withColumn("c", F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("k")).cast("int")).drop("k")

    found = materialize(compared(dealt(shared, 1), ["c"], False), "group-links")
    if sizes.where("k > 1").isEmpty():
        return found
    hot = materialize(shared.where("k > 1"), "hot-groups")
    again = materialize(compared(dealt(hot, 2), ["c"], False), "group-links")
    named = components(found.unionByName(again).select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("__node"), "component")
    found = named.where("__node != component").select(F.col("__node").alias("a"), F.col("component").alias("b"))  # the same links as stars
    labelled = hot.join(named, F.col("node") == F.col("__node"), "left").select(*names, "k", F.coalesce("component", "node").alias("label"))
    labelled = materialize(labelled, "hot-groups")
    shares = labelled.groupBy(*by, "label").agg(F.count("*").alias("n"))
    largest = shares.groupBy(*by).agg(F.max(F.struct("n", F.col("label").alias("main"))).alias("top"), F.sum("n").alias("all"))
    apart = F.col("all") - F.col("top.n")
    largest = largest.where(apart > 0).select(*[F.col(k).alias(f"__{k}") for k in by], F.col("top.main").alias("main"), F.ceil(apart / chunk).cast("int").alias("m"))
    rest = labelled.join(largest, _same(by)).drop(*[f"__{k}" for k in by])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = rest.where("label != main").withColumn("m", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("m")).cast("int")).withColumn("c", every("k")).withColumn("asks", F.lit(True))
    asked = rest.withColumn("c", F.pmod(F.xxhash64(F.lit(4), "node"), F.col("k")).cast("int")).withColumn("m", every("m")).withColumn("asks", F.lit(False))
    last = compared(asking.unionByName(asked).drop("k", "main"), ["m", "c"], True)
    return found.unionByName(materialize(last, "group-links"))
