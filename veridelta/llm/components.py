"""Connected components of a large link table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialize

#: Links that a task joins before the first round.
LOT = 1 << 20


def star_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is joined to by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _joined(links: DataFrame) -> DataFrame:
    """Links that join the same nodes, each lot of a task's links made stars."""

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0

        def stars() -> pd.DataFrame:
            every = pd.concat(held)
            nodes, at = np.unique(every[["u", "v"]].to_numpy(), return_inverse=True)
            at = at.reshape(-1, 2)
            label = star_labels(len(nodes), at[:, 0], at[:, 1])
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return pd.DataFrame({"u": nodes[moved], "v": nodes[label[moved]]})

        for frame in frames:
            if len(frame):
                held.append(frame)
                rows += len(frame)
            if rows >= LOT:
                yield stars()
                held, rows = [], 0
        if held:
            yield stars()

    return links.mapInPandas(join, "u long, v long")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows. Links come as u > v, and leave so."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("n")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them. Links come as u > v, and leave so."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    handed = links.join(least.withColumnRenamed("u", "n"), F.col("u") == F.col("n")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    ``links`` has long columns u and v. Each round is written to the shared folder, so lineage stays short.
    Raises if ``max_rounds`` (the logarithm of any real graph, many times over) is not enough.
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        kept = materialize(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
        return kept, (seen.get["n"], seen.get["h"])

    links = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links, state = written(_joined(links).distinct())
    for _ in range(max_rounds):
        before = state
        if state[0]:
            links, state = written(_small_star(_large_star(links)))
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError("the components have not settled")
