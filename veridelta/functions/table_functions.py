"""Operators that SQL can call: table functions over ``TABLE(...) PARTITION BY``.

A function sees one partition after another, each in the order that the call states. Its output has the partition's other columns as they
came, named by ``analyze`` from the table that the call passes, and the result beside them. Call ``register`` once in a session, then for example

    select * from changepoints(TABLE(select kpi, region, period, value from series) PARTITION BY (kpi, region) ORDER BY period)
    select * from price_volume(TABLE(select region, week, units, gross_revenue from sales) PARTITION BY (region), 100, 102, 104, 106)
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _with_keys(table: AnalyzeArgument, taken: tuple[str, ...], made: list[tuple[str, T.DataType]]) -> AnalyzeResult:
    """The schema of the input's other columns, and of what is made. The input must have the columns that are taken."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(...) PARTITION BY ...")
    names = table.dataType.names
    if missing := [c for c in taken if c not in names]:
        raise ValueError(f"the table lacks {', '.join(missing)}; it has {', '.join(names)}")
    schema = T.StructType([f for f in table.dataType.fields if f.name not in taken])
    for name, kind in made:
        if name in schema.names:
            raise ValueError(f"a column of the table is named as a result: {name}")
        schema = schema.add(name, kind)
    return AnalyzeResult(schema=schema)


class Changepoints:
    """(other columns, n_observations, tau, confidence, impact_pct, impact_abs) of each partition's series; none for a series without values.

    Rows come in the order of the call. Null values are left out. A partition's values are kept until it ends, as the posterior asks for them.
    """

    TAKEN = ("period", "value")
    MADE = [("n_observations", T.IntegerType()), ("tau", T.IntegerType()), ("confidence", T.DoubleType()), ("impact_pct", T.DoubleType()), ("impact_abs", T.DoubleType())]

    def __init__(self) -> None:
        self.keys: tuple | None = None
        self.values: list[float] = []
        self.hazard = 15.0

    @staticmethod
    def analyze(table: AnalyzeArgument, hazard: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _with_keys(table, Changepoints.TAKEN, Changepoints.MADE)

    def eval(self, row, hazard: float = 15.0) -> Iterator[tuple]:
        self.hazard = float(hazard)
        if self.keys is None:
            self.keys = tuple(row[c] for c in row.__fields__ if c not in Changepoints.TAKEN)
        if row["value"] is not None:
            self.values.append(float(row["value"]))
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        from veridelta.operators import signal

        if self.values:
            values = np.array(self.values)
            tau, confidence = signal.changepoint(signal.run_lengths(values, signal.prior_of(values), self.hazard)[0])
            yield (*self.keys, len(values), tau, confidence, *signal.impact(values, tau))


class PriceVolume:
    """(other columns, revenue_pre, revenue_post, volume_effect, price_effect, mix_effect) of each partition; four sums are all that it keeps.

    The windows are weeks, ends included. A partition without a row in either window gives none. Null units and revenue count as 0.
    """

    TAKEN = ("week", "units", "gross_revenue")
    MADE = [(c, T.DoubleType()) for c in ("revenue_pre", "revenue_post", "volume_effect", "price_effect", "mix_effect")]

    def __init__(self) -> None:
        self.keys: tuple | None = None
        self.sums = [Decimal(0)] * 4

    @staticmethod
    def analyze(table: AnalyzeArgument, pre_from: AnalyzeArgument, pre_to: AnalyzeArgument, post_from: AnalyzeArgument, post_to: AnalyzeArgument) -> AnalyzeResult:
        return _with_keys(table, PriceVolume.TAKEN, PriceVolume.MADE)

    def eval(self, row, pre_from: int, pre_to: int, post_from: int, post_to: int) -> Iterator[tuple]:
        week = row["week"]
        if week is not None and (pre_from <= week <= pre_to or post_from <= week <= post_to):
            if self.keys is None:
                self.keys = tuple(row[c] for c in row.__fields__ if c not in PriceVolume.TAKEN)
            later = post_from <= week <= post_to
            for at, amount in ((0, row["gross_revenue"]), (2, row["units"])):
                self.sums[at + later] += Decimal(str(amount or 0))
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        if self.keys is not None:
            r0, r1, q0, q1 = map(float, self.sums)
            p0, p1 = (r / q if q else 0.0 for r, q in ((r0, q0), (r1, q1)))
            volume, price = (q1 - q0) * p0, q1 * (p1 - p0)
            yield (*self.keys, r0, r1, volume, price, r1 - r0 - volume - price)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL as ``changepoints`` and ``price_volume``."""
    from pyspark.sql.functions import udtf

    for name, handler in (("changepoints", Changepoints), ("price_volume", PriceVolume)):
        spark.udtf.register(name, udtf(handler))
