"""Mergeable sketches: distinct counts and quantiles written once per week, and merged for any period without the facts.

A row holds a HyperLogLog sketch of a key and a KLL sketch of an amount, both of Spark's own library. Their bytes are a few kilobytes whatever went
in, so a period's answer reads as many small rows as it has weeks. Counts and sums stand beside them and add up exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers are 2^LG_K: a distinct count's relative standard error is 1.04 / sqrt(2^LG_K), 1.6 %.
LG_K = 12
#: A quantile's rank is off by 1.33 % at most with 99 % confidence for this size.
KLL_K = 200


def distinct_error(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """Relative error that a distinct count keeps within so many standard deviations."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def rank_error(k: int = KLL_K) -> float:
    """Error of a quantile's rank at 99 % confidence, by the published fit for double-sided bounds."""
    return 2.446 / k**0.9433


def sketched(rows: DataFrame, by: list[str], key: str, amount: str, lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """(by, n, total, keys, amounts): counts, exact sums and the two sketches of each group.

    Null keys aren't counted, null amounts are in no quantile; a group of nulls alone has empty sketches. Sketches are summed in each task
    before they are shuffled, so a hot group is as cheap as any.
    """
    number = F.col(amount).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(amount).alias("total"), F.hll_sketch_agg(F.col(key), lg_k).alias("keys"), F.kll_sketch_agg_double(number, F.lit(k)).alias("amounts"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The same columns for coarser groups, from sketches alone."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("amounts").alias("amounts"))


def distinct_of(keys: Column) -> Column:
    return F.hll_sketch_estimate(keys)


def quantile_of(amounts: Column, rank: float) -> Column:
    """Null for a sketch that nothing went into."""
    return F.when(F.kll_sketch_get_n_double(amounts) > 0, F.kll_sketch_get_quantile_double(amounts, F.lit(rank)))
