"""Localisation: where a movement comes from, by price and volume, by category and by rep."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta.functions.columns import ratio

REPLICATES, PERMUTATIONS, SEED = 500, 2000, 7
#: The bootstrap's generator: a 32-bit word, odd factors below 2^31, steps from one replicate and one copy to the next.
WORD, FIRST_FACTOR, SECOND_FACTOR, REPLICATE_STEP, COPY_STEP = 0xFFFFFFFF, 0x7FEB352D, 0x31848BAB, 0x85EBCA6B, 0x9E3779B9
#: A word below the k-th of these is a Poisson count of k or less.
POISSON_LIMITS = np.array([int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)], np.int64)
#: Rows whose draws are made at once.
DRAWN_AT_ONCE = 4096


def inside(period: str, window: tuple) -> Column:
    return F.col(period).between(*window)


def price_volume_bridge(sales: DataFrame, keys: list[str], pre: tuple, post: tuple) -> DataFrame:
    """(keys, revenue_pre, revenue_post, volume_effect, price_effect, mix_effect): volume at old prices, price on new volume.

    The two add up to the difference, so the mix term is zero up to rounding; it is kept as a check.
    """
    now, was = inside("week", post), inside("week", pre)
    zero = F.lit(0)
    sums = sales.where(now | was).groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(w, F.col(c))), zero).cast("double").alias(n) for w, c, n in ((was, "gross_revenue", "r0"), (now, "gross_revenue", "r1"), (was, "units", "q0"), (now, "units", "q1"))]
    )
    p0, p1 = ratio(F.col("r0"), F.col("q0")), ratio(F.col("r1"), F.col("q1"))
    volume, price = (F.col("q1") - F.col("q0")) * p0, F.col("q1") * (p1 - p0)
    return sums.select(*keys, F.col("r0").alias("revenue_pre"), F.col("r1").alias("revenue_post"), volume.alias("volume_effect"), price.alias("price_effect"), (F.col("r1") - F.col("r0") - volume - price).alias("mix_effect"))


def mix_shift(sales: DataFrame, keys: list[str], part: str, pre: tuple, post: tuple) -> DataFrame:
    """(keys, mix_shift): what the change of the parts' shares in the volume brings at their old prices; an extension."""
    now, was = inside("week", post), inside("week", pre)
    cells = sales.where(now | was).groupBy(*keys, part).agg(
        F.sum(F.when(was, F.col("units")).otherwise(0)).cast("double").alias("q0"), F.sum(F.when(now, F.col("units")).otherwise(0)).cast("double").alias("q1"),
        F.sum(F.when(was, F.col("gross_revenue")).otherwise(0)).cast("double").alias("r0"),
    )
    totals = cells.groupBy(*keys).agg(F.sum("q0").alias("t0"), F.sum("q1").alias("t1"))
    joined = cells.join(totals, keys)
    return joined.groupBy(*keys).agg(F.sum((ratio(F.col("q1"), F.col("t1")) - ratio(F.col("q0"), F.col("t0"))) * F.col("t1") * ratio(F.col("r0"), F.col("q0"))).alias("mix_shift"))


def category_deltas(sales: DataFrame, keys: list[str], player: str, pre: tuple, post: tuple) -> DataFrame:
    """(keys, player, delta): in an additive game a player's Shapley value is its own difference."""
    now, was = inside("week", post), inside("week", pre)
    delta = F.sum(F.when(now, F.col("gross_revenue")).otherwise(-F.col("gross_revenue")))
    return sales.where(now | was).groupBy(*keys, F.col(player).alias("player")).agg(delta.cast("double").alias("delta"))


def mixed(x: np.ndarray) -> np.ndarray:
    """32 bits stirred so that each bit of the result depends on every bit of ``x``; products stay below 2^63."""
    x = (x ^ (x >> 16)) * FIRST_FACTOR & WORD
    x = (x ^ (x >> 15)) * SECOND_FACTOR & WORD
    return x ^ (x >> 16)


def poisson_draws(identity: np.ndarray, replicates: int, seed: int = SEED) -> np.ndarray:
    """(replicates, rows) counts of a Poisson distribution of mean 1; a count depends on its row's identity, its replicate and the seed alone."""
    low, high = identity & WORD, (identity >> 32) & WORD
    row = mixed(mixed(low + seed & WORD) ^ high)
    number = np.arange(replicates, dtype=np.int64) * REPLICATE_STEP & WORD
    return np.searchsorted(POISSON_LIMITS, mixed(row[None, :] ^ number[:, None]), side="right")


def bootstrap_deltas(sales: DataFrame, player: str, pre: tuple, post: tuple, replicates: int = REPLICATES, seed: int = SEED, identity: Column | None = None) -> DataFrame:
    """(player, low, high): 5 % and 95 % bounds of category_deltas, resampling rows within each week.

    Each row has a Poisson(1) count in each replicate, from a generator that counts by the row's ``identity`` (a long; by default a hash of all
    its columns) and the replicate: the same bounds come out however rows are dealt to tasks, and after a lost executor. Equal rows
    are told apart by their number. A week's counts are scaled to its number of rows, as resampling keeps it. Tasks add up whole vectors
    of replicates in integers of a ten-thousandth, so a row is read once and never copied.
    """
    now, was = inside("week", post), inside("week", pre)
    known = F.xxhash64(*[F.col(c) for c in sales.columns]) if identity is None else identity
    amount = (F.col("gross_revenue").cast("decimal(18,4)") * 10000).cast("bigint")
    rows = sales.where(now | was).select("week", F.col(player).alias("player"), F.coalesce(amount, F.lit(0)).alias("value"), now.alias("now"), known.cast("bigint").alias("identity"))
    rows = rows.where("player is not null").groupBy("week", "player", "value", "now", "identity").agg(F.count("*").alias("copies"))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {}
        for frame in frames:
            for key, part in frame.groupby(["week", "player", "now"]):
                copies = part["copies"].to_numpy()
                place = np.repeat(np.arange(len(part)), copies)
                number = np.arange(len(place)) - np.repeat(np.cumsum(copies) - copies, copies)
                for some in np.array_split(np.arange(len(place)), len(place) // DRAWN_AT_ONCE + 1):
                    at, value = place[some], part["value"].to_numpy()[place[some]]
                    draw = poisson_draws(part["identity"].to_numpy()[at] + number[some] * COPY_STEP, replicates, seed)
                    n, v = found.get(key, (0, 0))
                    found[key] = (n + draw.sum(axis=1), v + draw @ value)
        out = [(w, p, bool(a), int(n[r]), int(v[r]), r) for (w, p, a), (n, v) in found.items() for r in range(replicates)]
        yield pd.DataFrame(out, columns=["week", "player", "now", "drawn", "value", "replicate"])

    partial = rows.mapInPandas(sums, "week int, player string, now boolean, drawn long, value long, replicate int")
    cells = partial.groupBy("week", "player", "now", "replicate").agg(F.sum("drawn").alias("drawn"), F.sum("value").alias("value"))
    size = rows.groupBy("week").agg(F.sum("copies").alias("rows"))
    drawn = cells.groupBy("week", "replicate").agg(F.sum("drawn").alias("all"))
    scaled = cells.join(drawn, ["week", "replicate"]).join(size, "week")
    value = F.col("value") / 10000 * ratio(F.col("rows"), F.col("all")) * F.when(F.col("now"), 1).otherwise(-1)
    per = scaled.groupBy("player", "replicate").agg(F.sum(value).alias("delta"))
    return per.groupBy("player").agg(F.percentile("delta", F.lit(0.05)).alias("low"), F.percentile("delta", F.lit(0.95)).alias("high"))


def shapley_exact(worth: DataFrame, players: list[str]) -> DataFrame:
    """(player, value) of a game over at most eight players: ``worth`` has (coalition bitmask, worth), absent ones worth 0.

    Every player's marginal contributions over all coalitions, weighted by their share of the orders.
    """
    from math import factorial

    n = len(players)
    if n > 8:
        raise ValueError("exact enumeration is for eight players at most; sample permutations above")
    spark = worth.sparkSession
    every = spark.range(1 << n).select(F.col("id").cast("int").alias("coalition"))
    full = every.join(worth, "coalition", "left").select("coalition", F.coalesce(F.col("worth").cast("double"), F.lit(0.0)).alias("worth"))
    who = spark.createDataFrame([(i, p) for i, p in enumerate(players)], "bit int, player string")
    bit = F.expr("shiftleft(1, bit)")
    without = full.join(who, F.col("coalition").bitwiseAND(bit) == 0).withColumn("with", F.col("coalition").bitwiseOR(bit))
    share = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - k - 1) / factorial(n)) for k in range(n)]), F.bit_count("coalition") + 1)
    other = full.select(F.col("coalition").alias("with"), F.col("worth").alias("more"))
    return without.join(other, "with").groupBy("player").agg(F.sum(share * (F.col("more") - F.col("worth"))).alias("value"))


def coverage_worth(members: DataFrame, players: list[str], member: str, player: str) -> DataFrame:
    """(coalition, worth): the number of members that any player of a coalition reaches.

    Members shrink to the players that reach them, and these to counts of at most 2^n masks, before coalitions meet them.
    """
    place = F.create_map(*[F.lit(x) for i, p in enumerate(players) for x in (p, 1 << i)])
    masks = members.groupBy(member).agg(F.bit_or(F.element_at(place, F.col(player))).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))
    every = members.sparkSession.range(1 << len(players)).select(F.col("id").cast("int").alias("coalition"))
    return every.join(masks, F.col("coalition").bitwiseAND(F.col("mask")) != 0).groupBy("coalition").agg(F.sum("n").alias("worth"))


def shapley_sampled(spark: SparkSession, players: list[str], worth, permutations: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """(player, value) by random orders: the mean of what a player adds to those before it.

    ``worth`` turns (permutation, position, player) rows, to which players join in that order, into the same with the
    coalition's worth after the player; it may be any DataFrame program.
    """
    who = spark.createDataFrame([(p,) for p in players], "player string")
    orders = spark.range(permutations).select(F.col("id").cast("int").alias("permutation")).join(who, F.lit(True))
    placed = orders.withColumn("position", F.row_number().over(Window.partitionBy("permutation").orderBy(F.xxhash64(F.lit(seed), "permutation", "player"), "player")))
    before = F.lag("worth", 1, 0.0).over(Window.partitionBy("permutation").orderBy("position"))
    return worth(placed).withColumn("added", F.col("worth") - before).groupBy("player").agg(F.avg("added").alias("value"))


def rep_shares(reps: DataFrame, pre_months: list[str], post_months: list[str], loss: DataFrame) -> DataFrame:
    """(region, rep_id, delta, share): mean over the later months less that over the earlier, as a share of the region's loss.

    ``loss`` has (region, loss); where it isn't negative the share is 0. A rep without a later month counts as 0 there.
    """
    both = reps.where(F.col("month").isin(pre_months + post_months))
    was, now = F.col("month").isin(pre_months), F.col("month").isin(post_months)
    value = F.col("rep_attributed_revenue").cast("double")
    delta = F.coalesce(F.avg(F.when(now, value)), F.lit(0.0)) - F.coalesce(F.avg(F.when(was, value)), F.lit(0.0))
    per = both.groupBy("region", "rep_id").agg(delta.alias("delta")).join(loss, "region")
    return per.select("region", "rep_id", "delta", F.when(F.col("loss") < 0, F.col("delta") / F.col("loss")).otherwise(0.0).alias("share"))


def ascending(contributions: DataFrame, value: str = "delta") -> DataFrame:
    """Contributions in order, the largest loss first."""
    return contributions.orderBy(value, *[c for c in contributions.columns if c != value])


def reindexed(rows: DataFrame, keys: list[str], period: str, wanted: list) -> DataFrame:
    """The rows of the wanted periods; a key without one of them has a row of nulls for it, so that what is missing shows.

    Periods that aren't wanted are left out; keys are those of all rows.
    """
    spine = rows.select(*keys).distinct().withColumn(period, F.explode(F.array(*[F.lit(p) for p in wanted])))
    return spine.join(rows, [*keys, period], "left").select(*rows.columns)


def region_loss(sales: DataFrame, pre_months: list[str], post_months: list[str]) -> DataFrame:
    """(region, loss): mean monthly revenue over the later months less that over the earlier."""
    monthly = sales.where(F.col("month").isin(pre_months + post_months)).groupBy("region", "month").agg(F.sum("gross_revenue").cast("double").alias("v"))
    return monthly.groupBy("region").agg((F.avg(F.when(F.col("month").isin(post_months), F.col("v"))) - F.avg(F.when(F.col("month").isin(pre_months), F.col("v")))).alias("loss"))
