"""Localisation over the whole lattice of dimensions: one pass of grouping sets answers every drill-down.

Sums are additive, so a cell's movement is that of its parts added up, and all cells come from one CUBE. ``grouping_id`` tells a dimension that is
summed over from one whose value is null. A cell is named by ``cell``, the bits of the dimensions that it fixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .localise import inside


def cells(sales: DataFrame, dims: list[str], pre: tuple, post: tuple, measure: str = "gross_revenue") -> DataFrame:
    """(dims, cell, level, before, after, delta) of every cell of the cube over ``dims``.

    ``cell`` has bit i set if dims[i] is fixed; ``level`` is how many are. A dimension that isn't fixed is null, as may be one that is: ``cell`` decides.
    Rows of neither window take no part. Without rows there are no cells.
    """
    now, was = inside("week", post), inside("week", pre)
    amount = F.col(measure).cast("decimal(18,4)")
    sums = [F.sum(F.when(w, amount).otherwise(F.lit(0))).alias(n) for w, n in ((was, "before"), (now, "after"))]
    # finest cells first: what is rolled up is as small as the data's own combinations
    finest = sales.where(now | was).groupBy(*dims).agg(*sums)
    rolled = finest.cube(*dims).agg(F.grouping_id().alias("gid"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    fixed = _fixed(F.col("gid"), len(dims))
    found = rolled.select(*dims, fixed.alias("cell"), F.bit_count(fixed).cast("int").alias("level"), "before", "after", (F.col("after") - F.col("before")).alias("delta"))
    return found.where(F.col("cell").isNotNull() & F.col("before").isNotNull())


def _fixed(gid: Column, n: int) -> Column:
    """Bits of the fixed dimensions; a grouping id has a bit for each that is summed over, the first dimension highest."""
    out = F.lit(0)
    for i in range(n):
        out = out + F.when(gid.bitwiseAND(F.lit(1 << (n - 1 - i))) == 0, 1 << i).otherwise(0)
    return out.cast("int")


def parents(found: DataFrame, dims: list[str]) -> DataFrame:
    """Each cell once for each cell one level above it: (p_dims, p_cell) name that one."""
    bit = F.explode(F.array(*[F.lit(i) for i in range(len(dims))]))
    each = found.withColumn("loose", bit).where(F.expr("(cell & shiftleft(1, loose)) > 0"))
    up = [F.when(F.col("loose") != i, F.col(d)).alias(f"p_{d}") for i, d in enumerate(dims)]
    return each.select("*", *up, F.expr("cell - shiftleft(1, loose)").alias("p_cell"))


def root_causes(found: DataFrame, dims: list[str], share: float = 0.5, inner: float = 0.8) -> DataFrame:
    """(dims, cell, level, delta, explained, deepest_share): cells that explain the movement and can't be narrowed down.

    A cell explains the share of the total's movement that its own is, if it goes the same way. It is a root cause if that is ``share`` or
    more and no cell one level below has ``inner`` or more of its movement. The total itself is one where nothing below explains it. A
    total that doesn't move has none.
    """
    total = found.where("level = 0").select(F.col("delta").cast("double").alias("total"))
    one = found.join(total, F.lit(True)).where("total != 0").withColumn("explained", F.col("delta").cast("double") / F.col("total"))
    up = parents(one.where("explained > 0"), dims)
    most = up.groupBy(*[f"p_{d}" for d in dims], "p_cell").agg(F.max("explained").alias("most"))
    same = F.col("cell") == F.col("p_cell")
    for d in dims:
        same &= F.col(d).eqNullSafe(F.col(f"p_{d}"))
    judged = one.where(F.col("explained") >= share).join(most, same, "left").withColumn("deepest_share", F.coalesce(F.col("most") / F.col("explained"), F.lit(0.0)))
    return judged.where(F.col("deepest_share") < inner).select(*dims, "cell", "level", "delta", "explained", "deepest_share")
