"""Joins that an equality alone can't say: by interval, by latest earlier state, and of both sides with what each lacks.

Each becomes equi-joins on keys and time buckets, so that Spark deals the rows, splits skewed keys and never compares all with all.
Times are long columns (days, seconds, microseconds); names of the two sides' columns may not meet, except the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.sources.tables import materialize

#: Window lengths of a level differ by this many powers of two at most.
STEP = 2
#: Rows of keys that share a hash's remainder, up to which an as-of join sorts a key in one task; more go by buckets of time.
KEY_ROWS, REMAINDERS = 1 << 20, 1 << 16
#: Buckets of the whole time range that an as-of join carries states through, where no width is given.
BUCKETS = 1024


def fresh(*frames: DataFrame) -> str:
    """A prefix that no column of the frames begins with."""
    names, prefix = [c for df in frames for c in df.columns], "_"
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    return prefix


def interval_join(points: DataFrame, windows: DataFrame, at: str, start: str, end: str, on: list[str] | None = None) -> DataFrame:
    """Each point with each window that holds it (start <= at <= end) and has the same keys; every such pair once.

    A window goes to the level whose buckets are as long as it is or up to four times longer, and so touches two of them at most, however long it
    is. A point goes to its one bucket on each level that windows have. They meet by an equi-join on keys, level and bucket, and the
    bounds are then compared exactly. A window is at least an eighth of what is searched for it, so the pairs that meet grow as the result.

    Nulls: a point without a time or key, and a window without a bound or key, match nothing, as does a window that ends before it
    begins. Repeated rows match each for itself. Rows keep all columns of both sides, keys once.
    """
    on = on or []
    p = fresh(points, windows)
    length = F.try_subtract(F.col(end), F.col(start))  # null beyond 2^63
    whole = windows.where(F.col(start) <= F.col(end))
    bits = F.when(length.isNull(), 64).when(length < 1, 0).otherwise(F.length(F.bin(length)))
    levelled = whole.withColumn(f"{p}level", (F.ceil(bits / STEP) * STEP).cast("int"))
    levels = [r[0] for r in levelled.select(f"{p}level").distinct().collect()]  # at most 33: powers of four up to 2^64
    bucket = lambda t: F.expr(f"shiftright(cast(`{t}` as bigint), least(63, `{p}level`))")
    spread = levelled.withColumn(f"{p}bucket", F.explode(F.array_distinct(F.array(bucket(start), bucket(end)))))
    placed = points.where(F.col(at).isNotNull()).withColumn(f"{p}level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]).cast("array<int>"))).withColumn(f"{p}bucket", bucket(at))
    met = placed.join(spread, [*on, f"{p}level", f"{p}bucket"])
    return met.where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop(f"{p}level", f"{p}bucket")


def interval_totals(points: DataFrame, windows: DataFrame, at: str, start: str, end: str, window: str, by: str, amount: str) -> DataFrame:
    """(by, hits, windows, total): of the pairs of ``interval_join``, by a column of the points, how many there are, of how many windows, and the sum of the points' amounts.

    No pair is made, as these grow with the square of a crowd. Beginnings and ends of windows and the points' moments stand on one line of time: a
    running sum, inside buckets and over them, tells how many windows hold a moment. A window has points of a group if the group's next moment from its
    beginning on is no later than its end: an as-of join backwards, of the windows times the groups, which are the result's rows.

    Nulls and repeated rows count as in ``interval_join``; groups without a pair are no row. ``total`` is an exact decimal for decimals.
    """
    p = fresh(points, windows)
    t, kind, d, b = f"{p}t", f"{p}kind", f"{p}d", f"{p}bucket"
    whole = windows.where(F.col(start) <= F.col(end)).select(F.col(window).alias(f"{p}window"), F.col(start).cast("bigint").alias(f"{p}from"), F.col(end).cast("bigint").alias(f"{p}to"))
    # a struct of the group, as a null is a group too
    moments = points.where(F.col(at).isNotNull()).groupBy(F.struct(F.col(by).alias("of")).alias(f"{p}g"), F.col(at).cast("bigint").alias(t)).agg(F.count("*").alias(f"{p}n"), F.sum(amount).alias(f"{p}sum"))
    moments = materialize(moments, "moments")
    # at one moment windows begin before points come, and end after them
    begun = whole.groupBy(F.col(f"{p}from").alias(t)).agg(F.count("*").alias(d)).withColumn(kind, F.lit(0))
    over = whole.groupBy(F.col(f"{p}to").alias(t)).agg((-F.count("*")).alias(d)).withColumn(kind, F.lit(2))
    line = moments.withColumn(kind, F.lit(1)).withColumn(d, F.lit(0).cast("bigint")).unionByName(begun.unionByName(over), allowMissingColumns=True)
    low, high = moments.agg(F.min(t), F.max(t)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // BUCKETS))
    # what is before the first point is one sum, and what is after the last isn't asked
    line = line.where(F.col(t) <= F.lit(high)).withColumn(b, F.when(F.col(t) < F.lit(low), F.lit(None)).otherwise(F.floor(F.col(t) / F.lit(width))).cast("bigint"))
    sums = line.groupBy(b).agg(F.sum(d).alias(d))
    base = sums.select(F.col(b).alias(f"{p}of"), (F.sum(d).over(Window.orderBy(F.asc_nulls_first(b))) - F.col(d)).alias(f"{p}base"))  # a row for each bucket
    held = F.sum(d).over(Window.partitionBy(b).orderBy(t, kind).rowsBetween(Window.unboundedPreceding, 0))
    covered = line.where(F.col(b).isNotNull()).withColumn(d, held).where(F.col(kind) == 1).join(base, F.col(b) == F.col(f"{p}of")).withColumn(d, F.col(d) + F.col(f"{p}base")).where(F.col(d) > 0)
    total = F.sum(F.col(f"{p}sum") * F.col(d).cast("decimal(19,0)" if points.schema[amount].dataType.typeName() == "decimal" else "bigint"))
    counted = covered.groupBy(f"{p}g").agg(F.sum(F.col(f"{p}n") * F.col(d)).alias("hits"), total.alias("total"))
    groups = moments.select(f"{p}g").distinct()
    asking = whole.join(F.broadcast(groups), how="cross").withColumn(f"{p}from", F.bitwise_not(f"{p}from"))  # time backwards
    next_ = asof_join(asking, moments.select(f"{p}g", F.bitwise_not(t).alias(t)), f"{p}from", t, [f"{p}g"])
    seen = next_.where(F.bitwise_not(t) <= F.col(f"{p}to")).groupBy(f"{p}g").agg(F.countDistinct(f"{p}window").alias("windows"))
    return counted.join(seen, f"{p}g").select(F.col(f"{p}g.of").alias(by), "hits", "windows", "total")


def asof_join(facts: DataFrame, states: DataFrame, at: str, valid_from: str, on: list[str], tolerance: int | None = None, width: int | None = None) -> DataFrame:
    """Every fact with the latest state of its keys at or before its time; state columns are null where there is none.

    States of equal keys and time count as one, the largest by its columns in order. ``tolerance`` is the largest age of a state that still counts.

    Facts and states of a key are put together in the order of time, and a window carries the last state on: one shuffle. Keys whose
    remainder of a hash has more than ``KEY_ROWS`` rows, and all if a ``width`` is given, go by buckets of time, so that no task gets a hot key.

    Nulls: a fact without a key or time has no state; a state without them is never one. Facts keep all rows and columns.
    """
    p = fresh(facts, states)
    body = [c for c in states.columns if c not in on]
    whole = lambda df, time: df.where(" and ".join(f"`{c}` is not null" for c in [*on, time]))
    known = whole(states, valid_from)
    begun = known.groupBy(*on, F.col(valid_from).cast("bigint").alias(f"{p}t")).agg(F.max(F.struct(*body)).alias(f"{p}state"))
    begun = materialize(begun, "asof-states")
    asked = whole(facts, at).withColumn(f"{p}t", F.col(at).cast("bigint"))
    lot = F.pmod(F.xxhash64(*on), F.lit(REMAINDERS)).cast("int")
    if width is None:
        sizes = asked.select(lot.alias(f"{p}lot")).unionByName(begun.select(lot.alias(f"{p}lot"))).groupBy(f"{p}lot").count()
        crowded = [r[0] for r in sizes.where(F.col("count") > KEY_ROWS).select(f"{p}lot").collect()]  # at most the rows by KEY_ROWS
        hot = lot.isin(crowded) if crowded else F.lit(False)
    else:
        crowded, hot = [0], F.lit(True)
    line = asked.where(~hot).withColumn(f"{p}asks", F.lit(1)).unionByName(begun.where(~hot).withColumn(f"{p}asks", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*on).orderBy(f"{p}t", f"{p}asks").rowsBetween(Window.unboundedPreceding, 0)
    taken = line.withColumn(f"{p}found", F.last(f"{p}state", ignorenulls=True).over(order)).where(F.col(f"{p}asks") == 1).select(*facts.columns, f"{p}t", f"{p}found")
    if crowded:
        taken = taken.unionByName(_by_buckets(asked.where(hot), begun.where(hot), on, p, width))
    if tolerance is not None:
        age = F.col(f"{p}t") - F.col(f"{p}found.{valid_from}").cast("bigint")
        taken = taken.withColumn(f"{p}found", F.when(age <= tolerance, F.col(f"{p}found")))
    found = taken.select(*[F.col(c) for c in facts.columns], *[F.col(f"{p}found.{c}").alias(c) for c in body])
    lost = facts.where(" or ".join(f"`{c}` is null" for c in [*on, at]))
    return found.unionByName(lost.select("*", *[F.lit(None).cast(states.schema[c].dataType).alias(c) for c in body]))


def _by_buckets(facts: DataFrame, begun: DataFrame, on: list[str], p: str, width: int | None) -> DataFrame:
    """Facts with the state found for them, for keys of any size.

    The times at which facts ask and states begin are put together, one row for each key and time. Inside buckets of ``width`` a
    window carries the last state on; what each bucket ends with is carried over the borders in a second pass that sees one row for each
    bucket. So a key with most rows is many tasks' work. Facts then take their moment's state by an equi-join, which Spark splits where a moment is hot.
    """
    asked = facts.select(*on, f"{p}t").distinct()
    if width is None:
        low, high = begun.unionByName(asked, allowMissingColumns=True).agg(F.min(f"{p}t"), F.max(f"{p}t")).first()
        width = max(1, -(-((high or 0) - (low or 0) + 1) // BUCKETS))
    both = asked.withColumn(f"{p}state", F.lit(None).cast(begun.schema[f"{p}state"].dataType)).unionByName(begun)
    one = both.groupBy(*on, f"{p}t").agg(F.max(f"{p}state").alias(f"{p}state")).withColumn(f"{p}bucket", F.floor(F.col(f"{p}t") / F.lit(width)))
    one = materialize(one, "asof-moments")
    inside = Window.partitionBy(*on, f"{p}bucket").orderBy(f"{p}t").rowsBetween(Window.unboundedPreceding, 0)
    carried = one.withColumn(f"{p}here", F.last(f"{p}state", ignorenulls=True).over(inside))
    last = one.where(F.col(f"{p}state").isNotNull()).groupBy(*on, f"{p}bucket").agg(F.max_by(f"{p}state", f"{p}t").alias(f"{p}last"))
    # a border's state holds for every bucket until the next that has one
    spans = last.withColumn(f"{p}next", F.lead(f"{p}bucket").over(Window.partitionBy(*on).orderBy(f"{p}bucket")))
    wanted = carried.where(F.col(f"{p}here").isNull()).select(*on, f"{p}bucket").distinct()
    ends = Window.partitionBy(*on).orderBy(f"{p}bucket", f"{p}asks").rowsBetween(Window.unboundedPreceding, 0)
    borders = spans.select(*on, (F.col(f"{p}bucket") + 1).alias(f"{p}bucket"), f"{p}last", F.lit(0).alias(f"{p}asks"))
    borders = borders.unionByName(wanted.select(*on, f"{p}bucket", F.lit(None).cast(begun.schema[f"{p}state"].dataType).alias(f"{p}last"), F.lit(1).alias(f"{p}asks")))
    before = borders.withColumn(f"{p}before", F.last(f"{p}last", ignorenulls=True).over(ends)).where(F.col(f"{p}asks") == 1).select(*on, f"{p}bucket", f"{p}before")
    found = carried.join(before, [*on, f"{p}bucket"], "left").select(*on, f"{p}t", F.coalesce(f"{p}here", f"{p}before").alias(f"{p}found"))
    return facts.join(found, [*on, f"{p}t"], "left").select(*facts.columns, f"{p}found")


def balanced(left: DataFrame, right: DataFrame, keys: list[str], left_amount: str, right_amount: str, tolerances: tuple[float, float] = (0.005, 0.05)) -> DataFrame:
    """(keys, left amount, right amount, side, gap, agreement): both sides' sums by key, also where only one has the key.

    ``side`` is both, left or right. ``gap`` is (left - right) / left where both have an amount and left isn't zero. ``agreement`` is equal, within or near
    (by the tolerances on the gap), beyond, unmatched, or unknown where an amount is null. The amounts of all rows add up to what
    went in on either side: nothing vanishes as it does in an inner join.

    Each side is summed by its keys before they meet, so no key is hot. A null key is a row of its own side and matches nothing.
    """
    p = fresh(left, right)

    def summed(df: DataFrame, amount: str, mark: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum(amount).alias(amount)).withColumn(f"{p}{mark}", F.lit(True))

    met = summed(left, left_amount, "l").join(summed(right, right_amount, "r"), keys, "full")
    a, b = F.col(left_amount).cast("double"), F.col(right_amount).cast("double")
    side = F.when(F.col(f"{p}l") & F.col(f"{p}r"), "both").when(F.col(f"{p}l"), "left").otherwise("right")
    gap = F.when(a != 0, (a - b) / a)
    agreement = (
        F.when(side != "both", "unmatched").when(a.isNull() | b.isNull(), "unknown").when(F.col(left_amount) == F.col(right_amount), "equal")
        .when(F.abs(gap) <= tolerances[0], "within").when(F.abs(gap) <= tolerances[1], "near").otherwise("beyond")
    )
    return met.select(*keys, left_amount, right_amount, side.alias("side"), gap.alias("gap"), agreement.alias("agreement"))


def balance_totals(rows: DataFrame, left_amount: str, right_amount: str) -> DataFrame:
    """(agreement, side, n, left_total, right_total): sums of ``balanced`` by class, and over all in a row with agreement and side ``all``; no rows of none."""
    sums = [F.count("*").alias("n"), F.coalesce(F.sum(left_amount), F.lit(0)).alias("left_total"), F.coalesce(F.sum(right_amount), F.lit(0)).alias("right_total")]
    grouped = rows.groupingSets([["agreement", "side"], []], "agreement", "side").agg(F.grouping_id().alias("gid"), *sums)
    named = lambda c: F.when(F.col("gid") > 0, "all").otherwise(F.col(c)).alias(c)
    return grouped.select(named("agreement"), named("side"), "n", "left_total", "right_total")


def age_of(at: Column, since: Column) -> Column:
    """How old a state is when it is taken."""
    return at.cast("bigint") - since.cast("bigint")
