"""Reconciliation: sources of several cadences on one panel, their freshness and completeness, and claims that can fail."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions.columns import half_even, month_of_week, ratio
from veridelta.sources.tables import materialize

#: Largest gap between agreeing sources, completeness of the tiers.
AGREEMENT, HIGH, MEDIUM = 0.005, 0.98, 0.90


def mature(sales: DataFrame, min_weeks: int = 8) -> DataFrame:
    """Rows of categories that were there from the first week, or have more than ``min_weeks`` weeks of history.

    First weeks are a small aggregate that is joined back: no category is gathered in a window.
    """
    first = sales.where("product_category is not null").groupBy("product_category").agg(F.min("week").alias("__first")).withColumnRenamed("product_category", "__of")
    joined = sales.join(first, F.col("product_category") == F.col("__of"))
    return joined.where((F.col("__first") <= 1) | (F.col("week") - F.col("__first") + 1 > min_weeks)).drop("__of", "__first")


def region_weeks(sales: DataFrame) -> DataFrame:
    """(region, week, revenue, units): sums; rows without a key are left out."""
    known = sales.where("region is not null and week is not null")
    return known.groupBy("region", "week").agg(F.sum("gross_revenue").alias("revenue"), F.sum("units").alias("units"))


def category_weeks(sales: DataFrame) -> DataFrame:
    """(region, product_category, week, revenue, units), of all categories, mature or not."""
    known = sales.where("region is not null and product_category is not null and week is not null")
    return known.groupBy("region", "product_category", "week").agg(F.sum("gross_revenue").alias("revenue"), F.sum("units").alias("units"))


def weekly_panel(sales: DataFrame, marketing_weeks: DataFrame, reps: DataFrame, first_monday: str, min_weeks: int = 8) -> DataFrame:
    """One row per region and week: revenue and units of mature categories, attributed marketing revenue, rep revenue and share.

    ``marketing_weeks`` has (region, week, attributed_revenue), ``reps`` (region, month, rep_attributed_revenue). A month's
    rep revenue is spread evenly over its weeks in the panel. Weeks without marketing or reps keep nulls.
    """
    cube = materialize(category_weeks(sales).withColumnRenamed("revenue", "gross_revenue"), "category-weeks")  # the facts are read once for it
    base = region_weeks(mature(cube, min_weeks)).withColumn("month", month_of_week(F.col("week"), first_monday))
    spend = marketing_weeks.groupBy("region", "week").agg(F.sum("attributed_revenue").alias("marketing_attributed_revenue"))
    monthly = reps.groupBy("region", "month").agg(F.sum("rep_attributed_revenue").alias("__month"))
    weeks = base.groupBy("region", "month").agg(F.count("week").alias("__weeks"))
    joined = base.join(spend, ["region", "week"], "left").join(monthly.join(weeks, ["region", "month"]), ["region", "month"], "left")
    return joined.select(
        "region", "week", F.col("revenue").cast("double").alias("revenue"), F.col("units").alias("units_sold"),
        F.col("marketing_attributed_revenue").cast("double").alias("marketing_attributed_revenue"), "month",
        (F.col("__month").cast("double") / F.col("__weeks")).alias("rep_attributed_revenue"),
        half_even(F.col("marketing_attributed_revenue").cast("double") / F.col("revenue").cast("double"), 4).alias("marketing_attributed_revenue_share"),
    )


def ordered(panel: DataFrame) -> DataFrame:
    """A panel in the order of region and week, in ranges, as it is written."""
    return panel.orderBy("region", "week")


def freshness(covers: list[tuple[str, str, DataFrame, Column]], as_of: str) -> DataFrame:
    """(source, refresh_cadence, covered_through, staleness_days) from (source, cadence, rows, date that a row covers to)."""
    out = None
    for name, cadence, rows, through in covers:
        one = rows.agg(F.max(through).cast("date").alias("covered_through")).select(F.lit(name).alias("source"), F.lit(cadence).alias("refresh_cadence"), "covered_through")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("staleness_days", F.datediff(F.lit(as_of).cast("date"), F.col("covered_through")))


def complete_months(first: date, as_of: date) -> list[str]:
    """Months that the range touches, without a last one that isn't over; a first one that began earlier stays."""
    months, day = [], first.replace(day=1)
    while day <= as_of:
        after = (day + timedelta(days=32)).replace(day=1)
        if after - timedelta(days=1) <= as_of:
            months.append(day.strftime("%Y-%m"))
        day = after
    return months


def day_completeness(rows: DataFrame, expected_days: int) -> DataFrame:
    """(completeness): the mean over regions of distinct days against those expected, at most 1 each."""
    days = rows.where("region is not null").groupBy("region").agg(F.countDistinct("date").alias("n"))
    return days.agg(F.avg(F.least(F.lit(1.0), F.col("n") / F.lit(expected_days))).alias("completeness"))


def key_completeness(rows: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """(completeness): distinct combinations of keys against those expected."""
    return rows.select(*keys).distinct().agg((F.count("*") / F.lit(expected)).alias("completeness"))


def tiered(scores: DataFrame) -> DataFrame:
    """Adds quality_tier to (completeness, system_of_record): n/a, high, medium or low."""
    c = F.col("completeness")
    return scores.withColumn("quality_tier", F.when(c.isNull(), "n/a").when((c >= HIGH) & F.col("system_of_record"), "high").when(c >= MEDIUM, "medium").otherwise("low"))


def source_gaps(sales: DataFrame, gl: DataFrame) -> DataFrame:
    """(month, region, pos_revenue, gl_revenue, gap): the ledger's gap to the sales, where both have a row."""
    monthly = sales.groupBy("month", "region").agg(F.sum("gross_revenue").alias("pos_revenue"))
    joined = monthly.join(gl, ["month", "region"])
    pos, book = F.col("pos_revenue").cast("double"), F.col("gl_revenue").cast("double")
    return joined.select("month", "region", pos.alias("pos_revenue"), book.alias("gl_revenue"), ((pos - book) / pos).alias("gap"))


def agreement_claim(gaps: DataFrame) -> DataFrame:
    """One row: the claim that the two sources agree, and whether it is refuted."""
    worst = F.max(F.abs("gap"))
    return gaps.agg(F.count("*").alias("n_compared"), F.avg("gap").alias("mean_gap"), worst.alias("max_abs_gap")).withColumn("verdict", F.when(F.col("max_abs_gap") <= AGREEMENT, "AGREES").otherwise("DISAGREES"))


def bounds_claim(reps: DataFrame, sales: DataFrame) -> DataFrame:
    """One row: the claim that reps' attributed revenue stays within the region's revenue, with the worst month."""
    mine = reps.groupBy("region", "month").agg(F.sum("rep_attributed_revenue").alias("rep"))
    all_ = sales.groupBy("region", "month").agg(F.sum("gross_revenue").alias("revenue"))
    joined = mine.join(all_, ["region", "month"]).withColumn("ratio", ratio(F.col("rep"), F.col("revenue")))
    top = F.max_by(F.struct("region", "month"), F.struct(F.round("ratio", 9), "region", "month"))
    found = joined.agg(F.count("*").alias("n_compared"), F.max("ratio").alias("max_ratio"), top.alias("__w"))
    return found.select("n_compared", "max_ratio", F.col("__w.region").alias("worst_region"), F.col("__w.month").alias("worst_month"), F.when(F.col("max_ratio") > 1, "VIOLATED").otherwise("HOLDS").alias("verdict"))


def join_loss(name: str, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(join, expected, matched, loss_rate): the left side's key combinations that an inner join loses."""
    a = left.select(*keys).distinct()
    both = a.join(right.select(*keys).distinct().withColumn("__m", F.lit(1)), keys, "left")
    n, m = F.count("*"), F.count("__m")
    return both.agg(n.alias("expected"), m.alias("matched"), ((n - m) / n).alias("loss_rate")).select(F.lit(name).alias("join"), "expected", "matched", "loss_rate")


def null_loss(name: str, rows: DataFrame, column: str) -> DataFrame:
    """The same of a left join, by the nulls it leaves in a column."""
    n, m = F.count("*"), F.count(column)
    return rows.agg(n.alias("expected"), m.alias("matched"), ((n - m) / n).alias("loss_rate")).select(F.lit(name).alias("join"), "expected", "matched", "loss_rate")
