"""Made-up sources with a planted cause, decoys and an anomaly, each a Spark program over a range of keys.

Randomness comes from hashes of the row's own keys, so a row is the same however the data are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.contract import CONTRACT
from veridelta.functions.columns import month_of, week_of

REGIONS = ["West", "East", "Central"]
CENTERS = ["WEST_DC", "EAST_DC", "CENTRAL_DC"]
#: (category, mean daily units, price, first week).
CATEGORIES = [("Electronics", 24.0, 180.0, 1), ("Home", 22.0, 60.0, 1), ("Apparel", 26.0, 45.0, 1), ("Accessories", 6.0, 25.0, 1), ("Outdoor", 9.0, 90.0, 34)]
CHANNELS = ["Search", "Social", "Display", "Email"]
#: (rep, region, share of the region's revenue, month of departure or none).
REPS = [("W1", "West", 0.05, "2025-08"), ("W2", "West", 0.045, "2025-08"), ("W3", "West", 0.04, "2025-08"), ("W4", "West", 0.035, "2025-08"), ("W5", "West", 0.03, None), ("W6", "West", 0.03, None), ("E1", "East", 0.05, None), ("E2", "East", 0.04, None), ("E3", "East", 0.03, None), ("C1", "Central", 0.05, None), ("C2", "Central", 0.04, None)]
ONSET, ANOMALY = 31, (36, 39)


def uniform(seed: int, *keys: str) -> Column:
    """From 0 to 1 (exclusive), by the keys alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + 0.5) / F.lit(float(1 << 53))


def gaussian(seed: int, *keys: str) -> Column:
    """Standard normal, by the keys alone (Box and Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * F.pi() * uniform(seed + 1, *keys))


def table_of(spark: SparkSession, name: str, values: list) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def days(spark: SparkSession, weeks: int, start: str) -> DataFrame:
    day = F.date_add(F.lit(start).cast("date"), F.col("id").cast("int"))
    return spark.range(weeks * 7).select(day.alias("date")).withColumn("week", week_of(F.col("date"), start))


def pos_transactions(spark: SparkSession, seed: int = 42, weeks: int = 40, start: str = CONTRACT["calendar"]["week1_start"]) -> DataFrame:
    """Daily sales by region, category and centre: trend, weekdays, near-Poisson units, price noise, a loss in the West from ONSET on."""
    kinds = spark.createDataFrame(CATEGORIES, "product_category string, mean double, price double, first_week int")
    grid = days(spark, weeks, start).join(table_of(spark, "region", REGIONS), F.lit(True)).join(kinds, F.lit(True)).where("week >= first_week").join(table_of(spark, "fulfillment_center", CENTERS), F.lit(True))
    home = F.upper(F.col("region")) == F.split("fulfillment_center", "_")[0]
    keys = ["date", "region", "product_category", "fulfillment_center"]
    weekday = F.when(F.dayofweek("date").isin(1, 7), 1.25).otherwise(0.9)
    hit = F.when((F.col("region") == "West") & (F.col("week") >= ONSET), F.when(F.col("week") == ONSET, 0.95).otherwise(0.88)).otherwise(1.0)
    mean = F.col("mean") * F.when(home, 0.7).otherwise(0.15) * weekday * (1 + 0.001 * F.col("week")) * hit
    units = F.greatest(F.lit(0), F.round(mean + F.sqrt(mean) * gaussian(seed, *keys))).cast("int")
    price = F.col("price") * (1 + 0.02 * gaussian(seed + 2, *keys))
    return grid.withColumn("units", units).select(*keys, "units", F.round(F.col("units") * price, 2).alias("gross_revenue"))


def marketing_spend(spark: SparkSession, seed: int = 43, weeks: int = 40, start: str = CONTRACT["calendar"]["week1_start"]) -> DataFrame:
    """Weekly spend by channel, on plan but for noise: no dose to respond to."""
    grid = spark.range(1, weeks + 1).select(F.col("id").cast("int").alias("week")).withColumn("week_start", F.date_add(F.lit(start).cast("date"), (F.col("week") - 1) * 7))
    grid = grid.join(table_of(spark, "region", REGIONS), F.lit(True)).join(table_of(spark, "channel", CHANNELS), F.lit(True))
    spend = F.round(5000 * (1 + 0.05 * gaussian(seed, "week", "region", "channel")), 2)
    return grid.withColumn("spend_usd", spend).withColumn("attributed_revenue_usd", F.round(F.col("spend_usd") * (2 + 0.1 * gaussian(seed + 2, "week", "region", "channel")), 2))


def stable_accounts(rep: Column) -> Column:
    """From 8 to 13 accounts, by the rep's name alone."""
    return (F.conv(F.substring(F.sha2(rep, 256), 1, 2), 16, 10).cast("int") % 6 + 8).cast("int")


def crm_headcount(pos: DataFrame) -> DataFrame:
    """Monthly rows of each rep: a share of the region's revenue, of which 5 % is left from the month of departure on."""
    monthly = pos.groupBy("region", month_of(F.col("date")).alias("month")).agg(F.sum("gross_revenue").alias("r"))
    reps = pos.sparkSession.createDataFrame(REPS, "rep_id string, region string, share double, left string")
    gone = F.coalesce(F.col("month") >= F.col("left"), F.lit(False))
    return monthly.join(reps, "region").select(
        "month", "region", "rep_id", F.concat(F.lit("Rep "), "rep_id").alias("rep_name"), (~gone).alias("active"), F.when(gone, F.to_date(F.concat("left", F.lit("-01")))).alias("attrition_date"),
        stable_accounts(F.col("rep_id")).alias("assigned_accounts"), F.round(F.col("r") * F.col("share") * F.when(gone, 0.05).otherwise(1.0), 2).alias("rep_attributed_revenue_usd"),
    )


def finance_gl_extract(pos: DataFrame, share: float = 0.98) -> DataFrame:
    """A fixed share of the sales of complete months."""
    month = month_of(F.col("date"))
    last = pos.agg(F.max("date").alias("__last"))
    sums = pos.groupBy(month.alias("month"), "region").agg(F.round(F.sum("gross_revenue") * share, 2).alias("gl_revenue_usd"))
    return sums.join(last, F.last_day(F.to_date(F.concat("month", F.lit("-01")))) <= F.col("__last")).drop("__last")


#: (topic, region, texts, week around which they come, words).
TOPICS = [("billing", "West", 14, 36, "invoice charged twice refund billing statement wrong"), ("weather", "West", 6, 34, "storm snow road closed delivery weather delay"), ("shipping", "West", 16, 20, "package late carrier shipping tracking lost"), ("general", "East", 16, 18, "question account password login help setting"), ("general", "Central", 16, 22, "question product size color catalog help")]


def support_tickets(spark: SparkSession, seed: int = 44, start: str = CONTRACT["calendar"]["week1_start"]) -> DataFrame:
    """Short texts of some topics, their days spread around the topic's week."""
    rows = spark.createDataFrame(TOPICS, "topic_seed string, region string, n int, week int, words string").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    day = F.date_add(F.lit(start).cast("date"), ((F.col("week") - 1) * 7 + F.round(4 * gaussian(seed, "topic_seed", "region", "i"))).cast("int"))
    words = F.split("words", " ")
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.get(words, F.pmod(F.xxhash64("topic_seed", "i", k), F.size(words)).cast("int"))), " ")
    return rows.select(F.concat_ws("-", "topic_seed", "region", "i").alias("ticket_id"), day.alias("created_at"), "region", "topic_seed", text.alias("text"))


def inject_anomaly(pos: DataFrame, gl: DataFrame, tickets: DataFrame, start: str = CONTRACT["calendar"]["week1_start"]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A second planted cause: the Central centre loses 15 % in four weeks, the ledger follows, and eight tickets tell of it.

    Tickets that are there already aren't added again.
    """
    week = week_of(F.col("date"), start)
    hit = (F.col("fulfillment_center") == "CENTRAL_DC") & (F.col("region") == "Central") & week.between(*ANOMALY)
    was, factor = pos.where(F.col("region") == "Central"), F.when(hit, 0.85).otherwise(1.0)
    ratio = was.groupBy(month_of(F.col("date")).alias("month"), "region").agg((F.sum(F.col("gross_revenue") * factor) / F.sum("gross_revenue")).alias("__ratio"))
    new_pos = pos.withColumn("units", F.round(F.col("units") * factor).cast("int")).withColumn("gross_revenue", F.round(F.col("gross_revenue") * factor, 2))
    new_gl = gl.join(ratio, ["month", "region"], "left").withColumn("gl_revenue_usd", F.round(F.col("gl_revenue_usd") * F.coalesce("__ratio", F.lit(1.0)), 2)).drop("__ratio")
    more = tickets.sparkSession.range(8).select(F.concat(F.lit("central-"), "id").alias("ticket_id"), F.date_add(F.lit(start).cast("date"), (245 + F.col("id") * 3).cast("int")).alias("created_at"), F.lit("Central").alias("region"), F.lit("wms").alias("topic_seed"), F.lit("warehouse migration orders stuck center delay").alias("text"))
    return new_pos, new_gl.select(*gl.columns), tickets.unionByName(more.join(tickets, "ticket_id", "left_anti"))


def fulfillment_center_ops(spark: SparkSession, months: int = 9, start: str = CONTRACT["calendar"]["week1_start"]) -> DataFrame:
    """Monthly capacity of each centre; Central's backlog grows from the eighth month on."""
    grid = spark.range(months).select(F.add_months(F.lit(start).cast("date"), F.col("id").cast("int")).alias("d"), "id").join(spark.createDataFrame(list(zip(CENTERS, REGIONS, strict=True)), "fulfillment_center string, region string"), F.lit(True))
    late = (F.col("fulfillment_center") == "CENTRAL_DC") & (F.col("id") >= 7)
    return grid.select(
        month_of(F.col("d")).alias("month"), "fulfillment_center", "region", F.when(late, 1200 * (F.col("id") - 6)).otherwise(60).cast("int").alias("orders_backlog"), F.when(late, 520).otherwise(480).cast("int").alias("daily_incoming_orders"),
        F.when(late, 480).otherwise(560).cast("int").alias("daily_processing_capacity_orders"), F.lit(40).alias("staff_headcount"), F.when(late, "in_progress").otherwise("none").alias("wms_migration_status"),
    )


#: What was planted, and what testing it should say.
MANIFEST = {"rep_attrition": "SURVIVED", "shipping_delay": "KILLED", "competitor_launch": "KILLED", "accessories_pricing": "INCONCLUSIVE", "billing_complaints": "KILLED", "weather_disruption": "KILLED", "marketing_spend_cut": "INCONCLUSIVE", "central_dc_delay": "SURVIVED"}
