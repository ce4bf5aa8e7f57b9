"""Queries of the joins beyond equality, the lattice and the sketches over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.operators import joins, lattice, sketches
from veridelta.sources import binding
from veridelta.sources.binding import LEDGER_SQL, SALES_SQL
from veridelta.sources.tables import materialize, shared_dir, table
from veridelta.streaming import gate

from .registry import register

PRE, POST = (180, 182), (184, 186)


def micros() -> Column:
    """An event's time in microseconds, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")


BALANCED_SQL = f"""
{SALES_SQL}, {LEDGER_SQL},
a as (select month, region, sum(gross_revenue) as pos_revenue from sales group by all), b as (select month, region, sum(gl_revenue) as gl_revenue from gl group by all),
met as (select coalesce(a.month, b.month) as month, coalesce(a.region, b.region) as region, pos_revenue, gl_revenue,
  case when a.month is null then 'right' when b.month is null then 'left' else 'both' end as side,
  (cast(pos_revenue as double) - cast(gl_revenue as double)) / cast(pos_revenue as double) as gap
  from a full join b on a.month = b.month and a.region = b.region),
balanced as (select *, case when side <> 'both' then 'unmatched' when pos_revenue = gl_revenue then 'equal' when abs(gap) <= 0.005 then 'within' when abs(gap) <= 0.05 then 'near' else 'beyond' end as agreement from met)
"""


def _balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.balanced(binding.sales(spark, sf_dir), binding.ledger_extract(spark, sf_dir), ["month", "region"], "gross_revenue", "gl_revenue")


@register("full_reconciliation", f"with {BALANCED_SQL} select month, region, cast(pos_revenue as double) as pos_revenue, cast(gl_revenue as double) as gl_revenue, side, round(gap, 6) as gap, agreement from balanced")
def full_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales months against ledger months, also those that only one of them has."""
    rows = _balanced(spark, sf_dir)
    return rows.select("month", "region", F.col("gross_revenue").cast("double").alias("pos_revenue"), F.col("gl_revenue").cast("double").alias("gl_revenue"), "side", F.round("gap", 6).alias("gap"), "agreement")


@register("reconciliation_totals", f"""with {BALANCED_SQL}
select agreement, side, count(*) as n, cast(coalesce(sum(pos_revenue), 0) as double) as left_total, cast(coalesce(sum(gl_revenue), 0) as double) as right_total from balanced group by all
union all select 'all', 'all', (select count(*) from balanced), cast((select sum(gross_revenue) from sales) as double), cast((select sum(gl_revenue) from gl) as double)
""")
def reconciliation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each class of agreement holds; the row over all is what the two sources hold themselves."""
    totals = joins.balance_totals(_balanced(spark, sf_dir), "gross_revenue", "gl_revenue")
    return totals.select("agreement", "side", "n", F.col("left_total").cast("double").alias("left_total"), F.col("right_total").cast("double").alias("right_total"))


INCIDENTS_SQL = """
incidents as (select event_id as incident, user_id, epoch_us(ts) as begun, epoch_us(ts) + cast(round(value * 60) as bigint) * 1000000 as until, cast(round(value * 3600) as bigint) * 1000000 + epoch_us(ts) as until_slow from events where event_type = 'error'),
others as (select event_id, user_id as who, event_type, cast(value as decimal(18,4)) as value, epoch_us(ts) as moment from events where event_type <> 'error')
"""


def _incidents(spark: SparkSession, sf_dir: str, unit: int) -> tuple[DataFrame, DataFrame]:
    """Other events, and each error's window: as many units of seconds as its value says, from no time to days."""
    events = table(spark, sf_dir, "events").withColumn("at", micros())
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("incident"), "user_id", F.col("at").alias("begun"), (F.col("at") + F.round(F.col("value") * unit).cast("bigint") * 1_000_000).alias("over"))
    return events.where("event_type <> 'error'").select("event_id", "user_id", "event_type", F.col("value").cast("decimal(18,4)").alias("value"), "at"), errors


@register("incident_hits", f"""with {INCIDENTS_SQL}
select event_type, count(*) as hits, count(distinct incident) as incidents, cast(sum(value) as double) as value from others join incidents on moment between begun and until group by event_type
""")
def incident_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all users inside error incidents that last as many minutes as their value."""
    points, windows = _incidents(spark, sf_dir, 60)
    found = joins.interval_totals(points, windows, "at", "begun", "over", "incident", "event_type", "value")
    return found.select("event_type", "hits", F.col("windows").alias("incidents"), F.col("total").cast("double").alias("value"))


@register("user_incidents", f"""with {INCIDENTS_SQL}
select incident, event_id, moment - begun as micros_in from others join incidents on who = user_id and moment between begun and until_slow
""")
def user_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of a user inside that user's own incidents, which last as many hours as their value."""
    points, windows = _incidents(spark, sf_dir, 3600)
    return joins.interval_join(points, windows, "at", "begun", "over", ["user_id"]).select("incident", "event_id", (F.col("at") - F.col("begun")).alias("micros_in"))


@register("asof_price", """
with quoted as (
  select l_partkey as part, date_diff('day', date '1970-01-01', cast(o_orderdate as date))::bigint as quoted_on, max(cast(l_extendedprice as decimal(18,2))) as quoted_price
  from lineitem join orders on l_orderkey = o_orderkey group by all),
ship as (select l_partkey as part, l_orderkey, l_linenumber, cast(l_quantity as bigint) as units, date_diff('day', date '1970-01-01', cast(l_shipdate as date))::bigint as shipped_on from lineitem),
found as (select s.*, q.quoted_on, q.quoted_price from ship s asof left join quoted q on s.part = q.part and s.shipped_on >= q.quoted_on)
select part, l_orderkey, l_linenumber, units, shipped_on, case when shipped_on - quoted_on <= 120 then quoted_on end as quoted_on,
  cast(case when shipped_on - quoted_on <= 120 then quoted_price end as double) as quoted_price from found
""")
def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shipment with its part's latest quoted amount at or before the day, not older than 120 days."""
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "part")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint").alias("quoted_on"))
    price = F.max(F.col("l_extendedprice").cast("decimal(18,2)")).alias("quoted_price")
    quoted = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("part", "quoted_on").agg(price)
    shipped = line.select("part", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("units"), F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint").alias("shipped_on"))
    return joins.asof_join(shipped, quoted, "shipped_on", "quoted_on", ["part"], tolerance=120).withColumn("quoted_price", F.col("quoted_price").cast("double"))


@register("asof_purchase", """
with bought as (select user_id, epoch_us(ts) as bought_at, max(value) as bought from events where event_type = 'purchase' group by all),
faults as (select event_id, user_id, epoch_us(ts) as moment from events where event_type = 'error')
select event_id, f.user_id, bought, moment - bought_at as micros_since from faults f asof left join bought b on f.user_id = b.user_id and f.moment >= b.bought_at
""")
def asof_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error with its user's last purchase before it, however long ago."""
    events = table(spark, sf_dir, "events").withColumn("at", micros())
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("at").alias("bought_at"), F.col("value").alias("bought"))
    found = joins.asof_join(events.where("event_type = 'error'").select("event_id", "user_id", "at"), bought, "at", "bought_at", ["user_id"])
    return found.select("event_id", "user_id", "bought", joins.age_of(F.col("at"), F.col("bought_at")).alias("micros_since"))


DIMS = ["region", "product_category", "fulfillment_center"]
CELLS_SQL = f"""
{SALES_SQL}, cells as (
  select region, product_category, fulfillment_center, (7 - (4 * grouping(fulfillment_center) + 2 * grouping(product_category) + grouping(region)))::integer as cell,
    sum(case when week between 180 and 182 then gross_revenue else 0 end) as before, sum(case when week between 184 and 186 then gross_revenue else 0 end) as after
  from sales where week between 180 and 182 or week between 184 and 186 group by cube (region, product_category, fulfillment_center)),
moved as (select *, bit_count(cell)::integer as level, after - before as delta from cells)
"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.cells(binding.sales(spark, sf_dir), DIMS, PRE, POST)


@register("cube_movements", f"with {CELLS_SQL} select region, product_category, fulfillment_center, cell, level, cast(before as double) as before, cast(after as double) as after, cast(delta as double) as delta from moved")
def cube_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movement of every cell of region, category and centre, and of all that they roll up to."""
    return _cells(spark, sf_dir).select(*DIMS, "cell", "level", *[F.col(c).cast("double").alias(c) for c in ("before", "after", "delta")])


@register("cube_root_causes", f"""
with {CELLS_SQL},
share as (select m.*, cast(m.delta as double) / (select cast(delta as double) from moved where level = 0) as explained from moved m where (select delta from moved where level = 0) <> 0),
below as (
  select p.region, p.product_category, p.fulfillment_center, p.cell, max(c.explained) as most from share p join share c
  on c.level = p.level + 1 and (c.cell & p.cell) = p.cell and c.explained > 0 and (p.cell & 1 = 0 or c.region is not distinct from p.region)
  and (p.cell & 2 = 0 or c.product_category is not distinct from p.product_category) and (p.cell & 4 = 0 or c.fulfillment_center is not distinct from p.fulfillment_center)
  group by all),
judged as (
  select s.*, coalesce(most / explained, 0) as deepest_share from share s left join below b on s.cell = b.cell and s.region is not distinct from b.region
  and s.product_category is not distinct from b.product_category and s.fulfillment_center is not distinct from b.fulfillment_center where explained >= 0.05)
select region, product_category, fulfillment_center, cell, level, cast(delta as double) as delta, round(explained, 6) as explained, round(deepest_share, 6) as deepest_share from judged where deepest_share < 0.8
""")
def cube_root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that explain a twentieth of the movement or more and of whose movement no narrower cell has four fifths."""
    found = lattice.root_causes(_cells(spark, sf_dir), DIMS, 0.05, 0.8)
    return found.select(*DIMS, "cell", "level", F.col("delta").cast("double").alias("delta"), F.round("explained", 6).alias("explained"), F.round("deepest_share", 6).alias("deepest_share"))


@register("sketched_quarters", f"""
with {SALES_SQL}, quarters as (
  select region, cast(floor((week - 1) / 13.0) as integer) as quarter, count(*) as n, cast(sum(gross_revenue) as double) as total, count(distinct rep_id) as reps from sales group by all)
select region, quarter, n, total, reps, true as reps_within, true as median_within, true as p95_within from quarters
""")
def sketched_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reps and revenue quantiles of each quarter from weekly sketches, and whether they are as near to the exact ones as the sketches promise."""
    sales = materialize(binding.sales(spark, sf_dir).select("region", "week", "rep_id", "gross_revenue"), "quarter-sales")  # read for the sketches and for what they are held against
    weekly = materialize(sketches.sketched(sales, ["region", "week"], "rep_id", "gross_revenue"), "weekly-sketches")
    quarter = F.floor((F.col("week") - 1) / 13.0).cast("int").alias("quarter")
    found = sketches.merged(weekly.select("*", quarter), ["region", "quarter"])
    told = found.select("region", "quarter", "n", F.col("total").cast("double").alias("total"), sketches.distinct_of(F.col("keys")).alias("about"), *[sketches.quantile_of(F.col("amounts"), q).alias(f"q{q}") for q in (0.5, 0.95)])
    amount = F.col("gross_revenue").cast("double")
    margin = sketches.rank_error()
    exact = sales.select("region", quarter, "rep_id", amount.alias("amount")).join(told.select("region", "quarter", "`q0.5`", "`q0.95`"), ["region", "quarter"])
    ranks = [(F.sum((F.col("amount") < F.col(f"`q{q}`")).cast("int")) / F.count("*") - q <= margin) & (F.sum((F.col("amount") <= F.col(f"`q{q}`")).cast("int")) / F.count("*") - q >= -margin) for q in (0.5, 0.95)]
    checked = exact.groupBy("region", "quarter").agg(F.countDistinct("rep_id").alias("reps"), ranks[0].alias("median_within"), ranks[1].alias("p95_within"))
    within = F.abs(F.col("about") - F.col("reps")) <= F.greatest(F.lit(1.0), F.col("reps") * sketches.distinct_error())
    return told.join(checked, ["region", "quarter"]).select("region", "quarter", "n", "total", "reps", within.alias("reps_within"), "median_within", "p95_within")


@register("streaming_gate", """
select event_type as key, cast(floor(epoch_us(ts) / 86400000000.0) as bigint) as period, cast(sum(cast(round(value * 10000) as bigint)) as double) / 10000 as value, count(*) as n_rows, 0::bigint as n_late
from events where (floor(epoch_us(ts) / 86400000000.0) + 1) * 86400000 <= (select max(epoch_ms(ts)) from events) - 172800000 group by all
""")
def streaming_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream by type and day: the days that have closed by the watermark, from the stream's sink."""
    name, provider = gate.STATE_STORE
    # five keys need few state stores; a stream keeps the number that it begins with
    wanted = {name: provider, "spark.sql.shuffle.partitions": str(min(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    before = {k: spark.conf.get(k) for k in wanted}
    out = f"{shared_dir(spark)}/closed-days-{uuid.uuid4().hex}"
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may name a file as well as a folder
        closed = gate.gate_stream(stream.withColumn("ts", F.timestamp_micros(micros())), "event_type", "ts", "value", (50.0, 1.0, 2.0, 100.0), seconds=86400)
        closed.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(gate.CLOSED).parquet(out).select("key", "period", "value", "n_rows", "n_late")
