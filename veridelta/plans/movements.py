"""Queries of the signal and localisation operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta import contract
from veridelta.functions import table_functions
from veridelta.operators import localise, reconcile, signal
from veridelta.sources import binding
from veridelta.sources.binding import SALES_SQL
from veridelta.sources.tables import table

from .registry import register

PRE, POST = (100, 102), (104, 106)
PRE_MONTHS, POST_MONTHS = ["1998-05"], ["1998-06", "1998-07"]
KINDS = ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"]
URGENCIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def weekly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kpi, region, period_unit, period, value): weekly revenue and units, the last, partial week left out, and monthly revenue as reps' revenue."""
    sales = binding.sales_cube(binding.sales(spark, sf_dir), ["region", "week", "month"])
    weeks = reconcile.region_weeks(sales).where(F.col("week") < binding.WEEKS)
    tall = weeks.selectExpr("region", "week as period", "stack(2, 'revenue', cast(revenue as double), 'units_sold', cast(units as double)) as (kpi, value)").withColumn("period_unit", F.lit("week"))
    months = sales.groupBy("region", "month").agg(F.sum("gross_revenue").cast("double").alias("value"))
    place = F.row_number().over(Window.partitionBy("region").orderBy("month"))
    monthly = months.select("region", place.alias("period"), F.lit("rep_attributed_revenue").alias("kpi"), "value", F.lit("month").alias("period_unit"))
    return tall.unionByName(monthly)


BOCPD_SQL = f"""
with recursive {SALES_SQL},
s as (select region, month, cast(sum(gross_revenue) as double) as x, row_number() over (partition by region order by month) as t from sales group by region, month),
p as (select region, avg(x) as mu0, greatest(var_pop(x), 1e-6) as beta0, count(*) as n from s group by region),
run as (
  select region, 0::bigint as t, [1.0::double] as w, [mu0] as mu, [beta0] as beta, 0.0::double as first from p
  union all
  select q.region, q.t + 1, list_transform(q.nw, lambda v: v / list_sum(q.nw)),
    list_concat([q.mu0], list_transform(range(1, len(q.mu) + 1), lambda i: ((i) * q.mu[i] + q.x) / (i + 1))),
    list_concat([q.beta0], list_transform(range(1, len(q.mu) + 1), lambda i: q.beta[i] + i * (q.x - q.mu[i]) ** 2 / (2 * (i + 1)))),
    q.nw[2] / list_sum(q.nw)
  from (
    select r.*, s.x, p.mu0, p.beta0,
      list_concat([list_sum(j.v) / 15.0], list_transform(j.v, lambda y: y * (1 - 1 / 15.0::double))) as nw
    from run r join s on s.region = r.region and s.t = r.t + 1 join p on p.region = r.region,
    lateral (select list_transform(range(1, len(r.w) + 1), lambda i: r.w[i] * exp(lgamma(2 + (i - 1) / 2.0 + 0.5) - lgamma(2 + (i - 1) / 2.0))
        / sqrt(2 * (2 + (i - 1) / 2.0) * pi() * (r.beta[i] * (i + 1) / ((2 + (i - 1) / 2.0) * i)))
        * pow(1 + pow(s.x - r.mu[i], 2) / (2 * (2 + (i - 1) / 2.0) * (r.beta[i] * (i + 1) / ((2 + (i - 1) / 2.0) * i))), -(2 + (i - 1) / 2.0 + 0.5))) as v) j
  ) q),
"""

DETECT_TAIL = """
ends as (select run.region, p.n, list_slice(w, 2, len(w)) as f from run join p on p.region = run.region and run.t = p.n),
best as (select region, n, f, list_position(f, list_max(f)) - 1 as j from ends),
est as (select region, n, n - j + 1 as tau, list_sum(list_slice(f, greatest(j - 2, 0) + 1, j + 3)) as confidence from best),
i as (select *, least(greatest(tau - 1, 1), n - 1) as k from est),
base as (select i.region, avg(case when s.t <= k and s.t > greatest(k - 6, 0) then x end) as b, avg(case when s.t > k then x end) as c from i join s using (region) group by i.region)
"""


@register("bocpd_estimate", BOCPD_SQL + DETECT_TAIL + """
select 'rep_attributed_revenue' as kpi, region, 'month' as period_unit, cast(n as integer) as n_observations, n < 8 as sparse_history, cast(tau as integer) as tau,
  round(confidence, 6) as confidence, round((c - b) / b, 6) as impact_pct, round(c - b, 2) as impact_abs from i join base using (region)
""")
def bocpd_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changepoint, confidence and impact of each region's monthly series."""
    found = signal.detect(weekly_series(spark, sf_dir).where("period_unit = 'month'"))
    return found.select("kpi", "region", "period_unit", "n_observations", "sparse_history", "tau", F.round("confidence", 6).alias("confidence"), F.round("impact_pct", 6).alias("impact_pct"), F.round("impact_abs", 2).alias("impact_abs"))


@register("bocpd_weekly")
def bocpd_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the weekly series, which the recursive oracle is too slow for."""
    return signal.detect(weekly_series(spark, sf_dir).where("period_unit = 'week'"))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.gate(signal.detect(weekly_series(spark, sf_dir)), contract.kpi_table(spark))


@register("gate", BOCPD_SQL + DETECT_TAIL + """
select 'rep_attributed_revenue' as kpi, region, cast(tau as integer) as tau, confidence > 0.75 and tau > 1 and tau > n - 3 as statistical_materiality,
  abs((c - b) / b) >= 0.03 or abs(c - b) >= 20000 as business_materiality,
  confidence > 0.75 and tau > 1 and tau > n - 3 and (abs((c - b) / b) >= 0.03 or abs(c - b) >= 20000) and n >= 8 as gate_passed
from i join base using (region)
""")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both materialities and the gate, of the monthly series."""
    found = signal.gate(signal.detect(weekly_series(spark, sf_dir).where("period_unit = 'month'")), contract.kpi_table(spark))
    return found.select("kpi", "region", "tau", "statistical_materiality", "business_materiality", "gate_passed")


@register("gate_all")
def gate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both materialities and the gate of every series, weekly ones too; held against a plain fold in the tests."""
    return gated(spark, sf_dir).select("kpi", "region", "period_unit", "tau", "statistical_materiality", "business_materiality", "gate_passed")


@register("priority")
def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series' movement ranked, with the recency condition lifted so that there is something to rank."""
    found = gated(spark, sf_dir).withColumn("gate_passed", F.col("business_materiality"))
    monthly = F.col("period_unit") == "month"
    week = F.when(monthly, F.round(F.col("tau") * 52.18 / 12)).otherwise(F.col("tau")).cast("int")
    return signal.prioritize(found.withColumn("calendar_week", week)).drop("narrative")


@register("impact", f"""
with {SALES_SQL}, s as (select region, week as t, cast(sum(gross_revenue) as double) as x from sales where week < 357 group by all)
select region, round(avg(case when t between 294 and 299 then x end), 4) as base, round(avg(case when t >= 300 then x end), 4) as recent,
  round((avg(case when t >= 300 then x end) - avg(case when t between 294 and 299 then x end)) / avg(case when t between 294 and 299 then x end), 6) as impact_pct
from s group by region
""")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing six weeks against all from week 300 on."""
    weeks = reconcile.region_weeks(binding.sales(spark, sf_dir)).where(F.col("week") < binding.WEEKS)
    value = F.col("revenue").cast("double")
    both = weeks.groupBy("region").agg(F.avg(F.when(F.col("week").between(294, 299), value)).alias("base"), F.avg(F.when(F.col("week") >= 300, value)).alias("recent"))
    found = signal.impact_at(weeks.where("week >= 294").select(F.lit("revenue").alias("kpi"), "region", F.col("week").alias("period"), value.alias("value")), 300)
    return both.join(found, "region").select("region", F.round("base", 4).alias("base"), F.round("recent", 4).alias("recent"), F.round("impact_pct", 6).alias("impact_pct"))


@register("same_event", f"""
with {SALES_SQL}, w as (select region, product_category as kpi, week, sum(units) as u from sales group by all),
peak as (select region, kpi, max_by(week, struct_pack(u := u, w := -week)) as week from w group by all)
select a.region, a.kpi, a.week, array_to_string(list_sort(list(b.kpi) filter (b.kpi is not null)), ',') as same_event_as
from peak a left join peak b on a.region = b.region and a.kpi <> b.kpi and abs(a.week - b.week) <= 2 group by all
""")
def same_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak weeks of each category in a region, and the other categories that peak within two weeks."""
    units = binding.sales(spark, sf_dir).groupBy("region", F.col("product_category").alias("kpi"), "week").agg(F.sum("units").alias("u"))
    peak = units.groupBy("region", "kpi").agg(F.max_by("week", F.struct("u", -F.col("week"))).alias("week"))
    found = signal.same_events(peak.withColumnRenamed("week", "calendar_week"))
    return peak.join(found, ["region", "kpi"], "left").withColumn("same_event_as", F.array_join("same_event_as", ","))


@register("bridge_pvm", f"""
with {SALES_SQL}, b as (select region,
  cast(coalesce(sum(gross_revenue) filter (week between 100 and 102), 0) as double) as r0, cast(coalesce(sum(gross_revenue) filter (week between 104 and 106), 0) as double) as r1,
  cast(coalesce(sum(units) filter (week between 100 and 102), 0) as double) as q0, cast(coalesce(sum(units) filter (week between 104 and 106), 0) as double) as q1
  from sales where week between 100 and 102 or week between 104 and 106 group by region)
select region, round(r0, 4) as revenue_pre, round(r1, 4) as revenue_post, round((q1 - q0) * coalesce(r0 / nullif(q0, 0), 0), 4) as volume_effect,
  round(q1 * (coalesce(r1 / nullif(q1, 0), 0) - coalesce(r0 / nullif(q0, 0), 0)), 4) as price_effect from b
""")
def bridge_pvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = localise.price_volume_bridge(binding.sales(spark, sf_dir), ["region"], PRE, POST)
    return found.select("region", *[F.round(c, 4).alias(c) for c in ("revenue_pre", "revenue_post", "volume_effect", "price_effect")])


@register("mix_shift", f"""
with {SALES_SQL}, c as (select region, product_category, cast(coalesce(sum(units) filter (week between 100 and 102), 0) as double) as q0, cast(coalesce(sum(units) filter (week between 104 and 106), 0) as double) as q1,
  cast(coalesce(sum(gross_revenue) filter (week between 100 and 102), 0) as double) as r0 from sales where week between 100 and 102 or week between 104 and 106 group by all),
t as (select region, sum(q0) as t0, sum(q1) as t1 from c group by 1)
select region, round(sum((coalesce(q1 / nullif(t1, 0), 0) - coalesce(q0 / nullif(t0, 0), 0)) * t1 * coalesce(r0 / nullif(q0, 0), 0)), 4) as mix_shift from c join t using (region) group by 1
""")
def mix_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localise.mix_shift(binding.sales(spark, sf_dir), ["region"], "product_category", PRE, POST).withColumn("mix_shift", F.round("mix_shift", 4))


@register("shapley_additive", f"""
with {SALES_SQL} select region, product_category as player,
  round(cast(sum(case when week between 104 and 106 then gross_revenue else -gross_revenue end) as double), 4) as delta
from sales where week between 100 and 102 or week between 104 and 106 group by all
""")
def shapley_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = localise.category_deltas(binding.sales(spark, sf_dir), ["region"], "product_category", PRE, POST)
    return found.withColumn("delta", F.round("delta", 4))


@register("shapley_exact", """
with m as (select distinct o_custkey, o_orderpriority as player from orders), c as (select o_custkey, count(*) as n from m group by 1)
select player, round(sum(1.0::double / n), 6) as value from m join c using (o_custkey) group by 1
""")
def shapley_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the customer base each order priority reaches, over all coalitions."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    worth = localise.coverage_worth(orders, URGENCIES, "o_custkey", "o_orderpriority")
    return localise.shapley_exact(worth, URGENCIES).withColumn("value", F.round("value", 6))


@register("shapley_sampled", f"""
with {SALES_SQL} select product_category as player,
  round(cast(sum(case when week between 104 and 106 then gross_revenue else -gross_revenue end) as double), 4) as value
from sales where week between 100 and 102 or week between 104 and 106 group by all
""")
def shapley_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random orders of an additive game, which give the players' own deltas whatever the orders."""
    deltas = localise.category_deltas(binding.sales(spark, sf_dir), [], "product_category", PRE, POST)
    so_far = Window.partitionBy("permutation").orderBy("position")
    found = localise.shapley_sampled(spark, KINDS, lambda placed: placed.join(deltas, "player").withColumn("worth", F.sum("delta").over(so_far)))
    return found.withColumn("value", F.round("value", 4))


def _mixed_sql(x: str) -> str:
    """``localise.mixed`` of a 32-bit word."""
    first = f"list_transform([{x}], lambda a: xor(a, a >> 16) * {localise.FIRST_FACTOR} % 4294967296)"
    second = f"list_transform({first}, lambda b: xor(b, b >> 15) * {localise.SECOND_FACTOR} % 4294967296)"
    return f"list_transform({second}, lambda c: xor(c, c >> 16))[1]"


ROW_WORD_SQL = _mixed_sql(f"xor({_mixed_sql(f'(identity % 4294967296 + {localise.SEED}) % 4294967296')}, identity // 4294967296 % 4294967296)")


@register("bootstrap_ci", f"""
with {SALES_SQL},
r as (
  select week, product_category as player, week between 104 and 106 as later, cast(gross_revenue * 10000 as bigint) as value,
    date_diff('day', date '1970-01-01', date)::bigint * 15485863 + rep_id * 1000003 + units * 7919 + cast(gross_revenue * 10000 as bigint) as identity, count(*) as copies
  from sales where week between 100 and 102 or week between 104 and 106 group by all),
c as (select week, player, later, value, unnest(range(0, copies)) * {localise.COPY_STEP} + identity as identity from r),
w as (select week, player, later, value, {ROW_WORD_SQL} as word from c),
u as (select week, player, later, value, replicate, {_mixed_sql(f"xor(word, replicate * {localise.REPLICATE_STEP} % 4294967296)")} as drawn_word from w, unnest(range(0, {localise.REPLICATES})) as k(replicate)),
d as (select week, player, later, value, replicate, len(list_filter({localise.POISSON_LIMITS.tolist()}, lambda x: x <= drawn_word)) as n from u),
cells as (select week, player, later, replicate, sum(n) as drawn, sum(n * value) as value from d group by all),
weeks as (select week, replicate, sum(drawn) as every from cells group by all), sizes as (select week, sum(copies) as n_rows from r group by week),
per as (
  select player, replicate, sum(cast(value as double) / 10000 * case when every = 0 then 0 else cast(n_rows as double) / cast(every as double) end * case when later then 1 else -1 end) as delta
  from cells join weeks using (week, replicate) join sizes using (week) group by all)
select player, round(quantile_cont(delta, 0.05), 3) as low, round(quantile_cont(delta, 0.95), 3) as high from per group by player
""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the categories' deltas; the draws follow from the rows, so that they are the same anywhere."""
    sales = binding.sales(spark, sf_dir)
    identity = F.unix_date("date").cast("bigint") * 15485863 + F.col("rep_id") * 1000003 + F.col("units") * 7919 + (F.col("gross_revenue") * 10000).cast("bigint")
    found = localise.bootstrap_deltas(sales, "product_category", PRE, POST, identity=identity)
    return found.select("player", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@register("rep_share", f"""
with {SALES_SQL}, m as (select region, month, rep_id, cast(sum(gross_revenue) as double) as v from sales where month in ('1998-05', '1998-06', '1998-07') group by all),
t as (select region, month, cast(sum(gross_revenue) as double) as v from sales where month in ('1998-05', '1998-06', '1998-07') group by all),
loss as (select region, avg(v) filter (month <> '1998-05') - avg(v) filter (month = '1998-05') as loss from t group by 1),
d as (select region, rep_id, coalesce(avg(v) filter (month <> '1998-05'), 0) - coalesce(avg(v) filter (month = '1998-05'), 0) as delta from m group by all)
select region, rep_id, round(delta, 6) as delta, round(case when loss < 0 then delta / loss else 0 end, 6) as share from d join loss using (region)
""")
def rep_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = binding.sales(spark, sf_dir)
    loss = localise.region_loss(sales, PRE_MONTHS, POST_MONTHS)
    found = localise.rep_shares(binding.rep_months(sales), PRE_MONTHS, POST_MONTHS, loss)
    return found.select("region", "rep_id", F.round("delta", 6).alias("delta"), F.round("share", 6).alias("share"))


@register("region_loss", f"""
with {SALES_SQL}, t as (select region, month, cast(sum(gross_revenue) as double) as v from sales where month in ('1998-05', '1998-06', '1998-07') group by all)
select region, round(avg(v) filter (month <> '1998-05') - avg(v) filter (month = '1998-05'), 6) as loss from t group by 1
""")
def region_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localise.region_loss(binding.sales(spark, sf_dir), PRE_MONTHS, POST_MONTHS).withColumn("loss", F.round("loss", 6))


@register("sql_changepoints", BOCPD_SQL + DETECT_TAIL + """
select 'rep_attributed_revenue' as kpi, region, cast(n as integer) as n_observations, cast(tau as integer) as tau, round(confidence, 6) as confidence, round((c - b) / b, 6) as impact_pct, round(c - b, 2) as impact_abs
from i join base using (region)
""")
def sql_changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changepoints of the monthly series, called from SQL by partition."""
    table_functions.register(spark)
    series = weekly_series(spark, sf_dir).where("period_unit = 'month'").select("kpi", "region", "period", "value")
    found = spark.sql("select * from changepoints(TABLE(select * from {series}) PARTITION BY (kpi, region) ORDER BY period)", series=series)
    return found.select("kpi", "region", "n_observations", "tau", F.round("confidence", 6).alias("confidence"), F.round("impact_pct", 6).alias("impact_pct"), F.round("impact_abs", 2).alias("impact_abs"))


@register("sql_bridge", f"""
with {SALES_SQL}, sums as (
  select region, cast(sum(case when week between 100 and 102 then gross_revenue else 0 end) as double) as r0, cast(sum(case when week between 104 and 106 then gross_revenue else 0 end) as double) as r1,
    cast(sum(case when week between 100 and 102 then units else 0 end) as double) as q0, cast(sum(case when week between 104 and 106 then units else 0 end) as double) as q1
  from sales where week between 100 and 102 or week between 104 and 106 group by region)
select region, r0 as revenue_pre, r1 as revenue_post, round((q1 - q0) * r0 / q0, 4) as volume_effect, round(q1 * (r1 / q1 - r0 / q0), 4) as price_effect from sums
""")
def sql_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price and volume bridge of each region, called from SQL over what weeks sum to."""
    table_functions.register(spark)
    cells = binding.sales(spark, sf_dir).groupBy("region", "week").agg(F.sum("units").alias("units"), F.sum("gross_revenue").alias("gross_revenue"))
    found = spark.sql(f"select * from price_volume(TABLE(select * from {{cells}}) PARTITION BY (region), {PRE[0]}, {PRE[1]}, {POST[0]}, {POST[1]})", cells=cells)
    return found.select("region", "revenue_pre", "revenue_post", F.round("volume_effect", 4).alias("volume_effect"), F.round("price_effect", 4).alias("price_effect"))
