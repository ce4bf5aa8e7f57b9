"""Queries of the ledger's smaller operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.functions.columns import power_law
from veridelta.operators import actions, investigations, ledger, monitor, topics
from veridelta.plans.monitoring import MOVEMENTS_SQL, movements
from veridelta.sources.generate import stable_accounts
from veridelta.sources.tables import table

from .registry import register


@register("json_pool", """
select event_type, count(*) as n, sum(cast(json_extract(props, '$.k') as bigint))::bigint as total, max(cast(json_extract(props, '$.k') as integer)) as largest from events group by 1
""")
def json_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers pooled from JSON text, by event type."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"))


@register("stable_attribute", "select s_suppkey, cast(('0x' || substr(sha256(s_name), 1, 2))::integer % 6 + 8 as integer) as assigned_accounts from supplier")
def stable_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up attribute that depends on a name alone."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", stable_accounts(F.col("s_name")).alias("assigned_accounts"))


@register("cache_latest", """
with r as (select user_id % 3 as cache, user_id as key, event_id as seq, ts, case when event_type in ('view', 'signup') then 'put' when event_type = 'error' and user_id % 50 = 0 then 'clear' else 'hit' end as kind, value from events),
c as (select cache, max(seq) as cut from r where kind = 'clear' group by 1),
l as (select r.* from r left join c using (cache) where kind <> 'clear' and (cut is null or seq > cut))
select cast(cache as varchar) as cache, cast(key as varchar) as cache_key, cast(max_by(seq, seq) filter (kind = 'put') as varchar) as result_json, count(*) filter (kind = 'hit') as hit_count, max(ts) filter (kind = 'hit') as last_hit_at
from l group by cache, key having count(*) filter (kind = 'put') > 0
""")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a cache's puts, hits and clears, and what it holds after them."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "put").when((F.col("event_type") == "error") & (F.col("user_id") % 50 == 0), "clear").otherwise("hit")
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).cast("string").alias("cache"), F.col("user_id").cast("string").alias("cache_key"), F.lit("m").alias("model"), F.col("event_id").cast("string").alias("result_json"), kind.alias("kind"), F.col("event_id").alias("seq"), F.col("ts").alias("created_at")
    )
    return ledger.cache_view(rows).drop("model").withColumn("last_hit_at", F.col("last_hit_at").cast("timestamp_ntz"))


@register("ledger_tail", "select o_orderkey as seq, o_custkey, o_orderstatus from orders order by o_orderkey desc limit 50")
def ledger_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty rows of a log: a top-k report."""
    return ledger.tail(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), "o_custkey", "o_orderstatus"), 50)


@register("movement_sets", f"""
with {MOVEMENTS_SQL}, a as (select kpi, region from mv where run_id = '1999-06'), b as (select kpi, region from mv where run_id = '1999-07')
select 'both' as side, kpi, region from (select * from a intersect select * from b) union all select 'only_before', kpi, region from (select * from a except select * from b) union all select 'only_after', kpi, region from (select * from b except select * from a)
""")
def movement_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moved in two months, in one of them, or in both."""
    rows = movements(spark, sf_dir)
    a, b = (rows.where(F.col("run_id") == r).select("kpi", "region") for r in ("1999-06", "1999-07"))
    return monitor.sides(a, b)


@register("primary_verdict", """
select o_orderpriority as region, min_by(o_orderkey, struct_pack(p := coalesce(case when o_orderstatus = 'P' then null else round(o_totalprice / 1e6, 9) end, 1.0), k := o_orderkey)) as o_orderkey from orders group by 1
""")
def primary_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row with the smallest p of each group; a missing p counts as 1."""
    p = F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 1e6, 9))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("region"), "o_orderkey", p.alias("p_bh"))
    return actions.primaries(rows, "region", name="o_orderkey")


@register("delivery_channels", """
select c_custkey, case when c_acctbal > 0 and c_mktsegment <> 'BUILDING' then 'slack_channel' else 'dashboard' end as channel,
 case when c_acctbal > 5000 and c_mktsegment <> 'BUILDING' then 'urgent_push' when c_acctbal > 0 and c_mktsegment <> 'BUILDING' then 'routine_push' else 'pull_only' end as urgency from customer
""")
def delivery_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as readers: one segment has no pushing channel, balances stand for actions and their confidence."""
    channels = F.when(F.col("c_mktsegment") != "BUILDING", F.array(F.lit("slack_channel"), F.lit("dashboard"))).otherwise(F.array(F.lit("dashboard")))
    confidence = F.when(F.col("c_acctbal") > 5000, "High").otherwise("Medium")
    channel, urgency = actions.delivery_channel(F.col("c_acctbal") > 0, confidence, channels)
    return table(spark, sf_dir, "customer").select("c_custkey", channel.alias("channel"), urgency.alias("urgency"))


@register("drift_report")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as runs, hourly means as a run's numbers; the verdict rules are held against small frames in the tests."""
    hours = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.hour("ts").alias("hour"), "event_type").agg(F.avg("value").alias("value"))
    of = lambda t: F.collect_list(F.when(F.col("event_type") == t, F.col("value")))  # noqa: E731  24 numbers at most
    runs = hours.groupBy("run_id").agg(of("view").alias("l1_posteriors"), of("click").alias("did_effects"), of("error").alias("did_mdes"))
    return monitor.assess_drift(runs, "2024-01-30")


@register("telemetry_recent", """
with r as (select event_id as seq, lower(lpad(hex(user_id), 8, '0')) || case when event_type = 'error' then '-x' else '' end as run_id, event_type as stage from events),
last as (select max_by(run_id, seq) as run from r where regexp_full_match(run_id, '[0-9a-f]{8}'))
select seq, run_id, stage, run_id = run as in_latest_run from (select * from r order by seq desc limit 200), last
""")
def telemetry_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two hundred rows of a log, a top-k report, and which belong to the latest pipeline run: users as runs, their errors as sessions."""
    run = F.concat(F.lower(F.lpad(F.hex("user_id"), 8, "0")), F.when(F.col("event_type") == "error", "-x").otherwise(""))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), run.alias("run_id"), F.col("event_type").alias("stage"))
    return ledger.recent_telemetry(rows)


@register("prefix_rows", "select c_custkey, c_name from customer where c_name like 'Customer#00000001%'")
def prefix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the beginning of a name; the condition reaches the scan."""
    return ledger.with_prefix(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "Customer#00000001")


@register("keyword_rows", """
select p_partkey, p_name from part where len(list_filter(string_split(p_name || ' ' || p_type, ' '), lambda t: contains(lower(t), '7') or contains(lower(t), 'promo'))) > 0
""")
def keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a word of their name or type that holds one of two keywords."""
    rows = table(spark, sf_dir, "part").withColumn("terms", F.split(F.concat_ws(" ", "p_name", "p_type"), " "))
    return topics.matching(rows, "terms", ["7", "PROMO"]).select("p_partkey", "p_name")


_REGISTRY_SQL = "reg as (select o_orderpriority as region, o_orderstatus as kpi, 'analyst' as role, cast(o_custkey as varchar) as hypothesis_id, cast(min(o_orderkey) as bigint) as preference from orders group by 1, 2, o_custkey)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities and states as investigations, their customers as claims, the earliest order first."""
    keys = [F.col("o_orderpriority").alias("region"), F.col("o_orderstatus").alias("kpi"), F.lit("analyst").alias("role"), F.col("o_custkey").cast("string").alias("hypothesis_id")]
    return table(spark, sf_dir, "orders").groupBy(*keys).agg(F.min("o_orderkey").alias("preference"))


@register("first_survivors", f"""
with {_REGISTRY_SQL}, v as (select cast(c_custkey as varchar) as hypothesis_id from customer where c_acctbal > 9000)
select region, kpi, min_by(hypothesis_id, preference) as hypothesis_id from reg join v using (hypothesis_id) group by 1, 2
""")
def first_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claim that survives and stands first in its investigation's order."""
    verdicts = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("hypothesis_id"), F.when(F.col("c_acctbal") > 9000, "SURVIVED").otherwise("KILLED").alias("verdict"))
    return investigations.first_survivors(verdicts, claims(spark, sf_dir))


@register("attached_series", f"""
with {_REGISTRY_SQL}, r as (select o_orderpriority as region, o_orderstatus as kpi, count(*) as n_observations from orders where o_orderpriority <> '1-URGENT' group by 1, 2 union all select 'nowhere', 'O', 0),
per as (select region, kpi, min(role) as role, count(*) as n_claims from reg group by 1, 2)
select region, kpi, n_observations, role, n_claims from r left join per using (region, kpi)
""")
def attached_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with their investigation's role and number of claims; one has none."""
    rows = table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'").groupBy(F.col("o_orderpriority").alias("region"), F.col("o_orderstatus").alias("kpi")).agg(F.count("*").alias("n_observations"))
    rows = rows.unionByName(spark.createDataFrame([("nowhere", "O", 0)], "region string, kpi string, n_observations long"))
    return investigations.attach(rows, claims(spark, sf_dir))


@register("power_law", """
with p as (select l_quantity as x, sum(l_extendedprice) as y from lineitem group by 1)
select round(regr_slope(ln(y), ln(x)), 6) as exponent, round(exp(regr_intercept(ln(y), ln(x))), 2) as scale, round(regr_r2(ln(y), ln(x)), 6) as r2 from p where x > 0 and y > 0
""")
def power_law_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the revenue of a quantity grows with the quantity."""
    points = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.sum("l_extendedprice").alias("y"))
    exponent, scale, r2 = power_law(F.col("x"), F.col("y"))
    return points.agg(F.round(exponent, 6).alias("exponent"), F.round(scale, 2).alias("scale"), F.round(r2, 6).alias("r2"))
