"""Queries of whole flows: watched series to the gate, compiled tests by role, challenges, and what a role may see."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta import contract
from veridelta.functions.columns import power_law_between_ends
from veridelta.operators import challenge, investigations, ledger, localise, monitor, predicate, reconcile, signal, topics
from veridelta.sources import binding, files
from veridelta.sources.binding import MARKETING_SQL, SALES_SQL
from veridelta.sources.tables import materialize, table

from . import adjudication, reconciliation
from .common import fresh_folder
from .registry import ORACLE, register

WEEKLY = ["revenue", "units_sold", "marketing_attributed_revenue_share"]
#: A category that counts as new from a week on.
YOUNG = [("ASIA", "PROMO", 351)]


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series of the given tables: three weekly KPIs and the reps' monthly revenue of each region, and a new category with its siblings."""
    sales = binding.sales_cube(binding.sales(spark, sf_dir), ["region", "product_category", "week", "month"])
    spend = binding.marketing(spark, sf_dir).withColumnRenamed("day", "week")
    reps = binding.rep_totals(sales)
    panel = reconcile.weekly_panel(sales, spend, reps, binding.FIRST_MONDAY).where(F.col("week") < binding.WEEKS)
    return investigations.kpi_series(panel, reps, reconcile.category_weeks(sales).where(F.col("week") < binding.WEEKS), WEEKLY, YOUNG)


@register("kpi_series", f"""
with {SALES_SQL}, {MARKETING_SQL},
base as (select region, week, sum(gross_revenue) as revenue, cast(sum(units) as double) as units from sales where week < 357 group by all),
spend as (select day as week, region, sum(attributed_revenue) as attributed from marketing group by all),
panel as (select region, week, cast(revenue as double) as revenue, units, round_even(cast(attributed as double) / cast(revenue as double), 4) as share from base left join spend using (region, week)),
months as (select region, month, cast(sum(gross_revenue) as double) as v from sales group by all),
cats as (select region, product_category, week, cast(sum(gross_revenue) as double) as v from sales where week < 357 group by all)
select 'revenue' as kpi, region, 'week' as period_unit, week as period, revenue as value, null::bigint as n_siblings from panel
union all select 'units_sold', region, 'week', week, units, null from panel
union all select 'marketing_attributed_revenue_share', region, 'week', week, share, null from panel
union all select 'rep_attributed_revenue', region, 'month', cast(row_number() over (partition by region order by month) as integer), v, null from months
union all select 'new_category_revenue (PROMO)', region, 'week', week, v, (select count(*) from cats where region = 'ASIA' and product_category <> 'PROMO') from cats where region = 'ASIA' and product_category = 'PROMO' and week >= 351
""")
def kpi_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series that the signal layer watches, and how many siblings' weeks a new category's prior is drawn from."""
    return watched(spark, sf_dir).select("kpi", "region", "period_unit", "period", "value", F.when(F.col("baseline").isNotNull(), F.size("baseline")).cast("bigint").alias("n_siblings"))


@register("signal_all")
def signal_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changepoints, impact and gate of every watched series; the sparse one by its siblings' prior. Held against a plain fold in the tests."""
    return signal.gate(signal.detect(watched(spark, sf_dir)), contract.kpi_table(spark))


OPENED_SQL = "late as (select *, fulfillment_center as opened from sales where fulfillment_center <> 'DC_ASIA' or week > 97)"


@register("mature_units", f"""
with {SALES_SQL}, {OPENED_SQL}, firsts as (select opened, min(week) as f from late group by 1),
kept as (select late.* from late join firsts using (opened) where f <= 1 or week - f + 1 > 8)
select fulfillment_center as unit, week as period, cast(sum(gross_revenue) as double) as value from kept where region = 'EUROPE' and fulfillment_center in ('DC_ASIA', 'DC_EUROPE') and week between 96 and 109 group by all
""")
def mature_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compiled query over the shared view of mature sales: of a centre that opens in week 98 it sees nothing before the ninth week."""
    sales = binding.sales(spark, sf_dir).where("fulfillment_center <> 'DC_ASIA' or week > 97").withColumn("product_category", F.col("fulfillment_center"))
    files.register_views({"pos_transactions": sales}, min_weeks=8)
    checked = predicate.validate(adjudication.raw_predicate("h_new_centre", "fulfillment_center", ["DC_ASIA"]) | {"control": {"dim": "fulfillment_center", "in": ["DC_EUROPE"]}})
    compiled = predicate.compile_predicate(checked, "EUROPE", "analyst", adjudication.WINDOWS, adjudication.ROLES)
    treated, control = predicate.run_sides(spark, compiled, ordered=False)
    return treated.unionByName(control).withColumn("value", F.col("value").cast("double"))


DOSE_CLAIM = adjudication.raw_predicate("h_spend", "fulfillment_center", ["DC_ASIA"]) | {"test_archetype": "dose_response", "treatment": {"dim": "channel", "in": ["click", "error", "purchase"]}, "control": {"dim": "channel", "in": ["signup", "view"]}}


@register("dose_test", f"""
with {SALES_SQL}, {MARKETING_SQL},
d as (select region, channel, day, cast(sum(spend) as double) as v from marketing where day between 4 and 25 group by all), o as (select region, week, cast(sum(gross_revenue) as double) as v from sales where week between 4 and 25 group by all),
dc as (select region, channel, (avg(v) filter (day between 16 and 25) - avg(v) filter (day between 4 and 13)) / avg(v) filter (day between 4 and 13) as dose from d group by all),
oc as (select region, (avg(v) filter (week between 16 and 25) - avg(v) filter (week between 4 and 13)) / avg(v) filter (week between 4 and 13) as outcome from o group by 1),
st as (select * from dc join oc using (region) where dose is not null and outcome is not null),
k as (select rank() over (order by round(dose, 12)) + (count(*) over (partition by round(dose, 12)) - 1) / 2.0 as a, rank() over (order by round(outcome, 12)) + (count(*) over (partition by round(outcome, 12)) - 1) / 2.0 as b from st)
select count(*) as n, round(corr(a, b), 6) as rho, round(case when count(*) > 3 then tanh((1.959963984540054 + 0.8416212335729143) / sqrt(count(*) - 3.0)) end, 6) as mde_rho from k
""")
def dose_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dose-response claim by a role: compiled, run over the registered views, and correlated over regions by channels."""
    spend = binding.marketing(spark, sf_dir).select("region", "channel", F.col("day").alias("week"), F.col("spend").alias("spend_usd"))
    files.register_views({"marketing_spend": spend, "pos_transactions": binding.sales(spark, sf_dir)})
    regions = adjudication.ROLES["entitlements"]["analyst"]["regions"]
    found = investigations.dose_test(spark, DOSE_CLAIM, regions, "analyst", (4, 13), (16, 25), adjudication.ROLES)
    return found.select("n", F.round("rho", 6).alias("rho"), F.round("mde_rho", 6).alias("mde_rho"))


def other_side(prompt: str) -> tuple[str, int, int]:
    """A rule in the place of a model: it blames the first value of the dimension that the claim doesn't speak of."""
    claim = json.loads(prompt.split("\n")[0])["survivor"]
    dim = next(d for d in adjudication.VALUES if d != claim["treatment"]["dim"])
    return json.dumps(adjudication.raw_predicate("h_other_side", dim, adjudication.VALUES[dim][:1])), 100, 50


@register("challenged_claims")
def challenged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim with a rival on another dimension, tested in one family. The power gate is beyond SQL; tests hold it against planted panels."""
    adjudication.register_cube(spark, sf_dir)
    cases = [challenge.Case(predicate.validate(adjudication.raw_predicate(h, d, v)), region, "analyst", adjudication.WINDOWS) for h, region, d, v in adjudication.HYPOTHESES]
    book = ledger.Ledger(spark, fresh_folder(spark, "ledger"))
    told, _ = challenge.challenge(spark, book, other_side, cases, {"kpi": "revenue"}, adjudication.VALUES, "challenge", contract=adjudication.ROLES)
    return told


@register("role_view", f"""
with {SALES_SQL}, roles(role, regions, rep_detail) as (values {", ".join(f"('{r}', {v['regions']}, '{v['rep_detail']}')" for r, v in (contract.CONTRACT["entitlements"] | adjudication.ROLES["entitlements"] | {"europe_lead": {"regions": ["EUROPE"], "rep_detail": "allow"}}).items())})
select role, region, count(*) as n_rows, cast(sum(gross_revenue) as double) as revenue, count(distinct case when rep_detail = 'allow' then rep_id end) as reps from sales join roles on list_contains(regions, region) group by all
""")
def role_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each role sees of the sales: its regions' rows, and reps only with the grant. Roles of other regions see none."""
    roles = contract.role_table(spark, contract.CONTRACT).unionByName(contract.role_table(spark, adjudication.ROLES)).select("role", "regions", "rep_detail")
    roles = roles.unionByName(spark.createDataFrame([("europe_lead", ["EUROPE"], "allow")], "role string, regions array<string>, rep_detail string"))
    seen = investigations.visible(binding.sales(spark, sf_dir), roles)
    return seen.groupBy("role", "region").agg(F.count("*").alias("n_rows"), F.sum("gross_revenue").cast("double").alias("revenue"), F.countDistinct("rep_id").alias("reps"))


@register("pooled_arrays", """
select s_nationkey as nation, count(*) as n, sum(l_quantity) as total, max(l_quantity) as largest from lineitem join supplier on l_suppkey = s_suppkey group by 1
""")
def pooled_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's quantities as a JSON array, pooled again by nation."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation")), F.col("l_suppkey") == F.col("s_suppkey"))
    arrays = line.groupBy("nation", "l_orderkey").agg(F.to_json(F.collect_list("l_quantity")).alias("quantities"))  # an order's few lines
    return monitor.pooled(arrays, ["nation"], "quantities").groupBy("nation").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"))


@register("month_reindex", f"""
with {SALES_SQL}, m as (select region, month, cast(sum(gross_revenue) as double) as revenue from sales group by all), keys as (select distinct region from m), wanted(month) as (values ('1994-12'), ('1998-05'), ('1998-06'), ('2001-12'))
select region, month, revenue from keys cross join wanted left join m using (region, month)
""")
def month_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four months of every region; those that have no sales are null."""
    months = binding.sales(spark, sf_dir).groupBy("region", "month").agg(F.sum("gross_revenue").cast("double").alias("revenue"))
    return localise.reindexed(months, ["region"], "month", ["1994-12", "1998-05", "1998-06", "2001-12"])


@register("power_law_ends", """
with p as (select l_quantity as x, sum(cast(l_extendedprice as decimal(18,2)))::double as y from lineitem group by 1)
select round((ln(arg_max(y, x)) - ln(arg_min(y, x))) / (ln(max(x)) - ln(min(x))), 6) as exponent from p where x > 0 and y > 0
""")
def power_law_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exponent between the smallest and the largest quantity alone."""
    points = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("y"))
    return points.agg(F.round(power_law_between_ends(F.col("x"), F.col("y")), 6).alias("exponent"))


@register("panel_ordered", ORACLE["panel_weekly"])
def panel_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly panel in the order in which it is written."""
    return reconcile.ordered(reconciliation.panel_weekly(spark, sf_dir))


@register("cluster_candidates")
def cluster_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics as clusters of the documents' embeddings within a language, their first term by their texts, and whether each may have caused a movement in week 30.

    The given embeddings are all but orthogonal, so clusters are let be wider than the fixed distance.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    texts = docs.join(vectors, "doc_id")
    found = topics.cluster_texts(texts, "lang", "doc_id", "embedding", threshold=0.82).join(texts.select("doc_id", "text"), "doc_id")
    dated = materialize(found.withColumn("week", (F.floor(F.col("doc_id") % 364 / 7) + 1).cast("int")), "texts-by-cluster")  # read several times
    sizes = dated.groupBy("lang", "cluster").agg(F.count("*").alias("n_texts"))
    onsets = topics.onsets(topics.weekly_counts(dated, ["lang", "cluster"], 52), ["lang", "cluster"])
    term = topics.cluster_terms(dated, "cluster", "doc_id", "text", 1).select("cluster", "term")
    return topics.candidates(onsets.join(sizes, ["lang", "cluster"]), 30).join(term, "cluster", "left")
