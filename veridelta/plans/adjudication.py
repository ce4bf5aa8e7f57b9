"""Queries of predicates, entitlements and adjudication over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta import contract
from veridelta.operators import adjudicate, predicate
from veridelta.sources import binding
from veridelta.sources.binding import MARKETING_SQL, SALES_SQL
from veridelta.sources.tables import materialize, table

from .registry import register

PRE, POST = (96, 101), (104, 109)
WINDOWS = {"week": (PRE, POST)}

#: (hypothesis, region, dimension, treatment values); all other values of the dimension are the control.
HYPOTHESES = [
    ("h_asia_dc", "EUROPE", "fulfillment_center", ["DC_ASIA"]),
    ("h_west_dcs", "AMERICA", "fulfillment_center", ["DC_AMERICA", "DC_EUROPE"]),
    ("h_promo", "ASIA", "product_category", ["PROMO"]),
    ("h_sizes", "AFRICA", "product_category", ["SMALL", "LARGE"]),
]
VALUES = {
    "fulfillment_center": ["DC_AFRICA", "DC_AMERICA", "DC_ASIA", "DC_EUROPE", "DC_MIDDLE EAST"],
    "product_category": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
}
#: A role of this binding's own, scoped to its regions.
ROLES = contract.CONTRACT | {"entitlements": {"analyst": {"regions": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "rep_detail": "deny", "domains": ["sales"], "persona": "engineer", "channels": ["dashboard"]}}}


def raw_predicate(name: str, dim: str, treated: list[str]) -> dict:
    return {
        "hypothesis_id": name, "mechanism": f"{', '.join(treated)} lost sales", "test_archetype": "placebo",
        "treatment": {"dim": dim, "in": treated}, "control": {"dim": dim, "in": [v for v in VALUES[dim] if v not in treated]},
        "outcome": {"metric": "revenue", "expect": "decline"}, "temporal": {"cause_onset": "1997-01-01", "kpi_onset": "1997-01-08"},
        "refutes_if": {"condition": "treatment falls no more than control", "rationale": "a shared decline has another cause"},
    }


def register_cube(spark: SparkSession, sf_dir: str) -> None:
    """The view that predicates read: sales summed once by everything that a predicate may ask for, so that no test scans the facts again."""
    keys = ["region", "product_category", "fulfillment_center", "week"]
    cube = binding.sales(spark, sf_dir).groupBy(*keys).agg(F.sum("gross_revenue").alias("gross_revenue"))
    materialize(cube, "sales-cube").createOrReplaceTempView("pos_transactions")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panels of all hypotheses, each compiled from its predicate and run over the registered view; a few rows each."""
    register_cube(spark, sf_dir)
    out = None
    for name, region, dim, treated in HYPOTHESES:
        checked = predicate.validate(raw_predicate(name, dim, treated))
        one = predicate.unit_panel(spark, predicate.compile_predicate(checked, region, "analyst", WINDOWS, ROLES))
        out = one if out is None else out.unionByName(one)
    return materialize(out.coalesce(8), "panel")


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


PANEL_SQL = f"{SALES_SQL}, panel as (" + " union all ".join(
    f"select '{h}' as hypothesis_id, {d} as unit, week as period, cast(sum(gross_revenue) as double) as value, case when {d} in ({_in(t)}) then 1 else 0 end as treat, "
    f"case when week between 104 and 109 then 1 else 0 end as post from sales where region = '{r}' and (week between 96 and 101 or week between 104 and 109) group by all"
    for h, r, d, t in HYPOTHESES
) + ")"

DID_SQL = f"""
{PANEL_SQL},
r0 as (select *, ln(greatest(value, 1)) as y, post::double as a, (treat * post)::double as b from panel),
r as (select hypothesis_id, unit, treat, y - avg(y) over u as y, a - avg(a) over u as x1, b - avg(b) over u as x2 from r0 window u as (partition by hypothesis_id, unit, treat)),
s as (select hypothesis_id, sum(x1*x1) as a11, sum(x1*x2) as a12, sum(x2*x2) as a22, sum(x1*y) as b1, sum(x2*y) as b2, count(*) as n,
  count(distinct unit) filter (treat = 1) as nt, count(distinct unit) filter (treat = 0) as nc from r group by 1),
k0 as (select *, case when a11*a22 - a12*a12 > 1e-9 then a11*a22 - a12*a12 end as det from s),
k as (select *, (a22*b1 - a12*b2) / det as k1, (a11*b2 - a12*b1) / det as k2 from k0),
e as (select r.*, k1, k2, y - k1*x1 - k2*x2 as e from r join k using (hypothesis_id)),
m as (select hypothesis_id, sum(x1*x1*e*e) as h11, sum(x1*x2*e*e) as h12, sum(x2*x2*e*e) as h22 from e group by 1),
d0 as (select hypothesis_id, nt, nc, k2, case when n > nt + nc + 2 and nt + nc >= 2 then sqrt(greatest(0, n / (n - (nt + nc + 2.0)) * (a12*a12*h11 - 2*a11*a12*h12 + a11*a11*h22))) / det end as se from k join m using (hypothesis_id)),
d as (select hypothesis_id, nt, nc, case when se is not null then k2 end as effect, se from d0),
dz as (select *, case when se > 0 then effect / se end as z from d),
dp as (select *, case when z is null then null when abs(z) > 12 then 0 else greatest(0, 1 - 2 * exp(-z*z/2) / sqrt(2*pi()) *
  list_sum(list_transform(range(0, 200), lambda i: exp((2*i+1) * ln(greatest(abs(z), 1e-300)) - (lgamma(i + 1.5) + (i + 1) * ln(2.0) - 0.5 * ln(pi())))))) end as p from dz)
"""


@register("compiled_unit_query", f"with {SALES_SQL} select fulfillment_center as unit, week as period, cast(sum(gross_revenue) as double) as value from sales where region = 'EUROPE' and fulfillment_center in ('DC_ASIA') and week between 96 and 109 group by all")
def compiled_unit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_cube(spark, sf_dir)
    sql, params = predicate.compile_units("fulfillment_center", "EUROPE", ["DC_ASIA"], 96, 109)
    return spark.sql(sql, args=params).withColumn("value", F.col("value").cast("double"))


@register("compiled_total_query", f"with {SALES_SQL} select week as period, cast(sum(gross_revenue) as double) as value from sales where region = 'ASIA' and product_category in ('PROMO', 'SMALL') and week between 96 and 109 group by all")
def compiled_total_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_cube(spark, sf_dir)
    sql, params = predicate.compile_totals("product_category", "ASIA", ["PROMO", "SMALL"], 96, 109)
    return spark.sql(sql, args=params).withColumn("value", F.col("value").cast("double"))


@register("unit_panel", f"with {PANEL_SQL} select hypothesis_id, unit, period, value, treat, post from panel")
def unit_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir)


@register("did_hc1", f"with {DID_SQL} select hypothesis_id, nt as n_treatment_units, nc as n_control_units, round(effect, 6) as effect, round(se, 6) as se, round(z, 5) as z, round(p, 6) as p from dp")
def did_hc1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjudicate.did(panel(spark, sf_dir))
    return found.select("hypothesis_id", "n_treatment_units", "n_control_units", F.round("effect", 6).alias("effect"), F.round("se", 6).alias("se"), F.round("z", 5).alias("z"), F.round("p", 6).alias("p"))


REP_PANEL_SQL = f"""{SALES_SQL}, panel as (select 'reps_' || region as hypothesis_id, cast(rep_id as varchar) as unit, month as period, cast(sum(gross_revenue) as double) as value,
 case when rep_id % 10 < 4 then 1 else 0 end as treat, case when month >= '1998-07' then 1 else 0 end as post from sales where month between '1998-01' and '1998-12' group by region, rep_id, month)"""


def rep_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reps by month in every region: enough units on both sides for clustered errors."""
    sales = binding.sales(spark, sf_dir).where(F.col("month").between("1998-01", "1998-12"))
    value = F.sum("gross_revenue").cast("double").alias("value")
    rows = sales.groupBy("region", "rep_id", F.col("month").alias("period")).agg(value)
    rows = materialize(rows, "rep-panel")
    return rows.select(F.concat(F.lit("reps_"), "region").alias("hypothesis_id"), F.col("rep_id").cast("string").alias("unit"), "period", "value", F.when(F.col("rep_id") % 10 < 4, 1).otherwise(0).alias("treat"), F.when(F.col("period") >= "1998-07", 1).otherwise(0).alias("post"))


@register("did_cluster", f"""
with {REP_PANEL_SQL},
r0 as (select *, ln(greatest(value, 1)) as y, post::double as a, (treat * post)::double as b from panel),
r as (select hypothesis_id, unit, treat, y - avg(y) over u as y, a - avg(a) over u as x1, b - avg(b) over u as x2 from r0 window u as (partition by hypothesis_id, unit, treat)),
s as (select hypothesis_id, sum(x1*x1) as a11, sum(x1*x2) as a12, sum(x2*x2) as a22, sum(x1*y) as b1, sum(x2*y) as b2, count(*) as n, count(distinct unit) as g from r group by 1),
k as (select *, a11*a22 - a12*a12 as det, (a22*b1 - a12*b2)/(a11*a22 - a12*a12) as k1, (a11*b2 - a12*b1)/(a11*a22 - a12*a12) as k2 from s),
gs as (select hypothesis_id, unit, sum(x1*(y - k1*x1 - k2*x2)) as g1, sum(x2*(y - k1*x1 - k2*x2)) as g2 from r join k using (hypothesis_id) group by all),
m as (select hypothesis_id, sum(g1*g1) as c11, sum(g1*g2) as c12, sum(g2*g2) as c22 from gs group by 1)
select hypothesis_id, g as n_units, round(k2, 6) as effect, round(sqrt(g/(g-1.0)*(n-1.0)/(n-(g+2.0)) * (a12*a12*c11 - 2*a11*a12*c12 + a11*a11*c22)) / det, 6) as se from k join m using (hypothesis_id)
""")
def did_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjudicate.did(rep_panel(spark, sf_dir))
    return found.where("clustered").select("hypothesis_id", (F.col("n_treatment_units") + F.col("n_control_units")).alias("n_units"), F.round("effect", 6).alias("effect"), F.round("se", 6).alias("se"))


@register("pretrend", f"""
with {PANEL_SQL},
t as (select hypothesis_id, treat, ln(greatest(value, 1)) as y, (dense_rank() over (partition by hypothesis_id order by period) - 1)::double as t from panel where post = 0),
c as (select hypothesis_id, treat, y - avg(y) over w as y, t - avg(t) over w as t from t window w as (partition by hypothesis_id, treat)),
s as (select hypothesis_id, treat, sum(t*t) as sxx, sum(t*y)/sum(t*t) as slope, count(*) as m from c group by all),
v as (select c.hypothesis_id, c.treat, any_value(slope) as slope, any_value(m) as m, sum((y - slope*t)**2 * t*t) / any_value(sxx)**2 as v from c join s on c.hypothesis_id = s.hypothesis_id and c.treat = s.treat group by all),
b as (select hypothesis_id, sum(case when treat = 1 then slope else -slope end) as gap, sum(v) as v, sum(m) as n from v group by 1)
select hypothesis_id, round(gap, 6) as slope_gap, round(gap / sqrt(v * n / (n - 4.0)), 5) as pretrend_z from b
""")
def pretrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjudicate.parallel_trends(panel(spark, sf_dir))
    return found.select("hypothesis_id", F.round("slope_gap", 6).alias("slope_gap"), F.round("pretrend_z", 5).alias("pretrend_z"))


@register("bh_fdr", f"""
with {DID_SQL}, ranked as (select hypothesis_id, p, count(p) over () as m, row_number() over (partition by p is null order by p, hypothesis_id) as r from dp)
select hypothesis_id, case when p is not null then round(least(1, min(p * m / r) over (partition by p is null order by r desc)), 6) end as p_bh from ranked
""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjudicate.did(panel(spark, sf_dir)).withColumn("family", F.lit(1))
    return adjudicate.benjamini_hochberg(found, ["family"]).select("hypothesis_id", F.round("p_bh", 6).alias("p_bh"))


@register("verdicts")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hypothesis of the family; the power gate is beyond SQL, so tests hold it against planted panels."""
    return adjudicate.verdicts(panel(spark, sf_dir))


@register("power_inputs", f"""
with {PANEL_SQL}, r as (select *, ln(greatest(value, 1)) - avg(ln(greatest(value, 1))) over (partition by hypothesis_id, treat, unit) as d from panel)
select hypothesis_id, round(stddev_samp(d) filter (treat = 1), 6) as treated_sd, count(*) filter (treat = 1) as n_treated, count(*) filter (treat = 0) as n_controls from r group by 1
""")
def power_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjudicate.power_gate(panel(spark, sf_dir))
    return found.select("hypothesis_id", F.round("treated_sd", 6).alias("treated_sd"), "n_treated", "n_controls")


STRATA_SQL = f"""
{MARKETING_SQL}, d as (select region, channel, day, cast(sum(spend) as double) as v from marketing group by all),
o as (select region, day, cast(sum(attributed_revenue) as double) as v from marketing group by all),
dc as (select region, channel, (avg(v) filter (day between 16 and 25) - avg(v) filter (day between 4 and 13)) / avg(v) filter (day between 4 and 13) as dose from d group by all),
oc as (select region, (avg(v) filter (day between 16 and 25) - avg(v) filter (day between 4 and 13)) / avg(v) filter (day between 4 and 13) as outcome from o group by 1),
st as (select region, channel, dose, outcome from dc join oc using (region) where dose is not null and outcome is not null)
"""


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = binding.marketing(spark, sf_dir)
    return adjudicate.dose_strata(events.select("region", "channel", F.col("day").alias("period"), F.col("spend").alias("value")), events.select("region", F.col("day").alias("period"), F.col("attributed_revenue").alias("value")), (4, 13), (16, 25))


@register("dose_strata", f"with {STRATA_SQL} select region, channel, round(dose, 6) as dose_change, round(outcome, 6) as outcome_change from st")
def dose_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strata(spark, sf_dir).select("region", "channel", F.round("dose_change", 6).alias("dose_change"), F.round("outcome_change", 6).alias("outcome_change"))


@register("spearman", f"""
with {STRATA_SQL}, k as (select rank() over (order by round(dose, 12)) + (count(*) over (partition by round(dose, 12)) - 1) / 2.0 as a, rank() over (order by round(outcome, 12)) + (count(*) over (partition by round(outcome, 12)) - 1) / 2.0 as b from st)
select count(*) as n, round(corr(a, b), 6) as rho, round(case when count(*) > 3 then tanh((1.959963984540054 + 0.8416212335729143) / sqrt(count(*) - 3.0)) end, 6) as mde_rho from k
""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = strata(spark, sf_dir).withColumn("dose_change", F.round("dose_change", 12)).withColumn("outcome_change", F.round("outcome_change", 12))
    return adjudicate.dose_response(rounded).select("n", F.round("rho", 6).alias("rho"), F.round("mde_rho", 6).alias("mde_rho"))


#: Two-sided p of Student's t by its finite series in the angle's sine and cosine, for odd and for even degrees of freedom.
T_SQL = """
case when v % 2 = 1 then 1 - abs(2 / pi() * (angle + sin(angle) * coalesce(list_sum(list_transform(range(0, (v - 1) // 2), lambda k:
  exp(coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln(2 * j / (2 * j + 1.0)))), 0)) * pow(cos(angle), 2 * k + 1))), 0)))
else 1 - abs(sin(angle) * list_sum(list_transform(range(0, v // 2), lambda k: exp(coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln((2 * j - 1) / (2.0 * j)))), 0)) * pow(cos(angle), 2 * k)))) end
"""


@register("dose_response", f"""
with {STRATA_SQL}, k as (select rank() over (order by round(dose, 12)) + (count(*) over (partition by round(dose, 12)) - 1) / 2.0 as a, rank() over (order by round(outcome, 12)) + (count(*) over (partition by round(outcome, 12)) - 1) / 2.0 as b from st),
r as (select count(*) as n, corr(a, b) as rho, count(*) - 2 as v from k), t as (select *, atan(rho * sqrt(v / (1 - rho * rho)) / sqrt(v)) as angle, case when n > 3 then tanh((1.959963984540054 + 0.8416212335729143) / sqrt(n - 3.0)) end as reach from r),
q as (select *, {T_SQL} as p from t)
select n, round(rho, 6) as rho, round(p, 6) as p, round(reach, 6) as mde_rho, case when n < 6 then 'INCONCLUSIVE' when rho > 0 and p < 0.05 then 'SURVIVED' when reach > 0.5 then 'INCONCLUSIVE' else 'KILLED' end as verdict from q
""")
def dose_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation of dose and outcome over strata, its p and the verdict."""
    rounded = strata(spark, sf_dir).withColumn("dose_change", F.round("dose_change", 12)).withColumn("outcome_change", F.round("outcome_change", 12))
    found = adjudicate.dose_response(rounded)
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("rho", "p", "mde_rho")], "verdict")


@register("precedence", """
with w as (select source, lang, count(*) as n, min(doc_id % 357) + 1 as onset from documents group by all)
select source, lang, onset as topic_tau, round(least(0.95, n / 40.0), 6) as topic_confidence,
 case when least(0.95, n / 40.0) <= 0.6 then 'INCONCLUSIVE' when onset <= 5 then 'SURVIVED' else 'KILLED' end as verdict from w
""")
def precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets of document groups against a movement in week 5."""
    docs = table(spark, sf_dir, "documents")
    groups = docs.groupBy("source", "lang").agg(F.count("*").alias("n"), (F.min(F.col("doc_id") % binding.WEEKS) + 1).alias("topic_tau"))
    onsets = groups.select("source", "lang", "topic_tau", F.least(F.lit(0.95), F.col("n") / 40).alias("topic_confidence"), F.lit(5).alias("kpi_tau"), F.lit(0.9).alias("kpi_confidence"))
    found = adjudicate.precedence(onsets)
    return found.select("source", "lang", "topic_tau", F.round("topic_confidence", 6).alias("topic_confidence"), "verdict")


@register("entitlement_grid", f"""
with roles(role, regions, rep) as (values {", ".join(f"('{r}', {v['regions']}, '{v['rep_detail']}')" for r, v in contract.CONTRACT["entitlements"].items())}),
 regions as (select r_name as region from region union all select unnest(['West', 'East', 'Central'])), dims(dim, grantless) as (values ('fulfillment_center', true), ('product_category', true), ('rep_id', false), ('channel', true))
select role, region, dim, list_contains(regions, region) and (grantless or rep = 'allow') as allowed from roles, regions, dims
""")
def entitlement_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every role, region and dimension: the checks that run before a plan, as one table; the given regions are in no role's scope."""
    places = table(spark, sf_dir, "region").select(F.col("r_name").alias("region")).unionByName(spark.createDataFrame([("West",), ("East",), ("Central",)], "region string"))
    regions = sorted(r["region"] for r in places.collect())  # eight names
    grid = [(role, region, dim, contract.allowed(contract.check_entitlement, role, region, dim)[0]) for role in contract.CONTRACT["entitlements"] for region in regions for dim in contract.DIMENSIONS]
    return spark.createDataFrame(grid, "role string, region string, dim string, allowed boolean")


@register("domain_grid", f"""
with roles(role, domains) as (values {", ".join(f"('{r}', {v['domains']})" for r, v in contract.CONTRACT["entitlements"].items())}),
 kpis(kpi, domain) as (values {", ".join(f"('{k}', '{v['domain']}')" for k, v in contract.CONTRACT["kpis"].items())}), n as (select count(*) as n_rows from lineitem)
select role, kpi, list_contains(domains, domain) as allowed, case when list_contains(domains, domain) then n_rows end as visible_rows from roles, kpis, n
""")
def domain_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which KPI domains a role may query, and how many fact rows that opens to it."""
    rows = [(role, kpi, contract.allowed(contract.check_domain, role, kpi)[0]) for role in contract.CONTRACT["entitlements"] for kpi in contract.CONTRACT["kpis"]]
    grid = spark.createDataFrame(rows, "role string, kpi string, allowed boolean").join(table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_rows")), F.lit(True))
    return grid.select("role", "kpi", "allowed", F.when(F.col("allowed"), F.col("n_rows")).alias("visible_rows"))
