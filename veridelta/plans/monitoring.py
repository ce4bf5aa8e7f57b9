"""Queries of topics, monitoring, ledger, actions and graph over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta import contract
from veridelta.operators import actions, graph, ledger, monitor, reconcile, topics
from veridelta.sources import binding
from veridelta.sources.binding import FIRST_MONDAY, LEDGER_SQL, SALES_SQL
from veridelta.sources.tables import table

from .registry import register


def ticket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticket_id, region, week, created_at, topic): documents as tickets, their days spread over the calendar by id."""
    docs = table(spark, sf_dir, "documents")
    places = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    offset = (F.col("doc_id") % (7 * 52)).cast("int")
    rows = docs.select(F.col("doc_id").alias("ticket_id"), (F.col("doc_id") % 5).cast("int").alias("place"), F.date_add(F.lit(FIRST_MONDAY).cast("date"), offset).alias("created_at"), (F.floor(offset / 7) + 1).cast("int").alias("week"), F.col("lang").alias("topic"))
    return rows.join(places, F.col("place") == F.col("r_regionkey")).drop("place", "r_regionkey")


TICKETS_SQL = """
tickets as (select doc_id as ticket_id, r_name as region, date '1995-01-02' + cast(doc_id % 364 as integer) as created_at,
  cast(floor(cast(doc_id % 364 as integer) / 7.0) + 1 as integer) as week, lang as topic from documents join region on doc_id % 5 = r_regionkey)
"""


@register("spine_counts", f"""
with {TICKETS_SQL}, keys as (select distinct region, topic from tickets), spine as (select region, topic, cast(w as integer) as week from keys, range(1, 53) t(w)),
c as (select region, topic, week, count(*) as n from tickets group by all)
select region, topic, week, coalesce(n, 0) as n from spine left join c using (region, topic, week)
""")
def spine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of each topic and region in every week, 0 where there is none."""
    return topics.weekly_counts(ticket_rows(spark, sf_dir), ["region", "topic"], 52)


@register("topic_onsets", f"""
with recursive {TICKETS_SQL}, keys as (select distinct region, topic from tickets), c as (select region, topic, week, count(*) as n from tickets group by all),
s as (select keys.region || '/' || keys.topic as series, keys.region, keys.topic, w as t, coalesce(n, 0)::double as x from keys cross join range(1, 53) r(w) left join c on c.week = w and c.region = keys.region and c.topic = keys.topic),
p as (select series, avg(x) as mu0, greatest(var_pop(x), 1e-6) as beta0 from s group by series),
run as (
  select series, 0::bigint as t, [1.0::double] as w, [mu0] as mu, [beta0] as beta, 0.0::double as first from p
  union all
  select q.series, q.t + 1, list_transform(q.nw, lambda v: v / list_sum(q.nw)),
    list_concat([q.mu0], list_transform(range(1, len(q.mu) + 1), lambda i: (i * q.mu[i] + q.x) / (i + 1))),
    list_concat([q.beta0], list_transform(range(1, len(q.mu) + 1), lambda i: q.beta[i] + i * (q.x - q.mu[i]) ** 2 / (2 * (i + 1)))), q.nw[2] / list_sum(q.nw)
  from (
    select r.*, s.x, p.mu0, p.beta0, list_concat([list_sum(j.v) / 10.0], list_transform(j.v, lambda y: y * (1 - 1 / 10.0::double))) as nw
    from run r join s on s.series = r.series and s.t = r.t + 1 join p on p.series = r.series,
    lateral (select list_transform(range(1, len(r.w) + 1), lambda i: r.w[i] * exp(lgamma(2 + (i - 1) / 2.0 + 0.5) - lgamma(2 + (i - 1) / 2.0))
        / sqrt(2 * (2 + (i - 1) / 2.0) * pi() * (r.beta[i] * (i + 1) / ((2 + (i - 1) / 2.0) * i)))
        * pow(1 + pow(s.x - r.mu[i], 2) / (2 * (2 + (i - 1) / 2.0) * (r.beta[i] * (i + 1) / ((2 + (i - 1) / 2.0) * i))), -(2 + (i - 1) / 2.0 + 0.5))) as v) j) q),
best as (select series, arg_max(t, struct_pack(f := round(first, 12), t := -t)) as tau, max(first) as confidence from run where t >= 2 group by series),
sizes as (select region, topic, count(*) as n_texts from tickets group by all)
select region, topic, cast(tau as integer) as tau, round(confidence, 6) as confidence, n_texts, 30 as kpi_onset, tau <= 30 as precedes_kpi, confidence > 0.6 and tau > 1 and tau <= 30 as became_candidate,
  case when confidence > 0.6 and tau > 1 and tau <= 30 then 'its own change comes no later than the KPI''s' when not (confidence > 0.6 and tau > 1) then 'it has no sure change of its own' else 'it changed after the KPI did' end as reason
from best join (select distinct series, region, topic from s) using (series) join sizes using (region, topic) where n_texts >= 3
""")
def topic_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each topic bursts, and whether it may have caused a movement in week 30."""
    rows = ticket_rows(spark, sf_dir)
    found = topics.onsets(topics.weekly_counts(rows, ["region", "topic"], 52), ["region", "topic"])
    sizes = rows.groupBy("region", "topic").agg(F.count("*").alias("n_texts"))
    return topics.candidates(found.join(sizes, ["region", "topic"]), 30).withColumn("confidence", F.round("confidence", 6))


@register("representative_row", f"""
with {TICKETS_SQL}, m as (select region, topic, quantile_cont(date_diff('day', date '1970-01-01', created_at), 0.5) as mid from tickets group by all)
select region, topic, arg_min(ticket_id, struct_pack(d := abs(date_diff('day', date '1970-01-01', created_at) - mid), t := ticket_id)) as representative
from tickets join m using (region, topic) group by all
""")
def representative_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.representatives(ticket_rows(spark, sf_dir), ["region", "topic"], "created_at", "ticket_id")


@register("tfidf_terms", r"""
with w as (select doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') as w from documents),
t as (select doc_id, source, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from w),
c as (select doc_id, source, term, count(*) as n from t group by all), d as (select term, count(*) as df from c group by 1), total as (select count(*) as big from documents),
x as (select c.*, n * (ln((1 + big) / (1.0::double + df)) + 1) as weight from c join d using (term), total),
norms as (select doc_id, sqrt(sum(weight * weight)) as norm from x group by 1), sizes as (select source, count(*) as texts from documents group by 1),
m as (select source, term, round(sum(weight / norm) / any_value(texts), 9) as weight from x join norms using (doc_id) join sizes using (source) group by all),
r as (select *, row_number() over (partition by source order by weight desc, term) as rank from m)
select source, term, round(weight, 6) as weight, cast(rank as integer) as rank from r where rank <= 6
""")
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six heaviest words and word pairs of each source; the texts are invented, so no stop words are taken out."""
    found = topics.cluster_terms(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "doc_id", "text", stop_words=[])
    return found.withColumn("weight", F.round("weight", 6))


@register("ticket_clusters")
def ticket_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-linkage clusters of the embeddings of each label."""
    return topics.cluster_texts(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@register("psi", """
with s as (select event_type, ts >= timestamp '2024-01-16' as now, value as v from events where value is not null),
n as (select event_type, count(*) filter (not now) as a, count(*) filter (now) as b from s group by 1),
e as (select s.event_type, list_sort(list_distinct(quantile_cont(v, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) as edges from s where not now group by 1),
k as (select s.event_type, now, edges, least(len(list_filter(edges, lambda x: x <= v)) - 1, len(edges) - 2) as b from s join e using (event_type) where v between edges[1] and edges[-1]),
c as (select event_type, b, count(*) filter (not now) as p, count(*) filter (now) as q from k group by all),
f as (select event_type, p / sum(p) over (partition by event_type) + 1e-4 as p, q / greatest(sum(q) over (partition by event_type), 1) + 1e-4 as q from c),
t as (select event_type, sum((q - p) * ln(q / p)) as psi from f group by 1)
select event_type, a as n_baseline, b as n_current, round(psi, 6) as psi, case when psi < 0.1 then 'STABLE' when psi < 0.25 then 'MODERATE_SHIFT' else 'SIGNIFICANT_DRIFT' end as verdict from t join n using (event_type)
""")
def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of each event type's values between the two halves of the month."""
    events = table(spark, sf_dir, "events")
    pairs = events.select("event_type", (F.col("ts") >= F.lit("2024-01-16").cast("timestamp")).alias("is_current"), "value")
    found = monitor.psi_by_key(pairs, ["event_type"])
    return found.withColumn("verdict", monitor.psi_verdict_column(F.col("psi"))).withColumn("psi", F.round("psi", 6))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, predicted, outcome): a user's number as the stated probability of a purchase or a click."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("kind"), ((F.col("user_id") % 101) / 100).alias("predicted"), F.col("event_type").isin("purchase", "click").cast("int").alias("outcome"))


PREDICTIONS_SQL = "p as (select event_type as kind, (user_id % 101) / 100.0::double as predicted, cast(event_type in ('purchase', 'click') as integer) as outcome from events)"


@register("brier", f"with {PREDICTIONS_SQL} select count(*) as n, round(avg((predicted - outcome) ** 2), 6) as brier from p")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.brier(predictions(spark, sf_dir)).withColumn("brier", F.round("brier", 6))


@register("reliability", f"""
with {PREDICTIONS_SQL}, b as (select *, least(floor(predicted * 5), 4) as b from p)
select b / 5 as bucket_lo, (b + 1) / 5 as bucket_hi, count(*) as n, round(avg(predicted), 3) as mean_predicted, round(avg(outcome), 3) as observed, round(avg(outcome) - avg(predicted), 3) as gap from b group by b
""")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.reliability(predictions(spark, sf_dir))


@register("isotonic", f"""
with {PREDICTIONS_SQL}, g as (select predicted as x, sum(outcome) as s, count(*) as n from p group by 1), c as (select x, row_number() over (order by x) as i, sum(s) over (order by x) as s, sum(n) over (order by x) as n from g),
starts as (select 1 as a, 0 as s, 0 as n union all select i + 1, s, n from c),
pooled as (select m.i, a, min((b.s - starts.s)::double / (b.n - starts.n)::double) as least from c m join starts on starts.a <= m.i join c b on b.i >= m.i group by m.i, a),
fitted as (select x, y from c join (select i, max(least) as y from pooled group by i) using (i)), asked as (select k / 10.0::double as raw from range(0, 11) r(k)),
near as (
  select raw, max(x) filter (x <= raw) as x0, arg_max(y, x) filter (x <= raw) as y0, min(x) filter (x >= raw) as x1, arg_min(y, x) filter (x >= raw) as y1 from asked cross join fitted group by raw)
select round_even(raw, 2) as raw, round_even(case when x0 is null then y1 when x1 is null or x0 = x1 then y0 else y0 + (y1 - y0) * (raw - x0) / (x1 - x0) end, 3) as recalibrated from near
""")
def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recalibrated curve at tenths."""
    return monitor.isotonic(predictions(spark, sf_dir))


@register("hit_rates", f"with {PREDICTIONS_SQL} select kind, count(*) as n, avg(outcome) as hit_rate from p group by 1")
def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.hit_rates(predictions(spark, sf_dir))


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months as runs: a region whose ledger revenue moved by 8 % or more from the month before is a gated movement."""
    gl = binding.ledger_extract(spark, sf_dir)
    value = F.col("gl_revenue").cast("double")
    before = F.lag(value).over(Window.partitionBy("region").orderBy("month"))
    moved = gl.withColumn("business_impact_pct", F.round((value - before) / before, 9))
    seq = (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")).cast("long")
    kpi = F.when(F.col("region").isin("ASIA", "EUROPE"), "revenue").otherwise("rep_attributed_revenue")
    return moved.where(F.abs("business_impact_pct") >= 0.08).select(F.col("month").alias("run_id"), seq.alias("seq"), kpi.alias("kpi"), "region", F.lit(1).alias("week"), "business_impact_pct", F.lit(0.85).alias("confidence"))


MOVEMENTS_SQL = f"""
{LEDGER_SQL}, moved as (select month, region, cast(gl_revenue as double) as v, lag(cast(gl_revenue as double)) over (partition by region order by month) as b from gl),
mv as (select month as run_id, region, case when region in ('ASIA', 'EUROPE') then 'revenue' else 'rep_attributed_revenue' end as kpi, round((v - b) / b, 9) as impact from moved where abs(round((v - b) / b, 9)) >= 0.08)
"""
RUN = "1999-06"


def new_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = movements(spark, sf_dir)
    runs = binding.ledger_extract(spark, sf_dir).select(F.col("month").alias("run_id"), (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")).cast("long").alias("seq")).distinct()
    return monitor.new_movements(rows, RUN, runs)


@register("new_alerts", f"with {MOVEMENTS_SQL} select kpi, region, impact as business_impact_pct from mv where run_id = '{RUN}' and (kpi, region) not in (select (kpi, region) from mv where run_id = '1999-05')")
def new_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moved in one month and hadn't in the month before."""
    return new_now(spark, sf_dir).select("kpi", "region", "business_impact_pct")


@register("routing", f"""
with {MOVEMENTS_SQL}, now as (select kpi, region, impact from mv where run_id = '{RUN}' and (kpi, region) not in (select (kpi, region) from mv where run_id = '1999-05')),
roles(role, domains, channels) as (values {", ".join(f"('{r}', {v['domains']}, {v['channels']})" for r, v in contract.CONTRACT["entitlements"].items())}),
kpis(kpi, domain) as (values {", ".join(f"('{k}', '{v['domain']}')" for k, v in contract.CONTRACT["kpis"].items())})
select kpi, region, role, case when abs(impact) >= 0.05 then 'urgent_push' else 'routine_push' end as urgency,
 case when abs(impact) >= 0.05 and len(channels) > 1 then channels[1] else 'dashboard' end as channel from now join kpis using (kpi) join roles on list_contains(domains, domain)
""")
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts on what is new, for each role that may see its domain."""
    routed = monitor.route_alerts(new_now(spark, sf_dir), contract.kpi_table(spark), contract.role_table(spark))
    return routed.select("kpi", "region", "role", "urgency", "channel")


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as verdict rows: a customer is a hypothesis, its orders the re-tests, status the verdict, priority the evidence."""
    verdict = F.when(F.col("o_orderstatus") == "F", "SURVIVED").when(F.col("o_orderstatus") == "O", "KILLED").otherwise("INCONCLUSIVE")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("hypothesis_id"), verdict.alias("verdict"), F.col("o_orderpriority").alias("treatment_sql_hash"), F.lit("c").alias("control_sql_hash"), F.col("o_orderkey").alias("seq"))


LEDGER_ROWS_SQL = """
l as (select cast(o_custkey as varchar) as hypothesis_id, case o_orderstatus when 'F' then 'SURVIVED' when 'O' then 'KILLED' else 'INCONCLUSIVE' end as verdict, o_orderpriority as t, o_orderkey as seq from orders),
last as (select hypothesis_id, max_by(verdict, seq) as verdict, max_by(t, seq) as t from l group by 1)
"""


@register("latest_verdicts", f"with {LEDGER_ROWS_SQL} select hypothesis_id, verdict, t as treatment_sql_hash from last")
def latest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_verdicts(ledger_rows(spark, sf_dir)).select("hypothesis_id", "verdict", "treatment_sql_hash")


@register("contradictions", f"with {LEDGER_ROWS_SQL} select count(*) as n_survivors, count(distinct t) as n_evidence, case when count(distinct t) = 1 then 'SAME_EVIDENCE_RETEST' else 'INDEPENDENT_CONTRADICTION' end as kind from last where verdict = 'SURVIVED' having count(*) >= 2")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.contradictions(ledger_rows(spark, sf_dir)).select("n_survivors", "n_evidence", "kind")


@register("telemetry_summary", """
select case when regexp_matches(md5(cast(user_id as varchar))[1:8], '^[0-9a-f]{8}$') and user_id % 3 > 0 then 'pipeline' else 'session' end as kind, count(*) as n_stages, count(*) filter (event_type = 'click') as n_llm_calls, count(*) filter (event_type <> 'click') as n_deterministic,
 cast(sum(case when event_type = 'click' then event_id % 700 else 0 end) as bigint) as tokens_in, cast(sum(case when event_type = 'click' then event_id % 300 else 0 end) as bigint) as tokens_out from events group by 1
""")
def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry: clicks as model calls, a hash of the user as the run."""
    run = F.when(F.col("user_id") % 3 > 0, F.substring(F.md5(F.col("user_id").cast("string")), 1, 8)).otherwise(F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").select(run.alias("run_id"), (F.col("event_type") == "click").alias("is_llm_call"), (F.col("event_id") % 700).alias("tokens_in"), (F.col("event_id") % 300).alias("tokens_out"), F.lit(0.0).alias("estimated_cost_usd"), "value")
    found = ledger.telemetry_summary(rows.withColumn("latency_ms", F.col("value")).withColumn("kind", ledger.session_kind("run_id")), ["kind"])
    return found.select("kind", "n_stages", "n_llm_calls", "n_deterministic", "tokens_in", "tokens_out")


@register("capacity", """
with reps as (select r_name as region, s_suppkey, cast(s_suppkey % 20 + 3 as bigint) as accounts, s_acctbal < 0 as gone from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
s as (select region, count(*) filter (gone) as n_departed, coalesce(sum(accounts) filter (gone), 0) as need, coalesce(sum(greatest(0, 20 - accounts)) filter (not gone), 0) as head from reps group by 1)
select region, n_departed, cast(need as bigint) as accounts_needed, cast(head as bigint) as headroom, need <= head as fits, cast(greatest(0, need - head) as bigint) as shortfall from s
""")
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as reps: those in debt have left, and their accounts need room."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    reps = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = reps.select("region", F.lit("2001-07").alias("month"), F.when(F.col("s_acctbal") < 0, F.lit("2001-07-01").cast("date")).alias("attrition_date"), (F.col("s_suppkey") % 20 + 3).alias("assigned_accounts"))
    return actions.rep_capacity(rows).drop("month")


@register("fulfillment_capacity", """
with m as (select o_orderpriority as center, strftime(o_orderdate, '%Y-%m') as month, count(*) filter (o_orderstatus = 'O') as backlog, count(*) filter (o_orderstatus = 'P') as incoming, count(*) filter (o_orderstatus = 'F') as cap from orders group by all),
l as (select center, max_by(struct_pack(month := month, b := backlog, i := incoming, c := cap), month) as o from m group by 1), f as (select center, o.month, o.b, o.i, o.c from l)
select center as fulfillment_center, month, round(case when c - i > 0 then b / (c - i)::double end, 6) as days_to_clear, round(case when c * 1.2 - i > 0 then b / (c * 1.2 - i)::double end, 6) as days_with_overtime,
 coalesce(case when c * 1.2 - i > 0 then b / (c * 1.2 - i)::double end <= 14, false) as fits from f
""")
def fulfillment_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as centres: open orders as the backlog, filled ones as the capacity."""
    count = lambda s, n: F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(n)
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    ops = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("fulfillment_center"), month).agg(count("O", "orders_backlog"), count("P", "daily_incoming_orders"), count("F", "daily_processing_capacity_orders"))
    found = actions.center_capacity(ops)
    return found.select("fulfillment_center", "month", F.round("days_to_clear", 6).alias("days_to_clear"), F.round("days_with_overtime", 6).alias("days_with_overtime"), "fits")


@register("counterfactual", f"""
with {SALES_SQL}, s as (select region, week, cast(sum(gross_revenue) as double) as x from sales where week < 357 group by all),
b as (select region, max(week) as last, avg(x) filter (week between 340 and 345) as pre, avg(x) filter (week between 350 and 356) as level, stddev_samp(x) filter (week between 340 and 345) as sd from s group by 1),
w as (select region, cast(last + i as integer) as week, sd, level, level + i / 4.0::double * (pre - level) as rec from b, range(1, 5) t(i))
select region, week, 'no_action' as scenario, round(level, 3) as value, round(level - 1.645 * sd, 3) as ci_low, round(level + 1.645 * sd, 3) as ci_high from w
union all select region, week, 'recovery', round(rec, 3), round(rec - 1.645 * sd, 3), round(rec + 1.645 * sd, 3) from w
""")
def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = reconcile.region_weeks(binding.sales(spark, sf_dir)).where(F.col("week") < binding.WEEKS).withColumn("revenue", F.col("revenue").cast("double"))
    found = actions.counterfactual(weeks, (340, 345), (350, 356))
    return found.select("region", "week", "scenario", *[F.round(c, 3).alias(c) for c in ("value", "ci_low", "ci_high")])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers to nations to regions, as a graph."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(name("nation:", "n_nationkey").alias("source"), name("region:", "n_regionkey").alias("target"), F.lit("IN_REGION").alias("relation"))
    c = table(spark, sf_dir, "customer").select(name("customer:", "c_custkey").alias("source"), name("nation:", "c_nationkey").alias("target"), F.lit("LIVES_IN").alias("relation"))
    s = table(spark, sf_dir, "supplier").select(name("supplier:", "s_suppkey").alias("source"), name("nation:", "s_nationkey").alias("target"), F.lit("BASED_IN").alias("relation"))
    return n.unionByName(c).unionByName(s)


EDGES_SQL = """
e as (select 'nation:' || n_nationkey as source, 'region:' || n_regionkey as target, 'IN_REGION' as relation from nation
 union all select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LIVES_IN' from customer union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BASED_IN' from supplier),
both_ways as (select source as node, target as neighbour, relation, 'out' as direction from e union all select target, source, relation, 'in' from e)
"""


@register("graph_related", f"with {EDGES_SQL} select node, neighbour, relation, direction from both_ways where node = 'nation:7'")
def graph_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(edges(spark, sf_dir), "nation:7")


@register("graph_blast_radius", f"""
with recursive {EDGES_SQL}, walk(node, hops) as (select 'supplier:1', 0 union select b.neighbour, w.hops + 1 from walk w join both_ways b on b.node = w.node where w.hops < 3)
select node, cast(min(hops) as integer) as hops from walk group by node having min(hops) > 0
""")
def graph_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within three steps of a supplier."""
    return graph.blast_radius(edges(spark, sf_dir), "supplier:1", 3)


@register("graph_shared", """
with h as (select cast(p_partkey as varchar) as hypothesis_id, p_brand as dim, p_type as arch from part), o as (select dim, arch from h where hypothesis_id = '1')
select h.hypothesis_id, h.dim = o.dim as same_dim, h.arch = o.arch as same_archetype from h, o where h.hypothesis_id <> '1' and (h.dim = o.dim or h.arch = o.arch)
""")
def graph_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as hypotheses: those that share the first one's brand or type."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("hypothesis_id"), F.col("p_brand").alias("dim"), F.col("p_type").alias("test_archetype"))
    return graph.shared_mechanism(rows, "1")


@register("graph_dangling", f"""
with {EDGES_SQL}, n as (select 'nation:' || n_nationkey as id from nation where n_nationkey % 2 = 0 union all select 'region:' || r_regionkey from region union all select 'customer:' || c_custkey from customer)
select relation, count(*) as n_edges from (select distinct source, target, relation from e where source in (select id from n) and target in (select id from n)) group by 1
""")
def graph_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that are left when every other nation and all suppliers are no nodes."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("id")
    nodes = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(name("nation:", "n_nationkey")).unionByName(table(spark, sf_dir, "region").select(name("region:", "r_regionkey"))).unionByName(table(spark, sf_dir, "customer").select(name("customer:", "c_custkey")))
    return graph.without_dangling(nodes, edges(spark, sf_dir)).groupBy("relation").agg(F.count("*").alias("n_edges"))
