"""The lineage graph of contract and verdicts, as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.contract import CONTRACT, DIMENSIONS
from veridelta.sources.tables import materialize

NODE, EDGE = "id string, type string, label string", "source string, target string, relation string"


def contract_graph(spark: SparkSession, verdicts: DataFrame | None = None, links: dict[str, dict] | None = None, contract: dict = CONTRACT) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sources, domains, KPIs, dimensions, verdicts, roles, channels and tested hypotheses.

    ``links`` names a KPI's sources, reconciled_against and drivers. Edges to nodes that don't exist are dropped.
    """
    nodes = [(f"source:{s}", "source", s) for s in contract["sources"]] + [(f"domain:{d}", "domain", d) for d in ("sales", "marketing", "hr")]
    nodes += [(f"kpi:{k}", "kpi", k) for k in contract["kpis"]] + [(f"dim:{d}", "dimension", d) for d in DIMENSIONS]
    nodes += [(f"verdict:{v}", "verdict", v) for v in ("KILLED", "SURVIVED", "INCONCLUSIVE")] + [(f"role:{r}", "role", r) for r in contract["entitlements"]]
    edges = [(f"kpi:{k}", f"domain:{v['domain']}", "BELONGS_TO_DOMAIN") for k, v in contract["kpis"].items()]
    edges += [(f"dim:{d}", f"source:{v.view}", "BACKED_BY_TABLE") for d, v in DIMENSIONS.items()]
    for k, meta in (links or {}).items():
        for field, kind, relation in (("sources", "source", "SOURCED_FROM"), ("reconciled_against", "source", "RECONCILED_AGAINST"), ("drivers", "kpi", "HAS_DRIVER")):
            edges += [(f"kpi:{k}", f"{kind}:{t}", relation) for t in meta.get(field, [])]
    for r, meta in contract["entitlements"].items():
        edges += [(f"role:{r}", f"domain:{d}", "SCOPED_TO_DOMAIN") for d in meta["domains"]] + [(f"role:{r}", f"channel:{c}", "CAN_PUSH_VIA") for c in meta["channels"]]
        nodes += [(f"channel:{c}", "channel", c) for c in meta["channels"]]
    n, e = spark.createDataFrame(sorted(set(nodes)), NODE), spark.createDataFrame(edges, EDGE)
    if verdicts is not None:
        known = verdicts.where("hypothesis_id is not null")
        hyp = F.concat(F.lit("hyp:"), "hypothesis_id")
        n = n.unionByName(known.select(hyp.alias("id"), F.lit("hypothesis").alias("type"), F.col("hypothesis_id").alias("label"))).dropDuplicates(["id"])
        for target, relation in ((F.concat(F.lit("dim:"), "dim"), "TESTS_DIMENSION"), (F.concat(F.lit("verdict:"), "verdict"), "HAS_VERDICT"), (F.lit("kpi:revenue"), "TARGETS_KPI")):
            e = e.unionByName(known.select(hyp.alias("source"), target.alias("target"), F.lit(relation).alias("relation")))
    return n, without_dangling(n, e)


def without_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes, each once."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, neighbour, relation, direction)."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "relation", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "relation", F.lit("in").alias("direction")))


def related(edges: DataFrame, node: str) -> DataFrame:
    """Neighbours of a node in both directions."""
    return both_ways(edges).where(F.col("node") == node)


def blast_radius(edges: DataFrame, node: str, max_depth: int = 3) -> DataFrame:
    """(node, hops): all nodes within ``max_depth`` undirected steps, by their fewest.

    Each step joins the frontier to the edges and takes away what has been reached; it is written to the shared
    folder, so a step's lineage is one join, whatever the depth.
    """
    around = both_ways(edges).select("node", "neighbour").distinct()
    frontier = edges.sparkSession.createDataFrame([(node,)], "node string")
    seen = frontier.withColumn("hops", F.lit(0))
    for depth in range(1, max_depth + 1):
        reached = around.join(frontier, "node").select(F.col("neighbour").alias("node")).distinct()
        fresh = materialize(reached.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(depth)), "frontier")
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh.select("node")
    return seen.where("hops > 0")


def by_hops(reached: DataFrame) -> DataFrame:
    """What a node reaches, nearest first."""
    return reached.orderBy("hops", "node")


def shared_mechanism(hypotheses: DataFrame, hypothesis: str) -> DataFrame:
    """(hypothesis_id, same_dim, same_archetype): others that test the same dimension or in the same way."""
    own = hypotheses.where(F.col("hypothesis_id") == hypothesis).select(F.col("dim").alias("__d"), F.col("test_archetype").alias("__a"))
    same_dim, same_way = F.col("dim") == F.col("__d"), F.col("test_archetype") == F.col("__a")
    pairs = hypotheses.where(F.col("hypothesis_id") != hypothesis).join(own, same_dim | same_way)
    return pairs.select("hypothesis_id", F.coalesce(same_dim, F.lit(False)).alias("same_dim"), F.coalesce(same_way, F.lit(False)).alias("same_archetype"))
