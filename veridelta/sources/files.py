"""Scans and sinks of the analytic sources: CSV with declared schemas, JSON artefacts, and their writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from veridelta.operators.reconcile import mature
from veridelta.sources.tables import is_missing

#: Declared schemas of the sources, as DDL.
SCHEMAS = {
    "pos_transactions": "date date, region string, product_category string, fulfillment_center string, units int, gross_revenue double",
    "marketing_spend": "week int, week_start date, region string, channel string, spend_usd double, attributed_revenue_usd double",
    "crm_headcount": "month string, region string, rep_id string, rep_name string, active boolean, attrition_date date, assigned_accounts int, rep_attributed_revenue_usd double",
    "finance_gl_extract": "month string, region string, gl_revenue_usd double",
    "support_tickets": "ticket_id string, created_at date, region string, topic_seed string, text string",
    "fulfillment_center_ops": "month string, fulfillment_center string, region string, orders_backlog int, daily_incoming_orders int, daily_processing_capacity_orders int, staff_headcount int, wms_migration_status string",
}


def read_source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One CSV source with its declared schema; a header that names other columns, or in another order, is an error; dates as ISO."""
    return spark.read.schema(SCHEMAS[name]).option("header", True).option("enforceSchema", False).csv(f"{folder}/{name}.csv")


def read_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All five reconciled sources."""
    return {n: read_source(spark, folder, n) for n in SCHEMAS if n != "fulfillment_center_ops"}


def read_if_there(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A source, or None where its file is missing."""
    try:
        df = read_source(spark, folder, name)
        df.limit(0).count()
        return df
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return None


def read_artifact(spark: SparkSession, path: str, lines: bool = True) -> DataFrame | None:
    """A JSON artefact of an earlier step, a document on each line, or else one document or array; None where it is missing."""
    try:
        return spark.read.option("multiLine", not lines).json(path)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return None


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_artifact(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def register_views(sources: dict[str, DataFrame], min_weeks: int | None = None) -> None:
    """The views that compiled predicates may read.

    With ``min_weeks`` the sales are those of mature categories, by the one rule that panels use as well, so that no predicate sees a
    category that a panel leaves out.
    """
    for name, df in sources.items():
        if min_weeks is not None and name == "pos_transactions":
            df = mature(df, min_weeks)
        df.createOrReplaceTempView(name)
