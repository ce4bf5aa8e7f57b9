"""The semantic contract: KPIs, sources, calendar, constraints and roles, and the entitlement checks on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the contract.
CONTRACT: dict = {
    "calendar": {"week1_start": "2025-01-06", "weeks": 40},
    "sources": {
        "pos_transactions": {"refresh_cadence": "daily", "system_of_record": True},
        "marketing_spend": {"refresh_cadence": "weekly", "system_of_record": True},
        "crm_headcount": {"refresh_cadence": "monthly", "system_of_record": True},
        "finance_gl_extract": {"refresh_cadence": "monthly", "system_of_record": False},
        "support_tickets": {"refresh_cadence": "near-real-time", "system_of_record": False},
    },
    "kpis": {
        "revenue": {"pct": 0.03, "abs": 25000.0, "domain": "sales", "min_weeks_of_history": 8},
        "units_sold": {"pct": 0.05, "abs": None, "domain": "sales"},
        "marketing_attributed_revenue_share": {"pct": 0.04, "abs": None, "domain": "marketing"},
        "rep_attributed_revenue": {"pct": 0.03, "abs": 20000.0, "domain": "hr"},
        "new_category_revenue": {"pct": 0.10, "abs": None, "domain": "sales"},
    },
    "constraints": {"max_accounts_per_rep": 20, "max_overtime_capacity_boost_pct": 20, "backlog_clear_target_days": 14},
    "entitlements": {
        "ops_manager_west": {"regions": ["West"], "rep_detail": "allow", "domains": ["sales", "marketing", "hr"], "persona": "ops_manager", "channels": ["slack_channel", "dashboard"]},
        "regional_vp": {"regions": ["West", "East", "Central"], "rep_detail": "deny", "domains": ["sales", "marketing"], "persona": "exec_vp", "channels": ["email_digest", "dashboard"]},
        "marketing_analyst": {"regions": ["West", "East", "Central"], "rep_detail": "deny", "domains": ["marketing"], "persona": "marketing_analyst", "channels": ["dashboard"]},
        "platform_engineer": {"regions": ["West", "East", "Central"], "rep_detail": "allow", "domains": ["sales", "marketing", "hr"], "persona": "engineer", "channels": ["dashboard"]},
    },
}


def load_contract(path: str) -> dict:
    """A contract of the same shape from a YAML file on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


class EntitlementDenied(Exception):
    """A role asked for what it may not see; raised before any plan is made."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


@dataclass(frozen=True)
class Dimension:
    """Where a dimension's rows are: view, unit and period columns, and the column grant it needs."""

    view: str
    unit: str
    value: str
    time: str
    grant: str | None = None


#: Identifiers that compiled queries may use; values only ever come as bind parameters.
DIMENSIONS = {
    "fulfillment_center": Dimension("pos_transactions", "fulfillment_center", "gross_revenue", "week"),
    "product_category": Dimension("pos_transactions", "product_category", "gross_revenue", "week"),
    "rep_id": Dimension("crm_headcount", "rep_id", "rep_attributed_revenue_usd", "month", "rep_detail"),
    "channel": Dimension("marketing_spend", "channel", "spend_usd", "week"),
}


def check_entitlement(role: str, region: str, dim: str, contract: dict = CONTRACT) -> None:
    """Row and column scope; denies by default."""
    scope = contract["entitlements"].get(role)
    if scope is None:
        raise EntitlementDenied(f"unknown role {role}")
    if region not in scope["regions"]:
        raise EntitlementDenied(f"{role} has no access to region {region}")
    if dim not in DIMENSIONS:
        raise EntitlementDenied(f"unknown dimension {dim}")
    grant = DIMENSIONS[dim].grant
    if grant and scope.get(grant) != "allow":
        raise EntitlementDenied(f"{role} has no access to {grant}")


def check_domain(role: str, kpi: str, contract: dict = CONTRACT) -> None:
    """Domain scope of a KPI; denies by default."""
    scope = contract["entitlements"].get(role)
    if scope is None:
        raise EntitlementDenied(f"unknown role {role}")
    if kpi not in contract["kpis"]:
        raise EntitlementDenied(f"unknown KPI {kpi}")
    domain = contract["kpis"][kpi]["domain"]
    if domain not in scope["domains"]:
        raise EntitlementDenied(f"{role} has no access to the {domain} domain")


def allowed(check, *args) -> tuple[bool, str]:
    """Whether a check passes, and the reason if not."""
    try:
        check(*args)
        return True, ""
    except EntitlementDenied as e:
        return False, e.reason


def kpi_table(spark: SparkSession, contract: dict = CONTRACT) -> DataFrame:
    """(kpi, pct_threshold, abs_threshold, domain): a row for each KPI."""
    rows = [(k, v["pct"], v["abs"], v["domain"]) for k, v in contract["kpis"].items()]
    return spark.createDataFrame(rows, "kpi string, pct_threshold double, abs_threshold double, domain string")


def role_table(spark: SparkSession, contract: dict = CONTRACT) -> DataFrame:
    """(role, regions, rep_detail, domains, persona, channels): a row for each role."""
    rows = [(r, v["regions"], v["rep_detail"], v["domains"], v["persona"], v["channels"]) for r, v in contract["entitlements"].items()]
    return spark.createDataFrame(rows, "role string, regions array<string>, rep_detail string, domains array<string>, persona string, channels array<string>")
