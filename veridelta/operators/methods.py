"""What each stage computes with, and the rule that no model is the source of a number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (stage, category, method, is_quantitative).
STAGES = [
    ("reconcile_panel", "deterministic", "grouped sums and joins at declared grains", True),
    ("freshness", "deterministic", "latest covered day by source", True),
    ("completeness", "deterministic", "distinct keys against those expected", True),
    ("source_claims", "deterministic", "relative gaps and bounds", True),
    ("changepoint", "bayesian", "run-length posterior with a normal-inverse-gamma prior", True),
    ("materiality_gate", "deterministic", "posterior and business thresholds", True),
    ("price_volume_bridge", "deterministic", "volume at old prices, price on new volume", True),
    ("contribution", "game_theory", "Shapley values with bootstrap bounds", True),
    ("topic_clusters", "machine_learning", "average linkage on embeddings", True),
    ("topic_terms", "machine_learning", "mean TF-IDF", True),
    ("predicate_compiler", "deterministic", "typed predicates to parameterised SQL", True),
    ("predicate_proposal", "llm", "a proposed predicate, tested like any other", False),
    ("difference_in_differences", "econometrics", "two-way effects with robust errors", True),
    ("false_discovery", "econometrics", "step-up adjusted p", True),
    ("dose_response", "econometrics", "rank correlation over strata", True),
    ("action_wording", "llm", "words for a recommendation made by rule", False),
    ("drift_and_calibration", "statistics", "stability index, Brier score, isotonic fit", True),
]


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAGES, "stage string, category string, method string, is_quantitative boolean")


def by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("stage")).alias("stages"))


def assert_no_model_numbers(rows: DataFrame) -> None:
    """Raises if a model's stage is marked as the source of a number."""
    bad = rows.where("category = 'llm' and is_quantitative").count()
    if bad:
        raise AssertionError(f"{bad} model stages are marked as quantitative")
