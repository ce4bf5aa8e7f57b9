"""A corpus pipeline of the operators in veridelta.llm; each stage takes (spark, docs, sf_dir) and works on all it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.llm import mixing, packing, quality, simhash
from veridelta.llm.common import materialize, table

#: Documents with a quality score below this are rejected.
LEAST_SCORE = 0.5
#: Every document at least once, and no source more than twice as often as another.
MIXTURE = mixing.Targets(entropy=0.95, repetition=2.0)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, with all their columns."""
    rows = materialize(quality.with_features(docs), "quality-features")
    model = quality.fit(rows, table(spark, sf_dir, "labels"), quality.in_training(F.col("__id")))
    x = "x" + "".join(docs.columns)  # a name that no column has
    return docs.withColumn(x, quality.feature_column(F.col("text"))).where(model.score(F.col(x)) >= LEAST_SCORE).drop(x)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest doc_id.

    Documents are near duplicates if their five-word shingles have a Jaccard similarity of 0.8 or more, or by a chain of such pairs.
    Documents with a null doc_id can't be told apart and stay. Different texts under one doc_id are documents of
    their own: each component keeps one row, of its smallest doc_id and of that the text with the smallest key.
    """
    found = simhash.near_copies(docs.select("doc_id", "text")).where("doc_id is not null")
    each = found.groupBy("doc_id", "th").agg(F.first("root").alias("root"), F.count("*").alias("n"), F.first("component").alias("least"))  # not by root: it may be hot
    first = each.where("doc_id = least").groupBy("root").agg(F.min(F.struct("doc_id", "th", "n")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.th").alias("__th"), "k.n")
    kept = materialize(first, "near-copies-kept")
    again = kept.where("n > 1").select("__id", "__th")
    rest = each.join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("th") == F.col("__th")), "left_anti")
    out = rest.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).unionByName(again)
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])  # as one, so that no name clashes
    keyed = docs.select(row.alias("row"), F.col("doc_id").alias("id"), simhash.text_key(F.col("text")).alias("key"))
    same = (F.col("id") == F.col("__id")) & (F.col("key") == F.col("__th"))
    once = keyed.join(again, same, "left_semi").dropDuplicates(["id", "key"])
    return keyed.join(out, same, "left_anti").unionByName(once).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks, in the order of the mixture's blocks."""
    return mixing.mixed_rows(docs, MIXTURE)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality_filter", quality_filter), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", sequences)]
#: The classifier's fit and the fingerprints are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
