"""Readers for the given tables and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; one of our own where it names none."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or _own_dir(spark.sparkContext.applicationId)


def is_missing(error: AnalysisException) -> bool:
    """Whether a read failed because nothing is there."""
    return error.getCondition() == "PATH_NOT_FOUND"


@lru_cache
def _own_dir(application: str) -> str:
    """A folder for an application whose session names none, as in tests on one machine."""
    return tempfile.mkdtemp(prefix="spark-shared-")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
