"""What several plans share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from veridelta.sources.tables import shared_dir


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
