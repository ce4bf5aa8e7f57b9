"""What several of the corpus operators share: shared-folder tables, tokenizer caches, distributed running sums."""

from __future__ import annotations

import posixpath
import uuid
from functools import lru_cache
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta.sources.tables import materialize, shared_dir, table

__all__ = ["materialize", "shared_dir", "table", "tune", "running_total", "shared_path", "open_shared", "tokenizer"]

#: Rows of text, and their bytes, that go to a Python worker at once; a single longer text goes alone.
ARROW_ROWS, ARROW_BYTES = 400, 32 << 20


def tune(spark: SparkSession) -> None:
    """Keep the Arrow batches of whole texts small, so that long documents don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, salt: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the same keys, without a task that holds a whole key.

    ``salt`` splits each key into ranges or random parts; rows are ordered by (salt, order). The sums
    of the parts are added up per key, and the running sum inside each part is added to that.
    With about sqrt(n) parts for n rows, neither level has more than about sqrt(n) rows in a group.
    """
    with_salt = df.withColumn("__salt", salt)
    parts = with_salt.groupBy(*keys, "__salt").agg(F.sum(value).alias("__part"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__salt").alias("__k_salt"), F.coalesce(F.sum("__part").over(before), F.lit(0)).alias("__base"))
    same = F.col("__salt") == F.col("__k_salt")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    inside = Window.partitionBy(*keys, "__salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        with_salt.join(base, same)
        .withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__salt", "__base", "__k_salt", *[f"__k_{k}" for k in keys])
    )


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_shared(path: str, mode: str):
    """A binary stream of a file in the shared store, by the store that the path's scheme names; mode is "r" or "w"."""
    from pyarrow import fs

    at = urlparse(path)
    if at.scheme in ("", "file"):
        store, inner = fs.LocalFileSystem(), at.path
    else:
        store, inner = fs.FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(posixpath.dirname(inner), recursive=True)
        return store.open_output_stream(inner, compression=None)
    return store.open_input_file(inner)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """A tokenizers-library tokenizer, one of each per Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def public_vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
