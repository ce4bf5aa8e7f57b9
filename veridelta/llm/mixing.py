"""Mixing sources to target weights by temperature, and a schedule that realises them block by block.

A source's share of the tokens is raised to an exponent from 0 (all equal) to 1 (as they come). The exponent is found
by section search: the largest that reaches a target entropy, or the smallest that keeps repetition within a limit if
that is larger. Each pass asks for both measures at many exponents in one aggregate over the sources, so
the number of sources isn't bounded by the driver. The weights then become a schedule of blocks: each block has each
source's share of the block's budget, and its documents stand in a random order that depends on the seed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, public_vocabulary, running_total, tune
from .tokens import byte_ids

#: Exponents that one pass looks at, and passes: the interval shrinks by POINTS - 1 each time.
POINTS, PASSES = 33, 4
#: Copies of an equal row that are numbered at once.
COPIES = 4096


@dataclass(frozen=True)
class Targets:
    """What a mixture must meet. Entropy is a share of the largest possible; without a budget every document is kept once at least."""

    entropy: float | None = 0.95
    repetition: float | None = 4.0
    budget: int | None = None
    block: int = 1 << 20
    seed: int = 17


def tokens(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of a text by a public byte-level tokenizer, one at least: what a text counts for."""
    path = vocabulary or public_vocabulary("byte_bpe_50k.json")

    @F.pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = byte_ids(path)
        for texts in batches:
            yield pd.Series([max(1, len(ids(t))) for t in texts], dtype="int64")

    return counted(text)


def source_key(source: Column) -> Column:
    """A key that tells a null source from every name."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source.cast("string")))


def source_totals(rows: DataFrame) -> DataFrame:
    """(mix_key, docs, tokens) of each source of a table with columns mix_key and n_tokens."""
    return rows.groupBy("mix_key").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


def measures(totals: DataFrame, total: float, points: np.ndarray) -> list[tuple[float, float, float]]:
    """At each exponent: entropy, the largest and the smallest ratio of weight to share."""
    share = F.col("tokens").cast("double") / F.lit(float(total))
    asked = []
    for i, a in enumerate(points):
        raised = F.pow(share, F.lit(float(a)))
        ratio = F.pow(share, F.lit(float(a) - 1.0))
        asked += [F.sum(raised).alias(f"z{i}"), F.sum(raised * F.log(share)).alias(f"l{i}"), F.max(ratio).alias(f"h{i}"), F.min(ratio).alias(f"m{i}")]
    got = totals.agg(*asked).first()
    return [(float(np.log(got[f"z{i}"]) - a * got[f"l{i}"] / got[f"z{i}"]), got[f"h{i}"] / got[f"z{i}"], got[f"m{i}"] / got[f"z{i}"]) for i, a in enumerate(points)]


def find_exponent(totals: DataFrame, targets: Targets) -> tuple[float, float, float]:
    """(exponent, normaliser of the raised shares, tokens of the whole schedule) for the targets.

    Entropy falls and repetition falls as the exponent grows, so each has one place where it meets its target. If
    even an exponent of 1 repeats too much, the budget can't be met, which is an error.
    """
    n, total = totals.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return 1.0, 1.0, 0.0

    def repeats(high: float, low: float) -> float:
        return targets.budget / total * high if targets.budget else high / low

    def search(good) -> float:
        """The border in [0, 1] between exponents that are good and those that aren't."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            points = np.linspace(low, high, POINTS)
            states = [good(m) for m in measures(totals, total, points)]
            change = next((i for i in range(1, POINTS) if states[i] != states[0]), None)
            if change is None:
                return low if low == high else (1.0 if states[0] == good.keeps else 0.0)
            low, high = float(points[change - 1]), float(points[change])
        return low if good.keeps else high

    class Entropy:
        keeps = True  # good up to the border

        def __call__(self, m) -> bool:
            return m[0] >= targets.entropy * np.log(n) - 1e-12

    class Repetition:
        keeps = False  # good from the border on

        def __call__(self, m) -> bool:
            return repeats(m[1], m[2]) <= targets.repetition * (1 + 1e-9)

    exponent = search(Entropy()) if targets.entropy is not None and n > 1 else 1.0
    if targets.repetition is not None:
        (at_one,) = measures(totals, total, np.array([1.0]))
        if not Repetition()(at_one):
            raise ValueError("the budget repeats every source beyond the limit")
        exponent = max(exponent, search(Repetition()))
    ((_, high, low),) = measures(totals, total, np.array([exponent]))
    share = F.col("tokens").cast("double") / F.lit(float(total))
    z = totals.agg(F.sum(F.pow(share, F.lit(exponent)))).first()[0]
    return exponent, z, float(targets.budget or total / low)


def weights(totals: DataFrame, targets: Targets) -> DataFrame:
    """(mix_key, docs, tokens, weight, epochs): normalised weights, and how often each source is gone through."""
    exponent, z, budget = find_exponent(totals, targets)
    total = totals.agg(F.sum("tokens")).first()[0] or 1
    share = F.col("tokens").cast("double") / F.lit(float(total))
    weight = F.pow(share, F.lit(exponent)) / F.lit(z)
    epochs = weight * F.lit(budget) / F.col("tokens")
    nearly = F.round(epochs)
    return totals.withColumn("weight", weight).withColumn("epochs", F.when(F.abs(epochs - nearly) < 1e-9, nearly).otherwise(epochs))


def numbered_copies(rows: DataFrame) -> DataFrame:
    """The rows with a number for each of equal ones, so that copies of one row have hashes, and so places and tasks, of their own."""
    counted = rows.groupBy("id", "tie", "mix_key", "n_tokens").agg(F.count("*").alias("m"))
    lots = counted.withColumn("lot", F.explode(F.sequence(F.lit(0), F.expr(f"(m - 1) div {COPIES}"))))
    inside = F.explode(F.sequence(F.lit(0), F.least(F.lit(COPIES), F.col("m") - F.col("lot") * COPIES) - 1))
    return lots.withColumn("in_lot", inside).select("id", "tie", "mix_key", "n_tokens", (F.col("lot") * COPIES + F.col("in_lot")).alias("copy"))


def schedule(rows: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """(id, mix_key, n_tokens, weight, epoch, block, position) for every appearance of a document.

    ``rows`` has columns id, tie, mix_key and n_tokens and is read more than once. A source's documents come in a random order of
    their own in each epoch; the last, partial epoch takes them until the source's budget is met. A place in that
    stream, over the source's budget per block, is the block; positions in a block are a random permutation. Equal rows
    appear each for itself. An empty table gives no rows. A hot source is cut by the hash that orders it, never gathered.
    """
    per_source = materialize(source_totals(rows), "source-totals")
    mix = materialize(weights(per_source, targets), "mixture")
    known = numbered_copies(rows).join(mix.withColumnRenamed("mix_key", "of"), F.col("mix_key") == F.col("of")).drop("of")
    each = known.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil("epochs").cast("int") - 1)))
    each = each.withColumn("h", F.xxhash64(F.lit(targets.seed), "epoch", "id", "tie", "copy"))
    parts = F.ceil(F.sqrt("docs")).cast("long")
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))  # from 0 to 1, in the order of the hash
    placed = running_total(each, ["mix_key", "epoch"], [unit, F.col("id"), F.col("tie"), F.col("copy")], F.col("n_tokens"), F.floor(unit * parts), "before")
    left = (F.col("epochs") - F.col("epoch")) * F.col("tokens")
    kept = placed.where(F.col("before") < left)
    per_block = F.col("weight") * F.lit(float(targets.block))
    block = F.floor((F.col("epoch") * F.col("tokens") + F.col("before")) / per_block)
    blocked = kept.select("id", "tie", "copy", "mix_key", "n_tokens", "weight", "epoch", block.alias("block"))
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(targets.seed + 1), "id", "tie", "copy", "epoch"), "id", "tie", "copy", "epoch")
    return blocked.withColumn("position", F.row_number().over(order) - 1).drop("copy")


def mix(docs: DataFrame, targets: Targets = Targets(), doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens, weight, epoch, block, position) for every appearance of every document.

    A null source is a source of its own; a null or empty text counts as one token. Repeated rows appear each for itself.
    """
    tune(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("tie"), source_key(F.col(source)).alias("mix_key"), tokens(F.col(text)).alias("n_tokens"))
    found = schedule(materialize(narrow, "mix-rows"), targets)
    name = F.when(F.col("mix_key") != "-", F.substring("mix_key", 2, 1 << 30)).alias("source")
    return found.select(F.col("id").alias("doc_id"), name, "n_tokens", "weight", "epoch", "block", "position")


def mixed_rows(docs: DataFrame, targets: Targets = Targets(), source: str = "source", text: str = "text") -> DataFrame:
    """The documents themselves, with all their columns, as often and in the order that the schedule says.

    The schedule is made from ids and counts; whole rows are shuffled once to meet it and once into its order. Equal
    rows are told apart by their number alone: a row that occurs m times is scheduled m times.
    """
    tune(docs.sparkSession)
    row = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    keyed = docs.select(F.struct(*row).alias("row"), F.xxhash64(*row).alias("a"), F.xxhash64(F.lit(1), *row).alias("b"), source_key(F.col(source)).alias("key"), F.col(text).alias("text"))  # 128 bits tell rows apart
    counted = keyed.select(F.col("a").alias("id"), F.col("b").alias("tie"), F.col("key").alias("mix_key"), tokens(F.col("text")).alias("n_tokens"))
    plan = schedule(materialize(counted, "mix-rows"), targets).select("id", "tie", "block", "position")
    once = keyed.select("row", "a", "b").dropDuplicates(["a", "b"])  # dealt by the keys of the join, so that rows move once for both
    placed = once.join(plan, (F.col("a") == F.col("id")) & (F.col("b") == F.col("tie")))
    return placed.repartitionByRange("block", "position").sortWithinPartitions("block", "position").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
