"""URL rules by a cascade of Bloom filters that is exact on the corpus's own keys.

The keys of a URL are its host's suffixes joined to the beginnings of its path that a rule could have. The first
filter of a cascade holds the listed keys; the second, those unlisted keys of the corpus that the first lets
through; the third, those listed keys that the second lets through; and so on, until nothing passes wrongly. Every key
of the corpus went into the making, so membership is exact, and a page is judged by a few bit tests: no join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Bits of a filter at most: what is broadcast has this bound, whatever the list.
MOST_BITS = 1 << 30
MOST_LEVELS = 60
WORD = 32
#: Words of a filter that a task puts together.
SEGMENT = 1 << 15


def positions(a: np.ndarray, b: np.ndarray, size: int, count: int, level: int) -> Iterator[np.ndarray]:
    """The bits of each key; those of different levels are independent, or one's errors would be the next one's."""
    a = a ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for _ in range(2):
        a = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    for i in range(count):
        yield (a + np.uint64(i) * (b | np.uint64(1))) % np.uint64(size)


@dataclass(frozen=True)
class Bloom:
    """A bit field of 32-bit words, the number of bits set for a key, and the level that its hashes are mixed with."""

    words: np.ndarray
    size: int
    hashes: int
    level: int

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether keys with these two hashes may be in the filter."""
        found = np.ones(len(a), bool)
        for at in positions(a, b, self.size, self.hashes, self.level):
            found &= (self.words[(at // WORD).astype(np.int64)] >> (at % WORD).astype(np.uint32)) & 1 == 1
        return found


@dataclass(frozen=True)
class Cascade:
    """Levels in turn of listed and unlisted keys."""

    levels: tuple[Bloom, ...]

    def lists(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key is listed: exact for the keys it was made over."""
        listed = np.zeros(len(a), bool)
        undecided = np.arange(len(a))
        for k, level in enumerate(self.levels):
            passed = level.passes(a[undecided], b[undecided])
            if k % 2:
                listed[undecided[~passed]] = True  # in the even levels up to here, not among their false positives
            undecided = undecided[passed]
        if len(self.levels) % 2:
            listed[undecided] = True
        return listed


def hashes(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a key."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


class FilterTooLarge(ValueError):
    """What would be sent to every task is beyond MOST_BITS."""


def filter_bits(count: int, rate: float) -> int:
    """Bits of a filter of so many keys at a false-positive rate."""
    return max(64, ceil(-count * log(min(0.5, max(rate, 1e-12))) / log(2) ** 2))


def first_rate(count: int, total: int) -> float:
    """The false-positive rate of a cascade's first filter: about as many pass wrongly as are listed."""
    return sqrt(0.5) * count / total


def build_bloom(keys: DataFrame, count: int, rate: float, level: int) -> Bloom:
    """A filter of the (a, b) rows with about this false-positive rate; the words are put together by Spark."""
    rate = min(0.5, max(rate, 1e-12))
    size = filter_bits(count, rate)
    if size > MOST_BITS:
        raise FilterTooLarge(f"a filter of {size} bits is beyond the bound of {MOST_BITS}")
    k = max(1, round(-log(rate) / log(2)))

    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            a, b = frame["a"].to_numpy().view(np.uint64), frame["b"].to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(list(positions(a, b, size, k, level))).astype(np.int64))
            yield pd.DataFrame({"word": at // WORD, "mask": np.int64(1) << (at % WORD)})

    def segments(frame: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(SEGMENT, np.uint32)
        part[frame["word"].to_numpy() % SEGMENT] = frame["mask"].to_numpy().astype(np.uint32)
        return pd.DataFrame({"segment": frame["word"].iloc[:1] // SEGMENT, "words": [part.tobytes()]})

    by_word = keys.mapInPandas(bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    parts = by_word.groupBy(F.floor(F.col("word") / SEGMENT)).applyInPandas(segments, "segment long, words binary")
    words = np.zeros(-(-(size // WORD + 1) // SEGMENT) * SEGMENT, np.uint32)
    for r in parts.collect():  # MOST_BITS / 8 bytes at most, in segments
        words[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(r["words"], np.uint32)
    return Bloom(words, size, k, level)


def member(spark: SparkSession, cascade: Cascade):
    """A column function: the position from 1 of the first listed key of two arrays of hashes, or 0."""
    sent = spark.sparkContext.broadcast(cascade)

    @F.pandas_udf(T.IntegerType())
    def first(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = np.array([len(x) for x in a], np.int64)
        out = np.zeros(len(a), np.int32)
        if sizes.sum():
            flat = [np.concatenate([np.asarray(x, np.int64) for x in s]).view(np.uint64) for s in (a, b)]
            hit = np.flatnonzero(sent.value.lists(*flat))
            row = np.repeat(np.arange(len(a)), sizes)[hit]
            place = hit - (np.cumsum(sizes) - sizes)[row] + 1
            for r, p in zip(row[::-1], place[::-1], strict=True):  # the first of a row is written last
                out[r] = p
        return pd.Series(out)

    return first.asNondeterministic()  # evaluated where it stands: a filter on the verdict isn't moved into it


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """A cascade that is exact for the keys of ``universe`` (columns a, b), of which those in ``listed`` are listed.

    Only what a level lets through wrongly is kept for the next, about as many keys as are listed; the corpus's keys
    are read twice and never sorted. Raises if two keys, one of them listed, have the same pair of hashes.
    """
    listed = listed.distinct()
    n = listed.count()
    if not n:
        return Cascade(())
    total = universe.agg(F.approx_count_distinct(F.xxhash64("a", "b"))).first()[0] + n
    levels: list[Bloom] = []

    def passing(rows: DataFrame, level: Bloom) -> DataFrame:
        return rows.where(member(rows.sparkSession, Cascade((level,)))(F.array("a"), F.array("b")) == 1)

    levels.append(build_bloom(listed, n, first_rate(n, total), 0))
    wrong = materialize(passing(universe, levels[0]).distinct().join(listed, ["a", "b"], "left_anti"), "false-positives")
    inside, outside = listed, wrong
    while True:
        side, other = (outside, inside) if len(levels) % 2 else (inside, outside)
        count = side.count()
        if not count:
            return Cascade(tuple(levels))
        if len(levels) > MOST_LEVELS:
            raise RuntimeError("the cascade doesn't end: two keys share their hashes")
        levels.append(build_bloom(side, count, 0.5, len(levels)))
        kept = materialize(passing(other, levels[-1]), "still-passing")
        inside, outside = (kept, outside) if len(levels) % 2 == 0 else (inside, kept)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lowered. Path: from there up to ?, # or the end."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    rest = F.when(F.instr(url, "://") > 0, rest).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """The keys of a URL, longest first: each suffix of the host at a label with each beginning of the path of a rule's length."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in sorted(path_lengths, reverse=True)]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))
    longest_first = F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(longest_first, lambda s: s["key"]))


def rule_table(spark: SparkSession, rules: list[str] | DataFrame) -> DataFrame:
    """(rule, bad) of a list or of a table's column ``rule``, hosts lower-cased; ``bad`` tells rules without a host or a slash. Null rules are left out."""
    given = rules if isinstance(rules, DataFrame) else spark.createDataFrame([(r,) for r in rules], "rule string")
    cut = F.instr("rule", "/")
    host = F.lower(F.substring(F.col("rule"), F.lit(1), cut - 1))
    whole = F.concat(host, F.substring(F.col("rule"), cut, F.length("rule")))
    return given.where("rule is not null").select(F.when(cut > 1, whole).otherwise(F.col("rule")).alias("rule"), (cut < 2).alias("bad")).distinct()


def first_by_cascade(rows: DataFrame, universe: DataFrame, listed: DataFrame, out: str) -> DataFrame:
    """Adds the place of each row's first listed key, or 0, by a cascade that is sent to the tasks."""
    pair = [F.transform("keys", lambda k: hashes(k)[0]), F.transform("keys", lambda k: hashes(k)[1])]
    return rows.withColumn(out, member(rows.sparkSession, build_cascade(universe, listed))(*pair))


def first_by_join(rows: DataFrame, listed: DataFrame, out: str) -> DataFrame:
    """The same for lists whose filter is beyond what may be sent: keys meet the list where both hashes are dealt to.

    A page's keys go without its columns, and distinct keys meet the list once, so that a frequent key is one row.
    """
    a, b = hashes(F.col("k"))
    keyed = rows.select(F.explode("keys").alias("k")).distinct().select("k", a.alias("a"), b.alias("b"))
    hit = keyed.join(listed.distinct(), ["a", "b"], "left_semi").select("k")
    named = rows.withColumn("row_number", F.monotonically_increasing_id())
    named = materialize(named, "pages-with-keys")
    at = named.select("row_number", F.posexplode("keys").alias("i", "k")).join(hit, "k").groupBy("row_number").agg((F.min("i") + 1).cast("int").alias("found"))
    return named.join(at, "row_number", "left").withColumn(out, F.coalesce("found", F.lit(0))).drop("row_number", "found")


def judge(pages: DataFrame, block: list[str] | DataFrame, allow: list[str] | DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages; rules are written host/path, as in ``example.org/fr/``.

    Rules are lists, or tables with a column ``rule``. A rule fits its host and all hosts below it, if the URL's path starts with the rule's path. The
    longest rule that fits decides; of a rule that is both blocked and allowed, the allowance. A URL that no rule fits is allowed. A null
    URL, or one without ``://``, has an empty host and path, and is allowed. Rules without a host or a slash are an error. A list whose
    filter would be beyond MOST_BITS, some twenty million rules, is joined instead, with the same result.
    """
    spark = pages.sparkSession
    tables = {"bad": rule_table(spark, block), "good": rule_table(spark, allow)}
    every = materialize(tables["bad"].withColumn("kind", F.lit("bad")).unionByName(tables["good"].withColumn("kind", F.lit("good"))), "url-rules")
    wrong = every.where("bad").select("rule").limit(1).collect()
    if wrong:
        raise ValueError(f"a rule is host/path: {wrong[0][0]!r}")
    lengths = sorted(r[0] for r in every.select((F.length("rule") - F.instr("rule", "/") + 1).alias("n")).distinct().collect())  # lengths of paths: as many as a URL is long at most
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths or [1]))
    a, b = hashes(F.col("key"))
    universe = rows.select(F.explode("keys").alias("key")).select(a.alias("a"), b.alias("b"))
    good = every.where("kind = 'good'").select("rule")
    found = rows
    for name, named in (("bad", every.where("kind = 'bad'").select("rule").join(good, "rule", "left_anti")), ("good", good)):
        listed = named.select(F.col("rule").alias("key")).select(a.alias("a"), b.alias("b"))
        try:
            found = first_by_cascade(found, universe, listed, name)
        except FilterTooLarge:  # told before a filter is begun
            found = first_by_join(found, listed, name)
    at = F.when(F.col("bad") == 0, F.col("good")).when(F.col("good") == 0, F.col("bad")).otherwise(F.least("bad", "good"))
    return found.withColumn("at", at).select(
        "page_id", "host", "path",
        F.when(F.col("at") > 0, F.element_at("keys", F.greatest(F.col("at"), F.lit(1)))).alias("rule"),
        F.when((F.col("bad") > 0) & (F.col("at") == F.col("bad")), "block").otherwise("allow").alias("verdict"),
    )
