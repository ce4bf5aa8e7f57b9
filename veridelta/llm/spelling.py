"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two different words are one edit apart if their common prefix and their common suffix together reach the longer one's
length minus one. Tiles compare padded matrices of code points, block against block, and add up the two lengths for all
their pairs at once; only counts and the best partner of each word leave a tile.

Which words meet in a tile: an edit leaves the first half of the shorter word's letters, or the rest of them, as it was. So a
word goes to the tiles of its class (the shorter word's length), half and letters of that half, as the shorter and as the longer
of a pair. A half that more words share than a tile holds is cut into blocks, and every pair of its blocks is a tile, so no pair
is lost. The prefix tile counts a pair that both halves propose.

Nulls: a null text has no words, a null doc_id counts as an empty string. Empty tables have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune
from .groups import whole_groups

#: Letters of a word: A-Z, a-z and the code points from U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in this many loses a letter.
ONE_IN = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words of a block of a hot half, and code points of a tile's matrix.
BLOCK, CELLS = 1024, 1 << 20
#: Words of small halves that are compared in one tile.
TOGETHER = 512


def words(documents: DataFrame) -> DataFrame:
    """(word): every occurrence of a run of letters, A-Z lower-cased, one in 97 with a letter less."""
    runs = F.regexp_extract_all(F.translate(F.col("text"), UPPER, LOWER), F.lit(RUN), F.lit(0))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), place), F.substr(F.col("run"), place + 2))
    return hashed.select(F.when(F.col("h") % ONE_IN == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(occurrences: DataFrame) -> DataFrame:
    """(word, n): words of at least five letters that occur at least three times."""
    return occurrences.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def halves(known: DataFrame) -> DataFrame:
    """(m, kind, part, word, n): each word in the class of its length and in that of words one shorter, by first half and by the rest."""

    def of(m: Column) -> list[Column]:
        h = F.floor(m / 2).cast("int")
        first = F.substr(F.col("word"), F.lit(1), h)
        rest = F.substr(F.col("word"), F.length("word") - (m - h) + 1)
        return [F.struct(m.alias("m"), F.lit(k).alias("kind"), x.alias("part")) for k, x in (("first", first), ("rest", rest))]

    size = F.length("word")
    every = F.explode(F.array(*of(size), *of(size - 1)))
    return known.select(every.alias("of"), "word", "n").select("of.*", "word", "n").where(F.col("m") >= LEAST_LENGTH)


def tiles(rows: DataFrame) -> DataFrame:
    """The rows of ``halves`` with (i, j, side): the tile they are compared in, and the block (0 for i, 1 for j) that they stand for in it.

    A half of up to a block of words has the one tile (0, 0).
    """
    keys = ["m", "kind", "part"]
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(CELLS) / (F.col("m") + 1))))
    hot = rows.groupBy(*keys).agg(F.ceil(F.count("*") / room).cast("int").alias("blocks")).where("blocks > 1")
    hot = materialize(hot, "hot-halves")
    dealt = rows.join(hot, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "word", "n")


def common_lengths(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many leading columns agree, for every row of ``a`` (of ``sizes`` code points) with every row of ``b``."""
    same = np.ones((len(a), len(b)), bool)
    length = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        same &= a[:, k, None] == b[None, :, k]
        if not same.any():
            break
        length += same
    return np.minimum(length, sizes[:, None])


def _matrix(given: list[str], width: int) -> np.ndarray:
    return np.array(given, dtype=f"U{width}").view(np.uint32).reshape(len(given), width)


def single_edits(given: list[str], m: np.ndarray, first: np.ndarray, group: np.ndarray, side: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Symmetric matrix of which words of a tile are one edit apart, counting in rows of the same group, and of different sides where ``across``.

    ``m`` is each row's class: pairs of words of m and m, or of m and m + 1 letters, count. ``first`` tells rows of prefix tiles.
    """
    sizes = np.array([len(w) for w in given], np.int32)
    width = int(sizes.max())
    shorter = np.flatnonzero(sizes == m)
    if not len(shorter):
        return np.zeros((len(given), len(given)), bool)
    ahead, back = _matrix(given, width), _matrix([w[::-1] for w in given], width)
    prefix = common_lengths(ahead[shorter], ahead, sizes[shorter])
    suffix = common_lengths(back[shorter], back, sizes[shorter])
    longer = np.maximum(sizes[shorter][:, None], sizes[None, :])
    fit = (prefix + suffix >= longer - 1) & (sizes[None, :] - sizes[shorter][:, None] <= 1) & (sizes[None, :] >= sizes[shorter][:, None])
    fit &= ~((sizes[None, :] == sizes[shorter][:, None]) & (prefix == longer))  # not the word itself
    fit &= (group[shorter][:, None] == group[None, :]) & (~across[shorter][:, None] | (side[shorter][:, None] != side[None, :]))
    fit &= first[shorter][:, None] | (prefix < (m[shorter] // 2)[:, None])  # else the prefix tile has it
    near = np.zeros((len(given), len(given)), bool)
    near[shorter] = fit
    return near | near.T


def near_words(known: DataFrame) -> DataFrame:
    """(word, n_near, near): how many words are one edit away, and that of them with the largest n (ties: the first in code-point order)."""
    keys = ["m", "kind", "part", "i", "j"]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(frames, keys, TOGETHER):
            sizes = np.diff(starts)
            cells = np.add.reduceat(frame["m"].to_numpy() + 1, starts[:-1])
            begin = 0
            while begin < len(sizes):  # groups that fill a tile together, or one larger group
                end = begin + 1
                while end < len(sizes) and sizes[begin : end + 1].sum() <= TOGETHER and cells[begin : end + 1].sum() <= CELLS:
                    end += 1
                yield tile(frame.iloc[starts[begin] : starts[end]], np.repeat(np.arange(begin, end), sizes[begin:end]))
                begin = end

    def tile(frame: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        given, n = frame["word"].tolist(), frame["n"].to_numpy()
        near = single_edits(given, frame["m"].to_numpy(), (frame["kind"] == "first").to_numpy(), group, frame["side"].to_numpy(), (frame["i"] != frame["j"]).to_numpy())
        count = near.sum(axis=1)
        rank = np.array(sorted(range(len(given)), key=lambda k: (-n[k], given[k])))
        best = rank[near[:, rank].argmax(axis=1)]
        has = np.flatnonzero(count)
        text = lambda places: pd.Series([given[k] for k in places], dtype=object)
        return pd.DataFrame({"word": text(has), "n_near": count[has], "minus_n": -n[best[has]], "near": text(best[has])})

    work = tiles(halves(known)).repartition(*keys).sortWithinPartitions(*keys)
    found = work.mapInPandas(compare, "word string, n_near long, minus_n long, near string")
    best = F.min(F.struct("minus_n", "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.minus_n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form: the last of the forms that follow each other.

    A form occurs at least twice as often as its word, so chains end, and following twice as far each round takes at most six.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def variants(documents: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    A word's form is its near word of largest n, if that occurs at least twice as often; its root is the last of the forms.
    """
    tune(documents.sparkSession)
    known = materialize(vocabulary(words(documents)), "vocabulary")
    found = known.join(near_words(known), "word", "left")
    is_form = F.col("near_n") >= 2 * F.col("n")
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "spelling-forms")
    return found.join(roots(found.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
