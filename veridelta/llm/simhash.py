"""SimHash fingerprints, and links between them found by bit-sliced comparison.

``near_duplicates`` links fingerprints that differ in few bits. ``near_copies`` takes the comparison further: wide
fingerprints of five-word shingles sift what minhash bands propose, and the exact Jaccard similarity decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import materialize, tune
from .components import components, star_labels
from .groups import group_links

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Fingerprints of a bucket that one task compares.
CHUNK = 1024
#: Up to so many fingerprints, a bucket's pairs are lanes of their own, beside those of other small buckets.
FEW = 64
#: Near copies: words of a shingle, similarity, and the words of a fingerprint with the radius that sifts pairs.
WIDTH, SIMILARITY, WORDS, RADIUS = 5, 0.8, 2, 38
#: Shingle sets, and their shingles, that one task compares.
SETS, SHINGLES = 1024, 1 << 19
_SALT = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fingerprint_words(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """A fingerprint of 64 * ``words`` bits: a bit is 1 if set in over half the hashes. Further words come from the hashes mixed anew."""
    count = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), 4080):
        part = hashes[i : i + 4080]
        wide = np.empty((len(part), words), np.uint64)
        wide[:, 0] = part
        for k in range(1, words):
            mixed = (part ^ _SALT[k]) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            wide[:, k] = mixed ^ (mixed >> np.uint64(32))
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # as many ones fit a byte
            count += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) for every document: fp holds the 64 bits as a signed long.

    A null or empty text, or one of white space alone, has fingerprint 0. A text of fewer than
    ``width`` words is one shingle. Repeated rows and null ids stay as they are.
    """
    tune(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([int(fingerprint_words(shingles.shingle_hashes(t, width)).view(np.int64)[0]) for t in texts], dtype="int64")

    return docs.select(F.col(doc_id).alias("doc_id"), fp(F.col(text)).alias("fp"))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Vertical layout of (n,) or (n, words) fingerprints: plane j holds bit j of all of them, 64 to a word."""
    fps = fps.reshape(len(fps), -1)
    padded = np.zeros((-(-len(fps) // 64) * 64, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


class Distances:
    """Bit-sliced counters of many distances at once, a lane of a word for each, which tell those over ``radius``.

    Planes of differences are added by carry-save adders: two planes and a counter's bit give the bit and one carry, so most
    planes never reach the higher bits. Counters begin so that the first count over the radius carries out of the top.
    """

    def __init__(self, shape: tuple[int, ...], radius: int):
        depth = max(1, radius.bit_length())
        begin = (1 << depth) - 1 - radius
        self.bits = [np.full(shape, ALL if begin >> k & 1 else 0, np.uint64) for k in range(depth)]
        self.held: list[np.ndarray | None] = [None] * depth
        self.over = np.zeros(shape, np.uint64)

    def add(self, plane: np.ndarray) -> None:
        for level, other in enumerate(self.held):
            if other is None:
                self.held[level] = plane
                return
            mixed, c = other ^ plane, self.bits[level]
            self.bits[level], plane = c ^ mixed, (other & plane) | (c & mixed)
            self.held[level] = None
        self.over |= plane

    def settle(self) -> np.ndarray:
        """Adds what is held back; lanes that are over the radius."""
        for level, carry in enumerate(self.held):
            if carry is not None:
                self.held[level] = None
                for k in range(level, len(self.bits)):
                    c = self.bits[k]
                    self.bits[k], carry = c ^ carry, c & carry
                self.over |= carry
        return self.over

    def keep(self, lanes: np.ndarray) -> None:
        """Abandons all other blocks of lanes; nothing may be held back."""
        self.bits, self.over = [c[..., lanes] for c in self.bits], self.over[..., lanes]


def near(queries: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, lane) within ``radius`` bits.

    The distances of a query to 64 lanes at a time are counted bit by bit; every so many planes, the blocks of 64 lanes
    that are over the radius for all queries are abandoned.
    """
    queries = queries.reshape(len(queries), -1)
    alive = np.arange(planes.shape[1])
    counted = Distances((len(queries), len(alive)), radius)
    for j in range(len(planes)):
        flip = np.uint64(0) - ((queries[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1))
        counted.add(planes[j][alive][None, :] ^ flip[:, None])
        if j % 8 == 7 and j >= radius:
            keep = (counted.settle() != ALL).any(axis=0)
            if not keep.all():
                alive = alive[keep]
                counted.keep(keep)
                if not len(alive):
                    return np.empty(0, np.int64), np.empty(0, np.int64)
    hits = np.unpackbits(np.ascontiguousarray(~counted.settle()).view(np.uint8), axis=1, bitorder="little")
    q, lane = np.nonzero(hits)
    return q, alive[lane // 64] * 64 + lane % 64


def near_pairs(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs of places (a, b) are within ``radius`` bits; a lane for each pair."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), 1 << 15):
        differ = bit_planes(fps[a[i : i + (1 << 15)]] ^ fps[b[i : i + (1 << 15)]])
        alive = np.arange(differ.shape[1])
        counted = Distances(alive.shape, radius)
        for j in range(len(differ)):
            counted.add(differ[j][alive])
            if j % 8 == 7 and j >= radius:
                keep = counted.settle() != ALL
                if not keep.all():
                    alive = alive[keep]
                    counted.keep(keep)
        lanes = np.zeros((differ.shape[1], 64), np.uint8)
        lanes[alive] = np.unpackbits((~counted.settle())[:, None].view(np.uint8), axis=1, bitorder="little")
        out[i : i + (1 << 15)] = lanes.ravel()[: len(a) - i].astype(bool)
    return out


def star_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of places that join the fingerprints exactly as all pairs within ``radius`` would: one for each but the first of a group."""
    planes, n = bit_planes(fps), len(fps)
    found = [near(fps[i : i + 64], planes, radius) for i in range(0, n, 64)]
    a = np.concatenate([q + 64 * k for k, (q, _) in enumerate(found)])
    b = np.concatenate([lane for _, lane in found])
    real = (b < n) & (a != b)
    label = star_labels(n, a[real], b[real])
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def compare_fingerprints(column: str, radius: int):
    """A comparison of ``group_links``: fingerprints within ``radius`` bits. The column holds longs or the bytes of several words."""

    def matrix(values: pd.Series) -> np.ndarray:
        if values.dtype == np.int64:
            return values.to_numpy().view(np.uint64)[:, None]
        return np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1)

    def compare(frame: pd.DataFrame, starts: np.ndarray, asks: bool) -> tuple[np.ndarray, np.ndarray]:
        fps, found = matrix(frame[column]), []
        size = np.diff(starts)
        if asks:
            asking, label = frame["asks"].to_numpy(bool), frame["label"].to_numpy()
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                planes, mine = bit_planes(fps[s:e]), s + np.flatnonzero(asking[s:e])
                for i in range(0, len(mine), 64):
                    q, lane = near(fps[mine[i : i + 64]], planes, radius)
                    q, lane = q[lane < e - s], lane[lane < e - s]
                    pairs = pd.DataFrame({"a": mine[i : i + 64][q], "b": s + lane, "of": label[s + lane]})
                    pairs = pairs[label[pairs["a"]] != pairs["of"]].drop_duplicates(["a", "of"])
                    found.append((pairs["a"].to_numpy(), pairs["b"].to_numpy()))
        else:
            end = np.repeat(starts[1:], size)
            place = np.flatnonzero(np.repeat(size <= FEW, size))
            for d in range(1, min(FEW, int(size.max(initial=0)))):
                place = place[place + d < end[place]]
                if not len(place):
                    break
                hit = near_pairs(fps, place, place + d, radius)
                found.append((place[hit], place[hit] + d))
            for g in np.flatnonzero(size > FEW).tolist():
                a, b = star_links(fps[starts[g] : starts[g + 1]], radius)
                found.append((starts[g] + a, starts[g] + b))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, int) for k in (0, 1))

    return compare


def _blocks(radius: int, spare: int) -> list[int]:
    """Masks: of radius + spare blocks of bits, two fingerprints within the radius agree in some ``spare`` of them."""
    edges = np.linspace(0, 64, radius + spare + 1).round().astype(int)
    blocks = [sum(1 << int(j) for j in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, spare)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint_links(distinct: DataFrame, radius: int = 3, spare: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that give the same components as all pairs within ``radius``.

    Each fingerprint goes to the buckets of its C(radius + spare, spare) masked forms; buckets of one are dropped.
    """
    tables = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(_blocks(radius, spare))])
    placed = distinct.select(F.col("fp").alias("node"), F.explode(tables).alias("b")).select("node", "b.t", "b.key")
    return group_links(placed, ["t", "key"], CHUNK, compare_fingerprints("node", radius))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component): documents joined by chains of fingerprints that differ in at most ``radius`` bits.

    The component is the smallest doc_id reachable, the document's own included. One row comes out for each row
    that goes in. Documents without words all have fingerprint 0, which links like any other. A null id takes
    no part in the smallest; a component of null ids alone has a null component. Ids may be of any type that has an
    order. Rows of one id with different texts are documents of their own. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, doc_id, text, width), "fingerprints")
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = materialize(fingerprint_links(groups.select("fp"), radius), "fingerprint-links")
    named = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = groups.join(named, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "of")
    labels = rooted.join(smallest, F.col("root") == F.col("of")).select(F.col("fp").alias("of_fp"), "component")
    return prints.join(labels, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component")


def text_key(text: Column) -> Column:
    """Tells texts apart, by 128 bits."""
    known = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(known).alias("a"), F.xxhash64(F.lit(1), known).alias("b"))


def shingle_prints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, th, fp, check, bands, sim) for every document: key of the text, two digests of its set of shingles, keys of its bands, the wide fingerprint of the set."""
    tune(docs.sparkSession)

    @F.pandas_udf(T.StructType().add("fp", T.LongType()).add("check", T.LongType()).add("bands", T.ArrayType(T.LongType())).add("sim", T.BinaryType()))
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingles.shingle_set(t, WIDTH)
            rows.append((shingles.digest(s), shingles.digest(s, 8), shingles.band_keys(s) if len(s) else np.empty(0, np.int64), fingerprint_words(s, WORDS).tobytes()))
        return pd.DataFrame(rows, columns=["fp", "check", "bands", "sim"])

    return docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("th"), of(F.col(text)).alias("p")).select("doc_id", "th", "p.*")


def shingle_nodes(rows: DataFrame) -> DataFrame:
    """(fp, th, bands, sim, low, high) of each digest; low and high differ if sets with different second digests have it."""
    return rows.where("fp != 0").groupBy("fp").agg(F.min("th").alias("th"), F.first("bands").alias("bands"), F.first("sim").alias("sim"), F.min("check").alias("low"), F.max("check").alias("high"))


def told_apart(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows with another digest, of both together, where different sets share the first."""
    shared = nodes.where("low != high").select(F.col("fp").alias("shared"))
    joined = rows.join(shared, F.col("fp") == F.col("shared"), "left")
    return joined.withColumn("fp", F.when(F.col("shared").isNotNull(), F.xxhash64("check", "fp")).otherwise(F.col("fp"))).drop("shared")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, th, root, component): documents joined by chains of pairs whose five-word shingles have a Jaccard similarity of ``least`` or more.

    Documents that share a minhash band are compared by their fingerprints of 128 bits, bit-sliced. Two sets of a
    similarity of 0.8 differ in 19 of them on average; beyond RADIUS a pair is passed over (fewer than 1 in 100,000 of long
    texts, of the shortest, 4 shingles against 5, 1 in 1,000). What is left gives rough groups, in which whole shingle sets are compared exactly.

    One row comes out for each row that goes in. ``root`` names the group, ``component`` is its smallest doc_id, null if
    all are null; ``th`` is the ``text_key``. Texts without words are one group. ``least`` may not be less than SIMILARITY,
    for which the bands are made.
    """
    if least < SIMILARITY:
        raise ValueError("the bands are too narrow for that similarity")
    rows = materialize(shingle_prints(docs, doc_id, text), "shingle-prints")
    nodes = materialize(shingle_nodes(rows), "shingle-nodes")
    if not nodes.where("low != high").isEmpty():  # different sets of one digest: about 270 pairs among 10^11
        rows = materialize(told_apart(rows, nodes), "shingle-prints")
        nodes = materialize(shingle_nodes(rows), "shingle-nodes")
    placed = nodes.select(F.col("fp").alias("node"), "sim", F.explode(F.array_distinct("bands")).alias("key"))
    rough = group_links(placed, ["key"], CHUNK, compare_fingerprints("sim", RADIUS))
    rough = components(rough.select(F.col("a").alias("u"), F.col("b").alias("v")))
    members = materialize(nodes.select("fp", "th").join(rough, F.col("fp") == F.col("node")).select("fp", "th", F.col("component").alias("g")), "rough-groups")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles.shingle_set(t, WIDTH).view(np.int64) for t in texts])

    # Copies of a text meet in each task before they are shuffled, so that a text of very many rows fills no task.
    texts = docs.select(text_key(F.col(text)).alias("of"), F.col(text).alias("x")).dropDuplicates(["of"])
    grouped = members.join(texts, F.col("th") == F.col("of")).select("g", F.col("fp").alias("node"), sets("x").alias("s"))
    grouped = materialize(grouped, "shingle-sets")

    def compare(frame: pd.DataFrame, starts: np.ndarray, asks: bool) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        asking, label = (frame["asks"].to_numpy(bool), frame["label"].to_numpy()) if asks else (None, None)
        every = [np.asarray(s, np.int64) for s in frame["s"]]
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            i, j = shingles.similar(every[s:e], least, *((asking[s:e], label[s:e]) if asks else ()))
            a += [s + x for x in i]
            b += [s + x for x in j]
        return np.array(a, int), np.array(b, int)

    links = group_links(grouped, ["g"], SETS, compare, F.size("s"), SHINGLES, batch=1)
    named = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = rows.select("doc_id", "th", "fp").join(named.select("node", F.col("component").alias("r")), F.col("fp") == F.col("node"), "left")
    rooted = materialize(rooted.select("doc_id", "th", F.coalesce("r", "fp").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component")).withColumnRenamed("root", "of")
    return rooted.join(smallest, F.col("root") == F.col("of")).select("doc_id", "th", "root", "component")
