"""Packing documents into sequences: linear grouping, configurations of few sizes, then best fit.

The plan depends on the histogram of lengths alone, and lengths are whole numbers up to the capacity, so
the driver handles at most ``capacity`` counts at any scale. Documents take the plan's places by their
rank among those of the same length, which Spark finds in two levels without gathering a length in a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, public_vocabulary, running_total, tune

#: Groups of equal cardinality that the large lengths are rounded up in.
GROUPS = 512
#: Lengths of at most this share of the capacity are small.
SMALL = 0.2
#: Configurations are optimised until no other fills a sequence to more than 1 + GAP times its price.
GAP = 1e-4
#: Configurations that one look at the prices brings in.
TOGETHER = 8


@dataclass
class Plan:
    """Segments: ``count`` items of ``length`` from rank ``rank`` on go to sequences seq, seq + 1, ... at ``offset``."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    seq: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0


def linear_groups(large: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Cuts the lengths, longest first, into groups of equal cardinality: each a list of [length, count]."""
    total = sum(large.values())
    bounds = [round(total * (g + 1) / groups) for g in range(groups)]
    found: list[list[list[int]]] = [[] for _ in range(groups)]
    done = g = 0
    for length in sorted(large, reverse=True):
        left = large[length]
        while left:
            while bounds[g] <= done:
                g += 1
            take = min(left, bounds[g] - done)
            found[g].append([length, take])
            done, left = done + take, left - take
    return [g for g in found if g]


class Fillings:
    """Best fillings of a sequence with at most four items, which are all that fit if every size is over a fifth of the capacity."""

    def __init__(self, sizes: list[int], capacity: int):
        self.n, self.capacity = len(sizes), capacity
        size = np.array([*sizes, 0])  # the last stands for no item
        i, j = np.triu_indices(self.n + 1)
        total = size[i] + size[j]
        order = np.argsort(total, kind="stable")[: int((total <= capacity).sum())]
        self.i, self.j, total = i[order], j[order], total[order]
        self.first = np.flatnonzero(np.r_[True, total[1:] != total[:-1]])
        self.end = np.r_[self.first[1:], len(total)]
        self.within = np.searchsorted(total[self.first], np.arange(capacity + 1), side="right") - 1

    def best(self, price: np.ndarray) -> list[tuple[float, list[int]]]:
        """The fillings that are worth most, by the best pairs for each way to halve the capacity: (worth, items)."""
        price = np.append(np.maximum(price, 0), 0.0)
        worth = price[self.i] + price[self.j]
        top = np.maximum.reduceat(worth, self.first)
        most = np.maximum.accumulate(top)
        where = np.maximum.accumulate(np.where(top >= most, np.arange(len(top)), 0))
        pair = most[self.within]
        half = np.arange(self.capacity // 2 + 1)
        both, found = pair[half] + pair[self.capacity - half], []
        for h in np.argsort(-both)[:TOGETHER].tolist():
            items: list[int] = []
            for space in (h, self.capacity - h):
                g = where[self.within[space]]
                k = self.first[g] + int(worth[self.first[g] : self.end[g]].argmax())
                items += [int(self.i[k]), int(self.j[k])]
            found.append((float(both[h]), [x for x in items if x < self.n]))
        return found


class Basis:
    """The basis of the configuration program, its inverse, and how often each configuration is used."""

    def __init__(self, sizes: list[int], demand: list[int], capacity: int):
        each = np.array([float(capacity // s) for s in sizes])
        self.columns, self.inverse = np.diag(each), np.diag(1 / each)
        self.need = np.array(demand, float)
        self.times, self.changes = self.need / each, 0

    def price(self) -> np.ndarray:
        return self.inverse.sum(axis=0)

    def enter(self, items: list[int]) -> None:
        """A configuration takes the place of the one that its use brings to nothing first."""
        way = self.inverse[:, items].sum(axis=1)
        up = way > 1e-9
        ratio = np.where(up, np.maximum(self.times, 0) / np.where(up, way, 1), np.inf)
        out = int(ratio.argmin())
        row = self.inverse[out] / way[out]
        self.inverse -= way[:, None] * row
        self.inverse[out] = row
        self.times = self.times - ratio[out] * way
        self.times[out] = ratio[out]
        self.columns[:, out] = np.bincount(items, minlength=len(self.need))
        self.changes += 1
        if self.changes % 100 == 0 and np.abs(np.einsum("ij,j->i", self.columns, self.times) - self.need).max() > 1e-6 * (1 + self.need.max()):
            self.inverse = np.linalg.inv(self.columns)  # rounding has added up
            self.times = np.einsum("ij,j->i", self.inverse, self.need)


def best_fit_fillings(sizes: list[int], demand: list[int], capacity: int) -> list[list[int]]:
    """The different fillings of best fit, longest first."""
    have, found = list(demand), []
    while any(have):
        items, space = [], capacity
        for k, s in enumerate(sizes):
            many = min(space // s, have[k])
            items += [k] * many
            space -= many * s
        count = {k: items.count(k) for k in items}
        times = min(have[k] // c for k, c in count.items())
        for k, c in count.items():
            have[k] -= times * c
        found.append(items)
    return found


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of the configuration program, by column generation: (items of each size, times) pairs.

    Sizes come in descending order, all over a fifth of the capacity. It starts from what best fit would fill. Then the dual
    prices of the present configurations go into ``Fillings``; those worth more than one sequence enter
    the basis. Stops within GAP of the optimum, or after ``rounds`` with a feasible solution that is near it.
    """
    basis, fillings = Basis(sizes, demand, capacity), Fillings(sizes, capacity)
    known = best_fit_fillings(sizes, demand, capacity)
    table = np.array([np.bincount(items, minlength=len(sizes)) for items in known], float)
    for _ in range(2 * len(known)):
        worth = np.einsum("ij,j->i", table, basis.price())
        if worth.max() <= 1 + GAP:
            break
        basis.enter(known[int(worth.argmax())])
    for _ in range(rounds):
        found = fillings.best(basis.price())
        if found[0][0] <= 1 + GAP:
            break
        for k, (_, items) in enumerate(found):
            if not k or basis.price()[items].sum() > 1 + GAP:
                basis.enter(items)
    return [(basis.columns[:, k].round().astype(int), float(t)) for k, t in enumerate(basis.times) if t > 1e-9]


def whole_configurations(found: list[tuple[np.ndarray, float]], demand: list[int]) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of sequences: the fractional ones rounded down, then once more each that what is left still asks for, largest fraction first."""
    left, times = np.array(demand), []
    for items, t in found:
        times.append(int(t + 1e-9))
        left = left - times[-1] * items
    for k in sorted(range(len(found)), key=lambda k: times[k] - found[k][1]):
        items, t = found[k]
        if t - times[k] > 1e-9 and (left >= items).all():
            times[k] += 1
            left = left - items
    return [(items, n) for (items, _), n in zip(found, times, strict=True) if n]


def make_plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, small: float = SMALL) -> Plan:
    """A place for every item of a histogram of lengths from 1 to ``capacity``.

    Sequences are opened by the configurations of the rounded sizes. A place takes the longest document that is no longer than
    its size; the last place of a sequence, and what space is left behind it, the longest that fits, so that what rounding up
    has set aside is used. Large documents that no sequence has taken and small ones follow by best fit, longest first.
    """
    plan = Plan()
    left = {k: v for k, v in histogram.items() if v}
    taken: dict[int, int] = {}
    free: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by space left: [first sequence, sequences]

    def assign(length: int, count: int, seq: int, offset: int) -> None:
        plan.length.append(length)
        plan.rank.append(taken.get(length, 0))
        plan.count.append(count)
        plan.seq.append(seq)
        plan.offset.append(offset)
        taken[length] = taken.get(length, 0) + count
        left[length] -= count

    large = {k: v for k, v in left.items() if k > small * capacity}
    merged: dict[int, int] = {}
    for g in linear_groups(large, groups):
        merged[g[0][0]] = merged.get(g[0][0], 0) + sum(c for _, c in g)  # rounded up to the group's longest
    sizes = sorted(merged, reverse=True)
    demand = [merged[s] for s in sizes]
    least = min(large, default=capacity + 1)

    def longest(limit: int) -> int | None:
        return next((k for k in range(limit, least - 1, -1) if left.get(k)), None)

    for items, count in whole_configurations(configurations(sizes, demand, capacity), demand) if sizes else []:
        places = [s for s, many in zip(sizes, items.tolist(), strict=True) for _ in range(many)]
        parts = [(plan.sequences, count, 0)]  # first sequence, sequences, space used
        opened, place = plan.sequences, 0
        while parts:
            after = []
            for seq, many, used in parts:
                limit = capacity - used if place >= len(places) - 1 else places[place]
                while many and (length := longest(limit)) is not None:
                    take = min(many, left[length])
                    assign(length, take, seq, used)
                    after.append((seq, take, used + length))
                    seq, many = seq + take, many - take
                    opened = max(opened, seq)
                if many and used:
                    free[capacity - used].append([seq, many])
            parts, place = after, place + 1
        plan.sequences = opened  # those that got no document were never opened
    for length in sorted((k for k, v in left.items() if v), reverse=True):
        while count := left[length]:
            space = next((r for r in range(length, capacity + 1) if free[r]), None)
            if space is None:
                new = -(-count // (capacity // length))
                free[capacity].append([plan.sequences, new])
                plan.sequences += new
                continue
            seq, many = free[space].pop()
            each = min(space // length, count)
            bins = min(many, count // each)
            if bins < many:
                free[space].append([seq + bins, many - bins])
            for j in range(each):
                assign(length, bins, seq, capacity - space + j * length)
            free[space - each * length].append([seq, bins])
    return plan


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and the end id, cut into pieces of ``capacity``; only the first may be shorter.

    A null text is empty, and still has its end id. Ids are whole numbers of up to 64 bits, or null; what can't be cast to them is an error.
    """
    import zlib

    path = vocabulary or public_vocabulary("byte_bpe_50k.json")
    tune(docs.sparkSession)

    @F.pandas_udf(T.ArrayType(T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("ids_crc32", T.LongType())))
    def cut(texts: pd.Series) -> pd.Series:
        from .tokens import byte_ids

        encode, rows = byte_ids(path), []
        for body in texts:
            ids = np.append(encode(body), np.uint32(end)).astype("<u4")
            first = len(ids) % capacity or capacity
            at = [0, *range(first, len(ids) + 1, capacity)]
            rows.append([{"start": s, "length": e - s, "ids_crc32": zlib.crc32(ids[s:e])} for s, e in zip(at, at[1:], strict=False)])
        return pd.Series(rows)

    each = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.posexplode(cut(F.col(text))).alias("piece", "p"))
    return each.select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32")


def place(pieces: DataFrame, capacity: int = 1024, groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """Adds sequence_id and offset to a table with columns doc_id, piece and length; read twice, so materialize what is dear.

    Rows of a length are ranked in parts by the hash of the whole row, so that equal or null ids don't meet in one part.
    Equal rows get places of their own. An empty table gives none. Lengths must be from 1 to ``capacity``.
    """
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = make_plan(counted, capacity, groups, small)
    length, rank = np.array(plan.length, np.int64), np.array(plan.rank, np.int64)
    order = np.lexsort((rank, length))
    length, rank, seq, offset = length[order], rank[order], np.array(plan.seq, np.int64)[order], np.array(plan.offset, np.int64)[order]

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def found(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        key = length * (1 << 50) + rank
        at = np.searchsorted(key, lengths.to_numpy() * (1 << 50) + ranks.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": seq[at] + ranks.to_numpy() - rank[at], "offset": offset[at]})

    parts = F.create_map(*[F.lit(x) for k, n in counted.items() for x in (int(k), int(n**0.5) + 1)]) if counted else F.create_map(F.lit(1), F.lit(1))
    salt = F.pmod(F.xxhash64(*pieces.columns), F.element_at(parts, F.col("length").cast("int")))
    ranked = running_total(pieces, ["length"], [F.col(c) for c in pieces.columns], F.lit(1), salt, "__rank")
    return ranked.withColumn("__at", found("length", "__rank")).select("*", "__at.sequence_id", "__at.offset").drop("__rank", "__at")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    Repeated rows are documents of their own, in places of their own. Texts that are null or empty are packed
    with their end id alone. A null doc_id stays null. An empty table gives no rows.
    """
    return place(materialize(token_pieces(docs, doc_id, text, vocabulary, end, capacity), "pieces"), capacity)
