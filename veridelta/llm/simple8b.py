"""Token ids in Simple-8b files: 64-bit words whose selectors pack varying counts of ids, in ascending doc_id order.

A file holds, little-endian throughout:

    "S8BIDS01"                     magic
    words  u64[]                   Simple-8b words, each block from a new word on
    blocks u64[n_blocks + 1]       word index where each block begins, and the end
    doc_ids i64[n_docs], has_id u8[n_docs], lengths u32[n_docs]
    tail   u64[5]                  words, blocks, documents, ids, ids in a block
    "S8BIDS01"

A word's top four bits are its selector. Selectors 1 to 14 pack 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1
ids of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30 or 60 bits. Selector 0 is the escape: the low bits count the raw
64-bit ids in the words that follow it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, open_shared, public_vocabulary, shared_path, tune

MAGIC = b"S8BIDS01"
#: (ids in a word, bits of an id) by selector; the first is the escape.
LAYOUT = [(0, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
#: Ids that a step over a word of each selector passes.
COUNTS = np.array([c or 1 for c, _ in LAYOUT])
#: Ids in a block.
BLOCK = 1 << 16


def selector_rank(bits: int) -> int:
    """How many of the layout's widths an id of at most ``bits`` bits is too wide for."""
    return sum(b < bits for b in {b for _, b in LAYOUT})


#: The rank of every id of up to 20 bits.
WIDTHS = np.array([selector_rank(b) for b in range(21)], np.uint8)[np.concatenate([[0], *[np.full(1 << b, b + 1) for b in range(20)]])]


def encode(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of a block of unsigned ids.

    From every position the longest word that fits is found at once, by the selectors' widths; then the
    words are walked from the first. The last word of a block may be filled up with zeros: decoding stops at
    the block's count.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    padded = np.append(ids, np.zeros(64, np.uint64))  # what follows the last id fits anywhere
    widths = np.zeros(n + 64, np.uint8)
    if int(ids.max()) < len(WIDTHS):
        widths[:n] = WIDTHS[ids]
    else:
        for bits in sorted({b for _, b in LAYOUT}):
            widths += padded >> np.uint64(bits) != 0
    chosen = np.zeros(n, np.uint8)
    widest, span = widths, 1  # the widest id among the `span` from a position on
    for selector in range(len(LAYOUT) - 1, 0, -1):  # more ids in a word replace fewer
        count, bits = LAYOUT[selector]
        while span < count:
            step = min(span, count - span)
            widest = np.maximum(widest[:-step], widest[step:])
            span += step
        chosen[widest[:n] <= selector_rank(bits)] = selector
    steps, where, i = COUNTS[chosen].tolist(), [], 0
    while i < n:
        where.append(i)
        i += steps[i]
    at = np.array(where)
    selectors = chosen[at]
    words = np.zeros(len(at), np.uint64)
    for selector in range(1, len(LAYOUT)):
        mine = np.flatnonzero(selectors == selector)
        if len(mine):
            count, bits = LAYOUT[selector]
            value = np.full(len(mine), selector << 60, np.uint64)
            first = at[mine]
            for k in range(count):
                value |= padded[first + k] << np.uint64(bits * k)
            words[mine] = value
    raw = np.flatnonzero(selectors == 0)
    if len(raw):  # each escaped id: a word that counts one, then the id
        words[raw] = 1
        words = np.insert(words, raw + 1, ids[at[raw]])
    return words


def decode(words: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` ids of a block's words, all words of a selector at a time."""
    words = np.asarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    escapes = np.flatnonzero(selectors == 0)
    raw = np.zeros(len(words), bool)
    if len(escapes):  # a raw word may look like an escape; walk those few
        k = 0
        while k < len(escapes):
            e = escapes[k]
            n = int(words[e])
            raw[e + 1 : e + 1 + n] = True
            k = int(np.searchsorted(escapes, e + 1 + n))
    many = np.array([c for c, _ in LAYOUT] + [0])[selectors]
    if len(escapes):
        many = np.where(raw, 1, many)
    ends = np.cumsum(many)
    starts = ends - many
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for selector in range(1, len(LAYOUT)):
        mine = np.flatnonzero((selectors == selector) & ~raw)
        if len(mine):
            n, bits = LAYOUT[selector]
            mask = np.uint64((1 << bits) - 1)
            for k in range(n):
                out[starts[mine] + k] = (words[mine] >> np.uint64(bits * k)) & mask
    if raw.any():
        out[starts[raw]] = words[raw]
    return out[:count]


def write_file(path: str, documents: Iterator[tuple[int | None, np.ndarray]]) -> tuple[int, int, int]:
    """Writes documents (id or None, ids) to one file as they come, a block of ids in memory; returns documents, ids, words."""
    held, in_hand, blocks, words, total = [], 0, [0], 0, 0
    doc_ids, has_id, lengths = [], [], []
    with open_shared(path, "w") as out:
        out.write(MAGIC)
        for doc_id, ids in chain(documents, [(None, None)]):
            if ids is not None:
                doc_ids.append(doc_id or 0)
                has_id.append(doc_id is not None)
                lengths.append(len(ids))
                held.append(ids)
                in_hand += len(ids)
                total += len(ids)
            while in_hand >= BLOCK or (ids is None and in_hand):
                everything = np.concatenate(held)
                packed = encode(everything[:BLOCK])
                out.write(packed.astype("<u8").tobytes())
                words += len(packed)
                blocks.append(words)
                held, in_hand = [everything[BLOCK:]], max(0, in_hand - BLOCK)
        for values, kind in ((blocks, "<u8"), (doc_ids, "<i8"), (has_id, "<u1"), (lengths, "<u4"), ([words, len(blocks) - 1, len(doc_ids), total, BLOCK], "<u8")):
            out.write(np.array(values, kind).tobytes())
        out.write(MAGIC)
    return len(doc_ids), total, words


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file in order, (id or None, ids), a block in memory at a time besides the document in hand."""
    with open_shared(path, "r") as f:
        f.seek(f.size() - 48)
        tail = f.read(48)
        if tail[40:] != MAGIC:
            raise ValueError(f"{path} is no Simple-8b id file")
        words, n_blocks, docs, total, size = (int(x) for x in np.frombuffer(tail[:40], "<u8"))
        f.seek(8 + 8 * words)
        blocks = np.frombuffer(f.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        doc_ids, has_id, lengths = (np.frombuffer(f.read(docs * w), k) for w, k in ((8, "<i8"), (1, "<u1"), (4, "<u4")))
        left, block, rest = total, 0, np.empty(0, np.uint64)
        for doc_id, known, length in zip(doc_ids.tolist(), has_id.tolist(), lengths.tolist(), strict=True):
            parts, have = [rest], len(rest)
            while have < length:
                f.seek(8 + 8 * int(blocks[block]))
                got = decode(np.frombuffer(f.read(8 * int(blocks[block + 1] - blocks[block])), "<u8"), min(size, left))
                parts.append(got)
                have, left, block = have + len(got), left - len(got), block + 1
            whole = np.concatenate(parts) if len(parts) > 1 else rest
            yield (doc_id if known else None), whole[:length]
            rest = whole[length:]


def write_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = 2) -> DataFrame:
    """Tokenizes whole texts and writes them as Simple-8b files in ascending doc_id order, null ids first.

    Returns the manifest (shard, path, n_docs, n_ids, n_words); it names the files of finished tasks alone, so
    what a lost or repeated task has left behind is never read. Ids are whole numbers of up to 64 bits; what can't be cast to them is an error. Texts are ranged by id before they are tokenized;
    equal ids are ranged by their texts, so that one repeated id fills no task alone.
    """
    spark = docs.sparkSession
    tune(spark)
    path, folder = vocabulary or public_vocabulary("word_bpe_49k.json"), shared_path(spark, "simple8b")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from .tokens import word_ids

        encoder, last = word_ids(path), np.array([end], "<u4")

        def documents():
            for frame in frames:
                for key, has, body in zip(frame["doc_id"].tolist(), frame["known"].tolist(), frame["text"].tolist(), strict=True):
                    yield (key if has else None), np.concatenate([np.frombuffer(encoder(body), "<u4"), last])

        shard = TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.s8b"
        yield pd.DataFrame([(shard, name, *write_file(name, documents()))], columns=["shard", "path", "n_docs", "n_ids", "n_words"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    dealt = dealt.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")  # no null, so ids stay whole numbers
    return materialize(dealt.mapInPandas(write, "shard int, path string, n_docs long, n_ids long, n_words long"), "manifest")


def read_ids(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files, one task for each file."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).alias("start"))  # one row a file
    count = max(1, manifest.count())

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start in zip(frame["path"].tolist(), frame["start"].tolist(), strict=True):
                rows = []
                for key, ids in read_file(path):
                    data = ids.astype("<u4").tobytes()
                    rows.append((key, start, len(ids), zlib.crc32(data), *([ids.astype(np.int64)] if with_ids else [])))
                    start += len(ids)
                    if len(rows) == 5000:
                        yield table_of(rows)
                        rows = []
                yield table_of(rows)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def table_of(rows: list) -> pd.DataFrame:
        return pd.DataFrame({n: pd.array([r[k] for r in rows], dtype="Int64") if n == "doc_id" else pd.Series([r[k] for r in rows], dtype=object if n == "ids" else "int64") for k, n in enumerate(names)})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return files.repartitionByRange(count, "shard").mapInPandas(read, schema)
