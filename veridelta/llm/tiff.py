"""TIFF: image directories, strips and tiles, PackBits, LZW and deflate, predictors; a row for each page.

Reads baseline grey and colour images of 8 or 16-bit samples, little- and big-endian; writes grey pages of 8-bit samples.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tune

#: Fixed values of the TIFF 6.0 format and its technical notes: tags, field sizes by type, compressions.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
LZW_CLEAR, LZW_END = 256, 257
#: Bytes of samples that a byte of packed data can stand for, and more than any of the codecs reach.
MOST_PACKED = 4096
#: Bytes in a row of a stored payload, rows in a strip, and rows in a page.
ROW, STRIP_ROWS, PAGE_ROWS = 64, 256, 1 << 14


def unpack_bits(data: bytes) -> bytes:
    """PackBits: a count n from 0 is followed by n + 1 bytes, from -127 to -1 by one byte to repeat 1 - n times."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
                i += 1
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of three and more are repeated, the rest is written out."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run >= 3:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 2 < n and data[i] == data[i + 1] == data[i + 2]):
            i += 1
        out += bytes((i - start - 1,)) + data[start:i]
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, one code before the table would need it."""
    out, table, width, last = [], [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
    held, have = 0, 0
    for byte in data:
        held, have = (held << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = held >> have & ((1 << width) - 1)
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("a damaged LZW strip")
        out.append(entry)
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW; the table is cleared when it is nearly full."""
    out, held, have = bytearray(), 0, 0

    def emit(code: int, width: int) -> None:
        nonlocal held, have
        held, have = held << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(held >> have & 255)
        held &= (1 << have) - 1

    fresh = {bytes((i,)): i for i in range(256)}
    table, size, width, word = dict(fresh), 258, 9, b""
    emit(LZW_CLEAR, width)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        emit(table[word], width)
        table[longer] = size
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if size >= 4094:
            emit(LZW_CLEAR, width)
            table, size, width = dict(fresh), 258, 9
        word = data[i : i + 1]
    if word:
        emit(table[word], width)
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    emit(LZW_END, width)
    if have:
        out.append(held << (8 - have) & 255)
    return bytes(out)


DECODERS = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}
ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda data: zlib.compress(data, 1), PACKBITS: pack_bits}


class Page:
    """An image directory: tag -> values, and the samples that its strips or tiles hold."""

    def __init__(self, data: bytes, order: str, at: int):
        self.data, self.order, self.tags = data, order, {}
        (count,) = struct.unpack_from(order + "H", data, at)
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = FIELD_SIZES.get(kind, 0) * n
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if kind in (1, 3, 4):
                self.tags[tag] = struct.unpack_from(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }".replace(" ", ""), data, where)
        (self.next,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)

    def one(self, tag: int, default: int | None = None) -> int:
        found = self.tags.get(tag)
        if not found and default is None:
            raise ValueError(f"a page lacks tag {tag}")
        return found[0] if found else default

    def many(self, tag: int) -> list[int]:
        """All values of a tag that a page must have."""
        self.one(tag)
        return self.tags[tag]

    def samples(self) -> np.ndarray:
        """(rows, columns, samples) of the page."""
        width, length, per = self.one(WIDTH), self.one(LENGTH), self.one(SAMPLES, 1)
        bits, predictor = self.one(BITS, 1), self.one(PREDICTOR, 1)
        decoder = DECODERS.get(self.one(COMPRESSION, NONE))
        if bits not in (8, 16) or predictor not in (1, 2) or decoder is None or (per > 1 and self.one(PLANAR, 1) != 1):
            raise ValueError("a page of a kind that is not read")
        kind = np.dtype(np.uint8 if bits == 8 else np.uint16).newbyteorder(self.order)
        if TILE_OFFSETS in self.tags:
            wide, high = self.one(TILE_WIDTH), self.one(TILE_LENGTH)
            offsets, sizes = self.many(TILE_OFFSETS), self.many(TILE_BYTES)
            across = -(-width // max(1, wide))
            parts, down = [(k // across * high, k % across * wide, high, wide) for k in range(len(offsets))] if across else [], len(offsets) // max(1, across)
        else:
            high = min(self.one(ROWS_PER_STRIP, length), length) or 1
            offsets, sizes = self.many(STRIP_OFFSETS), self.many(STRIP_BYTES)
            parts, down = [(k * high, 0, min(high, length - k * high), width) for k in range(len(offsets))], len(offsets)
        if not (0 < length <= down * high and width > 0) or length * width * per * kind.itemsize > MOST_PACKED * (sum(sizes) + 1):
            raise ValueError("a page is said to be larger than its data can be")
        out = np.zeros((length, width, per), kind.newbyteorder("="))
        for (top, left, rows, columns), at, size in zip(parts, offsets, sizes, strict=True):
            raw = decoder(self.data[at : at + size])
            block = np.frombuffer(raw, kind, rows * columns * per).reshape(rows, columns, per).astype(out.dtype)
            if predictor == 2:
                block = np.add.accumulate(block, axis=1, dtype=out.dtype)
            out[top : top + rows, left : left + columns] = block[: length - top, : width - left]
        return out


def pages_of(data: bytes) -> Iterator[Page]:
    """Walks the chain of image directories; a loop in it is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a loop")
        seen.add(at)
        page = Page(data, order, at)
        yield page
        at = page.next


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian TIFF of grey 8-bit pages, in strips, or in tiles of (rows, columns)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in pages:
        length, width = image.shape
        if tile:
            high, wide = tile
            blocks = []
            for top in range(0, length, high):
                for left in range(0, width, wide):
                    part = image[top : top + high, left : left + wide]
                    blocks.append(np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1])), mode="edge"))
        else:
            blocks = [image[top : top + strip_rows] for top in range(0, length, strip_rows)]
        if predictor == 2:
            blocks = [np.diff(b, axis=1, prepend=np.zeros((len(b), 1), np.uint8)) for b in blocks]
        offsets, sizes = [], []
        for b in blocks:
            packed = ENCODERS[compression](np.ascontiguousarray(b).tobytes())
            offsets.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        fields = {WIDTH: [width], LENGTH: [length], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [tile[1]], TILE_LENGTH: [tile[0]], TILE_OFFSETS: offsets, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [strip_rows], STRIP_BYTES: sizes}
        placed = {}
        for tag, values in fields.items():
            if len(values) > 1:
                placed[tag] = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields))
        for tag in sorted(fields):
            out += struct.pack("<HHII", tag, 4, len(fields[tag]), placed.get(tag, fields[tag][0]))
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def layout(payload: bytes) -> dict:
    """Compression, predictor and tiles of a payload, by its checksum alone: every kind that is written, the slow ones seldom."""
    kind = zlib.crc32(payload) % 64
    if kind < 4:
        return [{"compression": LZW}, {"compression": PACKBITS}, {"compression": LZW, "predictor": 2}, {"compression": PACKBITS, "tile": (16, ROW)}][kind]
    return {"compression": DEFLATE, "predictor": 1 + kind % 8 // 7, "tile": (16, ROW) if kind % 16 == 4 else None}


def store_payload(payload: bytes, **how) -> bytes:
    """A payload of a multiple of ROW bytes as a TIFF: ROW samples to a row, PAGE_ROWS rows to a page; laid out as ``layout`` or ``how`` says."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return write_tiff([image[i : i + PAGE_ROWS] for i in range(0, len(image), PAGE_ROWS)], **(how or layout(payload)))


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, with zeros up to a positive multiple of ROW bytes, in a TIFF.

    A null text is empty: one row of zeros. Repeated rows stay; equal texts have equal media.
    """
    tune(docs.sparkSession)

    @F.pandas_udf(T.BinaryType())
    def media(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> bytes:
            raw = (t or "").encode("utf-8")
            return store_payload(raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW)), **how)

        return pd.Series([one(t) for t in texts])

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), size.alias("n_bytes"), media(F.col(text)).alias("media"))


def features_of(samples: np.ndarray) -> str:
    """Mean, spread, entropy in bits, and share of zero samples, of a page or a file."""
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256).astype(np.float64)
    n = max(1.0, counts.sum())
    p = counts / n
    value = np.arange(len(counts))
    mean = float(p @ value)
    spread = float(np.sqrt(max(0.0, p @ (value - mean) ** 2)))
    some = p[p > 0]
    return f"mean={mean:.4f};std={spread:.4f};entropy={-(some * np.log2(some)).sum():.4f};zeros={p[0]:.4f}"


_PAGE = [("page", "int"), ("width", "int"), ("height", "int"), ("samples", "int"), ("bits", "int"), ("compression", "int"), ("predictor", "int"), ("pixels", "binary"), ("feature", "string"), ("error", "string")]


def pages(media: Column) -> Column:
    """An array of a file's pages, of structs as in ``read_pages``."""
    names = [n for n, _ in _PAGE]

    @F.pandas_udf("array<struct<" + ",".join(f"{n}:{t}" for n, t in _PAGE) + ">>")
    def walk(files: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> list[dict]:
            if data is None:
                return []
            try:
                rows = []
                for k, p in enumerate(pages_of(bytes(data))):
                    got = p.samples()
                    pixels = got.astype(got.dtype.newbyteorder("<")).tobytes()
                    rows.append(dict(zip(names, (k, got.shape[1], got.shape[0], got.shape[2], p.one(BITS, 1), p.one(COMPRESSION, 1), p.one(PREDICTOR, 1), pixels, features_of(got), None), strict=True)))
                return rows
            except (ValueError, KeyError, struct.error, zlib.error, IndexError, TypeError, OverflowError) as e:
                return [dict.fromkeys(names) | {"page": -1, "error": str(e)}]

        return pd.Series([one(f) for f in files])

    return walk(media)


def read_pages(media: DataFrame, key: str = "doc_id", column: str = "media", extra: list[str] | None = None) -> DataFrame:
    """One row a page: (key, page, width, height, samples, bits, compression, predictor, pixels, feature, error[, extra]).

    ``pixels`` is the page's samples in rows, little-endian. A null file gives no page; one that can't be read gives a
    row with the pages before the fault left out, page -1 and the error. Nothing fails for a damaged file: a page
    that is said to be larger than its data can be is not read.
    """
    tune(media.sparkSession)
    extra = extra or []
    return media.select(F.col(key).alias(key), *extra, F.explode(pages(F.col(column))).alias("__p")).select(key, *extra, *[F.col(f"__p.{n}").alias(n) for n, _ in _PAGE])


def payload_digest(pixels: Column) -> dict[str, Column]:
    """Columns of a payload read back from one or more pages in order."""
    return {"payload_bytes": F.octet_length(pixels).cast("long"), "payload_sha256": F.sha2(pixels, 256), "tail_crc32": F.crc32(F.substring(pixels, -ROW, ROW))}


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text as a TIFF, reads its pages back from the stored bytes as ``read_pages`` does, and joins a file's pages in their order.

    One row out for each row in: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, pages). A document's pages never leave its row, so nothing is shuffled.
    """
    stored = store_texts(docs, doc_id, text)
    got = stored.withColumn("pages", pages(F.col("media")))
    joined = F.when(F.size("pages") == 1, F.get("pages", F.lit(0))["pixels"]).otherwise(F.aggregate("pages", F.lit(b""), lambda whole, p: F.concat(whole, p["pixels"])))
    got = got.withColumn("payload", joined)
    return got.select(
        "doc_id", "n_bytes", *[c.alias(n) for n, c in payload_digest(F.col("payload")).items()], F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.array_join(F.transform("pages", lambda p: p["feature"]), "|").alias("feature"), F.size("pages").alias("pages"),
    )
