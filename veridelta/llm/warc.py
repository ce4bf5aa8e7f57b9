"""WARC archives as a chunked record table: written and read as streams, one chunk of a payload in memory at a time.

Archives are ISO 28500 files, each record a gzip member of its own. The record table has a row for each chunk of a
record: its identifier, the chunk's number, its bytes, and the payload's digest and length so far.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, open_shared, shared_path, tune

#: Bytes of a payload in a chunk.
CHUNK = 1 << 20
#: Payloads below this many bytes are always written out.
LEAST_REVISIT = 100
SPACE = uuid.UUID("9b2f0a4e-6f0f-5b0c-9f4e-2c8f1d3a7b60")


def record_id(key: int) -> str:
    """The identifier of a record by its key: the same in every run, so that a revisit can name what it repeats."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, str(key))}>"


class Writer:
    """Appends records to a stream, each compressed as a gzip member."""

    def __init__(self, out):
        self.out = out

    def begin(self, headers: list[tuple[str, str]], length: int) -> None:
        """The header of a record whose block will have ``length`` bytes."""
        self.packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(length))]) + "\r\n"
        self.append(head.encode("utf-8"))

    def append(self, chunk: bytes) -> None:
        """More of the record's block."""
        self.out.write(self.packer.compress(chunk))

    def end(self) -> None:
        """The end of the record."""
        self.append(b"\r\n\r\n")
        self.out.write(self.packer.flush())

    def record(self, headers: list[tuple[str, str]], chunks: Iterable[bytes], length: int) -> None:
        """One record; the chunks' bytes are ``length`` together, and never joined."""
        self.begin(headers, length)
        for chunk in chunks:
            self.append(chunk)
        self.end()


class Reader:
    """Reads the records of an archive as a stream: plain, gzipped as a whole, or a gzip member for each record."""

    def __init__(self, stream, block: int = 1 << 16):
        self.stream, self.block, self.ready, self.packed, self.unpacker, self.plain = stream, block, b"", b"", None, None

    def fill(self) -> bool:
        """More plain bytes; False at the end."""
        while True:
            if not self.packed:
                self.packed = self.stream.read(self.block)
                if not self.packed:
                    rest = self.unpacker.flush() if self.unpacker is not None else b""
                    self.unpacker = None
                    self.ready += rest
                    return bool(rest)
            if self.plain is None:
                self.plain = self.packed[:2] != b"\x1f\x8b"
            if self.plain:
                self.ready, self.packed = self.ready + self.packed, b""
                return True
            if self.unpacker is None:
                self.unpacker = zlib.decompressobj(31)
            got = self.unpacker.decompress(self.packed, self.block)
            self.packed = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.packed, self.unpacker = self.unpacker.unused_data, None
            if got:
                self.ready += got
                return True

    def take(self, most: int) -> bytes:
        """Up to ``most`` bytes; fewer only at the end or where the buffer ends."""
        if not self.ready:
            self.fill()
        got, self.ready = self.ready[:most], self.ready[most:]
        return got

    def header(self) -> dict[str, str] | None:
        """The next record's headers, names in lower case; None at the end. A header may be of any length, but must begin as one."""
        while b"\r\n\r\n" not in (begun := self.ready.lstrip(b"\r\n")):
            if begun and not b"WARC/".startswith(begun[:5]):
                raise ValueError(f"no WARC record: {begun[:40]!r}")
            if not self.fill():
                if self.ready.strip():
                    raise ValueError("an archive ends within a header")
                return None
        head, _, self.ready = self.ready.lstrip(b"\r\n").partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def chunks(self, length: int, size: int) -> Iterator[bytes]:
        """The record's block in chunks of ``size`` bytes; at least one, which may be empty."""
        first = True
        while length or first:
            parts, have = [], 0
            while have < min(size, length):
                got = self.take(min(size, length) - have)
                if not got:
                    raise ValueError("an archive ends within a record")
                parts.append(got)
                have += len(got)
            length, first = length - have, False
            yield parts[0] if len(parts) == 1 else b"".join(parts)


def record_chunks(stream, size: int = CHUNK) -> Iterator[tuple]:
    """(headers, chunk number, bytes, payload length so far, digest so far, last) for each chunk of each record."""
    reader = Reader(stream)
    while (headers := reader.header()) is not None:
        digest, seen, left = hashlib.sha256(), 0, int(headers["content-length"])
        for number, chunk in enumerate(reader.chunks(left, size)):
            digest.update(chunk)
            seen += len(chunk)
            yield headers, number, chunk, seen, digest.hexdigest(), seen == left


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, n_bytes, refers_to): refers_to is the smallest page_id with an equal payload of at least ``least`` bytes.

    Revisits are resolved on ids and digests alone, short payloads left out: the smallest id of each digest by a partial
    aggregate, then the list of pages that repeat it. That list is written first, so Spark knows its size and
    sends it to the pages, which then don't move, if it is small; else it joins by page.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    narrow = materialize(rows.where((F.col("n_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest"), "payload-digests")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    again = narrow.join(first.withColumnRenamed("digest", "of"), (F.col("digest") == F.col("of")) & (F.col("page_id") > F.col("first")))
    again = materialize(again.select(F.col("page_id").alias("id"), F.xxhash64("digest").alias("key"), F.col("first").alias("refers_to")).distinct(), "revisits")
    named = rows.join(again, (F.col("page_id") == F.col("id")) & (F.xxhash64("digest") == F.col("key")), "left")
    return named.select("page_id", "url", "payload", "digest", "n_bytes", F.when(F.col("n_bytes") >= least, F.col("refers_to")).alias("refers_to"))


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for every row and returns the manifest (path, n_records) of the archives of finished tasks.

    A null html is an empty payload. Ids are whole numbers of up to 64 bits; what can't be cast to them is an error. Payloads
    come to the writer in chunks, a row for each. Rows with a null page_id, and all but one of equal rows with the same id, are
    records of their own. What a lost or repeated task left behind is in no manifest.
    """
    spark = pages.sparkSession
    tune(spark)
    folder = shared_path(spark, "warc")
    when = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, count, names = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, ("known", "key", "url", "digest", "n_bytes", "again", "first", "chunk", "data")
        with open_shared(name, "w") as out:
            writer = Writer(out)
            for frame in frames:
                for known, key, target, digest, n, again, first, chunk, data in zip(*(frame[c].tolist() for c in names), strict=True):
                    if chunk == 0:
                        headers = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(key) if known else f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", when)]
                        headers += [("WARC-Target-URI", " ".join(target.split()))] if target else []
                        headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(n))]
                        headers += [("X-Page-ID", str(key))] if known else []
                        if again:
                            headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first)), ("X-Refers-To-Page-ID", str(first))]
                        left = 0 if again else n
                        writer.begin(headers, left)
                        count += 1
                    writer.append(data)
                    left -= len(data)
                    if not left:
                        writer.end()
        yield pd.DataFrame({"path": [name], "n_records": [count]})

    rows = with_revisits(pages, page_id, url, html)
    length = F.when(F.col("refers_to").isNull(), F.col("n_bytes")).otherwise(0)
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(length / CHUNK) - 1).cast("int"))
    pieces = F.transform(numbers, lambda i: F.when(F.col("refers_to").isNull(), F.substring("payload", i * CHUNK + 1, F.lit(CHUNK))).otherwise(F.lit(b"")))
    chunked = rows.select(
        F.col("page_id").isNotNull().alias("known"), F.coalesce("page_id", F.lit(0)).alias("key"), "url", "digest", "n_bytes",
        F.col("refers_to").isNotNull().alias("again"), F.coalesce("refers_to", F.lit(0)).alias("first"), F.posexplode(pieces).alias("chunk", "data"),
    )
    return materialize(chunked.mapInPandas(write, "path string, n_records long"), "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, with_data: bool = True, size: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives that a manifest's ``path`` column names.

    (record_id, chunk, page_id, record_type, refers_to, declared_digest, declared_bytes, seen_bytes, digest, last[, data]):
    a row for each chunk. ``digest`` and ``seen_bytes`` are of the block's bytes up to and with the chunk. Without
    ``data``, only the last chunk of a record is returned. A damaged archive fails the task.
    """
    names = ["record_id", "chunk", "page_id", "record_type", "refers_to", "declared_digest", "declared_bytes", "seen_bytes", "digest", "last", *(["data"] if with_data else [])]

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        whole = ("page_id", "refers_to", "declared_bytes")  # may be null, and must not become doubles
        return pd.DataFrame({n: pd.array([r[k] for r in rows], dtype="Int64") if n in whole else [r[k] for r in rows] for k, n in enumerate(names)})

    def number(text: str | None) -> int | None:
        return int(text) if text is not None else None

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"].tolist():
                rows, held = [], 0
                with open_shared(path, "r") as f:
                    for h, chunk, data, seen, digest, last in record_chunks(f, size):
                        if not (with_data or last):
                            continue
                        rows.append((h["warc-record-id"], chunk, number(h.get("x-page-id")), h["warc-type"], number(h.get("x-refers-to-page-id")), h.get("warc-payload-digest"), number(h.get("x-payload-length")), seen, digest, last, *([data] if with_data else [])))
                        held += len(data) if with_data else 0
                        if held > 4 * size or len(rows) == 5000:
                            yield frame_of(rows)
                            rows, held = [], 0
                if rows:
                    yield frame_of(rows)

    schema = "record_id string, chunk int, page_id long, record_type string, refers_to long, declared_digest string, declared_bytes long, seen_bytes long, digest string, last boolean" + (", data binary" if with_data else "")
    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInPandas(read, schema)


def payloads(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): one row a record, of the full payload.

    A response is measured by the bytes that were read; a revisit, which has none of its own, by what it declares.
    """
    whole = records.where("last")
    response = F.col("record_type") == "response"

    def of(read: str, declared: Column) -> Column:
        return F.when(response, F.col(read)).otherwise(declared)

    return whole.select(
        "page_id", of("seen_bytes", F.col("declared_bytes")).alias("payload_bytes"),
        of("digest", F.regexp_extract("declared_digest", r"^sha256:([0-9a-f]{64})$", 1)).alias("payload_digest"), "record_type", "refers_to",
    )
