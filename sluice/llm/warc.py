"""WARC archives through a table of chunks.

Writing: payloads are cut into rows of (record, chunk number, bytes) before they leave the JVM, and each task writes
the rows of its records one after another into one archive, a gzip member a record, never holding a whole payload.
Of records with equal payloads of some length, the smallest page_id keeps the payload, and the others revisit it.
Reading: archives are streamed into the same kind of rows; each carries the bytes so far, and the last one of a
record the digest, which is updated chunk by chunk and checked against the record's header.

The table of archives that the write gives is itself written, so that just one attempt of each task counts.

Null payloads are empty ones. Records of an equal, smallest page_id all are responses; if no equal payload has an
id, all are. Null urls are left out. Long payloads differ from short ones in no way. An empty table has no archives.
Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice import staging
from sluice.functions.arrow import tidy
from sluice.sources import blobs

#: Bytes of a chunk; payloads from this many bytes on are revisited.
CHUNK, REVISIT_FROM = 1 << 20, 100
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{digest}'.encode()).digest()[:16])}>"


def _header(page_id, url, size, digest, refers_to) -> bytes:
    """The record's head and what comes before its payload."""
    revisit = refers_to is not None
    http = _HTTP.format(size).encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url and "".join(url.split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Refers-To", _record_id(refers_to, digest) if revisit else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else size))),
        ("X-Payload-Length", str(size)),
        ("X-Page-Id", None if page_id is None else str(page_id)),
        ("X-Refers-To-Page-Id", str(refers_to) if revisit else None),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n" + http


def plan(pages: DataFrame, chunk: int = CHUNK, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The chunk table: (page_id, url, size, digest, refers_to, chunk, last, data); a revisit has one chunk without data."""
    raw = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"))
    raw = raw.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    # digests that occur once need no row here
    first = raw.where(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = raw.join(first, "digest", "left").withColumn("refers_to", F.when((F.col("size") >= REVISIT_FROM) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    body = F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(F.lit(b""))
    cut = joined.withColumn("body", body).withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(chunk)).cast("int")))
    one = cut.select("page_id", "url", "size", "digest", "refers_to", "body", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"))
    return one.select("page_id", "url", "size", "digest", "refers_to", "chunk", (F.col("chunk") == F.col("n") - 1).alias("last"), F.substring("body", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"))


def write(pages: DataFrame, folder: str | None = None, chunk: int = CHUNK, **columns) -> DataFrame:
    """Writes the archives, and gives the table of them: (path, records, bytes)."""
    spark = pages.sparkSession
    folder = folder or staging.new_path(spark, "warc")

    @tidy
    def run(batches):
        path, out, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        manager, pack = None, None
        try:
            for batch in batches:
                for page_id, url, length, digest, refers_to, number, last, data in zip(*(c if c.type == pa.binary() else c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        manager = blobs.create(path)
                        out = manager.__enter__()
                    parts = []
                    if not number:
                        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                        parts.append(pack.compress(_header(page_id, url, length, digest, refers_to)))
                        records += 1
                    parts.append(pack.compress(data.as_py()))
                    if last:
                        parts.append(pack.compress(b"\r\n\r\n") + pack.flush())
                    size += sum(out.write(p) or len(p) for p in parts)
        finally:
            if manager is not None:
                manager.__exit__(None, None, None)
        if records:
            yield pa.record_batch([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    with staging.small_batches(spark):
        return staging.stage(plan(pages, chunk, **columns).mapInArrow(run, "path string, records long, bytes long"), "archives")


def _stream(f, chunk: int):
    """Decompressed bytes of all members, some at a time."""
    unpack = zlib.decompressobj(31)
    while data := f.read(chunk):
        while data:
            if out := unpack.decompress(data, chunk):
                yield out
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack = unpack.unused_data, zlib.decompressobj(31)


class _Reader:
    def __init__(self, pieces):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.held += piece
        return piece is not None

    def until(self, mark: bytes) -> bytes | None:
        """What comes before mark, which is taken too; None at the end."""
        at = self.held.find(mark)
        while at < 0:
            if not self.more():
                if self.held:
                    raise ValueError("an archive ends within a record")
                return None
            at = self.held.find(mark)
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, most: int) -> bytes:
        if not self.held and not self.more():
            raise ValueError("an archive ends within a record")
        out = bytes(self.held[:most])
        del self.held[:most]
        return out


def records(f, chunk: int = CHUNK):
    """Rows of an archive: (page_id, url, record_type, refers_to, chunk, payload_bytes so far, payload_digest or None, data)."""
    reader = _Reader(_stream(f, chunk))
    while (head := reader.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        left = int(fields["content-length"])
        http = reader.until(b"\r\n\r\n")
        left -= len(http) + 4
        number = lambda name: int(fields[name]) if name in fields else None
        row = (number("x-page-id"), fields.get("warc-target-uri"), fields["warc-type"], number("x-refers-to-page-id"))
        claimed = fields["warc-payload-digest"].partition(":")[2]
        if fields["warc-type"] == "revisit":
            yield (*row, 0, int(fields["x-payload-length"]), claimed, b"")
        else:
            digest, done, n = hashlib.sha256(), 0, 0
            while True:
                data = reader.take(min(left, chunk)) if left else b""
                left -= len(data)
                done += len(data)
                digest.update(data)
                if not left and digest.hexdigest() != claimed:
                    raise ValueError(f"a payload's digest isn't {claimed}")
                yield (*row, n, done, None if left else claimed, data)
                n += 1
                if not left:
                    break
        if reader.until(b"\r\n\r\n") != b"":
            raise ValueError("a record doesn't end where it should")


_ROW = "page_id long, url string, record_type string, refers_to long, chunk int, payload_bytes long, payload_digest string, data binary"


def read(archives: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives that a table with their paths lists; the last row of each record has its digest."""
    names = [x.split()[0] for x in _ROW.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    @tidy
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with blobs.read(path) as f:
                    for row in records(f, chunk):
                        rows.append(row if with_data else (*row[:-1], None))
                        size += len(row[-1]) if with_data else 64
                        if size > 4 * CHUNK:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    n = staging.partitions(archives.sparkSession)
    return archives.select("path").repartition(n, "path").mapInArrow(run, _ROW)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, reads them back, and gives a row for each record. A staged table; the archives are deleted."""
    spark = pages.sparkSession
    folder = staging.new_path(spark, "warc")
    with staging.scope() as kept:
        rows = read(write(pages, folder), with_data=False)
        out = staging.stage(rows.where("payload_digest is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
        kept.append(out)
    staging.delete(spark, folder)
    return out
