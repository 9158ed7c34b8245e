"""WARC archives: one gzip member per record, written and read back by executors.

The writer makes one archive per task; equal payloads are stored once and revisited.  The reader
walks an archive from front to back with incremental inflation and content-length framing, and
verifies block and payload digests.  Memory: one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import common

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"

CHUNK = 1 << 16
#: Bytes after which a task closes an archive and begins the next, so that a reader's work is bounded.
ARCHIVE_BYTES = 1 << 30
MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, offset long, record_id string, record_type string, target_uri string, refers_to_id string,"
    " payload_bytes long, payload_digest string, payload binary"
)


class WarcError(ValueError):
    """An archive that breaks its framing or fails a digest."""


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC digests are written."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record, not compressed.  A revisit keeps the HTTP head, which has the payload's length."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", f"<urn:page:{record_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((uri or "").split())),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
    ]
    if refers_to:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields)]
    return CRLF.join(lines) + CRLF + CRLF + block + CRLF + CRLF


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Inflated:
    """The stream of one gzip member after another, read piece by piece."""

    def __init__(self, source) -> None:
        self.source, self.left, self.offset, self.z, self.out = source, b"", 0, None, b""

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if not self.left:
            self.left = self.source.read(CHUNK)
        if not self.left:
            return False
        self.z, self.out = zlib.decompressobj(31), b""
        return True

    def fill(self) -> bool:
        """Inflate a little more of this member; False at its end."""
        while not self.z.eof:
            if not self.left:
                self.left = self.source.read(CHUNK)
                if not self.left:
                    raise WarcError("the archive ends within a member")
            before = len(self.left)
            try:
                got = self.z.decompress(self.left, CHUNK)
            except zlib.error as e:
                raise WarcError(f"bad member at {self.offset}: {e}") from e
            self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.offset += before - len(self.left)
            if got:
                self.out += got
                return True
        return False

    def line(self) -> bytes:
        while (i := self.out.find(b"\r\n")) < 0:
            if not self.fill():
                raise WarcError("a header line has no end")
        line, self.out = self.out[:i], self.out[i + 2 :]
        return line

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if not self.out and not self.fill():
                raise WarcError(f"a block has {have} of {n} bytes")
            piece, self.out = self.out[: n - have], self.out[n - have :]
            parts.append(piece)
            have += len(piece)
        return b"".join(parts)


def read_archive(source) -> Iterator[dict]:
    """The records of an open archive in order, each verified."""
    stream = Inflated(source)
    while True:
        at = stream.offset
        if not stream.next_member():
            return
        if stream.line() != VERSION:
            raise WarcError(f"no WARC record at {at}")
        fields = {}
        while line := stream.line():
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode()] = v.strip().decode()
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != CRLF + CRLF or stream.out or stream.fill():
            raise WarcError(f"record at {at} isn't framed by its content length")
        if fields["warc-block-digest"] != "sha1:" + digest(block):
            raise WarcError(f"block digest of record at {at}")
        head, _, payload = block.partition(b"\r\n\r\n")
        length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        kind = fields["warc-type"]
        if kind == "response" and (len(payload) != length or fields["warc-payload-digest"] != "sha1:" + digest(payload)):
            raise WarcError(f"payload of record at {at}")
        yield {
            "offset": at,
            "record_id": fields["warc-record-id"][len("<urn:page:") : -1],
            "record_type": kind,
            "target_uri": fields["warc-target-uri"],
            "refers_to_id": fields["warc-refers-to"][len("<urn:page:") : -1] if "warc-refers-to" in fields else None,
            "payload_bytes": length,
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
            "payload": payload if kind == "response" else None,
        }


def with_revisits(pages: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: the smallest page_id with an equal payload of at least ``min_payload_bytes``
    bytes, null for that page itself and for smaller payloads.

    Null html is an empty payload.  Rows that repeat the smallest page_id are responses too; a null
    page_id revisits unless every page with the payload has none.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    keyed = pages.select(
        F.col("page_id"), F.col("url"), F.col("html"), F.sha1(payload).alias("_sha1"), F.octet_length(payload).alias("_bytes")
    )
    firsts = keyed.filter(F.col("_bytes") >= min_payload_bytes).groupBy("_sha1").agg(F.min("page_id").alias("_first"))
    out = common.spread_join(keyed, firsts, "_sha1", "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return out.select("page_id", "url", "html", first.alias("refers_to"))


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Write ``records`` (page_id, url, html, refers_to) as gzipped WARC files under ``path``, one per task
    and ``ARCHIVE_BYTES``, and return the manifest (path, records, bytes).  An empty partition writes none."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(x.as_py() for x in row) for b in batches for row in zip(*(b.column(i) for i in range(4))))
        row, count, number = next(rows, None), 0, 0
        task = TaskContext.get()

        def put(out) -> None:
            nonlocal row, count
            count = 0
            while row is not None and out.tell() < ARCHIVE_BYTES:
                key, url, html, ref = row
                out.write(gzip_member(record_bytes("" if key is None else str(key), url, (html or "").encode("utf-8"), None if ref is None else str(ref))))
                count += 1
                row = next(rows, None)

        while row is not None:
            # rows come in no fixed order: another try of the task writes files of its own, and the manifest names one try's
            name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
            size = common.publish(name, put)
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [count], "bytes": [size]})

    spark = records.sparkSession
    common.bounded_batches(spark)
    manifest = records.select("page_id", "url", "html", "refers_to").mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of every archive that ``manifest`` lists, one task reading an archive from front to
    back.  ``payloads=False`` leaves payloads out after their digests are verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split()[0] for x in RECORDS.split(",")]
        types = pa.schema(
            [(n, pa.int64() if n in ("offset", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names]
        )
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = common.filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(inner, compression=None) as source:
                    for record in read_archive(io.BufferedReader(source, CHUNK)):
                        record["path"] = path
                        if not payloads:
                            record["payload"] = None
                        held += len(record["payload"] or b"")
                        rows.append(record)
                        if len(rows) >= common.BATCH_ROWS or held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema=types)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=types)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives, read them back, and return a row per record: page_id,
    payload_bytes, payload_digest, record_type, refers_to, target_uri, path, offset.

    Repeated rows are records of their own.  A page_id that is null or, as a string, empty reads back
    as null.  Other columns of ``pages`` than page_id, url and html aren't archived.
    """
    spark = pages.sparkSession
    manifest = write_archives(with_revisits(pages, min_payload_bytes), common.shared_dir(spark, "warc"))
    back = read_archives(spark, manifest, payloads=False)
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(pages.schema["page_id"].dataType)
    return back.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"), "target_uri", "path", "offset"
    )
