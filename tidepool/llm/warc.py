"""WARC archives as a chunked record table.

Writing: each page is one gzip-compressed WARC/1.1 record. Its bytes are rows (archive, record, chunk, last, so_far,
digest, data): `so_far` and `digest` are the payload's length and SHA-1 up to and including that chunk, so a reader can check a record
as it goes. The rows of an archive, in order of record and chunk, are the bytes of a .warc.gz file (export() writes them).
Reading: records of one chunk are parsed where they lie; only the chunks of longer ones are brought together, sorted,
and streamed through an inflater and a running digest, so no record is ever whole in memory.

A payload that others repeat is stored once, by its smallest page_id; the others are revisit records with an HTTP
header (which has the full length) but no payload. Groups are found by a partial aggregate over digests; the join back
is one that Spark may split or broadcast at run time.

Cases: null html is an empty payload; rows without page_id are never referred to (they revisit a response that has one);
repeated rows of the smallest page_id are all responses; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, written
from .packing import _partition

#: Payload bytes of a chunk before compression.
CHUNK = 1 << 20
MIN_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CHUNK_SCHEMA = "archive string, record long, chunk int, last boolean, so_far long, digest string, data binary"


def with_references(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", uri_col: str | None = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, uri, payload, refers_to): refers_to is the response's id for revisits, else null."""
    own = pages.select(
        F.col(id_col).alias("page_id"), (F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")).alias("uri"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    groups = own.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    groups = groups.select(F.col("sha").alias("group"), "first")
    to = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first"))
    return own.join(groups, F.col("sha") == F.col("group"), "left").select("page_id", "uri", "payload", to.alias("refers_to"))


def _header(kind: str, page: object, uri: str | None, digest: str, refers: object, size: int, http: bytes) -> bytes:
    target = "".join(c if c.isprintable() and c != " " else "_" for c in uri or f"urn:page:{page}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (size if refers is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def record_chunks(page: object, uri: str | None, payload: pa.BinaryScalar | bytes, refers: object, chunk: int = CHUNK) -> Iterator[tuple[int, bool, int, str, bytes]]:
    """A record's rows (chunk, last, so_far, digest, data); the payload is read through a window of `chunk` bytes."""
    view = memoryview(payload if isinstance(payload, bytes) else payload.as_buffer())
    whole = hashlib.sha1(view).digest()
    deflate, running = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(view)}\r\n\r\n".encode()
    data = deflate.compress(_header("response" if refers is None else "revisit", page, uri, base64.b32encode(whole).decode(), refers, len(view), http))
    if refers is not None:
        view = view[:0]
    for n, at in enumerate(range(0, max(len(view), 1), chunk)):
        part = view[at : at + chunk]
        running.update(part)
        last = at + chunk >= len(view)
        data += deflate.compress(part) + (deflate.compress(b"\r\n\r\n") + deflate.flush() if last else b"")
        yield n, last, at + len(part), running.hexdigest(), data
        data = b""


def write_archives(pages: DataFrame, **options: object) -> DataFrame:
    """The chunk table of all pages, stored in the shared folder. options: those of with_references()."""
    arrow_limits(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = _partition(), 0
        names, types = ["archive", "record", "chunk", "last", "so_far", "digest", "data"], [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return batch

        for batch in batches:
            ids, uris, refers = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for i, page in enumerate(ids):
                for k, last, so_far, digest, data in record_chunks(page, uris[i], batch.column(2)[i], refers[i]):
                    rows.append((f"part-{task:06d}.warc.gz", task << 36 | n, k, last, so_far, digest, data))
                    held += len(data)
                    if held > 4 * CHUNK:
                        yield out()
                        held = 0
                n += 1
        if rows:
            yield out()

    return written(with_references(pages, **options).mapInArrow(run, CHUNK_SCHEMA), "warc")


class Parser:
    """Reads one record from its compressed chunks in order."""

    def __init__(self) -> None:
        self.inflate = zlib.decompressobj(31)
        self.head, self.fields, self.http = b"", None, None
        self.sha, self.size, self.left = hashlib.sha1(), 0, 0

    def feed(self, data: bytes) -> None:
        self.take(self.inflate.decompress(data))

    def take(self, raw: bytes) -> None:
        while self.http is None:
            self.head += raw
            block, gap, raw = self.head.partition(b"\r\n\r\n")
            if not gap:
                return
            self.head = b""
            lines = block.decode("utf-8", "replace").split("\r\n")
            found = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            if self.fields is None:
                self.fields, self.left = found, int(found["content-length"])
            else:
                self.http = found
                self.left -= len(block) + 4
        part = raw[: self.left]
        self.left -= len(part)
        self.sha.update(part)
        self.size += len(part)

    def page(self, field: str = "warc-record-id") -> str | None:
        return self.fields[field][len("<urn:page:") : -1] or None if field in self.fields else None

    def result(self) -> tuple[str | None, int, str, str, str | None]:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to); of a revisit, what its headers say of the payload."""
        kind, stated = self.fields["warc-type"], self.fields["warc-payload-digest"].removeprefix("sha1:")
        if self.left:
            raise ValueError(f"{self.fields['warc-record-id']}: {self.left} bytes are missing")
        if kind == "response" and base64.b32encode(self.sha.digest()).decode() != stated:
            raise ValueError(f"{self.fields['warc-record-id']}: the payload doesn't have the stated digest")
        return self.page(), self.size if kind == "response" else int(self.http["content-length"]), stated, kind, self.page("warc-refers-to")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    parser, due = None, (0, 0)
    for batch in batches:
        rows = []
        record, chunk, last, so_far, digest = (batch.column(k).to_pylist() for k in range(1, 6))
        for i in range(batch.num_rows):
            if chunk[i] == 0:
                parser = Parser()
            elif parser is None or due != (record[i], chunk[i]):
                raise ValueError(f"record {record[i]}: chunk {chunk[i]} isn't in turn")
            parser.feed(batch.column(6)[i].as_py())
            due = record[i], chunk[i] + 1
            if last[i]:
                if parser.size != so_far[i] or parser.sha.hexdigest() != digest[i]:
                    raise ValueError(f"record {record[i]}: chunk {chunk[i]} doesn't have its digest")
                rows.append(parser.result())
                parser = None
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(chunks: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per record of a chunk table: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    arrow_limits(chunks.sparkSession)
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    short = chunks.filter("chunk = 0 AND last").mapInArrow(_parse, schema)
    long = chunks.filter("NOT (chunk = 0 AND last)").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_parse, schema)
    out = short.unionByName(long)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def export(chunks: DataFrame, archive: str, to: BinaryIO) -> None:
    """Write one archive's bytes, row by row."""
    for row in chunks.filter(F.col("archive") == archive).orderBy("record", "chunk").select("data").toLocalIterator():
        to.write(row.data)


def _records(archive: memoryview, window: int = CHUNK) -> Iterator[Parser]:
    """Parsed records of an archive, compressed record by record or not, read through windows: what is inflated at once is bounded, not the record."""
    at = 0
    while at < len(archive):
        parser = Parser()
        if bytes(archive[at : at + 2]) == b"\x1f\x8b":
            while not parser.inflate.eof:
                held = parser.inflate.unconsumed_tail or archive[at : at + window]
                if not held:
                    raise ValueError("the archive ends within a record")
                at += 0 if parser.inflate.unconsumed_tail else len(held)
                parser.take(parser.inflate.decompress(held, 4 * window))
            at -= len(parser.inflate.unused_data)
        else:
            head = b""
            while b"\r\n\r\n" not in head and len(head) < len(archive) - at:
                head = bytes(archive[at : at + len(head) + 4096])
            size = [x.split(b":")[1] for x in head.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
            if not size:
                raise ValueError(f"no record at {at}")
            end = at + head.index(b"\r\n\r\n") + 4 + int(size[0])
            for k in range(at, end, window):
                parser.take(bytes(archive[k : min(k + window, end)]))
            at = end + 4
        yield parser


def read_files(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Records of .warc or .warc.gz files that write_archives() made and export() wrote. Spark gives a file's bytes as one value (2 GB at most); records are read from it through windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                rows = [parser.result() for parser in _records(memoryview(blob.as_buffer()))]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
