"""WARC archives written and read as a table of record chunks with incremental digests."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, join_small, remove, shared_dir

#: Bytes of a payload in one row, on the way out and on the way in.
BYTES = 1 << 20
#: Archives are begun anew past this many bytes.
ARCHIVE = 1 << 30
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNKS = (
    "archive string, record_id string, chunk_no int, page_id long, record_type string, refers_to long, "
    "position long, data binary, last boolean, payload_bytes long, payload_digest string"
)


def open_filesystem(where: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; a bare path is local to the driver and executors alike."""
    return (pafs.LocalFileSystem(), where) if where.startswith("/") else pafs.FileSystem.from_uri(where)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(archive: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def _header_safe(value: str) -> str:
    """A header value without control characters: those and non-ASCII become percent escapes."""
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def _header(archive: str, number: int, row: dict) -> bytes:
    block = len(HTTP) + (row["n"] if row["refers_to"] is None else 0)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(archive, number)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_header_safe(row['url'] or '') or 'urn:unknown'}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(row['sha']))}",
        f"Payload-Bytes: {row['n']}",
    ]
    if row["page_id"] is not None:
        lines.append(f"Page-ID: {row['page_id']}")
    if row["refers_to"] is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {row['refers_to']}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """Add ``sha`` (hex), ``n`` (payload bytes) and ``refers_to`` to ``page_id, url, html`` rows.

    Digests are computed in the JVM; only pages that share one are looked up.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).cast("long").alias("n"))
    shared = cut(
        rows.where(F.col("n") >= least).groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("newest")).where("copies > 1").select("sha", "newest")
    )
    known = join_small(rows, shared, "sha")
    return known.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest"))).drop("newest")


def _chunks(most: int):
    """Rows of at most ``most`` bytes of payload, in order, each payload read once; revisits carry none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload, of, number, count, parts, size = batch.column(5).cast(pa.binary()), [], [], [], [], 0

            def out():
                rows = batch.select(range(5)).take(pa.array(of, pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays([*rows.columns, pa.array(number, pa.int32()), pa.array(count, pa.int32()), pa.array(parts, pa.binary())], names=[*rows.schema.names, "chunk", "chunks", "data"])  # noqa: B023

            for i in range(batch.num_rows):
                data = memoryview(b"") if batch.column(4)[i].is_valid else memoryview(payload[i].as_buffer())
                total = max(1, -(-data.nbytes // most))
                for n in range(total):
                    part = bytes(data[n * most : (n + 1) * most])
                    of.append(i)
                    number.append(n)
                    count.append(total)
                    parts.append(part)
                    size += len(part)
                    if size >= 8 * most:
                        yield out()
                        of, number, count, parts, size = [], [], [], [], 0
            if of:
                yield out()

    return run


def _write(where: str, most: int):
    """Write the rows of a task, in order, as gzip members; report each archive that was closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_filesystem(where)
        system.create_dir(root, recursive=True)
        out, path, number, size, written, digest, packer = None, "", 0, 0, 0, None, None

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([number], pa.int64()), pa.array([size], pa.int64())], names=["archive", "records", "bytes"])

        def put(data: bytes) -> None:
            nonlocal size
            out.write(data)
            size += len(data)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(("page_id", "url", "sha", "n", "refers_to", "chunk", "chunks", "data"))}
                if not row["chunk"]:
                    if out is not None and size >= most:
                        yield closed()
                        out = None
                    if out is None:
                        # A name of its own for each attempt: what a lost task has left is never read.
                        path, number, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(path, compression=None)
                    packer, digest, written = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1(), 0
                    put(packer.compress(_header(path.rpartition("/")[2], number, row) + HTTP))
                if row["refers_to"] is None:
                    data = row["data"]
                    digest.update(data)
                    written += len(data)
                    put(packer.compress(data))
                if row["chunk"] == row["chunks"] - 1:
                    if row["refers_to"] is None and (digest.hexdigest() != row["sha"] or written != row["n"]):
                        raise ValueError(f"page {row['page_id']}: the chunks are not the payload that was announced")
                    put(packer.compress(b"\r\n\r\n") + packer.flush())
                    number += 1
        if out is not None:
            yield closed()

    return run


def write_archives(pages: DataFrame, where: str, least: int = 0, chunk: int = BYTES, most: int = ARCHIVE) -> DataFrame:
    """Write a record per row under the shared folder ``where``; ``(archive, records, bytes)`` of what was closed.

    Payloads go out as rows of ``chunk`` bytes, so no task holds a whole
    oversized payload beside the row it came in. The list is materialised: archives
    of failed attempts are not in it.
    """
    rows = roles(pages, least).select("page_id", "url", "sha", "n", "refers_to", "html")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:5])
    rows = rows.mapInArrow(_chunks(chunk), f"{kinds}, chunk int, chunks int, data binary")
    return cut(rows.mapInArrow(_write(where, most), "archive string, records long, bytes long"))


class _Stream:
    """Bytes of one gzip member after the other, without ever holding more than asked for and one block."""

    def __init__(self, source, block: int):
        self.source, self.block, self.buffer, self.packed, self.inflate = source, block, bytearray(), b"", None

    def _more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.source.read(1 << 16)
                if not self.packed:
                    return False
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            data = self.inflate.decompress(self.packed, self.block)
            if self.inflate.eof:
                self.packed, self.inflate = self.inflate.unused_data, None
            else:
                self.packed = self.inflate.unconsumed_tail
            if data:
                self.buffer += data
                return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """Through ``mark``; None at the end of the source."""
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if len(self.buffer) > most:
                raise ValueError("a header has no end")
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("an archive ends inside a header")
                return None
        out = bytes(self.buffer[: found + len(mark)])
        del self.buffer[: found + len(mark)]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, a block at a time."""
        while size:
            if not self.buffer and not self._more():
                raise ValueError("an archive ends inside a record")
            part = bytes(self.buffer[: min(size, self.block)])
            del self.buffer[: len(part)]
            size -= len(part)
            yield part


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("a record does not start with its version")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def _read(block: int, with_data: bool):
    """Chunks of each record of each archive; digests run on from chunk to chunk."""

    def rows(where: str):
        system, path = open_filesystem(where)
        name, number = path.rpartition("/")[2], 0
        with system.open_input_stream(path, compression=None) as source:
            stream = _Stream(source, block)
            while (header := stream.until(b"\r\n\r\n")) is not None:
                fields = _fields(header)
                if (own := fields["warc-record-id"]) != record_id(name, number):
                    raise ValueError(f"{path}: record {number} has another's identifier")
                number += 1
                kind, said = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
                front = stream.until(b"\r\n\r\n")
                left = int(fields["content-length"]) - len(front)
                page = int(fields["page-id"]) if "page-id" in fields else None
                refers = int(fields["refers-to-page-id"]) if "refers-to-page-id" in fields else None
                digest, at, n, total = hashlib.sha1(), 0, 0, left
                held = None
                for part in stream.take(left):
                    digest.update(part)
                    if held is not None:
                        yield (name, own, n, page, kind, refers, at, held, False, None, None)
                        at, n = at + len(held), n + 1
                    held = part
                held = held or b""
                if kind == "response" and base32_sha1(digest.digest()) != said:
                    raise ValueError(f"{path}: record {number - 1} does not have the payload of its digest")
                size = total if kind == "response" else int(fields["payload-bytes"])
                yield (name, own, n, page, kind, refers, at, held, True, size, said)
                if b"".join(stream.take(4)) != b"\r\n\r\n":
                    raise ValueError(f"{path}: record {number - 1} has no end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("chunk_no", pa.int32()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("position", pa.int64()), ("data", pa.binary()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for batch in batches:
            for where in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(where):
                    if not with_data:
                        if not row[8]:
                            continue
                        row = (*row[:7], None, *row[8:])
                    held.append(row)
                    size += len(row[7] or b"")
                    if len(held) >= 1024 or size >= 4 * block:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return run


def read_archives(archives: DataFrame, block: int = BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in column ``archive``: see ``CHUNKS``.

    A record has one row per ``block`` bytes of payload (one without data if empty);
    its last row carries the payload's size and digest, which is checked as it is
    read. Without data only those last rows are returned. The paths are counted and
    dealt by range to as many tasks: by their few bytes they would all meet in one.
    """
    paths = archives.select("archive")
    return paths.repartitionByRange(max(1, paths.count()), "archive").mapInArrow(_read(block, with_data), CHUNKS)


def round_trip(pages: DataFrame, least: int = 0, chunk: int = BYTES, block: int = BYTES) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` as read back.

    Of records with equal payloads of at least ``least`` bytes, the one with the largest
    page_id is the response (all its rows, if it is repeated) and the others revisit it;
    smaller ones are all responses. A null html is an empty payload, a null url unknown; a very long
    html streams in chunks.
    Where every holder of a payload has a null page_id, all are responses; a null
    page_id beside a known one revisits that. An empty table gives an empty result;
    other columns are ignored. The archives are removed once they have been read.
    """
    spark = pages.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written = write_archives(pages.select("page_id", "url", "html"), where, least, chunk)
    prefix = where[: where.index("://") + 3] if "://" in where else ""
    named = written.select(F.concat(F.lit(_prefix(where)), "archive").alias("archive")) if prefix else written
    back = cut(read_archives(named, block, with_data=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, where)
    return back


def _prefix(where: str) -> str:
    """What a path of the file system lacks to be the URI that it came from."""
    _, path = open_filesystem(where)
    return where[: len(where) - len(path)] if where.endswith(path) else where.partition("://")[0] + "://"


def archive_sql(pages: str = "pages") -> str:
    """DuckDB SQL of the op8 query; base32 is spelt out, four letters from five hexadecimal digits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    value = lambda i: f"('0x' || substr(sha, {1 + 5 * i}, 5))::BIGINT"
    digits = " || ".join(f"substr('{letters}', 1 + (({value(i)} >> {s}) & 31)::INT, 1)" for i in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM {pages}),
r AS (SELECT sha, max(page_id) AS newest FROM p GROUP BY sha)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {digits} AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM newest AND newest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM p JOIN r USING (sha)"""
