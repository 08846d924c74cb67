"""WARC archives: written as monolithic gzip, normalised to a member per record, read through an index.

1. :func:`write_archives` writes the pages as WARC/1.1 records. Spark's own text writer
   compresses each file as one gzip stream, which can only be read from its start.
2. :func:`normalise` inflates each such stream once, line by line, and writes every record
   as a gzip member of its own, with a sidecar of offsets beside the archive. One record is
   in memory at a time. An archive and then its sidecar are moved to their names when they
   are whole, so a lost executor leaves nothing half-written under a name, and the archive
   that a second attempt writes is the same.
3. :func:`read_records` reads single records at the offsets of the sidecars.

Of the records with one payload of LEAST_BYTES or more, that of the smallest page_id is a
`response`; the others are `revisit` records that carry its HTTP headers, digest and id, but
not its payload. Smaller payloads are always written.

Defined cases: a null payload is empty; a null page_id has an empty record id and is the
smallest only among nulls; every row of the smallest page_id is a response; a null url has no
target header, and control characters in one are percent-encoded; an empty table gives no
archives and an empty index. In foreign archives a record whose header or length does not fit
is counted as damaged and reading goes on at the next record.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, drop_folder, only, per_batch, ship

LEAST_BYTES = 100
#: Most records of one archive, and zlib's level for its members.
ARCHIVE_RECORDS, LEVEL = 50_000, 4
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
ARCHIVE, SIDECAR = ".warc.gz", ".warc.gz.index.json"
ID_PREFIX = "urn:x-page:"
INDEX_SCHEMA = "archive string, offset long, length long, record_id string, record_type string, uri string"
RECORD_SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, intact boolean"
)


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest."""
    rows = only(pages, page_id="page_id", url="url", html="html")
    payload = F.coalesce(F.col("html"), F.lit(""))
    return rows.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )


def repeated(found: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """payload_digest and smallest page_id of payloads that several records share."""
    narrow = found.where(F.col("payload_bytes") >= least_bytes).select("payload_digest", "page_id")
    return narrow.groupBy("payload_digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").drop("n")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def target(url: Column) -> Column:
    """A url that stays on its header line."""
    for code in [*range(0x20), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def record(page_id: Column, url: Column, payload: Column, size: Column, digest: Column, refers_to: Column) -> Column:
    """The bytes of a record up to the empty lines behind it, as a string; a revisit where `refers_to` is not null."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        size.cast("string"), F.lit(CRLF + CRLF))
    again = refers_to.isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, payload))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(page_id)),
        F.concat(F.lit("WARC-Target-URI: "), target(url)),  # left out where the url is null
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), record_id(refers_to))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, archive_records: int = ARCHIVE_RECORDS
) -> None:
    """The records of `pages` in archives below `folder`, each one gzip stream."""
    found = payloads(pages)
    # A written table, so that Spark knows its size: the pages move only where it is large.
    firsts = cut(repeated(found, least_bytes))
    marked = found.join(firsts, "payload_digest", "left")
    first = F.col("first_id")
    refers_to = F.when(first.isNotNull() & ~F.col("page_id").eqNullSafe(first), first)
    rows = marked.select(record(
        F.col("page_id"), F.col("url"), F.col("payload"), F.col("payload_bytes"), F.col("payload_digest"), refers_to))
    rows.write.option("compression", "gzip").option("lineSep", CRLF + CRLF).option(
        "maxRecordsPerFile", archive_records).text(folder)


class RecordReader:
    """Records of one archive from its lines; a line has lost its CRLF."""

    def __init__(self) -> None:
        self.damaged = 0
        self._header: list[bytes] | None = None
        self._need = -1
        self._have = 0
        self._block: list[bytes] = []

    def feed(self, line: bytes) -> tuple[list[bytes], bytes] | None:
        """The record that ends with this line, if one does: header lines and block."""
        if self._need >= 0:
            if self._have + len(line) < self._need:
                self._block += (line, b"\r\n")
                self._have += len(line) + 2
                return self._record() if self._have == self._need else None
            if self._have + len(line) == self._need:
                self._block.append(line)
                return self._record()
            self._drop()  # the block is not as long as it says
        if self._header is None:
            if line.startswith(b"WARC/"):
                self._header = [line]
            elif line:
                self.damaged += 1
            return None
        if line:
            self._header.append(line)
            return None
        length = header_value(self._header, b"content-length")
        if not length.isdigit():
            self._drop()
            return None
        self._need = int(length)
        return self._record() if self._need == 0 else None

    def end(self) -> None:
        if self._header is not None:
            self._drop()

    def _record(self) -> tuple[list[bytes], bytes]:
        found = self._header or [], b"".join(self._block)
        self._header, self._need, self._have, self._block = None, -1, 0, []
        return found

    def _drop(self) -> None:
        self.damaged += 1
        self._header, self._need, self._have, self._block = None, -1, 0, []


def header_value(lines: list[bytes], name: bytes) -> bytes:
    """The value of a header line; empty if there is none."""
    for line in lines:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name:
            return value.strip()
    return b""


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


def member(lines: list[bytes], block: bytes, level: int) -> bytes:
    """The record as a gzip member; equal records give equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join((
        packer.compress(b"\r\n".join(lines) + b"\r\n\r\n"), packer.compress(block), packer.compress(b"\r\n\r\n"),
        packer.flush()))


class ArchiveWriter:
    """One normalised archive and its sidecar, published by :meth:`publish`."""

    def __init__(self, out: str, name: str, level: int) -> None:
        self._fs, folder = opened(out)
        self._fs.create_dir(folder, recursive=True)
        self._final = f"{folder.rstrip('/')}/{name}"
        self._attempt = f"{folder.rstrip('/')}/_{uuid.uuid4().hex}"
        self._name, self._level, self._offset, self.records = name, level, 0, 0
        self._data = self._fs.open_output_stream(self._attempt + ARCHIVE, compression=None)
        self._side = self._fs.open_output_stream(self._attempt + SIDECAR, compression=None)

    def add(self, lines: list[bytes], block: bytes) -> None:
        packed = member(lines, block, self._level)
        self._data.write(packed)

        def text(name: bytes) -> str:
            return header_value(lines, name).decode("utf-8", "replace")

        entry = {
            "archive": self._name + ARCHIVE, "offset": self._offset, "length": len(packed),
            "record_id": text(b"warc-record-id"), "record_type": text(b"warc-type"), "uri": text(b"warc-target-uri"),
        }
        self._side.write(json.dumps(entry).encode() + b"\n")
        self._offset += len(packed)
        self.records += 1

    def publish(self) -> int:
        self._data.close()
        self._side.close()
        self._fs.move(self._attempt + ARCHIVE, self._final + ARCHIVE)
        self._fs.move(self._attempt + SIDECAR, self._final + SIDECAR)
        return self._offset


def normalise(spark: SparkSession, folder: str, out: str, level: int = LEVEL) -> dict[str, int]:
    """Rewrites the archives below `folder`; returns the numbers of archives, records, damaged records and bytes."""
    lines = spark.read.option("lineSep", CRLF).text(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))
    ship(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, int]] = []
        path, reader, writer = None, RecordReader(), None

        def finish() -> None:
            if writer is not None:
                reader.end()
                size = writer.publish()
                done.append((writer.records, reader.damaged, size))

        for batch in batches:
            for at, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != path:
                    finish()
                    name = at.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
                    # Files of one name from different folders stay apart.
                    name += f"-{hashlib.sha256(at.encode()).hexdigest()[:8]}"
                    path, reader, writer = at, RecordReader(), ArchiveWriter(out, name, level)
                if (found := reader.feed(line)) is not None:
                    writer.add(*found)
        finish()
        if done:
            records, damaged, size = zip(*done)
            yield pa.RecordBatch.from_pydict({
                "records": pa.array(records, pa.int64()), "damaged": pa.array(damaged, pa.int64()),
                "bytes": pa.array(size, pa.int64())})

    written = lines.mapInArrow(run, "records long, damaged long, bytes long").agg(
        F.count(F.lit(1)).alias("archives"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "damaged", "bytes")))
    return written.first().asDict()


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """The sidecars below `out`; empty if there are none."""
    return spark.read.schema(INDEX_SCHEMA).option("pathGlobFilter", f"[!_]*{SIDECAR}").json(out)


def page_number(name: bytes) -> int | None:
    digits = name.strip(b"<>").removeprefix(ID_PREFIX.encode())
    return int(digits) if digits.lstrip(b"-").isdigit() else None


def read_records(index: DataFrame, out: str, with_payload: bool = True) -> DataFrame:
    """The records of the index, each read at its offset and inflated alone.

    `payload_bytes` is the full payload's length, for a revisit that of the record it refers
    to. `payload_digest` of a response is taken from the bytes that were read, and `intact`
    says whether it is the one in its header; a revisit's is that of its header.
    """

    def run(batch: pa.RecordBatch) -> dict:
        source, folder = opened(out)
        name, file = None, None
        rows = []
        for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if archive != name:
                name, file = archive, source.open_input_file(f"{folder.rstrip('/')}/{archive}")
            head, _, block = zlib.decompress(file.read_at(length, offset), 31).partition(b"\r\n\r\n")
            lines = head.split(b"\r\n")
            http, _, body = block.removesuffix(b"\r\n\r\n").partition(b"\r\n\r\n")
            kind = header_value(lines, b"warc-type").decode()
            said = header_value(lines, b"warc-payload-digest").decode().removeprefix("sha256:")
            digest = hashlib.sha256(body).hexdigest() if kind == "response" else said
            size = header_value(http.split(b"\r\n"), b"content-length")
            rows.append((
                page_number(header_value(lines, b"warc-record-id")),
                header_value(lines, b"warc-target-uri").decode("utf-8", "replace") or None, kind,
                len(body) if kind == "response" else int(size) if size.isdigit() else None, digest,
                page_number(header_value(lines, b"warc-refers-to")), digest == said,
                body if kind == "response" else None))
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")] + ["payload"]
        return dict(zip(names, zip(*rows)))

    schema = RECORD_SCHEMA + (", payload binary" if with_payload else "")
    return per_batch(index.select("archive", "offset", "length"), run, schema)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """The pages as records of normalised archives in the shared folder, read back through their index."""
    spark = pages.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/llm-warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{base}/streams")
    normalise(spark, f"{base}/streams", f"{base}/archives")
    drop_folder(spark, f"{base}/streams")
    # The folder exists even where no record was written.
    target_fs, folder = opened(f"{base}/archives")
    target_fs.create_dir(folder, recursive=True)
    return read_records(read_index(spark, f"{base}/archives"), f"{base}/archives", with_payload)
