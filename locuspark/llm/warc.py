"""WARC archives with revisit records for payloads that were seen before.

Headers alone are shuffled by payload digest to find each repeated payload's
original; payloads never are.  What was decided goes back to each partition of
the pages as a file, and a second scan writes response or revisit records, in
gzip members of archive files in the shared folder.  Reading the archives joins
revisits to the responses that they refer to.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.llm import files
from locuspark.llm.common import materialise, scratch_path, stable, write_by_partition

#: Payloads shorter than this are always written whole.
LEAST_REVISIT_BYTES = 1000
#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122

RECORDS = "page_id long, url string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to_record string"


def record_id(page_id: int | None, digest: str, row: int) -> str:
    """Differs for every row, also of rows that repeat page and payload."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}:{digest}:{row}')}>"


def _header_value(text: str) -> str:
    """A URL without the characters that would end a header line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, name: str, refers_to: str | None, date: str) -> bytes:
    """One gzip member: a response, or a revisit of the record ``refers_to``."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")]
    head.append(f"WARC-Record-ID: {name}".encode())
    head.append(f"WARC-Date: {date}".encode())
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}".encode())
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}".encode())
    head.append(f"WARC-Payload-Digest: sha1:{digest}".encode())
    if refers_to is None:
        head.append(b"Content-Type: text/html; charset=utf-8")
    else:
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {refers_to}".encode())
        payload = b""
    head.append(f"Content-Length: {len(payload)}".encode())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n") + packer.compress(payload) + packer.compress(b"\r\n\r\n") + packer.flush()


def decode_records(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, names in lower case, and payload of each record; holds one record at a time."""
    rest = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            rest = rest or stream.read(chunk)
            if not rest:
                if parts or unpacker.unconsumed_tail:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        record = b"".join(parts)
        head, _, body = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        n = int(headers["content-length"])
        if body[n:] != b"\r\n\r\n":
            raise ValueError("the record's length is wrong")
        yield headers, body[:n]


def _write_decisions(rows: DataFrame, path: str, least_bytes: int) -> None:
    """For each partition of the pages a file: its rows in order, their digests, and the page and row that a revisit refers to."""
    headers = materialise(rows.select("row", "page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")), "warc-headers")
    long = headers.where(F.col("size") >= least_bytes).drop("size")
    best = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.negative(F.col("row")).alias("row"))))
    originals = long.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1 and best is not null").drop("n")
    revisit = F.col("best").isNotNull() & (F.col("size") >= least_bytes) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("best.page_id")))
    decided = headers.join(originals, "digest", "left").select(
        "row", "digest", F.when(revisit, F.col("best.page_id")).alias("original"), F.when(revisit, F.negative(F.col("best.row"))).alias("original_row")
    )
    write_by_partition(decided, path)


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Write ``page_id``, ``url``, ``html`` rows as WARC files; returns ``file``, ``records``, ``bytes``.

    Null html is an empty payload.  A null page_id can't be referred to: such
    rows revisit the largest id of their payload if there is one.  Rows that
    repeat the largest id with the same payload are responses all of them, and
    each has a record id of its own; rows that repeat an id with another
    payload are judged by their own payload.  Other columns are left out.

    ``pages`` is scanned twice, to decide and to write; what is not a scan of
    files is written to a table first.
    """
    rows = stable(pages.select("page_id", "url", "html"), "warc-pages").select(
        F.monotonically_increasing_id().alias("row"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    decisions = scratch_path(pages.sparkSession, "warc-decisions")
    _write_decisions(rows, decisions, least_bytes)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        known, at = None, 0
        for batch in batches:
            for row, page, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if known is None:
                    known = [c.to_pylist() for c in files.read_block(f"{decisions}/{row >> 33:07d}.arrow").columns]
                payload = payload.encode()
                digest = hashlib.sha1(payload).hexdigest()
                if at >= len(known[0]) or (known[0][at], known[1][at]) != (row, digest):
                    raise ValueError("the pages differ from those that were compared; write them to a table first")
                original, original_row = known[2][at], known[3][at]
                at += 1
                refers_to = None if original is None else record_id(original, digest, original_row)
                yield encode_record(page, url, payload, digest, record_id(page, digest, row), refers_to, date)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, written = TaskContext.get().partitionId(), 0, []
        made = encoded(batches)
        record = next(made, None)
        while record is not None:
            name, records = f"{path}/pages-{task:06d}-{part:04d}.warc.gz", 0
            with files.writing(name) as out:
                while record is not None and out.tell() < archive_bytes:
                    out.write(record)
                    records += 1
                    record = next(made, None)
                size = out.tell()
            written.append((name, records, size))
            part += 1
        if written:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*written)], ["file", "records", "bytes"])

    return materialise(rows.mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


def read_records(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives, as ``RECORDS``; with ``payloads``, also what responses hold.

    Digests and sizes of responses are those of the payload that was read;
    a payload that differs from its digest is an error.
    """
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in RECORDS.split(", ")] + ["payload"] * payloads
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.reading(name) as stream:
                    for headers, body in decode_records(stream):
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        whole = kind == "response"
                        if whole and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload differs from its digest")
                        page = headers.get("x-page-id")
                        row = (None if page is None else int(page), headers.get("warc-target-uri"), headers["warc-record-id"], kind, digest, len(body) if whole else None, headers.get("warc-refers-to"))
                        rows.append(row + ((body if whole else None,) if payloads else ()))
                        held += len(body) * payloads
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield _batch(rows, names, kinds)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names, kinds)

    return manifest.select("file").repartition(n).mapInArrow(read, RECORDS + ", payload binary" * payloads)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with sizes, and for revisits ``refers_to``, from the responses that they refer to."""
    responses = records.where("record_type = 'response'")
    referred = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("whole_bytes"))
    revisits = records.where("record_type = 'revisit'").join(referred, "refers_to_record", "left")
    columns = ["page_id", "payload_digest", "record_type"]
    return responses.select(*columns, "payload_bytes", F.lit(None).cast("long").alias("refers_to")).union(
        revisits.select(*columns, F.col("whole_bytes").alias("payload_bytes"), "refers_to")
    )


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read them, and resolve the revisits."""
    manifest = write_archives(pages, scratch_path(pages.sparkSession, "warc"))
    records = materialise(read_records(manifest), "warc-records")
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
