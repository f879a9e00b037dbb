"""WARC archives: written with an index, read back by byte ranges.

Writing: pages with equal payloads (by SHA-1, found with one aggregation) have one response record, that with the largest
page_id; the others become revisit records that name it and carry no payload. Each task appends gzip members to an archive of
its own in the shared folder and returns an index row per record: file, offset, length, URL, payload digest. The index is a
written table, so a retried task's new file replaces the lost one's rows, and files of failed tries are never read.

Reading: index rows are dealt by stretches of a file and sorted by offset; neighbouring records are fetched in one read of at
most RANGE bytes, across gaps of at most GAP bytes. A response's length and digest come from its payload, which must match the digest in
its header.

Defined results: a null html is an empty payload, a null URL an empty one. A payload is kept byte for byte; read back as text, bytes that are
not UTF-8 show as U+FFFD. Rows that repeat a page_id with one payload are all
responses if it is the largest; a null page_id counts as the smallest. Further columns are ignored; an empty table gives no
archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, map_batches, utf8, written

MIN_PAYLOAD = 0
DATE = "2024-01-01T00:00:00Z"
#: Most bytes of one read, and the gap worth reading across.
RANGE = 4 << 20
GAP = 64 << 10
#: Bytes of a file whose records go to one task's read.
STRETCH = 32 << 20
INDEX = "page_id long, url string, digest string, record_type string, file string, start long, size long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, n_bytes: int) -> bytes:
    """One record, uncompressed: a response, or a revisit if refers_to is given."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if " " < c else f"%{ord(c):02X}" for c in url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {n_bytes}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the body."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    n = int(fields["content-length"])
    if len(rest) < n + 4 or rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
    return fields, rest[:n]


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _page_of(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "None" else int(value)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Appends every row to this task's archive; index rows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    out, name, at = None, f"part-{uuid.uuid4().hex}.warc.gz", 0
    try:
        for b in batches:
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}", compression=None)  # the members are compressed already
            rows = []
            for page, url, html, n, keep, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                digest = base64.b32encode(bytes.fromhex(keep)).decode()
                member = _member(record(page, url, html, digest, first, n))
                out.write(member)
                rows.append((page, url, digest, "response" if first is None else "revisit", f"{folder}/{name}", at, len(member)))
                at += len(member)
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "url", "digest", "record_type", "file", "start", "size"])
    finally:
        if out is not None:
            out.close()


def write_archives(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Writes the pages (page_id, url, html) as archives into a folder all machines see; the index, as a written table."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "sha": F.sha1(F.col("html").cast("binary"))})
    # Only ids and digests are aggregated; the join's large side can be split where one payload has many copies.
    kept = rows.groupBy("sha").agg(F.max("page_id").alias("keep"))
    rows = rows.join(kept, "sha")
    copy = (F.col("n") >= min_payload) & ~F.col("page_id").eqNullSafe(F.col("keep"))
    first = F.when(copy, F.col("keep"))
    payload = F.when(copy, F.lit("")).otherwise(F.col("html"))
    sent = rows.select("page_id", "url", payload.alias("html"), "n", "sha", first.alias("first"))
    return written(map_batches(sent, partial(_write, folder=folder), INDEX), "warc-index")


def _ranges(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows (file, start, size, ...) in order, cut into stretches for one read each."""
    run: list[tuple] = []
    for r in rows:
        if run and (r[0] != run[-1][0] or r[1] - (run[-1][1] + run[-1][2]) > GAP or r[1] + r[2] - run[0][1] > RANGE):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def _read(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    """Records of index rows, sorted by file and offset."""
    from pyarrow import fs

    name, source = None, None
    for b in batches:
        index = list(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for run in _ranges(index):
            if run[0][0] != name:
                if source is not None:
                    source.close()
                name = run[0][0]
                system, path = fs.FileSystem.from_uri(name)
                source = system.open_input_file(path)
            base = run[0][1]
            raw = source.read_at(run[-1][1] + run[-1][2] - base, base)
            rows = []
            for _, start, size, page, url in run:
                fields, body = parsed(zlib.decompress(raw[start - base : start - base + size], 31))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                kind, refers, n = fields["warc-type"], None, int(fields["warc-payload-length"])
                if kind == "response":
                    if digest32(body) != digest or len(body) != n:
                        raise ValueError(f"the payload of page {page} does not match its digest")
                else:
                    refers = _page_of(fields["warc-refers-to"])
                rows.append((page, url, n, digest, kind, refers, body.decode("utf-8", "replace") if payload and kind == "response" else None))
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    if source is not None:
        source.close()


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the given index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (of responses)."""
    dealt = index.withColumn("stretch", F.floor(F.col("start") / STRETCH)).repartition("file", "stretch").sortWithinPartitions("file", "start").drop("stretch")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    return map_batches(dealt, partial(_read, payload=payload), schema)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = write_archives(pages, fresh_path(spark, "warc"))
    return read_records(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
