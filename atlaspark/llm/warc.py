"""WARC archives: index first, then coalesced byte-range reads of selected records."""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_folder, table

INDEX = "archive string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, a gzip member of its own so that it can be read alone. A revisit keeps the HTTP header, which states the payload's length, without the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


_URL_SAFE = "".join(chr(c) for c in range(33, 127))


def parse_record(record: bytes) -> dict:
    """The fields of one record; raises where a length or a payload's digest does not hold."""
    head, block = gzip.decompress(record).split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, root: str, min_revisit_bytes: int = 0, segment_bytes: int = 1 << 30, date: str | None = None) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) below root; return the index.

    Each task writes segments of its own, named by attempt, and returns the
    index rows of just those: what a lost or repeated attempt has written is
    never referred to. Of equal payloads of min_revisit_bytes or more, the one
    with the largest page_id is the response that the others refer to; smaller
    payloads are all responses. Which rows are revisits is worked out on ids and
    digests alone, and payloads then move once, dealt by page. `date` is every
    record's WARC-Date, by default the time of the call.

    Null html is an empty payload; a null url gives no target; control
    characters in a url are percent-encoded; rows that repeat the largest
    page_id of a payload are all responses; a null page_id is smaller than any
    other, and payloads that only null page_ids have are responses; an empty
    table gives an empty index; other columns are ignored.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    records = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    keys = records.where(F.length("payload") >= min_revisit_bytes).groupBy("page_id", "sha1").agg(F.count("*").alias("n"))
    shared = keys.groupBy("sha1").agg(F.max("page_id").alias("response"), F.sum("n").alias("n")).where("n > 1 AND response IS NOT NULL").select("sha1", "response")
    revisits = keys.join(shared, "sha1").where("page_id IS NULL OR page_id < response").select(F.col("page_id").alias("id"), F.col("sha1").alias("digest"), F.col("response").alias("refers_to"))
    joined = records.join(revisits, records["page_id"].eqNullSafe(revisits["id"]) & (records["sha1"] == revisits["digest"]), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(root)
        fs.create_dir(folder, recursive=True)
        stream, name, at, segment = None, "", 0, 0
        context = TaskContext.get()
        try:
            for batch in batches:
                rows = []
                for page_id, url, body, sha1, refers_to in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to")], strict=True):
                    page_id, url, refers_to, digest = page_id.as_py(), url.as_py(), refers_to.as_py(), _base32(sha1.as_py())
                    record = record_bytes(page_id, url, body.as_py(), digest, refers_to, date)
                    if stream is None or at >= segment_bytes:
                        if stream is not None:
                            stream.close()
                        name, at, segment = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{segment}.warc.gz", 0, segment + 1
                        stream = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    stream.write(record)
                    rows.append((name, at, len(record), url, digest, "response" if refers_to is None else "revisit", page_id))
                    at += len(record)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEX_TYPES, strict=True)], names=_INDEX_NAMES)
        finally:
            if stream is not None:
                stream.close()

    return materialize(joined.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(write, INDEX))


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in INDEX.split(", ")]


def read_records(index: DataFrame, root: str, gap_bytes: int = 1 << 16, read_bytes: int = 1 << 23, task_bytes: int = 1 << 23) -> DataFrame:
    """Read the records that an index (or any selection of its rows) points to.

    Rows are ranged and sorted by archive and offset, so that each task reads a
    contiguous stretch of about task_bytes; neighbours at most gap_bytes apart are fetched by one
    read of up to read_bytes (one record may be larger). An index row that
    repeats gives its record again; an empty index gives no rows; a damaged
    record raises an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(root)
        name, file = None, None

        def emit(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=_RECORD_SCHEMA)

        for batch in batches:
            wanted = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            i = 0
            while i < len(wanted):
                archive, start, length = wanted[i]
                end, j = start + length, i + 1
                while j < len(wanted) and wanted[j][0] == archive and wanted[j][1] - end <= gap_bytes and wanted[j][1] + wanted[j][2] - start <= read_bytes:
                    end, j = max(end, wanted[j][1] + wanted[j][2]), j + 1
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, fs.open_input_file(f"{folder}/{archive}")
                file.seek(start)
                data = file.read(end - start)
                yield emit([parse_record(data[o - start : o - start + n]) for _, o, n in wanted[i:j]])
                i = j
        if file is not None:
            file.close()

    stretches = max(1, (index.agg(F.sum("length")).first()[0] or 0) // task_bytes)
    ranged = index.select("archive", "offset", "length").repartitionByRange(stretches, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ranged.mapInArrow(read, RECORD)


_RECORD_SCHEMA = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in RECORD.split(", ")])


def op5_warc(spark, sf_dir: str) -> DataFrame:
    root = new_folder(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), root)
    return read_records(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
                  max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS m
           FROM pages)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < m THEN m END AS refers_to
FROM p
"""

QUERIES = {"op5_warc": op5_warc}
ORACLES = {"op5_warc": ORACLE}
