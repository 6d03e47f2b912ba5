"""Operator 1: WARC archives, index first.

``write_archive`` writes one gzip member a record and returns an index: file, offset, length, URL and digest of
every record.  ``read_archive`` sorts the index rows of the records asked for, coalesces neighbouring byte ranges
into large reads and cuts the records out of them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import store

INDEX = "file string, offset long, length long, url string, digest string, record_id string"
#: Reads join ranges with gaps below GAP bytes and stop growing at READ bytes.
GAP, READ = 64 << 10, 8 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _urn(page_id) -> str:
    return f"urn:x-page:{page_id}"


def _header(value: str | None) -> str:
    """A header's value is one line."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value or "")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit's block has the HTTP head only."""
    block = _HTTP if revisit else _HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_urn(page_id)}>"),
        ("WARC-Target-URI", _header(url)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Refers-To", f"<{_urn(refers_to)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields of a record, and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def first_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with sha, the payload's SHA-1, and first, the smallest page_id among equal payloads of min_bytes or more."""
    keyed = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("sha"))
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    shared = keyed.filter(size >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("sha").alias("copied"), "first")
    return keyed.join(shared, F.col("sha") == F.col("copied"), "left").drop("copied")


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 1, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) below folder; returns the written index.

    Null html is an empty payload.  Of equal payloads of at least min_bytes the one with the smallest page_id is a
    response and the others are revisits that refer to it; of rows that repeat that page_id too, all are responses.
    A null page_id is written as ``None`` and is never referred to.  Control characters in a url are escaped.  A
    task that runs again writes a new file; only files in the index count.  Payloads of any length that fits in a row
    are written whole, further columns of any name are ignored, and an empty table gives an empty index.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, at = TaskContext.get(), None, 0
        fs, root = store.filesystem(folder)
        fs.create_dir(root, recursive=True)
        leaf = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for batch in batches:
            rows: list[tuple] = []
            out = out or fs.open_output_stream(f"{root}/{leaf}.part")
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "first"))
            for page, url, html, sha, first in zip(*columns):
                payload = (html or "").encode()
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record(page, url, payload, digest, first, first is not None and page != first, date)
                data = press.compress(data) + press.flush()
                out.write(data)
                rows.append((f"{folder}/{leaf}", at, len(data), url, digest, _urn(page)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["file", "offset", "length", "url", "digest", "record_id"])
        if out:
            out.close()
            fs.move(f"{root}/{leaf}.part", f"{root}/{leaf}")

    return store.written(first_copies(pages, min_bytes).mapInArrow(store.tidied(write), INDEX), "warc-index")


def coalesced(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Of sorted (offset, length): (from, to, how many of them) of each read."""
    start = end = n = 0
    for offset, length in ranges:
        if n and (offset - end > GAP or offset + length - start > READ):
            yield start, end, n
            n = 0
        if not n:
            start = end = offset
        end, n = max(end, offset + length), n + 1
    if n:
        yield start, end, n


def read_archive(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that index's rows name: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    All from the archives; a response's digest is computed anew from its payload, and a difference is an error.
    payload is null for revisits, and without with_payload.
    """
    spark = index.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def number(urn: str | None):
        text = urn.strip("<>").rpartition(":")[2] if urn else "None"
        return None if text == "None" else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, source = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            rows: list[tuple] = []
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                if files[i] != held:
                    fs, path = store.filesystem(files[i])
                    held, source = files[i], fs.open_input_file(path)
                for start, end, n_records in coalesced(list(zip(offsets[i:j], lengths[i:j]))):
                    data = memoryview(source.read_at(end - start, start))
                    for offset, length in zip(offsets[i : i + n_records], lengths[i : i + n_records]):
                        fields, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(fields["X-Payload-Length"])
                        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{files[i]} at {offset}: the payload is not that of its digest")
                        rows.append((number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], payload if with_payload and kind == "response" else None))
                        if len(rows) >= 2_000:
                            yield table(rows)
                            rows = []
                    i += n_records
            if rows:
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    ordered = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(store.tidied(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op1: all pages to archives and back."""
    index = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), store.work_dir(spark, "warc"))
    return read_archive(index).drop("payload")
