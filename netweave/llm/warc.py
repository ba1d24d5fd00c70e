"""WARC archives: a writer with revisit records and a splittable reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave import scratch
from netweave.llm.common import col, keyed, text_of

MAGIC = b"\x1f\x8b\x08"
#: A gzip member of nothing; like any member of under 16 MB it ends in a zero byte.
EMPTY = gzip.compress(b"", mtime=0)
RECORDS = (
    "path string, offset long, end long, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """A gzip member with one record. A revisit keeps the HTTP header, with its length, but no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_name(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each row below ``path``, one file per task.

    Of rows with equal payloads of at least ``min_bytes``, the smallest id is the response and the
    others are revisits of it; null html is an empty payload. Rows that repeat the smallest id and
    its payload are responses too, and a null id is smallest only where there is no other. The
    payloads move once, by row key, so equal payloads do not meet in one task. Further columns are
    not read. An empty table writes no record, and reading it back gives no rows. A payload is one
    member whatever its length, so the longest bounds the memory of a task.

    The bytes go through Spark's text writer and its commit protocol, so a task that is run twice
    leaves one file: the line separator is the zero byte that ends each member.
    """
    pages = scratch.as_files(pages)
    rows = keyed(pages, col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), text_of(html_col).cast("binary").alias("payload"))
    keys = scratch.materialize(rows.filter(F.octet_length("payload") >= min_bytes).select("__row", "page_id", F.sha1("payload").alias("digest")), "payload_digests")
    groups = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = keys.join(groups, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("__row").alias("__r"), "first", F.lit(True).alias("revisit"))
    rows = rows.join(scratch.materialize(again, "revisits"), F.col("__row") == F.col("__r"), "left").select("page_id", "url", "payload", "first", F.coalesce("revisit", F.lit(False)).alias("revisit"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for row in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                    member = record(*row)
                    member = member if member[-1] == 0 else member + EMPTY
                    out.append(member[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    rows.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


class _Window:
    """Bytes of a file around the place of reading."""

    def __init__(self, file, size: int, step: int = 1 << 18):
        self.file, self.size, self.step, self.at, self.data = file, size, step, 0, b""

    def bytes_at(self, at: int, n: int) -> bytes:
        """At least ``n`` bytes from ``at`` on, or what there is."""
        have = at - self.at
        if have < 0 or have > len(self.data):
            self.at, self.data, have = at, b"", 0
        if len(self.data) - have < n and self.at + len(self.data) < self.size:
            self.file.seek(self.at + len(self.data))
            self.data = self.data[have:] + self.file.read(max(n, self.step))
            self.at, have = at, 0
        return self.data[have:]

    def find(self, start: int, stop: int) -> int:
        """The first place of MAGIC in start .. stop - 1, or -1."""
        while start < stop:
            data = self.bytes_at(start, self.step)
            i = data.find(MAGIC)
            if i >= 0:
                return start + i if start + i < stop else -1
            if start + len(data) >= self.size:
                return -1
            start += max(1, len(data) - len(MAGIC) + 1)
        return -1

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The content of the gzip member at ``at`` and the place after it; None if no WARC record is there."""
        d, out, n, pos = zlib.decompressobj(31), [], 0, at
        while not d.eof:
            data = self.bytes_at(pos, 1)[: self.step]
            if not data:
                return None
            try:
                out.append(d.decompress(data))
            except zlib.error:
                return None
            pos += len(data) - len(d.unused_data)
            n += len(out[-1])
            if n >= 5 and not (out := [b"".join(out)] if len(out) < 3 else out)[0].startswith(b"WARC/"):
                return None
        whole = b"".join(out)
        return (whole, pos) if whole.startswith(b"WARC/") else None


def _parse(content: bytes) -> tuple:
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"^([\w-]+):[ \t]*(.*?)\r?$", head.decode("utf-8", "replace"), re.M))
    page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    if kind == "revisit":
        said = re.search(rb"(?mi)^content-length:[ \t]*(\d+)", http)
        size, digest, payload = int(said[1]) if said else None, fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), None
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return page("WARC-Record-ID"), fields.get("WARC-Target-URI"), kind, page("WARC-Refers-To"), size, digest, payload


def read_warc(spark: SparkSession, path: str, range_bytes: int = 32 << 20, with_payload: bool = True) -> DataFrame:
    """The records of the archives below ``path``, read by byte ranges of ``range_bytes``.

    A task looks for the gzip magic in its range, takes a place where a WARC header can be decoded
    for a record, and owns the records that start inside, reading past its end for the last one.
    Places that do not decode to the end of a member are no records. A record whose payload
    holds an archive in plain bytes may show one of its inner records to the task whose range starts
    there; such a record starts before an earlier one of the file ends and is dropped.
    Payload digests of responses are computed from the payload, those of revisits are read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("begin"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.repartition(max(n, 2 * spark.sparkContext.defaultParallelism), "path", "begin")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("path", pa.string()), *[(k, pa.int64()) for k in ("offset", "end", "page_id")], ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for uri, size, begin in zip(*[c.to_pylist() for c in batch.columns]):
                store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    window, at, stop = _Window(file, size), begin, min(begin + range_bytes, size)
                    while (at := window.find(at, stop)) >= 0:
                        if (got := window.member(at)) is None:
                            at += 1
                            continue
                        row = (uri, at, got[1], *_parse(got[0]))
                        rows.append(row if with_payload else (*row[:-1], None))
                        held += len(got[0]) * with_payload
                        at = got[1]
                        if len(rows) >= 4096 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    found = scratch.materialize(ranges.select("path", "length", "begin").mapInArrow(scan, RECORDS), "records")
    # within its range a task reads record after record; only the last one of a range reaches into later ranges
    begin = F.col("offset") - F.pmod("offset", F.lit(range_bytes).cast("long"))
    step = F.lit(range_bytes).cast("long")
    over = found.filter(F.col("end") > begin + step).select(F.col("path").alias("__path"), F.explode(F.sequence(begin + step, F.col("end") - 1, step)).alias("__begin"), F.col("end").alias("__end"))
    over = over.groupBy("__path", "__begin").agg(F.max("__end").alias("__end"))
    found = found.withColumn("__b", begin).join(over, (F.col("path") == F.col("__path")) & (F.col("__b") == F.col("__begin")), "left")
    return found.filter("__end is null or offset >= __end").drop("__path", "__begin", "__end", "__b")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT *, sha1(payload) AS h, min(page_id) OVER (PARTITION BY sha1(payload)) AS first FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
         (('0x' || substr(h || '00', 1 + (i * 5) // 4, 3))::BIGINT >> (12 - (i * 5) % 4 - 5)) & 31)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d
"""
