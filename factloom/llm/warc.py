"""WARC archives: a writer, and a splittable reader.

Writing: a record is one gzip member. Pages with equal payloads of ``REVISIT`` bytes or more are one response, of the largest
page_id, and revisits that refer to it. Files are written by Spark's text sink, so a lost task leaves nothing behind: the
last byte of a member is the top byte of its length, 0 below 16 MiB, and that 0 is the sink's line separator. After a larger
record an empty member, which every reader skips, ends in the 0.

Reading: files are cut into byte ranges. A task looks for gzip magic in its range, accepts a candidate if its member decodes
and its text begins as a WARC record, and owns the records that start inside, though they may end beyond. Archives inside
a payload can look like records to a task that starts in the middle of one. So a first scan notes how far each range's
records reach, and the second begins each range behind all that reached into it.

Defined cases: null html is an empty payload; a null url gives no target; a null page_id gives a record without a number,
which revisits if its payload is elsewhere too; rows with one page_id and payload are responses both if it is the largest;
an empty table gives no record; further columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import re
import string
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.session import configure, materialize, scratch_path

REVISIT = 1000
#: Bytes of a range, and of one read.
RANGE, BLOCK = 16 << 20, 1 << 18
DATE = "1970-01-01T00:00:00Z"
_MAGIC, _EMPTY = b"\x1f\x8b\x08", gzip.compress(b"", mtime=0)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """The bytes of one record. A revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=string.punctuation)}")
    if revisit:
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as gzip members without their last byte, which is 0."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "keeper", "revisit", "digest")), strict=True)
        out = []
        for row in rows:
            member = gzip.compress(record(*row), compresslevel=5, mtime=0)
            out.append((member if member[-1] == 0 else member + _EMPTY)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write(pages: DataFrame, path: str) -> None:
    """Write archives of (page_id, url, html) to a folder; a partition is a file."""
    configure(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    same = rows.where(F.col("size") >= REVISIT).groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keeper")).where("n > 1").drop("n")
    # Written first, so that its size is known: only payloads that occur again are in it.
    rows = rows.join(materialize(same.withColumn("again", F.lit(True)), "same"), ["digest", "size"], "left")
    revisit = F.coalesce("again", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    members = rows.withColumn("revisit", revisit).select("page_id", "url", "payload", "keeper", "revisit", "digest").mapInArrow(_members, "member binary")
    # The cast keeps the bytes as they are.
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


class _Source:
    """Bytes of a file by position, read in blocks as needed."""

    def __init__(self, uri: str):
        filesystem, path = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
        self.file = filesystem.open_input_file(path)
        self.size = self.file.size()
        self.base, self.data = 0, b""

    def block(self, at: int) -> bytes:
        """Some bytes from a position on; none at the end."""
        if not self.base <= at < self.base + len(self.data):
            self.base, self.data = at, self.file.read_at(min(BLOCK, self.size - at), at) if at < self.size else b""
        return self.data[at - self.base :]

    def find(self, at: int, end: int) -> int:
        """The next magic that starts before ``end``, or -1."""
        while at < end:
            data = self.block(at)
            found = data.find(_MAGIC)
            if found >= 0:
                return at + found if at + found < end else -1
            if len(data) < len(_MAGIC):
                more = self.file.read_at(min(len(_MAGIC), self.size - at), at)
                if more == _MAGIC:
                    return at
                at += 1
                if len(more) < len(_MAGIC):
                    return -1
            else:
                at += len(data) - len(_MAGIC) + 1
        return -1

    def member(self, at: int) -> tuple[int, bytes] | None:
        """The end and the text of a member that is empty or a WARC record; None if it is neither."""
        decode, out, size = zlib.decompressobj(31), [], 0
        begin = at
        try:
            while not decode.eof:
                data = self.block(at)
                if not data:
                    return None
                out.append(decode.decompress(data))
                at += len(data)
                if size < 5:
                    size = sum(map(len, out))
                    if size and b"WARC/".find(b"".join(out)[:5]) != 0:
                        return None
        except zlib.error:
            return None
        text = b"".join(out)
        end = at - len(decode.unused_data)
        return (end, text) if end > begin and (not text or text.startswith(b"WARC/")) else None


def _records(source: _Source, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    at = source.find(start, end)
    while at >= 0:
        found = source.member(at)
        if found and found[1]:
            yield at, found[0], found[1]
        at = source.find(found[0] if found else at + 1, end)


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How far the records that start in each range reach."""
    for batch in batches:
        ends = [max((e for _, e, _ in _records(_Source(r["path"]), r["start"], r["end"])), default=0) for r in batch.to_pylist()]
        yield batch.append_column("reach", pa.array(ends, pa.int64()))


_FIELDS = ["path", "offset", "type", "record_id", "refers_to", "uri", "date", "digest", "http", "payload"]


def _hex(digest: str | None) -> str | None:
    return base64.b32decode(digest.removeprefix("sha1:")).hex() if digest else None


def parse(text: bytes) -> dict:
    """Headers, digest in hexadecimal, HTTP header and payload of a record."""
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {
        "type": fields["WARC-Type"], "record_id": fields["WARC-Record-ID"], "refers_to": fields.get("WARC-Refers-To"), "uri": fields.get("WARC-Target-URI"),
        "date": fields.get("WARC-Date"), "digest": _hex(fields.get("WARC-Payload-Digest")), "http": http.decode(), "payload": payload,
    }


def _read(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 7, pa.binary()]

    def take(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], k) for f, k in zip(_FIELDS, kinds, strict=True)], names=_FIELDS)

    for batch in batches:
        rows, held = [], 0
        for r in batch.to_pylist():
            for at, _, text in _records(_Source(r["path"]), r["start"], r["end"]):
                rows.append({"path": r["path"], "offset": at} | parse(text))
                held += len(text)
                if held > limit:
                    yield take(rows)
                    rows, held = [], 0
        yield take(rows)


def read(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """The records of all archives in a folder: path, offset, WARC fields, HTTP header and payload."""
    configure(spark)
    size = size or RANGE
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + size, "length").alias("end")).repartition(spark.sparkContext.defaultParallelism * 4)
    reached = materialize(ranges.mapInArrow(_reach, "path string, start long, end long, reach long"), "ranges")
    # A row per range; a file has as many as its length says.
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    entered = reached.withColumn("from", F.coalesce(F.max("reach").over(earlier), F.lit(0)))
    owned = entered.select("path", F.greatest("start", "from").alias("start"), "end").where("start < end").repartition(spark.sparkContext.defaultParallelism * 4)
    kinds = "path string, offset long, type string, record_id string, refers_to string, uri string, date string, digest string, http string, payload binary"
    return owned.mapInArrow(partial(_read), kinds)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of the pages, written to the shared folder and read back: a row per record."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    id_of = lambda c: F.when(number(c) != "", number(c).cast("long"))
    rows = read(pages.sparkSession, path)
    response = F.col("type") == "response"
    return rows.select(
        id_of("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.regexp_extract("http", r"(?m)^Content-Length: ([0-9]+)", 1).cast("long")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).alias("own_digest"), "digest", F.col("type").alias("record_type"), id_of("refers_to").alias("refers_to"), "uri",
    )
