"""WARC archives: what is written is read, in any cut, and other readers agree."""

import gzip
import hashlib
import os
import tempfile
from collections import defaultdict

from factloom.llm import queries, warc


def expected(rows):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        keeper = max((x for x in groups[body] if x is not None), default=None)
        revisit = len(body) >= 1000 and len(groups[body]) > 1 and i != keeper
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int")


ROWS = [(1, "http://a/b c\r\nX: y", "x" * 999), (2, None, "x" * 999), (3, "http://é/", "é" * 500), (4, "u", "é" * 500), (9, "u", "é" * 500), (5, "u", None), (6, "u", ""), (None, "u", "é" * 500), (9, "u", "é" * 500)]
ROWS += [(100 + i, "u", "\r\n\r\nWARC/1.1\r\n" + os.urandom(2000).hex()) for i in range(40)] + [(200, "u", "big " * 5_000_000)]


def test_round_trip(spark):
    rows = warc.round_trip(frame(spark, ROWS).repartition(3)).collect()
    assert all(r.own_digest in (None, r.digest) for r in rows)
    assert sorted(((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in rows), key=str) == expected(ROWS)
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_ranges_of_any_size_and_archives_in_payloads(spark):
    folder = tempfile.mkdtemp(prefix="warc-test-")
    inner = b"".join(gzip.compress(warc.record(1000 + i, "in", os.urandom(300), None, False, "00" * 20), mtime=0) for i in range(20))
    records = [warc.record(i, "out", inner if i % 3 else os.urandom(1500), None, False, "00" * 20) for i in range(12)]
    # Members that are stored, not deflated, show the inner archives' bytes as they are.
    data = b"".join(gzip.compress(r, compresslevel=0, mtime=0) for r in records)
    with open(f"{folder}/x.warc.gz", "wb") as f:
        f.write(data)
    with open(f"{folder}/y.warc.gz", "wb") as f:
        f.write(gzip.compress(records[0], mtime=0) + warc._EMPTY + gzip.compress(records[1], mtime=0))
    for size in (500, 4000, 1 << 20):
        got = sorted((r.path[-9:], r.record_id, bytes(r.payload)) for r in warc.read(spark, folder, size).collect())
        want = [("x.warc.gz", r) for r in records] + [("y.warc.gz", r) for r in records[:2]]
        assert got == sorted((p, f"<urn:page:{i % 12}>", r.partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[2][:-4]) for i, (p, r) in enumerate(want))


def test_other_readers_agree(spark):
    path = warc.scratch_path(spark, "warc")
    warc.write(frame(spark, ROWS[:20]).coalesce(1), path)
    data = b"".join(open(f"{path}/{n}", "rb").read() for n in sorted(os.listdir(path)) if n.startswith("part"))
    assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == 20


def test_query(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.op2_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(pages)
