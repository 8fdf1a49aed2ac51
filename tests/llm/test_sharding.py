"""K-d tree shards: every cut against sorted rows, and what holds for any table."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from factloom.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, node string"


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "a", 5, "b") for r in rows], SCHEMA).repartition(5)
    return sharding.shard(docs, **options).collect()


def law(got, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    total, most = sum(r.size for r in got), max((r.size for r in got), default=0)
    for s in range(shards):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        # Each of the cuts above a leaf is off by half a row at most.
        assert abs(sum(r.size for r in mine) - total / shards) <= most


def table(n):
    return [(i, f"text {i * 7919 % 1009} " * (1 + i % 7), ("en", "de", None)[i % 3], f"src{i % 4 if i % 3 else 0}", 10 * (1 + i % 7)) for i in range(n)]


def test_near_equal_bytes(spark):
    rows = table(900)
    law(run(spark, rows, shards=16), rows, 16)


def test_odd_numbers_and_targets(spark):
    rows = table(300)
    law(run(spark, rows, shards=5), rows, 5)
    total = sum(len(r[1]) + 1 for r in rows)
    got = run(spark, rows, target_bytes=total // 3 + 1)
    law(got, rows, 3)


def test_copies_and_repeated_rows(spark):
    # A text that holds a third of all bytes under many ids, and a row repeated so often.
    rows = table(300) + [(1000 + i, "the same text", "en", "src0", 13) for i in range(400)] + [(5000, "one row", "en", "src1", 7)] * 400
    law(run(spark, rows, shards=8), rows, 8)


def test_nulls_long_texts_and_few_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "é" * 50_000, "en", "s", -4), (3, "x", None, "s", 2**62), (3, "x", None, "s", 2**62)]
    law(run(spark, rows, shards=4), rows, 4)
    assert run(spark, [], shards=4) == []


def test_cut_is_the_weighted_median(spark):
    rows = table(400)
    got = {r.doc_id: r.shard for r in run(spark, rows, shards=2)}
    docs = spark.createDataFrame([(*r, "a", 5, "b") for r in rows], SCHEMA)
    keys = sharding.metadata(docs).select("doc_id", "size", F.col("keys")[0].alias("k")).collect()
    half, run_, left = sum(r.size for r in keys) / 2, 0, set()
    for r in sorted(keys, key=lambda r: r.k):
        if run_ + r.size / 2 > half:
            break
        run_ += r.size
        left.add(r.doc_id)
    assert {i for i, s in got.items() if s == 0} == left


def test_equal_texts_part_only_at_cuts(spark):
    rows = [(i, f"text {i % 50}", "en", "one", 9) for i in range(500)]
    parts = {}
    for r in run(spark, rows, shards=4):
        parts.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(p) > 1 for p in parts.values()) <= 3


def test_number_coordinates_ascend(spark):
    values = [0, 1, 2, 3, 511, 512, 513, 1024, 5000, 2**40, 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "n long").select(sharding.number_coordinate("n").alias("c")).collect()
    places = [r.c for r in rows]
    assert places == sorted(places) and places[-1] < 1 << sharding.COORDINATE_BITS and places[0] == 0
