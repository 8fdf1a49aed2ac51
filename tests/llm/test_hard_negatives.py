"""Hard negatives against all pairs in plain Python, and the streaming pass on its own."""

import math
import random

from pyspark.sql import functions as F

from factloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, id string, score int, anchor boolean"


def brute(rows, every=10):
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(256 * x) for x in v):
            continue
        q = (label, tuple(v))
        if i not in best or q < best[i]:
            best[i] = q
    known = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in best.items()}

    def score(a, b):
        return max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=False))))

    out = []
    for a in known:
        if a % every:
            continue
        order = sorted(((-score(known[a][1], v), i, label) for i, (label, v) in known.items() if i != a))
        for p, pid, _ in [x for x in order if x[2] == known[a][0]][:5]:
            inside = [(s, i) for s, i, label in order if label != known[a][0] and 80 * -p <= 100 * -s <= 100 * -p]
            out += [(a, pid, k, i, -p, -s) for k, (s, i) in enumerate(inside[:5], 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in H.mine(df, "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0).collect())


def test_ties_repeats_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((0.0, 0.5, 1.0)) for _ in range(4)], rng.randrange(3)) for i in range(-40, 200)]
    rows += rows[::3] + [(7, [1.0, 1.0, 1.0, 1.0], 1), (20, [1.0], 0), (30, [], 0), (40, [0.25] * 6, 2)]
    rows += [(1000, None, 1), (1010, [1.0], None), (None, [1.0], 1), (1020, [float("nan"), 1.0], 1), (1030, [None, 1.0], 1), (1040, [float("inf")], 1), (1050, [1e307], 1)]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(i, [float(2 ** (20 + i)), float(3 * i + 1)], i % 2) for i in range(0, 40)]
    assert run(spark, rows) == brute(rows)


def test_negative_scores_and_lone_labels(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-0.9, 0.0], 1), (3, [0.0, 1.0], 0), (4, [0.0, 2.0], 1), (10, [1.0, 1.0], 5)]
    got = run(spark, rows)
    assert got == brute(rows) == [(0, 3, 1, 4, 0, 0)]


def test_empty(spark):
    assert run(spark, []) == []


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "ROW_BLOCK", 500)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 100)
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.randrange(4)) for i in range(300)] + [(i, [0.5] * 8, i % 4) for i in range(300, 400)]
    assert run(spark, rows) == brute(rows)


def test_keys_sort_as_numbers():
    triples = [(a, s, i) for a in (-5, 0, 3) for s in (-(1 << 63), -1, 0, 9, (1 << 63) - 1) for i in (-2, 0, 8)]
    assert [H.unpack(k) for k in sorted(H.pack(*t) for t in triples)] == sorted(triples, key=lambda t: (t[0], -t[1], t[2]))
