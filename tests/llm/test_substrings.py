"""Substring deduplication against a count of all windows."""

import random
import re
from collections import Counter

from factloom.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for j in range(len(w) - size + 1):
            if seen[tuple(w[j : j + size])] > 1:
                gone.update(range(j, j + size))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def run(spark, rows, size):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, node string").repartition(3)
    return sorted((tuple(r) for r in substrings.remove_repeats(docs, size).collect()), key=str)


def test_random_texts_with_shared_stretches(spark):
    rng = random.Random(5)
    word = lambda n: [f"w{rng.randrange(5000)}é" for _ in range(n)]
    shared = [word(rng.randrange(8, 60)) for _ in range(6)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(0, 5)):
            piece = rng.choice(shared)
            a = rng.randrange(len(piece))
            text += word(rng.randrange(0, 20)) + piece[a : a + rng.randrange(1, 60)]
        rows.append((i, " ".join(text) if i % 2 else "\n".join(text)))
    rows += [(500, "a " * 300), (501, "a b " * 100), (502, None), (503, ""), (504, " \n"), (None, rows[3][1]), rows[5], rows[5]]
    for size in (35, 8):
        assert run(spark, rows, size) == brute(rows, size)


def test_edges(spark):
    ws = [f"t{i}" for i in range(100)]
    rows = [(1, " ".join(ws[:34])), (2, " ".join(ws[:34])), (3, " ".join(ws[:35])), (4, " ".join(ws[40:75])), (5, "x " + "\t".join(ws[40:75]) + " y")]
    assert run(spark, rows, 35) == brute(rows, 35)
    assert run(spark, rows[:0], 35) == []
