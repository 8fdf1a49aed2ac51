"""The n-gram Jaccard join against all pairs, on small tables."""

import random
import re

import numpy as np
import pyarrow as pa

from factloom.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, key string, n int").repartition(3)
    return sorted(((r.id, r.n, r.component) for r in jaccard.join(docs).collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_groups_of_copies(spark):
    rng = random.Random(3)
    word = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, base = [], word(120)
    rows += [(i, " ".join(edited(rng, base, rng.randrange(0, 5)))) for i in range(60)]
    passage = word(60)
    rows += [(100 + i, " ".join(word(rng.randrange(0, 30)) + passage + word(rng.randrange(0, 30)))) for i in range(60)]
    for g in range(15):
        text = word(rng.randrange(6, 200))
        rows += [(1000 + 10 * g + i, " ".join(edited(rng, text, i))) for i in range(4)]
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "One two"), (2004, "one TWO"), (2005, "one"), (2006, "a b c d e"), (2007, "A b c d e\n"), (None, rows[0][1]), rows[1], (None, "no other text has these words")]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_chains_in_large_groups(spark):
    """Sets that slide along one text: neighbours are linked, far ones are not, and common shingles are in large groups."""
    rng = random.Random(4)
    text = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(text[i * 5 : i * 5 + 100])) for i in range(50)] + [(100 + i, " ".join(text[i * 2 : i * 2 + 60] + [f"x{rng.random()}"] * 3)) for i in range(50)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, [(1, None)]) == [(1, 0, 1)]
    assert run(spark, []) == []


def test_given_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_many_fragments(spark, sf_dir, monkeypatch):
    """Small fragments, small groups and blocks give the same rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = sorted(map(str, jaccard.join(docs).collect()))
    monkeypatch.setattr(jaccard, "FRAGMENT", 3000)
    monkeypatch.setattr(jaccard, "OVERLAP_BITS", 1)
    monkeypatch.setattr(jaccard, "SMALL", 2)
    assert sorted(map(str, jaccard.join(docs).collect())) == one


def test_representatives(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(5, 25)] + [(100, "other words that stay here"), (100, "other words that stay here"), (100, "and a second text of one id"), (7000, None), (7001, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    out = jaccard.representatives(docs)
    assert out.columns == docs.columns
    want = {(5, rows[0][1]), (100, rows[20][1]), (100, rows[22][1]), (7000, None), (7001, ""), (None, "")}
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want


def test_segments_carry_little():
    """Heads of short segments are nine bytes, and all widths of counts come back."""
    rng = np.random.default_rng(3)
    counts = np.concatenate((np.ones(50, np.int64), [0, 300, 70_000], rng.integers(1, 255, 40)))
    keys = rng.integers(-(1 << 62), 1 << 62, len(counts))
    edges = np.concatenate(([0], np.cumsum(counts)))
    cuts = np.array([0, 50, 50, 52, 53, len(counts)])
    table = pa.table(jaccard._blobs(keys, cuts, edges, shingles=np.zeros(edges[-1], np.uint8)))
    got = jaccard._unpacked(table)
    assert (got[0] == keys).all() and (got[1] == counts).all()
    assert sum(table.column(c)[0].as_buffer().size for c in table.column_names) == 50 * (8 + 1 + 1)


def test_pairs_that_stay_are_not_sorted_again_for_each_group(monkeypatch):
    """More pairs than a fragment is to hold: they are sorted a few times in all, and none is lost."""
    groups, size = 150, 24
    rng = np.random.default_rng(3)
    sets = groups * size // 4
    values = rng.permutation(np.repeat(np.arange(groups, dtype=np.uint64), size))
    table = pa.table({
        "key": rng.permutation(sets), "n": pa.array(np.full(sets, 12, np.int32)), "shingles": jaccard._binaries(values, np.arange(sets + 1) * 4),
        "places": jaccard._binaries(np.zeros(4 * sets, np.int32), np.arange(sets + 1) * 4), "root": rng.permutation(sets),
    })
    pairs = lambda t: set(zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True))
    want, sorts, plain = pairs(jaccard._pairs(table, "rest")), [], jaccard._runs
    monkeypatch.setattr(jaccard, "HELD", 500)
    monkeypatch.setattr(jaccard, "_runs", lambda *columns: sorts.append(len(columns)) or plain(*columns))
    assert pairs(jaccard._pairs(table, "rest")) == want and len(want) > 20 * 500
    assert len(sorts) < 20
