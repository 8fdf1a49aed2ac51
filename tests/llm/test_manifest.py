"""Merkle manifests against a plain tree in Python."""

import hashlib
import random
import string
import zlib

from pyspark.sql import functions as F

from factloom.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx int, tree long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)])


def climb(levels, at, digest, proof):
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        proof += run[: at % 8] + run[at % 8 + 1 :]
        run[at % 8] = digest
        digest, at = H(*run), at // 8
    return digest


def build(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, members = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        members.append(mine)
        trees.append(build([leaf(*r) for r in mine]))
    top = build([t[-1][0] for t in trees])
    out = []
    for k, mine in enumerate(members):
        for at, r in enumerate(mine):
            i, text, *rest = r
            hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
            proof = []
            own = leaf(i, text.translate(LOWER) if hit and text is not None else text, *rest)
            folded = climb(top, k, climb(trees[k], at, own, proof), proof)
            out.append((i, trees[k][0][at], trees[k][-1][0], top[-1][0], H(*proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = manifest.verify(docs, chosen, manifest.lower_ascii(F.col("text")))
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in got.collect()), key=str)


def test_trees_of_many_sizes(spark):
    rng = random.Random(2)
    sizes = {"a": 1, "b": 8, "c": 9, "Z": 65, None: 64, "é": 520, "": 2, "d": 7, "e": 3, "f": 17}
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 37 % 1009, rng.choice((None, "", "Ab É", "low", "X" * 3000)), lang, rng.choice((None, "", "src")), rng.choice((None, 0, 12))))
    got = run(spark, rows)
    assert got == brute(rows) and {r[-1] for r in got} == {True, False}


def test_one_language_one_row_and_none(spark):
    one = [(3, "Text", "en", "s", 4)]
    assert run(spark, one) == brute(one)
    lone = [(i, "Text", "en", "s", 4) for i in range(20)]
    assert run(spark, lone) == brute(lone)
    assert run(spark, []) == []


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "Same", "en", "s", 4)] * 30 + [(None, "Null", "en", None, 1)] * 3 + [(5, "Other", "en", "s", 4), (6, "B", "de", "s", 1)]
    assert run(spark, rows) == brute(rows)
