"""Hashes against words that made polynomials modulo 2^64 collide: Thue-Morse words and their complements."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_jaccard import brute as jaccard_brute
from test_jaccard import run as jaccard_run
from test_packing import LIBRARY, ids_of
from test_substrings import brute as substrings_brute
from test_substrings import run as substrings_run

from factloom.llm import quality, token_counts
from factloom.llm import words as W


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


PAIRS = [(thue_morse(n, a, b), thue_morse(n, b, a)) for n in (1024, 2048, 4096) for a, b in (("a", "b"), ("x", "é"), ("0", "~"))]


def hashes(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    return W.byte_hashes(data, ends - [len(t.encode()) for t in texts], ends)


def test_bytes():
    texts = [t for pair in PAIRS for t in pair] + ["a" * n for n in range(40)] + [c + "\0" * n for c in "ab" for n in range(20)]
    assert len(set(hashes(texts).tolist())) == len(set(texts))
    assert hashes(["abc", "xabc", "abc"])[0] == hashes(["abc"])[0] == hashes(["1234567", "abc"])[1]


def test_ranges_of_words():
    rng = np.random.default_rng(1)
    two = rng.integers(0, 2**64, 2, np.uint64)
    pattern = np.array([bin(i).count("1") % 2 for i in range(4096)])
    values = np.concatenate((two[pattern], two[1 - pattern], two[pattern]))
    at = np.array([0, 4096, 8192])
    a, b, c = W.range_hashes(values, at, at + 4096)
    assert a == c != b
    every = rng.integers(0, 2**64, 300, np.uint64)
    starts = np.arange(200)
    twice = np.concatenate((every[50:], every))
    assert (W.range_hashes(every, starts + 50, starts + 90) == W.range_hashes(twice, starts, starts + 40)).all()
    assert W.range_hashes(np.zeros(5, np.uint64), np.array([0, 0]), np.array([2, 3])).tolist()[0] != W.range_hashes(np.zeros(5, np.uint64), np.array([0, 0]), np.array([2, 3])).tolist()[1]


@pytest.mark.parametrize("pair", PAIRS[:3])
def test_ids(pair):
    texts = list(pair) + [pair[0] + " " + pair[1]]
    assert ids_of(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_joins(spark):
    rng = random.Random(4)
    rows = []
    for i, (a, b) in enumerate(PAIRS):
        tail = [f"w{rng.randrange(10**6)}" for _ in range(3)]
        rows += [(10 * i, " ".join([a] * 40 + tail)), (10 * i + 1, " ".join([b] * 40 + tail)), (10 * i + 2, a), (10 * i + 3, b)]
    assert jaccard_run(spark, rows) == jaccard_brute(rows)
    rows = [(2 * i + j, " ".join([w] + [f"v{i}_{k}" for k in range(34)])) for i, p in enumerate(PAIRS) for j, w in enumerate(p)]
    assert substrings_run(spark, rows, 35) == substrings_brute(rows, 35)


def test_lines(spark):
    a, b = PAIRS[0]
    docs = spark.createDataFrame([(1, f"{a}\n{b}\n{a}\n", "s", "en", 1), (2, " ".join([*"wxyz", a, *"wxyz", b] * 2), "s", "en", 1)], "doc_id long, text string, source string, lang string, n_chars long")
    got = {r.id: r for r in quality.judge(docs).collect()}
    assert got[1].n_dup_lines == 1 and got[2].n_repeat_words == 20


def test_long_words_take_seconds(spark):
    vocabulary = token_counts.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé漢0") for _ in range(n)) for n in (40, 100, 250)]
    flat = np.frombuffer("".join(token_counts.BLANK + w for w in words).encode(), np.uint8)
    ends = np.cumsum([len((token_counts.BLANK + w).encode()) for w in words])
    assert token_counts.trie_counts(flat, np.concatenate(([0], ends[:-1])), ends, vocabulary).tolist() == [vocabulary.count(token_counts.BLANK + w) for w in words]
    text = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    (batch,) = token_counts._count(iter([pa.RecordBatch.from_pydict({"id": [1, 2], "text": [text, "short one"]})]), public_tokenizers.path("piece_bpe_32k.model"))
    assert batch.column("n_tokens").to_pylist()[0] == vocabulary.count(token_counts.BLANK + text)
