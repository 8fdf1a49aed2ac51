"""Quality rules against a plain count."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from factloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def lines_of(text):
    found = Counter()
    for line in (text or "").split("\n"):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line))
        if words:
            found[tuple(words)] += len(words)
    return found


def expected_removed(rows, limit):
    """Lines above the limit; each text here is unrelated to the others or an exact copy."""
    texts = defaultdict(set)
    for _, text, host in rows:
        for line in lines_of(text):
            texts[host or "", line].add(text)
    return {k for k, v in texts.items() if len(v) > limit}


def unique_words(i, n):
    return " ".join(f"w{i}x{j}" for j in range(n))


def make(spark, rows):
    return spark.createDataFrame([(i, t, h, "en", len(t or ""), 1) for i, t, h in rows], "doc_id long, text string, source string, lang string, n_chars long, id int")


def test_counts_lines_and_verdicts(spark):
    rows = [(i, f"{unique_words(i, 30)}\nCookie  notice here\n{unique_words(-i, 5)}", "a") for i in range(1, 9)]
    rows += [(i, f"cookie NOTICE here\n{unique_words(i, 1)}\n" + "cookie notice here\n" * 4, "a") for i in range(20, 23)]
    rows += [(30, None, None), (31, "", "a"), (32, "a b c d e f a b c d e\xa0é 😀 <x>|", "a"), (33, "\n \n\x0b x", "b"), (34, "word " * 40000, "b")]
    rows += [(i, f"{unique_words(99, 20)}\ncopied line of the same text", "c") for i in range(40, 60)]
    rows += [rows[0], (None, rows[1][1], "a")]
    got = quality.judge(make(spark, rows), max_docs=5).collect()
    assert len(got) == len(rows)
    removed = expected_removed(rows, 5)
    assert {k[1] for k in removed} == {("cookie", "notice", "here")}
    by_id = {i: (t, h) for i, t, h in rows}
    for r in got:
        text, host = by_id[r.id]
        want = base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        lost = sum(n for line, n in lines_of(text).items() if (host or "", line) in removed)
        assert r.n_left == want[0] - lost
        assert r.kept == (not want[5] and r.n_left >= 0.3 * want[0])


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = quality.judge(docs, max_docs=3).collect()
    assert len(got) == len(text)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text[r.id])


def test_near_copies_are_no_boilerplate(spark):
    body = [unique_words(i, 40) for i in range(8)]
    rows = [(i, "\n".join([*body[: i % 8], unique_words(1000 + i, 6), *body[i % 8 :]]), "a") for i in range(60)]
    assert quality.judge(make(spark, rows), max_docs=5).where("kept").count() == 60


def test_pages_with_a_common_passage_are_no_copies(spark):
    for common, own in ((50, 50), (60, 40), (70, 30), (80, 20), (85, 20)):
        rows = [(i, f"{unique_words(0, common)}\n{unique_words(i, own)}", "a") for i in range(1, 101)]
        got = quality.judge(make(spark, rows)).collect()
        assert {r.n_left for r in got} == {own} and {r.kept for r in got} == {own >= 0.3 * (common + own)}


def test_copies_count_once_among_others(spark):
    near = lambda i: f"{unique_words(0, 200)}\n{unique_words(i, 12)}"
    rows = [(i, near(i), "a") for i in range(1, 1001)] + [(i, near(i), "b") for i in range(1001, 1301)]
    rows += [(i, f"{unique_words(0, 200)}\n{unique_words(i, 150)}", "b") for i in range(2001, 2051)]
    got = quality.judge(make(spark, rows)).collect()
    assert {r.n_left for r in got if r.host == "a"} == {212} and {r.n_left for r in got if r.host == "b"} == {12, 150}


def test_clean_and_empty(spark):
    rows = [(i, f"{unique_words(i, 30)}\nCookie  notice here", "a") for i in range(9)] + [(50, "too short", "a")]
    docs = make(spark, rows)
    out = quality.clean(docs, max_docs=5)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(i, unique_words(i, 30), len(unique_words(i, 30))) for i in range(9)}
    assert quality.judge(docs.limit(0)).count() == 0 and quality.clean(docs.limit(0)).count() == 0


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for g in range(60):
        words = [f"g{g}w{k}" for k in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(2, 6)):
            text = list(words)
            # Edits apart from each other, each of five shingles: similarities lie about the limit.
            for at in range(0, len(text), rng.choice((40, 56, 64, 96))):
                text[at] = f"x{len(rows)}at{at}"
            text[0] = text[0].upper()
            rows.append((len(rows) + 1, " ".join(text), "a"))
    docs = make(spark, rows)
    measured = quality.measured(docs)
    texts = measured.groupBy("text_key").agg(F.min("sketch").alias("sketch"))
    roots = {r.node: r.root for r in quality.near_copies(texts, docs).collect()}
    keys = {r.id: r.text_key for r in measured.collect()}
    sets = {}
    for i, text, _ in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text).split(" ")
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    linked = [(i, j) for i in sets for j in sets if j < i and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])]
    for i, j in linked:
        up[root(i)] = root(j)
    same = lambda i, j: roots.get(keys[i], i) == roots.get(keys[j], j)
    assert len(linked) > 100
    assert sum(same(i, j) for i, j in linked) >= 0.98 * len(linked)
    assert not [(i, j) for i in sets for j in sets if j < i and same(i, j) and root(i) != root(j)]
