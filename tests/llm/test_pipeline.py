"""The pipeline's stages, each against plain code on its own input."""

import re

import pytest
from test_packing import check

import corpus_pipeline
from factloom.llm import jaccard, quality, secret_scan, templates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        out.append(docs)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns(steps):
    assert all(s.columns == COLUMNS for s in steps[:-1])
    assert all(r.n_chars == len(r.text or "") for s in steps[1:-1] for r in s.collect())


def test_quality(steps):
    before, after = texts(steps[0]), texts(steps[1])
    kept = {r.id: r.removed or [] for r in quality.judge(steps[0]).where("kept").collect()}
    assert after.keys() == kept.keys() and 0 < len(kept) < len(before)
    for i, text in after.items():
        lines = before[i].split("\n")
        assert (text == before[i]) if not kept[i] else set(text.split("\n")) <= set(lines) and len(text) < len(before[i])


def test_near_copies(steps):
    from test_jaccard import brute

    before, after = texts(steps[1]), texts(steps[2])
    rows = brute(list(before.items()))
    assert after == {i: before[i] for i, n, c in rows if i == c} and len(after) < len(before)


def test_decontamination(spark, sf_dir, steps):
    from test_templates import brute

    before, after = texts(steps[2]), texts(steps[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {d for d, _ in brute(list(before.items()), items)}
    assert after == {i: t for i, t in before.items() if i not in gone}
    assert templates.leaks(steps[3], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0


def test_secrets(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert after.keys() == before.keys()
    for i, text in after.items():
        assert re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", text) is None
        assert "[secret]" in text or text == before[i]
    assert secret_scan.findings(steps[4], [0] * 6400).where("n_access + n_hex + n_assign > 0").count() == 0


def test_packed(steps):
    rows = [tuple(r) for r in steps[4].select("doc_id", "text").collect()]
    found = steps[5].selectExpr("doc_id AS id", "start", "length", "ids_crc32 AS crc", "doc_tokens AS n_tokens", "sequence_id AS sequence", "offset AS place").collect()
    padding, total = check(found, rows)
    assert padding <= 1024 + 0.01 * total


def test_run(spark, sf_dir, steps):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    count = lambda f: f.groupBy("doc_id").agg({"length": "sum"}).count()
    assert count(corpus_pipeline.run(spark, sf_dir).select(*key)) == count(steps[5])
    assert jaccard.PERCENT == 75


def through(spark, sf_dir, docs, tmp_path):
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    return docs


ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, key string, shingles int, body string"


def test_odd_rows(spark, sf_dir, tmp_path):
    words = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    extra = ("a", 1, "b", 2, "c")
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, words(60, 4)), (4, words(60, 4)), (5, words(60, 4)), (None, words(50, 6)), (7, words(30_000, 7)), (8, words(40, 8))]
    docs = spark.createDataFrame([(i, t, None if i == 8 else "en", None if i == 8 else "s", None, *extra) for i, t in rows], ODD)
    got = through(spark, sf_dir, docs, tmp_path).collect()
    assert {r.doc_id for r in got} == {4, None, 7, 8}
    assert sum(r.length for r in got if r.doc_id == 4) == next(r.doc_tokens for r in got if r.doc_id == 4)


def test_empty_table(spark, sf_dir, tmp_path):
    assert through(spark, sf_dir, spark.createDataFrame([], ODD), tmp_path).count() == 0
