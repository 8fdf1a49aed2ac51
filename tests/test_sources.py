"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import sql_text
from factloom.session import scratch_path
from factloom.sources import facts, logs
from factloom.streaming import bursts as SB
from factloom.streaming import lifecycle

c = F.col


def write_lines(spark, lines, label):
    path = scratch_path(spark, label)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def document(**more):
    return json.dumps({"schema_version": 1, "repo": {"name": "r", "commit": "abc", "unit": {"id": "u", "main_target": "bin:x"}}, **more})


def test_facts_are_read_strictly(spark):
    item = {"id": "a#fn", "kind": "fn", "name": "a", "file": "f", "span": {"line": 1, "col": 2, "end_line": 3, "end_col": 4}, "crate": "k", "module": "", "visibility": "pub"}
    entry = {"item": "a#fn", "kind": "framework", "framework": {"generic": "warp"}, "confidence": "guessed", "witness": {"kind": "span", "file": "f", "line": 1}}
    docs = facts.read_facts(spark, write_lines(spark, [document(items=[item], entries=[entry])], "doc"), lines=True)
    row = facts.flat(docs, "items").first()
    assert (row["tree_key"], row["line"], row["end_line"], row["entry"], row["reexported"]) == ("commit:abc", 1, 3, False, False)
    assert json.loads(facts.flat(docs, "entries").first()["framework"]) == {"generic": "warp"}
    assert facts.flat(docs, "links").count() == 0
    old = document().replace('"schema_version": 1', '"schema_version": 2')
    with pytest.raises(Exception, match="schema version 2"):
        facts.read_facts(spark, write_lines(spark, [old], "old"), lines=True).collect()
    with pytest.raises(Exception):
        facts.read_facts(spark, write_lines(spark, ["{oops"], "bad"), lines=True).collect()
    extra = facts.unknown_fields(spark, write_lines(spark, [document(novel=1)], "extra"))
    assert [r["field"] for r in extra.collect()] == ["novel"]


def test_a_bad_thread_line_names_its_number(spark):
    lines = spark.createDataFrame([("s", 1, '{"kind":"text","text":"a"}'), ("s", 2, " "), ("s", 3, "{no")], "session string,line bigint,value string")
    with pytest.raises(Exception, match="line 3"):
        logs.parse_thread(lines).collect()
    assert logs.parse_thread(lines.filter("line < 3")).count() == 1


def test_transcripts_are_read_leniently(spark):
    lines = ["", "not json", "[1]", '{"type":"new"}', '{"type":"system","subtype":"init","session_id":"s","model":"m"}', '{"type":"stream_event"}',
             json.dumps({"type": "assistant", "message": {"content": [{"type": "thinking"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t", "name": "Read", "input": {"path": "x"}}]}}),
             json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "is_error": True, "content": "no"}]}}),
             json.dumps({"type": "result", "subtype": "error", "is_error": True, "result": "x", "session_id": "s"})]
    df = spark.createDataFrame([("f", n, x) for n, x in enumerate(lines)], "file string,pos bigint,value string")
    events = sorted((r["pos"], r["block"], r["kind"], r["text"], r["ok"]) for r in logs.parse_transcript(df).collect())
    assert [e[2] for e in events] == ["started", "text", "tool-call", "tool-result", "result"]
    assert events[3][3:] == ("no", False) and events[4][3:] == (None, False)
    stats = logs.stream_stats(df).first()
    assert (stats["lines"], stats["skipped"], stats["unknown"], stats["results"]) == (8, 2, 1, 1)


def test_sql_text(spark):
    got = lambda sql: {(r["table"], r["access"], r["inserts"], r["dequeues"]) for r in sql_text.sql_touches(spark.createDataFrame([(1, sql)], "id int,sql string"), "sql").collect()}
    assert got("SELECT id FROM outbox FOR UPDATE SKIP LOCKED") == {("outbox", "read", False, True)}
    assert got("INSERT INTO a SELECT * FROM b JOIN a") == {("a", "write", True, False), ("b", "read", False, False)}
    assert got("DELETE FROM x; UPDATE \"Y\" SET z = 1 -- from c") == {("x", "write", False, False), ("y", "write", False, False)}
    made = sql_text.created_tables(spark.createDataFrame([(1, "create\ntable if not exists s.T (a int);\nCREATE TABLE u(b int)")], "id int,sql string"), "sql")
    assert [(r["table"], r["line"]) for r in made.collect()] == [("t", 1), ("u", 3)]


def test_a_delta_outside_its_tree_is_refused(spark):
    files = spark.createDataFrame([("r", "t", "a.rs")], "repo string,tree_key string,path string")
    deltas = spark.createDataFrame([("r", "t", "k", "b.rs")], "repo string,tree_key string,facts_key string,path string")
    with pytest.raises(ValueError, match="b.rs"):
        facts.put_tree(files, deltas, files, scratch_path(spark, "put"))


def arrive(spark, parts, schema, label):
    path = scratch_path(spark, label)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_the_burst_stream_goes_on_between_batches(spark):
    times = [0, 1, 2, 5, 6, 7, 8, 9, 10, 30]
    data = [("w", n, t) for n, t in enumerate(times)]
    schema = "worktree string,seq bigint,s bigint"
    stream = arrive(spark, [data[:3], data[3:6], data[6:]], schema, "bursts").withColumn("ts", F.timestamp_seconds("s"))
    out = scratch_path(spark, "out")
    tagged = SB.tag_burst_stream(stream, 3_000_000, 6_000_000, ["worktree"])
    query = tagged.writeStream.trigger(availableNow=True).option("checkpointLocation", out + "/c").format("parquet").start(out + "/rows")
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    got = {r["s"]: r["burst"] // 1_000_000 for r in spark.read.parquet(out + "/rows").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 5: 0, 6: 0, 7: 7, 8: 7, 9: 7, 10: 7, 30: 30}


def test_late_changes_are_dropped_and_counted(spark):
    schema = "seq bigint,s bigint"
    path, out = scratch_path(spark, "late"), scratch_path(spark, "out")
    late, kept = 0, scratch_path(spark, "counts")
    # Each part arrives before a run of its own, so the order is certain; the watermark lives in the checkpoint.
    for part in ([(1, 9000), (2, 10000)], [(3, 10001), (3, 10001)], [(4, 9010)], [(5, 9011), (6, 9012)]):
        # As after a restart of the driver, a listener of its own.
        counter = SB.LateRows(spark, kept)
        spark.streams.addListener(counter)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.timestamp_seconds("s"))
        writer = SB.on_time(stream, "100 seconds", ["seq"]).writeStream.trigger(availableNow=True).option("checkpointLocation", out + "/c")
        query = writer.format("parquet").start(out + "/rows")
        query.awaitTermination()
        late += counter.of(query)
        spark.streams.removeListener(counter)
    assert sorted(r["seq"] for r in spark.read.parquet(out + "/rows").collect()) == [1, 2, 3]
    assert late == SB.late_rows_of(spark, kept, query.id) == 3


def test_late_rows_of_more_batches_than_progress_keeps(spark):
    path, out = scratch_path(spark, "late"), scratch_path(spark, "out")
    counter = SB.LateRows()
    spark.streams.addListener(counter)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        for days in (["2024-05-01"], ["2024-01-01", "2024-01-02", "2024-01-03"]):
            for k, day in enumerate(days):
                spark.createDataFrame([(f"{day}{k}", f"{day} 00:00:00")], "id string, ts string").coalesce(1).write.mode("append").parquet(path)
            stream = SB.on_time(spark.readStream.schema("id string, ts string").option("maxFilesPerTrigger", 1).parquet(path), "1 day", ["id"])
            query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", out + "/c").format("parquet").option("path", out + "/r").start()
            query.awaitTermination()
        assert counter.of(query) == 3
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        spark.streams.removeListener(counter)


def test_tables_of_a_block_are_removed(spark):
    import os

    from factloom.session import materialize, temporary

    rows = spark.range(5)
    outside = materialize(rows, "kept")
    with temporary(spark):
        inner = materialize(rows, "gone").inputFiles()[0]
        kept = scratch_path(spark, "kept")
    result = scratch_path(spark, "result")
    with temporary(spark):
        materialize(rows, "gone").write.parquet(result)
    assert outside.count() == spark.read.parquet(result).count() == 5
    assert not os.path.exists(inner.removeprefix("file://")) and not os.path.exists(kept)


def test_canonical_facts_are_read_back_from_packed_lines(spark, tmp_path):
    items = spark.createDataFrame([("r", "t", "b"), ("r", "t", "a"), ("s", "t", "c")], "repo string,tree_key string,id string")
    table = items.select("repo", "tree_key", F.array("id").alias("sort_key"), F.struct("id").alias("element"))
    facts.write_canonical_facts({"items": table}, str(tmp_path / "packed"), compression="gzip")
    assert list((tmp_path / "packed").rglob("*.txt.gz")) and not list((tmp_path / "packed").rglob("*.txt"))
    got = facts.read_canonical(spark, str(tmp_path / "packed"), "items").collect()
    assert sorted((r["repo"], r["element"]) for r in got) == [("r", '{"id":"a"}'), ("r", '{"id":"b"}'), ("s", '{"id":"c"}')]


def test_files_are_written_by_the_tasks(spark, tmp_path):
    """A file per row, repeated and null contents too, with nothing of a sink beside them; no row gives no file."""
    rows = spark.createDataFrame([("src/a", "x\n"), ("src/a", "x\n"), (".cargo", "é"), ("src/target", None)] * 5, "folder string, content string").repartition(4)
    assert facts.write_files(rows, f"{tmp_path}/made") == 20
    made = sorted(str(p.relative_to(tmp_path / "made").parent) for p in (tmp_path / "made").rglob("*") if p.is_file())
    assert made == [".cargo"] * 5 + ["src/a"] * 10 + ["src/target"] * 5
    seen = facts.scan_files(spark, f"{tmp_path}/made").groupBy("content").count().collect()
    assert {bytes(r.content).decode(): r["count"] for r in seen} == {"x\n": 10, "é": 5}
    assert facts.write_files(rows.limit(0), f"{tmp_path}/none") == 0
    assert facts.scan_files(spark, f"{tmp_path}/none").count() == 0
