"""Streams that end by themselves: any split of the rows gives the batch form's answer, and no state is left."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import fixed
from factloom.operators import bursts as B
from factloom.operators import sessions as S
from factloom.session import scratch_path
from factloom.streaming import closing, lifecycle, transcripts


def arrive(spark, parts, schema):
    path = scratch_path(spark, "parts")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, mode="append"):
    """All rows of a stream with their batch, and the rows of state after each batch."""
    out = scratch_path(spark, "out")
    save = lambda df, n: df.withColumn("epoch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/n={n}")
    query = stream.writeStream.outputMode(mode).foreachBatch(save).trigger(availableNow=True).option("checkpointLocation", out + "/c").start()
    query.awaitTermination()
    return spark.read.parquet(out + "/rows").drop("n"), [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]


CHANGES = "worktree string,path string,seq bigint,s double"
START = 1_700_000_000


@pytest.mark.parametrize("seed", [1, 2])
def test_closed_bursts_are_those_of_the_batch(spark, seed):
    rng = random.Random(seed)
    rows, at = [], START
    for n in range(160):
        at += rng.choice((0, 0.25, 1, 1, 2, 3, 3.5, 20))
        rows.append((rng.choice("vw"), f"p{rng.randrange(6)}", n, float(at)))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    parts = [shuffled[:50], shuffled[50:60], shuffled[60:], [("end", "end", -1, at + 5000.0)]]
    timed = lambda df: df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    stream = closing.closed_bursts(timed(arrive(spark, parts, CHANGES)), 3_000_000, 6_000_000, "4000 seconds", ["worktree"])
    got, state = run(spark, stream)
    whole = B.tag_bursts(timed(spark.createDataFrame(rows, CHANGES)), 3_000_000, 6_000_000, ["worktree"])
    want = B.burst_batches(whole, ["worktree"])
    assert sorted(map(tuple, got.drop("epoch").collect())) == sorted(map(tuple, want.collect()))
    # Only the row that let the others end is still held.
    assert state[-1] < max(state) and state[-1] <= 4


def test_a_burst_ends_while_the_stream_goes_on(spark):
    parts = [[("w", "a", 1, START + 1.0), ("w", "b", 2, START + 2.0)], [("v", "x", 3, START + 30.0)], [("v", "y", 4, START + 31.0)]]
    stream = arrive(spark, parts, CHANGES).withColumn("ts", F.timestamp_seconds("s"))
    got, _ = run(spark, closing.closed_bursts(stream, 3_000_000, 60_000_000, "5 seconds", ["worktree"]))
    assert {(r.worktree, r.path) for r in got.collect()} == {("w", "a"), ("w", "b")}
    assert {r.epoch for r in got.collect()} == {2}


def test_one_clock_over_all_worktrees(spark):
    rows = [("w", "a", 1, START + 1.0), ("v", "a", 2, START + 2.0), ("w", "a", 3, START + 2.5), (None, "n", 4, START + 3.0), ("w", None, 5, START + 3.0)]
    stream = arrive(spark, [rows, [("z", "z", 9, START + 900.0)]], CHANGES).withColumn("ts", F.timestamp_seconds("s")).withColumn("clock", F.lit("all"))
    got, _ = run(spark, closing.closed_bursts(stream, 3_000_000, 60_000_000, "5 seconds", ["clock"]))
    assert sorted(((r.worktree, r.path) for r in got.collect()), key=str) == [("v", "a"), ("w", "a"), (None, "n")]


TRIGGERS = "session string,seq bigint,trigger string,s bigint"


def path_of(rng, n):
    """Triggers of a session: mostly legal moves, some not."""
    at, out = "planning", []
    moves = {}
    for a, t, b in fixed.TRANSITIONS:
        moves.setdefault(a, []).append((t, b))
    for _ in range(n):
        if at in moves and rng.random() < 0.8:
            t, at = rng.choice(moves[at])
        else:
            t = rng.choice([*(t for _, t, _ in fixed.TRANSITIONS), "unheard-of"])
            at = dict(moves.get(at, [])).get(t, at)
        out.append(t)
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_lifecycles_in_any_order(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{k}", n * (1 + k % 3), t, START + n) for k in range(9) for n, t in enumerate(path_of(rng, 5 + 9 * k), 1)]
    parts = [[], [], [], []]
    for r in rows:
        parts[rng.randrange(4)].append(r)
    parts[3] += rng.sample(parts[0], 10)
    stream = arrive(spark, parts, TRIGGERS).withColumn("ts", F.timestamp_seconds("s"))
    got, _ = run(spark, lifecycle.lifecycle_stream(stream, "1 day"), "update")
    newest = got.groupBy("session").agg(F.max_by(F.struct("state", "illegal"), "epoch").alias("v")).select("session", "v.*")
    want = S.replay_lifecycles(spark.createDataFrame(rows, TRIGGERS))
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, want.collect()))
    assert {r.gaps for r in got.where("session = 's0'").orderBy(F.desc("epoch")).limit(1).collect()} == {0}


def test_archived_sessions_are_forgotten(spark):
    way = ["delegate", "group-done", "last-gate-passed", "pr-created", "merged", "archived"]
    first = [("a", n, t, START + n) for n, t in enumerate(way, 1)] + [("b", 1, "delegate", START)]
    parts = [first, [("b", 2, "ask", START + 100)], [("b", 3, "answer", START + 90_000)], [("b", 4, "ask", START + 90_001)]]
    stream = arrive(spark, parts, TRIGGERS).withColumn("ts", F.timestamp_seconds("s"))
    got, state = run(spark, lifecycle.lifecycle_stream(stream, "1 hour", "10 hours"), "update")
    assert {(r.session, r.state) for r in got.collect()} >= {("a", "archived"), ("b", "asks")}
    # A session is a run, a time, and while it waits to be forgotten a timer.
    assert state[0] > state[-1] and state[-1] <= 3


def test_functions_compose():
    rng = np.random.default_rng(5)
    to, bad = rng.integers(0, 11, (37, 11)), rng.integers(0, 2, (37, 11))
    a, b = lifecycle.composed(to, bad)
    for start in range(11):
        at, n = start, 0
        for k in range(37):
            n, at = n + bad[k, at], to[k, at]
        assert (a[start], b[start]) == (at, n)


def said(text, id_="s1"):
    return json.dumps({"type": "assistant", "session_id": id_, "message": {"content": [{"type": "text", "text": text}]}})


def done(id_="s1"):
    return json.dumps({"type": "result", "subtype": "success", "is_error": False, "session_id": id_, "result": "ok"})


def land(path, name, lines, at):
    with open(f"{path}/{name}", "w") as f:
        f.write("".join(x + "\n" for x in lines))
    os.utime(f"{path}/{name}", (START + at, START + at))


def test_transcripts_have_places_and_ends(spark, tmp_path):
    path = str(tmp_path)
    land(path, "a.1.jsonl", [said("one"), "", "not json", said("two"), done()], 0)
    land(path, "b.1.jsonl", [said("lost", "s2"), said("lost too", "")], 1)
    land(path, "c.1.jsonl", [said("goes on", "s3")], 2)
    land(path, "c.2.jsonl", [said("further", "s3"), done("s3")], 20)
    land(path, "d.1.jsonl", ["not json", '{"type":"system","subtype":"progress"}'], 21)
    land(path, "e.1.jsonl", [said("new turn", "s5"), done("s5"), said("again", "s5")], 200)
    land(path, "y.1.jsonl", [done("y")], 900)
    land(path, "z.1.jsonl", [done("z")], 1000)
    stream = transcripts.transcript_stream(spark, path, r"([a-z])\.\d\.jsonl$", 60_000_000, "5 seconds", maxFilesPerTrigger=1)
    got, state = run(spark, stream)
    rows = {(r.file, r.pos, r.kind, r.session_id, r.subtype, r.ok) for r in got.collect()}
    assert {r[:3] for r in rows if r[4] != transcripts.UNFINISHED} == {
        ("a", 1, "text"), ("a", 4, "text"), ("a", 5, "result"), ("b", 1, "text"), ("b", 2, "text"), ("c", 1, "text"), ("c", 2, "text"),
        ("c", 3, "result"), ("e", 1, "text"), ("e", 2, "result"), ("e", 3, "text"), ("y", 1, "result"), ("z", 1, "result")}
    assert {r for r in rows if r[4] == transcripts.UNFINISHED} == {("b", 2, "result", "s2", "unfinished", False), ("e", 3, "result", "s5", "unfinished", False)}
    # The turn ended before the next file was read, not at the end of the stream.
    assert got.where("file = 'b' AND subtype = 'unfinished'").first().epoch < got.where("file = 'z'").first().epoch
