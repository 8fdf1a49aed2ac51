"""Replacing trees and applying epochs: what a reader sees when a writer stops at any of its writes."""

import threading

import pytest
from pyspark.sql import DataFrameWriter

from factloom.session import scratch_path
from factloom.sources import facts
from factloom.sources.versions import Conflict, Log
from factloom.streaming import bursts as SB

FILES = "repo string,tree_key string,path string,file_hash string"
COMMITS = "repo string,tree_key string,ord int,hash string"
DELTAS = "repo string,tree_key string,facts_key string,path string"
SCHEMAS = {"tree_files": FILES, "tree_commits": COMMITS, "file_facts": DELTAS}


def tree(spark, key, names, deltas=True, commits=True, repo="r"):
    files = spark.createDataFrame([(repo, key, n, "h" + n) for n in names], FILES)
    facts_ = spark.createDataFrame([(repo, key, "k" + n, n) for n in names if deltas], DELTAS)
    made = spark.createDataFrame([(repo, key, i, f"c{i}{len(names)}") for i in range(2 * commits)], COMMITS)
    return files, facts_, made


def stored(spark, path):
    return {t: sorted(tuple(r) for r in facts.read_trees(spark, path, t, s).collect()) for t, s in SCHEMAS.items()}


def put(spark, path, *args, after=None, **options):
    files, deltas, commits = tree(spark, *args, **options)
    trees = spark.createDataFrame([(options.get("repo", "r"), args[0])], "repo string,tree_key string")
    return facts.put_tree(files, deltas, commits, path, trees=trees, after=after)


class Stop(Exception):
    pass


def stopping(monkeypatch, at):
    """All writes under a store fail but the first ``at``; scratch tables are not counted."""
    done = [0]

    def counted(act):
        def call(self, *args, **options):
            if isinstance(self, Log) or "/store/" in args[0]:
                done[0] += 1
                if done[0] > at:
                    raise Stop
            return act(self, *args, **options)

        return call

    monkeypatch.setattr(DataFrameWriter, "parquet", counted(DataFrameWriter.parquet))
    monkeypatch.setattr(Log, "add", counted(Log.add))


def test_a_replaced_tree_leaves_nothing_behind(spark):
    path = scratch_path(spark, "store")
    assert stored(spark, path) == {t: [] for t in SCHEMAS}
    put(spark, path, "t", ["a", "b"])
    put(spark, path, "u", ["x"])
    put(spark, path, "t", ["a", "c"], deltas=False, commits=False)
    got = stored(spark, path)
    assert got["tree_files"] == [("r", "t", "a", "ha"), ("r", "t", "c", "hc"), ("r", "u", "x", "hx")]
    assert got["file_facts"] == [("r", "u", "kx", "x")] and [r[1] for r in got["tree_commits"]] == ["u", "u"]
    put(spark, path, "u", [], commits=False)
    assert [r[1] for r in stored(spark, path)["tree_files"]] == ["t", "t"]
    # Every earlier state is there until it is pruned.
    assert len(facts.read_trees(spark, path, "tree_commits", COMMITS, at=0).collect()) == 2


def test_a_put_that_stops_shows_the_old_tree(spark, monkeypatch):
    path = scratch_path(spark, "store") + "/store"
    put(spark, path, "t", ["a", "b"])
    old = stored(spark, path)
    for at in range(5):
        with monkeypatch.context() as patch:
            stopping(patch, at)
            with pytest.raises(Stop):
                put(spark, path, "t", ["z"])
        assert stored(spark, path) == old
    put(spark, path, "t", ["z"])
    assert stored(spark, path) != old
    left = facts.prune_trees(spark, path, older_ms=-60_000)
    assert len(left) >= 4 and stored(spark, path)["tree_files"] == [("r", "t", "z", "hz")]
    assert facts.prune_trees(spark, path, older_ms=-60_000) == []


def test_a_young_version_is_not_pruned(spark):
    path = scratch_path(spark, "store")
    put(spark, path, "t", ["a"])
    put(spark, path, "t", ["b"])
    assert facts.prune_trees(spark, path) == []


def test_of_puts_at_the_same_time_one_holds_whole(spark):
    path = scratch_path(spark, "store")
    numbers = []
    work = [threading.Thread(target=lambda n=n: numbers.append(put(spark, path, "t", [f"{n}{k}" for k in range(n + 1)]))) for n in range(4)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert sorted(numbers) == [0, 1, 2, 3]
    got = stored(spark, path)
    names = [r[2] for r in got["tree_files"]]
    assert len({n[0] for n in names}) == 1 and len(names) == int(names[0][0]) + 1
    assert sorted(r[3] for r in got["file_facts"]) == names and len(got["tree_commits"]) == 2


def test_a_put_on_an_old_state_conflicts(spark):
    path = scratch_path(spark, "store")
    seen = put(spark, path, "t", ["a"])
    assert put(spark, path, "u", ["b"], after=seen) == seen + 1
    with pytest.raises(Conflict):
        put(spark, path, "t", ["c"], after=seen)
    assert [r[2] for r in stored(spark, path)["tree_files"]] == ["a", "b"]


def test_compacting_keeps_all_trees(spark):
    path = scratch_path(spark, "store")
    for n, key in enumerate("tuvt"):
        put(spark, path, key, [f"{n}"], deltas=n % 2 == 0)
    put(spark, path, "e", [], commits=False)
    old = stored(spark, path)
    facts.compact_trees(spark, path, SCHEMAS)
    assert len(facts.prune_trees(spark, path, older_ms=-60_000)) == 5
    assert stored(spark, path) == old and facts.current_trees(spark, path).count() == 4


def test_an_entry_is_made_once(spark):
    log = Log(spark, scratch_path(spark, "log"))
    won = []
    work = [threading.Thread(target=lambda n=n: won.append(log.add(str(n), 0))) for n in range(8)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert sum(won) == 1 and log.numbers() == [0] and log.append("next") == 1 and log.entries()[1] == "next"


BATCH = "worktree string,path string,seq bigint,sha256 string,removed boolean,writer string"
EPOCHS = [
    [("w", "a.rs", 1, "h1", False, "you"), ("w", "b.rs", 2, "h1", False, "s1"), ("v", "a.rs", 3, "h", False, "you")],
    [("w", "a.rs", 4, "h2", False, "s1"), ("w", "b.rs", 5, None, True, "you")],
    [],
    [("w", "a.rs", 3, "late", False, "s1"), ("v", "n.md", 9, "h", False, "you"), ("u", "x.rs", 1, "h", False, "you")],
    [("w", "b.rs", 12, "h3", False, "you")],
]


def seen(spark, base):
    return sorted(map(tuple, SB.snapshot_rows(spark, base).collect()), key=str), sorted(map(tuple, SB.event_rows(spark, base).collect()), key=str)


@pytest.mark.parametrize("fold", [2, 64])
def test_epochs_may_come_again(spark, monkeypatch, fold):
    monkeypatch.setattr(SB, "FOLD", fold)
    once, again = scratch_path(spark, "once"), scratch_path(spark, "again")
    batches = [spark.createDataFrame(rows, BATCH) for rows in EPOCHS]
    for n, batch in enumerate(batches):
        SB.apply_batches(once)(batch, n)
        for _ in range(2):
            SB.apply_batches(again)(batch, n)
    assert seen(spark, once) == seen(spark, again)
    rows, events = seen(spark, once)
    assert {(r[4], r[0], r[2], r[3]) for r in rows} == {("w", "a.rs", "h2", False), ("w", "b.rs", "h3", False), ("v", "a.rs", "h", False), ("v", "n.md", "h", False), ("u", "x.rs", "h", False)}
    assert (1, "w", 2, "facts-updated", "unit", 2) in events and (4, "w", 2, "facts-updated", "unit", 1) in events
    with pytest.raises(ValueError, match="new base"):
        SB.apply_batches(again)(batches[0], 4)


def test_an_epoch_that_fails_at_any_write_can_be_run_again(spark, monkeypatch):
    batches = [spark.createDataFrame(rows, BATCH) for rows in EPOCHS[:2]]
    whole = scratch_path(spark, "whole")
    for n, batch in enumerate(batches):
        SB.apply_batches(whole)(batch, n)
    base = scratch_path(spark, "base") + "/store"
    SB.apply_batches(base)(batches[0], 0)
    old = seen(spark, base)
    for at in range(4):
        with monkeypatch.context() as patch:
            stopping(patch, at)
            with pytest.raises(Stop):
                SB.apply_batches(base)(batches[1], 1)
        assert seen(spark, base) == old
    SB.apply_batches(base)(batches[1], 1)
    assert seen(spark, base) == seen(spark, whole)
