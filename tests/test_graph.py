"""Reach by words of starts, and layers over folded chains, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from factloom import session
from factloom.operators import graph

EDGES = "repo string,tree_key string,from string,to string"


def keyed(spark, rows, names):
    return spark.createDataFrame([("r", "t", *row) for row in rows], f"repo string,tree_key string,{names}")


def walk(edges, start, depth=None):
    seen, front, hops = {start: 0}, {start}, 0
    while front and (depth is None or hops < depth):
        hops += 1
        front = {b for a, b in edges if a in front} - seen.keys()
        seen |= dict.fromkeys(front, hops)
    return seen


def test_reach_of_more_starts_than_a_word_holds(spark):
    rng = random.Random(6)
    links = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(180)]
    foci = [f"n{k}" for k in range(150)]
    got = {(r.focus, r.node): r.hops for r in graph.reach(keyed(spark, links, "from string,to string"), keyed(spark, [(f,) for f in foci], "focus string"), 3).collect()}
    both = links + [(b, a) for a, b in links]
    assert got == {(f, n): h for f in foci for n, h in walk(both, f, 3).items()}


def test_closures_and_their_first_edges(spark):
    rng = random.Random(7)
    links = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(120)]
    first = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(30)]
    starts = [f"n{k}" for k in range(90)]
    named = "from string,to string"
    out = graph.closure(keyed(spark, links, named), keyed(spark, [(x,) for x in starts], "node string"), first_edges=keyed(spark, first, named))
    want = {(x, n) for x in starts for m in [x, *(b for a, b in first if a == x)] for n in walk(links, m)}
    got = [(r.start, r.node) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def layers(nodes, edges):
    deps = {n: {b for a, b in edges if a == n} for n in nodes}
    out = {}
    while ready := [n for n in nodes if n not in out and deps[n] <= out.keys()]:
        out |= {n: 1 + max((out[d] for d in deps[n]), default=0) for n in ready}
    return out


def run(spark, nodes, edges):
    rows = graph.topological_layers(keyed(spark, [(n, i) for i, n in enumerate(nodes)], "id string,pos int"), keyed(spark, edges, "id string,depends_on string")).collect()
    return {r.id: r.layer for r in rows}, {r.id: r.error for r in rows}


def test_layers_of_random_plans(spark):
    rng = random.Random(8)
    nodes = [f"e{k}" for k in range(120)]
    edges = [(f"e{k}", f"e{max(0, k - rng.choice((1, 1, 1, 1, 2, 30)))}") for k in range(1, 100) for _ in range(rng.choice((1, 1, 1, 2)))]
    # A ring, a node on itself, what is behind them, and an unknown dependency at a chain's end.
    edges += [("e100", "e101"), ("e101", "e102"), ("e102", "e100"), ("e103", "e100"), ("e104", "e104"), ("e105", "e104")]
    edges += [("e106", "nowhere"), ("e107", "e106"), ("e108", "e107"), ("e110", "e111"), ("e111", "e112"), ("e112", "e110")]
    got, errors = run(spark, nodes, edges)
    want = layers(nodes, edges)
    assert {n: x for n, x in got.items() if x} == want
    assert errors["e106"] == "depends on unknown nowhere" and errors["e108"] == errors["e103"] == errors["e111"] == "on or behind a cycle"
    assert all((errors[n] is None) == (n in want) for n in nodes)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    writes, plain = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: writes.append(label) or plain(df, label))
    n = 10_000
    got, _ = run(spark, [f"e{k}" for k in range(n)], [(f"e{k}", f"e{k - 1}") for k in range(1, n)])
    assert got == {f"e{k}": k + 1 for k in range(n)} and writes.count("chain-links") <= 16


def test_reach_lists_starts_by_number_and_keeps_unknown_names(spark, monkeypatch):
    rng, paths, plain = random.Random(9), [], graph.scratch_path
    monkeypatch.setattr(graph, "scratch_path", lambda s, label: paths.append((label, plain(s, label))) or paths[-1][1])
    for name, n in (("BLOCK", 8), ("TASK_PAIRS", 50), ("SENT_NAMES", 20)):
        monkeypatch.setattr(graph, name, n)
    links = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)]
    foci = [f"n{k}" for k in range(60)] + ["alone"]
    rows = [("r", "t", *x) for x in [*links, *links[:9], ("far", None), (None, "far")]] + [(None, "t", "n1", "alone")]
    given = spark.createDataFrame([("r", "t", f) for f in [*foci, *foci[:5], "far", None]] + [(None, "t", "n1")], "repo string,tree_key string,focus string")
    got = [(r.focus, r.node, r.hops) for r in graph.reach(spark.createDataFrame(rows, EDGES), given, 2).collect()]
    both = links + [(b, a) for a, b in links]
    want = {(f, n, h) for f in foci for n, h in walk(both, f, 2).items()} | {("far", "far", 0), ("far", None, 1), (None, None, 0)}
    assert len(got) == len(set(got)) and set(got) == want
    rounds = next(path for label, path in paths if label == "reach")
    assert {t for _, t in spark.read.parquet(rounds).dtypes} == {"bigint", "int", "array<int>"}


def test_links_are_dealt_out_once(spark, monkeypatch):
    """Joins on stored links shuffle the other side alone, and walks read links by number."""
    monkeypatch.setattr(graph, "stored", lambda df, by, label: tables.append(session.stored(df, by, label)) or tables[-1])
    tables = []
    edges = spark.createDataFrame([("r", "t", f"n{i}", f"n{i + 1}") for i in range(9)] + [("r", "t", "n2", "n7"), ("r", "t", "n2", "n7")], "repo string, tree_key string, `from` string, `to` string")
    starts = spark.createDataFrame([("r", "t", "n4"), ("r", "t", "alone"), ("r", None, "n1"), ("r", "t", None)], "repo string, tree_key string, node string")
    found = [(r.tree_key, r.node) for r in graph.reachable(edges, starts).collect()]
    assert sorted(map(str, found)) == sorted(map(str, [("t", f"n{i}") for i in range(4, 10)] + [("t", "alone"), (None, "n1"), ("t", None)]))
    assert len(tables) == 1 and tables[0].count() == 10
    fresh = spark.range(5000).select((F.col("id") * 7).alias("node")).repartition(3)
    plan = fresh.hint("merge").join(tables[0], F.col("node") == F.col("_from"))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_numbers_of_names_that_collide(spark, monkeypatch):
    """Names that share a number under one seed get others under the next; unknown names are below 0."""
    names = spark.createDataFrame([("r", "a"), ("r", "b"), (None, "r"), ("r", None), (None, None)], "repo string, name string")
    plain, seeds = F.xxhash64, []

    def clumsy(seed, *parts):
        seeds.append(seed)
        return F.lit(5).cast("bigint") if len(seeds) == 1 else plain(seed, *parts)

    monkeypatch.setattr(graph.F, "xxhash64", clumsy)
    known, _ = graph.numbers_of(names, ["repo"], "names")
    rows = known.collect()
    assert len(seeds) == 2 and len({r.num for r in rows}) == 5
    assert all((r.num < 0) == (r.name is None) for r in rows)


@pytest.mark.parametrize("few", [0, 100])
def test_spawned_workers_whichever_end_comes_first(spark, monkeypatch, few):
    """Owners and targets are looked up in the order of their number, sent to all tasks or not."""
    monkeypatch.setattr(graph, "FEW", few)
    make = lambda rows, kind: spark.createDataFrame([("r", "t", *x) for x in rows], "repo string, tree_key string, " + kind)
    ids = ["main", "a", "w1", "w2", "w3", "x", "loop"]
    items = make([(i, "m::x" if i != "x" else "n::x", None, i == "main") for i in ids], "id string, module string, cfg string, entry boolean")
    calls = make([("main", "a"), ("w1", "loop"), ("w2", "x"), ("x", "loop"), ("w3", "w1")], "`from` string, `to` string")
    spawns = make([(3, "a", "w1", False, "f3", 3), (1, "main", "w1", False, "f1", 1), (2, "a", "w2", False, "f2", 2), (4, "a", "w3", True, "f4", 4), (5, "a", "w3", False, "f5", 5), (0, "w2", "w3", False, "f0", 0)],
                  "pos long, owner string, target string, in_loop boolean, file string, line long")
    one = lambda *names: make([(n,) for n in names], "id string")
    sent = []
    monkeypatch.setattr(graph.F, "broadcast", lambda df: sent.append(df) or df)
    found = graph.spawned_workers(items, calls, spawns, one("nothing"), one("loop"), one("main"))
    assert sorted(map(tuple, found.select("target", "owner", "file", "line", "in_main").collect())) == [("w1", "main", "f1", 1, True), ("w3", "a", "f5", 5, False)]
    assert len(sent) == (2 if few else 0)


def test_layers_send_few_rows_to_all_tasks(spark, monkeypatch):
    """What is sent to all tasks goes by the number of rows, not by the size of files."""
    sizes, plain = [], F.broadcast
    monkeypatch.setattr(graph.F, "broadcast", lambda df: sizes.append(df.count()) or plain(df))
    monkeypatch.setattr(graph, "FEW", 40)
    nodes = keyed(spark, [(f"e{i}", i) for i in range(200)], "id string,pos long")
    deps = keyed(spark, [(f"e{i}", f"e{i // k}") for i in range(2, 200) for k in (2, 3) if i >= k], "id string,depends_on string")
    found = graph.topological_layers(nodes, deps)
    outer = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftOuter" in line]
    assert outer and all("SortMergeJoin" in line for line in outer) and sizes and max(sizes) <= 40
    layers = {0: 1, 1: 1}
    for i in range(2, 200):
        layers[i] = 1 + max(layers[i // k] for k in (2, 3) if i >= k)
    assert {(r.id, r.layer, r.error) for r in found.collect()} == {(f"e{i}", n, None) for i, n in layers.items()}


def test_unknown_nodes_are_reached_once(spark):
    edges = keyed(spark, [*[(f"n{i}", f"n{i + 1}") for i in range(12)], *[(f"n{i}", None) for i in range(13)], (None, "far")], "`from` string,`to` string")
    found = [r.node for r in graph.reachable(edges, keyed(spark, [("n0",)], "node string")).collect()]
    assert sorted(map(str, found)) == sorted([*[f"n{i}" for i in range(13)], "None"])
