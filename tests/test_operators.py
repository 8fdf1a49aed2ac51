"""Operators on small hand-made rows and against plain folds on random ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import fixed
from factloom.functions import columns as C
from factloom.operators import areas, assemble, bursts, graph, invariants, lints, ordered, placement, reports, rules, sessions, snapshots
from factloom.streaming.bursts import cut_bursts

c = F.col


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.select(*names).collect())


def one(spark, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema)


def test_first_matching_area_wins(spark):
    areas_df = spark.createDataFrame(
        [("r", 1, "http", "driving", "src/adapters/http/**"), ("r", 2, "adapters", "driven", "src/adapters/**"),
         ("r", 3, "app", "domain", "src/app/**"), ("r", 3, "app", "domain", "src/worker.rs"), ("other", 1, "all", "domain", "**")],
        "repo string,ord int,name string,side string,glob string")
    paths = ["src/adapters/http/handlers.rs", "src/adapters/stripe/mod.rs", "src/worker.rs", "src/main.rs", "tests/flows.rs"]
    files = spark.createDataFrame([("r", "t", p) for p in paths], "repo string,tree_key string,file string")
    assert rows(placement.place_files(files, areas_df), "file", "area") == [
        ("src/adapters/http/handlers.rs", "http"), ("src/adapters/stripe/mod.rs", "adapters"), ("src/worker.rs", "app")]


def test_placing_by_folder_is_placing_by_every_glob(spark):
    rng = random.Random(5)
    name = lambda: rng.choice(["a", "b", "src", "a.b", "", "x y", "é"])
    paths = sorted({"/".join(name() for _ in range(rng.randrange(1, 6))) for _ in range(300)})
    part = lambda: rng.choice(["a", "b", "src", "**", "*", "?", "{a,b}", "[ab]", "a*", "[!a]", "a.b", "é", ""])
    globs = sorted({"/".join(part() for _ in range(rng.randrange(1, 5))) for _ in range(300)})
    listed = spark.createDataFrame([("r", n, f"n{n}", "s", g) for n, g in enumerate(globs)] + [("r", 999, "null", "s", None)], "repo string,ord int,name string,side string,glob string")
    files = spark.createDataFrame([("r", "t", p) for p in [*paths, None]], "repo string,tree_key string,file string")
    every = files.join(listed, "repo").filter(F.rlike("file", C.glob_regex(c("glob"))))
    want = every.groupBy("file").agg(F.min_by("name", "ord").alias("area"))
    assert rows(placement.place_files(files, listed), "file", "area") == rows(want, "file", "area")
    # A pair of folder and path that begins like it is all that a regex sees.
    assert every.filter(~F.array_contains(C.ancestors(c("file")), C.glob_folder(c("glob")))).count() == 0


def test_findings_of_a_change_are_those_of_two_full_runs(spark):
    rng = random.Random(8)
    spec = {
        "items": "repo string,tree_key string,id string,file string,module string,cfg string",
        "links": "repo string,tree_key string,`from` string,target_kind string,target_id string,kind string,member string,confidence string,file string,line int",
        "externals": "repo string,tree_key string,id string,kind string", "ports": "repo string,tree_key string,id string,kind string,side string",
    }
    names = ["core/a.rs", "core/b.rs", "web/a.rs", "web/b.rs", "db/a.rs", "lone.rs"]
    items = {f"u::i{n}#fn": rng.choice(names) for n in range(40)}
    kind_of = {"item": "calls", "external": "uses-external", "table": "writes", "port": "uses-external"}

    def link(source):
        kind = rng.choice(["item", "item", "item", "external", "table", "port"])
        to = rng.choice(sorted(items)) if kind == "item" else f"{kind}:{rng.randrange(3)}"
        return ("r", source, kind, to, kind_of[kind], None, "resolved", rng.randrange(4))

    links = {s: [link(s) for _ in range(8)] for s in items}
    externals = {f"external:{n}": "database" for n in range(3)} | {"port:0": "database"}
    ports = {f"port:{n}": "database" for n in range(3)}

    def side(tree):
        own = [(r, tree, a, k, t, m, x, conf, items.get(a, "lone.rs"), line) for ls in links.values() for r, a, k, t, m, x, conf, line in ls]
        data = {
            "items": [("r", tree, i, f, f[:-3], None) for i, f in items.items()], "links": own,
            "externals": [("r", tree, i, k) for i, k in externals.items()], "ports": [("r", tree, i, k, "driven") for i, k in ports.items()],
        }
        return {n: spark.createDataFrame(data[n], spec[n]) for n in spec}

    areas_df = spark.createDataFrame([("r", n, a, s, f"{a}/**") for n, (a, s) in enumerate([("core", "domain"), ("web", "driving"), ("db", "driven")])], "repo string,ord int,name string,side string,glob string")
    rules_df = spark.createDataFrame([("r", 1, "domain", "depend-on", ["driving", "externals"], "block"), ("r", 2, "web", "depend-on", ["db", "core"], "warn"), ("r", 3, "db", "depend-on", ["externals"], "warn")],
                                     "repo string,ord int,subject string,must_not string,targets array<string>,level string")
    allows = spark.createDataFrame([], "repo string,ord int,rule string,site string,target string,by string,reason string")
    before = side("t1")
    changed = {"core/a.rs"}
    for s in [i for i, f in items.items() if f == "core/a.rs"]:
        links[s] = [*links[s][2:], link(s), links[s][-1]]
    moved, gone = [i for i, f in sorted(items.items()) if f == "web/a.rs"][:2]
    items[moved] = "db/a.rs"
    del items[gone]
    changed |= {"web/a.rs", "db/a.rs"}
    externals["external:1"] = "crate"
    del externals["port:0"], ports["port:2"]
    after = side("t2")
    files = spark.createDataFrame([("r", f) for f in changed], "repo string,file string")
    got = reports.findings_of_change(before, after, files, areas_df, rules_df, allows)
    full = [rules.check_rules(*(s[n] for n in ("items", "links", "externals", "ports")), areas_df, rules_df, allows, ["repo"]) for s in (before, after)]
    keys = ["repo", *reports.CHANGE_KEY]
    a, b = (set(f.select(*keys).toLocalIterator()) for f in full)
    want = {(*r, "added") for r in b - a} | {(*r, "fixed") for r in a - b}
    found = [tuple(r) for r in got.select(*keys, "change").collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert {r[-1] for r in want} == {"added", "fixed"} and a & b


def test_findings_of_change_takes_only_links_that_differ(spark):
    def side(rows):
        return spark.createDataFrame([("r", *x, False) for x in rows], "repo string,from string,target_kind string,target_id string,kind string,file string,line int,_end boolean")

    same = [("a", "item", "b", "calls", "f", n) for n in range(50)]
    old = [*same, ("a", "external", "x", "reads", "f", 1), ("a", "port", "x", "reads", "f", 1), ("a", "table", "t", "reads", "f", 1), ("a", "odd", "y", "reads", "f", 1)]
    new = [*same, ("a", "port", "x", "reads", "f", 1), ("a", "external", "table:t", "reads", "f", 1), ("a", "item", "x", "reads", "f", 1)]
    got = {tuple(r)[1:] for r in reports._differing(side(old), side(new), ["repo"]).select(
        "repo", "from", "target_kind", "target_id", "kind", "file", "line", "_0", "_1").collect()}
    # Ends of one target text are taken together, whatever their kinds; links that are alike on both sides are left out.
    assert got == {
        ("a", "external", "x", "reads", "f", 1, True, False), ("a", "port", "x", "reads", "f", 1, True, True),
        ("a", "table", "t", "reads", "f", 1, True, False), ("a", "external", "table:t", "reads", "f", 1, False, True),
        ("a", "item", "x", "reads", "f", 1, False, True)}


@pytest.mark.parametrize("glob,path,match", [
    ("src/*.rs", "src/a/b.rs", True), ("**/x/**", "x/y", True), ("**/x/**", "a/x/y", True), ("**/x/**", "ax/y", False),
    ("a/**/b", "a/b", True), ("a/**/b", "a/c/d/b", True), ("a/{b,c}/?.rs", "a/c/d.rs", True), ("a/{b,c}/?.rs", "a/d/d.rs", False),
    ("f[0-9].rs", "f3.rs", True), ("f[!0-9].rs", "f3.rs", False), ("a.b", "axb", False), ("a,b", "a,b", True),
])
def test_globs(spark, glob, path, match):
    df = spark.createDataFrame([(glob, path)], "g string,p string")
    assert df.select(F.rlike("p", C.glob_regex(c("g")))).first()[0] is match


@pytest.mark.parametrize("item,module,site", [
    ("app::app::notify::impl NotifyCustomer::deliver#fn", "app::notify", "f::NotifyCustomer::deliver"),
    ("app::http::impl From<A> for B#impl", "http", "f::B"), ("app::http::impl Sender<X for Y> for Z::send#fn", "http", "f::Z::send"),
    ("app::main#fn", "", "f::main"), ("plain", "gone", "f::plain"),
])
def test_site_of(spark, item, module, site):
    df = spark.createDataFrame([(item, "f", module)], "i string,f string,m string")
    assert df.select(C.site_of(c("i"), c("f"), c("m"))).first()[0] == site


def test_text_columns(spark):
    get = lambda col, v: one(spark, v).select(col(c("v"))).first()[0]
    assert get(lambda v: C.tail(v, 4), "abé€") == "…€"
    assert get(lambda v: C.tail(v, 10), "abé€") == "abé€"
    assert get(C.normalize_path, "../a/./b/../../c") == "../c"
    assert get(C.normalize_path, "../../a") == "../../a"
    assert get(C.host_in, "see https://a.b.c/x and http://a.b.c") == "a.b.c"
    assert get(C.host_in, "https://a.b and http://c.d") is None
    assert get(C.host_in, "http://localhost") is None
    assert get(C.kebab_case, "CallsPort") == "calls-port"
    assert get(C.git_blob_id, "abc") == "f2ba8f84ab5c1bce84a7b441cb1959cfc7093b7f"
    assert get(C.tool_result_text, '[{"type":"text","text":"a"},{"type":"image"},{"text":"b"}]') == "a\nb"
    assert get(C.tree_key_kind, "branch:x") is None
    assert get(C.is_source_file, "a/target/b.rs") is True and get(C.is_source_file, "target/b.rs") is False
    assert get(C.non_test, "all(test, unix)") is False and get(C.non_test, "testing") is True


def test_links_between_places_meet_rules_and_allows(spark):
    areas_df = spark.createDataFrame([("r", 1, "core", "domain", "core/**"), ("r", 2, "db", "driven", "db/**")],
                                     "repo string,ord int,name string,side string,glob string")
    rules_df = spark.createDataFrame([("r", 1, "domain", "depend-on", ["nowhere", "db", "driven"], "block")],
                                     "repo string,ord int,subject string,must_not string,targets array<string>,level string")
    item = lambda n, f, m, cfg=None: ("r", "t", f"k::{m}::{n}#fn", f, m, cfg)
    items = spark.createDataFrame([item("a", "core/x.rs", "core"), item("t", "core/x.rs", "core", "test"), item("q", "db/y.rs", "db")],
                                  "repo string,tree_key string,id string,file string,module string,cfg string")
    link = lambda a, conf, line: ("r", "t", f"k::core::{a}#fn", "item", "k::db::q#fn", None, "calls", conf, "core/x.rs", line)
    links = spark.createDataFrame([link("a", "resolved", 1), link("a", "guessed", 2), link("t", "resolved", 3), link("a", "resolved", 4)],
                                  "repo string,tree_key string,from string,target_kind string,target_id string,member string,kind string,confidence string,file string,line bigint")
    none = spark.createDataFrame([], "repo string,tree_key string,id string,kind string,side string")
    allows = spark.createDataFrame([("r", 1, "core/x.rs:4", "domain must not depend-on db", "db/y.rs", "known", "ann"),
                                    ("r", 0, "core/x.rs:4", "another rule", None, "no", "bob")],
                                   "repo string,ord int,site string,rule string,target string,reason string,by string")
    found = rules.check_rules(items, links, none, none, areas_df, rules_df, allows)
    assert rows(found, "line", "rule", "level", "allowed_by") == [
        (1, "domain must not depend-on db", "block", None), (2, "domain must not depend-on db", "warn", None),
        (4, "domain must not depend-on db", "block", "ann")]
    assert rows(rules.summarize_findings(found, items), "blocking", "warnings", "allowed", "exit_code") == [(1, 1, 1, 1)]


def test_numbered_and_carried_with_one_hot_key(spark):
    rng = random.Random(1)
    data = [("hot" if n % 3 else "k%d" % (n % 5), n, rng.choice([None, n])) for n in range(600)]
    df = spark.createDataFrame(data, "k string,pos bigint,v bigint")
    ranked = ordered.numbered(df, ["k"], ["pos"], F.floor(c("pos") / 37), "n")
    seen = {}
    for k, pos, _ in data:
        seen[k] = seen.get(k, 0) + 1
        seen[(k, pos)] = seen[k]
    assert all(r["n"] == seen[(r["k"], r["pos"])] for r in ranked.collect())
    got = {(r["k"], r["pos"]): r["last"] for r in ordered.carried(df, ["k"], ["pos"], F.floor(c("pos") / 37), {"last": c("v")}).collect()}
    last = {}
    for k, pos, v in data:
        assert got[(k, pos)] == last.get(k)
        last[k] = v if v is not None else last.get(k)


def fold_bursts(times, quiet, age):
    out, start, last = {}, None, None
    for t in sorted(set(times)):
        if start is None or t - last > quiet or t - start > age:
            start = t
        out[t], last = start, t
    return out


@pytest.mark.parametrize("seed,quiet,age", [(1, 5, 30), (2, 3, 3), (3, 10, 12), (4, 1, 100)])
def test_bursts_are_the_plain_fold(spark, seed, quiet, age):
    rng = random.Random(seed)
    data = [("hot" if n % 3 else "k%d" % (n % 2), rng.randrange(900)) for n in range(500)]
    got = bursts.bursts(spark.createDataFrame(data, "k string,at bigint"), quiet, age, ["k"])
    want = sorted((k, b, t) for k in {k for k, _ in data} for t, b in fold_bursts([t for x, t in data if x == k], quiet, age).items())
    assert rows(got, "k", "burst", "at") == want
    times = np.array(sorted(t for k, t in data if k == "hot"))
    whole = cut_bursts(times, quiet, age, None, None)
    half = cut_bursts(times[:200], quiet, age, None, None)
    rest = cut_bursts(times[200:], quiet, age, int(half[-1]), int(times[199]))
    assert list(whole) == list(half) + list(rest)
    assert {int(t): int(b) for t, b in zip(times, whole)} == fold_bursts(times.tolist(), quiet, age)


def test_tool_state_is_the_plain_replay(spark):
    rng = random.Random(5)
    log = [("e", "p%d" % rng.randrange(4), n, rng.choice(["read", "expect", "confirm", "fail"]), "h%d" % rng.randrange(3)) for n in range(300)]
    log = [(e, p, n, op, None if op == "fail" and n % 4 == 0 else h) for e, p, n, op, h in log]
    read, expected = {}, {}
    for _, p, _, op, h in log:
        held = expected.setdefault(p, set())
        if op in ("read", "confirm"):
            read[p] = h
        if op == "expect":
            held.add(h)
        elif op == "confirm":
            expected[p] = {h}
        elif op == "fail":
            expected[p] = held & {h}
    want = sorted([("read", p, h) for p, h in read.items()] + [("expected", p, h) for p, hs in expected.items() for h in hs])
    got = sessions.tool_state(spark.createDataFrame(log, "element string,path string,pos bigint,op string,hash string"))
    assert rows(got, "holds", "path", "hash") == want


def test_reviews_are_the_plain_fold(spark):
    rng = random.Random(6)
    states = ["APPROVED", "CHANGES_REQUESTED", "COMMENTED", "DISMISSED", "PENDING"]
    data = [(1, n, "r%d" % rng.randrange(40), rng.choice(states)) for n in range(200)]
    at = {"r0": "requested", "team": "requested"}
    for _, _, who, state in data:
        if state == "PENDING" or at.get(who) == "requested":
            continue
        now = at.setdefault(who, "commented")
        if state == "DISMISSED":
            at[who] = "commented"
        elif not (state == "COMMENTED" and now in ("approved", "changes-requested")):
            at[who] = {"APPROVED": "approved", "CHANGES_REQUESTED": "changes-requested"}.get(state, "commented")
    got = sessions.fold_reviews(spark.createDataFrame(data, "pr int,pos int,reviewer string,state string"),
                                spark.createDataFrame([(1, "r0"), (1, "team")], "pr int,reviewer string"))
    assert rows(got, "reviewer", "state") == sorted(at.items())


def test_every_state_and_trigger(spark):
    triggers = [t for _, t, _ in fixed.TRANSITIONS]
    moves = [(s, t) for s in fixed.SESSION_STATES for t in set(triggers)]
    odd = sessions.illegal_transitions(spark.createDataFrame(moves, "state string,trigger string"))
    assert odd.count() == 11 * 18 - 18 and len(set(triggers)) == 18


def test_a_long_session_replays_like_the_plain_fold(spark):
    rng = random.Random(7)
    triggers = [t for _, t, _ in fixed.TRANSITIONS] + ["nonsense"]
    data = [("s%d" % (n % 2 if n % 10 == 0 else 0), n, rng.choice(triggers)) for n in range(3000)]
    edges = {(a, t): b for a, t, b in fixed.TRANSITIONS}
    want = {}
    for s, _, t in data:
        state, bad = want.get(s, ("planning", 0))
        want[s] = (edges[(state, t)], bad) if (state, t) in edges else (state, bad + 1)
    got = sessions.replay_lifecycles(spark.createDataFrame(data, "session string,seq bigint,trigger string"))
    assert {r["session"]: (r["state"], r["illegal"]) for r in got.collect()} == want


def layers(spark, nodes, edges):
    n = spark.createDataFrame([("p", i, k) for k, i in enumerate(nodes)], "session string,id string,pos int")
    e = spark.createDataFrame([("p", a, b) for a, b in edges], "session string,id string,depends_on string")
    return {r["id"]: (r["layer"], r["error"]) for r in graph.topological_layers(n, e, ["session"]).collect()}


def test_layers(spark):
    assert layers(spark, "abcd", [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")]) == {"a": (1, None), "b": (2, None), "c": (2, None), "d": (3, None)}
    odd = layers(spark, "abcd", [("a", "b"), ("b", "a"), ("c", "x"), ("d", "d")])
    assert odd["c"] == (None, "depends on unknown x") and {odd[k] for k in "abd"} == {(None, "on or behind a cycle")}


def test_dev_dependencies_count_in_the_first_step_only(spark):
    key = lambda data, schema: spark.createDataFrame([("r", "t", *d) for d in data], "repo string,tree_key string," + schema)
    packages = key([(x,) for x in "abcd"], "name string")
    deps, dev = key([("b", "c")], "name string,dep string"), key([("a", "b"), ("c", "d")], "name string,dep string")
    held = rows(graph.package_closure(packages, deps, dev), "package", "holds")
    assert held == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c"), ("c", "d"), ("d", "d")]
    assert rows(graph.dependents(packages, deps, dev, key([("d",)], "name string")), "name") == [("c",), ("d",)]


def test_reach_goes_both_ways(spark):
    links = spark.createDataFrame([("r", "t", a, b) for a, b in ("ab", "cb", "cd", "de")], "repo string,tree_key string,from string,to string")
    foci = spark.createDataFrame([("r", "t", "a")], "repo string,tree_key string,focus string")
    assert rows(graph.reach(links, foci, 3), "node", "hops") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.reach(links, foci, 0), "node", "hops") == [("a", 0)]


def test_split_areas_take_free_names(spark):
    item = lambda module, entry=False: ("r", "t", f"k::{module}::x#fn", "fn", "src/" + module.replace("::", "/") + ".rs", module, None, entry, 1)
    modules = ["a::one", "a::two", "b::one", "b::c", "c"]
    items = spark.createDataFrame([item(m) for m in modules], "repo string,tree_key string,id string,kind string,file string,module string,cfg string,entry boolean,pos int")
    entries = items.filter(c("id").isin("k::a::one::x#fn", "k::b::c::x#fn")).select("repo", "tree_key", c("id").alias("item"))
    table = lambda m: ("r", "t", f"k::{m}::x#fn", "table", "orders", "reads")
    links = spark.createDataFrame([table("a::two"), table("b::one")], "repo string,tree_key string,from string,target_kind string,target_id string,kind string")
    none = spark.createDataFrame([], "repo string,tree_key string,id string,kind string,side string")
    got = areas.propose_areas(items, entries, links, none, none)
    assert {(r["area"], r["side"], tuple(r["paths"]), r["area_order"]) for r in got.collect()} == {
        ("one", "driving", ("src/a/one.rs",), 2), ("two", "driven", ("src/a/two.rs",), 2), ("b::one", "driven", ("src/b/one.rs",), 1),
        ("b::c", "driving", ("src/b/c.rs",), 1), ("c", "domain", ("src/c.rs",), 1)}


def test_changed_files_flags_a_path_listed_twice(spark):
    files = lambda data: spark.createDataFrame([("r", p, h) for p, h in data], "repo string,path string,file_hash string")
    before, after = files([("same", "1"), ("new", "1"), ("gone", "1"), ("twice", "1"), ("twice", "1")]), files([("same", "1"), ("new", "2"), ("twice", "1")])
    assert rows(snapshots.changed_files(before, after), "path") == [("gone",), ("new",), ("twice",)]
    assert rows(snapshots.symmetric_difference(before, after), "path") == [("gone",), ("new",)]


def test_three_areas_in_a_cycle(spark):
    linked = spark.createDataFrame([("r", "t", a, b) for a, b in ["xy"] * 5 + ["yz"] * 4 + ["zx"] + ["xw"]], "repo string,tree_key string,from_area string,target_area string")
    got = lints.area_cycles(linked).collect()
    assert [(r["cycle"], r["areas"], r["from_area"], r["target_area"], r["links"]) for r in got] == [("x", ["x", "y", "z"], "z", "x", 1)]
    # Two areas: the direction with fewer links goes; of as many, the one with more forbidden ones.
    pair = lambda rows: {(r["from_area"], r["target_area"]) for r in lints.area_cycles(spark.createDataFrame([("r", "t", *x) for x in rows], "repo string,tree_key string,from_area string,target_area string,bad boolean"), F.col("bad")).collect()}
    assert pair([("a", "b", False), ("a", "b", False), ("b", "a", True)]) == {("b", "a")}
    assert pair([("a", "b", True), ("b", "a", False)]) == {("a", "b")} and pair([("a", "b", False), ("b", "a", True)]) == {("b", "a")}


def test_a_cut_says_whether_it_is_exact(spark):
    schema = "repo string,tree_key string,from_area string,target_area string"
    of = lambda *pairs: rows(lints.area_cycles(spark.createDataFrame([("r", "t", *p) for p in pairs], schema)), "from_area", "target_area", "cut_exact")
    assert of("ab", "ab", "ba") == [("b", "a", True)] and of("ab", "ba") == [("a", "b", True)]
    assert of("xy", "xy", "yz", "yz", "zx") == [("z", "x", False)]


def test_a_finding_meets_its_link_by_a_short_key(spark):
    links = spark.createDataFrame([("r", "t", i, x) for i, x in [("a", "guessed"), ("b", "declared"), ("c", "resolved"), (None, "guessed")]], "repo string,tree_key string,id string,confidence string")
    findings = spark.createDataFrame(
        [("r", "t", f"f{n}", link, level, gates) for n, (link, level, gates) in enumerate([("a", "block", None), ("a", "warn", None), ("b", "block", False), ("b", None, True), ("c", "block", True), (None, "block", True)])],
        "repo string,tree_key string,id string,link string,level string,gates_merge boolean")
    assert [m for m, in rows(invariants.finding_confidence(findings, links), "message")] == ["finding f0 on guessed link a blocks or gates", "finding f3 on declared link b gates a merge"]


def test_nothing_is_expected_of_repos_without_findings(spark):
    repos = spark.createDataFrame([("r", "t")], "repo string,tree_key string")
    none = spark.createDataFrame([], "repo string,tree_key string,level string,allowed_by string")
    assert rows(rules.summarize_findings(none, repos), "blocking", "warnings", "allowed", "exit_code") == [(0, 0, 0, 0)]


def test_unique_ids_in_visit_order(spark):
    items = spark.createDataFrame([("r", "t", n, "dup" if n != 2 else "own") for n in range(5)], "repo string,tree_key string,pos bigint,id string")
    assert rows(assemble.unique_ids(items, chunk=2), "pos", "id") == [(0, "dup"), (1, "dup.2"), (2, "own"), (3, "dup.3"), (4, "dup.4")]


def test_reach_difference_of_repeated_and_unknown_rows(spark, monkeypatch):
    plain, told = invariants.materialize, []
    monkeypatch.setattr(invariants, "materialize", lambda df, label: told.append(label) or plain(df, label))
    make = lambda found: spark.createDataFrame([("r", *x) for x in found], "repo string,focus string,node string")
    found = invariants.reach_difference(make([("a", "b"), ("a", "c"), ("a", None)]), make([("a", "c"), ("a", "d"), ("a", "d"), (None, "b")]), ["repo", "focus"])
    got = [(r.focus, r.node, r.side) for r in found.collect()]
    assert sorted(got, key=repr) == sorted([("a", "b", "missing"), ("a", None, "missing"), ("a", "d", "extra"), ("a", "d", "extra"), (None, "b", "extra")], key=repr)
    assert told == ["reach-side", "reach-side"]


def test_check_output_can_be_packed(spark, tmp_path):
    names = "repo string,tree_key string,rule string,level string,site string,from string,target string,kind string,file string,line bigint,allowed_by string"
    found = spark.createDataFrame([("r", "t", "a must not use b", "block", f"s{n}", "x", "y", "calls", "f", n, None) for n in (2, 1)], names)
    repos = spark.createDataFrame([("r", "t"), ("s", "t")], "repo string,tree_key string")
    reports.write_check_output(found, repos, str(tmp_path / "packed"), compression="gzip")
    assert list((tmp_path / "packed").rglob("*.txt.gz")) and not list((tmp_path / "packed").rglob("*.txt"))
    lines = spark.read.schema("value string,repo string,tree_key string").text(str(tmp_path / "packed"))
    assert sorted((r.repo, r.n) for r in lines.groupBy("repo").agg(F.count("value").alias("n")).collect()) == [("r", 3), ("s", 1)]
