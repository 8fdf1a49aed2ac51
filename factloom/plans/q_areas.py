"""Proposed areas, facts assembled across files, and the lints."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import fixed
from factloom.functions import columns as C
from factloom.operators import areas as A
from factloom.operators import assemble, graph, lints, placement, rules
from factloom.operators.ordered import KEYS
from factloom.plans.catalog import query
from factloom.plans.q_graph import workers
from factloom.plans.views import VIEWS

c = F.col

# Calls between parts as links of four kinds, next to the links of the orders.
VIEWS["v_call_links_1"] = """
SELECT x.id AS "from", y.id AS target_id, CASE (c.a + c.b) % 4 WHEN 0 THEN 'uses-type' WHEN 1 THEN 'calls-port' WHEN 2 THEN 'calls' ELSE 'implements' END AS kind,
  x.file AS file, CAST(c.b % 500 + 1 AS BIGINT) AS line, c.b AS b
FROM v_part_calls c JOIN v_part_ids x ON x.num = c.a JOIN v_part_ids y ON y.num = c.b"""
VIEWS["v_all_links"] = """
SELECT repo, tree_key, "from", target_kind, target_id, member, kind, confidence, file, line FROM v_links
UNION ALL SELECT 'alpha', 'commit:alpha', "from", 'item', target_id, 'call', kind, 'resolved', file, line FROM v_call_links_1
UNION ALL SELECT 'beta', 'commit:beta', "from", 'item', target_id, 'call', kind, 'guessed', file, line FROM v_call_links_1"""
VIEWS["v_members"] = """
SELECT repo, id, file, top, child FROM v_items WHERE cfg IS NULL OR cfg NOT LIKE '%test,%'"""
VIEWS["v_io_from"] = """
SELECT DISTINCT l.repo, l."from" AS id FROM v_all_links l WHERE l.target_kind = 'table'
  OR (l.target_kind = 'external' AND EXISTS (SELECT 1 FROM v_externals e WHERE e.repo = l.repo AND e.id = l.target_id AND e.kind NOT IN ('crate', 'pub', 'declared')))
  OR (l.target_kind = 'port' AND EXISTS (SELECT 1 FROM v_ports e WHERE e.repo = l.repo AND e.id = l.target_id AND e.side = 'driven' AND e.kind NOT IN ('crate', 'pub', 'declared')))"""
VIEWS["v_route_ends"] = """
SELECT repo, "from" AS id FROM v_all_links WHERE kind = 'routes' AND target_kind = 'item' UNION SELECT repo, target_id FROM v_all_links WHERE kind = 'routes' AND target_kind = 'item'"""
VIEWS["v_entry_ids"] = """SELECT repo, item AS id FROM v_few_entries UNION SELECT repo, id FROM v_route_ends"""
# Few entries by name; routes make entries too.
VIEWS["v_few_entries"] = """SELECT repo, tree_key, id AS item, 'main' AS kind, file, line FROM v_items WHERE pos % 193 = 0 AND crate = 'part' AND repo = 'alpha'"""
VIEWS["v_few_links"] = """
SELECT * FROM v_all_links
UNION ALL SELECT 'alpha', 'commit:alpha', "from", 'table', 't1', CAST(NULL AS STRING), 'reads', 'resolved', file, line FROM v_call_links_1 WHERE b % 29 = 0"""
for name in ("v_io_from", "v_route_ends"):
    VIEWS[name] = VIEWS[name].replace("v_all_links", "v_few_links")
VIEWS["v_flags"] = """
SELECT m.*, e.id IS NOT NULL AS e, o.id IS NOT NULL AS io FROM v_members m LEFT JOIN v_entry_ids e ON e.repo = m.repo AND e.id = m.id
LEFT JOIN v_io_from o ON o.repo = m.repo AND o.id = m.id"""
VIEWS["v_groups"] = """
SELECT repo, top, child, false AS has_file, true AS has_dir, bool_or(e) AS holds_entry, bool_or(io) AS touches_io FROM v_flags GROUP BY repo, top, child
UNION ALL SELECT repo, top, NULL, false, true, bool_or(e), bool_or(io) FROM v_flags GROUP BY repo, top"""
VIEWS["v_made"] = """
SELECT DISTINCT m.repo, m.top, m.child, l.target_id AS trait FROM v_few_links l JOIN v_members m ON m.repo = l.repo AND m.id = l."from"
JOIN v_items t ON t.repo = l.repo AND t.id = l.target_id AND t.kind = 'trait' WHERE l.kind = 'implements' AND l.target_kind = 'item'"""
VIEWS["v_io_traits"] = """
SELECT DISTINCT m.repo, m.trait FROM v_made m JOIN v_groups g ON g.repo = m.repo AND g.top = m.top AND g.child = m.child AND g.touches_io"""
VIEWS["v_group_sides"] = """
SELECT g.*, CASE WHEN holds_entry THEN 'driving' WHEN touches_io OR EXISTS (SELECT 1 FROM v_made m JOIN v_io_traits t ON t.repo = m.repo AND t.trait = m.trait
  WHERE m.repo = g.repo AND m.top = g.top AND (g.child IS NULL OR m.child = g.child)) THEN 'driven' ELSE 'domain' END AS side FROM v_groups g"""


def group_inputs(i):
    return i.v_items, i.v_few_entries, i.v_few_links, i.v_externals, i.v_ports


@query("module_groups", """
SELECT repo, top, child, has_file, has_dir, holds_entry, touches_io FROM v_groups""")
def _(i):
    return A.module_groups(*group_inputs(i))[0].drop("tree_key", "root")


@query("route_ends", "SELECT repo, id AS node FROM v_route_ends")
def _(i):
    return A.route_ends(i.v_few_links).drop("tree_key")


@query("io_traits", "SELECT repo, trait FROM v_io_traits")
def _(i):
    return A.io_traits(*A.module_groups(*group_inputs(i))).drop("tree_key")


@query("module_side", "SELECT repo, top, child, side FROM v_group_sides")
def _(i):
    return A.module_sides(*A.module_groups(*group_inputs(i))).select("repo", "top", "child", "side")


@query("column_rule", """
SELECT r.repo, CASE WHEN EXISTS (SELECT 1 FROM v_few_entries e JOIN v_items i ON i.repo = e.repo AND i.id = e.item
  WHERE e.repo = r.repo AND (i.cfg IS NULL OR i.cfg NOT LIKE '%test,%')) THEN 'hexagon' ELSE 'layers' END AS rule FROM v_repos r""")
def _(i):
    return A.column_rules(i.v_items, i.v_few_entries).drop("tree_key")


# Only alpha has an entry. No child name repeats between two split modules there or equals a top module's, but c0, c1, c2 do.
@query("propose_areas", """
WITH hex AS (SELECT DISTINCT e.repo FROM v_few_entries e JOIN v_items i ON i.repo = e.repo AND i.id = e.item WHERE i.cfg IS NULL OR i.cfg NOT LIKE '%test,%'),
mixed AS (SELECT repo, top FROM v_group_sides WHERE child IS NOT NULL AND repo IN (SELECT repo FROM hex) GROUP BY repo, top
  HAVING bool_or(side = 'driving') AND bool_or(side = 'driven')),
whole AS (SELECT g.repo, g.top AS area, g.side, 'src/' || g.top || '/**' AS paths FROM v_group_sides g WHERE child IS NULL
  AND NOT EXISTS (SELECT 1 FROM mixed m WHERE m.repo = g.repo AND m.top = g.top)),
parts AS (SELECT g.repo, CASE WHEN g.top = min(g.top) OVER (PARTITION BY g.repo, g.child) THEN g.child ELSE g.top || '::' || g.child END AS area, g.side,
  'src/' || g.top || '/' || g.child || '/**' AS paths FROM v_group_sides g JOIN mixed m ON m.repo = g.repo AND m.top = g.top WHERE g.child IS NOT NULL),
both_kinds AS (SELECT * FROM whole UNION ALL SELECT * FROM parts)
SELECT repo, area, CASE WHEN repo IN (SELECT repo FROM hex) THEN side END AS side, paths,
  CAST(row_number() OVER (PARTITION BY repo, CASE WHEN repo IN (SELECT repo FROM hex) THEN side END ORDER BY area) AS INT) AS area_order,
  CASE WHEN repo IN (SELECT repo FROM hex) THEN 'hexagon' ELSE 'layers' END AS rule FROM both_kinds""")
def _(i):
    return A.propose_areas(*group_inputs(i)).withColumn("paths", F.array_join("paths", ", ")).drop("tree_key")


@query("area_order", """
SELECT repo, module AS area, kind AS side, CAST(row_number() OVER (PARTITION BY repo, kind ORDER BY module) AS INT) AS area_order
FROM (SELECT DISTINCT repo, module, kind FROM v_items) x""")
def _(i):
    return A.area_order(i.v_items.select("repo", c("module").alias("area"), c("kind").alias("side")).distinct(), ["repo"])


# ---------------------------------------------------------------- assembly

VIEWS["v_routes"] = """
SELECT i.repo, i.tree_key, i.id AS item, 'GET /' || p.p_name AS name, p.p_brand AS framework, CAST(i.pos % 2 AS BIGINT) AS phase,
  CAST((i.pos * 37) % 1009 AS BIGINT) AS walk_pos, i.pos AS seq, i.file, i.line FROM v_parts i JOIN part p ON p.p_partkey = i.pos WHERE i.pos % 31 = 0"""


@query("first_claim", """
WITH claims AS (
  SELECT repo, id AS item, 'main' AS kind, CAST(NULL AS STRING) AS framework, 'resolved' AS confidence, file, line, 0 AS r, 0 AS a, 0 AS b, 0 AS d FROM v_parts WHERE entry
  UNION ALL SELECT repo, item, 'framework', framework, 'guessed', file, line, 1, phase, walk_pos, seq FROM v_routes
  UNION ALL SELECT repo, target, 'spawned-worker', NULL, CASE WHEN in_main THEN 'resolved' ELSE 'guessed' END, file, line, 2, 0, 0, 0 FROM v_workers)
SELECT repo, item, kind, framework, confidence, file, line FROM (SELECT *, row_number() OVER (PARTITION BY repo, item ORDER BY r, a, b, d) AS rn FROM claims) x WHERE rn = 1""")
def _(i):
    mains = i.v_parts.filter("entry").select(*KEYS, c("id").alias("item"), "file", "line")
    return assemble.first_claims(mains, i.v_routes, workers(i)).drop("tree_key")


@query("route_ports", """
SELECT repo, 'port:http:' || name AS id, name, 'http' AS kind, 'driving' AS side, 'unresolved' AS section, file, line FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY phase, walk_pos, seq) AS rn FROM v_routes) x WHERE rn = 1""")
def _(i):
    return assemble.route_ports(i.v_routes).drop("tree_key")


VIEWS["v_walk"] = """
SELECT 'alpha' AS repo, 'commit:alpha' AS tree_key, event_id AS pos, 'f' || CAST(user_id AS STRING) AS path FROM events"""
VIEWS["v_visit_notes"] = """
SELECT 'alpha' AS repo, 'commit:alpha' AS tree_key, event_id AS note, 'f' || CAST(user_id * 2 AS STRING) AS path, CAST(event_id % 90 AS BIGINT) AS visit FROM events"""


@query("walk_position", """
WITH visits AS (SELECT path, pos, row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS visit FROM v_walk)
SELECT n.note, n.path, n.visit, CAST(coalesce(v.pos, 4294967295) AS BIGINT) AS walk_pos FROM v_visit_notes n
LEFT JOIN visits v ON v.path = n.path AND v.visit = n.visit""")
def _(i):
    return assemble.walk_positions(i.v_visit_notes, i.v_walk).select("note", "path", "visit", "walk_pos")


VIEWS["v_sql_notes"] = """
SELECT DISTINCT i.repo, i.tree_key, i.id AS owner, i.top || CAST(i.pos % 7 AS STRING) AS "table", i.pos % 2 = 0 AS inserts, i.pos % 40 = 0 AS dequeues FROM v_parts i"""
VIEWS["v_created"] = """
SELECT DISTINCT repo, tree_key, top || CAST(pos % 9 AS STRING) AS name, 'migrations/' || top || '.sql' AS file, CAST(pos % 9 + 1 AS BIGINT) AS line FROM v_parts"""


@query("queue_tables", """
SELECT t.repo, t.name, t.file, t.line, EXISTS (SELECT 1 FROM v_sql_notes s WHERE s.repo = t.repo AND s."table" = t.name AND s.dequeues) AS queue FROM v_created t""")
def _(i):
    return assemble.queue_tables(i.v_created, i.v_sql_notes).drop("tree_key")


@query("queue_users", """
SELECT DISTINCT s.repo, s."table" AS name, r.role, s.owner FROM v_sql_notes s JOIN (VALUES ('inserter'), ('dequeuer')) AS r(role)
  ON CASE r.role WHEN 'inserter' THEN s.inserts ELSE s.dequeues END
WHERE EXISTS (SELECT 1 FROM v_created t WHERE t.repo = s.repo AND t.name = s."table")
  AND EXISTS (SELECT 1 FROM v_sql_notes d WHERE d.repo = s.repo AND d."table" = s."table" AND d.dequeues)""")
def _(i):
    return assemble.queue_users(i.v_created, i.v_sql_notes).drop("tree_key")


VIEWS["v_table_links"] = """
SELECT i.repo, i.tree_key, i.id AS "from", 'table' AS target_kind, i.top || CAST(i.pos % 7 AS STRING) AS target_id, CAST(NULL AS STRING) AS member,
  CASE WHEN n.n = 1 THEN 'queues' ELSE 'reads' END AS kind, i.file, i.line FROM v_parts i JOIN (VALUES (0), (1)) AS n(n) ON n.n = 0 OR i.pos % 6 = 0 WHERE i.pos % 5 <> 1"""


@query("queue_inserters", """
SELECT DISTINCT l.repo, l."from", l.target_id, 'queues' AS kind, 'guessed' AS confidence, l.file, l.line FROM v_table_links l
JOIN v_sql_notes s ON s.repo = l.repo AND s.owner = l."from" AND s."table" = l.target_id AND s.inserts
WHERE l.kind = 'reads' AND EXISTS (SELECT 1 FROM v_sql_notes d WHERE d.repo = l.repo AND d."table" = l.target_id AND d.dequeues)
  AND NOT EXISTS (SELECT 1 FROM v_table_links q WHERE q.repo = l.repo AND q."from" = l."from" AND q.target_id = l.target_id AND q.kind = 'queues')""")
def _(i):
    return assemble.queue_inserters(i.v_sql_notes, i.v_table_links).select("repo", "from", "target_id", "kind", "confidence", "file", "line")


@query("touched_surface", """
SELECT i.repo, p.p_brand AS package, string_agg(DISTINCT p.p_name, ',' ORDER BY p.p_name) AS paths FROM v_parts i JOIN part p ON p.p_partkey = i.pos GROUP BY ALL""")
def _(i):
    named = i.v_parts.join(i.part, c("p_partkey") == c("pos"))
    per_file = named.groupBy(*KEYS, "file", c("p_brand").alias("package")).agg(F.collect_set("p_name").alias("paths"))
    return assemble.touched_surface(per_file).select("repo", "package", F.array_join("paths", ",").alias("paths"))


VIEWS["v_drivers"] = """
SELECT repo, tree_key, k AS pos, name || '/Cargo.toml' AS file, k AS line, CASE k % 3 WHEN 0 THEN 'sqlite,mysql' WHEN 1 THEN 'runtime' ELSE 'postgres' END AS features
FROM v_pkgs WHERE num % 3 <> 0 AND k > num % 7"""
VIEWS["v_ws"] = """SELECT DISTINCT repo, tree_key, repo || '/Cargo.toml' AS file FROM v_pkgs"""
VIEWS["v_ws_sql"] = """SELECT repo, tree_key, 't' || CAST(k AS STRING) AS "table" FROM v_pkgs WHERE num % 2 = 0 AND k < 3"""
VIEWS["v_ws_created"] = """SELECT repo, tree_key, 'm/' || name || '.sql' AS file, k AS line FROM v_pkgs WHERE num % 5 > 0 AND k > 20"""


@query("sql_external", """
WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY pos) AS rn FROM v_drivers) x WHERE rn = 1),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file, line) AS rn FROM v_ws_created) x WHERE rn = 1),
t AS (SELECT repo, string_agg(DISTINCT "table", ',' ORDER BY "table") AS touched FROM v_ws_sql GROUP BY repo)
SELECT w.repo, CASE WHEN d.features LIKE '%postgres%' THEN 'postgres' WHEN d.features LIKE '%mysql%' THEN 'mysql' WHEN d.features LIKE '%sqlite%' THEN 'sqlite' ELSE 'sql' END AS name,
  coalesce(t.touched, '') AS touched, coalesce(d.file, m.file, w.file) AS file,
  CAST(CASE WHEN d.repo IS NOT NULL THEN d.line WHEN m.repo IS NOT NULL THEN m.line ELSE 1 END AS BIGINT) AS line
FROM v_ws w LEFT JOIN d ON d.repo = w.repo LEFT JOIN m ON m.repo = w.repo LEFT JOIN t ON t.repo = w.repo
WHERE t.repo IS NOT NULL OR (m.repo IS NOT NULL AND d.repo IS NOT NULL)""")
def _(i):
    drivers = i.v_drivers.withColumn("features", F.split("features", ","))
    out = assemble.sql_externals(i.v_ws_sql, i.v_ws_created, drivers, i.v_ws)
    return out.select("repo", "name", F.array_join("touched", ",").alias("touched"), "file", "line")


@query("dependency_witness", """
WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, dep ORDER BY k) AS rn FROM (
    SELECT x.repo, x.dep, p.k, x.name || '/Cargo.toml' AS file, p.k AS line FROM v_pkg_deps x JOIN v_pkgs p ON p.repo = x.repo AND p.name = x.name WHERE x.local) y) z WHERE rn = 1)
SELECT p.repo, p.name AS package, CASE WHEN d.file IS NOT NULL THEN d.file WHEN p.k % 2 = 0 THEN 'Cargo.lock' ELSE p.repo || '/Cargo.toml' END AS file,
  CAST(CASE WHEN d.file IS NOT NULL THEN d.line WHEN p.k % 2 = 0 THEN p.k * 10 ELSE 1 END AS BIGINT) AS line
FROM v_pkgs p LEFT JOIN d ON d.repo = p.repo AND d.dep = p.name""")
def _(i):
    pkgs = i.v_pkgs
    declared = i.v_pkg_deps.filter("local").join(pkgs.select(*KEYS, "name", "k"), [*KEYS, "name"]).select(
        *KEYS, c("dep").alias("package"), c("k").alias("pos"), F.concat("name", F.lit("/Cargo.toml")).alias("file"), c("k").alias("line"))
    locked = pkgs.filter(c("k") % 2 == 0).select(*KEYS, "name", (c("k") * 10).alias("line"))
    return assemble.dependency_witness(pkgs.select(*KEYS, c("name").alias("package")), declared, locked, i.v_ws).drop("tree_key")


@query("package_ids", """
WITH RECURSIVE reach AS (SELECT repo, name AS package, name AS holds FROM v_pkgs
  UNION SELECT r.repo, r.package, d.dep FROM reach r JOIN v_pkg_deps d ON d.repo = r.repo AND d.name = r.holds),
t AS (SELECT repo, name, CASE WHEN k % 7 = 3 THEN '-' ELSE sha256(repo || name) END AS tree, CASE WHEN k % 4 = 0 THEN 'out' || CAST(k AS STRING) END AS out FROM v_pkgs),
d AS (SELECT r.repo, r.package, coalesce(string_agg(CASE WHEN r.holds <> r.package THEN 'dep ' || r.holds || ' ' || t.tree || chr(10) END, '' ORDER BY r.holds), '') AS deps,
  coalesce(string_agg('out_dir ' || r.holds || ' ' || t.out || chr(10), '' ORDER BY r.holds), '') AS outs
  FROM reach r JOIN t ON t.repo = r.repo AND t.name = r.holds GROUP BY r.repo, r.package)
SELECT d.repo, d.package, sha256('package 1' || chr(10) || 'tree ' || t.tree || chr(10) || d.deps || d.outs || 'lock ' || d.repo || chr(10) || 'syntax') AS id
FROM d JOIN t ON t.repo = d.repo AND t.name = d.package""")
def _(i):
    from factloom.operators.snapshots import package_ids

    pkgs = i.v_pkgs.withColumn("package", c("name")).withColumn("dir", F.concat(F.lit("crates/"), "name"))
    trees = pkgs.filter(c("k") % 7 != 3).select(*KEYS, "dir", F.sha2(F.concat("repo", "name"), 256).alias("id"))
    outs = pkgs.filter(c("k") % 4 == 0).select(*KEYS, "dir", F.concat(F.lit("out"), c("k").cast("string")).alias("out"))
    locks = pkgs.select(*KEYS, c("repo").alias("lock"), F.lit("syntax").alias("analyzer")).distinct()
    return package_ids(pkgs.select(*KEYS, "package", "dir"), i.v_pkg_deps, trees, locks, outs).drop("tree_key")


@query("wires", """
WITH made AS (SELECT DISTINCT l.repo, l."from" AS owner, f.crate AS pkg, l.target_id AS type, l.file, l.line FROM v_links l JOIN v_items f ON f.repo = l.repo AND f.id = l."from"
  JOIN v_items t ON t.repo = l.repo AND t.id = l.target_id AND t.kind = 'struct' WHERE l.kind = 'constructs' AND l.line % 2 = 0),
impls AS (SELECT i.repo, i.id AS type, i.id || '/impl' || CAST(n.n AS STRING) AS impl, CASE WHEN n.n = 0 THEN 'part' ELSE 'cust' END AS pkg
  FROM v_items i JOIN (VALUES (0), (1)) AS n(n) ON true WHERE i.kind = 'struct' AND i.crate = 'part')
SELECT m.repo, m.owner AS "from", p.impl AS target_id, 'wires' AS kind, 'guessed' AS confidence, arg_min(m.file, struct_pack(f := m.file, l := m.line)) AS file, min(m.line) AS line
FROM made m JOIN impls p ON p.repo = m.repo AND p.type = m.type AND p.pkg = 'part' GROUP BY m.repo, m.owner, p.impl""")
def _(i):
    items = i.v_items
    owners = items.select(*KEYS, c("id").alias("from"), c("crate").alias("owner_package"))
    structs = items.filter(c("kind") == "struct").select(*KEYS, c("id").alias("target_id"))
    builds = i.v_links.filter(c("kind") == "constructs").join(owners, [*KEYS, "from"]).join(structs, [*KEYS, "target_id"], "left_semi").select(
        *KEYS, c("from").alias("owner"), "owner_package", c("target_id").alias("made"), (c("line") % 2 == 0).alias("passed"), "file", "line")
    impls = items.filter((c("kind") == "struct") & (c("crate") == "part")).select(
        *KEYS, c("id").alias("type"), F.explode(F.array(*[
            F.struct(F.concat("id", F.lit(f"/impl{n}")).alias("impl"), F.lit(p).alias("package")) for n, p in ((0, "part"), (1, "cust"))])).alias("x")
    ).select(*KEYS, "type", "x.impl", "x.package")
    seen = i.v_repos.select(*KEYS, F.lit("supp").alias("package"), F.explode(F.array(F.lit("supp"), F.lit("part"))).alias("holds"))
    return assemble.wires(builds, impls, seen).drop("tree_key")


@query("port_adapters", """
SELECT repo, target_id AS trait, CAST(count(DISTINCT "from") AS BIGINT) AS adapters FROM v_all_links WHERE kind = 'implements' AND target_kind = 'item' GROUP BY ALL""")
def _(i):
    return assemble.port_adapters(i.v_all_links).drop("tree_key")


@query("dedupe_links", """
SELECT repo, "from", target_kind, target_id, kind, member, file, line, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, "from", target_kind, target_id, kind, member ORDER BY file, line, confidence) AS rn FROM v_links) x WHERE rn = 1""")
def _(i):
    return assemble.dedupe_links(i.v_links, ["file", "line", "confidence"]).select(
        "repo", "from", "target_kind", "target_id", "kind", "member", "file", "line", "confidence")


@query("unique_ids", """
SELECT repo, pos, CASE WHEN n > 1 THEN id || '.' || CAST(n AS STRING) ELSE id END AS id FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY pos) AS n FROM (SELECT repo, pos, module AS id FROM v_parts) y) x""")
def _(i):
    return assemble.unique_ids(i.v_parts.select(*KEYS, "pos", c("module").alias("id")), chunk=50).drop("tree_key")


VIEWS["v_uses"] = """
SELECT l.repo, l.tree_key, l."from", l.target_id, l.line, CASE WHEN l.line % 11 = 0 THEN 'variant' WHEN l.line % 13 = 0 THEN 'external' ELSE t.kind END AS target_kind,
  CASE l.line % 9 WHEN 0 THEN 'call' WHEN 1 THEN 'value' WHEN 2 THEN 'construct' WHEN 3 THEN 'type' WHEN 4 THEN 'impl-self' WHEN 5 THEN 'field' WHEN 6 THEN 'impl-trait'
    WHEN 7 THEN 'supertrait' ELSE 'pattern' END AS context,
  'x' || CAST(l.line AS STRING) AS field, l.line % 4 = 0 AS is_test, l.line % 6 = 0 AS is_self, l.line % 5 = 0 AS in_trait, l.line % 7 = 0 AS spawned, l.kind AS link_kind, l.member AS link_member
FROM v_links l JOIN v_items t ON t.repo = l.repo AND t.id = l.target_id WHERE l.target_kind = 'item'"""


@query("classify_link", f"""
SELECT repo, "from", target_id, line, link_kind, link_member, target_kind, context, kind, member, access FROM (
  SELECT u.*, CASE WHEN target_kind = 'fn' AND context = 'call' AND is_test THEN 'tests' WHEN target_kind = 'fn' AND context = 'call' AND in_trait THEN 'calls-port' ELSE d.k END AS kind,
    CASE WHEN context = 'field' AND d.k = 'holds' THEN field WHEN target_kind = 'variant' THEN field END AS member, d.a AS access
  FROM v_uses u JOIN (VALUES {", ".join("('%s','%s','%s',%s)" % (t, x, k, "NULL" if a is None else f"'{a}'") for t, x, k, a in fixed.USE_TABLE)}) AS d(t, x, k, a)
    ON d.t = u.target_kind AND d.x = u.context) y
WHERE NOT (target_kind = 'fn' AND context = 'call' AND spawned) AND NOT (is_self AND context = 'type' AND target_kind IN ('struct', 'union', 'enum', 'type-alias'))""")
def _(i):
    uses = i.v_uses.drop("member")
    return assemble.classify_links(uses).select(
        "repo", "from", "target_id", "line", "link_kind", "link_member", "target_kind", "context", "kind", "member", "access")


VIEWS["v_fold_items"] = """
SELECT repo, tree_key, id, CASE WHEN pos % 10 = 4 THEN 'impl' WHEN pos % 17 = 0 THEN 'mod' ELSE kind END AS kind, visibility, module, area, pos,
  CASE WHEN pos % 10 >= 5 THEN prev END AS parent, CASE WHEN pos % 10 = 4 THEN prev END AS self_type FROM (
  SELECT p.*, p.top AS area, lag(p.id) OVER (PARTITION BY p.repo, p.top ORDER BY p.id) AS prev FROM v_items p) x"""
VIEWS["v_rows"] = """
SELECT * FROM (WITH RECURSIVE own AS (SELECT i.repo, i.id, i.area, CASE WHEN i.parent IS NOT NULL THEN i.parent WHEN i.kind = 'impl' AND t.id IS NOT NULL THEN i.self_type
    WHEN i.visibility = 'private' AND i.kind NOT IN ('mod', 'impl') THEN 'module:' || i.module ELSE i.id END AS up
  FROM v_fold_items i LEFT JOIN v_fold_items t ON t.repo = i.repo AND t.id = i.self_type AND t.area = i.area),
walk AS (SELECT repo, id, area, up AS r, 0 AS n FROM own
  UNION ALL SELECT w.repo, w.id, w.area, p.up, w.n + 1 FROM walk w JOIN own p ON p.repo = w.repo AND p.area = w.area AND p.id = w.r WHERE p.up <> w.r)
SELECT repo, id, area, arg_max(r, n) AS "row" FROM walk GROUP BY repo, id, area) z"""


def folded_rows(i):
    items = i.v_fold_items
    return assemble.row_fold(items.drop("area", "self_type"), items, items)


@query("row_fold", 'SELECT repo, id, area, "row" FROM v_rows')
def _(i):
    return folded_rows(i).drop("tree_key")


@query("row_links", """
SELECT l.repo, a."row" AS row_a, b."row" AS row_b, CAST(count(*) AS BIGINT) AS links FROM v_all_links l JOIN v_rows a ON a.repo = l.repo AND a.id = l."from"
JOIN v_rows b ON b.repo = l.repo AND b.id = l.target_id WHERE l.target_kind = 'item' AND a."row" <> b."row" GROUP BY ALL""")
def _(i):
    return assemble.row_links(i.v_all_links, folded_rows(i)).drop("tree_key")


# ---------------------------------------------------------------- lints

VIEWS["v_plain"] = """SELECT repo, id, area, side, kind FROM v_placed WHERE cfg IS NULL OR cfg NOT LIKE '%test,%'"""
VIEWS["v_impl_counts"] = """
SELECT l.repo, l.target_id AS trait, CAST(count(DISTINCT CASE WHEN i.cfg IS NULL OR i.cfg NOT LIKE '%test,%' THEN l."from" END) AS BIGINT) AS implementors,
  CAST(count(DISTINCT CASE WHEN i.cfg LIKE '%test,%' THEN l."from" END) AS BIGINT) AS test_implementors
FROM v_all_links l JOIN v_items i ON i.repo = l.repo AND i.id = l."from" WHERE l.kind = 'implements' AND l.target_kind = 'item' GROUP BY ALL"""
VIEWS["v_port_traits"] = """
SELECT DISTINCT t.repo, t.id AS trait FROM v_plain t JOIN v_all_links l ON l.repo = t.repo AND l.target_id = t.id AND l.kind = 'implements' AND l.target_kind = 'item'
JOIN v_plain f ON f.repo = l.repo AND f.id = l."from" AND f.side IN ('driving', 'driven') WHERE t.kind = 'trait' AND t.side = 'domain'"""


def placed_ids(i):
    return placement.place_items(i.v_items, i.v_areas).select(*KEYS, "id", "area", "side")


@query("area_lines", """
SELECT x.repo, p.area, CAST(count(*) AS BIGINT) AS lines FROM (SELECT DISTINCT repo, file, unnest(range(line, end_line + 1)) AS n FROM v_items
  WHERE cfg IS NULL OR cfg NOT LIKE '%test,%') x LEFT JOIN (SELECT DISTINCT repo, file, area FROM v_placed) p ON p.repo = x.repo AND p.file = x.file GROUP BY ALL""")
def _(i):
    return lints.area_lines(i.v_items, placement.place_files(i.v_items, i.v_areas)).drop("tree_key")


@query("god_module", """
WITH spans AS (SELECT x.repo, p.area FROM (SELECT DISTINCT repo, file, unnest(range(line, end_line + 1)) AS n FROM v_items
  WHERE cfg IS NULL OR cfg NOT LIKE '%test,%') x LEFT JOIN (SELECT DISTINCT repo, file, area FROM v_placed) p ON p.repo = x.repo AND p.file = x.file),
t AS (SELECT repo, count(*) AS n FROM spans GROUP BY repo)
SELECT s.repo, s.area, CAST(count(*) AS BIGINT) AS lines, CAST(any_value(t.n) AS BIGINT) AS unit_lines FROM spans s JOIN t ON t.repo = s.repo
WHERE s.area IS NOT NULL GROUP BY s.repo, s.area HAVING count(*) > any_value(t.n) * 0.1""")
def _(i):
    # A tenth instead of four tenths: no area of these repos is that large.
    return lints.god_module(i.v_items, placement.place_files(i.v_items, i.v_areas), i.v_areas, share=0.1).drop("tree_key")


VIEWS["v_cycle_links"] = """
SELECT l.repo, a.area AS from_area, b.area AS target_area, l.line FROM v_all_links l JOIN v_plain a ON a.repo = l.repo AND a.id = l."from"
JOIN v_placed b ON b.repo = l.repo AND b.id = l.target_id WHERE l.target_kind = 'item' AND l.kind <> 'tests' AND a.area <> b.area"""


@query("area_cycle", """
WITH RECURSIVE e AS (SELECT repo, from_area AS f, target_area AS t, CAST(count(*) AS BIGINT) AS links, CAST(count(*) FILTER (WHERE line % 3 = 0) AS BIGINT) AS bad FROM v_cycle_links GROUP BY ALL),
r AS (SELECT repo, f, t FROM e UNION SELECT r.repo, r.f, e.t FROM r JOIN e ON e.repo = r.repo AND e.f = r.t),
s AS (SELECT a.repo, a.f AS area, least(min(a.t), a.f) AS cyc FROM r a JOIN r b ON b.repo = a.repo AND b.f = a.t AND b.t = a.f WHERE a.f <> a.t GROUP BY a.repo, a.f),
g AS (SELECT repo, cyc, string_agg(area, ',' ORDER BY area) AS areas, count(*) AS n FROM s GROUP BY repo, cyc),
x AS (SELECT e.repo, a.cyc, g.areas, g.n, e.f, e.t, e.links, e.bad FROM e JOIN s a ON a.repo = e.repo AND a.area = e.f JOIN s b ON b.repo = e.repo AND b.area = e.t AND b.cyc = a.cyc JOIN g ON g.repo = e.repo AND g.cyc = a.cyc),
w AS (SELECT repo, cyc, area, sum(d) AS d FROM (SELECT repo, cyc, f AS area, -links AS d FROM x UNION ALL SELECT repo, cyc, t, links FROM x) y GROUP BY ALL),
z AS (SELECT x.*, row_number() OVER (PARTITION BY x.repo, x.cyc ORDER BY x.links, -x.bad, x.f) AS rn, (wf.d > wt.d OR (wf.d = wt.d AND wf.area > wt.area)) AS against
  FROM x JOIN w wf ON wf.repo = x.repo AND wf.cyc = x.cyc AND wf.area = x.f JOIN w wt ON wt.repo = x.repo AND wt.cyc = x.cyc AND wt.area = x.t)
SELECT repo, cyc AS "cycle", areas, f AS from_area, t AS target_area, links, bad AS forbidden, n = 2 AS cut_exact FROM z WHERE CASE WHEN n = 2 THEN rn = 1 ELSE against END""")
def _(i):
    linked = rules.rule_links(i.v_items, i.v_all_links, i.v_externals, i.v_ports, i.v_areas)
    return lints.area_cycles(linked, c("line") % 3 == 0).withColumn("areas", F.array_join("areas", ",")).drop("tree_key")


@query("leaky_port", """
SELECT DISTINCT l.repo, p.trait, l."from", l.target_id, l.file, l.line FROM v_all_links l JOIN v_port_traits p ON p.repo = l.repo AND p.trait = l."from"
JOIN v_placed a ON a.repo = l.repo AND a.id = l.target_id AND a.side IN ('driving', 'driven') WHERE l.kind = 'uses-type' AND l.target_kind = 'item'""")
def _(i):
    return lints.leaky_port(i.v_items, i.v_all_links, placed_ids(i)).drop("tree_key")


@query("speculative_abstraction", """
SELECT t.repo, t.id AS trait, p.trait IS NOT NULL AS is_port, n.test_implementors FROM v_items t JOIN v_impl_counts n ON n.repo = t.repo AND n.trait = t.id
LEFT JOIN v_port_traits p ON p.repo = t.repo AND p.trait = t.id
WHERE t.kind = 'trait' AND (t.cfg IS NULL OR t.cfg NOT LIKE '%test,%') AND n.implementors = 1 AND (p.trait IS NULL OR n.test_implementors = 0)""")
def _(i):
    return lints.speculative_abstraction(i.v_items, i.v_all_links, placed_ids(i)).drop("tree_key")


@query("unresolved_dyn", """
SELECT DISTINCT l.repo, l.target_id AS port, coalesce(n.implementors, 0) AS implementors, l.file, l.line FROM v_all_links l
JOIN v_items t ON t.repo = l.repo AND t.id = l.target_id AND t.kind = 'trait' AND (t.cfg IS NULL OR t.cfg NOT LIKE '%test,%')
JOIN v_items f ON f.repo = l.repo AND f.id = l."from" AND (f.cfg IS NULL OR f.cfg NOT LIKE '%test,%')
LEFT JOIN v_impl_counts n ON n.repo = l.repo AND n.trait = l.target_id
WHERE l.kind = 'calls-port' AND l.target_kind = 'item' AND coalesce(n.implementors, 0) <> 1
  AND NOT EXISTS (SELECT 1 FROM v_all_links w WHERE w.repo = l.repo AND w.target_id = l.target_id AND w.kind = 'wires' AND w.target_kind = 'item')""")
def _(i):
    return lints.unresolved_dyn(i.v_items, i.v_all_links, placed_ids(i)).drop("tree_key")
