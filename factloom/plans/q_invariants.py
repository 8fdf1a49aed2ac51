"""The invariant checks, each on view rows with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import fixed
from factloom.operators import invariants as V
from factloom.operators import lints
from factloom.operators.ordered import KEYS
from factloom.plans.catalog import Inputs, query
from factloom.plans.views import VIEWS

c = F.col

SIDE = "CASE WHEN top = 'supp' THEN 'driving' WHEN top IN ('standard', 'promo', 'economy') THEN 'domain' WHEN top = 'cust' THEN 'internals' ELSE 'driven' END"
VIEWS["v_inv_items"] = f"""
SELECT repo, tree_key, id, crate AS krate, CASE WHEN pos % 23 = 0 THEN 'driven' WHEN pos % 211 = 0 THEN 'externals' WHEN pos % 17 = 0 THEN NULL ELSE {SIDE} END AS "column",
  CASE WHEN pos % 19 = 0 THEN NULL WHEN pos % 401 = 0 THEN 'lost' ELSE top END AS area, visibility = 'pub' OR reexported OR entry AS public,
  'h' || CAST(pos AS STRING) AS content_hash, pos FROM v_items
UNION ALL SELECT r.repo, r.tree_key, 'ext:' || CAST(s_suppkey AS STRING), 'x', CASE WHEN s_suppkey % 2 = 0 THEN 'driven' END, NULL, true, 'e', s_suppkey FROM supplier JOIN v_repos r ON true"""
VIEWS["v_inv_areas"] = f"""
SELECT DISTINCT repo, tree_key, top AS id, CASE WHEN repo = 'beta' AND top = 'small' THEN 'nowhere' ELSE {SIDE} END AS side, length(top) % 2 = 0 OR top = 'large' AS folded FROM v_items"""
VIEWS["v_inv_links"] = """
SELECT repo, tree_key, "from" || ' -' || kind || coalesce('.' || member, '') || '-> ' || target_id || '@' || CAST(line AS STRING) || confidence AS id, "from", target_id AS "to", kind, confidence,
  CASE WHEN line % 11 = 0 THEN 'no path' END AS unresolved, line FROM v_all_links WHERE target_kind = 'item'"""
VIEWS["v_inv_findings"] = """
SELECT repo, tree_key, 'f ' || id AS id, CASE WHEN line % 2 = 0 THEN 'direction' ELSE 'domain must not depend-on driven' END AS rule, id AS link,
  CASE WHEN line % 3 = 0 THEN 'block' ELSE 'warn' END AS level, line % 4 = 0 AS gates_merge, CASE WHEN line % 50 = 0 THEN 'plugin' ELSE 'core' END AS origin FROM v_inv_links"""
VIEWS["v_inv_chips"] = """
SELECT repo, tree_key, a AS "from", b AS "to", n + CASE WHEN length(b) = 4 THEN 1 ELSE 0 END AS "count", length(a) % 3 <> 0 AS badged FROM (
  SELECT l.repo, l.tree_key, x.area AS a, y.area AS b, count(*) AS n FROM v_inv_links l JOIN v_inv_items x ON x.repo = l.repo AND x.id = l."from"
  JOIN v_inv_items y ON y.repo = l.repo AND y.id = l."to" WHERE l.unresolved IS NULL AND x.area <> y.area GROUP BY l.repo, l.tree_key, x.area, y.area) z WHERE a <> 'promo' OR b <> 'economy'
UNION ALL SELECT repo, tree_key, 'medium', 'large', 3, true FROM v_repos UNION ALL SELECT repo, tree_key, 'cust', 'supp', 3, true FROM v_repos"""
VIEWS["v_inv_pills"] = """
SELECT repo, tree_key, "from" AS item, 'unresolved' AS kind, count(*) + CASE WHEN min(line) % 3 = 0 THEN 1 ELSE 0 END AS "count" FROM v_inv_links WHERE unresolved IS NOT NULL GROUP BY repo, tree_key, "from" HAVING min(line) % 7 <> 0
UNION ALL SELECT repo, tree_key, id, 'unresolved', 2 FROM v_inv_items WHERE pos % 31 = 0"""
VIEWS["v_positions"] = """
SELECT i.repo, i.tree_key, i.id AS item, p.p_retailprice AS x, CAST(p.p_size AS DOUBLE) AS y, i.pos FROM v_parts i JOIN part p ON p.p_partkey = i.pos WHERE i.pos % 59 <> 0"""
VIEWS["v_base_positions"] = """
SELECT i.repo, i.tree_key, i.id AS item, CASE WHEN i.pos % 29 = 0 THEN p.p_retailprice + 1 ELSE p.p_retailprice END AS x, CAST(p.p_size AS DOUBLE) AS y FROM v_parts i JOIN part p ON p.p_partkey = i.pos WHERE i.pos % 61 <> 0"""
VIEWS["v_old_items"] = """SELECT repo, tree_key, id, CASE WHEN pos % 4 = 0 THEN 'old' ELSE 'h' || CAST(pos AS STRING) END AS content_hash FROM v_items"""
VIEWS["v_with_overlays"] = """
SELECT repo, tree_key, item, CASE WHEN pos % 37 = 0 THEN x + 2 ELSE x END AS x, y FROM v_positions WHERE repo = 'alpha' OR pos % 41 <> 0
UNION ALL SELECT repo, tree_key, 'new ' || item, x, y FROM v_positions WHERE pos % 67 = 0"""
VIEWS["v_without_rails"] = """SELECT repo, tree_key, item, x, CASE WHEN pos % 43 = 0 THEN y + 1 ELSE y END AS y FROM v_positions"""
VIEWS["v_overlays"] = """
SELECT CASE WHEN event_id % 3 = 0 THEN 'beta' ELSE 'alpha' END AS repo, CASE WHEN event_id % 3 = 0 THEN 'commit:beta' ELSE 'commit:alpha' END AS tree_key, 'u' || CAST(event_id AS STRING) AS item,
  CASE event_type WHEN 'view' THEN 'sessions' WHEN 'click' THEN 'plan' WHEN 'purchase' THEN 'findings' ELSE 'delta' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 'outline' WHEN 1 THEN 'fade' ELSE 'fill' END AS channel, event_id % 25 = 0 AS has_geometry FROM events"""
VIEWS["v_fold"] = """
SELECT 'w' || CAST(user_id AS STRING) AS repo, 'commit:w' AS tree_key, event_id AS pos, event_id % 160 AS visible_items, 1 - CAST(event_id % 50 AS DOUBLE) / 100 AS scale, event_id % 2 = 0 AS areas_folded,
  CAST(CASE WHEN event_id % 30 = 0 THEN 13.5 ELSE 12 END AS DOUBLE) AS label_px FROM events"""
VIEWS["v_inv_ports"] = """
SELECT r.repo, r.tree_key, 'port:' || CAST(p_partkey AS STRING) AS id, CASE p_partkey % 12 WHEN 0 THEN 'rpc' WHEN 1 THEN 'http' WHEN 2 THEN 'cli' WHEN 3 THEN 'topic' WHEN 4 THEN 'crate' WHEN 5 THEN 'sql'
  WHEN 6 THEN 'pub' WHEN 7 THEN 'redis' WHEN 8 THEN 'fs' WHEN 9 THEN 'tty' WHEN 10 THEN 'declared' ELSE 'smoke' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'driving' ELSE 'driven' END AS side,
  CASE p_size % 7 WHEN 0 THEN 'platform-services' WHEN 1 THEN 'third-party' WHEN 2 THEN 'events' WHEN 3 THEN 'data-stores' WHEN 4 THEN 'os' WHEN 5 THEN 'libraries' ELSE 'unresolved' END AS section,
  CASE WHEN p_partkey % 13 <> 0 THEN 'ext:' || CAST(p_partkey % 50 AS STRING) END AS external, p_partkey AS pos FROM part JOIN v_repos r ON true"""
VIEWS["v_inv_externals"] = """SELECT DISTINCT r.repo, r.tree_key, 'ext:' || CAST(p_partkey % 47 + CASE WHEN p_partkey % 9 = 0 THEN 20 ELSE 0 END AS STRING) AS id FROM part JOIN v_repos r ON true"""
VIEWS["v_rail_edges"] = """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'beta' ELSE 'alpha' END AS repo, CASE WHEN o_orderkey % 3 = 0 THEN 'commit:beta' ELSE 'commit:alpha' END AS tree_key, 'o' || CAST(o_orderkey AS STRING) AS "from",
  'ext:' || CAST(o_orderkey % 50 AS STRING) AS external, CASE WHEN o_orderkey % 10 <> 0 THEN 'port:' || CAST(o_orderkey % 100 AS STRING) END AS port FROM orders"""
VIEWS["v_inv_reach"] = """
SELECT repo, tree_key, node AS focus, node FROM v_call_starts
UNION SELECT s.repo, s.tree_key, s.node, c."to" FROM v_call_starts s JOIN v_calls c ON c.repo = s.repo AND c."from" = s.node
UNION SELECT s.repo, s.tree_key, s.node, i.id FROM v_call_starts s JOIN v_items i ON i.repo = s.repo AND i.crate = 'supp' AND i.pos % 97 = length(s.node) % 97
UNION SELECT repo, tree_key, 'ghost ' || node, node FROM v_call_starts"""
VIEWS["v_reach_links"] = """SELECT repo, tree_key, "from", "to", CASE WHEN length("from") % 5 = 4 THEN 'lost' END AS unresolved FROM v_calls"""
VIEWS["v_many_units"] = """
SELECT repo, tree_key, CASE num % 3 WHEN 0 THEN 'hexagon' ELSE 'layers' END AS rule, CASE num % 5 WHEN 1 THEN 'hexagon' WHEN 2 THEN 'layers' END AS rule_override, max(CASE WHEN k = num % 30 THEN 1 ELSE 0 END) = 1 AS has_entry
FROM v_pkgs GROUP BY repo, tree_key, num"""


def units(i: Inputs):
    columns = F.array(*[F.lit(s) for s in ("driving", "domain", "driven")])
    layers = F.array(*[F.lit(s) for s in ("driven", "domain", "driving")])
    hexagon = c("repo") == "alpha"
    return i.v_repos.select(*KEYS, F.when(hexagon, "hexagon").otherwise("layers").alias("rule"), F.when(hexagon, columns).otherwise(layers).alias("columns"))


def violations(df):
    return df.select("repo", "invariant", "message")


def num(sql: str) -> str:
    return f"regexp_replace(CAST({sql} AS STRING), '[.]0$', '')"


def moved_sql(invariant: str, what: str, with_it: str, plain: str) -> str:
    return f"""
SELECT w.repo, '{invariant}' AS invariant, CASE WHEN p.item IS NULL THEN w.item || ' appears only with {what}'
  ELSE w.item || ' is at (' || {num('w.x')} || ', ' || {num('w.y')} || ') with {what} but (' || {num('p.x')} || ', ' || {num('p.y')} || ') without' END AS message
FROM {with_it} w LEFT JOIN {plain} p ON p.repo = w.repo AND p.item = w.item WHERE p.item IS NULL OR p.x <> w.x OR p.y <> w.y
UNION ALL SELECT r.repo, '{invariant}', CAST(a.n AS STRING) || ' positions with {what}, ' || CAST(b.n AS STRING) || ' without' FROM v_repos r
JOIN (SELECT repo, count(*) AS n FROM {with_it} GROUP BY repo) a ON a.repo = r.repo JOIN (SELECT repo, count(*) AS n FROM {plain} GROUP BY repo) b ON b.repo = r.repo WHERE a.n <> b.n"""


def _none(sql: str) -> str:
    return f"coalesce(CAST({sql} AS STRING), 'none')"


CHECKS: dict[str, str] = {}

CHECKS["positions_stable"] = f"""
SELECT i.repo, 'MAP-1' AS invariant, CASE WHEN p.item IS NULL THEN i.id || ' lost its position with unchanged facts'
  ELSE i.id || ' moved from (' || {num('b.x')} || ', ' || {num('b.y')} || ') to (' || {num('p.x')} || ', ' || {num('p.y')} || ') with unchanged facts' END AS message
FROM v_inv_items i JOIN v_old_items o ON o.repo = i.repo AND o.id = i.id AND o.content_hash = i.content_hash JOIN v_base_positions b ON b.repo = i.repo AND b.item = i.id
LEFT JOIN v_positions p ON p.repo = i.repo AND p.item = i.id WHERE p.item IS NULL OR p.x <> b.x OR p.y <> b.y"""


@query("positions_stable", CHECKS["positions_stable"])
def _(i):
    return violations(V.positions_stable(i.v_inv_items, i.v_positions, i.v_old_items, i.v_base_positions))


CHECKS["no_state_relayout"] = moved_sql("MAP-3", "overlays", "v_with_overlays", "v_positions") + """
UNION ALL SELECT repo, 'MAP-3', kind || ' overlay row on ' || item || ' carries geometry' FROM v_overlays WHERE has_geometry"""


@query("no_state_relayout", CHECKS["no_state_relayout"])
def _(i):
    return violations(V.no_state_relayout(i.v_with_overlays, i.v_positions, i.v_overlays))


CHECKS["fold_floor"] = f"""
SELECT f.repo, 'MAP-4' AS invariant, 'fold state ' || CAST(f.pos AS STRING) || m.message AS message FROM (SELECT *, first_value(scale) OVER w AS os, first_value(label_px) OVER w AS ol FROM v_fold WINDOW w AS (PARTITION BY repo ORDER BY pos)) f
JOIN LATERAL (SELECT ' changes label size ' || {num('f.ol')} || ' → ' || {num('f.label_px')} AS message WHERE f.label_px <> f.ol
  UNION ALL SELECT ' scale ' || {num('f.scale')} || ' is below the floor 0.7 × ' || {num('f.os')} WHERE f.scale < CAST(0.7 AS DOUBLE) * f.os
  UNION ALL SELECT ' shows ' || CAST(f.visible_items AS STRING) || ' items with areas unfolded' WHERE f.visible_items > 80 AND NOT f.areas_folded) m ON true"""


@query("fold_floor", CHECKS["fold_floor"])
def _(i):
    return violations(V.fold_floor(i.v_fold))


CHECKS["overlay_stacking"] = """
SELECT repo, 'MAP-14' AS invariant, kind || ' overlay on ' || item || ' uses ' || channel || ', expected ' || e AS message FROM (
  SELECT *, CASE kind WHEN 'sessions' THEN 'outline' WHEN 'delta' THEN 'fade' ELSE 'fill' END AS e FROM v_overlays) x WHERE channel <> e"""


@query("overlay_stacking", CHECKS["overlay_stacking"])
def _(i):
    return violations(V.overlay_stacking(i.v_overlays))


CHECKS["unresolved_one_pill"] = """
SELECT repo, 'MAP-16' AS invariant, CASE WHEN n = 0 THEN id || ' has an unresolved pill but no unresolved links'
  WHEN k = 1 THEN id || ' pill says ' || CAST(says AS STRING) || ' unresolved, facts say ' || CAST(n AS STRING) ELSE id || ' has ' || CAST(k AS STRING) || ' unresolved pills, expected one' END AS message
FROM (SELECT i.repo, i.id, coalesce(u.n, 0) AS n, coalesce(p.k, 0) AS k, p.says FROM v_inv_items i
  LEFT JOIN (SELECT repo, "from" AS id, count(*) AS n FROM v_inv_links WHERE unresolved IS NOT NULL GROUP BY ALL) u ON u.repo = i.repo AND u.id = i.id
  LEFT JOIN (SELECT repo, item AS id, count(*) AS k, max("count") AS says FROM v_inv_pills GROUP BY ALL) p ON p.repo = i.repo AND p.id = i.id) x
WHERE (n = 0 AND k > 0) OR (n > 0 AND (k <> 1 OR says <> n))"""


@query("unresolved_one_pill", CHECKS["unresolved_one_pill"])
def _(i):
    return violations(V.unresolved_one_pill(i.v_inv_items, i.v_inv_links, i.v_inv_pills))


CHECKS["cross_unit_public"] = """
SELECT l.repo, 'MAP-30' AS invariant, 'link ' || l.id || ' crosses ' || a.krate || ' → ' || b.krate || ' onto non-public ' || b.id AS message
FROM v_inv_links l JOIN v_inv_items a ON a.repo = l.repo AND a.id = l."from" JOIN v_inv_items b ON b.repo = l.repo AND b.id = l."to" WHERE l.unresolved IS NULL AND a.krate <> b.krate AND NOT b.public"""


@query("cross_unit_public", CHECKS["cross_unit_public"])
def _(i):
    return violations(V.cross_unit_public(i.v_inv_items, i.v_inv_links))


VIEWS["v_directed"] = """
SELECT l.*, a."column" AS from_column, b."column" AS to_column FROM v_inv_links l JOIN v_inv_items a ON a.repo = l.repo AND a.id = l."from" AND a."column" IS NOT NULL
JOIN v_inv_items b ON b.repo = l.repo AND b.id = l."to" AND b."column" IS NOT NULL WHERE l.unresolved IS NULL AND l.kind IN ('calls', 'calls-out', 'hands-off', 'listens-to', 'routes')"""
VIEWS["v_smells"] = """
SELECT d.*, CASE WHEN repo = 'alpha' THEN 'hexagon' ELSE 'layers' END AS rule FROM v_directed d WHERE from_column IN ('driving', 'domain', 'driven') AND to_column IN ('driving', 'domain', 'driven') AND
CASE WHEN repo = 'alpha' THEN from_column <> to_column AND NOT (to_column = 'domain' AND from_column IN ('driving', 'driven'))
  ELSE CASE to_column WHEN 'driven' THEN 1 WHEN 'domain' THEN 2 ELSE 3 END < CASE from_column WHEN 'driven' THEN 1 WHEN 'domain' THEN 2 ELSE 3 END END"""


@query("direction_links", "SELECT repo, id, from_column, to_column FROM v_directed")
def _(i):
    return lints.directed_links(i.v_inv_links, i.v_inv_items).select("repo", "id", "from_column", "to_column")


@query("direction_smell", "SELECT repo, id, from_column, to_column, rule FROM v_smells")
def _(i):
    return lints.direction_smells(i.v_inv_links, i.v_inv_items, units(i)).select("repo", "id", "from_column", "to_column", "rule")


CHECKS["direction_marked"] = """
SELECT repo, 'MAP-17' AS invariant, kind || ' link ' || id || ' goes ' || from_column || ' → ' || to_column || ', against the ' || rule || ' grain, and no direction finding marks it' AS message
FROM v_smells s WHERE NOT EXISTS (SELECT 1 FROM v_inv_findings f WHERE f.repo = s.repo AND f.link = s.id AND f.rule = 'direction')"""


@query("direction_marked", CHECKS["direction_marked"])
def _(i):
    return violations(V.direction_marked(i.v_inv_items, i.v_inv_links, units(i), i.v_inv_findings))


CHECKS["columns_are_sides"] = f"""
SELECT repo, 'MAP-2' AS invariant, 'area ' || id || ' has side ' || side || ', not a column under ' || CASE WHEN repo = 'alpha' THEN 'hexagon' ELSE 'layers' END AS message FROM v_inv_areas
WHERE side NOT IN ('driving', 'domain', 'driven')
UNION ALL SELECT i.repo, 'MAP-2', CASE WHEN a.id IS NULL THEN i.id || ' is in unknown area ' || i.area
  ELSE i.id || ' sits in column ' || {_none('i."column"')} || ' but its area ' || a.id || ' is on side ' || a.side END
FROM v_inv_items i LEFT JOIN v_inv_areas a ON a.repo = i.repo AND a.id = i.area WHERE i.area IS NOT NULL AND (a.id IS NULL OR i."column" IS DISTINCT FROM a.side)"""


@query("columns_are_sides", CHECKS["columns_are_sides"])
def _(i):
    return violations(V.columns_are_sides(i.v_inv_items, i.v_inv_areas, units(i)))


CHECKS["folded_link_counts"] = """
SELECT * FROM (WITH e AS (SELECT l.repo, x.area AS a, y.area AS b, count(*) AS n, bool_or(f.link IS NOT NULL) AS badge FROM v_inv_links l
  JOIN v_inv_items x ON x.repo = l.repo AND x.id = l."from" JOIN v_inv_items y ON y.repo = l.repo AND y.id = l."to"
  JOIN v_inv_areas ax ON ax.repo = l.repo AND ax.id = x.area AND ax.folded JOIN v_inv_areas ay ON ay.repo = l.repo AND ay.id = y.area AND ay.folded
  LEFT JOIN (SELECT DISTINCT repo, link FROM v_inv_findings) f ON f.repo = l.repo AND f.link = l.id WHERE l.unresolved IS NULL AND x.area <> y.area GROUP BY ALL),
d AS (SELECT repo, "from" AS a, "to" AS b, count(*) AS k, max("count") AS says, bool_or(badged) AS badged FROM v_inv_chips GROUP BY ALL)
SELECT coalesce(e.repo, d.repo) AS repo, 'MAP-7' AS invariant, CASE WHEN e.n IS NULL THEN 'chip link ' || d.a || ' → ' || d.b || ' folds no item link between folded areas'
  WHEN d.k IS NULL THEN 'chips ' || e.a || ' → ' || e.b || ' fold ' || CAST(e.n AS STRING) || ' links but no chip link is drawn'
  WHEN d.k > 1 THEN CAST(d.k AS STRING) || ' chip links drawn ' || e.a || ' → ' || e.b || ', expected one'
  WHEN d.says <> e.n THEN 'chip link ' || e.a || ' → ' || e.b || ' says ' || CAST(d.says AS STRING) || ', it folds ' || CAST(e.n AS STRING) || ' links'
  WHEN d.badged <> e.badge THEN 'chip link ' || e.a || ' → ' || e.b || ' badge is ' || CAST(d.badged AS STRING) || ', findings on its links say ' || CAST(e.badge AS STRING) END AS message
FROM e FULL JOIN d ON d.repo = e.repo AND d.a = e.a AND d.b = e.b) z WHERE message IS NOT NULL"""


@query("folded_link_counts", CHECKS["folded_link_counts"])
def _(i):
    i.keep("v_inv_links")
    return violations(V.folded_link_counts(i.v_inv_items, i.v_inv_links, i.v_inv_areas, i.v_inv_findings, i.v_inv_chips))


VIEWS["v_reach_diff"] = """
SELECT * FROM (WITH e AS (SELECT repo, "from" AS a, "to" AS b FROM v_reach_links WHERE unresolved IS NULL UNION SELECT repo, "to", "from" FROM v_reach_links WHERE unresolved IS NULL),
h0 AS (SELECT repo, node AS focus, node FROM v_call_starts), h1 AS (SELECT h.repo, h.focus, e.b AS node FROM h0 h JOIN e ON e.repo = h.repo AND e.a = h.node),
h2 AS (SELECT h.repo, h.focus, e.b AS node FROM h1 h JOIN e ON e.repo = h.repo AND e.a = h.node),
want AS (SELECT * FROM h0 UNION SELECT * FROM h1 UNION SELECT * FROM h2),
got AS (SELECT repo, focus, node FROM v_inv_reach WHERE focus NOT LIKE 'ghost %')
SELECT repo, focus, node, 'missing' AS side FROM (SELECT * FROM want EXCEPT SELECT * FROM got) x UNION ALL SELECT repo, focus, node, 'extra' FROM (SELECT * FROM got EXCEPT SELECT * FROM want) y) z"""
CHECKS["reach_depth"] = """
SELECT repo, 'MAP-11' AS invariant, CASE WHEN side = 'missing' THEN node || ' is within 2 hops of ' || focus || ' but outside the Reach set' ELSE node || ' is in the Reach set but more than 2 hops from ' || focus END AS message FROM v_reach_diff
UNION ALL SELECT DISTINCT repo, 'MAP-11', 'Reach focus ' || focus || ' is not an item' FROM v_inv_reach WHERE focus LIKE 'ghost %'"""


@query("reach_depth", CHECKS["reach_depth"])
def _(i):
    return violations(V.reach_depth(i.v_inv_items, i.v_reach_links, i.v_inv_reach, 2))


@query("reach_difference", "SELECT repo, focus, node, side FROM v_reach_diff")
def _(i):
    from factloom.operators import graph

    edges = i.v_reach_links.filter(c("unresolved").isNull())
    expected = graph.reach(edges, i.v_call_starts.withColumnRenamed("node", "focus"), 2)
    shown = i.v_inv_reach.filter(~c("focus").startswith("ghost "))
    return V.reach_difference(expected, shown, [*KEYS, "focus"]).drop("tree_key")


CHECKS["column_rule_from_entry"] = """
SELECT repo, 'MAP-26' AS invariant, 'unit rule is ' || rule || ', ' || CASE WHEN rule_override IS NOT NULL THEN 'the override' ELSE 'has_entry = ' || CAST(has_entry AS STRING) END || ' says ' || e AS message FROM (
  SELECT *, coalesce(rule_override, CASE WHEN has_entry THEN 'hexagon' ELSE 'layers' END) AS e FROM v_many_units) x WHERE rule <> e"""


@query("column_rule_from_entry", CHECKS["column_rule_from_entry"])
def _(i):
    return violations(V.column_rule_from_entry(i.v_many_units))


SECTION_RANK = "CASE section " + " ".join(f"WHEN '{s}' THEN {n}" for n, s in enumerate(fixed.SECTIONS)) + " END"
VIEWS["v_section_inversions"] = f"""
SELECT repo, side, id, section, after_id, after_section FROM (SELECT *, {SECTION_RANK} AS r, lag({SECTION_RANK}) OVER w AS pr, lag(id) OVER w AS after_id, lag(section) OVER w AS after_section
  FROM v_inv_ports WINDOW w AS (PARTITION BY repo, side ORDER BY pos)) x WHERE r < pr"""


@query("section_inversions", 'SELECT repo, side, id, section, after_id AS "after", after_section FROM v_section_inversions')
def _(i):
    return V.section_inversions(i.v_inv_ports, chunk=100).drop("tree_key")


CHECKS["externals_on_rails"] = f"""
SELECT repo, 'MAP-31' AS invariant, 'port ' || id || ' has kind ' || kind || ', not a known one' AS message FROM v_inv_ports WHERE kind IN ('declared', 'smoke')
UNION ALL SELECT repo, 'MAP-31', 'external ' || id || ' is not a port' FROM v_inv_externals e WHERE NOT EXISTS (SELECT 1 FROM v_inv_ports p WHERE p.repo = e.repo AND p.external = e.id)
UNION ALL SELECT repo, 'MAP-31', side || ' rail puts ' || id || ' (' || section || ') after ' || after_id || ' (' || after_section || ')' FROM v_section_inversions
UNION ALL SELECT repo, 'MAP-31', id || ' sits in the rail column externals' FROM v_inv_items WHERE "column" = 'externals'
UNION ALL SELECT repo, 'MAP-31', 'external ' || id || ' is placed in column ' || "column" FROM v_inv_items i WHERE "column" <> 'externals' AND EXISTS (SELECT 1 FROM v_inv_externals e WHERE e.repo = i.repo AND e.id = i.id)"""


@query("externals_on_rails", CHECKS["externals_on_rails"])
def _(i):
    return violations(V.externals_on_rails(i.v_inv_ports, i.v_inv_externals, i.v_inv_items))


CHECKS["rail_docking"] = moved_sql("MAP-32", "rails", "v_positions", "v_without_rails")


@query("rail_docking", CHECKS["rail_docking"])
def _(i):
    return violations(V.rail_docking(i.v_positions, i.v_without_rails))


CHECKS["ports_from_facts"] = f"""
SELECT p.repo, 'CANVAS-2' AS invariant, CASE WHEN p.external IS NULL THEN 'port ' || p.id || ' has no witness external' ELSE 'port ' || p.id || ' names external ' || p.external || ', absent from the facts' END AS message
FROM v_inv_ports p LEFT JOIN v_inv_externals e ON e.repo = p.repo AND e.id = p.external WHERE e.id IS NULL
UNION ALL SELECT e.repo, 'CANVAS-2', 'edge ' || e."from" || ' → ' || e.external || ' ends on ' || {_none('e.port')} || ', not on that external''s port'
FROM v_rail_edges e LEFT JOIN v_inv_ports p ON p.repo = e.repo AND p.id = e.port WHERE p.external IS DISTINCT FROM e.external"""


@query("ports_from_facts", CHECKS["ports_from_facts"])
def _(i):
    return violations(V.ports_from_facts(i.v_inv_ports, i.v_inv_externals, i.v_rail_edges))


CHECKS["finding_confidence"] = """
SELECT f.repo, 'ADR-9' AS invariant, CASE WHEN l.confidence = 'guessed' THEN 'finding ' || f.id || ' on guessed link ' || l.id || ' blocks or gates' ELSE 'finding ' || f.id || ' on declared link ' || l.id || ' gates a merge' END AS message
FROM v_inv_findings f JOIN v_inv_links l ON l.repo = f.repo AND l.id = f.link WHERE (l.confidence = 'guessed' AND (f.level = 'block' OR f.gates_merge)) OR (l.confidence = 'declared' AND f.gates_merge)"""


@query("finding_confidence", CHECKS["finding_confidence"])
def _(i):
    i.keep("v_inv_links")
    return violations(V.finding_confidence(i.v_inv_findings, i.v_inv_links))


CHECKS["origin_is_core"] = """
SELECT repo, 'ORIGIN' AS invariant, 'finding ' || id || ' has origin ' || origin AS message FROM v_inv_findings WHERE origin <> 'core'"""


@query("origin_is_core", CHECKS["origin_is_core"])
def _(i):
    return violations(V.origin_is_core(i.v_inv_findings))


ALL = [
    "positions_stable", "columns_are_sides", "no_state_relayout", "folded_link_counts", "overlay_stacking", "unresolved_one_pill", "direction_marked", "cross_unit_public", "externals_on_rails",
    "rail_docking", "ports_from_facts", "finding_confidence", "origin_is_core", "fold_floor", "reach_depth", "column_rule_from_entry",
]


@query("check_all", """
SELECT repo, invariant, CAST(count(*) AS BIGINT) AS violations FROM (""" + " UNION ALL ".join(f"SELECT repo, invariant, message FROM ({CHECKS[n]}) x_{n}" for n in ALL) + ") x GROUP BY ALL")
def _(i):
    i.keep("v_inv_links")
    i.keep("v_calls")
    view = dict(
        items=i.v_inv_items, links=i.v_inv_links, areas=i.v_inv_areas, units=units(i), entry_units=i.v_many_units, fold=i.v_fold, reach=i.v_inv_reach, reach_links=i.v_reach_links,
        base_items=i.v_old_items, base_positions=i.v_base_positions, positions=i.v_positions, with_overlays=i.v_with_overlays, without_rails=i.v_without_rails, overlays=i.v_overlays,
        pills=i.v_inv_pills, findings=i.v_inv_findings, chip_links=i.v_inv_chips, ports=i.v_inv_ports, externals=i.v_inv_externals, rail_edges=i.v_rail_edges,
    )
    return V.check_all(view).groupBy("repo", "invariant").agg(F.count(F.lit(1)).alias("violations"))


@query("load_input", """
SELECT l.repo, l."from" || ' -' || l.kind || coalesce('.' || l.member, '') || '-> ' || l.target_id AS id, l.confidence, b.visibility = 'pub' OR b.reexported OR b.entry AS to_public
FROM v_links l JOIN v_items b ON b.repo = l.repo AND b.id = l.target_id WHERE l.target_kind = 'item'""")
def _(i):
    items, links = V.load_input(i.v_items, i.v_links, i.v_entries)
    far = items.select(*KEYS, c("id").alias("to"), c("public").alias("to_public"))
    return links.join(far, [*KEYS, "to"]).select("repo", "id", "confidence", "to_public")
