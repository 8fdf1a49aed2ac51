"""Placement, dependency rules and what the views say about areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import placement, rules
from factloom.operators.ordered import KEYS
from factloom.plans.catalog import Inputs, query
from factloom.plans.views import VIEWS

# Pieces of the SQL checks.
VIEWS["v_sites"] = """
SELECT repo, tree_key, id, file, kind, crate, module, cfg, visibility, entry, line, pos,
  file || '::' || split_part(substr(id, strpos(id, '::' || module || '::') + length(module) + 4), '#', 1) AS site
FROM v_items"""
VIEWS["v_placed"] = """
SELECT s.*, p.name AS area, p.side AS side FROM v_sites s JOIN (
  SELECT *, row_number() OVER (PARTITION BY repo, file ORDER BY ord) AS rn FROM (
    SELECT DISTINCT f.repo, f.file, a.ord, a.name, a.side
    FROM (SELECT DISTINCT repo, file FROM v_items) f
    JOIN v_area_re a ON a.repo = f.repo AND regexp_matches(f.file, a.re)) y
) p ON p.repo = s.repo AND p.file = s.file AND p.rn = 1"""
VIEWS["v_ended"] = """
SELECT l.*, p.site AS target, p.id AS target_item, p.area AS target_area, p.side AS target_side
FROM v_links l JOIN v_placed p ON l.target_kind = 'item' AND p.repo = l.repo AND p.id = l.target_id
UNION ALL
SELECT l.*, CASE WHEN l.target_kind = 'table' THEN 'table:' || l.target_id ELSE l.target_id END, NULL, 'externals', 'externals'
FROM v_links l WHERE l.target_kind = 'table'
  OR (l.target_kind = 'external' AND EXISTS (SELECT 1 FROM v_externals e WHERE e.repo = l.repo AND e.id = l.target_id
      AND e.kind NOT IN ('crate', 'pub', 'declared')))
  OR (l.target_kind = 'port' AND EXISTS (SELECT 1 FROM v_ports e WHERE e.repo = l.repo AND e.id = l.target_id
      AND e.side = 'driven' AND e.kind NOT IN ('crate', 'pub', 'declared')))"""
VIEWS["v_rule_links"] = """
SELECT e.*, p.area AS from_area, p.side AS from_side, p.site AS site
FROM v_ended e JOIN v_placed p ON p.repo = e.repo AND p.id = e."from"
WHERE e.kind <> 'tests' AND (p.cfg IS NULL OR p.cfg NOT LIKE '%test,%') AND p.area <> e.target_area"""
VIEWS["v_hits"] = """
SELECT * FROM (
  SELECT l.*, r.ord AS rule_ord, r.subject || ' must not depend-on ' || r.target AS rule, 'core' AS origin,
    CASE WHEN l.confidence = 'resolved' THEN r.level ELSE 'warn' END AS level,
    row_number() OVER (PARTITION BY l.repo, l."from", l.target_kind, l.target_id, l.member, l.kind, l.confidence, l.line, r.ord
      ORDER BY r.target_pos) AS rn
  FROM v_rule_links l JOIN v_rule_targets r ON r.repo = l.repo AND r.must_not = 'depend-on'
    AND (r.subject = l.from_area OR r.subject = l.from_side)
    AND (r.target = l.target_area OR r.target = l.target_side)) x WHERE rn = 1"""
VIEWS["v_findings"] = """
SELECT * FROM (
  SELECT h.*, a."by" AS allowed_by, a.reason AS allowed_reason,
    row_number() OVER (PARTITION BY h.repo, h."from", h.target_kind, h.target_id, h.member, h.kind, h.confidence, h.line, h.rule_ord
      ORDER BY a.ord) AS an
  FROM v_hits h LEFT JOIN v_allows a ON a.repo = h.repo AND a.rule = h.rule
    AND (a.site = h.site OR a.site = h."from" OR a.site = h.file || ':' || CAST(h.line AS STRING))
    AND (a.target IS NULL OR a.target = h.target OR a.target = h.target_item OR starts_with(h.target, a.target || '::'))) x
WHERE an = 1"""


def rules_of(i: Inputs):
    return i.v_rule_targets.groupBy("repo", "ord", "subject", "must_not", "level").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("target_pos", "target"))), lambda t: t["target"]).alias("targets")
    )


def linked(i: Inputs):
    return rules.rule_links(i.v_items, i.v_links, i.v_externals, i.v_ports, i.v_areas)


def findings(i: Inputs):
    return rules.check_rules(i.v_items, i.v_links, i.v_externals, i.v_ports, i.v_areas, rules_of(i), i.v_allows)


FINDING = ["repo", "rule", "level", "site", "from", "from_area", "target", "target_area", "kind", "member",
           "confidence", "file", "line", "allowed_by", "allowed_reason"]
FINDING_SQL = ", ".join(f'"{c}"' for c in FINDING)


@query("place_items", "SELECT repo, id, area, side FROM v_placed")
def _(i):
    return placement.place_items(i.v_items, i.v_areas).select("repo", "id", "area", "side")


@query("unplaced_items", """
SELECT repo, id, file FROM v_items i WHERE NOT EXISTS (SELECT 1 FROM v_placed p WHERE p.repo = i.repo AND p.id = i.id)""")
def _(i):
    return placement.unplaced_items(i.v_items, i.v_areas).select("repo", "id", "file")


@query("far_end", """
SELECT repo, "from", target_kind, target_id, member, kind, line, target, target_item, target_area, target_side FROM v_ended""")
def _(i):
    placed = placement.place_files(i.v_items, i.v_areas)
    return rules.far_ends(i.v_links, i.v_items, i.v_externals, i.v_ports, placed).select(
        "repo", "from", "target_kind", "target_id", "member", "kind", "line", "target", "target_item", "target_area",
        "target_side",
    )


@query("rule_links", """
SELECT repo, "from", from_area, from_side, site, kind, member, line, target, target_area, target_side FROM v_rule_links""")
def _(i):
    return linked(i).select(
        "repo", "from", "from_area", "from_side", "site", "kind", "member", "line", "target", "target_area", "target_side"
    )


@query("check_rules", f"SELECT {FINDING_SQL} FROM v_findings")
def _(i):
    return findings(i).select(*FINDING)


@query("cover_allows", """
SELECT repo, rule, site, target, line, kind, allowed_by, allowed_reason FROM v_findings WHERE allowed_by IS NOT NULL""")
def _(i):
    return findings(i).filter(F.col("allowed_by").isNotNull()).select(
        "repo", "rule", "site", "target", "line", "kind", "allowed_by", "allowed_reason"
    )


@query("sort_findings", f"SELECT {FINDING_SQL} FROM v_findings ORDER BY repo, site, target, rule, file, line, kind")
def _(i):
    return rules.sort_findings(findings(i)).select(*FINDING)


@query("summarize_findings", """
SELECT r.repo, CAST(count(f.repo) FILTER (WHERE f.level = 'block' AND f.allowed_by IS NULL) AS BIGINT) AS blocking,
  CAST(count(f.repo) FILTER (WHERE f.level <> 'block' AND f.allowed_by IS NULL) AS BIGINT) AS warnings,
  CAST(count(f.repo) FILTER (WHERE f.allowed_by IS NOT NULL) AS BIGINT) AS allowed,
  CAST(count(f.repo) FILTER (WHERE f.level = 'block' AND f.allowed_by IS NULL) > 0 AS INT) AS exit_code
FROM v_repos r LEFT JOIN v_findings f ON f.repo = r.repo GROUP BY r.repo""")
def _(i):
    return rules.summarize_findings(findings(i), i.v_repos).drop("tree_key")


@query("links_between", """
SELECT repo, from_area, target_area, kind, CAST(count(*) AS BIGINT) AS links FROM v_rule_links GROUP BY ALL""")
def _(i):
    return rules.links_between(linked(i)).select("repo", "from_area", "target_area", "kind", "links")


@query("items_per_area", """
SELECT a.repo, a.name AS area, CAST(count(p.id) AS BIGINT) AS items
FROM (SELECT DISTINCT repo, name FROM v_area_re) a
LEFT JOIN v_placed p ON p.repo = a.repo AND p.area = a.name AND (p.cfg IS NULL OR p.cfg NOT LIKE '%test,%')
GROUP BY a.repo, a.name""")
def _(i):
    return rules.items_per_area(i.v_items, i.v_areas).drop("tree_key")


@query("unplaced_files", """
SELECT DISTINCT repo, file FROM v_items i WHERE (cfg IS NULL OR cfg NOT LIKE '%test,%')
  AND NOT EXISTS (SELECT 1 FROM v_area_re a WHERE a.repo = i.repo AND regexp_matches(i.file, a.re))""")
def _(i):
    return rules.unplaced_files(i.v_items, i.v_areas).drop("tree_key")


VIEWS["v_asked_sites"] = """
SELECT repo, tree_key, id AS site FROM v_items
UNION ALL SELECT DISTINCT repo, tree_key, file FROM v_items
UNION ALL SELECT r.repo, r.tree_key, n.name FROM v_repos r JOIN (SELECT DISTINCT name FROM v_areas) n ON true"""


@query("resolve_site", """
SELECT s.repo, s.site, coalesce(p.area, n.name, f.area) AS area,
  CASE WHEN i.id IS NOT NULL THEN p.side WHEN n.name IS NOT NULL THEN n.side ELSE f.side END AS side,
  CASE WHEN coalesce(p.area, n.name, f.area) IS NULL THEN 'outside every area'
    ELSE 'area `' || coalesce(p.area, n.name, f.area) || '` (' || coalesce(CASE WHEN i.id IS NOT NULL THEN p.side
      WHEN n.name IS NOT NULL THEN n.side ELSE f.side END, 'no side') || ')' END AS position
FROM v_asked_sites s
LEFT JOIN v_items i ON i.repo = s.repo AND i.id = s.site
LEFT JOIN v_placed p ON p.repo = s.repo AND p.id = s.site
LEFT JOIN (SELECT DISTINCT repo, name, side FROM v_area_re) n ON n.repo = s.repo AND n.name = s.site
LEFT JOIN (SELECT DISTINCT repo, file, area, side FROM v_placed) f ON f.repo = s.repo AND f.file = s.site""")
def _(i):
    return placement.resolve_sites(i.v_asked_sites, i.v_items, i.v_areas).drop("tree_key")


VIEWS["v_item_places"] = """
SELECT DISTINCT p.repo, p.area, p.side FROM v_placed p"""


@query("area_reach", """
WITH ends AS (SELECT DISTINCT repo, name, side FROM v_area_re UNION ALL SELECT DISTINCT repo, 'externals', 'externals' FROM v_area_re),
held AS (SELECT repo, area, CAST(count(*) AS BIGINT) AS items FROM v_placed GROUP BY repo, area)
SELECT a.repo, a.name AS "from", e.name AS "to", CAST(min(r.ord) AS INT) AS forbidden_by, min(r.ord) IS NULL AS may,
  CAST(coalesce(max(h.items), 0) AS BIGINT) AS items
FROM (SELECT DISTINCT repo, name, side FROM v_area_re) a JOIN ends e ON e.repo = a.repo AND e.name <> a.name
LEFT JOIN v_rule_targets r ON r.repo = a.repo AND r.must_not = 'depend-on' AND (r.subject = a.name OR r.subject = a.side)
  AND (r.target = e.name OR r.target = e.side)
LEFT JOIN held h ON h.repo = a.repo AND h.area = a.name
GROUP BY a.repo, a.name, e.name""")
def _(i):
    # With the number of items each answer concerns, so that the work grows with the facts.
    held = placement.place_items(i.v_items, i.v_areas).groupBy("repo", F.col("area").alias("from")).agg(
        F.count(F.lit(1)).alias("items")
    )
    return (
        rules.area_reach(i.v_areas, rules_of(i)).join(held, ["repo", "from"], "left")
        .withColumn("items", F.coalesce("items", F.lit(0)))
    )


@query("area_listing", """
SELECT a.repo, a.name, min(a.side) AS side, CAST(min(a.area_order) AS INT) AS area_order,
  CAST(CASE min(a.side) WHEN 'driving' THEN 0 WHEN 'domain' THEN 1 WHEN 'driven' THEN 2 END AS INT) AS rank,
  (SELECT CAST(count(*) AS BIGINT) FROM v_placed p WHERE p.repo = a.repo AND p.area = a.name) AS items
FROM v_areas a GROUP BY a.repo, a.name""")
def _(i):
    held = placement.place_items(i.v_items, i.v_areas).groupBy("repo", F.col("area").alias("name")).agg(
        F.count(F.lit(1)).alias("items")
    )
    listed = rules.area_listing(i.v_areas)
    return listed.join(held, ["repo", "name"], "left").withColumn("items", F.coalesce("items", F.lit(0)))


@query("columns_of_items", """
SELECT repo, id, cfg IS NULL OR cfg NOT LIKE '%test,%' AS non_test, visibility = 'pub' OR reexported OR entry AS public_surface,
  file || '::' || split_part(substr(id, strpos(id, '::' || module || '::') + length(module) + 4), '#', 1) AS site,
  file || ':' || CAST(line AS STRING) AS witness_text FROM v_items""")
def _(i):
    c = F.col
    return i.v_items.select(
        "repo", "id", C.non_test(c("cfg")).alias("non_test"),
        C.is_public(c("visibility"), c("reexported"), c("entry")).alias("public_surface"),
        C.site_of(c("id"), c("file"), c("module")).alias("site"),
        C.witness_text(c("file"), c("line"), F.lit(None).cast("string")).alias("witness_text"),
    )


@query("columns_of_links", """
SELECT repo, "from", target_kind, target_id, member, kind, line, confidence,
  CASE WHEN kind IN ('calls','calls-port','depends-on-port','hands-off','listens-to','calls-out','wires','routes') THEN 'call'
    WHEN kind IN ('implements','refines','inherits','uses-type','holds','constructs','matches-on') THEN 'type'
    WHEN kind IN ('reads','queues') THEN 'data' WHEN kind IN ('tests','re-exports','expands','decorates') THEN 'structure' END AS family,
  CASE WHEN kind IN ('implements','refines','re-exports','inherits','decorates','holds') THEN 'declared' END AS origin,
  kind IN ('expands','decorates','inherits') AS compile_time,
  CASE WHEN confidence = 'resolved' THEN 'block' ELSE 'warn' END AS level,
  split_part(target_id, '#', 1) || ' must not depend-on ' || kind AS rule_text
FROM v_links""")
def _(i):
    c = F.col
    return i.v_links.select(
        "repo", "from", "target_kind", "target_id", "member", "kind", "line", "confidence",
        C.link_family(c("kind")).alias("family"), C.link_origin(c("kind")).alias("origin"),
        C.is_compile_time(c("kind")).alias("compile_time"),
        C.confidence_level(c("confidence"), F.lit("block")).alias("level"),
        C.rule_text(F.substring_index("target_id", "#", 1), F.lit("depend-on"), c("kind")).alias("rule_text"),
    )
