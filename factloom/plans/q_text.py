"""Text jobs on documents, pages and conversations; reports over the whole graph; policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import fixed
from factloom.functions import columns as C
from factloom.functions import sql_text as Q
from factloom.operators import assemble, reports, rules
from factloom.operators.ordered import KEYS
from factloom.plans.catalog import query
from factloom.plans.q_rules import FINDING, FINDING_SQL, findings, rules_of
from factloom.plans.views import VIEWS
from factloom.session import scratch_path
from factloom.sources import facts as src
from factloom.sources import logs

c = F.col

STATEMENTS = [
    "SELECT * FROM orders", "select a, b from public.orders o join customers c on o.id = c.id", "INSERT INTO outbox (id) VALUES (1)",
    "UPDATE orders SET state = 1", "DELETE FROM orders WHERE id = 1", "SELECT id FROM outbox FOR UPDATE SKIP LOCKED",
    "CREATE TABLE IF NOT EXISTS shipments (id INT)", "create table ~Orders~ (id int); CREATE TABLE items(id int);", "SELECT * FROM (SELECT 1) x, LATERAL unnest(y)",
    "select 1 -- from nowhere", "WITH q AS (SELECT id FROM queue FOR UPDATE SKIP LOCKED) DELETE FROM queue", "insert into a.b select * from [c]",
]
# A tilde stands for a double quote in these texts.
VIEWS["v_sql"] = "SELECT doc_id, replace(CASE doc_id % 12 " + " ".join(
    f"WHEN {n} THEN '{s}'" for n, s in enumerate(STATEMENTS)) + " END, '~', chr(34)) || chr(10) || text || chr(10) || 'from t' || CAST(doc_id % 5 AS STRING) AS sql FROM documents"
VIEWS["v_sql_lines"] = """
SELECT doc_id, unnest(string_split(sql, chr(10))) AS l, generate_subscripts(string_split(sql, chr(10)), 1) AS line FROM v_sql"""
VIEWS["v_sql_split"] = r"""
SELECT doc_id, line, unnest(list_filter(regexp_split_to_array(regexp_replace(l, '--.*$', ''), '[\s\p{Z}(),;]+'), lambda w: w <> '')) AS word,
  generate_subscripts(list_filter(regexp_split_to_array(regexp_replace(l, '--.*$', ''), '[\s\p{Z}(),;]+'), lambda w: w <> ''), 1) AS k FROM v_sql_lines"""
VIEWS["v_words"] = """
SELECT doc_id, CAST(line AS BIGINT) AS line, word, lower(word) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) AS pos,
  lag(lower(word)) OVER (PARTITION BY doc_id ORDER BY line, k) AS before, lead(word) OVER (PARTITION BY doc_id ORDER BY line, k) AS nxt FROM v_sql_split"""
VIEWS["v_touches"] = r"""
SELECT doc_id, "table", CASE WHEN max(wr) = 1 THEN 'write' ELSE 'read' END AS access, max(ins) = 1 AS inserts FROM (
  SELECT doc_id, lower(regexp_replace(list_last(string_split(nxt, '.')), '^["`\[\]]+|["`\[\]]+$', '', 'g')) AS "table",
    CASE WHEN (w = 'from' AND before = 'delete') OR w = 'into' OR w = 'update' THEN 1 ELSE 0 END AS wr, CASE WHEN w = 'into' THEN 1 ELSE 0 END AS ins
  FROM v_words WHERE nxt IS NOT NULL AND (w IN ('from', 'join', 'into') OR (w = 'update' AND coalesce(before, '') <> 'for'))) x
WHERE regexp_matches("table", '^[\p{L}\p{N}_]+$') AND NOT regexp_matches("table", '^[0-9]') AND "table" NOT IN ('select', 'set', 'only', 'lateral', 'unnest') GROUP BY doc_id, "table" """


@query("sql_words", "SELECT doc_id, line, word FROM v_words")
def _(i):
    return i.v_sql.select("doc_id", F.inline(Q.sql_words(c("sql")))).select("doc_id", "line", "word")


@query("sql_touches", """
SELECT t.doc_id, t."table", t.access, t.inserts, EXISTS (SELECT 1 FROM v_words w WHERE w.doc_id = t.doc_id AND w.w = 'skip' AND lower(w.nxt) = 'locked') AS dequeues FROM v_touches t""")
def _(i):
    return Q.sql_touches(i.v_sql, "sql")


@query("adjacent_words", "SELECT doc_id, bool_or(w = 'skip' AND lower(nxt) = 'locked') AS locked FROM v_words GROUP BY doc_id")
def _(i):
    return Q.skips_locked(i.v_sql, "sql").select("doc_id", "locked")


@query("created_tables", r"""
SELECT a.doc_id, lower(regexp_replace(list_last(string_split(n.word, '.')), '^["`\[\]]+|["`\[\]]+$', '', 'g')) AS "table", a.line FROM v_words a
JOIN LATERAL (SELECT word FROM v_words b WHERE b.doc_id = a.doc_id AND b.pos >= a.pos + 2 AND b.w NOT IN ('if', 'not', 'exists') ORDER BY b.pos LIMIT 1) n ON true
WHERE a.w = 'create' AND lower(a.nxt) = 'table'""")
def _(i):
    return Q.created_tables(i.v_sql, "sql")


# ---------------------------------------------------------------- pages

VIEWS["v_html"] = """
SELECT p.page_id, p.url, p.html, CASE WHEN p.page_id % 5 = 0 THEN 'none' ELSE p.url END || CASE WHEN p.page_id % 3 = 0 THEN ' ' || coalesce(q.url, '') ELSE '' END AS text
FROM pages p LEFT JOIN pages q ON q.page_id = p.page_id + 1"""
VIEWS["v_hosts"] = r"""
SELECT page_id, CASE WHEN len(h) = 1 THEN h[1] END AS host FROM (SELECT page_id, list_distinct(list_filter(regexp_extract_all(text, 'https?://([\p{L}\p{N}.-]*)', 1), lambda x: contains(x, '.'))) AS h FROM v_html) y"""


@query("host_in", "SELECT page_id, host FROM v_hosts")
def _(i):
    return i.v_html.select("page_id", C.host_in(c("text")).alias("host"))


VIEWS["v_host_notes"] = """
SELECT 'alpha' AS repo, page_id, CAST(page_id % 2 AS BIGINT) AS phase, CAST((page_id * 37) % 1009 AS BIGINT) AS walk_pos FROM pages"""


@query("first_per_host", """
SELECT repo, host, 'p' || CAST(page_id AS STRING) || '.rs' AS file, page_id AS line FROM (
  SELECT n.*, h.host, row_number() OVER (PARTITION BY h.host ORDER BY n.phase, n.walk_pos, n.page_id) AS rn FROM v_host_notes n JOIN v_hosts h ON h.page_id = n.page_id WHERE h.host IS NOT NULL) x WHERE rn = 1""")
def _(i):
    named = i.v_html.select("page_id", C.host_in(c("text")).alias("host")).filter(c("host").isNotNull())
    notes = i.v_host_notes.join(named, "page_id").select(
        "repo", F.lit("t").alias("tree_key"), "host", F.concat(F.lit("p"), c("page_id").cast("string"), F.lit(".rs")).alias("file"),
        c("page_id").alias("line"), "phase", "walk_pos", c("page_id").alias("seq"))
    return assemble.first_per_host(notes).drop("tree_key")


@query("first_terminal_write", """
SELECT source AS repo, path AS file, doc_id AS line FROM (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY doc_id % 3, (doc_id * 37) % 1009, doc_id) AS rn FROM v_docs d) x WHERE rn = 1""")
def _(i):
    writes = i.v_docs.select(
        c("source").alias("repo"), F.lit("t").alias("tree_key"), c("path").alias("file"), c("doc_id").alias("line"), (c("doc_id") % 3).alias("phase"),
        ((c("doc_id") * 37) % 1009).alias("walk_pos"), c("doc_id").alias("seq"))
    return assemble.first_terminal_write(writes).drop("tree_key")


@query("line_col", """
SELECT page_id, strpos(html, '</p>') AS at_char, CAST(len(string_split(substr(html, 1, strpos(html, '</p>') - 1), chr(10))) AS BIGINT) AS line,
  CAST(length(list_last(string_split(substr(html, 1, strpos(html, '</p>') - 1), chr(10)))) + 1 AS BIGINT) AS col FROM v_html WHERE strpos(html, '</p>') > 0""")
def _(i):
    at = F.position(F.lit("</p>"), c("html"))
    return i.v_html.withColumn("at_char", at).filter(c("at_char") > 0).select(
        "page_id", c("at_char").cast("bigint").alias("at_char"), C.line_of(c("html"), c("at_char")).alias("line"), C.column_of(c("html"), c("at_char")).alias("col"))


@query("normalize_path", """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '../' ELSE '' END || 'a' || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/x' || CAST(page_id AS STRING) END || '/y.rs' AS path FROM pages""")
def _(i):
    n = c("page_id").cast("string")
    raw = F.concat(F.when(c("page_id") % 4 == 0, "b/../../").otherwise("./"), F.lit("a//./x"), n, F.when(c("page_id") % 2 == 0, "/..").otherwise(""), F.lit("/y.rs"))
    return i.pages.select("page_id", C.normalize_path(raw).alias("path"))


# ---------------------------------------------------------------- documents and conversations

DECLARED = ["pub fn run() {}", "  pub(crate) async fn go() {}", "struct S;", "pub enum E {}", "unsafe trait T {}", "const X: u8 = 1;", "mod inner {", "macro_rules! m {", "extern ~C~ fn f() {}", "let fnord = 1;"]
VIEWS["v_code"] = "SELECT repo, path, text || chr(10) || replace(CASE doc_id % 10 " + " ".join(
    f"WHEN {n} THEN '{s}'" for n, s in enumerate(DECLARED)) + " END, '~', chr(34)) || chr(10) || 'static S: u8 = 0;' AS text FROM v_docs"
VIEWS["v_code_lines"] = """SELECT repo, path, unnest(string_split(text, chr(10))) AS l FROM v_code"""


def _decl_sql(kind: str) -> str:
    return f"CAST(count(*) FILTER (WHERE regexp_matches(l, '{C.declaration_line([kind])}')) AS BIGINT) AS \"{kind}\""


@query("count_declarations", "SELECT repo, path, " + ", ".join(_decl_sql(k) for k in fixed.DECL_KINDS) + f""",
  CAST(count(*) FILTER (WHERE regexp_matches(l, '{C.declaration_line([*fixed.DECL_KINDS, "union"])}') OR regexp_matches(l, '^\\s*macro_rules!\\s')) AS BIGINT) AS decls, CAST(count(*) - 1 AS BIGINT) AS lines FROM v_code_lines GROUP BY repo, path""")
def _(i):
    return i.v_code.select("repo", "path", *[v.alias(k) for k, v in C.declarations(c("text")).items()])


@query("measured_sizes", f"""
SELECT repo, CAST(count(DISTINCT path) AS BIGINT) AS files, CAST(count(*) - count(DISTINCT path) AS BIGINT) AS lines,
  CAST(count(*) FILTER (WHERE regexp_matches(l, '{C.declaration_line([*fixed.DECL_KINDS, "union"])}') OR regexp_matches(l, '^\\s*macro_rules!\\s')) AS BIGINT) AS decls FROM v_code_lines GROUP BY repo""")
def _(i):
    counted = i.v_code.select("repo", *[v.alias(k) for k, v in C.declarations(c("text")).items()])
    return counted.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("decls").alias("decls"))


@query("squash", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS squashed FROM documents")
def _(i):
    return i.documents.select("doc_id", C.squash(c("text")).alias("squashed"))


@query("columns_of_texts", r"""
SELECT conv_id, turn, CASE WHEN octet_length(encode(text)) <= 100 THEN text ELSE '…' || right(text, CAST(list_max(list_filter(range(0, 101), lambda k: octet_length(encode(right(text, k))) <= 100)) AS BIGINT)) END AS tail,
  CASE WHEN length(split_part(text, chr(10), 1)) > 160 THEN substr(split_part(text, chr(10), 1), 1, 160) || '…' ELSE split_part(text, chr(10), 1) END AS short,
  replace(replace(text, '|', chr(92) || '|'), chr(10), ' ') AS cell,
  CASE WHEN turn % 3 < 2 AND NOT contains(trim(text), chr(10)) AND trim(text) <> '' THEN CASE turn % 3 WHEN 0 THEN 'feat' ELSE 'fix' END || CASE WHEN turn % 2 = 0 THEN '(' || "role" || ')' ELSE '' END || ': ' || trim(text) END AS subject,
  text || chr(10) || 'end' AS result_text, text AS plain_text,
  CASE WHEN turn % 4 = 0 THEN 'scope' WHEN turn % 4 = 1 THEN 'stale' ELSE 'command' END AS cause, CASE "role" WHEN 'user' THEN 'calls-port-' || CAST(turn AS STRING) ELSE 'holds-' || CAST(turn AS STRING) END AS kebab
FROM conversations""")
def _(i):
    part = F.struct(F.lit("text").alias("type"), c("text"))
    said = F.to_json(F.array(part, F.struct(F.lit("text").alias("type"), F.lit("end").alias("text"))))
    quoted = F.regexp_extract(F.to_json(F.struct(c("text").alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    reason = F.when(c("turn") % 4 == 0, F.concat("text", F.lit(" is outside element E1"))).when(
        c("turn") % 4 == 1, F.concat(F.lit("f changed since element E1 last read it "), "text")).otherwise("refused")
    camel = F.concat(F.when(c("role") == "user", "CallsPort-").otherwise("Holds-"), c("turn").cast("string"))
    kind = F.when(c("turn") % 3 == 0, "feat").when(c("turn") % 3 == 1, "fix").otherwise("wip")
    return i.conversations.select(
        "conv_id", "turn", C.tail(c("text"), 100).alias("tail"), C.short(c("text")).alias("short"), C.markdown_cell(c("text")).alias("cell"),
        C.conventional_subject(kind, F.when(c("turn") % 2 == 0, c("role")), c("text")).alias("subject"),
        C.tool_result_text(said).alias("result_text"), C.tool_result_text(quoted).alias("plain_text"), C.denial_cause(reason).alias("cause"), C.kebab_case(camel).alias("kebab"))


@query("area_paths", """
SELECT repo, module, string_agg(g, ', ' ORDER BY g) AS paths FROM (
  SELECT DISTINCT repo, module, 'src/' || replace(module, '::', '/') || '/**' AS g FROM v_items
  UNION SELECT DISTINCT repo, module, 'src/' || replace(module, '::', '/') || '.rs' FROM v_items WHERE length(module) % 2 = 0) x GROUP BY repo, module""")
def _(i):
    base = F.concat(F.lit("src/"), F.replace("module", F.lit("::"), F.lit("/")))
    # A module's own file next to its folder, for every second module.
    files = i.v_items.select("repo", "module", F.explode(F.array("file", F.when(F.length("module") % 2 == 0, F.concat(base, F.lit(".rs"))))).alias("f")).filter(c("f").isNotNull())
    held = files.groupBy("repo", "module").agg(F.collect_set("f").alias("files"))
    return held.select("repo", "module", F.array_join(F.array_sort(C.area_paths(base, c("files"))), ", ").alias("paths"))


@query("columns_of_ports", """
SELECT repo, id, kind NOT IN ('crate', 'pub', 'declared') AS is_io FROM v_inv_ports""")
def _(i):
    return i.v_inv_ports.select("repo", "id", C.is_io(c("kind")).alias("is_io"))


# ---------------------------------------------------------------- policy and reports

VIEWS["v_lints"] = """
SELECT 'ws' || CAST(c_custkey AS STRING) AS repo, CASE c_custkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'block' WHEN 3 THEN 'warn' ELSE 'off' END AS setting FROM customer"""


@query("lint_level", "SELECT repo, CASE setting WHEN 'block' THEN 'block' WHEN 'true' THEN 'warn' WHEN 'warn' THEN 'warn' END AS level FROM v_lints")
def _(i):
    return i.v_lints.select("repo", C.lint_level(c("setting")).alias("level"))


@query("read_policy", """
SELECT 'ws' || CAST(c_custkey AS STRING) AS repo, 1 AS ord, lower(c_mktsegment) AS name, 'domain' AS side, 'src/' || lower(c_mktsegment) || '/**' AS "glob" FROM customer""")
def _(i):
    path = scratch_path(i.spark, "policy")
    name = F.lower("c_mktsegment")
    i.customer.select(F.concat(F.lit("ws"), c("c_custkey").cast("string")).alias("repo"), F.lit(1).alias("ord"), name.alias("name"), F.lit("domain").alias("side"),
                      F.concat(F.lit("src/"), name, F.lit("/**")).alias("glob")).write.json(path)
    return logs.read_policy(i.spark, path, "repo string,ord int,name string,side string,glob string")


@query("write_check_output", f"""
SELECT repo, CAST(1 AS BIGINT) AS version, CAST(count(*) AS BIGINT) AS findings, CAST(count(*) FILTER (WHERE level = 'block' AND allowed_by IS NULL) AS BIGINT) AS blocking,
  CAST(count(*) FILTER (WHERE allowed_by IS NOT NULL) AS BIGINT) AS allowed FROM v_findings GROUP BY repo""")
def _(i):
    path = scratch_path(i.spark, "check-output")
    reports.write_check_output(findings(i).select("tree_key", *FINDING), i.v_repos, path, compression="gzip")
    lines = i.spark.read.schema("value string,repo string,tree_key string").text(path)
    of = lambda n: F.get_json_object("value", f"$.{n}").cast("bigint")
    head = of("version").isNotNull()
    return lines.groupBy("repo").agg(
        F.max(of("version")).alias("version"), F.count_if(~head).alias("findings"), F.max(F.when(head, of("blocking"))).alias("blocking"),
        F.max(F.when(head, of("allowed"))).alias("allowed"))


@query("findings_delta", """
SELECT a.repo, a.site, a.target, a.rule, a.kind, a.line, 'added' AS change FROM (SELECT DISTINCT repo, site, target, rule, kind, line FROM v_findings WHERE line % 3 <> 0) a
WHERE NOT EXISTS (SELECT 1 FROM v_findings b WHERE b.line % 4 <> 0 AND b.repo = a.repo AND b.site = a.site AND b.target = a.target AND b.rule = a.rule AND b.kind = a.kind AND b.line = a.line)
UNION ALL SELECT b.repo, b.site, b.target, b.rule, b.kind, b.line, 'fixed' FROM (SELECT DISTINCT repo, site, target, rule, kind, line FROM v_findings WHERE line % 4 <> 0) b
WHERE NOT EXISTS (SELECT 1 FROM v_findings a WHERE a.line % 3 <> 0 AND b.repo = a.repo AND b.site = a.site AND b.target = a.target AND b.rule = a.rule AND b.kind = a.kind AND b.line = a.line)""")
def _(i):
    on = ["repo", "site", "target", "rule", "kind", "line"]
    found = findings(i).select(*on).distinct()
    return reports.findings_delta(found.filter(c("line") % 4 != 0), found.filter(c("line") % 3 != 0), on)


@query("findings_of_change", """
SELECT repo, site, "from", target, rule, kind, file, line, 'added' AS change FROM (
  SELECT DISTINCT repo, site, "from", target, target_item, rule, kind, file, line FROM v_findings WHERE length(file) % 2 = 0 AND line % 4 = 0 AND line % 3 <> 0)
UNION ALL SELECT repo, site, "from", target, rule, kind, file, line, 'fixed' FROM (
  SELECT DISTINCT repo, site, "from", target, target_item, rule, kind, file, line FROM v_findings WHERE length(file) % 2 = 0 AND line % 4 <> 0 AND line % 3 = 0)""")
def _(i):
    # Links of some files come and go by their lines; the other files' facts are the same on both sides.
    facts = {"items": i.v_items, "links": i.v_links, "externals": i.v_externals, "ports": i.v_ports}
    edited = F.length("file") % 2 == 0
    sides = [{**facts, "links": i.v_links.filter(~edited | (c("line") % n != 0))} for n in (4, 3)]
    changed = i.v_links.filter(edited).select("repo", "file").distinct()
    found = reports.findings_of_change(*sides, changed, i.v_areas, rules_of(i), i.v_allows)
    return found.select("repo", "site", "from", "target", "rule", "kind", "file", "line", "change")


@query("fleet_sizes", """
SELECT repo, 'links' AS what, CAST(count(*) + 5 AS BIGINT) AS recorded, CAST(count(*) AS BIGINT) AS found FROM v_links WHERE repo = 'beta' GROUP BY repo""")
def _(i):
    # Recorded sizes written and read back; beta's links are recorded wrong by five.
    path = scratch_path(i.spark, "sizes")
    counted = i.v_links.groupBy("repo").agg(F.count(F.lit(1)).alias("links")).join(i.v_items.groupBy("repo").agg(F.count(F.lit(1)).alias("items")), "repo")
    counted.withColumn("links", F.when(c("repo") == "beta", c("links") + 5).otherwise(c("links"))).select(
        F.to_json(F.struct("repo", "items", "links")).alias("value")).repartition(2, "repo").write.option("maxRecordsPerFile", 1).text(path)
    return reports.fleet_sizes(i.v_items, i.v_links, src.read_sizes(i.spark, path))


@query("context_pack", """
SELECT repo, section, line FROM (
SELECT a.repo, 1 AS section, '- **' || a.name || '** · ' || coalesce(a.side, 'no side') || ' · ' || g.paths || ' · ' || CAST((SELECT count(*) FROM v_placed p WHERE p.repo = a.repo AND p.area = a.name
    AND (p.cfg IS NULL OR p.cfg NOT LIKE '%test,%')) AS STRING) || ' items' AS line FROM (SELECT DISTINCT repo, name, side FROM v_areas) a
  JOIN (SELECT repo, name, string_agg("glob", ', ' ORDER BY path_pos) AS paths FROM v_areas GROUP BY ALL) g ON g.repo = a.repo AND g.name = a.name
UNION ALL SELECT DISTINCT repo, 2, '- outside every area: `' || file || '`' FROM v_items i WHERE (cfg IS NULL OR cfg NOT LIKE '%test,%')
  AND NOT EXISTS (SELECT 1 FROM v_area_re a WHERE a.repo = i.repo AND regexp_matches(i.file, a.re))
UNION ALL SELECT repo, 3, '- ' || side || ' · `' || id || '` · ' || section || coalesce(' · behind `' || external || '`', '') FROM v_ports
UNION ALL SELECT e.repo, 4, '- main · `' || e.item || '` · ' || coalesce('in `' || p.area || '`', 'outside every area') FROM v_entries e LEFT JOIN v_placed p ON p.repo = e.repo AND p.id = e.item
UNION ALL SELECT repo, 5, '- ' || from_area || ' → ' || target_area || ': ' || string_agg(kind || ' ' || CAST(n AS STRING), ', ' ORDER BY rank) FROM (
    SELECT repo, from_area, target_area, kind, count(*) AS n, """ + "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(fixed.LINK_KINDS)) + """ END AS rank FROM v_rule_links GROUP BY ALL) x GROUP BY repo, from_area, target_area
UNION ALL SELECT repo, 6, '- ' || subject || ' must not ' || must_not || ' ' || string_agg(target, ', ' ORDER BY target_pos) || ' · ' || level FROM v_rule_targets GROUP BY repo, ord, subject, must_not, level
UNION ALL SELECT repo, 7, '- ' || rule || ' · `' || site || '` → `' || target || '` · ' || CASE WHEN allowed_by IS NOT NULL THEN 'allowed by ' || allowed_by ELSE level END || ' · ' || file || ':' || CAST(line AS STRING) FROM v_findings) z""")
def _(i):
    pack = reports.context_pack(i.v_items, i.v_links, i.v_externals, i.v_ports, i.v_entries, i.v_areas, rules_of(i), i.v_allows)
    return pack.select("repo", "section", "line")
