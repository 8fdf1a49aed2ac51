"""Snapshots of document trees: identity, differences, assembly and refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import snapshots as S
from factloom.operators.ordered import KEYS
from factloom.plans.catalog import Inputs, query
from factloom.plans.views import VIEWS
from factloom.session import scratch_path
from factloom.sources import facts as src

c = F.col

# Tree a holds every document; tree b drops, changes and adds some in alpha, and only changes some in beta.
VIEWS["v_docs"] = """
SELECT CASE WHEN doc_id % 3 = 0 THEN 'beta' ELSE 'alpha' END AS repo, doc_id, text, source, lang,
  'src/' || source || '/' || lang || '/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 11 = 0 THEN '.md' ELSE '.rs' END AS path
FROM documents"""
VIEWS["v_files_a"] = """
SELECT repo, 'commit:a' AS tree_key, doc_id, path, source AS package, text, sha256(text) AS file_hash FROM v_docs"""
VIEWS["v_text_b"] = """
SELECT repo, doc_id, path, source, CASE WHEN doc_id % 14 = 0 THEN text || ' // word' WHEN doc_id % 7 = 0 THEN text || ' word'
  ELSE text END AS text FROM v_docs WHERE repo = 'beta' OR doc_id % 10 <> 0
UNION ALL SELECT repo, doc_id, path || '.v2.rs', source, text FROM v_docs WHERE repo = 'alpha' AND doc_id % 13 = 0"""
VIEWS["v_files_b"] = """
SELECT repo, 'worktree:b' AS tree_key, doc_id, path, source AS package, text, sha256(text) AS file_hash FROM v_text_b"""
VIEWS["v_keyed_a"] = """
SELECT repo, tree_key, doc_id, path, package, file_hash, sha256(path || chr(0) || file_hash || chr(0) || package) AS facts_key FROM v_files_a"""
VIEWS["v_keyed_b"] = """
SELECT repo, tree_key, doc_id, path, package, file_hash, sha256(path || chr(0) || file_hash || chr(0) || package) AS facts_key FROM v_files_b"""
# Deltas exist for two thirds of tree a; each holds one to three items.
VIEWS["v_delta_items"] = """
SELECT a.repo, a.facts_key, a.path, a.file_hash, a.doc_id,
  a.package || '::' || CAST(a.doc_id AS STRING) || '::i' || CAST(n.n AS STRING) AS id, a.path AS file, CAST(n.n + 1 AS BIGINT) AS line
FROM v_keyed_a a JOIN (VALUES (0), (1), (2)) AS n(n) ON n.n <= a.doc_id % 3 WHERE a.doc_id % 4 <> 3"""
VIEWS["v_file_facts"] = """SELECT DISTINCT repo, facts_key, path, file_hash, doc_id FROM v_delta_items"""
VIEWS["v_bare_a"] = r"""
SELECT repo, path, regexp_replace(regexp_replace(text, '//[^' || chr(10) || ']*', '', 'g'), '/[*].*?[*]/', '', 'gs') AS bare FROM v_files_a"""
VIEWS["v_bare_b"] = VIEWS["v_bare_a"].replace("v_files_a", "v_files_b")


def _print_sql(view: str) -> str:
    text = "bare"
    for _ in range(3):
        text = f"regexp_replace({text}, '[{{][^{{}}]*[}}]', ';', 'g')"
    return f"SELECT repo, path, sha256(regexp_replace({text}, '[ \t\n\r\f\v]+', '', 'g')) AS fingerprint FROM {view}"


# The given texts have no functions, so a plain removal of comments, braces and blanks tells the same texts apart.
VIEWS["v_print_a"] = _print_sql("v_bare_a")
VIEWS["v_print_b"] = _print_sql("v_bare_b")


def nested_deltas(i: Inputs):
    """Deltas as one row per file with an array of items."""
    return i.v_delta_items.groupBy("facts_key", "repo", "path", "file_hash").agg(
        F.array_sort(F.collect_list(F.struct("id", "file", "line"))).alias("items")
    )


@query("file_identity", """
SELECT repo, path, file_hash, facts_key, CAST(octet_length(encode(path)) AS BIGINT) AS path_bytes,
  'commit' AS tree_kind, 'a' AS tree_name, CAST(NULL AS STRING) AS not_a_key,
  substr(sha256(repo || chr(0) || package || chr(0) || path), 1, 8) AS element_id
FROM v_keyed_a""")
def _(i):
    hashed = i.v_files_a.withColumn("file_hash", C.content_hash(c("text")))
    return hashed.select(
        "repo", "path", "file_hash", C.facts_key(c("path"), c("file_hash"), c("package")).alias("facts_key"),
        F.octet_length("path").cast("bigint").alias("path_bytes"), C.tree_key_kind(c("tree_key")).alias("tree_kind"),
        C.tree_key_name(c("tree_key")).alias("tree_name"), C.tree_key_kind(c("path")).alias("not_a_key"),
        C.element_id(c("repo"), c("package"), c("path")).alias("element_id"),
    )


@query("git_blob_id", """
SELECT repo, path, sha256(encode('blob ' || CAST(octet_length(encode(text)) AS STRING) || chr(0)) || encode(text)) AS id,
  sha1(encode('blob ' || CAST(octet_length(encode(text)) AS STRING) || chr(0)) || encode(text)) AS short_id FROM v_files_a""")
def _(i):
    return i.v_files_a.select(
        "repo", "path", C.git_blob_id(c("text"), 256).alias("id"), C.git_blob_id(c("text")).alias("short_id")
    )


# A source text around each document's words, and edits of it: name, old, new, and whether other files see the edit.
PRINT_CASES = [
    ("none", "zzz", "zzz", True), ("function_body", "x(1)", "y(2, 3)", True), ("comment", "use a::b;", "use a::b; // c { d", True), ("spaces", "-> u8", "\n  ->   u8", True),
    ("method_body", "{ 7 }", "{ self.k() }", True), ("inner_function_body", "{ 8 }", "{ 9 }", True), ("text_in_body", "let t = \"", "let t = \"more } ", True),
    ("field_type", "f: u8", "f: u16", False), ("trait_method", "fn m(&self) -> u8;", "fn m(&mut self) -> u8;", False), ("method_header", "fn k(&self)", "fn k(&self, n: u8)", False),
    ("constant_text", "http://a/", "http://b/", False), ("item_in_module", "pub fn z()", "pub fn y()", False), ("constant_function_body", "{ 5 }", "{ 6 }", False),
    ("inner_function_header", "fn inner()", "fn inner(n: u8)", False), ("use_in_body", "loop {", "use q::r; loop {", False), ("visibility", "struct S", "pub struct S", False),
]
SOURCE = (
    "use a::b;\nstruct S { f: u8 }\ntrait T { fn m(&self) -> u8; }\nimpl S { fn k(&self) { 7 } }\nmod o { pub fn z() {} }\nconst fn five() -> u8 { 5 }\n"
    "const U: &str = \"http://a/\";\nfn main() { if a { loop { match b { _ => { while c { let t = \"@\"; x(1); } } } } } fn inner() -> u8 { 8 } }"
)
_print_names = ", ".join(f"('{name}', {str(same).lower()})" for name, _, _, same in PRINT_CASES)


@query("structure_fingerprint", f"""
SELECT f.repo, f.path, k.edit, k.same FROM v_files_b f CROSS JOIN (VALUES {_print_names}) AS k(edit, same)""")
def _(i):
    words = F.regexp_replace(c("text"), r'[\\"]', "")
    edits = F.array(*[F.struct(F.lit(n).alias("edit"), F.replace(F.lit(SOURCE), F.lit(old), F.lit(new)).alias("to")) for n, old, new, _ in PRINT_CASES])
    # Texts are dealt out first, as a file of them may have few parts. The source's hash is taken in front of the edits, once.
    texts = i.v_files_b.select("repo", "path", words.alias("words")).repartition(int(i.spark.conf.get("spark.sql.shuffle.partitions")))
    rows = texts.withColumn("was", C.structure_fingerprint(F.replace(F.lit(SOURCE), F.lit("@"), "words"))).withColumn("x", F.explode(edits))
    return rows.select("repo", "path", "x.edit", (C.structure_fingerprint(F.replace("x.to", F.lit("@"), "words")) == c("was")).alias("same"))


@query("changed_files", """
SELECT repo, path FROM (SELECT repo, path, file_hash FROM v_files_a UNION ALL SELECT repo, path, file_hash FROM v_files_b) x
GROUP BY repo, path HAVING count(DISTINCT file_hash) <> 1 OR count(*) <> 2""")
def _(i):
    return S.changed_files(i.v_files_a, i.v_files_b)


@query("symmetric_difference", """
SELECT DISTINCT repo, path FROM (
  (SELECT repo, path, file_hash FROM v_files_a EXCEPT SELECT repo, path, file_hash FROM v_files_b)
  UNION ALL (SELECT repo, path, file_hash FROM v_files_b EXCEPT SELECT repo, path, file_hash FROM v_files_a)) x""")
def _(i):
    return S.symmetric_difference(i.v_files_a, i.v_files_b)


@query("worktree_state_hash", """
SELECT repo, sha256(string_agg(path || chr(0) || file_hash || chr(10), '' ORDER BY path)) AS state_hash FROM v_files_b GROUP BY repo""")
def _(i):
    return S.worktree_state_hash(i.v_files_b).drop("tree_key")


@query("missing_file_facts", """
SELECT repo, path FROM v_keyed_a a WHERE NOT EXISTS (SELECT 1 FROM v_file_facts f WHERE f.facts_key = a.facts_key)""")
def _(i):
    return S.missing_file_facts(i.v_keyed_a, i.v_file_facts).select("repo", "path")


@query("assemble_tree", """
SELECT repo, id, file, line FROM v_delta_items
UNION ALL SELECT DISTINCT repo, 'worker::' || path, path, CAST(NULL AS BIGINT) FROM v_docs WHERE doc_id % 17 = 0""")
def _(i):
    derived = (
        i.v_docs.filter(c("doc_id") % 17 == 0)
        .withColumn("tree_key", F.lit("commit:a"))
        .withColumn("items", F.array(F.struct(F.concat(F.lit("worker::"), "path").alias("id"), c("path").alias("file"))))
    )
    return S.assemble_tree(i.v_keyed_a, nested_deltas(i), "items", derived).drop("tree_key")


@query("tree_union", """
SELECT repo, kind, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT repo, kind FROM v_links UNION ALL SELECT repo, 'calls' FROM v_calls) x GROUP BY repo, kind""")
def _(i):
    per_file = i.v_links.select("repo", "tree_key", "from", "kind", "confidence")
    derived = i.v_calls.withColumn("kind", F.lit("calls")).select("repo", "tree_key", "from", "kind")
    both = per_file.unionByName(derived, allowMissingColumns=True)
    return both.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("item_flags", """
SELECT i.repo, i.id,
  i.entry OR EXISTS (SELECT 1 FROM v_calls e WHERE e.repo = i.repo AND e."to" = i.id) AS entry,
  i.reexported OR EXISTS (SELECT 1 FROM v_links l WHERE l.repo = i.repo AND l.target_id = i.id AND l.kind = 're-exports'
    AND l.target_kind = 'item') AS reexported FROM v_items i""")
def _(i):
    entries = i.v_calls.select(*KEYS, c("to").alias("item"))
    return S.item_flags(i.v_items, entries, i.v_links).select("repo", "id", "entry", "reexported")


@query("tree_ids", """
WITH blobs AS (SELECT repo, path, doc_id, sha256(encode('blob ' || CAST(octet_length(encode(text)) AS STRING) || chr(0)) || encode(text)) AS id FROM v_files_a),
leaf AS (SELECT repo, regexp_replace(path, '/[^/]*$', '') AS dir, string_agg(hex(encode(CASE WHEN doc_id % 5 = 0 THEN '100755 ' ELSE '100644 ' END
    || regexp_extract(path, '[^/]*$', 0) || chr(0))) || upper(id), '' ORDER BY regexp_extract(path, '[^/]*$', 0)) AS body FROM blobs GROUP BY ALL),
l3 AS (SELECT repo, dir, sha256(encode('tree ' || CAST(length(body) // 2 AS STRING) || chr(0)) || unhex(body)) AS id FROM leaf),
b2 AS (SELECT repo, regexp_replace(dir, '/[^/]*$', '') AS up, string_agg(hex(encode('40000 ' || regexp_extract(dir, '[^/]*$', 0) || chr(0))) || upper(id), ''
    ORDER BY regexp_extract(dir, '[^/]*$', 0) || '/') AS body FROM l3 GROUP BY ALL),
l2 AS (SELECT repo, up AS dir, sha256(encode('tree ' || CAST(length(body) // 2 AS STRING) || chr(0)) || unhex(body)) AS id FROM b2),
b1 AS (SELECT repo, 'src' AS dir, string_agg(hex(encode('40000 ' || regexp_extract(dir, '[^/]*$', 0) || chr(0))) || upper(id), ''
    ORDER BY regexp_extract(dir, '[^/]*$', 0) || '/') AS body FROM l2 GROUP BY ALL),
l1 AS (SELECT repo, dir, sha256(encode('tree ' || CAST(length(body) // 2 AS STRING) || chr(0)) || unhex(body)) AS id FROM b1),
b0 AS (SELECT repo, hex(encode('40000 src' || chr(0))) || upper(id) AS body FROM l1)
SELECT repo, dir, id FROM l3 UNION ALL SELECT repo, dir, id FROM l2 UNION ALL SELECT repo, dir, id FROM l1
UNION ALL SELECT repo, '', sha256(encode('tree ' || CAST(length(body) // 2 AS STRING) || chr(0)) || unhex(body)) FROM b0""")
def _(i):
    mode = F.when(c("doc_id") % 5 == 0, "100755").otherwise("100644")
    blobs = i.v_files_a.select(*KEYS, "path", mode.alias("mode"), C.git_blob_id(c("text"), 256).alias("id"))
    return S.tree_ids(blobs, 256).drop("tree_key")


def prints(i: Inputs, files: str):
    return getattr(i, files).select("repo", "path", "file_hash", C.structure_fingerprint(c("text")).alias("fingerprint"))


VIEWS["v_src_deps"] = """
SELECT DISTINCT repo, source AS name, 'src' || CAST(2 * CAST(substr(source, 4) AS INT) + 1 AS STRING) AS dep FROM v_docs
WHERE 2 * CAST(substr(source, 4) AS INT) + 1 < 20"""
VIEWS["v_src_dev"] = """
SELECT DISTINCT repo, source AS name, 'src' || CAST(CAST(substr(source, 4) AS INT) - 1 AS STRING) AS dep FROM v_docs
WHERE CAST(substr(source, 4) AS INT) % 6 = 5"""
VIEWS["v_src"] = """SELECT DISTINCT repo, source AS name FROM v_docs"""
VIEWS["v_scope"] = """
SELECT * FROM (WITH RECURSIVE owned AS (SELECT repo, path, package FROM v_keyed_a),
diff AS (SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path, a.path IS NOT NULL AS was, b.path IS NOT NULL AS now,
    a.file_hash IS NOT NULL AND b.file_hash IS NOT NULL AND a.file_hash <> b.file_hash AS changed
  FROM v_keyed_a a FULL JOIN v_keyed_b b ON a.repo = b.repo AND a.path = b.path),
redecl AS (SELECT d.repo, d.path FROM diff d JOIN v_print_a x ON x.repo = d.repo AND x.path = d.path
  JOIN v_print_b y ON y.repo = d.repo AND y.path = d.path WHERE d.changed AND x.fingerprint <> y.fingerprint),
whole AS (SELECT DISTINCT repo FROM diff WHERE path LIKE '%.rs' AND was <> now
  UNION SELECT repo FROM redecl r WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.repo = r.repo AND o.path = r.path)),
decl AS (SELECT DISTINCT o.repo, o.package AS name FROM redecl r JOIN owned o ON o.repo = r.repo AND o.path = r.path),
up AS (SELECT repo, name FROM decl UNION SELECT d.repo, d.name FROM up u JOIN v_src_deps d ON d.repo = u.repo AND d.dep = u.name),
hit AS (SELECT repo, name FROM up UNION SELECT d.repo, d.name FROM up u JOIN v_src_dev d ON d.repo = u.repo AND d.dep = u.name),
walked AS (SELECT DISTINCT o.repo, o.path FROM owned o JOIN hit h ON h.repo = o.repo AND h.name = o.package)
SELECT d.repo, d.path, CASE WHEN EXISTS (SELECT 1 FROM whole w WHERE w.repo = d.repo) THEN 'unit'
  WHEN EXISTS (SELECT 1 FROM walked w WHERE w.repo = d.repo AND w.path = d.path) THEN 'package'
  WHEN d.changed OR NOT d.was THEN 'file' ELSE 'carry' END AS scope FROM diff d WHERE d.now) z"""


def scope_inputs(i: Inputs):
    """Beta's sources are owned, so its changes stay partial; alpha loses and gains sources."""
    before = i.v_keyed_a.select("repo", "path", "facts_key").join(prints(i, "v_files_a"), ["repo", "path"])
    owners = i.v_keyed_a.select("repo", "path", "package")
    return dict(
        before=before, after=prints(i, "v_files_b"), deltas=i.v_keyed_a, owners=owners, packages=i.v_src,
        deps=i.v_src_deps, dev_deps=i.v_src_dev, unit=i.v_src,
    )


@query("recompute_scope", "SELECT repo, path, scope FROM v_scope")
def _(i):
    return S.recompute_scope(**scope_inputs(i))


@query("carry_forward", """
SELECT b.repo, b.facts_key, CASE WHEN s.scope = 'carry' THEN 'old ' || a.path ELSE 'new ' || b.path END AS facts
FROM v_keyed_b b JOIN v_scope s ON s.repo = b.repo AND s.path = b.path
LEFT JOIN v_keyed_a a ON a.repo = b.repo AND a.path = b.path""")
def _(i):
    scope = S.recompute_scope(**scope_inputs(i))
    old = i.v_keyed_a.select("repo", "facts_key", F.concat(F.lit("old "), "path").alias("facts"))
    new = i.v_keyed_b.select("repo", "facts_key", F.concat(F.lit("new "), "path").alias("facts"))
    return S.carry_forward(i.v_keyed_a, i.v_keyed_b, scope, old, new)


@query("incremental_equals_cold", """
SELECT repo, facts_key, CAST(NULL AS STRING) AS side FROM v_keyed_b WHERE false""")
def _(i):
    scope = S.recompute_scope(**scope_inputs(i))
    cold = i.v_keyed_b.select("repo", "facts_key")
    refreshed = S.carry_forward(
        i.v_keyed_a, i.v_keyed_b, scope, i.v_keyed_a.select("repo", "facts_key"), cold
    )
    return S.differences(refreshed, cold)


@query("prune_file_facts", """
SELECT repo, facts_key, path FROM v_file_facts f WHERE EXISTS (SELECT 1 FROM v_keyed_b b WHERE b.facts_key = f.facts_key)""")
def _(i):
    return S.prune_file_facts(i.v_file_facts, i.v_keyed_b).select("repo", "facts_key", "path")


@query("pruned_count", """
SELECT CAST(count(*) AS BIGINT) AS pruned FROM v_file_facts f WHERE NOT EXISTS (SELECT 1 FROM v_keyed_b b WHERE b.facts_key = f.facts_key)""")
def _(i):
    return S.pruned_count(i.v_file_facts, i.v_keyed_b)


# Pointers by document: each worktree was on one state and moves to another.
VIEWS["v_pointers_before"] = """
SELECT repo, 'w' || CAST(doc_id AS STRING) AS worktree, CASE WHEN doc_id % 2 = 0 THEN 'worktree:' ELSE 'commit:' END ||
  CAST(doc_id % 40 AS STRING) AS tree_key FROM v_docs"""
VIEWS["v_pointers_after"] = """
SELECT repo, 'w' || CAST(doc_id AS STRING) AS worktree, CASE WHEN doc_id % 4 = 0 THEN 'worktree:' ELSE 'commit:' END ||
  CAST(CASE WHEN doc_id % 40 < 20 THEN doc_id % 40 + 1 ELSE doc_id % 40 END AS STRING) AS tree_key FROM v_docs"""
VIEWS["v_trees"] = """SELECT DISTINCT repo, tree_key FROM v_pointers_before UNION SELECT repo, tree_key FROM v_pointers_after"""


@query("retire", """
SELECT repo, tree_key FROM v_trees t WHERE starts_with(tree_key, 'worktree:')
  AND EXISTS (SELECT 1 FROM v_pointers_before b WHERE b.repo = t.repo AND b.tree_key = t.tree_key)
  AND NOT EXISTS (SELECT 1 FROM v_pointers_after a WHERE a.repo = t.repo AND a.tree_key = t.tree_key)""")
def _(i):
    return S.retired_trees(i.v_trees, i.v_pointers_before, i.v_pointers_after)


@query("set_worktree", """
SELECT repo, worktree, tree_key FROM v_pointers_after
UNION ALL SELECT repo, worktree, tree_key FROM v_pointers_before b WHERE NOT EXISTS (
  SELECT 1 FROM v_pointers_after a WHERE a.repo = b.repo AND a.worktree = b.worktree)""")
def _(i):
    old = i.v_pointers_before.withColumn("version", F.lit(1))
    new = i.v_pointers_after.withColumn("version", F.lit(2))
    return src.upsert(old, new, ["repo", "worktree"], "version").drop("version")


VIEWS["v_cache"] = """
SELECT repo, worktree AS branch, 'map' AS view_name, tree_key FROM v_pointers_before"""


@query("view_cache_current", """
SELECT c.repo, c.branch, c.tree_key, coalesce(c.tree_key = a.tree_key, false) AS "current"
FROM v_cache c LEFT JOIN v_pointers_after a ON a.repo = c.repo AND a.worktree = c.branch""")
def _(i):
    heads = i.v_pointers_after.withColumnRenamed("worktree", "branch")
    return S.view_cache_current(i.v_cache, heads).select("repo", "branch", "tree_key", "current")


@query("split_facts", """
SELECT repo, 'items' AS part, file AS delta_file, CAST(count(*) AS BIGINT) AS n FROM v_items GROUP BY ALL
UNION ALL SELECT l.repo, 'links', i.file, CAST(count(*) AS BIGINT) FROM v_links l JOIN v_items i ON i.repo = l.repo AND i.id = l."from" GROUP BY ALL
UNION ALL SELECT repo, 'entries', file, CAST(count(*) AS BIGINT) FROM v_entries GROUP BY ALL""")
def _(i):
    parts = S.split_facts(i.v_items, i.v_links, {"entries": i.v_entries})
    out = None
    for name, part in parts.items():
        one = part.groupBy("repo", F.lit(name).alias("part"), "delta_file").agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("split_round_trip", """SELECT repo, id, CAST(NULL AS STRING) AS side FROM v_items WHERE false""")
def _(i):
    links = i.v_links
    back = S.join_split(S.split_facts(i.v_items, links, {}))
    items = S.differences(back["items"], i.v_items).select("repo", "id", "side")
    return items.unionByName(S.differences(back["links"], links).select("repo", c("from").alias("id"), "side"))


# ---------------------------------------------------------------- sources and sinks, read back


def stored(i: Inputs, df, label: str, by):
    path = scratch_path(i.spark, label)
    src.write_partitioned(df, path, by)
    return path


@query("put_tree", """
SELECT 'file' AS what, repo, tree_key, path, facts_key FROM v_keyed_b
UNION ALL SELECT 'file', repo, tree_key, path, facts_key FROM v_keyed_a WHERE repo = 'alpha'
UNION ALL SELECT 'delta', repo, tree_key, path, facts_key FROM v_keyed_a WHERE repo = 'alpha'
UNION ALL SELECT DISTINCT 'commit', repo, tree_key, 'h', CAST(NULL AS STRING) FROM v_keyed_a WHERE repo = 'alpha'""")
def _(i):
    # Tree b, which has no deltas and no commits, replaces beta's tree a; alpha keeps both. Then a put stops before its entry.
    path = scratch_path(i.spark, "trees")
    cols = ["repo", "tree_key", "path", "facts_key"]
    old = i.v_keyed_a.select(*cols).withColumn("tree_key", F.when(c("repo") == "beta", "worktree:b").otherwise(c("tree_key")))
    new = i.v_keyed_b.select(*cols)
    commits = old.select("repo", "tree_key").distinct().withColumn("ord", F.lit(0)).withColumn("hash", F.lit("h"))
    src.put_tree(old, old.select("repo", "tree_key", "facts_key", "path"), commits, path)
    src.put_tree(new, new.select("repo", "tree_key", "facts_key", "path").limit(0), commits.limit(0), path)
    for table in src.TREE_TABLES:
        old.write.partitionBy("repo", "tree_key").parquet(f"{path}/{table}/version=stopped")
    keyed = "repo string,tree_key string,path string,facts_key string"
    files, deltas = (src.read_trees(i.spark, path, t, keyed).select(*cols) for t in ("tree_files", "file_facts"))
    hashes = src.read_trees(i.spark, path, "tree_commits", "repo string,tree_key string,ord int,hash string")
    hashes = hashes.select("repo", "tree_key", c("hash").alias("path"), F.lit(None).cast("string").alias("facts_key"))
    parts = [rows.select(F.lit(what).alias("what"), *cols) for what, rows in (("file", files), ("delta", deltas), ("commit", hashes))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("strangers", """
SELECT a.repo, a.path FROM v_keyed_a a WHERE NOT EXISTS (SELECT 1 FROM v_keyed_b b WHERE b.repo = a.repo AND b.path = a.path)""")
def _(i):
    return src.strangers(i.v_keyed_a, i.v_keyed_b, ["repo"]).select("repo", "path")


@query("put_file_facts", """
SELECT repo, path, CASE WHEN v2 IS NOT NULL THEN v2 ELSE v1 END AS file_hash FROM (
  SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path, a.file_hash AS v1, b.file_hash AS v2
  FROM v_files_a a FULL JOIN v_files_b b ON a.repo = b.repo AND a.path = b.path) x""")
def _(i):
    old = i.v_files_a.select("repo", "path", "file_hash", F.lit(1).alias("version"))
    new = i.v_files_b.select("repo", "path", "file_hash", F.lit(2).alias("version"))
    path = stored(i, src.upsert(old, new, ["repo", "path"], "version"), "deltas", ["repo"])
    return src.read_tree_tables(i.spark, path, "path string,file_hash string,version int,repo string").drop("version")


@query("delete_by_key", """
SELECT repo, path FROM v_files_a a WHERE NOT EXISTS (SELECT 1 FROM v_files_b b WHERE b.repo = a.repo AND b.path = a.path)""")
def _(i):
    return src.delete_by_key(i.v_files_a.select("repo", "path"), i.v_files_b.select("repo", "path"), ["repo", "path"])


@query("read_tree_tables", "SELECT repo, tree_key, path, file_hash FROM v_files_b WHERE tree_key = 'worktree:b'")
def _(i):
    both = i.v_files_a.unionByName(i.v_files_b).select("repo", "tree_key", "path", "file_hash")
    path = stored(i, both, "tree-files", ["tree_key"])
    schema = "repo string,path string,file_hash string,tree_key string"
    return src.read_tree_tables(i.spark, path, schema).filter(c("tree_key") == "worktree:b")


@query("read_file_facts", "SELECT repo, facts_key, id, file, line FROM v_delta_items")
def _(i):
    item = F.struct("id", "file", F.struct("line").alias("span"))
    text = F.to_json(F.struct("path", "file_hash", F.collect_list(item).alias("items")))
    stored_text = i.v_delta_items.groupBy("repo", "facts_key", "path", "file_hash").agg(text.alias("facts"))
    parsed = src.read_file_facts(stored_text)
    return parsed.select("repo", "facts_key", F.inline("items")).select("repo", "facts_key", "id", "file", c("span.line").alias("line"))


def documents_of(i: Inputs):
    """Fact documents made from the views: one JSON object per file, so a document holds one file's facts."""
    items = i.v_items.groupBy(*KEYS, "file").agg(F.collect_list(src.nested_item()).alias("items"))
    links = i.v_links.groupBy(*KEYS, "file").agg(F.collect_list(src.nested_link()).alias("links"))
    header = F.struct(c("repo").alias("name"), F.regexp_replace("tree_key", "^commit:", "").alias("commit")).alias("repo")
    return items.join(links, [*KEYS, "file"], "left").select(
        F.to_json(F.struct(F.lit(1).alias("schema_version"), header, "items", "links")).alias("value")
    )


def read_documents(i: Inputs):
    path = scratch_path(i.spark, "facts")
    documents_of(i).write.option("compression", "gzip").text(path)
    return src.read_facts(i.spark, path, lines=True)


@query("read_facts", """
SELECT repo, tree_key, id, kind, file, line, end_line, crate, module, visibility, reexported, entry, cfg FROM v_items""")
def _(i):
    return src.flat(read_documents(i), "items").select(
        "repo", "tree_key", "id", "kind", "file", "line", "end_line", "crate", "module", "visibility", "reexported",
        "entry", "cfg",
    )


@query("read_facts_links", """
SELECT repo, "from", target_kind, target_id, member, kind, confidence, file, line FROM v_links""")
def _(i):
    return src.flat(read_documents(i), "links").select(
        "repo", "from", "target_kind", "target_id", "member", "kind", "confidence", "file", "line"
    )


@query("write_canonical_facts", """
SELECT repo, 'items' AS part, id AS sort_key FROM v_items
UNION ALL SELECT repo, 'links', "from" || ' ' || target_kind || ' ' || target_id || ' ' || kind || ' ' || coalesce(member, '') FROM v_links""")
def _(i):
    path = scratch_path(i.spark, "canonical")
    none = F.lit("")
    items = i.v_items.select(*KEYS, F.array("id").alias("sort_key"), src.nested_item().alias("element"))
    links = i.v_links.select(
        *KEYS, F.array("from", "target_kind", "target_id", "kind", F.coalesce("member", none)).alias("sort_key"),
        src.nested_link().alias("element"),
    )
    src.write_canonical_facts({"items": items, "links": links}, path, compression="gzip")
    got = lambda e, p: F.get_json_object(e, f"$.{p}")
    e = c("element")
    back = src.read_canonical(i.spark, path, "items").select("repo", F.lit("items").alias("part"), got(e, "id").alias("sort_key"))
    kind = F.when(got(e, "to.item").isNotNull(), "item").when(got(e, "to.port").isNotNull(), "port").when(
        got(e, "to.external").isNotNull(), "external").otherwise("table")
    target = F.coalesce(*[got(e, f"to.{k}") for k in ("item", "port", "external", "table")])
    back_links = src.read_canonical(i.spark, path, "links").select(
        "repo", F.lit("links").alias("part"),
        F.concat_ws(" ", got(e, "from"), kind, target, got(e, "kind"), F.coalesce(got(e, "member"), none)).alias("sort_key"),
    )
    return back.unionByName(back_links)


@query("canonical_sort", """
SELECT repo, "from", target_kind, target_id, kind, member, line FROM v_links ORDER BY repo, "from", target_kind, target_id, kind, member""")
def _(i):
    return i.v_links.select("repo", "from", "target_kind", "target_id", "kind", "member", "line").orderBy(
        "repo", "from", "target_kind", "target_id", "kind", "member"
    )


# Each document is a file in one of these folders; the second list is left out of a scan.
SCANNED = ["src/a", "src/b/c", ".cargo", ".arch/x", "src/.arch"]
UNSCANNED = ["target/x", "src/target", "src/.cargo", ".git/x"]
_folders = ", ".join(f"({n}, '{f}', {str(n < len(SCANNED)).lower()})" for n, f in enumerate([*SCANNED, *UNSCANNED]))


@query("scan_files", f"""
SELECT k.folder, d.file_hash, CAST(count(*) AS BIGINT) AS files FROM v_files_a d JOIN (VALUES {_folders}) AS k(n, folder, seen)
  ON k.n = d.doc_id % {len(SCANNED) + len(UNSCANNED)} WHERE k.seen GROUP BY ALL""")
def _(i):
    path = scratch_path(i.spark, "scan")
    folders = [*SCANNED, *UNSCANNED]
    folder = F.get(F.array(*[F.lit(x) for x in folders]), (c("doc_id") % len(folders)).cast("int"))
    rows = i.v_files_a.select(folder.alias("folder"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("content"))
    src.write_files(rows.filter(c("folder").isNotNull()), path)
    listed = src.scan_files(i.spark, path)
    body = F.regexp_replace(F.decode("content", "UTF-8"), r"\n$", "")
    return listed.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.sha2(body, 256).alias("file_hash")).agg(F.count(F.lit(1)).alias("files"))


VIEWS["v_paths"] = """
SELECT repo, path, doc_id FROM v_docs
UNION ALL SELECT repo, '.git/' || path, doc_id FROM v_docs UNION ALL SELECT repo, 'target/' || path, doc_id FROM v_docs
UNION ALL SELECT repo, '.cargo/config.toml', doc_id FROM v_docs UNION ALL SELECT repo, source || '/migrations/' || CAST(doc_id AS STRING) || '.sql', doc_id FROM v_docs
UNION ALL SELECT repo, source || '/' || CAST(doc_id AS STRING) || '.sql', doc_id FROM v_docs UNION ALL SELECT repo, source || '/Cargo.toml', doc_id FROM v_docs
UNION ALL SELECT repo, source || '/target/Cargo.lock', doc_id FROM v_docs UNION ALL SELECT repo, source || '/.#Cargo.lock', doc_id FROM v_docs"""


@query("is_source_file", r"""
SELECT repo, path, doc_id, CASE WHEN path = '.cargo/config.toml' THEN true
  WHEN regexp_matches(path, '(^|/)[.]') OR starts_with(path, 'target/') THEN false
  ELSE path LIKE '%.rs' OR regexp_matches(path, '(^|/)migrations/.*[.]sql$') OR regexp_matches(path, '(^|/)Cargo[.](toml|lock)$') END AS source
FROM v_paths""")
def _(i):
    return i.v_paths.select("repo", "path", "doc_id", C.is_source_file(c("path")).alias("source"))


VIEWS["v_locks"] = """
SELECT repo, doc_id, '[[package]]' || chr(10) || 'name = "' || source || '-x"' || chr(10) || text || chr(10) || 'name = "' || lang || '"'
  || chr(10) || 'name = "' || source || '_x"' AS text FROM v_docs"""


@query("read_lock_packages", r"""
SELECT repo, doc_id, "key", arg_min(name, line) AS name, CAST(min(line) AS BIGINT) AS line FROM (
  SELECT repo, doc_id, n AS line, replace(regexp_extract(l, '^name = "([^"]*)"', 1), '-', '_') AS "key",
    regexp_extract(l, '^name = "([^"]*)"', 1) AS name
  FROM (SELECT repo, doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM v_locks) x
  WHERE regexp_matches(l, '^name = "[^"]+"')) y GROUP BY repo, doc_id, "key" """)
def _(i):
    return src.read_lock_packages(i.v_locks, ["repo", "doc_id"])


@query("drafts_by_age", """
SELECT user_id AS draft, max(ts) AS updated_at FROM events GROUP BY user_id ORDER BY 2, 1""")
def _(i):
    # Each event puts a draft again; the listing is by the last time.
    drafts = i.events.groupBy(c("user_id").alias("draft")).agg(F.max("ts").alias("updated_at"))
    return drafts.orderBy("updated_at", "draft")


@query("commit_history_order", """
SELECT 'w' || CAST(user_id AS STRING) AS branch, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS ord,
  sha256(CAST(event_id AS STRING)) AS hash FROM events""")
def _(i):
    from factloom.operators.ordered import numbered

    rows = i.events.select(F.concat(F.lit("w"), c("user_id").cast("string")).alias("branch"), "ts", "event_id")
    ranked = numbered(rows, ["branch"], ["ts", "event_id"], F.date_trunc("day", "ts"), "ord")
    return ranked.select("branch", "ord", F.sha2(c("event_id").cast("string"), 256).alias("hash")).orderBy("branch", "ord")
