"""Views that give the given tables the shape of code facts; the same SQL runs in Spark and in DuckDB.

Two repos hold the same items; ``alpha`` holds two thirds of the links, so one key is hot.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from factloom.session import scratch_path

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

KIND_CASE = """CASE (l_orderkey + l_linenumber) % 22
    WHEN 0 THEN 'calls' WHEN 1 THEN 'calls-port' WHEN 2 THEN 'depends-on-port' WHEN 3 THEN 'hands-off'
    WHEN 4 THEN 'listens-to' WHEN 5 THEN 'calls-out' WHEN 6 THEN 'wires' WHEN 7 THEN 'routes'
    WHEN 8 THEN 'implements' WHEN 9 THEN 'refines' WHEN 10 THEN 'inherits' WHEN 11 THEN 'uses-type'
    WHEN 12 THEN 'holds' WHEN 13 THEN 'constructs' WHEN 14 THEN 'matches-on' WHEN 15 THEN 'reads'
    WHEN 16 THEN 'queues' WHEN 17 THEN 'tests' WHEN 18 THEN 're-exports' WHEN 19 THEN 'expands'
    WHEN 20 THEN 'decorates' ELSE 'refers-to' END"""

VIEWS: dict[str, str] = {}

VIEWS["v_base_items"] = """
SELECT p_partkey AS num, lower(p_type) AS top, 'c' || CAST(p_partkey % 3 AS STRING) AS child, 'part' AS crate,
  'p' || CAST(p_partkey AS STRING) AS name, p_size AS extent,
  CASE p_partkey % 10 WHEN 0 THEN 'trait' WHEN 1 THEN 'struct' WHEN 2 THEN 'enum' WHEN 3 THEN 'const' ELSE 'fn' END AS kind
FROM part
UNION ALL
SELECT s_suppkey, 'supp', 'n' || CAST(s_nationkey AS STRING), 'supp', 's' || CAST(s_suppkey AS STRING), 10,
  CASE WHEN s_suppkey % 4 = 0 THEN 'struct' ELSE 'fn' END FROM supplier
UNION ALL
SELECT c_custkey, 'cust', lower(c_mktsegment), 'cust', 'u' || CAST(c_custkey AS STRING), 10,
  CASE WHEN c_custkey % 4 = 0 THEN 'trait' ELSE 'struct' END FROM customer"""

VIEWS["v_repo_items"] = """
SELECT crate || '::' || top || '::' || child || '::' || name || '#' || kind AS id, kind, name, crate,
  top || '::' || child AS module, top, child,
  'src/' || top || '/' || child || '/f' || CAST(num % 20 AS STRING) || '.rs' AS file,
  CAST(num % 500 + 1 AS BIGINT) AS line, CAST(1 AS BIGINT) AS col, CAST(num % 500 + 1 + extent AS BIGINT) AS end_line,
  CASE WHEN num % 50 = 0 THEN 'all(test, unix)' WHEN num % 7 = 0 THEN 'feature = testing' END AS cfg,
  CASE num % 3 WHEN 0 THEN 'pub' WHEN 1 THEN 'crate' ELSE 'private' END AS visibility,
  num % 97 = 0 AS entry, num % 41 = 0 AS reexported, CAST(num AS BIGINT) AS pos
FROM v_base_items"""

VIEWS["v_items"] = """
SELECT 'alpha' AS repo, 'commit:alpha' AS tree_key, * FROM v_repo_items
UNION ALL SELECT 'beta', 'commit:beta', * FROM v_repo_items"""

VIEWS["v_part_ids"] = """
SELECT p_partkey AS num, i.id AS id, i.file AS file, i.kind AS kind, i.module AS module
FROM part JOIN v_repo_items i ON i.crate = 'part' AND i.pos = p_partkey"""

VIEWS["v_links"] = f"""
SELECT DISTINCT * FROM (
SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'beta' ELSE 'alpha' END AS repo,
  CASE WHEN l_orderkey % 3 = 0 THEN 'commit:beta' ELSE 'commit:alpha' END AS tree_key,
  s.id AS "from", 'item' AS target_kind, p.id AS target_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 'm' || CAST(l_linenumber AS STRING) END AS member, {KIND_CASE} AS kind,
  CASE l_returnflag WHEN 'A' THEN 'resolved' WHEN 'N' THEN 'guessed' ELSE 'declared' END AS confidence,
  s.file AS file, CAST(l_orderkey % 500 + 1 AS BIGINT) AS line
FROM lineitem
JOIN v_repo_items s ON s.crate = 'supp' AND s.pos = l_suppkey
JOIN v_repo_items p ON p.crate = 'part' AND p.pos = l_partkey
UNION ALL
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'beta' ELSE 'alpha' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'commit:beta' ELSE 'commit:alpha' END,
  c.id, CASE o_orderkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'port' ELSE 'external' END,
  CASE o_orderkey % 4 WHEN 0 THEN 't' || CAST(o_orderkey % 5 AS STRING)
    WHEN 1 THEN 'port:http:' || o_orderpriority WHEN 2 THEN 'external:crate:Brand#' || CAST(o_orderkey % 25 + 1 AS STRING)
    ELSE 'external:http:' || o_orderpriority END,
  CAST(NULL AS STRING), CASE o_orderkey % 4 WHEN 0 THEN 'reads' ELSE 'calls-out' END,
  CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'guessed' ELSE 'declared' END,
  c.file, CAST(o_orderkey % 500 + 1 AS BIGINT)
FROM orders JOIN v_repo_items c ON c.crate = 'cust' AND c.pos = o_custkey) x"""

VIEWS["v_part_calls"] = """
SELECT DISTINCT a, b FROM (
SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_shipdate) AS b FROM lineitem) x
WHERE b IS NOT NULL AND a <> b"""

VIEWS["v_calls"] = """
SELECT 'alpha' AS repo, 'commit:alpha' AS tree_key, x.id AS "from", y.id AS "to"
FROM v_part_calls c JOIN v_part_ids x ON x.num = c.a JOIN v_part_ids y ON y.num = c.b
UNION ALL
SELECT 'beta', 'commit:beta', y.id, x.id
FROM v_part_calls c JOIN v_part_ids x ON x.num = c.a JOIN v_part_ids y ON y.num = c.b"""

VIEWS["v_parts"] = """SELECT * FROM v_items WHERE crate = 'part'"""

VIEWS["v_repos"] = """
SELECT * FROM (VALUES ('alpha', 'commit:alpha'), ('beta', 'commit:beta')) AS t(repo, tree_key)"""

VIEWS["v_externals_1"] = """
SELECT DISTINCT 'external:http:' || o_orderpriority AS id, o_orderpriority AS name, 'http' AS kind FROM orders
UNION ALL SELECT DISTINCT 'external:crate:' || p_brand, p_brand, 'crate' FROM part"""
VIEWS["v_externals"] = """
SELECT 'alpha' AS repo, 'commit:alpha' AS tree_key, * FROM v_externals_1
UNION ALL SELECT 'beta', 'commit:beta', * FROM v_externals_1 WHERE name <> '5-LOW'"""

VIEWS["v_ports_1"] = """
SELECT DISTINCT 'port:http:' || o_orderpriority AS id, o_orderpriority AS name,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'declared' ELSE 'http' END AS kind, 'driven' AS side,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'events' WHEN '2' THEN 'third-party' WHEN '3' THEN 'data-stores'
    WHEN '4' THEN 'libraries' ELSE 'os' END AS section,
  'external:http:' || o_orderpriority AS external, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS pos FROM orders
UNION ALL
SELECT DISTINCT 'port:http:' || r_name, r_name, 'http', 'driving', 'unresolved', CAST(NULL AS STRING),
  CAST(10 + r_regionkey AS BIGINT) FROM region"""
VIEWS["v_ports"] = """
SELECT 'alpha' AS repo, 'commit:alpha' AS tree_key, * FROM v_ports_1
UNION ALL SELECT 'beta', 'commit:beta', * FROM v_ports_1"""

VIEWS["v_entries"] = """SELECT repo, tree_key, id AS item, 'main' AS kind, file, line FROM v_items WHERE entry"""

VIEWS["v_areas"] = """
SELECT repo, CAST(ord AS INT) AS ord, name, side, CAST(area_order AS INT) AS area_order, CAST(path_pos AS INT) AS path_pos, "glob"
FROM (VALUES
  ('alpha', 1, 'billing', 'domain', 1, 0, 'src/standard/c0/**'),
  ('alpha', 2, 'catalog', 'domain', 2, 0, 'src/standard/**'),
  ('alpha', 2, 'catalog', 'domain', 2, 1, 'src/promo/**'),
  ('alpha', 3, 'stores', 'driven', 1, 0, 'src/{medium,large}/**'),
  ('alpha', 4, 'web', 'driving', 1, 0, 'src/supp/n?/**'),
  ('alpha', 5, 'suppliers', 'driving', NULL, 0, 'src/supp/**'),
  ('alpha', 6, 'accounts', NULL, NULL, 0, 'src/cust/[bf]*.rs'),
  ('beta', 1, 'core', 'domain', 1, 0, '**/c1/**'),
  ('beta', 2, 'edge', 'driving', 1, 0, 'src/supp/**'),
  ('beta', 2, 'edge', 'driving', 1, 1, 'src/cust/*'),
  ('beta', 3, 'rest', 'driven', 1, 0, 'src/**/f[0-9].rs')
) AS t(repo, ord, name, side, area_order, path_pos, "glob")"""

# The same globs as regexes, written by hand for the checks.
VIEWS["v_area_re"] = """
SELECT * FROM (VALUES
  ('alpha', 1, 'billing', 'domain', '^src/standard/c0/.*$'),
  ('alpha', 2, 'catalog', 'domain', '^src/(standard|promo)/.*$'),
  ('alpha', 3, 'stores', 'driven', '^src/(medium|large)/.*$'),
  ('alpha', 4, 'web', 'driving', '^src/supp/n./.*$'),
  ('alpha', 5, 'suppliers', 'driving', '^src/supp/.*$'),
  ('alpha', 6, 'accounts', NULL, '^src/cust/[bf].*[.]rs$'),
  ('beta', 1, 'core', 'domain', '^(.*/)?c1/.*$'),
  ('beta', 2, 'edge', 'driving', '^src/(supp|cust)/.*$'),
  ('beta', 3, 'rest', 'driven', '^src/(.*/)?f[0-9][.]rs$')
) AS t(repo, ord, name, side, re)"""

VIEWS["v_rule_targets"] = """
SELECT * FROM (VALUES
  ('alpha', 1, 'domain', 'depend-on', 'block', 0, 'driving'), ('alpha', 1, 'domain', 'depend-on', 'block', 1, 'driven'),
  ('alpha', 2, 'driving', 'depend-on', 'block', 0, 'billing'), ('alpha', 2, 'driving', 'depend-on', 'block', 1, 'driven'),
  ('alpha', 3, 'suppliers', 'depend-on', 'warn', 0, 'catalog'), ('alpha', 3, 'suppliers', 'depend-on', 'warn', 1, 'domain'),
  ('alpha', 4, 'accounts', 'depend-on', 'block', 0, 'externals'),
  ('alpha', 5, 'web', 'use', 'block', 0, 'domain'),
  ('beta', 1, 'edge', 'depend-on', 'block', 0, 'core'), ('beta', 1, 'edge', 'depend-on', 'block', 1, 'externals'),
  ('beta', 2, 'driving', 'depend-on', 'warn', 0, 'driven')
) AS t(repo, ord, subject, must_not, level, target_pos, target)"""

VIEWS["v_allows"] = """
SELECT * FROM (VALUES
  ('alpha', 1, 'src/supp/n12/f7.rs:10', 'driving must not depend-on driven', NULL, 'old call', 'ann'),
  ('alpha', 2, 'src/cust/building/f1.rs::u81', 'accounts must not depend-on externals', NULL, 'root user', 'ben'),
  ('alpha', 3, 'cust::cust::building::u11#struct', 'accounts must not depend-on externals', 'external:http:1-URGENT', 'by id', 'cyd'),
  ('alpha', 4, 'src/supp/n12/f7.rs::s7', 'suppliers must not depend-on catalog', 'src/promo/c0/f10.rs', 'prefix', 'dan'),
  ('alpha', 5, 'src/supp/n12/f7.rs::s7', 'driving must not depend-on driven', NULL, 'whole site', 'ann'),
  ('alpha', 6, 'src/supp/n0/f15.rs:105', 'driving must not depend-on driven', NULL, 'old call', 'fay'),
  ('alpha', 7, 'src/cust/building/f0.rs::u1120', 'accounts must not depend-on externals', NULL, 'one user', 'gus'),
  ('alpha', 8, 'cust::cust::building::u1002#struct', 'accounts must not depend-on externals', 'external:http:1-URGENT', 'by id', 'hal'),
  ('alpha', 9, 'src/supp/n10/f18.rs::s38', 'suppliers must not depend-on catalog', 'src/promo/c0/f0.rs', 'prefix', 'ida'),
  ('beta', 2, 'src/supp/n0/f15.rs::s75', 'edge must not depend-on core', NULL, 'one site', 'jon'),
  ('beta', 1, 'src/supp/n8/f6.rs::s6', 'edge must not depend-on core', NULL, 'one site', 'eve')
) AS t(repo, ord, site, rule, target, reason, "by")"""


def _needed(sql: str, views: dict[str, str], given: Sequence[str]) -> list[str]:
    """Names of the views ``sql`` reads, in an order that defines each before its use; those ``given`` are tables."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z0-9_]+\b", text):
            if name in views and name not in out and name not in given:
                visit(views[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def duckdb_sql(body: str, views: dict[str, str] = VIEWS, given: Sequence[str] = ()) -> str:
    """``body`` with the views it reads in front, as one statement for DuckDB."""
    needed = _needed(body, views, given)
    readers = [body, *(views[name] for name in needed)]
    # Views that are read more than once are worked out once.
    kept = {name for name in needed if sum(len(re.findall(rf"\b{name}\b", x)) for x in readers) > 1}
    ctes = [f"{name} AS {'MATERIALIZED ' * (name in kept)}({views[name]})" for name in needed]
    rest = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", body, count=1, flags=re.I)
    if rest != body:
        return "WITH RECURSIVE " + ",\n".join([*ctes, rest.strip()])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()


# The same rows for Spark, joined on numbers as long as possible. A repeated link is dropped while it is still numbers (an id
# tells its number, so equal links have equal numbers), and what is drawn in both repos is joined once.
KIND_OF_TAG = KIND_CASE.replace("(l_orderkey + l_linenumber) % 22", "tag DIV 2 % 22")
SPARK_VIEWS: dict[str, str] = {}

# A link's small numbers are one: the repo (2), the kind (22), the confidence (3) and the line, -498 to 500 or null (1000).
SPARK_VIEWS["v_link_keys"] = """
SELECT DISTINCT l_suppkey AS supp, l_partkey AS part, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS nth,
  CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END
  + 2 * CASE WHEN (l_orderkey + l_linenumber) % 22 BETWEEN 0 AND 20 THEN CAST((l_orderkey + l_linenumber) % 22 AS INT) ELSE 21 END
  + 44 * CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END
  + 132 * coalesce(CAST(l_orderkey % 500 + 499 AS INT), 999) AS tag
FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL"""

# Rows alike in line number and part are alike in all that the order tells, so no other column is shuffled.
SPARK_VIEWS["v_part_calls"] = """
SELECT DISTINCT a, b FROM (
SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) x
WHERE b IS NOT NULL AND a <> b"""

SPARK_VIEWS["v_order_keys"] = """
SELECT DISTINCT o_custkey AS cust, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS beta,
  CASE o_orderkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'port' ELSE 'external' END AS target_kind,
  CASE o_orderkey % 4 WHEN 0 THEN 't' || CAST(o_orderkey % 5 AS STRING)
    WHEN 1 THEN 'port:http:' || o_orderpriority WHEN 2 THEN 'external:crate:Brand#' || CAST(o_orderkey % 25 + 1 AS STRING)
    ELSE 'external:http:' || o_orderpriority END AS target_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'reads' ELSE 'calls-out' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'guessed' ELSE 'declared' END AS confidence,
  CAST(o_orderkey % 500 + 1 AS INT) AS line
FROM orders WHERE o_custkey IS NOT NULL"""

SPARK_VIEWS["v_links"] = f"""
SELECT CASE tag % 2 WHEN 1 THEN 'beta' ELSE 'alpha' END AS repo, CASE tag % 2 WHEN 1 THEN 'commit:beta' ELSE 'commit:alpha' END AS tree_key,
  s.id AS "from", 'item' AS target_kind, p.id AS target_id, CASE WHEN nth IS NOT NULL THEN 'm' || CAST(nth AS STRING) END AS member,
  {KIND_OF_TAG} AS kind, CASE tag DIV 44 % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'guessed' ELSE 'declared' END AS confidence,
  s.file AS file, nullif(tag DIV 132 - 498, 501) AS line
FROM v_link_keys l
JOIN (SELECT DISTINCT pos, id FROM v_repo_items WHERE crate = 'part') p ON p.pos = l.part
JOIN (SELECT DISTINCT pos, id, file FROM v_repo_items WHERE crate = 'supp') s ON s.pos = l.supp
UNION ALL
SELECT CASE beta WHEN 1 THEN 'beta' ELSE 'alpha' END, CASE beta WHEN 1 THEN 'commit:beta' ELSE 'commit:alpha' END,
  c.id, o.target_kind, o.target_id, CAST(NULL AS STRING), o.kind, o.confidence, c.file, CAST(o.line AS BIGINT)
FROM v_order_keys o JOIN (SELECT DISTINCT pos, id, file FROM v_repo_items WHERE crate = 'cust') c ON c.pos = o.cust"""

SPARK_VIEWS["v_calls"] = """
SELECT repo, 'commit:' || repo AS tree_key, CASE repo WHEN 'alpha' THEN a ELSE b END AS "from", CASE repo WHEN 'alpha' THEN b ELSE a END AS "to" FROM (
  SELECT x.id AS a, y.id AS b FROM v_part_calls c JOIN v_part_ids x ON x.num = c.a JOIN v_part_ids y ON y.num = c.b) z
LATERAL VIEW explode(array('alpha', 'beta')) e AS repo"""

SPARK_VIEWS["v_all_links"] = """
SELECT repo, tree_key, "from", target_kind, target_id, member, kind, confidence, file, line FROM v_links
UNION ALL SELECT r.repo, r.tree_key, "from", 'item', target_id, 'call', kind, r.confidence, file, line FROM v_call_links_1
  LATERAL VIEW inline(array(named_struct('repo', 'alpha', 'tree_key', 'commit:alpha', 'confidence', 'resolved'),
    named_struct('repo', 'beta', 'tree_key', 'commit:beta', 'confidence', 'guessed'))) r AS repo, tree_key, confidence"""

#: Tables of numbers that the wide views are joined from, and small ones: written once per session and folder.
KEPT = ["v_link_keys", "v_part_calls", "v_part_ids"]

# Where they are: (path, schema).
_STORED: dict[tuple[str, str, str], tuple] = {}


def kept(spark: SparkSession, sf_dir: str) -> list[str]:
    """Views that are tables by now, or are made so on first use."""
    made = [name for app, folder, name in _STORED if (app, folder) == (spark.sparkContext.applicationId, sf_dir)]
    return [*KEPT, *(name for name in made if name not in KEPT)]


def view(spark: SparkSession, sf_dir: str, name: str, keep: bool = False) -> DataFrame:
    """One of the views, or a given table, as a DataFrame.

    Only ``KEPT`` views, and those to ``keep`` as a query reads them several times, are written. The others are plans, so
    that a query joins and shuffles the columns and rows it needs.
    """
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not keep and name not in kept(spark, sf_dir):
        return spark_sql(spark, sf_dir, f"SELECT * FROM {name}")
    made = (spark.sparkContext.applicationId, sf_dir, name)
    if made not in _STORED:
        df = spark_sql(spark, sf_dir, SPARK_VIEWS[name] if name in SPARK_VIEWS else VIEWS[name])
        path = scratch_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        _STORED[made] = (path, df.schema)
    path, schema = _STORED[made]
    return spark.read.schema(schema).parquet(path)


def spark_sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """Run ``body`` over the views in Spark."""
    given = kept(spark, sf_dir)
    text = duckdb_sql(body, {**VIEWS, **SPARK_VIEWS}, given).replace(" AS MATERIALIZED (", " AS (")
    for table in [*TABLES, *given]:
        if re.search(rf"\b{table}\b", text):
            view(spark, sf_dir, table).createOrReplaceTempView(table)
    if "sha256(" in text:
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sha256(x STRING) RETURNS STRING RETURN sha2(x, 256)")
    return spark.sql(re.sub(r'"([A-Za-z_]+)"', r"`\1`", text))
