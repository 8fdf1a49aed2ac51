"""Views for Spark give the rows of the same views in DuckDB, also of repeated and null rows, and only tables of numbers are written."""

import duckdb

from factloom.operators import graph
from factloom.plans import load_catalog, views
from factloom.plans.catalog import Inputs

TABLES = {
    "part": ("p_partkey bigint,p_type string,p_size int,p_brand string", [(1, "SMALL X", 3, "b"), (2, "PROMO Y", 4, "b"), (2, "PROMO Y", 4, "b"), (3, None, 5, "b"), (None, "SMALL", 1, "b"), (4, "LARGE::Z", 9, "b")]),
    "supplier": ("s_suppkey bigint,s_nationkey bigint", [(1, 7), (2, 8), (2, 9), (None, 1)]),
    "customer": ("c_custkey bigint,c_mktsegment string", [(1, "BUILDING"), (1, "BUILDING"), (2, "AUTO")]),
    "orders": ("o_orderkey bigint,o_custkey bigint,o_orderpriority string,o_orderstatus string", [(n, n % 3, f"{n % 5}-P", "FOP"[n % 3]) for n in range(40)] * 2 + [(None, 1, None, None), (5, None, "x", "F")]),
    "lineitem": (
        "l_orderkey bigint,l_partkey bigint,l_suppkey bigint,l_linenumber int,l_quantity double,l_extendedprice double,l_shipdate date,l_returnflag string",
        [(n // 4, n % 5, n % 3, n % 4, float(n % 7), 1.0, None, "ANR"[n % 3]) for n in range(200)] * 2 + [(None, 1, 1, None, None, None, None, None), (7, None, 2, 1, 1.0, 1.0, None, "A")]),
}


def test_views_of_numbers_give_the_rows_of_the_sql(spark, tmp_path):
    load_catalog()
    for name, (schema, given) in TABLES.items():
        spark.createDataFrame(given, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    inputs = Inputs(spark, str(tmp_path))
    for name in ("v_links", "v_calls", "v_all_links", "v_few_links"):
        df = getattr(inputs, name)
        cols = ", ".join(f'"{c}"' for c in df.columns)
        want = con.execute(views.duckdb_sql(f"SELECT {cols} FROM {name}")).fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())
    assert set(views.kept(spark, str(tmp_path))) == set(views.KEPT)


def test_calls_shuffle_no_columns_beside_their_order(spark, tmp_path):
    load_catalog()
    schema, given = TABLES["lineitem"]
    spark.createDataFrame(given, schema).createOrReplaceTempView("lineitem")
    calls, links = (spark.sql(views.SPARK_VIEWS[n]) for n in ("v_part_calls", "v_link_keys"))
    ordered = calls._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" in ordered and not any(n in ordered for n in ("l_suppkey AS", "l_quantity ASC", "l_extendedprice ASC", "l_shipdate ASC"))
    assert links.columns == ["supp", "part", "nth", "tag"]


def test_packed_links_keep_negative_and_null_numbers(spark, tmp_path):
    load_catalog()
    rows = [(o, 1, 1, n, 1.0, 1.0, None, f) for o in (None, -1499, -501, -500, -3, -1, 0, 499, 500, 1000) for n in (None, -2, -1, 0, 1, 2, 2**31 - 2) for f in ("A", "N", "R", None)]
    given = {**TABLES, "lineitem": (TABLES["lineitem"][0], rows)}
    con = duckdb.connect()
    for name, (schema, values) in given.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    df = Inputs(spark, str(tmp_path)).v_links
    cols = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(views.duckdb_sql(f"SELECT {cols} FROM v_links")).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())


def test_reach_within_a_module_keeps_unknown_modules_apart(spark):
    edges = spark.createDataFrame([("r", "t", a, b) for a, b in ["ab", "bc", "cx", "xd", "nm", "aa"]], "repo string,tree_key string,from string,to string")
    items = spark.createDataFrame([("r", "t", i, m) for i, m in [*((i, "m::k") for i in "abcd"), ("x", "o"), ("n", None), ("m", None)]], "repo string,tree_key string,id string,module string")
    starts = spark.createDataFrame([("r", "t", i) for i in ["a", "a", "c", "x", "n", "lost", None]], "repo string,tree_key string,node string")
    got = sorted((r["start"], r["node"]) for r in graph.reach_within_module(edges, items, starts).collect())
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("c", "c"), ("n", "n"), ("x", "x")]
