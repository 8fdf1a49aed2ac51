"""The call graph's views take every row of the given tables."""

from collections import defaultdict

from factloom.plans import load_catalog
from factloom.plans.views import view

load_catalog()


def test_calls_links_and_spawns_come_from_all_rows(spark, sf_dir):
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect():
        lines[r.l_orderkey].append((r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_quantity, r.l_extendedprice, r.l_shipdate))
    orders = [sorted(rows) for rows in lines.values()]
    pairs = {(x[1], y[1]) for rows in orders for x, y in zip(rows, rows[1:], strict=False) if x[1] != y[1]}
    assert {(r.a, r.b) for r in view(spark, sf_dir, "v_part_calls").collect()} == pairs
    assert {(r.a, r.b) for r in view(spark, sf_dir, "v_spawn_edges").collect()} == pairs
    calls = {repo: {(r["from"], r["to"]) for r in view(spark, sf_dir, "v_calls").filter(f"repo = '{repo}'").collect()} for repo in ("alpha", "beta")}
    assert len(calls["alpha"]) == len(pairs) and calls["beta"] == {(b, a) for a, b in calls["alpha"]}
    links = view(spark, sf_dir, "v_all_links")
    assert links.filter("repo = 'beta' AND member = 'call'").count() == len(pairs)
    assert links.exceptAll(view(spark, sf_dir, "v_few_links")).count() == 0
