"""Connected components of a link table by star contraction; no task and no driver holds the whole graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize

#: Links that one local contraction holds at most.
LOCAL = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over bounded runs of links: each node's link to the smallest node of its local group."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > LOCAL:
            yield flush()
    yield flush()


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. Edges go from the larger node u to the smaller v."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionAll(small).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (u, v); root is the component's smallest node."""
    edges = materialize(links.where("u != v").mapInArrow(_contract, "u long, v long"), "links")
    mark = None
    while True:
        n, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == mark or not n:
            break
        mark = (n, total)
        parts = n // LOCAL + 1
        edges = materialize(_stars(edges.repartition(parts).mapInArrow(_contract, "u long, v long")), "links")
    rows = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rows.unionAll(rows.select(F.col("root").alias("node"), "root").distinct())
