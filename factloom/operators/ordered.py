"""Ordered picks that stay spread out when one key holds a large part of the rows.

"First wins" is ``min_by`` under ``groupBy``: it combines on the map side, so a hot key never gathers its
rows in one task. Running numbers and carried values work in two levels: inside chunks of a key, then over
the chunks' summaries, of which there are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["repo", "tree_key"]


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One whole row per key: the first in ``order``."""
    return _pick(df, keys, order, F.min_by)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One whole row per key: the last in ``order``."""
    return _pick(df, keys, order, F.max_by)


def _pick(df, keys, order, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chunk: Column, name: str
) -> DataFrame:
    """``row_number`` per key in ``order``; ``chunk`` must not fall along that order.

    Rows are ranked inside (key, chunk); each chunk then starts after the counts of the chunks before it.
    """
    rows = df.withColumn("_chunk", chunk)
    counts = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    ranked = rows.withColumn("_at", F.row_number().over(inside))
    return (
        ranked.join(starts, [*keys, "_chunk"])
        .withColumn(name, (F.col("_start") + F.col("_at")).cast("bigint"))
        .drop("_chunk", "_start", "_at")
    )


def carried(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: dict[str, Column],
) -> DataFrame:
    """For each row the last non-null value before it in ``order``, per key: an as-of lookup.

    The last value is taken inside (key, chunk); where the chunk has none yet, it comes from the last chunk
    before that has one.
    """
    rows = df.withColumn("_chunk", chunk)
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    # A struct keeps a carried null apart from no value; it is null when the row sets nothing.
    for name, value in values.items():
        rows = rows.withColumn(f"_set_{name}", value)
    local = rows
    for name in values:
        local = local.withColumn(f"_in_{name}", F.last(f"_set_{name}", ignorenulls=True).over(inside))
    last = rows.groupBy(*keys, "_chunk").agg(
        *[
            F.max_by(f"_set_{name}", F.when(F.col(f"_set_{name}").isNotNull(), F.struct(*order))).alias(f"_end_{name}")
            for name in values
        ]
    )
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    for name in values:
        last = last.withColumn(f"_pre_{name}", F.last(f"_end_{name}", ignorenulls=True).over(across))
    last = last.drop(*[f"_end_{name}" for name in values])
    out = local.join(last, [*keys, "_chunk"])
    for name in values:
        out = out.withColumn(name, F.coalesce(f"_in_{name}", f"_pre_{name}"))
    drop = [p + name for name in values for p in ("_set_", "_in_", "_pre_")]
    return out.drop("_chunk", *drop)
