"""Hard negatives by a secondary-sort shuffle.

A row is (id, vector, label). Components become floor(256 * x) as doubles, a score is the integer inner product of two
rows, and for one anchor higher scores come first, ties by the smaller id.

1. Anchors and rows are dealt to blocks of bounded size, and every block of anchors meets every block of rows once. In the
   first meeting a block names each anchor's first rows of the same label; the best of all blocks are its positives.
2. A positive's score p opens the window of scores from ``LOW`` / ``HIGH`` of p up to p. In the second meeting a block names
   the first rows of other labels in each window. No other pair can be an answer, so only these are shuffled.
3. Pairs are packed into 24-byte keys (anchor, descending score, id), dealt by anchor and sorted inside partitions by
   ``repartitionAndSortWithinPartitions``. One pass over a partition opens windows at positives and emits negatives; it
   keeps open windows and the first negatives of a run of equal scores, never an anchor's pairs.

Defined cases: rows with a null id, label or vector, or with a component that is null or not finite, take no part. Of rows
with one id the first by (label, vector) takes part, so repeated rows count once and no row is its own positive. Vectors of
different lengths are compared as if padded with zeros; an empty vector scores 0. Scores beyond a long count as its ends. A
positive with a negative score has no negative, for its window is empty. An anchor alone with its label has no positive and
no row. An empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import configure, materialize

POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100
#: Components that a block of rows and a block of anchors hold about, and scores worked on at a time.
ROW_BLOCK, ANCHOR_BLOCK, TILE = 1 << 18, 1 << 20, 1 << 20
#: Components that a row costs besides its own.
OVERHEAD = 16
_LONG, _SIGN = (1 << 63) - 1, 1 << 63
_KEY = ">QQQ"


def pack(anchor: int, score: int, row: int) -> bytes:
    """A key whose byte order is (anchor, descending score, id)."""
    return struct.pack(_KEY, anchor + _SIGN, _LONG - score, row + _SIGN)


def unpack(key: bytes) -> tuple[int, int, int]:
    anchor, score, row = struct.unpack(_KEY, key)
    return anchor - _SIGN, _LONG - score, row - _SIGN


def _anchor_hash(key: bytes) -> int:
    return zlib.crc32(key[:8])


def mine_sorted(pairs: Iterator[tuple[bytes, bool]], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score) from (key, is negative) in the order of keys."""
    anchor = run_score = None
    windows: list[list[int]] = []  # id, score and rows given, of windows that may still take one
    run: list[int] = []  # first negatives of the run of equal scores
    opened = 0
    for key, negative in pairs:
        a, score, row = unpack(key)
        if a != anchor:
            anchor, run_score, windows, opened = a, None, [], 0
        if score != run_score:
            run_score, run = score, []
            windows = [w for w in windows if low * w[1] <= high * score]
        if negative:
            if len(run) < negatives:
                run.append(row)
            for w in windows:
                w[2] += 1
                yield a, w[0], w[2], row, w[1], score
            windows = [w for w in windows if w[2] < negatives]
        elif opened < positives:
            opened += 1
            if low * score > high * score:
                continue
            # Negatives of the same score and a smaller id came before their positive.
            for rank, before in enumerate(run, 1):
                yield a, row, rank, before, score, score
            if len(run) < negatives:
                windows.append([row, score, len(run)])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """floor(256 * x) of a column of vectors, padded with zeros."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products: as doubles while these hold them and their hundredfold, else as whole numbers."""
    width = max(x.shape[1], y.shape[1])
    x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * width < 2.0**46:
        return x @ y.T
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(x).astype(object) @ whole(y).astype(object).T
    return np.minimum(np.maximum(exact, -_LONG - 1), _LONG)


def _firsts(scores: np.ndarray, wanted: np.ndarray, many: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line, column) of the largest wanted scores of each line; of equal ones the leftmost."""
    left = np.where(wanted, scores, -np.inf)
    lines = np.arange(len(left))
    for _ in range(min(many, left.shape[1])):
        at = left.argmax(axis=1)
        there = left[lines, at] != -np.inf
        if not there.any():
            return
        yield lines[there], at[there]
        left[lines, at] = -np.inf


def _block(anchors: pa.Table, rows: pa.Table, positives: int, negatives: int, low: int, high: int) -> pa.Table:
    """Pairs of one block of anchors and one of rows that may matter: of one label, or where anchors have windows, of others."""
    windowed = "windows" in anchors.schema.names
    rows = rows.sort_by("id")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(rows) and len(anchors):
        ids, labels, vectors = rows.column("id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("vector"))
        own, own_labels, own_vectors = anchors.column("of").to_numpy(), anchors.column("own").to_numpy(), _matrix(anchors.column("of_vector"))
        given = anchors.column("windows").to_pylist() if windowed else []
        for part in np.array_split(np.arange(len(own)), len(own) * len(ids) // TILE + 1):
            scores = _scores(own_vectors[part], vectors)
            same = own_labels[part][:, None] == labels
            if not windowed:
                picks = list(_firsts(scores, same & (own[part][:, None] != ids), positives))
            else:
                picks = []
                for i in range(positives):
                    # No window is at a score below zero.
                    top = np.array([given[k][i] if i < len(given[k]) else -1 for k in part], scores.dtype)[:, None]
                    inside = ~same & (scores <= top) & (high * scores >= low * top)
                    picks += _firsts(scores, inside.astype(bool) & (top >= 0).astype(bool), negatives)
            if picks:
                line, at = np.unique(np.array([np.concatenate(x) for x in zip(*picks, strict=True)]), axis=1)
                found.append((own[part][line], scores[line, at].astype(np.int64), ids[at]))
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("anchor", "score", "id"), columns, strict=True)))


def _meet(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], options: dict) -> DataFrame:
    """(anchor, score, id) of every block of anchors with every block of rows."""
    n_anchors, n_rows = blocks
    left = anchors.withColumn("ab", F.pmod(F.xxhash64("of"), F.lit(n_anchors))).withColumn("rb", F.explode(F.expr(f"sequence(0L, {n_rows - 1}L)")))
    right = rows.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(n_rows))).withColumn("ab", F.explode(F.expr(f"sequence(0L, {n_anchors - 1}L)")))
    block = partial(_block, **options)
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(lambda a, b: block(a, b), "anchor long, score long, id long")


def mine(
    rows: DataFrame, id: str, vector: str, label: str, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score): for each of the first ``positives`` rows of an
    anchor's label, the first ``negatives`` rows of other labels with ``low * positive <= high * negative <= high * positive``.

    ``anchors`` is a condition on the columns of ``rows``.
    """
    spark = configure(rows.sparkSession)
    options = {"positives": positives, "negatives": negatives, "low": low, "high": high}
    finite = F.forall(vector, lambda x: F.coalesce((~F.isnan(x)) & (F.abs(x.cast("double") * 256) < F.lit(float("inf"))), F.lit(False)))
    part = rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    part = part.select(F.col(id).cast("long").alias("id"), F.struct(F.col(label).alias("label"), F.col(vector).alias("vector")).alias("x"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    once = part.groupBy("id").agg(F.min("x").alias("x"), F.min_by("is_anchor", "x").alias("is_anchor"))
    known = materialize(once.select("id", "x.label", "x.vector", "is_anchor"), "vectors")
    size = F.size("vector") + F.lit(OVERHEAD)
    total, of_anchors = known.agg(F.sum(size), F.sum(F.when(F.col("is_anchor"), size))).first()
    blocks = int(of_anchors or 0) // ANCHOR_BLOCK + 1, int(total or 0) // ROW_BLOCK + 1
    vectors = known.select("id", "label", "vector")
    chosen = known.where("is_anchor").select(F.col("id").alias("of"), F.col("label").alias("own"), F.col("vector").alias("of_vector"))
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id")
    best = materialize(_meet(chosen, vectors, blocks, options).withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"), "positives")
    windows = best.groupBy(F.col("anchor").alias("of")).agg(F.collect_set(F.when(F.col("score") >= 0, F.col("score"))).alias("windows"))
    others = _meet(chosen.join(windows, "of"), vectors, blocks, options)
    pairs = materialize(best.withColumn("negative", F.lit(False)).unionByName(others.withColumn("negative", F.lit(True))), "pairs")
    keyed = pairs.rdd.map(lambda r: (pack(r.anchor, r.score, r.id), r.negative))
    dealt = keyed.repartitionAndSortWithinPartitions(int(spark.conf.get("spark.sql.shuffle.partitions")), _anchor_hash)
    out = dealt.mapPartitions(partial(mine_sorted, **options))
    return spark.createDataFrame(out, "anchor long, positive long, rank int, negative long, positive_score long, negative_score long", verifySchema=False)
