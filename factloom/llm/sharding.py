"""Shards of near equal bytes by a K-d tree over the documents' metadata, in built-in columns.

Every node of the tree holds a range of shards. A level splits all its nodes at once: each takes the dimension that is
widest in it (as a share of the whole table's width) and is cut at the weighted median, or, for an odd number of shards, at
the quantile that gives either side its share of bytes. Levels go on until a leaf is one shard of the target bytes.

A row's place along a dimension is a key of 63 bits: 15 of the dimension, 32 of the text's hash, 16 of the id's hash, and
then a row number that only repeated rows need. Medians are found digit by digit: one aggregation by (node, digit) of at
most 65,536 sums a node, of which the driver gets the digit that the median lies in, a row per node. So a dimension value
that holds a third of all bytes is cut inside, at a text, and a text that holds a third inside, at a document; equal texts
with equal metadata stay together wherever no cut falls into them. Rows are never moved for it: a node number follows from
a row's keys and the cuts.

Defined cases: a null text has no bytes and size 1; null metadata is a value of its own; of widths that are equal the first
dimension is taken; an empty table gives an empty one; repeated rows are rows, and which of equal rows gets which slot is
left open; further columns are not read. Slots of a shard are numbered in chunks of it; rows of one id fall in one chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ordered import numbered
from factloom.session import configure, materialize

#: Rows of a shard that are numbered by one task, about.
CHUNK_ROWS = 20_000
COORDINATE_BITS, TEXT_BITS, ID_BITS, ROW_BITS = 15, 32, 16, 16
#: How far each digit of a key is shifted, from the first.
SHIFTS = (48, 32, 16, 0)


def text_coordinate(name: str) -> Column:
    """Place of a string along a dimension without an order: by hash; null first."""
    return F.coalesce(1 + F.pmod(F.xxhash64(name), F.lit((1 << COORDINATE_BITS) - 1)), F.lit(0))


def number_coordinate(name: str) -> Column:
    """Place of a count on a logarithmic scale: its power of two and the nine bits below; null and less than one first."""
    n = f"CAST(`{name}` AS BIGINT)"
    power = f"(length(bin({n})) - 1)"
    rest = f"({n} - shiftleft(1L, {power}))"
    return F.expr(f"CASE WHEN {n} >= 1 THEN {power} * 512 + IF({power} > 9, shiftright({rest}, {power} - 9), shiftleft({rest}, 9 - {power})) ELSE 0L END")


#: Column and what gives its place, in the order in which equal widths are decided.
DIMENSIONS = {"source": text_coordinate, "lang": text_coordinate, "n_chars": number_coordinate}


def metadata(docs: DataFrame, dimensions: dict[str, Callable[[str], Column]] = DIMENSIONS) -> DataFrame:
    """(doc_id, size, text_crc32, keys, row): what the tree needs of each document, written once."""
    text = F.coalesce("text", F.lit(""))
    tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), 32), 16).bitwiseOR(F.shiftrightunsigned(F.xxhash64("doc_id"), 48))
    keys = F.array(*[F.shiftleft(place(name).cast("long"), TEXT_BITS + ID_BITS).bitwiseOR(tie) for name, place in dimensions.items()])
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        keys.alias("keys"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("row"),
    )
    return materialize(rows, "shard-keys")


def _of_node(values: list[int]) -> Column:
    """The value for the node of a row; a constant array with a value per shard."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), F.col("node").cast("int") + 1)


def _medians(sums: DataFrame, by: list[str], targets: list[int] | None, parts: list[tuple[int, int]]) -> list:
    """In each group of (digit, s, n): the digit in which the running sum passes the target, with the sum before it, the
    group's least and largest digit and its total. The target is given per node, or the left side's share of the total."""
    along = Window.partitionBy(*by).orderBy("digit")
    whole = Window.partitionBy(*by)
    rows = sums.withColumn("before", F.sum("s").over(along) - F.col("s")).withColumn("total", F.sum("s").over(whole))
    rows = rows.withColumn("least", F.min("digit").over(whole)).withColumn("most", F.max("digit").over(whole))
    if targets is None:
        # Whole numbers, in an order that can't overflow.
        left, all_parts = _of_node([a for a, _ in parts]), _of_node([max(b, 1) for _, b in parts])
        rest = F.col("total") % all_parts
        target = ((F.col("total") - rest) / all_parts).cast("long") * left + F.floor(rest * left / all_parts)
    else:
        target = _of_node(targets)
    rows = rows.withColumn("target", target)
    return rows.where("before <= target AND target < before + s").select(*by, "digit", "s", "n", "before", "target", "least", "most").collect()


def _split(rows: DataFrame, ends: dict[int, int], widths: list[int] | None, shards: int) -> tuple[DataFrame, dict[int, int], list[int]]:
    """One level: nodes (first shard to the shard after the last) of more than one shard are cut in two."""
    parts = [(0, 0)] * shards
    for node, end in ends.items():
        if end - node > 1:
            parts[node] = ((end - node) // 2, end - node)
    open_ = _of_node([int(b > 0) for _, b in parts]) == 1
    live = rows.where(open_)
    # The first digit of all dimensions at once: it gives their widths and the median's place on each.
    first = live.select("node", "size", F.posexplode(F.transform("keys", lambda k: F.shiftright(k, SHIFTS[0]))).alias("dimension", "digit"))
    found = _medians(first.groupBy("node", "dimension", "digit").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")), ["node", "dimension"], None, parts)
    if widths is None:
        widths = [max((r.most - r.least for r in found if r.dimension == d), default=0) for d in range(max((r.dimension for r in found), default=0) + 1)]
    chosen = {}
    for r in sorted(found, key=lambda r: r.dimension):
        wide = (r.most - r.least) / max(widths[r.dimension], 1)
        if r.node not in chosen or wide > chosen[r.node][0]:
            chosen[r.node] = (wide, r)
    dimension = [int(chosen[n][1].dimension) if n in chosen else 0 for n in range(shards)]
    prefix = [int(chosen[n][1].digit) if n in chosen else -1 for n in range(shards)]
    before = [int(chosen[n][1].before) if n in chosen else 0 for n in range(shards)]
    target = [int(chosen[n][1].target) if n in chosen else 0 for n in range(shards)]
    key = F.element_at("keys", _of_node(dimension).cast("int") + 1)
    below = lambda digit, inside: live.where(inside).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    left = lambda: [t - b for t, b in zip(target, before, strict=True)]
    for wide_shift, shift in zip(SHIFTS[:-1], SHIFTS[1:], strict=True):
        sums = below(F.shiftright(key, shift).bitwiseAND(F.lit(0xFFFF)), F.shiftright(key, wide_shift) == _of_node(prefix))
        last = {r.node: r for r in _medians(sums, ["node"], left(), parts)}
        for n, r in last.items():
            prefix[n] = (prefix[n] << 16) | int(r.digit)
            before[n] += int(r.before)
    row_cut = [0] * shards
    repeated = any(r.n > 1 for r in last.values())
    if repeated:
        last = {r.node: r for r in _medians(below(F.col("row"), key == _of_node(prefix)), ["node"], left(), parts)}
    for n, r in last.items():
        # What is at the median goes to the side that comes closer to its share.
        short = target[n] - before[n] - (int(r.before) if repeated else 0)
        over = 2 * short > int(r.s)
        if repeated:
            row_cut[n] = int(r.digit) + over
        else:
            prefix[n] += over
    at, row_at = _of_node(prefix), _of_node(row_cut)
    middle = [n + a for n, (a, _) in enumerate(parts)]
    right = open_ & ((key > at) | ((key == at) & (F.col("row") >= row_at)))
    # Written, for a node number in terms of all cuts above would be evaluated anew in each filter.
    rows = materialize(rows.withColumn("node", F.when(right, _of_node(middle).cast("int")).otherwise(F.col("node"))), "shard-nodes")
    for n in [n for n, (_, b) in enumerate(parts) if b]:
        ends[middle[n]], ends[n] = ends[n], middle[n]
    return rows, ends, widths


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: dict[str, Callable[[str], Column]] = DIMENSIONS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document: so many shards, or as many as the target bytes ask for."""
    configure(docs.sparkSession)
    rows = metadata(docs, dimensions)
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if shards is None:
        if not target_bytes:
            raise ValueError("give the number of shards or the target bytes")
        shards = max(1, -(-(total or 0) // target_bytes))
    tree = rows.withColumn("node", F.lit(0))
    ends, widths = {0: shards}, None
    while max(end - node for node, end in ends.items()) > 1:
        tree, ends, widths = _split(tree, ends, widths, shards)
    placed = tree.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), F.xxhash64("doc_id").alias("h"))
    chunk = F.pmod("h", F.lit(n // (shards * CHUNK_ROWS) + 1))
    slots = numbered(placed, ["shard"], ["h", "doc_id", "text_crc32", "size"], chunk, "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))
