"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z in lower case, runs of white space as one) and hashed. For each host and line the distinct
documents that hold it are counted, copies as one. A line above the limit is boilerplate and is removed; a document that
then keeps too few of its words is depleted and rejected.

Copies are the same text, and near copies: texts whose 5-word shingles (A-Z in lower case) are similar by ``SIMILAR``, and
what such pairs connect. Texts that share a bucket of a few of ``SKETCH`` min-hashes are compared with the bucket's first or
last text only, so a large group makes as many pairs as it has members. The min-hashes estimate the similarity; where the
estimate is within ``DOUBT`` of the limit, the whole sets of shingles are compared. Only texts that hold a line above the
limit are compared. Pages that share a passage are no copies, however many they are.

Defined cases: null text is empty, with all counts 0 and rejected; a null host is the host ''; repeated rows get equal
rows; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import words as W
from factloom.llm.components import components
from factloom.llm.jaccard import shingle_sets
from factloom.session import configure, materialize

SHINGLE = 5
#: A line held by more distinct documents of its host than this is removed.
MAX_DOCS = 40
#: A document that keeps less than this share of its words is rejected.
MIN_LEFT = 0.3
#: Share of equal min-hashes from which two texts are near copies, and the number of min-hashes (two bytes each).
SIMILAR, SKETCH = 0.75, 128
#: Three standard deviations of the estimate at the limit.
DOUBT = 3 * (SIMILAR * (1 - SIMILAR) / SKETCH) ** 0.5
#: Doubtful texts up to which their keys (eight bytes each) are broadcast, so that no other text is shuffled; beyond, all are joined.
LOOKUP = 1_000_000
#: (first min-hash, min-hashes) of each bucket: short ones find all near copies, long ones hold little else.
BUCKETS = [*((k, 4) for k in range(0, 64, 4)), *((k, 8) for k in range(64, 128, 8))]
SYMBOLS = b"#*$%&|<>"

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = "id long, host string, text_key long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", sketch binary, lines array<long>, line_words array<long>"


def _grouped(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the number of its (owner, value) group, and the groups' sizes; groups are in order of owner."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    group = np.empty(len(o), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.bincount(group) if len(o) else np.zeros(0, np.int64)


def _line_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the lines of all texts, without their ends."""
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate((breaks + 1, offsets)))
    starts, ends = edges[:-1], edges[1:].copy()
    ends[data[ends - 1] == 10] -= 1
    return starts, ends


def _sketches(shingles: np.ndarray, per_text: np.ndarray) -> pa.Array:
    """``SKETCH`` min-hashes of each text's shingles, 16 bits of each; null for a text without shingles."""
    some = np.flatnonzero(per_text)
    mins = np.empty((len(some), SKETCH), np.uint16)
    if len(some):
        starts = (np.cumsum(per_text) - per_text)[some]
        low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        for k, factor in enumerate(W.mix(np.arange(1, SKETCH + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)):
            x = low * factor
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            mins[:, k] = (np.minimum.reduceat(x, starts) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    out: list[bytes | None] = [None] * len(per_text)
    for i, row in zip(some.tolist(), mins, strict=True):
        out[i] = row.tobytes()
    return pa.array(out, pa.binary())


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, min-hashes of the shingles, and the distinct normalised lines of each text."""
    for batch in batches:
        for lo, hi, data, offsets in W.chunks(batch.column("text")):
            n = hi - lo
            w = W.Words(data, offsets)
            heads = (data & 0xC0) != 0x80
            lead = np.concatenate(([0], np.cumsum(heads & ~W.spaces(data))))
            chars = lead[offsets[1:]] - lead[offsets[:-1]]
            symbols = W.sums(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offsets)
            hashes = w.hashes(data)

            starts, ends = _line_ranges(data, offsets)
            first = np.searchsorted(w.starts, starts)
            last = np.searchsorted(w.starts, ends)
            some = last > first
            starts, ends, first, last = starts[some], ends[some], first[some], last[some]
            text = np.searchsorted(offsets, starts, "right") - 1
            exact, sizes = _grouped(text, W.byte_hashes(data, starts, ends))
            repeated = np.bincount(text, minlength=n) - np.bincount(text[np.unique(exact, return_index=True)[1]], minlength=n)

            at = W.windows(w.first, SHINGLE)
            shingles = W.window_hashes(hashes, at, SHINGLE)
            owner = W.owners(w.first, at)
            group, sizes = _grouped(owner, shingles)
            again = W.covered(at[sizes[group] > 1], SHINGLE, len(w.starts)) if len(at) else np.zeros(len(w.starts), bool)

            lowered = w.hashes(W.lower(data))
            plain = W.range_hashes(lowered, first, last)
            group, sizes = _grouped(text, plain)
            kept, index = np.unique(group, return_index=True)
            line_words = np.bincount(group, weights=last - first, minlength=len(kept)).astype(np.int64)
            per_text = np.bincount(text[index], minlength=n)
            part = batch.slice(lo, n)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("host"), part.column("text_key")]
                + [pa.array(x, pa.int64()) for x in (w.counts, chars, symbols, repeated, W.sums(again, w.first))]
                + [_sketches(W.window_hashes(lowered, at, SHINGLE), np.bincount(owner, minlength=n)), W.lists(plain[index].view(np.int64), per_text, pa.int64()), W.lists(line_words, per_text, pa.int64())],
                names=["id", "host", "text_key", *_COUNTS, "sketch", "lines", "line_words"],
            )


def measured(docs: DataFrame) -> DataFrame:
    """A small row per document, written once: counts and line hashes, no text."""
    configure(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("host"), F.xxhash64("text").alias("text_key"), "text")
    return materialize(rows.mapInArrow(measure, _SCHEMA), "quality")


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that may be similar; ``sure`` where the sketches leave no doubt."""
    for batch in batches:
        a, b = (np.array(batch.column(c).to_pylist(), f"S{2 * SKETCH}").view(np.uint16).reshape(-1, SKETCH) for c in ("su", "sv"))
        share = (a == b).sum(axis=1) / SKETCH
        yield batch.select(["u", "v"]).append_column("sure", pa.array(share > SIMILAR + DOUBT)).filter(pa.array(share >= SIMILAR - DOUBT))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text, in order, eight bytes each."""
    for batch in batches:
        for lo, hi, data, offsets in W.chunks(batch.column("text")):
            values, per_text, _ = shingle_sets(data, offsets)
            parts = np.split(values, np.cumsum(per_text)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("text_key").slice(lo, hi - lo), pa.array([x.tobytes() for x in parts], pa.binary())], names=["text_key", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar enough."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def near_copies(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of the texts (text_key, sketch) of ``docs`` that have near copies; a root stands for its group."""
    keys = F.array(*[F.xxhash64(F.lit(at), F.substring("sketch", 2 * at + 1, 2 * n)) for at, n in BUCKETS])
    held = texts.where("sketch IS NOT NULL").select("text_key", F.posexplode(keys).alias("place", "bucket"))
    ends = held.groupBy("place", "bucket").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low < high")
    short = sum(n == BUCKETS[0][1] for _, n in BUCKETS)
    pairs = held.join(ends, ["place", "bucket"]).select(F.col("text_key").alias("u"), F.when(F.col("place") < short, F.col("low")).otherwise(F.col("high")).alias("v")).where("u != v")
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    both = pairs.join(texts.select(F.col("text_key").alias("u"), F.col("sketch").alias("su")), "u").join(texts.select(F.col("text_key").alias("v"), F.col("sketch").alias("sv")), "v")
    told = materialize(both.select("u", "v", "su", "sv").mapInArrow(_estimated, "u long, v long, sure boolean"), "told")
    # Pairs that surely similar ones connect already need no sets.
    roots = materialize(components(told.where("sure").select("u", "v")), "roots")
    doubtful = told.where("NOT sure").drop("sure")
    for end in ("u", "v"):
        doubtful = doubtful.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    doubtful = materialize(doubtful.where("ru IS NULL OR rv IS NULL OR ru != rv").select("u", "v"), "doubtful")
    wanted = materialize(doubtful.select(F.explode(F.array("u", "v")).alias("text_key")).distinct(), "wanted")
    if wanted.count() <= LOOKUP:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.xxhash64("text").alias("text_key"), "text").join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"])
    sets = materialize(rows.mapInArrow(_sets, "text_key long, shingles binary"), "sets")
    both = doubtful.join(sets.select(F.col("text_key").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("text_key").alias("v"), F.col("shingles").alias("b")), "v")
    links = both.select("u", "v", "a", "b").mapInArrow(_similar, "u long, v long")
    return components(links.unionByName(roots.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))))


def frequent_lines(rows: DataFrame, docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line, n_docs) of lines above the limit, from the measured ``rows`` of ``docs``; n_docs counts copies as one. Every count is combined before its shuffle."""
    held = rows.select("host", F.explode("lines").alias("line"), "text_key").distinct()
    often = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs).drop("n")
    holders = materialize(held.join(often, ["host", "line"]), "holders")
    sketches = rows.select("text_key", "sketch").join(holders.select("text_key").distinct(), "text_key", "left_semi")
    texts = materialize(sketches.groupBy("text_key").agg(F.min("sketch").alias("sketch")), "sketches")
    roots = near_copies(texts, docs).withColumnRenamed("node", "text_key")
    classes = holders.join(roots, "text_key", "left").select("host", "line", F.coalesce("root", "text_key").alias("class")).distinct()
    return classes.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs)


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """A row per document: id, host, text_key, the counts, base_failed, n_left (words left), removed (line hashes), kept."""
    rows = measured(docs)
    frequent = frequent_lines(rows, docs, max_docs)
    one = rows.groupBy("host", "text_key").agg(F.min(F.struct("lines", "line_words")).alias("x"))
    lines = one.select("host", "text_key", F.explode(F.arrays_zip("x.lines", "x.line_words")).alias("x")).select("host", "text_key", F.col("x.lines").alias("line"), F.col("x.line_words").alias("n"))
    lost = lines.join(frequent, ["host", "line"]).groupBy("host", "text_key").agg(F.sum("n").alias("n_lost"), F.sort_array(F.collect_list("line")).alias("removed"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("n_lost", F.lit(0))
    return (
        rows.drop("lines", "line_words", "sketch").join(lost, ["host", "text_key"], "left")
        .withColumn("base_failed", base).withColumn("n_left", left)
        .withColumn("kept", ~base & (left >= F.lit(min_left) * F.col("n_words"))).drop("n_lost")
    )


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the lines named in ``removed`` out of ``text``."""
    for batch in batches:
        texts = []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
            if text and removed:
                lines = pa.array(text.split("\n"))
                hashes = np.concatenate([_one_line(d, o) for _, _, d, o in W.chunks(lines)])
                gone = np.isin(hashes, np.array(removed, np.int64))
                text = "\n".join(x for x, g in zip(lines.to_pylist(), gone, strict=True) if not g)
            texts.append(text)
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns(["removed"])


def _one_line(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    w = W.Words(data, offsets)
    return W.range_hashes(w.hashes(W.lower(data)), w.first[:-1], w.first[1:]).view(np.int64)


def clean(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that stay, without their frequent lines, in the columns of ``docs``; n_chars follows the text."""
    verdicts = judge(docs, max_docs, min_left).where("kept").groupBy("host", "text_key").agg(F.first("removed").alias("removed"))
    names = docs.columns
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.coalesce("source", F.lit("")).alias("host"), F.xxhash64("text").alias("text_key"))
    joined = inner.join(verdicts, ["host", "text_key"]).drop("host", "text_key")
    joined = joined.withColumnRenamed(f"c{names.index('text')}", "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("removed").schema)
    out = joined.mapInArrow(_strip, types)
    out = out.select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
