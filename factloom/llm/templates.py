"""Benchmark decontamination by template canonicalisation.

Words lose punctuation and case; numbers, names and units become typed placeholders. Windows of template words are hashed
and joined with the benchmark's windows. Windows with slots are also hashed as plain words, so a copy is found whatever its
capitals and line ends make of its names. Windows of one document and item on one diagonal (document place minus item place)
are an alignment; its slots must be consistent, that is, an item's value stands for one value of the document throughout,
so a question with other numbers and names is caught and a chance meeting of placeholders is not. A document leaks an item
if consistent alignments cover enough of the item: ``COVER`` of it by plain words and by templates with enough literals, or
``SLOT_COVER`` of it in one alignment, where templates rich in slots count too.

The benchmark's window hashes filter the documents' windows in the scan while their number is at most ``LOOKUP``, which
bounds the broadcast; beyond it all windows go to the join. Either way the join decides.

- number: a word that starts with a digit; unit: a word of ``UNITS`` after a number
- name: a capitalised word (A-Z, and Latin-1) without a second capital of A-Z, that does not start a text, line or sentence

Defined cases: null and blank texts leak nothing; an item of fewer than ``WINDOW`` words is one window of its own length;
templates have enough literals with ``LITERAL`` words that are no placeholders (half in short items), and are not looked at
without one (two in short items, one if that is half); plain words of a short item are looked at if it has four words or one
that is no number or unit; repeated rows give equal rows;
empty tables give an empty one; null ids stay null; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import words as W
from factloom.session import configure, materialize

WINDOW, LITERAL = 8, 5
#: Share of an item's words that leaked windows cover, and of its slot values that keep one value.
COVER, CONSISTENT = 0.35, 0.8
#: Share of an item that one alignment covers where windows have few literals.
SLOT_COVER = 0.8
#: Benchmark windows up to which their hashes are broadcast (8 bytes each).
LOOKUP = 1_000_000
# Names and signs of common units.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds oz ounce ounces ml cl l liter liters litre litres gallon gallons "
    "ms s sec min h hr second seconds minute minutes hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur gbp mph kmh w kw kwh v volt volts watt watts hz khz mhz ghz kb mb gb tb degree degrees"
).split()
_NUMBER, _NAME, _UNIT = 1, 2, 3


def _hash_words(names: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(names).encode(), np.uint8)
    return W.Words(data, np.array([0, len(data)])).hashes(data)


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, kind (0 for a literal) and value hash of each word; text d has the words first[d] up to first[d + 1]."""
    w = W.Words(data, offsets)
    low = W.lower(data)
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = np.where(latin, low + np.uint8(32), low)
    core = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
    before = np.concatenate(([0], np.cumsum(core)))
    some = before[w.ends] > before[w.starts]
    starts, ends = w.starts[some], w.ends[some]
    first = np.searchsorted(starts, offsets)
    value = W.byte_hashes(low[core], before[starts], before[ends])
    head = np.flatnonzero(core)[before[starts]] if len(starts) else starts
    digit = (data[head] >= 48) & (data[head] <= 57)
    capital = ((data[head] >= 65) & (data[head] <= 90)) | np.concatenate((latin, [False]))[head + 1]
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    capital &= upper[ends] - upper[starts] < 2
    opens = np.ones(len(starts), bool)
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    opens[1:] = np.isin(data[ends[:-1] - 1], np.frombuffer(b".!?:;", np.uint8)) | (lines[starts[1:]] > lines[ends[:-1]])
    opens[first[:-1][first[:-1] < len(starts)]] = True
    kind = np.where(digit, _NUMBER, np.where(capital & ~opens, _NAME, 0))
    after = np.zeros(len(starts), bool)
    after[1:] = digit[:-1]
    after[first[:-1][first[:-1] < len(starts)]] = False
    kind[after & (kind == 0) & np.isin(value, _hash_words(UNITS))] = _UNIT
    return np.where(kind > 0, kind.astype(np.uint64), value), kind, value, first


def _windows(batches: Iterator[pa.RecordBatch], sizes: list[int], whole: bool, lookup=None) -> Iterator[pa.RecordBatch]:
    """Informative windows: hash, place and the values in their slots. ``whole``: a text gives windows of its own size."""
    wanted = None if lookup is None else lookup.value
    for batch in batches:
        for lo, _, data, offsets in W.chunks(batch.column("text")):
            template, kind, value, first = canonical(data, offsets)
            slots = np.flatnonzero(kind)
            literal = np.concatenate(([0], np.cumsum(kind == 0)))
            spoken = np.concatenate(([0], np.cumsum((kind == 0) | (kind == _NAME))))
            counts = np.diff(first)
            for size in sizes:
                at = W.windows(first, size)
                text = W.owners(first, at)
                if whole:
                    keep = np.minimum(counts[text], WINDOW) == size
                    at, text = at[keep], text[keep]
                literals = literal[at + size] - literal[at]
                enough = min(LITERAL, (size + 1) // 2)
                told = (size >= 4) | (spoken[at + size] > spoken[at])
                for words, chosen in ((template, literals >= (1 if size == WINDOW else min(2, enough))), (value, (literals < size) & told)):
                    yield _rows(batch, lo, words, at[chosen], text[chosen], size, (literals[chosen] >= enough) | (words is value), first, None if words is value else slots, value, wanted)


def _rows(batch: pa.RecordBatch, lo: int, words: np.ndarray, at: np.ndarray, text: np.ndarray, size: int, strong: np.ndarray, first: np.ndarray, slots: np.ndarray | None, value: np.ndarray, wanted) -> pa.RecordBatch:
    """Rows of the windows at ``at``; plain words (no ``slots``) have no slots to check."""
    hashes = W.window_hashes(words, at, size).view(np.int64)
    if wanted is not None:
        near = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
        keep = wanted[near] == hashes if len(wanted) else np.zeros(len(hashes), bool)
        at, text, hashes, strong = at[keep], text[keep], hashes[keep], strong[keep]
    slots = np.zeros(0, np.int64) if slots is None else slots
    a, b = np.searchsorted(slots, at), np.searchsorted(slots, at + size)
    spread = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("key").take(pa.array(lo + text)), batch.column("id").take(pa.array(lo + text)), pa.array(hashes), pa.array(np.full(len(at), size, np.int32)), pa.array(strong),
            pa.array((at - first[text]).astype(np.int32)), pa.array(np.diff(first)[text].astype(np.int32)), W.lists(value[slots[spread]].view(np.int64), b - a, pa.int64()),
        ],
        names=["key", "id", "window", "size", "strong", "at", "n", "slots"],
    )


_SCHEMA = "key long, id long, window long, size int, strong boolean, at int, n int, slots array<long>"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, id, item_id, n_words of the item, n_covered, n_slots, n_changed) of each document and item that it leaks.

    key is ``xxhash64(doc_id, text)`` of the document's row; n_slots are the item's slot values met, n_changed those with
    another value in the document.
    """
    spark = configure(docs.sparkSession)
    items = benchmark.select(F.xxhash64("item_id", "text").alias("key"), F.col("item_id").cast("long").alias("id"), "text").distinct()
    theirs = materialize(items.mapInArrow(partial(_windows, sizes=list(range(1, WINDOW + 1)), whole=True), _SCHEMA), "items")
    # At most WINDOW different sizes.
    sizes = [r.size for r in theirs.select("size").distinct().collect()]
    known = theirs.select("window").distinct()
    lookup = None
    if known.count() <= LOOKUP:
        lookup = spark.sparkContext.broadcast(np.sort(known.toArrow().column("window").to_numpy()))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("id"), "text")
    ours = rows.mapInArrow(partial(_windows, sizes=sizes, whole=False, lookup=lookup), _SCHEMA)
    theirs = theirs.select("window", "size", "strong", F.col("key").alias("item_key"), F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("n").alias("n_words"), F.col("slots").alias("item_slots"))
    met = ours.drop("n", "strong").join(theirs, ["window", "size"]).select(
        "key", "id", "item_key", "item_id", "n_words", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", "size", "strong",
        F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("ours")).alias("pairs"),
    )
    # One alignment holds an item's windows and slots at most once for each row.
    aligned = met.groupBy("key", "id", "item_key", "item_id", "n_words", "diagonal").agg(
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
        F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(item_at, item_at + size - 1)")))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set(F.expr("CASE WHEN strong THEN sequence(item_at, item_at + size - 1) END")))).alias("strong_places"),
    ).withColumn("n_slots", F.size(F.array_distinct("pairs.theirs"))).withColumn("n_changed", F.expr("size(filter(pairs, p -> p.theirs != p.ours))"))
    good = aligned.where(F.col("n_slots") >= CONSISTENT * F.size("pairs"))
    whole = good.groupBy("key", "id", "item_key", "item_id", "n_words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("strong_places")))).alias("n_strong"), F.max(F.size("places")).alias("n_best"), F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed")
    )
    found = whole.where((F.col("n_strong") >= COVER * F.col("n_words")) | (F.col("n_best") >= SLOT_COVER * F.col("n_words")))
    return found.select("key", "id", "item_id", "n_words", F.greatest("n_strong", "n_best").alias("n_covered"), "n_slots", "n_changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, in the columns of ``docs``."""
    names = docs.columns
    found = leaks(docs, benchmark).select(F.col("key").alias("leak_key")).distinct()
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.xxhash64("doc_id", "text").alias("leak_key"))
    return inner.join(found, "leak_key", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
