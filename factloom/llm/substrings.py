"""Exact substring deduplication over a compacted de Bruijn graph of the corpus.

A text's nodes are token k-mers, those that are smallest by hash in some window of ``size`` words (k is a third of a
window, so each window has a node of its own). Its edges are the stretches of words from one node to the next, each with
a 64-bit hash of all its words. ``nodes`` counts them over the corpus.
An edge is nonbranching if every occurrence of its first node goes on with it and every occurrence of its last node
comes from it; joins of the nodes' only out-edges with the nodes' only in-edges find these. A maximal run of such
edges is a compacted path: its words are the same at each occurrence, so each window inside a repeated path is repeated.
Windows that hold a repeated node but reach out of its path are verified at their source coordinates: their 128-bit
hashes are counted. Windows without a repeated node are unique and go no further.

Texts go through two shuffles, compressed: those that hold a repeated node, and all for the result. A node or window that a third
of all documents share is counted with a combine before the shuffle; joins back are left to adaptive skew splitting.

Defined cases: null text is empty, n_words and n_removed are 0; a text shorter than a window loses nothing; repeated
rows are documents of their own, so they remove each other's words; null ids stay null; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import words as W
from factloom.session import configure, materialize

SIZE = 35
_EDGE_BASE, _CHECK_BASE = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def _k(size: int) -> int:
    """Words of a node."""
    return size // 3 + 1


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts compressed, for the way through a shuffle."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        bodies = [None if x is None else pack.compress(x.encode()) for x in batch.column(at).to_pylist()]
        yield batch.set_column(at, "body", pa.array(bodies, pa.binary()))


def _unpack(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [b"" if x is None else unpack.decompress(x) for x in column.to_pylist()]


def _graph(words: W.Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, each window's node (position of its smallest k-mer), the k-mers' hashes, and the nodes in order."""
    k = _k(size)
    at = W.windows(words.first, size)
    if not len(at):
        return at, at, np.zeros(0, np.uint64), at
    kmers = W.window_hashes(hashes, np.arange(len(hashes) - k + 1), k)
    rows = np.lib.stride_tricks.sliding_window_view(kmers, size - k + 1)
    node = at + rows[at].argmin(axis=1)
    return at, node, kmers, np.unique(node)


def _edges(hashes: np.ndarray, nodes: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Hash of the words from each node through the next one of the same text; 0 after a text's last node."""
    out = np.zeros(len(nodes), np.uint64)
    if len(nodes) > 1:
        on = np.flatnonzero(text[1:] == text[:-1])
        out[on] = W.range_hashes(hashes, nodes[on], nodes[on + 1] + k, _EDGE_BASE)
    return out


def _occurrences(batches: Iterator[pa.RecordBatch], size: int, placed: bool) -> Iterator[pa.RecordBatch]:
    """Every node of every text: with its place, or with the edges that come in and go out."""
    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        for lo, _, data, offsets in W.chunks(batch.column("text")):
            w = W.Words(data, offsets)
            hashes = w.hashes(data)
            _, _, kmers, nodes = _graph(w, hashes, size)
            text = W.owners(w.first, nodes)
            columns = {"node": kmers[nodes].view(np.int64)}
            if placed:
                columns |= {"key": key[lo + text], "at": (nodes - w.first[text]).astype(np.int32)}
            else:
                out = _edges(hashes, nodes, text, _k(size)).view(np.int64)
                into = np.zeros_like(out)
                into[1:] = out[:-1]
                columns |= {"into": into, "out": out}
            yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in columns.items()})


def _spans(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """For each text its windows inside repeated paths, as ranges of starts, and the windows to verify."""
    k = _k(size)
    for batch in batches:
        for lo, hi, data, offsets in W.chunks(pa.array(_unpack(batch.column("body")), pa.large_binary())):
            part = batch.slice(lo, hi - lo)
            w = W.Words(data, offsets)
            # The two hashes of a window share nothing, from the words up.
            hashes, other = w.hashes(data), w.hashes(data, _CHECK_BASE)
            at, node, _, nodes = _graph(w, hashes, size)
            flags = part.column("nodes")
            flat = flags.flatten()
            places = w.first[np.repeat(np.arange(hi - lo), np.diff(flags.offsets.to_numpy()))] + flat.field("at").to_numpy()
            repeated, linked = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
            index = np.searchsorted(nodes, places)
            repeated[index] = True
            linked[index[flat.field("linked").to_numpy(zero_copy_only=False)]] = True
            # A path runs on while the node before is linked to this one.
            head = np.ones(len(nodes), bool)
            head[1:] = ~linked[:-1]
            path = np.cumsum(head) - 1
            begin = nodes[head]
            end = nodes[np.concatenate((np.flatnonzero(head)[1:] - 1, [len(nodes) - 1]))] + k if len(nodes) else nodes
            of = np.searchsorted(nodes, node)
            inside = repeated[of] & (at >= begin[path[of]]) & (at + size <= end[path[of]])
            check = at[repeated[of] & ~inside]
            text = W.owners(w.first, check)
            sure = at[inside]
            sure_text = W.owners(w.first, sure)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    W.lists(sure - w.first[sure_text], np.bincount(sure_text, minlength=hi - lo), pa.int32()),
                    W.lists(check - w.first[text], np.bincount(text, minlength=hi - lo), pa.int32()),
                    W.lists(W.window_hashes(hashes, check, size).view(np.int64), np.bincount(text, minlength=hi - lo), pa.int64()),
                    W.lists(W.range_hashes(other, check, check + size, _CHECK_BASE).view(np.int64), np.bincount(text, minlength=hi - lo), pa.int64()),
                ],
                names=["key", "sure", "at", "h1", "h2"],
            )


def _kept(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, kept = [], [], []
        columns = [batch.column(c) for c in ("sure", "more")]
        for i, text in enumerate(_unpack(batch.column("body"))):
            words = text.split()
            starts = [x for c in columns if c[i].is_valid for x in (c[i].values.to_numpy(),) if len(x)]
            counts.append(len(words))
            if starts:
                gone = W.covered(np.unique(np.concatenate(starts)), size, len(words))
                removed.append(int(gone.sum()))
                words = compress(words, ~gone)
            else:
                removed.append(0)
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of id and text. Rows that are equal in both have one key, and lose the same words."""
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("key"), "text")


def graph_nodes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(node, linked) of every repeated node; linked if its only out-edge is also the only in-edge of the next node."""
    found = keyed(docs).select("key", "text").mapInArrow(partial(_occurrences, size=size, placed=False), "node long, into long, out long")
    counted = found.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.min("into").alias("i"), F.max("into").alias("i2"), F.min("out").alias("o"), F.max("out").alias("o2")
    ).where("n > 1")
    nodes = materialize(counted.select("node", F.when(F.expr("i = i2 AND i != 0"), F.col("i")).alias("into"), F.when(F.expr("o = o2 AND o != 0"), F.col("o")).alias("out")), "nodes")
    ends = nodes.where("into IS NOT NULL").select(F.col("into").alias("out"), F.lit(True).alias("met"))
    return nodes.select("node", "out").join(ends, "out", "left").select("node", F.coalesce("met", F.lit(False)).alias("linked"))


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, n_words, n_removed, kept) of each document; kept are the words that stay, joined by one space."""
    configure(docs.sparkSession)
    rows = keyed(docs)
    bodies = rows.mapInArrow(_pack, "id long, key long, body binary")
    placed = rows.select("key", "text").mapInArrow(partial(_occurrences, size=size, placed=True), "node long, key long, at int")
    flagged = placed.join(graph_nodes(docs, size), "node").groupBy("key").agg(F.collect_list(F.struct("at", "linked")).alias("nodes"))
    once = "key long, sure array<int>, at array<int>, h1 array<long>, h2 array<long>"
    spans = materialize(bodies.select("key", "body").join(flagged, "key").mapInArrow(partial(_spans, size=size), once), "spans")
    checks = spans.select("key", F.explode(F.arrays_zip("at", "h1", "h2")).alias("x")).select("key", "x.*")
    again = checks.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    more = checks.join(again, ["h1", "h2"]).groupBy("key").agg(F.collect_list("at").alias("more"))
    # Rows that are equal in id and text have equal spans.
    sure = spans.groupBy("key").agg(F.first("sure").alias("sure"))
    gone = sure.join(more, "key", "left").where("size(sure) > 0 OR more IS NOT NULL")
    return bodies.join(gone, "key", "left").select("id", "body", "sure", "more").mapInArrow(partial(_kept, size=size), "id long, n_words long, n_removed long, kept string")
