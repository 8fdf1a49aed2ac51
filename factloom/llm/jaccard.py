"""N-gram Jaccard join with vertical partitioning.

A document is the set of its 5-word shingles, as 64-bit hashes. Documents with the same set are one member of the join.
The global order of shingles is by document frequency, then by hash; hash ranges cut it into fragments.

1. ``_segments`` deals each set's segments to the fragments, where the frequency of every shingle is counted. A set of
   which less than three quarters of the shingles occur elsewhere links with nothing and ends here.
2. The others are put in the global order. Linked sets share a shingle among the first quarter (the prefix). Prefixes are
   dealt to fragments again; a fragment names pairs that share a prefix shingle and that length and position allow.
3. Pairs and segments meet fragment by fragment, each fragment counts its partial overlaps, and the sum per pair decides.

Only the components are wanted, so a group of sets with a common prefix shingle is not expanded into all its pairs. Groups
of up to ``SMALL`` sets are. In larger ones each set is first paired with a head of its class of length, then sets
outside the group's largest component are paired with some of it, and in the end every pair whose sides are still in
different components is counted. So no link is lost, and a group of near copies costs a few pairs for each member.

Defined cases: null and blank texts have no shingle and link with nothing; 1 to 4 words are one shingle; repeated rows and
equal sets are linked; ties do not arise, a component's id is its smallest doc_id (null only if all its ids are null); an
empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import words as W
from factloom.llm.components import components
from factloom.session import configure, materialize

SHINGLE = 5
PERCENT = 75
#: Groups with a common prefix shingle up to this size are expanded into pairs at once.
SMALL = 16
#: Members of a larger component that a set outside of it is paired with before the last round.
PROBES = 6
#: Pairs that a fragment holds before repeated ones are dropped.
HELD = 2_000_000
#: Shingles that a fragment holds about, and bits of the most fragments in which overlaps are counted; beyond these, sets
#: are also dealt to blocks.
FRAGMENT, OVERLAP_BITS = 2_000_000, 7
_SHORT_BASE, _SET_BASE = 0x8EBC6AF09C88C6E3, np.uint64(0x589965CC75374CC3)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts in order of text and hash, their number in each text, and a key of each set."""
    data = W.lower(data)
    w = W.Words(data, offsets)
    hashes = w.hashes(data)
    at = W.windows(w.first, SHINGLE)
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    values = np.concatenate((W.window_hashes(hashes, at, SHINGLE), W.range_hashes(hashes, w.first[short], w.first[short + 1], _SHORT_BASE)))
    owner = np.concatenate((W.owners(w.first, at), short))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix(values ^ _SET_BASE))))
    edges = np.concatenate(([0], np.cumsum(counts)))
    return values, counts, W.mix(total[edges[1:]] - total[edges[:-1]] + counts.astype(np.uint64)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in W.chunks(batch.column("text")):
            _, counts, keys = shingle_sets(data, offsets)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), pa.array(counts, pa.int64()), pa.array(keys, mask=counts == 0)], names=["id", "row", "n", "key"])


def _binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Slices of an array of fixed-width values as binary; edges are where they start and the end."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column end to end, and the number in each row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets).astype(np.int64) // np.dtype(kind).itemsize


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.concatenate((np.flatnonzero(new), [n]))


def _fragments(values: np.ndarray, bits: int) -> np.ndarray:
    """Fragment of each shingle: the top bits of its hash."""
    return (values >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(values), np.int32)


def _narrow(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of an array of whole numbers as binary, each as wide as its largest value needs: 1, 2, 4 or 8 bytes."""
    return pa.array([values[a:b].astype(np.min_scalar_type(values[a:b].max(initial=0))).tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())


def _wide(column: pa.Array, many: np.ndarray) -> np.ndarray:
    """The values that ``_narrow`` packed, end to end; many is their number in each row."""
    data, sizes = _flat(column, np.uint8)
    width = sizes // np.maximum(many, 1)
    out, of_value, of_byte = np.empty(many.sum(), np.int64), np.repeat(width, many), np.repeat(width, sizes)
    for w in np.unique(width[many > 0]):
        out[of_value == w] = data[of_byte == w].view(f"u{w}")
    return out


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Key and number of values of each segment."""
    keys, many = _flat(table.column("keys"), np.int64)
    return keys, _wide(table.column("counts"), many)


def _blobs(keys: np.ndarray, cuts: np.ndarray, edges: np.ndarray, **values: np.ndarray) -> dict[str, pa.Array]:
    """Rows of many segments: segment i has key keys[i] and the values edges[i] up to edges[i + 1]; row j has the segments
    cuts[j] up to cuts[j + 1]. Segments get short as fragments grow in number, so they carry no more than that."""
    out = {"keys": _binaries(keys, cuts), "counts": _narrow(np.diff(edges), cuts)}
    return out | {name: _binaries(x, edges[cuts]) for name, x in values.items()}


_BLOBS = "keys binary, counts binary, shingles binary"


def _segments(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The segments of the sets of a chunk, a row per fragment: the 48 bits below a shingle's fragment bits.

    A set goes out once from a task.
    """
    seen: set[int] = set()
    for batch in batches:
        for _, _, data, offsets in W.chunks(batch.column("text")):
            values, counts, keys = shingle_sets(data, offsets)
            fresh = np.array([bool(n) and (k not in seen and not seen.add(k)) for k, n in zip(keys.tolist(), counts.tolist(), strict=True)], bool)
            take = np.repeat(fresh, counts)
            values, keys, counts = values[take], keys[fresh], counts[fresh]
            fragment = _fragments(values, bits)
            owner = np.repeat(np.arange(len(keys)), counts)
            order = np.lexsort((owner, fragment))
            values, owner, fragment = values[order], owner[order], fragment[order]
            edges = _runs(fragment, owner)
            first = edges[:-1]
            cuts = _runs(fragment[first])
            low = np.ascontiguousarray(((values << np.uint64(bits)) >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").reshape(-1)
            yield pa.RecordBatch.from_pydict({"fragment": pa.array(fragment[first][cuts[:-1]])} | _blobs(keys[owner[first]], cuts, edges, shingles=low))


def _frequencies(table: pa.Table, bits: int, buckets: int) -> pa.Table:
    """In one fragment: the shingles that more than one set holds, with a logarithmic class of their frequency, by bucket of keys."""
    fragment = int(table.column("fragment")[0].as_py())
    keys, counts = _unpacked(table)
    raw, _ = _flat(table.column("shingles"), np.dtype("V6"))
    # Tasks that met the same set sent it each.
    once = np.zeros(len(keys), bool)
    once[np.unique(keys, return_index=True)[1]] = True
    raw, keys, counts = raw[np.repeat(once, counts)], keys[once], counts[once]
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw.view(np.uint8).reshape(-1, 6)
    low = wide.reshape(-1).view(np.uint64)
    order = np.argsort(low, kind="stable")
    edges = _runs(low[order])
    df = np.empty(len(low), np.int64)
    df[order] = np.repeat(np.diff(edges), np.diff(edges))
    keep = df > 1
    owner = np.repeat(np.arange(len(keys)), counts)[keep]
    top = np.uint64(fragment << (64 - bits)) if bits else np.uint64(0)
    values = ((low[keep] << np.uint64(16)) >> np.uint64(bits)) | top
    classes = np.minimum(255, 8 * np.log2(df[keep])).astype(np.uint8)
    bucket = (keys % buckets).astype(np.int32)
    order = np.lexsort((owner, bucket[owner]))
    values, classes, owner = values[order], classes[order], owner[order]
    edges = _runs(owner)
    first = owner[edges[:-1]]
    cuts = _runs(bucket[first])
    return pa.table({"bucket": bucket[first][cuts[:-1]]} | _blobs(keys[first], cuts, edges, shingles=values, classes=classes))


def _ordered(table: pa.Table, heads: pa.Table) -> pa.Table:
    """In one bucket of keys, with the sizes of its sets: the sets of which enough shingles occur elsewhere, those shingles in
    the global order, and the length of the prefix."""
    keys, counts = _unpacked(table)
    values, _ = _flat(table.column("shingles"), np.uint64)
    classes, _ = _flat(table.column("classes"), np.uint8)
    keys, of = np.unique(keys, return_inverse=True)
    known, sizes = heads.column("key").to_numpy(), heads.column("n").to_numpy()
    order = np.argsort(known)
    n, owner = sizes[order[np.searchsorted(known[order], keys)]] if len(keys) else np.zeros(0, np.int64), np.repeat(of, counts)
    held = np.bincount(owner, minlength=len(keys))
    enough = 100 * held >= PERCENT * n
    take = enough[owner]
    values, classes, owner = values[take], classes[take], owner[take]
    order = np.lexsort((values, classes, owner))
    held, n = held[enough], n[enough]
    prefix = held - (PERCENT * n + 99) // 100 + 1
    return pa.table({"key": keys[enough], "n": n.astype(np.int32), "prefix": prefix.astype(np.int32), "shingles": _binaries(values[order], np.concatenate(([0], np.cumsum(held))))})


def _prefixes(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The prefix shingles of each set by fragment, with their places in the whole set."""
    for batch in batches:
        values, counts = _flat(batch.column("shingles"), np.uint64)
        n, prefix = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "prefix"))
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
        take = place < prefix[owner]
        values, owner, place = values[take], owner[take], (place + (n - counts)[owner])[take].astype(np.int32)
        fragment = _fragments(values, bits)
        order = np.lexsort((fragment, owner))
        values, owner, place, fragment = values[order], owner[order], place[order], fragment[order]
        edges = _runs(owner, fragment)
        first = owner[edges[:-1]]
        out = [pa.array(fragment[edges[:-1]]), batch.column("key").take(pa.array(first)), pa.array(n[first].astype(np.int32)), _binaries(values, edges), _binaries(place, edges)]
        names = ["fragment", "key", "n", "shingles", "places"]
        if "root" in batch.schema.names:
            out.append(batch.column("root").take(pa.array(first)))
            names.append("root")
        yield pa.RecordBatch.from_arrays(out, names=names)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, counts times."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _pairs(table: pa.Table, stage: str) -> pa.Table:
    """In one fragment: pairs of sets with a common prefix shingle that may be linked.

    ``first`` pairs all of a small group, and each set of a larger one with a few. ``probe`` and ``rest`` look at larger
    groups that have more than one component: some pairs, or all pairs, between different ones.
    """
    values, counts = _flat(table.column("shingles"), np.uint64)
    place, _ = _flat(table.column("places"), np.int32)
    key = np.repeat(table.column("key").to_numpy(), counts)
    n = np.repeat(table.column("n").to_numpy().astype(np.int64), counts)
    order = np.lexsort((key, n, values))
    values, place, key, n = values[order], place[order].astype(np.int64), key[order], n[order]
    root = np.repeat(table.column("root").to_numpy(), counts)[order] if stage != "first" else key
    edges = _runs(values)
    size = np.diff(edges)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, most_held = 0, HELD

    def add(a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of positions that length and position allow, at most once."""
        swap = n[a] > n[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        ok = (key[a] != key[b]) & (100 * n[a] >= PERCENT * n[b])
        if stage != "first":
            ok &= root[a] != root[b]
        most = 1 + np.minimum(n[a] - 1 - place[a], n[b] - 1 - place[b])
        ok &= (100 + PERCENT) * most >= PERCENT * (n[a] + n[b])
        a, b = a[ok], b[ok]
        swap = key[a] > key[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        nonlocal held, most_held
        found.append((a, b))
        held += len(a)
        if held > most_held:
            shrink()
            # Twice what is left: pairs that stay are not sorted again for each group.
            held = len(found[0][0])
            most_held = max(HELD, 2 * held)

    def shrink() -> None:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((key[b], key[a]))
        keep = order[_runs(key[a][order], key[b][order])[:-1]] if len(a) else order
        found[:] = [(a[keep], b[keep])]

    if stage == "first":
        small = (size > 1) & (size <= SMALL)
        member = np.flatnonzero(np.repeat(small, size))
        left = np.repeat(edges[1:], size)[member] - member - 1
        for step in range(1, SMALL):
            at = member[left >= step]
            add(at, at + step)
        large = np.repeat(size > SMALL, size)
        member = np.flatnonzero(large)
        if len(member):
            # Heads: the smallest key of each class of length; classes are narrower than linked sets may differ. A group's
            # shingles have much the same heads.
            width = (np.log(n[member]) / np.log(1.15)).astype(np.int64)
            member = member[np.lexsort((key[member], width, values[member]))]
            width = (np.log(n[member]) / np.log(1.15)).astype(np.int64)
            runs = _runs(values[member], width)
            add(np.repeat(member[runs[:-1]], np.diff(runs)), member)
    else:
        rng = np.random.default_rng(7)
        for g in np.flatnonzero(size > SMALL):
            at = np.arange(edges[g], edges[g + 1])
            roots, of, many = np.unique(root[at], return_inverse=True, return_counts=True)
            if len(roots) < 2:
                continue
            main = of == many.argmax()
            inner, outer = at[main], at[~main]
            if stage == "probe":
                add(np.repeat(outer, PROBES), rng.choice(inner, PROBES * len(outer)))
                continue
            # All sets that are not shorter, and within the length that can be linked; at is in order of n.
            for part in np.array_split(outer, len(outer) * len(at) // 500_000 + 1):
                lo = np.searchsorted(n[at], -(-PERCENT * n[part] // 100), "left")
                hi = np.searchsorted(n[at], 100 * n[part] // PERCENT, "right")
                add(np.repeat(part, hi - lo), at[_spread(lo, hi - lo)])
    if not found:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "na": pa.array([], pa.int32()), "nb": pa.array([], pa.int32())})
    shrink()
    a, b = found[0]
    return pa.table({"a": key[a], "b": key[b], "na": n[a].astype(np.int32), "nb": n[b].astype(np.int32)})


def _cut(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The segments in which overlaps are counted."""
    for batch in batches:
        values, counts = _flat(batch.column("shingles"), np.uint64)
        owner = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        fragment = _fragments(values, bits)
        edges = _runs(owner, fragment)
        first = pa.array(owner[edges[:-1]])
        yield pa.RecordBatch.from_arrays([batch.column("block").take(first), pa.array(fragment[edges[:-1]]), batch.column("key").take(first), _binaries(values, edges)], names=["block", "fragment", "key", "shingles"])


def _overlaps(pairs: pa.Table, segments: pa.Table) -> pa.Table:
    """In one fragment: the partial overlap of each pair."""
    a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
    key = segments.column("key").to_numpy()
    values, counts = _flat(segments.column("shingles"), np.uint64)
    out = np.zeros(len(a), np.int64)
    if len(key) and len(a):
        _, ids = np.unique(values, return_inverse=True)
        order = np.argsort(key)
        starts = np.cumsum(counts) - counts
        width = int(ids.max()) + 1
        rank = np.empty(len(key), np.int64)
        rank[order] = np.arange(len(key))
        held = np.sort(np.repeat(rank, counts) * width + ids)
        x, y = np.searchsorted(key[order], a), np.searchsorted(key[order], b)
        last = len(key) - 1
        there = np.flatnonzero((key[order][np.minimum(x, last)] == a) & (key[order][np.minimum(y, last)] == b))
        for part in np.array_split(there, len(there) * max(1, len(values) // len(key)) // 2_000_000 + 1):
            row = order[x[part]]
            many = counts[row]
            wanted = np.repeat(y[part], many) * width + ids[_spread(starts[row], many)]
            hit = held[np.minimum(np.searchsorted(held, wanted), len(held) - 1)] == wanted
            out[part] = np.bincount(np.repeat(np.arange(len(part)), many)[hit], minlength=len(part))
    some = out > 0
    return pa.table({"a": a[some], "b": b[some], "na": pairs.column("na").to_numpy()[some], "nb": pairs.column("nb").to_numpy()[some], "overlap": out[some]})


def _links(pairs: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """Pairs (u > v) that are similar enough: partial overlaps of each fragment, summed per pair."""
    bits = min(OVERLAP_BITS, int(total // FRAGMENT).bit_length())
    blocks = total // (FRAGMENT << OVERLAP_BITS) + 1
    pairs = pairs.withColumn("block", F.pmod(F.hash("a"), F.lit(blocks)))
    members = pairs.select("block", F.col("a").alias("key")).unionAll(pairs.select("block", F.col("b").alias("key"))).distinct()
    segments = sets.select("key", "shingles").join(members, "key").select("block", "key", "shingles").mapInArrow(partial(_cut, bits=bits), "block int, fragment int, key long, shingles binary")
    dealt = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1))))
    counted = dealt.groupBy("block", "fragment").cogroup(segments.groupBy("block", "fragment")).applyInArrow(_overlaps, "a long, b long, na int, nb int, overlap long")
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("o"))
    return summed.where(F.expr(f"100 * o >= {PERCENT} * (na + nb - o)")).select(F.col("b").alias("u"), F.col("a").alias("v"))


def join(docs: DataFrame) -> DataFrame:
    """(id, row, n, root, component) of every row of ``docs``: a hash of its id and text, the size of its set, the component's
    key, and its smallest id."""
    configure(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    sets = materialize(texts.mapInArrow(_sets, "id long, row long, n long, key long"), "sets")
    heads = sets.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"), F.max("n").alias("n"))
    labels = _labels(texts, heads)
    roots = heads.join(labels, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component"))
    of_key = roots.select("key", "root").join(least, "root").select("key", "root", "component")
    return sets.join(of_key, "key", "left").select("id", "row", "n", "root", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest id (of rows with one id, that with the smallest text hash), in
    the columns of ``docs``. Documents without a shingle are linked with nothing and stay; of rows equal in id and text one does."""
    rows = join(docs)
    alone = rows.where("n = 0").select("row")
    first = rows.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("x")).select("x.row")
    chosen = alone.unionAll(first).distinct()
    names = docs.columns
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.xxhash64("doc_id", "text").alias("row"))
    # Rows that are equal in id and text meet in the join's partitions already.
    once = inner.join(chosen, "row").groupBy("row").agg(F.first(F.struct(*[f"c{i}" for i in range(len(names))])).alias("x"))
    return once.select(*[F.col(f"x.c{i}").alias(c) for i, c in enumerate(names)])


def _frequencies_of(bits: int, buckets: int):
    return lambda table: _frequencies(table, bits, buckets)


def _pairs_of(stage: str):
    return lambda table: _pairs(table, stage)


def _labels(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """(key, root) of the sets that are linked with others."""
    total = heads.agg(F.sum("n")).first()[0] or 0
    bits = max(0, int(total // FRAGMENT).bit_length())
    counted = (
        texts.select("text").mapInArrow(partial(_segments, bits=bits), f"fragment int, {_BLOBS}")
        .groupBy("fragment").applyInArrow(_frequencies_of(bits, 1 << bits), f"bucket int, {_BLOBS}, classes binary")
    )
    sizes = heads.select(F.expr(f"CAST(pmod(key, {1 << bits}) AS INT)").alias("bucket"), "key", F.col("n").cast("long").alias("n"))
    sets = counted.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInArrow(_ordered, "key long, n int, prefix int, shingles binary")
    ordered = materialize(sets, "ordered")
    total, prefixes = ordered.agg(F.sum(F.length("shingles") / 8).cast("long"), F.sum("prefix")).first()
    bits = int((prefixes or 0) // FRAGMENT).bit_length()
    links = labels = None
    for stage in ("first", "probe", "rest"):
        rows = ordered
        if labels is not None:
            rows = ordered.join(labels, "key", "left").withColumn("root", F.coalesce("root", "key"))
        schema = "fragment int, key long, n int, shingles binary, places binary" + ", root long" * (labels is not None)
        pairs = (
            rows.mapInArrow(partial(_prefixes, bits=bits), schema).groupBy("fragment")
            .applyInArrow(_pairs_of(stage), "a long, b long, na int, nb int").distinct()
        )
        found = _links(materialize(pairs, "pairs"), ordered, total or 0)
        links = found if links is None else links.unionAll(found)
        labels = materialize(components(links).select(F.col("node").alias("key"), "root"), "labels")
        links = labels.select(F.col("key").alias("u"), F.col("root").alias("v"))
    return labels
