"""Bounded-space online packing of documents into sequences of token ids.

Each task keeps ``OPEN`` open windows. A document's ids and an end id are cut into whole sequences; the rest goes into the
open window that it fills best. When none fits, the fullest is emitted; if its gap and what is left of the document are
worth a piece, the document is cut to fill it, else the gap stays as padding. What is open at a task's end is merged: the
windows of up to ``FAN`` tasks are packed again by one, round by round, until one task is left; it lays its last windows
end to end. A round's tasks hold at most ``FAN * OPEN`` windows, so no task grows with the input.

Defined cases: null text is empty, and an empty text is the end id alone; null ids stay null; repeated rows are documents
of their own; further columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import words as W
from factloom.llm.bpe import encoder
from factloom.session import configure, materialize

LENGTH, END = 1024, 0
OPEN, FAN = 32, 32
#: Gaps below this are padded, and no document is cut for less.
LEAST = 12

_NAMES = ["id", "start", "length", "crc", "n_tokens", "sequence", "place", "task", "ids"]
_SCHEMA = "id long, start long, length long, crc long, n_tokens long, sequence long, place long, task int, ids binary"
Piece = tuple  # (id, start, ids, n_tokens)


class Packer:
    """Open windows of one task; closed ones go to ``rows``."""

    def __init__(self, task: int, level: int, length: int, keep_ids: bool):
        self.base, self.task, self.length, self.keep_ids = (level << 56) | (task << 24), task, length, keep_ids
        self.count = 0
        self.gaps: list[tuple[int, int]] = []  # (gap, number) of the open windows, in order
        self.held: dict[int, list[Piece]] = {}
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[Piece], open_: bool = False) -> None:
        place = 0
        for id_, start, ids, n in pieces:
            body = ids.tobytes()
            self.rows.append((id_, start, len(ids), zlib.crc32(body), n, self.base | self.count, place, self.task if open_ else None, body if open_ or self.keep_ids else None))
            place += len(ids)
        self.count += 1

    def add(self, id_: int | None, start: int, ids: np.ndarray, n: int) -> None:
        """Place a document's ids, or a piece of them."""
        while len(ids) >= self.length:
            self._emit([(id_, start, ids[: self.length], n)])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            at = bisect_left(self.gaps, (len(ids), -1))
            if at < len(self.gaps):
                gap, number = self.gaps.pop(at)
                self.held[number].append((id_, start, ids, n))
                if gap == len(ids):
                    self._emit(self.held.pop(number))
                else:
                    insort(self.gaps, (gap - len(ids), number))
                return
            if len(self.gaps) < OPEN:
                number = self.count = self.count + 1
                self.held[number] = [(id_, start, ids, n)]
                insort(self.gaps, (self.length - len(ids), number))
                return
            gap, number = self.gaps.pop(0)
            if gap >= LEAST and len(ids) - gap >= LEAST:
                self.held[number].append((id_, start, ids[:gap], n))
                start, ids = start + gap, ids[gap:]
            self._emit(self.held.pop(number))

    def leave(self) -> None:
        """Give the open windows away for the next round."""
        for pieces in self.held.values():
            self._emit(pieces, open_=True)
        self.gaps, self.held = [], {}

    def finish(self) -> None:
        """Lay the open windows end to end; only the last sequence has a gap."""
        window, room = [], self.length
        for pieces in self.held.values():
            for id_, start, ids, n in pieces:
                while len(ids):
                    window.append((id_, start, ids[:room], n))
                    start, ids, room = start + room, ids[room:], room - min(room, len(ids))
                    if not room:
                        self._emit(window)
                        window, room = [], self.length
        if window:
            self._emit(window)
        self.gaps, self.held = [], {}

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(_NAMES)
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def _pack(batches: Iterator[pa.RecordBatch], path: str, length: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    packer = Packer(TaskContext.get().partitionId(), 0, length, keep_ids)
    encode = encoder(path).encode
    end = np.array([END], np.uint32)
    for batch in batches:
        ids = batch.column("id").to_pylist()
        for lo, hi, data, offsets in W.chunks(batch.column("text")):
            flat, edges = encode(data, offsets)
            for i, a, b in zip(range(lo, hi), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                packer.add(ids[i], 0, np.concatenate((flat[a:b], end)), b - a + 1)
            yield packer.take()
    packer.leave()
    yield packer.take()


def _merge(level: int, last: bool, length: int, keep_ids: bool):
    def merge(table: pa.Table) -> pa.Table:
        packer = Packer(int(table.column("group")[0].as_py()), level, length, keep_ids)
        rows = table.select(["id", "start", "ids", "n_tokens"]).to_pylist()
        rows.sort(key=lambda r: (-len(r["ids"]), r["id"] is None, r["id"] or 0, r["start"]))
        for r in rows:
            packer.add(r["id"], r["start"], np.frombuffer(r["ids"], np.uint32), r["n_tokens"])
        packer.finish() if last else packer.leave()
        return pa.Table.from_batches([packer.take()])

    return merge


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """A row per piece: id, start, length, crc, n_tokens (of its document), sequence, place, ids (null unless wanted)."""
    configure(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(partial(_pack, path=tokenizer, length=length, keep_ids=keep_ids), _SCHEMA)
    made = materialize(rows, "packed")
    closed = made.where("task IS NULL")
    level, tasks = 0, (made.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        level, tasks = level + 1, -(-tasks // FAN)
        left = made.where("task IS NOT NULL").withColumn("group", F.floor(F.col("task") / FAN).cast("int"))
        made = left.groupBy("group").applyInArrow(_merge(level, tasks == 1, length, keep_ids), _SCHEMA)
        if tasks == 1:
            return closed.unionAll(made).drop("task")
        made = materialize(made, "packed")
        closed = closed.unionAll(made.where("task IS NULL"))
