"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string: for each turn ``<s>`` role ``[INST]`` text ``[/INST]</s>``. Control strings inside
roles and texts are escaped by a backslash after their first character (one more if there are some), which is undone by
taking one away. The rendered string is encoded once, with offsets; control strings are tokens of their own, so no token
reaches over a turn's edge. Turn spans and token spans are both sorted, so the tokens of an assistant text are found by
binary search, and the mask is that run of tokens.

Rows are dealt by ranges of (conversation, turn), so a long conversation is cut between turns into segments, in several
tasks; a segment also ends beyond ``SEGMENT`` characters. Segments of one conversation joined in order are its rendered
string. What is read back is folded in streams: no conversation is ever held whole.

Defined cases: null text and null role are empty; null conv_id is a conversation of its own; turns with one number are in
order of role and text, null turns come first; repeated rows are turns of their own; an empty table gives an empty one;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import configure, materialize

BEGIN, TEXT, CLOSE = "<s>", "[INST]", "[/INST]</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
#: The role whose texts are learned.
LEARNED = "assistant"
#: Characters after which a segment ends.
SEGMENT = 200_000
_MARKED = re.compile(r"([<\[])(\\*)(?=(?:/?s>|/?INST\]|\|endoftext\|>))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=(?:/?s>|/?INST\]|\|endoftext\|>))")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)


def escape(text: str) -> str:
    return _MARKED.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The string of some turns, and the spans of the learned texts in it, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{escape(role)}{TEXT}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) token of each span that is not empty. Token offsets are sorted."""
    some = np.array([s for s in spans if s[0] < s[1]], np.int64).reshape(-1, 2)
    return np.searchsorted(ends, some[:, 0], "right"), np.searchsorted(starts, some[:, 1], "left")


_tokenizers: dict = {}


def _tokenizer(path: str):
    """The vocabulary with the control strings as tokens of their own, after its last id."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        made = Tokenizer.from_file(path)
        made.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROL if made.token_to_id(c) is None])
        _tokenizers[path] = made
    return _tokenizers[path]


_SCHEMA = "conv_id long, turn long, segment int, n_turns int, text string, ids array<int>, starts array<int>, ends array<int>, first array<int>, last array<int>"


def _format(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Segments of the conversations in a sorted partition."""
    tokenizer = _tokenizer(path)
    open_: list[tuple[str, str]] = []
    key, turn, size, segment = None, None, 0, 0
    ready: list[tuple] = []

    def close() -> None:
        nonlocal open_, size, segment
        if open_:
            text, spans = render(open_)
            ready.append((key, turn, segment, len(open_), text, spans))
            open_, size, segment = [], 0, segment + 1

    def take() -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(10)]
        for (k, t, s, n, text, spans), e in zip(ready, tokenizer.encode_batch([r[4] for r in ready], add_special_tokens=False), strict=True):
            offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
            first, last = mask(spans, offsets[:, 0], offsets[:, 1])
            for column, x in zip(columns, (k, t, s, n, text, e.ids, offsets[:, 0], offsets[:, 1], first, last), strict=True):
                column.append(x)
        ready.clear()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.list_(pa.int32())] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "segment", "n_turns", "text", "ids", "starts", "ends", "first", "last"])

    begun = False
    for batch in batches:
        for k, t, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if not begun or k != key or size > SEGMENT:
                close()
                if not begun or k != key:
                    segment = 0
                key, turn, begun = k, t, True
            open_.append((role, text))
            size += len(text)
            if len(ready) >= 64:
                yield take()
    close()
    if ready:
        yield take()


def conversations(rows: DataFrame, path: str) -> DataFrame:
    """Formatted segments, written once: text, token ids and offsets, and the runs of tokens to learn (first, last).

    A conversation's segments are in order of (turn, segment); turn is that of a segment's first row.
    """
    configure(rows.sparkSession)
    turns = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    dealt = turns.repartitionByRange("conv_id", "turn").sortWithinPartitions(*keys)
    return materialize(dealt.mapInArrow(partial(_format, path=path), _SCHEMA), "chat")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's turns as read from its text, and what its mask covers, both unescaped."""
    for batch in batches:
        turns, learned = [], []
        lists = [batch.column(c) for c in ("starts", "ends", "first", "last")]
        for i, text in enumerate(batch.column("text").to_pylist()):
            turns.append("".join(f"{unescape(r)}\n{unescape(t)}\n" for r, t in _TURN.findall(text)))
            starts, ends, first, last = (c[i].values.to_numpy() for c in lists)
            learned.append("".join(unescape(text[a:b]) for a, b in zip(starts[first], ends[last - 1], strict=True)))
        columns = [batch.column("conv_id"), batch.column("turn"), batch.column("segment"), pa.array([len(_TURN.findall(t)) for t in batch.column("text").to_pylist()], pa.int64())]
        columns += [pa.array(turns, pa.string()), pa.array(learned, pa.string()), pa.array([len(t) for t in batch.column("text").to_pylist()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "segment", "n", "turns", "learned", "n_chars"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and digests of each conversation from its segments in order; a segment is held at a time."""
    key, state, begun, done = None, None, False, []

    def close() -> None:
        if begun:
            n, turns, chars, learned, formatted = state
            done.append((key, n, turns.hexdigest(), chars, learned.hexdigest(), formatted))

    def take() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * 6
        done.clear()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for k, n, turns, learned, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n", "turns", "learned", "n_chars")), strict=True):
            if not begun or k != key:
                close()
                key, state, begun = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            state[0] += n
            state[1].update(turns.encode())
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += size
        yield take()
    close()
    yield take()


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted conversations."""
    read = segments.select("conv_id", "turn", "segment", "text", "starts", "ends", "first", "last").mapInArrow(_read, "conv_id long, turn long, segment int, n long, turns string, learned string, n_chars long")
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.mapInArrow(_fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
