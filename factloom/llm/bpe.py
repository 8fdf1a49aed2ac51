"""Byte-level BPE ids of whole Arrow batches of texts.

The split into pre-tokens is done on arrays of code points; only pre-tokens not met before by this worker are merged, by
``tiktoken`` with the ranks of the given file. The result is that of ``tokenizers`` with the same file: a special token's
string in a text is that token's id. Texts that hold one go through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import chain

import numpy as np

from factloom.llm import words as W

#: Pre-tokens that a worker remembers at most.
REMEMBER = 600_000
_OTHER, _LETTER, _NUMBER, _SPACE, _UNASSIGNED = range(5)
_table: np.ndarray | None = None
# The pattern's contractions, and Unicode's White_Space.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _classes() -> np.ndarray:
    global _table
    if _table is None:
        kinds = {"L": _LETTER, "N": _NUMBER, "Cn": _UNASSIGNED}
        _table = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            kind = unicodedata.category(chr(i))
            _table[i] = kinds.get(kind, kinds.get(kind[0], _OTHER))
        _table[list(WHITE_SPACE)] = _SPACE
    return _table


def pre_tokens(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts that stand end to end: contractions, then runs of one class with a blank before."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[edges] = True
    new = first[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    # The last of a run of white space before other text stands alone, or goes with that text if it is a blank.
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:-1])
    new[last] = True
    new[last[points[last] == 32] + 1] = False
    mark = np.flatnonzero((points == 39) & new)
    for letters in CONTRACTIONS:
        at = mark[mark + len(letters) < n]
        for i, letter in enumerate(letters, 1):
            at = at[(points[at + i] == ord(letter)) & ~first[at + i]]
        new[at + 1] = False
        on = at + len(letters) + 1
        on = on[on < n]
        new[on] |= kind[on] == _LETTER
    return np.flatnonzero(new)


def _ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of each token. The file writes bytes as characters: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


class Encoder:
    """Ids of texts, for the worker's time of life."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        # A pre-token is one piece.
        self.merges = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=_ranks(path), special_tokens={}).encode_ordinary
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.n_ids = 0

    def _learn(self, texts: list[str]) -> None:
        """Remember the ids of new pre-tokens."""
        found = [self.merges(x) for x in texts]
        lengths = np.array([len(x) for x in found])
        flat = np.fromiter(chain.from_iterable(found), np.uint32, lengths.sum())
        n = len(self.known)
        while n + len(found) > len(self.starts):
            self.starts, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.starts[n : n + len(found)] = self.n_ids + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(found)] = lengths
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n_ids += len(flat)
        self.known.update(zip(texts, range(n, n + len(found)), strict=True))

    def _marked(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The texts that hold a special token's string."""
        whole, found = data.tobytes(), set()
        for mark in self.special:
            at = whole.find(mark)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(mark) <= offsets[text + 1]:
                    found.add(text)
                    at = int(offsets[text + 1]) - 1
                at = whole.find(mark, at + 1)
        return sorted(found)

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk's texts end to end, and where each text's ids start (and the end)."""
        marked = self._marked(data, offsets)
        if not marked:
            return self._encode(data, offsets)
        ids, sizes, lo = [], [], 0
        for i in [*marked, len(offsets) - 1]:
            parts = [self._encode(data[offsets[lo] : offsets[i]], offsets[lo : i + 1] - offsets[lo])] if i > lo else []
            if i < len(offsets) - 1:
                parts.append(self._by_library([data[offsets[i] : offsets[i + 1]].tobytes().decode()]))
            ids += [x for x, _ in parts]
            sizes += [np.diff(x) for _, x in parts]
            lo = i + 1
        return np.concatenate(ids), np.concatenate((np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes))))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        edges = heads[offsets]
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(points) and (_classes()[points] == _UNASSIGNED).any():
            # Characters whose class this Python doesn't know: the tokenizer does it all.
            return self._by_library([text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)])
        starts = pre_tokens(points, edges)
        ends = np.append(starts[1:], len(points))
        _, index, inverse = np.unique(W.byte_hashes(points, 4 * starts, 4 * ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER:
            self._forget()
        keys = [text[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)]
        fresh = [x for x in keys if x not in self.known]
        if fresh:
            self._learn(fresh)
        slot = np.fromiter((self.known[x] for x in keys), np.int64, len(keys))[inverse]
        lengths = self.lengths[slot]
        total = np.concatenate(([0], np.cumsum(lengths)))
        flat = self.ids[np.repeat(self.starts[slot] - total[:-1], lengths) + np.arange(total[-1])]
        return flat, total[np.searchsorted(starts, edges)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
