"""Token counts of a unigram model by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a blank mark and a word; it is cut into vocabulary pieces so that the sum of their scores is largest, with
its bytes as pieces where no piece fits. A task inserts the distinct pre-tokens of a chunk of texts in a trie and goes
through it level by level: all prefixes of one length at once, each once however many pre-tokens share it. A prefix keeps
its best score and the pieces of its best cut; those where a pre-token ends are its count. A text's count is the sum over
its words. Nothing is shuffled, and a chunk bounds the trie. A word of more than ``LONG`` bytes, which shares its prefixes
with no other, is gone through alone by the same recurrence over its matches.

The pieces are those of a public vocabulary file; nothing is trained. A piece's score is the logarithm of Zipf's share of
its rank in the file. Of cuts with one score (to a millionth) the one with fewer pieces counts.

Defined cases: null and blank texts have no token; repeated rows give equal rows; an empty table gives an empty one; null
ids stay null; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import words as W
from factloom.session import configure

BLANK = "▁"
#: Scores are whole millionths, so that sums are exact and equal cuts are equal.
UNIT = 1_000_000
#: Bytes of the longest word that goes into the trie.
LONG = 256
_BASE = 0x9FB21C651E98DF25
#: Bytes of texts that share a trie; each of its levels costs a few calls however few prefixes it has.
CHUNK = 2 << 20


class Pieces:
    """The pieces of a vocabulary by hash of their UTF-8 bytes, and what a byte costs where no piece fits."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranked = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        total = math.log(sum(1 / r for r in range(1, len(ranked) + 1)))
        self.scores = {p: round(UNIT * (-math.log(r) - total)) for r, p in enumerate(ranked, 1)}
        self.byte = 2 * min(self.scores.values())
        texts = [p.encode() for p in self.scores]
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        hashes = W.range_hashes(data + np.uint16(1), np.concatenate(([0], ends[:-1])), ends, _BASE)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.array(list(self.scores.values()), np.int64)[order]
        self.lengths = sorted({len(t) for t in texts})
        self.matches = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and their scores."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, self.values[at]


    def count(self, text: str) -> int:
        """Number of pieces of one pre-token, by its matches from left to right."""
        # Score and, negative, pieces of the best cut of each prefix.
        best = [(0, 0)] * (len(text) + 1)
        found = self.matches.iter(text)
        end, match = next(found, (len(text), None))
        for i, char in enumerate(text):
            n = len(char.encode())
            score, minus = best[i]
            here = (score + n * self.byte, minus - n)
            while end == i:
                size, value = match
                score, minus = best[i + 1 - size]
                here = max(here, (score + value, minus - 1))
                end, match = next(found, (len(text), None))
            best[i + 1] = here
        return -best[-1][1]


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def trie_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Number of pieces of each byte range (a distinct pre-token)."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    lengths = ends - starts
    deepest = int(lengths.max())
    prefixes = W.Prefixes(data + np.uint16(1), _BASE)
    out = np.zeros(n, np.int64)
    # Nodes of the levels that a piece can reach back to: for each pre-token its node, and by node score and pieces.
    back = max(vocabulary.lengths)
    levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {0: (np.zeros(n, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))}
    ids = live = np.arange(n)
    node_of = np.zeros(n, np.int64)
    for depth in range(1, deepest + 1):
        live = live[lengths[live] >= depth]
        if 4 * len(live) < len(ids):
            # Pre-tokens that ended are left behind.
            ids, starts, lengths, node_of = ids[live], starts[live], lengths[live], node_of[live]
            levels = {d: (nodes[live], scores, counts) for d, (nodes, scores, counts) in levels.items()}
            live = np.arange(len(ids))
        # A node is its parent and a byte.
        step = node_of[live] * 256 + data[starts[live] + depth - 1]
        _, first, node = np.unique(step, return_index=True, return_inverse=True)
        node_of[live] = node
        member = live[first]
        score = np.full(len(first), np.iinfo(np.int64).min // 2)
        count = np.zeros(len(first), np.int64)
        for length in (x for x in vocabulary.lengths if x <= depth):
            nodes, scores, counts = levels[depth - length]
            begin = starts[member] + depth - length
            hit, value = vocabulary.find(prefixes.hashes(begin, begin + length))
            hit &= (data[begin] & 0xC0) != 0x80
            score, count = _better(score, count, np.flatnonzero(hit), scores[nodes[member]] + value, counts[nodes[member]] + 1)
        nodes, scores, counts = levels[depth - 1]
        score, count = _better(score, count, np.arange(len(first)), scores[nodes[member]] + vocabulary.byte, counts[nodes[member]] + 1)
        levels[depth] = (node_of.copy(), score, count)
        levels.pop(depth - back, None)
        done = live[lengths[live] == depth]
        out[ids[done]] = count[node_of[done]]
    return out


def _better(score: np.ndarray, count: np.ndarray, at: np.ndarray, new_score: np.ndarray, new_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    take = at[(new_score[at] > score[at]) | ((new_score[at] == score[at]) & (new_count[at] < count[at]))]
    score[take], count[take] = new_score[take], new_count[take]
    return score, count


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocabulary = pieces(path)
    mark = np.frombuffer(BLANK.encode(), np.uint8)
    for batch in batches:
        for lo, hi, data, offsets in W.chunks(batch.column("text"), CHUNK):
            w = W.Words(data, offsets)
            _, first, of = np.unique(w.hashes(data), return_index=True, return_inverse=True)
            sizes = w.ends[first] - w.starts[first]
            # The distinct words end to end, each behind a blank mark.
            # The trie gains nothing on a long word, and would take a round for each of its bytes.
            long = np.flatnonzero(sizes > LONG)
            alone = [vocabulary.count(BLANK + data[w.starts[i] : w.ends[i]].tobytes().decode()) for i in first[long]]
            kept = np.flatnonzero(sizes <= LONG)
            every, first, sizes = first, first[kept], sizes[kept]
            edges = np.concatenate(([0], np.cumsum(sizes + len(mark))))
            flat = np.empty(edges[-1], np.uint8)
            for i, b in enumerate(mark):
                flat[edges[:-1] + i] = b
            source = np.repeat(w.starts[first] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            target = np.repeat(edges[:-1] + len(mark) - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            flat[target] = data[source]
            counts = np.zeros(len(every), np.int64)
            counts[kept] = trie_counts(flat, edges[:-1], edges[1:], vocabulary)
            counts[long] = alone
            tokens = W.sums(counts[of], w.first)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(w.counts, pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_words", "n_tokens"])


def count(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(id, n_words, n_tokens) of every document."""
    configure(docs.sparkSession)
    return docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(partial(_count, path=vocabulary), "id long, n_words long, n_tokens long")
