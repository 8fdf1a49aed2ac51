"""Words, lines and their 64-bit hashes for whole Arrow batches of texts, as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. A word's hash is a sum of its mixed blocks of eight bytes, a window's a
polynomial of its words' hashes modulo a prime; no Python loop runs over words. A chunk holds at most ``CHUNK`` bytes, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PRIME = (1 << 61) - 1
_P, _LOW29, _LOW30, _LOW31, _LOW32 = (np.uint64((1 << n) - 1) for n in (61, 29, 30, 31, 32))
_U29, _U30, _U31, _U32, _U61 = (np.uint64(n) for n in (29, 30, 31, 32, 61))
#: The lowest n bytes of eight.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo 2^61 - 1."""
    x = (x & _P) + (x >> _U61)
    return np.where(x >= _P, x - _P, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, of values below it."""
    a1, a0, b1, b0 = a >> _U31, a & _LOW31, b >> _U31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << np.uint64(1)) + (middle >> _U30) + ((middle & _LOW30) << _U31) + a0 * b0)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse modulo 2^61 - 1."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK // 2 + 1)
        both = []
        for b in (base % _PRIME, pow(base, -1, _PRIME)):
            x = np.ones(1, np.uint64)
            while len(x) < size:
                x = np.concatenate((x, _product(x, np.uint64(pow(b, len(x), _PRIME)))))
            both.append(x[:size])
        have = _powers[base] = (both[0], both[1])
        if size > 4 * CHUNK:
            del _powers[base]
    return have[0][:n], have[1][:n]


class Prefixes:
    """Prefix sums of a polynomial modulo the prime 2^61 - 1; differences are hashes of ranges of values."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = powers(base, len(values) + 1)
        terms = _product(_reduced(values.astype(np.uint64)), up[:-1])
        self.total = np.zeros(len(values) + 1, np.uint64)
        # The halves are summed apart, so that no sum wraps around.
        high = np.cumsum(terms >> _U32)
        self.total[1:] = _reduced((high >> _U29) + ((high & _LOW29) << _U32) + _reduced(np.cumsum(terms & _LOW32)))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        span = _reduced(self.total[ends] + (_P - self.total[starts]))
        return mix(_product(span, self.down[starts]) ^ ((ends - starts).astype(np.uint64) * np.uint64(_BASE)))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Mixed hash of values[start:end] for each range; depends on the values and their order only."""
    return Prefixes(values, base).hashes(starts, ends)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = _BASE) -> np.ndarray:
    """Mixed hash of data[start:end] for each range of bytes; depends on the bytes and their order only.

    Eight bytes are mixed with their number in the range before sums are taken, so no pattern of letters cancels out.
    """
    sizes = ends - starts
    blocks = (sizes + 7) >> 3
    edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(blocks)))
    if len(starts) and blocks.max() == 1 and blocks.min() == 1:
        at, number, left = starts, np.zeros(len(starts), np.uint64), sizes
    else:
        owner = np.repeat(np.arange(len(starts)), blocks)
        number = np.arange(edges[-1]) - edges[owner]
        at = starts[owner] + 8 * number
        left = np.minimum(ends[owner] - at, 8)
    padded = np.concatenate((data.view(np.uint8), np.zeros(8, np.uint8)))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))[at] & _MASKS[left]
    mixed = mix(mix(eight ^ np.uint64(seed)) + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(_WORD_BASE))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
    return mix(total[edges[1:]] - total[edges[:-1]] + sizes.astype(np.uint64) * np.uint64(_BASE))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows' texts) of slices of bounded size; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


class Words:
    """The words of a chunk: byte ranges, and for text d the words first[d] up to first[d + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~spaces(data)
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begin[cuts] = solid[cuts]
        end[cuts - 1] = solid[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, data: np.ndarray, seed: int = _BASE) -> np.ndarray:
        return byte_hashes(data, self.starts, self.ends, seed)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(first: np.ndarray, size: int) -> np.ndarray:
    """Where windows of so many words start; no window reaches over a text's end."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    return np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())


def window_hashes(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    return range_hashes(hashes, starts, starts + size, _WORD_BASE)


def owners(first: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text that each word position is in."""
    return np.searchsorted(first, positions, "right") - 1


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window that starts at one of ``starts``."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + size, n), -1)
    return np.cumsum(steps[:-1]) > 0


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of values between neighbouring edges."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[edges[1:]] - total[edges[:-1]]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))
