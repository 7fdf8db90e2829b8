"""Words, word hashes and n-gram hashes of whole texts, computed on Arrow buffers with numpy.

A word is ``[^\\x20\\x09-\\x0D]+``, optionally after lower-casing A-Z only. Hashes are 64-bit
polynomials over random byte values, finished by a mixing step. Two different words or n-grams share
a hash with a probability of about 2**-60 a pair; where a result depends on equality, that is the
error bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.cumprod(np.full(64, _BASE, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on every other."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_up_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), _BASE, np.uint64), dtype=np.uint64)
    return _powers


@dataclass
class Words:
    """Words of consecutive texts: byte ranges in ``buf``, a hash each, and where each text's words begin."""

    buf: np.ndarray  # bytes of all texts
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of text i: words first[i] to first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def spaced(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the words ``at``, each with a space after it, and where each one's begin (one more: the end)."""
        size = self.end[at] - self.start[at] + 1
        edges = np.concatenate([[0], np.cumsum(size)])
        if not len(at):
            return np.zeros(0, np.uint8), edges
        text = np.take(self.buf, np.arange(edges[-1]) + np.repeat(self.start[at] - edges[:-1], size), mode="clip")
        text[edges[1:] - 1] = 0x20
        return text, edges


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset of each text in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def words_of(column: pa.Array | pa.ChunkedArray, lower: bool) -> Words:
    buf, offsets = text_bytes(column)
    if lower:
        buf = _LOWER[buf]
    solid = ~_SPACE[buf]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]  # a text's border ends a word
    inner = inner[(inner > 0) & (inner < len(buf))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Words(buf, start, end, _hashes(buf, start, end), np.searchsorted(start, offsets))


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = 1 << 15) -> np.ndarray:
    """A hash for each word, some thousand words at a time, so that the steps stay in the cache."""
    out = np.empty(len(start), np.uint64)
    for lo in range(0, len(start), piece):
        s, e = start[lo : lo + piece], end[lo : lo + piece]
        size = e - s
        at = np.cumsum(size) - size
        within = np.arange(at[-1] + size[-1]) - np.repeat(at, size)
        value = _BYTE[buf[within + np.repeat(s, size)]]
        value *= _powers_up_to(int(size.max()))[within]
        out[lo : lo + piece] = mix(np.add.reduceat(value, at) + size.astype(np.uint64))
    return out


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n consecutive words, by doubling; shorter by n - 1 than the input."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(int(_STEP), k, 2**64))
    runs, length, out, done = hashes, 1, None, 0
    while True:
        if n & length:
            if out is None:
                out = runs
            else:  # the run so far covers ``done`` words; put this one before it
                out = runs[: len(runs) - done] * power(done) + out[length : length + len(runs) - done]
            done += length
        if done == n:
            return mix(out[: len(hashes) - n + 1])
        runs = runs[: len(runs) - length] * power(length) + runs[length:]
        length *= 2


@dataclass
class Grams:
    """Distinct word n-grams of consecutive texts: those of text i are hash[first[i]:first[i + 1]], ascending."""

    hash: np.ndarray
    first: np.ndarray


def shingle_sets(words: Words, n: int = 5) -> Grams:
    """Distinct n-word shingles of each text; a text of fewer words is one shingle, one without words none."""
    every, sets = ngram_hashes(words.hash, n), []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if hi - lo >= n:
            ranked = np.sort(every[lo : hi - n + 1])
            sets.append(ranked[np.concatenate([[True], ranked[1:] != ranked[:-1]])])
        else:
            sets.append(mix(_sequence(words.hash[lo:hi])) if hi > lo else words.hash[:0])
    return Grams(np.concatenate([words.hash[:0], *sets]), np.cumsum([0, *map(len, sets)]))


def _sequence(hashes: np.ndarray) -> np.ndarray:
    total = len(hashes)
    for h in hashes:
        total = (total * int(_STEP) + int(h)) % 2**64
    return np.array([total], np.uint64)
