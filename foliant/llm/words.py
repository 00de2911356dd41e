"""Vectorised words of Arrow text columns: spans, 64-bit hashes and shingle sets.

Words are maximal runs of word bytes, so both of the library's word rules work
on UTF-8 without decoding: their separators are ASCII, and bytes of other
characters are word bytes throughout. A-Z are lower-cased first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, in lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, _BLOCK + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


@dataclass
class Words:
    """Words of some consecutive texts.

    text: lower-cased bytes; start, end: spans in it; first: for each text its
    first word's number, with the number of all words behind.
    """

    text: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, block by block to bound memory.

        With most, a longer word's hash is that of its first most bytes and no
        whole word's.
        """
        out = np.empty(len(self.start), np.uint64)
        block = self.start // _BLOCK
        cuts = np.flatnonzero(np.diff(block)) + 1 if len(block) else np.zeros(0, int)
        for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
            if hi > lo:
                base, stop = self.start[lo], self.end[hi - 1]
                power, inverse = _power_table(stop - base + 1)
                total = np.zeros(stop - base + 1, np.uint64)
                # bytes count from 1, so that a word is not a prefix of itself padded
                np.cumsum((self.text[base:stop].astype(np.uint64) + np.uint64(1)) * power[: stop - base], out=total[1:])
                s, e = self.start[lo:hi] - base, self.end[lo:hi] - base
                size = (e - s).astype(np.uint64)
                if most is not None:
                    size = np.where(e - s > most, np.uint64(1 << 62), size)
                    e = np.minimum(e, s + most)
                out[lo:hi] = mix((total[e] - total[s]) * inverse[s] + size)
        return out


def slices(column: pa.Array, limit: int = _BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about limit bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    """The words of the texts that raw holds between offsets."""
    text = LOWER[raw]
    n = len(text)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = word_bytes[text]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Words(text, offsets, start, end, np.searchsorted(start, offsets))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    A text with fewer than k words has its whole sequence as one shingle; one
    without words has none.
    """
    h, first = words.hashes(), words.first
    odd = [np.uint64(pow(_BASE, i + 1, 1 << 64)) for i in range(k)]
    n = len(h)
    if n >= k:
        total = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            total += h[i : n - k + 1 + i] * odd[i]
        total = mix(total)
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= k:
            s = np.sort(total[lo : hi - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif hi > lo:
            whole = (h[lo:hi] * np.array(odd[: hi - lo])).sum(keepdims=True) + np.uint64(hi - lo)
            out.append(mix(whole ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
