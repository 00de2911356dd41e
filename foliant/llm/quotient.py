"""Counting quotient filters: lossless, compact counters of packed word-id n-grams.

An n-gram of 2 to 4 word ids is packed to two halves, left and right, and
permuted invertibly, so that its bits are spread evenly. The leading bits of
the permuted key are its quotient, all its other bits the remainder. A filter
holds its keys in order: for each quotient how many keys it has, as runs of
ones that end in a zero, and for each key its remainder and count. As the whole
remainder is kept and the permutation can be undone, nothing is lost or
confused. Filters are merged by merging their sorted keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from foliant.llm.words import mix

_ROUNDS = [np.uint64(0x9E3779B97F4A7C15 * k % 2**64) for k in range(1, 9)]
_U = np.uint64


@dataclass(frozen=True)
class Layout:
    """n ids of bits each (32 at most): the first n - 2 of them (at least one) are the left half, the others the right."""

    n: int
    bits: int

    @property
    def left(self) -> int:
        return self.bits * (2 if self.n == 4 else 1)

    @property
    def right(self) -> int:
        return self.bits * (1 if self.n == 2 else 2)

    @property
    def narrow(self) -> bool:
        return self.left + self.right <= 64


@dataclass
class Keys:
    """Permuted keys, as two halves."""

    left: np.ndarray
    right: np.ndarray

    def __len__(self) -> int:
        return len(self.left)

    def __getitem__(self, at) -> Keys:
        return Keys(self.left[at], self.right[at])


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def pack(ids: list[np.ndarray], layout: Layout) -> Keys:
    """The permuted keys of n-grams, from an array for each of their words."""
    ids = [x.astype(np.uint64) for x in ids]
    b = _U(layout.bits)
    halves = ([ids[0]], ids[1:]) if layout.n < 4 else (ids[:2], ids[2:])
    left, right = ((h[0] << b | h[1]) if len(h) == 2 else h[0].copy() for h in halves)
    for k in range(0, 8, 2):
        left ^= mix(right + _ROUNDS[k]) & _mask(layout.left)
        right ^= mix(left + _ROUNDS[k + 1]) & _mask(layout.right)
    return Keys(left, right)


def unpack(keys: Keys, layout: Layout) -> np.ndarray:
    """The ids of permuted keys, a row for each."""
    left, right = keys.left.copy(), keys.right.copy()
    for k in range(6, -1, -2):
        right ^= mix(left + _ROUNDS[k + 1]) & _mask(layout.right)
        left ^= mix(right + _ROUNDS[k]) & _mask(layout.left)
    b, m = _U(layout.bits), _mask(layout.bits)
    of = lambda half, width: [half >> b, half & m] if width > layout.bits else [half]
    return np.stack([*of(left, layout.left), *of(right, layout.right)], axis=1).astype(np.int64)


def summed(keys: Keys, counts: np.ndarray | None, layout: Layout) -> tuple[Keys, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of their counts (None: each once), and for each given key its place among them."""
    if layout.narrow:
        key = keys.left << _U(layout.right) | keys.right
        order = np.argsort(key, kind="stable")  # merges runs that are sorted already
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((keys.right, keys.left))
        left, right = keys.left[order], keys.right[order]
        new = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    first = np.concatenate(([0], np.flatnonzero(new) + 1)) if len(order) else np.zeros(0, np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    if counts is None:
        total = np.diff(np.append(first, len(order)))
    else:
        total = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
    return keys[order[first]], total.astype(np.int64), place


def _bytes(half: np.ndarray, bits: int) -> bytes:
    """The lowest bits of each number, in whole bytes."""
    return half.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - -(-bits // 8) :].tobytes() if bits else b""


def _numbers(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    if bits:
        wide[:, 8 - -(-bits // 8) :] = data.reshape(n, -1)
    return wide.reshape(-1).view(">u8").astype(np.uint64) if n else np.zeros(0, np.uint64)


def freeze(keys: Keys, counts: np.ndarray, layout: Layout, cut: int) -> bytes:
    """The filter of distinct sorted keys that share their first cut bits.

    It has the quotient's length, the number of keys and of counts of 255 and
    more, the runs, the remainders, the counts in a byte each, and those of 255
    and more again in full.
    """
    n = len(keys)
    q = min(layout.left - cut, max(1, n.bit_length() - 1))
    rest = layout.left - cut - q
    quotient = ((keys.left >> _U(rest)) & _mask(q)).astype(np.int64)
    runs = np.zeros((1 << q) + n, np.uint8)
    runs[quotient + np.arange(n)] = 1
    large = np.flatnonzero(counts >= 255)
    head = np.array([q, n, len(large)], np.uint32).tobytes()
    remainder = _bytes(keys.left & _mask(rest), rest) + _bytes(keys.right, layout.right)
    return head + np.packbits(runs).tobytes() + remainder + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype(np.int64).tobytes()


def thaw(data: bytes, layout: Layout, cut: int, shard: int) -> tuple[Keys, np.ndarray]:
    """The keys, in order, and counts of a filter whose keys' first cut bits are the shard's number."""
    q, n, large = (int(x) for x in np.frombuffer(data, np.uint32, 3))
    raw = np.frombuffer(data, np.uint8, offset=12)
    rest = layout.left - cut - q
    sizes = [-(-((1 << q) + n) // 8), n * -(-rest // 8), n * -(-layout.right // 8), n, large * 8]
    runs, low, right, counts, full = np.split(raw[: sum(sizes)], np.cumsum(sizes)[:-1])
    quotient = np.flatnonzero(np.unpackbits(runs)[: (1 << q) + n]) - np.arange(n)
    left = _U(shard) << _U(layout.left - cut) if cut else _U(0)
    left = left | quotient.astype(np.uint64) << _U(rest) | _numbers(low, n, rest)
    counts = counts.astype(np.int64)
    counts[counts == 255] = np.frombuffer(full.tobytes(), np.int64)
    return Keys(left, _numbers(right, n, layout.right)), counts
