"""Byte-level BPE by monoid tree reduction.

A node of the tree is a stretch of text with its pre-token pieces; below a
piece's level, a node is a stretch of bytes with its token ids. Halves are
encoded on their own and joined by re-encoding a window around the boundary,
which grows until what lies outside provably stays:

* pieces: the splitting pattern scans forwards and looks ahead at most
  LOOKAHEAD characters, so pieces of the left half that end earlier than that
  before the boundary stay; once the new scan ends a piece where a piece of
  the right half starts, all later pieces stay;
* ids: a token sequence is the encoding of its bytes if each two neighbours
  are the encoding of their joint bytes, so the window may end wherever its
  outermost token and its neighbour outside are such a pair.

Joining is associative, so texts can be cut anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.llm.storage import lean

#: Characters behind a piece's end that can still change it: "'re" has three.
LOOKAHEAD = 4
#: Characters of a leaf of text, bytes of a leaf of a piece, ids of a leaf when decoding.
TEXT_LEAF, BYTE_LEAF, ID_LEAF = 1 << 15, 16, 1 << 12
#: Pieces (twice) and pairs that a worker remembers; after each partition it starts afresh.
MEMORY = 75_000
#: No merge: above every rank.
NONE = 1 << 62


class _Pieces(dict):
    """Packed ids of pieces, encoded when first asked for; once full, those asked for since stay for another round."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        self.encode, self.before = encode, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.before.get(piece)
        if packed is None:
            ids = self.encode(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= MEMORY:
                self.before = dict(self)
                super().clear()
            self[piece] = packed
        return packed

    def clear(self) -> None:
        super().clear()
        self.before = {}


class ByteBPE:
    """Encoder and decoder over ranked byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        #: rank of the token that two tokens join to, by both ids
        self._merges = {left << 32 | right: rank for token, rank in ranks.items() for left, right in self._halves(token)}
        self._bytes = [ranks.get(bytes([x]), NONE) for x in range(256)]
        self._pairs: dict[tuple[int, int], list[int]] = {}
        self._pieces = _Pieces(self.encode_bytes)

    def _halves(self, token: bytes) -> Iterator[tuple[int, int]]:
        for i in range(1, len(token)):
            left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
            if left is not None and right is not None:
                yield left, right

    def forget(self) -> None:
        for known in (self._pairs, self._pieces):
            known.clear()

    # bytes of one piece -> ids

    def _merge(self, data: bytes) -> list[int]:
        """Plain merging, for leaves and windows: always the leftmost pair of lowest rank."""
        ranks = self.ranks
        if len(data) <= 48:
            ids, joined = [self._bytes[x] for x in data], self._merges.get
            pair = [joined(ids[i] << 32 | ids[i + 1], NONE) for i in range(len(ids) - 1)]
            while pair:
                best = min(pair)
                if best == NONE:
                    break
                i = pair.index(best)
                ids[i] = best
                del ids[i + 1], pair[i]
                if i < len(pair):
                    pair[i] = joined(best << 32 | ids[i + 1], NONE)
                if i:
                    pair[i - 1] = joined(ids[i - 1] << 32 | best, NONE)
            return ids
        n = len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, data[i : i + 2]) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (r := ranks.get(pair := part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, pair))
        return [ranks[p] for p in part if p is not None]

    def _pair(self, left: int, right: int) -> list[int]:
        """The ids of the joint bytes of two tokens."""
        ids = self._pairs.get((left, right))
        if ids is None:
            if len(self._pairs) >= MEMORY:
                self._pairs.clear()
            ids = self._pairs[left, right] = self._merge(self.bytes_of[left] + self.bytes_of[right])
        return ids

    def _stays(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their joint bytes."""
        ids = self._pair(left, right)
        return len(ids) == 2 and ids[0] == left

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of joint bytes from the ids of both parts."""
        if not left or not right:
            return left + right
        window = self._pair(left[-1], right[0])
        i = j = 1
        while True:
            grow_left = i < len(left) and not self._stays(left[-i - 1], window[0])
            grow_right = j < len(right) and not self._stays(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[:-i] + window + right[j:]
            i = min(len(left), 2 * i) if grow_left else i
            j = min(len(right), 2 * j) if grow_right else j
            window = self._merge(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one piece: halves, then join. The result is not to be changed."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= BYTE_LEAF:
            return self._merge(data)
        middle = len(data) // 2
        return self.join_ids(self.encode_bytes(data[:middle]), self.encode_bytes(data[middle:]))

    # text -> pieces

    def join_pieces(self, text: str, middle: int, left: list[str], right: list[str]) -> list[str]:
        """The pieces of text from those of text[:middle] and text[middle:]; left and right are used up."""
        at = middle
        while left and at > middle - LOOKAHEAD:
            at -= len(left.pop())
        skipped, seen = 0, middle
        for m in self.pattern.finditer(text, at):
            left.append(m[0])
            end = m.end()
            while seen < end and skipped < len(right):
                seen += len(right[skipped])
                skipped += 1
            if seen == end >= middle:
                break
        left.extend(right[skipped:])
        return left

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern: halves, then join."""
        if len(text) <= TEXT_LEAF:
            return self.pattern.findall(text)
        middle = len(text) // 2
        return self.join_pieces(text, middle, self.pieces(text[:middle]), self.pieces(text[middle:]))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._pieces.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, concatenated up the tree."""
        if len(ids) > 4 * ID_LEAF:
            middle = len(ids) // 8 * 4
            return self.decode(ids[:middle]) + self.decode(ids[middle:])
        return b"".join(map(self.bytes_of.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """The encoder of a rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return ByteBPE(ranks, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", n_tokens: str = "n_tokens", ids: str = "token_ids") -> DataFrame:
    """Add n_tokens long and the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    path is a rank file that each executor's environment has, pattern its
    splitting pattern; special tokens get no meaning. Null texts count as
    empty and have no ids. Columns of the added names are replaced; all others
    pass. Rows stay in their partitions: there is no shuffle.
    """
    return _mapped(df, text, [(n_tokens, T.LongType(), pa.int64()), (ids, T.BinaryType(), pa.binary())], _Encode(path, pattern))


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text", n_tokens: str = "n_tokens", ids: str = "token_ids", decoded: str = "decoded_sha256") -> DataFrame:
    """encode_texts(), with the SHA-256 of the bytes that the ids decode to, in one pass over the texts."""
    return _mapped(df, text, [(n_tokens, T.LongType(), pa.int64()), (ids, T.BinaryType(), pa.binary()), (decoded, T.StringType(), pa.string())], _Both(path, pattern))


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes of packed ids; null ids count as none. An unknown id is an error."""
    return _mapped(df, ids, [(decoded, T.BinaryType(), pa.binary())], _Decode(path, pattern))


class _Encode:
    def __init__(self, path: str, pattern: str):
        self.args = path, pattern

    def __call__(self, values: pa.Array) -> list[list]:
        bpe = load(*self.args)
        ids = [bpe.encode(x.as_py() or "") for x in values]
        return [[len(x) // 4 for x in ids], ids]


class _Decode(_Encode):
    def __call__(self, values: pa.Array) -> list[list]:
        bpe = load(*self.args)
        return [[bpe.decode(x.as_py() or b"") for x in values]]


class _Both(_Encode):
    def __call__(self, values: pa.Array) -> list[list]:
        bpe = load(*self.args)
        n, ids = super().__call__(values)
        return [n, ids, [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]]


def _mapped(df: DataFrame, column: str, added: list[tuple], f: Callable, rows: int = 512) -> DataFrame:
    names = {name for name, _, _ in added}
    kept = [x for x in df.schema if x.name not in names]
    used = df.select(*(f"`{x.name}`" for x in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                made = [pa.array(x, kind) for x, (_, _, kind) in zip(f(part.column(column)), added, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(a for a, _, _ in added)])
        load(*f.args).forget()  # workers outlive their tasks

    return used.mapInArrow(lean(run), T.StructType([*kept, *(T.StructField(a, kind) for a, kind, _ in added)]))
