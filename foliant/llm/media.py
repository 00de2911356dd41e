"""Media columns in ISO media containers.

Writing puts a payload into a container: a file-type box, a movie box with one
track and its sample tables, and a media-data box with the payload as 8-bit
samples. Reading walks the nested boxes and decodes the sample tables, which
give codec, duration and the byte ranges of samples and keyframes; the payload
is read from those ranges, and never decoded.

Containers are columns of rows, so Spark spreads and recovers them like any
other; a row's container passes through one task.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.llm.storage import lean

#: Payloads are padded with zero bytes to a positive multiple of this.
UNIT = 64
#: Bytes of a sample, samples of a chunk, and samples from one keyframe to the next.
SAMPLE_BYTES, CHUNK_SAMPLES, KEY_EVERY = 1024, 16, 8
#: Ticks a second, and ticks of a sample: one for each 8-bit unit.
TIMESCALE = 8000
CODEC = b"raw "
#: Boxes that hold boxes.
NESTED = frozenset((b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes) -> bytes:
    return payload + bytes(max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def write_container(payload: bytes) -> bytes:
    """A container with the payload in samples of SAMPLE_BYTES, the last one shorter; the first of each KEY_EVERY is a keyframe."""
    sizes = [SAMPLE_BYTES] * (len(payload) // SAMPLE_BYTES)
    if len(payload) % SAMPLE_BYTES or not sizes:
        sizes.append(len(payload) % SAMPLE_BYTES)
    n, duration = len(sizes), len(payload)
    chunks = -(-n // CHUNK_SAMPLES)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    times = [(n - 1, SAMPLE_BYTES), (1, sizes[-1])] if n > 1 else [(1, sizes[0])]
    runs = [(1, min(CHUNK_SAMPLES, n))]
    if chunks > 1 and n % CHUNK_SAMPLES:
        runs.append((chunks, n % CHUNK_SAMPLES))
    keys = range(1, n + 1, KEY_EVERY)
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"mp42")

    def movie(first: int) -> bytes:
        offsets = [first + i * CHUNK_SAMPLES * SAMPLE_BYTES for i in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        places = full_box(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets))
        table = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(f">I{2 * len(times)}I", len(times), *(x for t in times for x in t))),
            full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full_box(b"stsc", struct.pack(f">I{3 * len(runs)}I", len(runs), *(x for chunk, per in runs for x in (chunk, per, 1)))),
            full_box(b"stsz", struct.pack(f">II{n}I", 0, n, *sizes)),
            places,
        )
        info = box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), table)
        media = box(b"mdia", full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1), full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"), info)
        track = box(b"trak", full_box(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7), media)
        movie_head = full_box(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, duration, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", movie_head, track)

    data = box(b"mdat", payload)
    lead = len(data) - len(payload)
    size = len(movie(0))
    moov = movie(len(head) + size + lead)
    if len(moov) != size:  # offsets beyond 4 GB took more room
        moov = movie(len(head) + len(moov) + lead)
    return head + moov + data


@dataclass
class Track:
    """What the sample tables of a track say."""

    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray  # of samples
    sizes: np.ndarray
    keys: np.ndarray  # sample numbers from 0

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges [start, end) of keyframes."""
        return [(int(self.offsets[k]), int(self.offsets[k] + self.sizes[k])) for k in self.keys]


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end of the body) of each box, parents before children. A box that leaves its parent is an error."""
    at, end = start, len(data) if end is None else end
    while at < end:
        if end - at < 8:
            raise ValueError("a box is cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield (*path, kind), body, at + size
        if kind in NESTED:
            yield from walk(data, body, at + size, (*path, kind))
        at += size


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container; media data are not touched."""
    view, found = memoryview(data), []
    for path, body, end in walk(view):
        if path == (b"moov", b"trak"):
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1][path[-1]] = (body, end)
    return [_track(view, own) for own in found if b"stsz" in own]


def _numbers(view: memoryview, at: int, n: int, kind: str = ">u4") -> np.ndarray:
    return np.frombuffer(view, kind, n, at).astype(np.int64)


def _track(view: memoryview, boxes: dict[bytes, tuple[int, int]]) -> Track:
    at = boxes[b"mdhd"][0]
    timescale, duration = struct.unpack_from(">IQ" if view[at] == 1 else ">II", view, at + (20 if view[at] == 1 else 12))
    codec = bytes(view[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16]).decode("latin-1")
    same, n = struct.unpack_from(">II", view, boxes[b"stsz"][0] + 4)
    sizes = np.full(n, same, np.int64) if same else _numbers(view, boxes[b"stsz"][0] + 12, n)
    wide = b"co64" in boxes
    at = boxes[b"co64" if wide else b"stco"][0]
    (chunks,) = struct.unpack_from(">I", view, at + 4)
    places = _numbers(view, at + 8, chunks, ">u8" if wide else ">u4")
    at = boxes[b"stsc"][0]
    (runs,) = struct.unpack_from(">I", view, at + 4)
    first, per = _numbers(view, at + 8, 3 * runs).reshape(-1, 3)[:, :2].T
    per = np.repeat(per, np.diff(np.append(first, chunks + 1)))
    chunk = np.repeat(np.arange(chunks), per)[:n]
    before = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    head = np.concatenate(([0], np.cumsum(per)))[:-1]  # first sample of each chunk
    offsets = places[chunk] + before - before[head[chunk]] if n else np.zeros(0, np.int64)
    keys = np.arange(n)
    if b"stss" in boxes:
        (count,) = struct.unpack_from(">I", view, boxes[b"stss"][0] + 4)
        keys = _numbers(view, boxes[b"stss"][0] + 8, count) - 1
    return Track(codec, timescale, duration, offsets, sizes, keys)


def read_payload(data: bytes, track: Track) -> bytes:
    """The track's samples in order, read by their byte ranges."""
    view, ends = memoryview(data), track.offsets + track.sizes
    apart = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1  # neighbouring samples are read together
    edges = [0, *apart.tolist(), len(ends)]
    return b"".join(view[track.offsets[a] : ends[z - 1]] for a, z in zip(edges[:-1], edges[1:], strict=True) if z > a)


def store(df: DataFrame, column: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """df with media binary, a container of the column's bytes (text as UTF-8) padded to UNIT, and n_bytes, their number unpadded.

    Null counts as empty. The column itself and others pass; added names are replaced.
    """
    def made(values: pa.Array) -> list[pa.Array]:
        raw = [x.as_py() or b"" for x in values.cast(pa.binary() if values.type in (pa.string(), pa.binary()) else pa.large_binary())]
        return [pa.array([write_container(pad(x)) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())]

    return _with(df, column, [(media, T.BinaryType()), (n_bytes, T.LongType())], made)


FEATURES = [
    ("codec", T.StringType()), ("timescale", T.LongType()), ("duration", T.DoubleType()), ("n_samples", T.LongType()),
    ("keyframes", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
]


def probe(df: DataFrame, media: str = "media") -> DataFrame:
    """df with what the first track of each container says, and digests of the payload read back by its sample ranges.

    duration is in seconds; tail_crc32 is that of the last UNIT bytes. Null
    containers, and ones without a track, have null features; a damaged one is
    an error.
    """
    def made(values: pa.Array) -> list[pa.Array]:
        rows = []
        for value in values:
            data = value.as_py()
            found = tracks(data) if data is not None else []
            if not found:
                rows.append((None,) * len(FEATURES))
                continue
            t = found[0]
            payload = read_payload(data, t)
            frames = [{"start": a, "end": z} for a, z in t.keyframes()]
            rows.append((t.codec, t.timescale, t.duration / t.timescale if t.timescale else None, len(t.sizes), frames, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:])))
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.string(), pa.int64()]
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    return _with(df, media, FEATURES, made)


def _with(df: DataFrame, column: str, added: list[tuple], made, rows: int = 256) -> DataFrame:
    names = {name for name, _ in added}
    kept = [f for f in df.schema if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *made(part.column(column))], names=[*part.schema.names, *(a for a, _ in added)])

    return df.select(*(f"`{f.name}`" for f in kept)).mapInArrow(lean(run), T.StructType([*kept, *(T.StructField(a, kind) for a, kind in added)]))
