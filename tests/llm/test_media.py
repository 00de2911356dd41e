"""Containers: round trips, foreign layouts and damage."""

import hashlib
import os
import struct
import zlib

import pytest

from foliant.llm import media as m


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1025, 16384, 16385, 200_001])
def test_round_trip(n):
    payload = m.pad(os.urandom(n))
    data = m.write_container(payload)
    (track,) = m.tracks(data)
    assert len(payload) % 64 == 0 and len(payload) >= max(64, n)
    assert m.read_payload(data, track) == payload
    assert (track.codec, track.duration, track.timescale) == ("raw ", len(payload), 8000)
    for k, (start, end) in zip(track.keys, track.keyframes(), strict=True):
        assert data[start:end] == payload[k * 1024 : (k + 1) * 1024]


def test_other_layouts():
    """Chunks out of order, wide offsets and sizes, 32-bit times, no sync table, unknown boxes."""
    data = b"BBBBAACCC"
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data
    lead = m.box(b"free", b"x" * 5)
    base = len(lead) + 16
    stbl = m.box(
        b"stbl",
        m.full_box(b"stsd", struct.pack(">I", 1), m.box(b"avc1", bytes(70))),
        m.full_box(b"stsz", struct.pack(">II4I", 0, 4, 2, 2, 2, 3)),
        m.full_box(b"stsc", struct.pack(">I6I", 2, 1, 1, 1, 2, 2, 1)),
        m.full_box(b"co64", struct.pack(">I3Q", 3, base + 4, base, base + 6)),
    )
    media = m.box(b"mdia", m.full_box(b"mdhd", struct.pack(">IIII", 0, 0, 25, 100), bytes(4)), m.box(b"minf", stbl))
    whole = lead + mdat + m.box(b"moov", m.box(b"trak", m.box(b"edts"), media))
    (track,) = m.tracks(whole)
    assert (track.codec, track.timescale, track.duration) == ("avc1", 25, 100)
    assert m.read_payload(whole, track) == b"AABBBBCCC"
    assert track.keys.tolist() == [0, 1, 2, 3]


def test_damage_is_an_error():
    data = m.write_container(m.pad(b"x"))
    with pytest.raises(ValueError, match="leaves its parent"):
        m.tracks(data[:-10])
    with pytest.raises(ValueError, match="cut short"):
        m.tracks(data + b"abc")


def test_columns(spark):
    rows = [(1, "é" * 40, "c"), (2, None, None), (3, "", "c"), (1, "é" * 40, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, codec string")
    out = m.probe(m.store(df)).orderBy("doc_id").collect()
    assert [r.n_bytes for r in out] == [80, 80, 0, 0]
    assert [r.payload_bytes for r in out] == [128, 128, 64, 64]
    assert out[0].payload_sha256 == hashlib.sha256(("é" * 40).encode() + bytes(48)).hexdigest()
    assert out[0].tail_crc32 == zlib.crc32((("é" * 40).encode() + bytes(48))[-64:])
    assert (out[0].codec, out[0].media, out[2].n_samples) == ("raw ", out[1].media, 1)
    assert m.probe(spark.createDataFrame([(None,)], "media binary")).first().codec is None
    assert m.store(df.limit(0)).count() == 0
