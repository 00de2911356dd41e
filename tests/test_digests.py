"""Digests in pieces beside hashlib."""

import hashlib
import random

from foliant.sources import tables as A


def test_no_task_reads_more_than_a_piece(spark, tmp_path):
    r, want = random.Random(3), {}
    for i, n in enumerate((1, 2, 999, 1000, 1001, 2000, 2065, 5500)):
        data = r.randbytes(n)
        (tmp_path / f"a b%20é{i}.docx").write_bytes(data)
        want[f"a b%20é{i}.docx"] = hashlib.sha256(data).hexdigest()
    found = A.fingerprint(A.discover_files(spark, str(tmp_path)), 1000)
    assert {x.path.split("/")[-1]: x.sha256 for x in found.collect()} == want


def test_state_goes_on_within_a_block(tmp_path):
    from foliant.sources.digests import advance

    data = random.Random(4).randbytes(3_000_000)
    (tmp_path / "x").write_bytes(data)
    state, at = None, 0
    for size in (1, 62, 1, 1_999_999, 999_937):
        state = advance(f"file:{tmp_path}/x", at, size, state, at + size == len(data))
        at += size
    assert at == len(data) and state == hashlib.sha256(data).digest()
