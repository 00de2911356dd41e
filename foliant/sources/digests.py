"""SHA-256 of large files in pieces: a digest's state is handed from task to task, so that none reads more than a piece."""

from __future__ import annotations

import ctypes
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources.scratch import cut

#: Bytes of a file that one task reads at most.
PIECE = 256 << 20
#: Bytes of OpenSSL's SHA256_CTX: 8 words of the digest, 2 of the length, a block, and 2 words more.
STATE = 112


def _openssl() -> ctypes.CDLL:
    """The library behind hashlib, whose own objects can't be stored."""
    import _hashlib

    return ctypes.CDLL(_hashlib.__file__)


def _open(path: str):
    """A file by the path that Spark gives, which isn't encoded."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, place = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(place)


def advance(path: str, at: int, size: int, state: bytes | None, last: bool) -> bytes:
    """The state behind size bytes of a file from at, given that before them (none at its start); the digest itself if they are the last."""
    lib, ctx = _openssl(), ctypes.create_string_buffer(bytes(state or b""), STATE)
    if state is None:
        lib.SHA256_Init(ctx)
    with _open(path) as f:
        f.seek(at)
        while size:
            part = f.read(min(size, 1 << 20))
            if not part:
                raise OSError(f"{path} has become shorter")
            lib.SHA256_Update(ctx, part, ctypes.c_size_t(len(part)))
            size -= len(part)
    if not last:
        return ctx.raw
    out = ctypes.create_string_buffer(32)
    lib.SHA256_Final(out, ctx)
    return out.raw


def long_digests(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """path, sha256 of files (path, length): all advance by a piece in a round, in a task for each file."""
    step = F.udf(advance, "binary")
    rows = cut(files.select("path", "length", F.lit(None).cast("binary").alias("state")), "digests")
    n, longest = rows.agg(F.count("*"), F.max("length")).first()
    for at in range(0, longest or 0, piece):
        left = F.col("length") - at
        now = step("path", F.lit(at), F.least(left, F.lit(piece)), "state", left <= piece)
        # each path is a range of its own
        going = rows.where(left > 0).repartitionByRange(n, "path").select("path", "length", now.alias("state"))
        rows = cut(going.unionByName(rows.where(left <= 0)), "digests")
    return rows.select("path", F.lower(F.hex("state")).alias("sha256"))
