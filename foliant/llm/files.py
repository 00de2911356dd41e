"""Files in the shared folder, read and written by tasks."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs, ...) and the path in it."""
    return fs.FileSystem.from_uri(uri)


@contextmanager
def create(uri: str):
    """A new file that appears under its name when complete.

    Repeated or parallel attempts of a task write the same bytes, so whichever
    is moved last is right.
    """
    system, path = resolve(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt, compression=None) as f:
        yield f
    system.move(attempt, path)


def open_stream(uri: str) -> BinaryIO:
    system, path = resolve(uri)
    return system.open_input_stream(path, compression=None)


def open_random(uri: str) -> BinaryIO:
    system, path = resolve(uri)
    return system.open_input_file(path)
