"""Lines of text files as a Spark data source, with their place in the file.

Append-only logs and caches say by the order of lines what holds last. A line
comes with its file, the byte at which it starts and, in batches, its number, so
that this order needs no column of its own. Large files are read in splits. As a
stream the source follows files that grow: each micro-batch has the lines that
were completed since the one before.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

FORMAT = "foliant_lines"
SPLIT = 64 << 20
SCHEMA = "path string, start long, n long, offset long, value string"


@dataclass
class Span(InputPartition):
    """The lines of a file that start in [start, end)."""

    path: str
    start: int
    end: int


def _place(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _files(root: str, suffix: str) -> tuple[fs.FileSystem, dict[str, int]]:
    """Files at or below a path, by name and size; hidden ones are left out."""
    system, path = _place(root)
    info = system.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    keep = [f for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith(("_", "."))]
    return system, {f.path: f.size for f in keep}


def _spans(path: str, start: int, end: int, split: int) -> list[Span]:
    return [Span(path, at, min(at + split, end)) for at in range(start, end, split)]


def _lines(system: fs.FileSystem, span: Span) -> Iterator[pa.RecordBatch]:
    """The span's lines in batches; bytes that are no UTF-8 become replacement characters, and line ends \\n or \\r\\n are cut."""
    with io.BufferedReader(system.open_input_file(span.path), 1 << 20) as f:
        at = span.start
        if at:  # a line that begins in the split before belongs there
            f.seek(at - 1)
            at += len(f.readline()) - 1
        f.seek(at)
        rows, n, size = [], 0, 0
        while at < span.end:
            line = f.readline()
            if not line:
                break
            rows.append((span.path, span.start, n, at, line.decode("utf-8", "replace").removesuffix("\n").removesuffix("\r")))
            at, n, size = at + len(line), n + 1, size + len(line)
            if size > 4 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "start", "n", "offset", "value"])


def _whole(system: fs.FileSystem, path: str, size: int, from_: int) -> int:
    """The byte behind the last complete line of a file, or from_ if none was completed behind that."""
    with system.open_input_file(path) as f:
        end = size
        while end > from_:
            start = max(from_, end - (1 << 16))
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return from_


class Lines(DataSource):
    """Options: path (a file or folder), suffix of file names, split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return LinesStreamReader(self.options)


class LinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.split = options["path"], options.get("suffix", ""), int(options.get("split", SPLIT))

    def partitions(self) -> list[Span]:
        return [s for path, size in sorted(_files(self.path, self.suffix)[1].items()) for s in _spans(path, 0, size, self.split)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span is not None:  # no files, no spans
            yield from _lines(_place(self.path)[0], span)


class LinesStreamReader(DataSourceStreamReader):
    """An offset is the byte behind the last complete line of each file, as JSON in one field."""

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.split = options["path"], options.get("suffix", ""), int(options.get("split", SPLIT))
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        system, files = _files(self.path, self.suffix)
        self.last = {p: _whole(system, p, size, min(self.last.get(p, 0), size)) for p, size in sorted(files.items())}
        return {"files": json.dumps(self.last)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        seen, now = json.loads(start["files"]), json.loads(end["files"])
        return [s for p, to in now.items() if to > seen.get(p, 0) for s in _spans(p, seen.get(p, 0), to, self.split)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span is not None:
            yield from _lines(_place(self.path)[0], span)


def read_lines(spark: SparkSession, path: str, suffix: str = "", split: int = SPLIT) -> DataFrame:
    """path, line_no (from 1), offset, value of each line; lines of a split are numbered by the lines of those before it."""
    spark.dataSource.register(Lines)
    rows = spark.read.format(FORMAT).options(path=path, suffix=suffix, split=split).load()
    per = rows.groupBy("path", "start").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(per.select("path", "start", before.alias("_before")), ["path", "start"]).select("path", (F.col("n") + F.col("_before") + 1).alias("line_no"), "offset", "value")


def stream_lines(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, offset, value of lines as they are completed."""
    spark.dataSource.register(Lines)
    return spark.readStream.format(FORMAT).options(path=path, suffix=suffix).load().select("path", "offset", "value")
