"""WARC archives: writing, and normalising whole-file gzip to a member for each record.

Some archives are one gzip stream from end to end, in which no record can be
reached without inflating all before it. The normaliser inflates such a stream
once, in pieces of bounded size, rewrites every record as a gzip member of its
own, and writes a sidecar index with each member's place, so that any record
can then be read alone. Archives are files in the shared folder, of ARCHIVE_BYTES
of records and what the last one goes beyond them.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import files
from foliant.llm.storage import cut, lean, new_path

#: Bytes of records, heads included, after which an archive is closed.
ARCHIVE_BYTES = 64 << 20
#: Payloads below this size are stored in full even if another record has the same.
LEAST_REVISIT = 100
#: Rows of an index written at a time.
INDEX_ROWS = 4096
#: Bytes read, and inflated at most, at a time.
PIECE = 1 << 20
_DATE = "1970-01-01T00:00:00Z"
INDEX_SCHEMA = "archive string, offset long, length long, record_id string, record_type string, target_uri string, payload_digest string, refers_to string, content_length long"


def dedup(df: DataFrame, key: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """df with payload_bytes, payload_digest (SHA-256), record_type and refers_to.

    Of rows with equal payloads of at least least bytes that with the smallest
    key is the response, others revisit it. Null payloads are empty. Rows that
    share the smallest key are all responses; with no key but nulls, too.
    Columns of the added names are replaced.
    """
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = df.withColumns({"payload_digest": F.sha2(body, 256), "payload_bytes": F.length(body).cast("long")})
    # who revisits whom follows from keys and digests; payloads then meet it by both, so a common payload is no hot key
    bare = rows.where(F.col("payload_bytes") >= least).select(F.col(key).alias("_key"), F.col("payload_digest").alias("_digest"))
    firsts = bare.groupBy("_digest").agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    again = bare.join(cut(firsts, "firsts"), "_digest").where(~F.col("_key").eqNullSafe(F.col("_first"))).distinct()
    rows = rows.join(cut(again, "revisits"), (F.col("payload_digest") == F.col("_digest")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    revisits = F.col("_first").isNotNull()
    return rows.withColumns({"record_type": F.when(revisits, "revisit").otherwise("response"), "refers_to": F.col("_first")}).drop("_digest", "_key", "_first")


def record(record_id: str, kind: str, uri: str, digest: str, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC/1.0 record with a payload of its own (empty for revisits)."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    head += [("Content-Type", "application/octet-stream"), ("Content-Length", str(len(payload)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.0\r\n" + lines.encode() + b"\r\n" + payload + b"\r\n\r\n"


def field(value: str | None) -> str:
    """A header's value on one line."""
    return " ".join((value or "").split())


def write_monolithic(rows: DataFrame, name: str = "warc") -> DataFrame:
    """Write rows (record_id, record_type, target_uri, payload_digest, refers_to, payload) to archives of one gzip stream; returns archive, its records."""
    folder = new_path(rows.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), []
        source = (row for batch in batches for lo in range(0, batch.num_rows, 64) for row in batch.slice(lo, 64).to_pylist())
        row = next(source, None)
        while row is not None:
            archive, n, size = f"{folder}/{part:06d}-{len(made):04d}.warc.gz", 0, 0
            with files.create(archive) as f:
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                while row is not None and size < ARCHIVE_BYTES:
                    payload = (row["payload"] or b"") if row["record_type"] == "response" else b""
                    whole = record(row["record_id"], row["record_type"], field(row["target_uri"]), row["payload_digest"], row["refers_to"], payload)
                    f.write(packer.compress(whole))
                    n, size = n + 1, size + len(whole)
                    row = next(source, None)
                f.write(packer.flush())
            made.append((archive, n))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["archive", "records"])

    return cut(rows.select("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload").mapInArrow(lean(run), "archive string, records long"), "archives")


class Inflater:
    """Bytes of a gzip file of one or more members, inflated in pieces of bounded size."""

    def __init__(self, f):
        self.file, self.buffer, self.rest = f, bytearray(), b""
        self.stream = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.stream.eof:
            self.rest, self.stream = self.stream.unused_data, zlib.decompressobj(31)
            if not self.rest:
                self.rest = self.file.read(PIECE)
            if not self.rest:
                return False
        elif not self.rest:
            self.rest = self.file.read(PIECE)
            if not self.rest:
                return False
        piece = self.stream.decompress(self.rest, PIECE)
        self.rest = self.stream.unconsumed_tail
        self.buffer += piece
        return True

    def until(self, mark: bytes) -> bytes:
        """Up to and with mark; nothing at the end of the file."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("an archive ends within a record")
                return b""
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def headers(block: bytes) -> dict[str, str]:
    """Names (lower-cased) and values of a record's head."""
    lines = block.decode("utf-8", "replace").strip().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def records(f) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, head, payload) of each record of a gzipped archive, in order."""
    source = Inflater(f)
    while head := source.until(b"\r\n\r\n").lstrip():
        own = headers(head)
        payload = source.take(int(own["content-length"]))
        source.take(4)
        yield own, head, payload


def normalise(archives: DataFrame, archive: str = "archive") -> DataFrame:
    """Rewrite archives with a gzip member for each record; returns the index (INDEX_SCHEMA), a row for each record.

    Beside each new file lies its index, as lines of JSON, under the same name
    with .index. Archives are spread over tasks, each task streams through its
    own.
    """
    spark = archives.sparkSession
    folder = new_path(spark, "warc-members")
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{folder}/{source.rpartition('/')[2]}"
                index: list[dict] = []
                with files.open_stream(source) as f, files.create(target) as out, files.create(f"{target}.index") as side:
                    at = 0
                    for own, head, payload in records(f):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(head) + packer.compress(payload) + packer.compress(b"\r\n\r\n") + packer.flush()
                        out.write(member)
                        index.append({
                            "archive": target, "offset": at, "length": len(member), "record_id": own["warc-record-id"].strip("<>"), "record_type": own["warc-type"],
                            "target_uri": own.get("warc-target-uri", ""), "payload_digest": own.get("warc-payload-digest", "").rpartition(":")[2],
                            "refers_to": own["warc-refers-to"].strip("<>") if "warc-refers-to" in own else None, "content_length": len(payload),
                        })
                        at += len(member)
                        if len(index) == INDEX_ROWS:
                            yield _indexed(index, side)
                            index = []
                    yield _indexed(index, side)

    return cut(archives.select(archive).repartition(width, archive).mapInArrow(lean(run), INDEX_SCHEMA), "index")


def _indexed(index: list[dict], side: BinaryIO) -> pa.RecordBatch:
    """Rows of the index, written to the sidecar as well."""
    side.write("".join(json.dumps(x) + "\n" for x in index).encode())
    return pa.RecordBatch.from_pylist(index, _index_type())


def _index_type() -> pa.Schema:
    return pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (x.split() for x in INDEX_SCHEMA.split(", "))])


def read(index: DataFrame) -> DataFrame:
    """The records at the index's places, each member inflated alone: the index's columns and payload binary.

    A response whose payload doesn't have its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part, payloads = batch.slice(lo, 64), []
                for row in part.to_pylist():
                    if row["archive"] != name:
                        if f:
                            f.close()
                        name, f = row["archive"], files.open_random(row["archive"])
                    f.seek(row["offset"])
                    block = zlib.decompress(f.read(row["length"]), 31)
                    head, _, rest = block.partition(b"\r\n\r\n")
                    own = headers(head)
                    payload = rest[: int(own["content-length"])]
                    if own["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != row["payload_digest"]:
                        raise ValueError(f"record {row['record_id']} is damaged")
                    payloads.append(payload)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary())], names=[*part.schema.names, "payload"])
        if f:
            f.close()

    return index.mapInArrow(lean(run), INDEX_SCHEMA + ", payload binary")


def record_id(key: Column) -> Column:
    return F.concat(F.lit("urn:record:"), F.coalesce(key.cast("string"), F.lit("null")))


def key_of(record_id: Column, kind: str) -> Column:
    return F.regexp_extract(record_id, r"^urn:record:(-?\d+)$", 1).try_cast(kind) if kind != "string" else F.substring(record_id, 12, 1 << 30)
