"""Places in the shared folder where jobs cut lineage and keep files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.sources.workers import lean  # noqa: F401

#: Used only where the session names no folder and Spark runs on one machine.
LOCAL_DEFAULT = "file:///tmp/checkpoints/foliant"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_DEFAULT


#: What runs of swept() have to delete, innermost last.
_open: list[dict[str, SparkSession]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1][path] = spark
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The result has no lineage, so a lost executor costs a reread only, and
    Spark knows its size, so that it can choose join strategies.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def smallest(df: DataFrame, place: str, n: int) -> DataFrame:
    """The n rows of the smallest place, a column of whole numbers.

    Only places are sorted across tasks; whole rows move after the last place
    that counts is known, so no task gathers more than n rows and ties.
    """
    last = df.select(place).orderBy(place).limit(n).agg({place: "max"}).first()[0]
    return df.where(F.col(place) <= (last if last is not None else 0)).orderBy(place).limit(n)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*frames: DataFrame | None) -> None:
    """Delete the files of cut frames that nothing still to be run reads."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            _delete(df.sparkSession, path)
            for made in _open:
                made.pop(path, None)


@contextmanager
def swept() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end all files made in it, but those of the cut frames that were passed to what it hands out."""
    made: dict[str, SparkSession] = {}
    outside = _open[-1] if _open else None

    def keep(df: DataFrame) -> DataFrame:
        if outside is not None:
            outside[df._cut_path] = df.sparkSession
        made.pop(df._cut_path, None)
        return df

    _open.append(made)
    try:
        yield keep
    finally:
        while made:
            path, spark = made.popitem()
            _delete(spark, path)
        _open.pop()


def row_key(df: DataFrame) -> list[Column]:
    """_a and _b, 128 bits that tell rows apart by the values of their plain columns; equal rows have equal keys."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    return [F.xxhash64(*plain).alias("_a"), F.xxhash64(F.lit(1), *plain).alias("_b")]


def keyed(df: DataFrame) -> DataFrame:
    """row (df's columns, so that no name can clash), _a and _b."""
    return df.select(F.struct(*(F.col(f"`{x}`") for x in df.columns)).alias("row"), *row_key(df))


def rows_of(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of df as often as wanted has it: _a, _b (see row_key), rows (how many rows of df share the key) and copies (of all these together).

    A broadcast or a shuffle by 128 bits finds the rows; whole rows are never
    sorted. Equal rows stand for one another, so that one of them gives all
    copies; they are collapsed before they are shuffled.
    """
    wanted = cut(wanted.where("copies > 0"), "wanted")
    out = keyed(df).join(wanted.where("rows = 1").select("_a", "_b", "copies"), ["_a", "_b"]).select("row", "copies")
    several = wanted.where("rows > 1").select("_a", "_b", "copies")
    if not several.isEmpty():
        out = out.unionByName(keyed(df).join(several, ["_a", "_b"]).groupBy("row").agg(F.max("copies").alias("copies")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def bitmap(rows: DataFrame, column: str, bits: int) -> Broadcast:
    """Which leading bits of a column of hashes occur, for marked()."""
    slot = F.shiftrightunsigned(column, 64 - bits)
    found = rows.groupBy(F.shiftright(slot, 6).alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")).alias("bits")).toArrow()
    marks = np.zeros(1 << (bits - 6), np.uint64)
    marks[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(marks)


def marked(marks: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slot = hashes >> np.uint64(64 - bits)
    return (marks[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
