"""Embedding near-duplicates: iterative quantisation and multi-index Hamming tables.

Vectors get binary codes: they are centred, projected to principal axes and
turned by a rotation that alternates between quantising and refitting, so that
codes are balanced and close to the vectors. Several rotations, from different
starts, give several codes. Each code is cut into substrings, one table for
each; two vectors meet if they share a substring in any table. Of those that
meet, pairs whose whole codes are further apart than linked vectors can be
expected to be fall away, and every other pair is reranked once, by cosine of
the original vectors in double precision.

Substrings get longer with the number of vectors, so that buckets keep their
size, and tables more, so that linked vectors still meet.

Equal vectors form a class and are compared as one, with its size as a weight.
A bucket of a table is compared in blocks: its classes are dealt to chunks of
bounded size, each pair of chunks is a group of its own, and a group returns a
row for each class (the weight of its links, and its place in the block's own
components), never pairs. So a bucket that holds a third of all vectors spreads
over many tasks, though its comparisons still grow with its square.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.graph import connected_components
from foliant.llm.storage import cut, lean, smallest

#: The projection and rotations are fitted on so many vectors at most, those of the smallest hashes.
SAMPLE_ROWS = 8_192
#: Rows of the table of buckets, at 12 bytes each, that are sent to all tasks at most.
MOST_BUCKETS = 1_000_000


@dataclass(frozen=True)
class Index:
    """rotations codes of a vector, each cut into substrings of bits (None: as many as it takes); chunk: classes of a block's side.

    bucket: mean size of a table's buckets that bits follow from; recall: share
    of pairs just at the limit that tables follow from; spread: how many
    standard deviations a pair's Hamming distance may be above the mean of such
    pairs.
    """

    rotations: int | None = None
    bits: int | None = None
    rounds: int = 30
    chunk: int = 1024
    bucket: int = 1024
    recall: float = 0.94
    spread: float = 5.0

    def sized(self, n: int, d: int, least: float) -> Index:
        """With rotations and bits for n vectors of d components."""
        bits = min(self.bits or max(10, ceil(log2(max(n, 1) / self.bucket))), d, 24)
        tables = ceil(log(1 - self.recall) / log(1 - (1 - _apart(least)) ** bits))
        return replace(self, bits=bits, rotations=self.rotations or max(2, ceil(tables / (min(d // bits * bits, 256) // bits))))

    def radius(self, length: int, least: float) -> int:
        """Hamming distance that pairs of all codes, of length bits together, may have."""
        p = _apart(least)
        return ceil(length * p + self.spread * sqrt(length * p * (1 - p) * self.rotations))


def _apart(least: float) -> float:
    """Share of bits by which two vectors of a cosine differ, as random planes part them."""
    return acos(min(1.0, max(-1.0, least))) / pi


@dataclass
class Codes:
    """A fitted quantiser."""

    mean: np.ndarray
    planes: list[np.ndarray]  # projection and rotation of each code
    bits: int

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The substrings of unit vectors, a row of table keys for each, and all codes together, packed to 64-bit words."""
        out, codes = [], []
        power = 1 << np.arange(self.bits)
        for plane in self.planes:
            code = ((x - self.mean) @ plane > 0).astype(np.int64)
            codes.append(code)
            for k in range(0, code.shape[1] - self.bits + 1, self.bits):
                out.append(code[:, k : k + self.bits] @ power)
        packed = np.packbits(np.concatenate(codes, axis=1).astype(np.uint8), axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
        return np.stack(out, axis=1), np.ascontiguousarray(packed).view(np.int64)

    def length(self) -> int:
        return sum(p.shape[1] for p in self.planes)


def near_pairs(x: np.ndarray, codes: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs between left and right within radius whose cosine is least at least."""
    words = codes.view(np.uint64)
    apart = np.zeros((len(left), len(right)), np.uint16)
    for w in range(words.shape[1]):
        apart += np.bitwise_count(words[left, w][:, None] ^ words[right, w][None])
    near = apart <= radius
    if near.sum() * 16 > near.size:  # most are candidates: one product of matrices is less work
        a, b = np.nonzero(near & (x[left] @ x[right].T >= least))
        return left[a], right[b]
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    step = 1 << 15
    keep = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + step]], x[b[i : i + step]]) >= least for i in range(0, max(len(a), 1), step)])
    return a[keep], b[keep]


def fit(x: np.ndarray, index: Index) -> Codes:
    """Learn codes from unit vectors: principal axes, then for each rotation the alternation of ITQ."""
    mean = x.mean(axis=0)
    centred = x - mean
    d = x.shape[1]
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    bits = index.bits
    width = min(d // bits * bits, 256)
    v = centred @ axes[:, :width]
    planes = []
    for k in range(index.rotations):
        turn = np.linalg.qr(np.random.default_rng(k).standard_normal((width, width)))[0]
        for _ in range(index.rounds):
            b = np.where(v @ turn > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(b.T @ v)
            turn = (left @ right).T
        planes.append(axes[:, :width] @ turn)
    return Codes(mean, planes, bits)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very long or short vectors
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _block(least: float, radius: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between the classes of two chunks of a bucket, or within one."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        table = int(rows["t"].iloc[0])
        x = _unit(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
        keys = np.stack(rows["keys"].to_numpy())
        ids, weight = rows["cid"].to_numpy(), rows["weight"].to_numpy()
        left = np.flatnonzero(rows["side"].to_numpy() != 1)
        right = np.flatnonzero(rows["side"].to_numpy() != 0)
        a, b = near_pairs(x, np.stack(rows["code"].to_numpy()), left, right, radius, least)
        same = len(left) == len(right) and len(left) == len(rows)
        keep = a < b if same else a != b
        a, b = a[keep], b[keep]
        if table:  # an earlier table has counted pairs that it holds too
            new = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
            a, b = a[new], b[new]
        found = np.bincount(a, weights=weight[b], minlength=len(rows)) + np.bincount(b, weights=weight[a], minlength=len(rows))
        low = ids.copy()
        while True:
            before = low.copy()
            np.minimum.at(low, a, low[b])
            np.minimum.at(low, b, low[a])
            if (low == before).all():
                break
        hit = np.flatnonzero(found)
        return pd.DataFrame({"cid": ids[hit], "links": found[hit].astype(np.int64), "low": low[hit]})

    return links


def _same_length(classes: DataFrame, d: int, least: float, index: Index) -> DataFrame:
    """cid, links, low: what blocks found among classes whose vectors have d components."""
    spark = classes.sparkSession
    sample = smallest(classes.select("embedding", F.xxhash64("embedding").alias("place")), "place", SAMPLE_ROWS).toArrow()["embedding"].combine_chunks()
    index = index.sized(classes.count(), d, least)
    fitted = fit(_unit(_matrix(sample, d)), index)
    codes = spark.sparkContext.broadcast(fitted)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys, code = codes.value.keys(_unit(_matrix(batch.column("embedding"), d)))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())) for m in (keys.astype(np.int32), code)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "keys", "code"])

    kind = classes.schema["embedding"].dataType.simpleString()
    coded = cut(classes.mapInArrow(lean(run), f"cid {classes.schema['cid'].dataType.simpleString()}, weight long, embedding {kind}, keys array<int>, code array<bigint>"), "codes")
    entries = coded.select("*", F.posexplode("keys").alias("t", "key"))
    buckets = cut(coded.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / index.chunk).cast("int")).drop("n"), "buckets")
    # buckets grow with the vectors, so that they are counted before they are sent to all tasks; beyond the bound they are joined by key
    if buckets.count() <= MOST_BUCKETS:
        buckets = F.broadcast(buckets)
    entries = entries.join(buckets, ["t", "key"]).withColumn("c", F.pmod(F.xxhash64("cid", "t"), F.col("chunks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    entries = entries.withColumn("o", others).withColumns({"lo": F.least("c", "o"), "hi": F.greatest("c", "o")})
    entries = entries.withColumn("side", F.when(F.col("lo") == F.col("hi"), 2).when(F.col("c") == F.col("lo"), 0).otherwise(1))
    id_type = classes.schema["cid"].dataType.simpleString()
    block = _block(least, index.radius(fitted.length(), least))
    return entries.select("t", "key", "lo", "hi", "side", "cid", "weight", "embedding", "keys", "code").groupBy("t", "key", "lo", "hi").applyInPandas(block, f"cid {id_type}, links long, low {id_type}")


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, index: Index = Index()) -> DataFrame:
    """vec_id, n_links long, component_id, kept boolean: one row for each row of df.

    n_links counts other rows with a cosine of least at least that the index
    finds; equal vectors always link. component_id is the smallest id reached
    by links, kept whether it is the row's own. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing; so do those
    of different lengths with each other (each length has jobs of its own).
    Repeated rows are vectors of their own. A null id takes part in links but never names a component that has
    another id. Ids are whole numbers; other columns play no part.
    """
    v = F.col(embedding)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).alias("vec_id"), v.alias("embedding"), F.coalesce(fine, F.lit(False)).alias("_fine"))
    good = rows.where("_fine").drop("_fine")
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("low_id"), F.count("*").alias("weight")).withColumn("cid", F.coalesce("low_id", F.xxhash64("embedding")))
    classes = cut(classes.select("cid", "low_id", "weight", "embedding"), "classes")
    # two vectors with one smallest id (repeated ids) need numbers of their own
    clash = not classes.groupBy("cid").count().where("count > 1").isEmpty()
    if clash:
        classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    lengths = [r[0] for r in classes.select(F.size("embedding").alias("d")).distinct().collect()]
    found = None
    for d in lengths:
        part = cut(_same_length(classes.where(F.size("embedding") == d).select("cid", "weight", "embedding"), d, least, index), "links")
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("cid", "low").where("cid <> low").distinct(), "cid", "low")
    named = classes.join(groups, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    least_id = named.groupBy("component").agg(F.min("low_id").alias("component_id"))
    named = named.join(least_id, "component").join(links, "cid", "left")
    named = cut(named.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), "component_id"), "named")
    out = good.join(named, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where("not _fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
