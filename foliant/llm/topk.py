"""Exact top-k search by inner product, with bounds from segment statistics.

A vector is cut into segments, and the mean m and deviation s of each are kept,
at several resolutions. For segments of L components

    |q - c|^2 >= sum of L * ((m_q - m_c)^2 + (s_q - s_c)^2),

which, as 2 q.c = |q|^2 + |c|^2 - |q - c|^2, is the same as

    q.c <= sum of L * (m_q * m_c + s_q * s_c),

an inner product of the statistics. A pair whose bound is below the query's
k-th best score so far can't be in the result. Bounds are taken coarse to fine,
and exact scores only where the finest does not settle it.

The same bound holds for all vectors of a cell, from the ranges of its means
and its largest deviations. So a query first meets its own cell, which gives it
a score to beat, and then those cells alone whose bound reaches that score.
Cells hold vectors of similar coarse statistics. They are cut into shards of
bounded size, and the queries that visit a cell into chunks, so that each group
of rows is bounded however many vectors are alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.storage import cut, lean, smallest

#: Cells are fitted on so many vectors at most, those of the smallest hashes.
SAMPLE_ROWS = 8_192
#: There are so many cells at most, whatever the number of vectors, so that their bounds are a table of bounded size.
MOST_CELLS = 1_024


@dataclass(frozen=True)
class Plan:
    """levels: numbers of segments, coarse to fine, each a multiple of the one before; shard and chunk: candidates and queries of a group; tile: candidates that are bounded at once."""

    levels: tuple[int, ...] = (4, 16)
    shard: int = 2_048
    chunk: int = 1_024
    tile: int = 1_024
    rounds: int = 5


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means, then deviations, of each row's segments, weighted so that inner products of rows are bounds (deviations are not negative)."""
    n, d = x.shape
    length = max(1, -(-d // segments))
    padded = np.zeros((n, segments, length))
    padded.reshape(n, -1)[:, :d] = x
    weight = np.sqrt(length)
    return np.concatenate([padded.mean(axis=2) * weight, padded.std(axis=2) * weight], axis=1)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _arithmetic(q: np.ndarray, c: np.ndarray) -> type:
    """The narrowest type in which inner products are exact."""
    most = _largest(q) * _largest(c) * q.shape[1]
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def _whole(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers, saturated."""
    if scores.dtype == object:
        return np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64)
    return scores.astype(np.int64)


class Scan:
    """The best k candidates of each query of a block, tile by tile.

    Candidates come in the order of ties, so that of equal scores the earlier
    place wins. floor: scores below it do not count.
    """

    def __init__(self, q: np.ndarray, floor: np.ndarray, k: int, plan: Plan):
        self.q, self.floor, self.k, self.plan = q, floor.astype(np.float64), k, plan
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        self.stats = [statistics(q, s) for s in plan.levels]
        self.of = np.zeros(0, np.int64)
        self.place = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.compared = 0

    def tile(self, c: np.ndarray, first: int, own: np.ndarray) -> None:
        """Candidates at places from first on; own: for each query its own place, or -1."""
        rows, cols = np.arange(len(self.q)), np.arange(len(c))
        norm = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
        near = np.ones((len(rows), len(cols)), bool)
        for segments, stats in zip(self.plan.levels, self.stats, strict=True):
            # scores are whole numbers: half a unit and the rounding of the statistics
            slack = 0.5 + 1e-9 * self.norm[rows][:, None] * norm[cols][None]
            near &= stats[rows] @ statistics(c[cols], segments).T + slack >= self.floor[rows][:, None]
            r, s = near.any(axis=1), near.any(axis=0)
            near, rows, cols = near[r][:, s], rows[r], cols[s]
        if not near.size:
            return
        kind = _arithmetic(self.q[rows], c[cols])
        left, right = self.q[rows].astype(kind), c[cols].astype(kind)
        a, b = np.nonzero(near)
        if kind is np.float64 and near.sum() * 16 > near.size:  # most are left: one product of matrices is less work
            score = (left @ right.T)[a, b]
        else:
            step = 1 << 15
            score = np.concatenate([(left[a[i : i + step]] * right[b[i : i + step]]).sum(axis=1) for i in range(0, len(a), step)])
        self.compared += len(a)
        self._take(rows[a], first + cols[b], _whole(score), own)

    def _take(self, of: np.ndarray, place: np.ndarray, score: np.ndarray, own: np.ndarray) -> None:
        keep = (place != own[of]) & (score >= self.floor[of])
        of, place, score = (np.concatenate(p) for p in ((self.of, of[keep]), (self.place, place[keep]), (self.score, score[keep])))
        order = np.lexsort((place, ~score, of))
        of, place, score = of[order], place[order], score[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        best = rank < self.k
        self.of, self.place, self.score, rank = of[best], place[best], score[best], rank[best]
        full = rank == self.k - 1
        self.floor[self.of[full]] = np.maximum(self.floor[self.of[full]], self.score[full])


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _block(d: int, k: int, plan: Plan, out: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """The best of a shard for a chunk of queries."""

    def best(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        of, v = rows.column("row").to_numpy(), _matrix(rows.column("v"), d)
        floor = rows.column("floor").to_numpy()[asks]
        # candidates in the order of ties: by id, null last, then by row
        ids = rows.column("id").filter(pa.array(~asks)).combine_chunks()
        none = np.asarray(ids.is_null())
        place = np.lexsort((of[~asks], ids.fill_null(0).to_numpy(), none))
        c_row, c = of[~asks][place], v[~asks][place]
        at = dict(zip(c_row.tolist(), range(len(c_row)), strict=True))
        own = np.array([at.get(x, -1) for x in of[asks].tolist()], np.int64)
        scan = Scan(v[asks], floor, k, plan)
        lo, size = 0, 64
        while lo < len(c):  # small tiles first: they set the scores to beat
            scan.tile(c[lo : lo + size], lo, own)
            lo, size = lo + size, min(4 * size, plan.tile)
        return pa.table([pa.array(of[asks][scan.of]), pa.array(c_row[scan.place]), ids.take(pa.array(place)).take(pa.array(scan.place)), pa.array(scan.score)], schema=out)

    return best


@dataclass
class Cells:
    """Cells of similar coarse statistics: n rows, and ranges of means, and largest deviations, of each."""

    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    spread: np.ndarray

    def reach(self, stats: np.ndarray) -> np.ndarray:
        """The bound of each query's score with any vector of each cell."""
        m, s = np.split(stats, 2, axis=1)
        return np.maximum(m, 0) @ self.high.T + np.minimum(m, 0) @ self.low.T + s @ self.spread.T


def _centres(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Centres of the sample's coarse statistics, by rounds of k-means."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        near = _nearest(sample, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None] - 2 * (x @ centres.T), axis=1) if len(x) else np.zeros(0, np.int64)


def _celled(rows: DataFrame, d: int, plan: Plan) -> tuple[DataFrame, Cells]:
    """rows with their cell, written, and the cells."""
    coarse = plan.levels[0]
    sample = smallest(rows.select("v", F.xxhash64("row").alias("place")), "place", SAMPLE_ROWS).toArrow()["v"]
    cells = min(MOST_CELLS, max(1, rows.count() // plan.shard))
    centres = rows.sparkSession.sparkContext.broadcast(_centres(statistics(_matrix(sample, d).astype(np.float64), coarse), cells, plan.rounds))

    def assign(batches):
        for b in batches:
            stats = statistics(_matrix(pa.chunked_array([b.column("v")]), d).astype(np.float64), coarse)
            yield b.append_column("cell", pa.array(_nearest(stats, centres.value).astype(np.int32)))

    def extent(batches):
        n, low, high, spread = np.zeros(cells, np.int64), np.full((cells, coarse), np.inf), np.full((cells, coarse), -np.inf), np.zeros((cells, coarse))
        for b in batches:
            cell = b.column("cell").to_numpy()
            m, s = np.split(statistics(_matrix(pa.chunked_array([b.column("v")]), d).astype(np.float64), coarse), 2, axis=1)
            np.add.at(n, cell, 1)
            np.minimum.at(low, cell, m)
            np.maximum.at(high, cell, m)
            np.maximum.at(spread, cell, s)
        used = np.flatnonzero(n)
        many = [np.repeat(used, coarse).astype(np.int32), np.tile(np.arange(coarse, dtype=np.int32), len(used)), np.repeat(n[used], coarse), low[used].ravel(), high[used].ravel(), spread[used].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in many], names=["cell", "segment", "n", "low", "high", "spread"])

    table = cut(rows.mapInArrow(lean(assign), f"{_fields(rows)}, cell int"), "cells")
    parts = table.select("v", "cell").mapInArrow(lean(extent), "cell int, segment int, n long, low double, high double, spread double")
    # a row for each cell and segment, at most MOST_CELLS times the coarse segments
    found = parts.groupBy("cell", "segment").agg(F.sum("n"), F.min("low"), F.max("high"), F.max("spread")).collect()
    out = Cells(np.zeros(cells, np.int64), *(np.zeros((cells, coarse)) for _ in range(3)))
    for cell, segment, n, low, high, spread in found:
        out.n[cell], out.low[cell, segment], out.high[cell, segment], out.spread[cell, segment] = n, low, high, spread
    return table, out


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _visit(visits: DataFrame, table: DataFrame, cells: Cells, d: int, k: int, plan: Plan) -> DataFrame:
    """of, row, id, score: of each visit (row, v, floor, cell) the best k of the cell's shards."""
    spark = table.sparkSession
    id_type = table.schema["id"].dataType
    load = dict(visits.groupBy("cell").count().collect())  # at most MOST_CELLS rows
    sizes = [(c, max(1, -(-int(n) // plan.shard)), -(-load[c] // plan.chunk)) for c, n in enumerate(cells.n) if load.get(c)]
    sizes = F.broadcast(spark.createDataFrame(sizes, "cell int, shards int, chunks int"))  # at most MOST_CELLS rows
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    asking = visits.join(sizes, "cell").withColumn("chunk", dealt("chunks")).withColumn("shard", numbers("shards"))
    asked = table.join(sizes, "cell").withColumn("shard", dealt("shards")).withColumn("chunk", numbers("chunks"))
    both = asking.select("cell", "shard", "chunk", "row", F.lit(None).cast(id_type).alias("id"), "v", "floor", F.lit(True).alias("asks"))
    both = both.unionByName(asked.select("cell", "shard", "chunk", "row", "id", "v", F.lit(0.0).alias("floor"), F.lit(False).alias("asks")))
    arrow = pa.int64() if id_type.simpleString() == "bigint" else pa.int32()
    out = pa.schema([("of", pa.int64()), ("row", pa.int64()), ("id", arrow), ("score", pa.int64())])
    return both.groupBy("cell", "shard", "chunk").applyInArrow(_block(d, k, plan, out), f"of long, row long, id {id_type.simpleString()}, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; all partitions drop the rest before they are moved."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("of").orderBy(*order))).where(F.col("rank") <= k)


def top_k(df: DataFrame, vectors: Column, queries: Column, k: int = 5, vec_id: str = "vec_id", plan: Plan = Plan()) -> DataFrame:
    """query_id, rank int (from 1), vec_id, score long: the k rows of the highest inner products for each query row of df.

    vectors: arrays of 64-bit integers; queries: which rows ask (null: no).
    All rows but the query's own are candidates; equal scores are ranked by id
    (whole numbers; null last). Rows that repeat an id or a vector are rows of
    their own. Null vectors and those with null components take no part;
    vectors of different lengths do not meet (each length has jobs of its own),
    and empty vectors score 0 with each other. Scores are exact, and saturated
    where they pass 64 bits. Other columns play no part, whatever their names.
    """
    rows = df.select(F.col(vec_id).alias("id"), vectors.cast("array<bigint>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows, "vectors")
    lengths = [r[0] for r in rows.select(F.size("v")).distinct().collect()]
    parts = [_of_length(rows.where(F.size("v") == d), d, k, plan) for d in sorted(lengths)]
    if not parts:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _of_length(rows: DataFrame, d: int, k: int, plan: Plan) -> DataFrame:
    table, cells = _celled(rows, d, plan)
    asking = table.where("asks").select("row", "v", "cell")
    home = asking.withColumn("floor", F.lit(float("-inf")))
    near = cut(_first(_visit(home, table.drop("asks"), cells, d, k, plan), k), "near")
    floors = near.where(F.col("rank") == k).select(F.col("of").alias("row"), F.col("score").cast("double").alias("floor"))
    asking = asking.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    shared = table.sparkSession.sparkContext.broadcast(cells)

    def reaching(batches):
        for b in batches:
            v = _matrix(pa.chunked_array([b.column("v")]), d).astype(np.float64)
            floor, own = b.column("floor").to_numpy(), b.column("cell").to_numpy()
            reach = shared.value.reach(statistics(v, plan.levels[0]))
            far = np.sqrt((v**2).sum(axis=1))[:, None] * np.sqrt((shared.value.spread**2 + np.maximum(shared.value.high**2, shared.value.low**2)).sum(axis=1))[None]
            of, cell = np.nonzero((reach + 0.5 + 1e-9 * far >= floor[:, None]) & (shared.value.n > 0) & (np.arange(len(shared.value.n)) != own[:, None]))
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(of)), b.column("v").take(pa.array(of)), b.column("floor").take(pa.array(of)), pa.array(cell.astype(np.int32))], names=["row", "v", "floor", "cell"])

    visits = cut(asking.mapInArrow(lean(reaching), "row long, v array<bigint>, floor double, cell int"), "visits")
    found = near.drop("rank").unionByName(_visit(visits, table.drop("asks"), cells, d, k, plan))
    best = _first(found, k)
    names = table.where("asks").select(F.col("row").alias("of"), F.col("id").alias("query_id"))
    return best.join(names, "of").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
