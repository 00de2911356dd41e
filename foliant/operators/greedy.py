"""The greedy fold: ordered items fill batches up to a limit.

Short groups are folded as arrays, a search in their running sums for each
batch. A group of more than BLOCK items is cut into blocks. Where a batch that
opens at an item ends depends on the sums alone, so that every item has a next
start. Within a block these pointers are doubled until they leave it, which
leaves a block's last starts: what can come before the first start of a later
block. Those alone are looked up in later blocks, by their sums, and doubled
again across blocks from the group's first item. Then each block knows its first
start and folds its own items. No task has more than a block of weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.sources.places import placed
from foliant.sources.scratch import cut
from foliant.sources.spread import spread

#: Items of a group that are folded at once; longer groups are folded in blocks.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Rule:
    """When a batch ends: most items, whether one without weight can be flushed, and how much the next repeats (None: batches don't overlap)."""

    most: int | None = None
    flush_empty: bool = True
    overlap: float | None = None

    def ends(self, at: np.ndarray, found: np.ndarray, n: int, total: np.ndarray, above: np.ndarray) -> np.ndarray:
        """Ends (exclusive) of batches that open at items at, of n; found: the last places whose sums are within the limit; total: sums before at, above: those before found."""
        end = np.maximum(found, at + 1)
        if not self.flush_empty:
            end = end + ((end == found) & (end < n) & (above == total))  # nothing to flush yet: the item that goes beyond the limit comes in too
        return np.minimum(end, n if self.most is None else np.minimum(at + self.most, n))

    def steps(self, total: np.ndarray, limit: float, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of each item of a block (total: its running sums, from that before it) the end and the next start, -1 where later blocks decide.

        The number of items stands for what comes after the block; in a group's
        last block a batch that ends there has no next start.
        """
        m = len(total) - 1
        i = np.arange(m)
        found = np.searchsorted(total, total[:-1] + limit, side="right") - 1
        end = self.ends(i, found, m, total[:-1], total[np.minimum(found, m)])
        known = (found < m) | last
        if self.most is not None:
            known |= i + self.most <= m
        if self.overlap is None or self.overlap <= 0:
            start = end
        else:
            start = np.where(last & (end == m), m, np.maximum(i + 1, np.searchsorted(total, total[end] - self.overlap, side="right") - 1))
        return np.where(known, end, -1), np.where(known, start, -1)


def _chain(start: np.ndarray, at: int) -> list[int]:
    found, m = [], len(start)
    while 0 <= at < m:
        found.append(at)
        at = int(start[at])
    return found


def _numbers(rule: Rule):
    @F.pandas_udf("array<int>")
    def numbers(weights: pd.Series, limits: pd.Series) -> pd.Series:
        out = []
        for w, limit in zip(weights, limits, strict=True):
            total = np.concatenate(([0.0], np.cumsum(np.asarray(w, dtype=float))))
            starts = _chain(rule.steps(total, limit, True)[1], 0)
            out.append(np.repeat(np.arange(1, len(starts) + 1, dtype=np.int32), np.diff([*starts, len(w)])))
        return pd.Series(out, dtype=object)

    return numbers


def _long(rows: DataFrame, keys: list[str], block: int) -> DataFrame | None:
    """keys and _g, a number, of the groups with more than block items; None if there are none."""
    long = cut(rows.groupBy(*keys).count().where(F.col("count") > block).drop("count").withColumn("_g", F.monotonically_increasing_id()), "long")
    return None if long.isEmpty() else long


def _among(rows: DataFrame, long: DataFrame, keys: list[str], how: str) -> DataFrame:
    named = long.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(["_g"] if how == "inner" else []))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = rows.join(named, same, how)
    return out.drop(*(f"_k_{k}" for k in keys))


def _read(block: pa.Table, size: int) -> tuple[int, int, bool, int, np.ndarray, float]:
    """A block's group, first place, whether it is the last, the group's items, running sums (first that before it) and limit."""
    row = {c: block.column(c)[0] for c in block.column_names}
    g, b, n = (row[c].as_py() for c in ("_g", "_b", "_n"))
    weights = row["_weights"].values.to_numpy(zero_copy_only=False)
    total = row["_before"].as_py() + np.concatenate(([0.0], np.cumsum(weights)))
    return g, b * size, b * size + len(weights) == n, n, total, row["_limit"].as_py()


class Blocks:
    """Long groups in blocks: rows (_g, place, _w, _user) and weights of each block, with the sum before them."""

    def __init__(self, rows: DataFrame, order: list[str], rule: Rule, block: int):
        self.rule, self.block = rule, block
        # the group's number is its only key from here on, and what the caller named is in a column by itself
        user = F.struct(*(c for c in rows.columns if c not in ("_g", "_w", "_limit"))).alias("_user")
        rows = cut(rows.select("_g", "_w", "_limit", F.struct(order[0], "_w", *order[1:]).alias("_order"), user), "long_items")
        self.rows = cut(placed(rows, ["_order"], ["_g"]).drop("_order"), "placed")
        item = F.struct("place", "_w")
        weights = self.rows.groupBy("_g", F.expr(f"place div {block}").alias("_b")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_w"]).alias("_weights"), F.max("of").alias("_n"), F.max("_limit").alias("_limit"))
        w = Window.partitionBy("_g").orderBy("_b")  # a row for each block
        own = F.aggregate("_weights", F.lit(0.0), lambda a, x: a + x)
        weights = cut(weights.withColumn("_sum", own), "weights")
        before = F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        limit = F.max("_limit").over(Window.partitionBy("_g"))
        sums = cut(weights.select("_g", "_b", before.alias("_before"), limit.alias("_limit")), "sums")
        self.blocks = cut(weights.drop("_limit", "_sum").join(sums, ["_g", "_b"]), "blocks")
        self.sums = sums.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_before"))), lambda x: x["_before"]).alias("_sums"))

    def _meet(self, other: DataFrame, at: str, run, schema: str) -> DataFrame:
        """run(block, rows of other that lie in it by their place at) for each block that has some."""
        other = other.withColumn("_b", F.least(F.expr(f"{at} div {self.block}"), F.expr(f"(_n - 1) div {self.block}")) if at != "_b" else F.col("_b"))
        mine = self.blocks.select(F.col("_g").alias("_h"), F.col("_b").alias("_c"), "*").groupBy("_h", "_c")
        return mine.cogroup(other.groupBy("_g", "_b")).applyInArrow(run, schema)

    def last_starts(self) -> DataFrame:
        """_g, _n, s, total: starts with none behind them in their block, for each place at which a block could be entered."""
        rule, size, schema = self.rule, self.block, pa.schema([("_g", pa.int64()), ("_n", pa.int64()), ("s", pa.int64()), ("total", pa.float64())])

        def run(block: pa.Table) -> pa.Table:
            g, first, last, n, total, limit = _read(block, size)
            if last:
                return schema.empty_table()
            s = np.unique(_lasts(rule.steps(total, limit, last)[1]))
            return pa.table([np.full(len(s), g), np.full(len(s), n), first + s, total[s]], schema=schema)

        return self.blocks.select("*").groupBy("_g", "_b").applyInArrow(run, "_g long, _n long, s long, total double")

    def search(self, rows: DataFrame, target: str) -> DataFrame:
        """rows (_g, _n, s, total) with found, the last place whose sum is at most target, and the sums before it and before the next."""

        @F.pandas_udf("long")
        def block_of(sums: pd.Series, targets: pd.Series) -> pd.Series:
            return pd.Series([max(0, int(np.searchsorted(s, t, side="right")) - 1) for s, t in zip(sums, targets, strict=True)])

        asked = rows.join(self.sums, "_g").withColumn("_b", block_of("_sums", target)).drop("_sums").withColumnRenamed(target, "_target")
        size, schema = self.block, pa.schema([("_g", pa.int64()), ("_n", pa.int64()), ("s", pa.int64()), ("total", pa.float64()), ("end", pa.int64()), ("found", pa.int64()), ("above", pa.float64()), ("after", pa.float64())])

        def run(block: pa.Table, asks: pa.Table) -> pa.Table:
            if not asks.num_rows:
                return schema.empty_table()
            _, first, _, _, total, _ = _read(block, size)
            local = np.maximum(0, np.searchsorted(total, asks.column("_target").to_numpy(), side="right") - 1)
            after = total[np.minimum(local + 1, len(total) - 1)]
            return pa.table([asks.column("_g"), asks.column("_n"), asks.column("s"), asks.column("total"), asks.column("end"), first + local, total[local], after], schema=schema)

        return self._meet(asked.select("_g", "_n", "s", "total", "end", "_target", "_b"), "_b", run, "_g long, _n long, s long, total double, end long, found long, above double, after double")

    def entries(self, rows: DataFrame) -> DataFrame:
        """_g, y, t: the last start in its block of the chain from y."""
        rule, size, schema = self.rule, self.block, pa.schema([("_g", pa.int64()), ("y", pa.int64()), ("t", pa.int64())])

        def run(block: pa.Table, asks: pa.Table) -> pa.Table:
            if not asks.num_rows:
                return schema.empty_table()
            _, first, last, _, total, limit = _read(block, size)
            y = asks.column("y").to_numpy()
            return pa.table([asks.column("_g"), y, first + _lasts(rule.steps(total, limit, last)[1])[y - first]], schema=schema)

        return self._meet(rows.select("_g", "_n", "y"), "y", run, "_g long, y long, t long")

    def links(self) -> DataFrame:
        """_g, s, end, y, t: for each last start the end of its batch, the next start y, and the last start t of y's block; y and t are null where the group ends."""
        limits = self.blocks.where("_b = 0").select("_g", "_limit")
        s = self.last_starts().join(limits, "_g").select("_g", "_n", "s", "total", (F.col("total") + F.col("_limit")).alias("target"), F.lit(None).cast("long").alias("end"))
        found = self.search(cut(s, "starts"), "target")
        rule = self.rule

        @F.pandas_udf("long")
        def end_of(at: pd.Series, found: pd.Series, n: pd.Series, total: pd.Series, above: pd.Series) -> pd.Series:
            return pd.Series(rule.ends(*(x.to_numpy() for x in (at, found, n, total, above))))

        ended = found.withColumn("end", end_of("s", "found", "_n", "total", "above"))
        if rule.overlap is not None and rule.overlap > 0:
            more = ended.where("end < _n").withColumn("target", F.when(F.col("end") == F.col("found"), F.col("above")).otherwise(F.col("after")) - rule.overlap)
            back = self.search(cut(more.select("_g", "_n", "s", "total", "target", "end"), "back"), "target")
            y = back.select("_g", "_n", "s", "end", F.greatest(F.col("s") + 1, "found").alias("y"))
            ended = cut(ended.select("_g", "_n", "s", "end"), "ended")
            out = ended.join(y.select("_g", "s", "y"), ["_g", "s"], "left")
        else:
            out = ended.select("_g", "_n", "s", "end", F.when(F.col("end") < F.col("_n"), F.col("end")).alias("y"))
        out = cut(out, "ends")
        to = self.entries(out.where("y IS NOT NULL").select("_g", "_n", "y").distinct())
        return cut(out.join(to, ["_g", "y"], "left"), "links")

    def first_starts(self, links: DataFrame) -> DataFrame:
        """_g, _n, y: starts that follow from other blocks: a block's first one, and, if batches overlap, those that its last ones go back to."""
        zero = self.blocks.where("_b = 0").select("_g", "_n", F.lit(0).cast("long").alias("y"))
        seen = cut(self.entries(zero).select("_g", F.col("t").alias("s")), "seen")
        jump = links.where("t IS NOT NULL").select("_g", "s", F.col("t").alias("to"))
        while True:  # what is seen doubles
            more = cut(seen.join(jump, ["_g", "s"]).select("_g", F.col("to").alias("s")), "more")
            if more.isEmpty():
                break
            seen = seen.unionByName(more)
            jump = cut(jump.join(jump.select("_g", F.col("s").alias("to"), F.col("to").alias("_far")), ["_g", "to"]).select("_g", "s", F.col("_far").alias("to")), "jump")
        found = links.where("y IS NOT NULL").join(seen, ["_g", "s"]).select("_g", "_n", "y")
        return cut(zero.unionByName(found), "first_starts")

    def starts(self, first: DataFrame) -> DataFrame:
        """_g, _b, place, end (null where later blocks decide): all starts."""
        rule, size, schema = self.rule, self.block, pa.schema([("_g", pa.int64()), ("_b", pa.int64()), ("place", pa.int64()), ("end", pa.int64())])

        def run(block: pa.Table, entry: pa.Table) -> pa.Table:
            if not entry.num_rows:
                return schema.empty_table()
            g, at, last, _, total, limit = _read(block, size)
            end, start = rule.steps(total, limit, last)
            mine = np.unique(np.concatenate([_chain(start, y - at) for y in entry.column("y").to_pylist()]))
            end = end[mine]
            return pa.table([np.full(len(mine), g), np.full(len(mine), at // size), at + mine, pa.array(at + end, mask=(end < 0))], schema=schema)

        return cut(self._meet(first, "y", run, "_g long, _b long, place long, end long"), "all_starts")


def _lasts(start: np.ndarray) -> np.ndarray:
    """Of each place the last one of its chain within the block, by doubling."""
    to = np.where((start >= 0) & (start < len(start)), start, np.arange(len(start)))
    while True:
        far = to[to]
        if (far == to).all():
            return to
        to = far


def _ranked(starts: DataFrame) -> DataFrame:
    """starts with batch, their number in the group from 1."""
    per = starts.groupBy("_g", "_b").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("place"))
    return starts.join(per.select("_g", "_b", before.alias("_before")), ["_g", "_b"]).withColumn("batch", (F.col("_before") + within).cast("int")).drop("_before")


def greedy_batches(
    df: DataFrame, keys: list[str], order: str, weight: Column | str, limit: float | str, max_items: int | None = None, flush_empty: bool = True, batch: str = "batch", carry: list[str] | None = None, block: int = BLOCK
) -> DataFrame:
    """keys, order, carried columns and batch (from 1) for each item.

    An item opens a new batch if the open one would exceed limit with it (or
    has max_items), provided that the open one holds an item, or, with
    flush_empty false, weight. An item above the limit thus has a batch of its
    own. limit may name a column that is the same throughout a group; null
    weights are 0, others not negative (sums are exact for whole numbers). A
    group (a document, a leaf) of up to block items is folded in one task, by
    its weights alone, a longer one in blocks.
    """
    rule, carry = Rule(max_items, flush_empty), carry or []
    weight = F.col(weight) if isinstance(weight, str) else weight
    bound = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    rows = cut(df.select(*keys, order, *carry, F.coalesce(weight.cast("double"), F.lit(0.0)).alias("_w"), bound.cast("double").alias("_limit")), "items")
    long = _long(rows, keys, block)
    short = rows if long is None else _among(rows, long, keys, "left_anti")
    item = F.struct(order, "_w", *carry)
    groups = spread(short, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"), F.max("_limit").alias("_limit"))
    groups = groups.withColumn("_numbers", _numbers(rule)(F.transform("_items", lambda x: x["_w"]), "_limit"))
    each = groups.select(*keys, F.explode(F.arrays_zip("_items", "_numbers")).alias("_x"))
    out = each.select(*keys, f"_x._items.{order}", *(f"_x._items.{c}" for c in carry), F.col("_x._numbers").alias(batch))
    if long is None:
        return out
    blocks = Blocks(_among(rows, long, keys, "inner"), [order, *carry], rule, block)
    starts = _ranked(blocks.starts(blocks.first_starts(blocks.links())))
    # items take the number of the last start up to them: of their block, or of those before
    opened = starts.groupBy("_g", "_b").agg(F.max("batch").alias("_last"))
    every = blocks.blocks.select("_g", "_b").join(opened, ["_g", "_b"], "left")
    carried = every.withColumn("_open", F.last("_last", True).over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_g", "_b", "_open")
    items = blocks.rows.withColumn("_b", F.expr(f"place div {block}")).join(starts.select("_g", "place", "batch"), ["_g", "place"], "left").join(carried, ["_g", "_b"])
    within = Window.partitionBy("_g", "_b").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    items = items.withColumn("batch", F.coalesce(F.last("batch", True).over(within), "_open"))
    return out.unionByName(items.select("_user.*", F.col("batch").alias(batch)))


def overlapping_batches(items: DataFrame, target: float, overlap: float, block: int = BLOCK) -> DataFrame:
    """doc_id, batch, start_pos, end_pos: greedy batches up to target; each next one goes back until overlap repeats, but always further on.

    items: doc_id, pos, w. A document of up to block items is folded in one
    task, by its weights alone, a longer one in blocks.
    """
    rule = Rule(overlap=overlap)
    rows = cut(items.select("doc_id", "pos", F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("_w"), F.lit(float(target)).alias("_limit")), "items")
    long = _long(rows, ["doc_id"], block)

    @F.pandas_udf("array<struct<a:int,z:int>>")
    def ranges(weights: pd.Series) -> pd.Series:
        out = []
        for w in weights:
            end, start = rule.steps(np.concatenate(([0.0], np.cumsum(np.asarray(w, dtype=float)))), target, True)
            out.append([{"a": at, "z": int(end[at]) - 1} for at in _chain(start, 0)])
        return pd.Series(out)

    short = rows if long is None else _among(rows, long, ["doc_id"], "left_anti")
    groups = spread(short, ["doc_id"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "_w"))).alias("x"))
    found = groups.select("doc_id", F.transform("x", lambda i: i["pos"]).alias("p"), F.posexplode(ranges(F.transform("x", lambda i: i["_w"]))).alias("batch", "r"))
    out = found.select("doc_id", (F.col("batch") + 1).alias("batch"), F.get("p", F.col("r.a")).alias("start_pos"), F.get("p", F.col("r.z")).alias("end_pos"))
    if long is None:
        return out
    blocks = Blocks(_among(rows, long, ["doc_id"], "inner"), ["pos"], rule, block)
    links = blocks.links()
    starts = _ranked(blocks.starts(blocks.first_starts(links)))
    starts = starts.join(links.select("_g", F.col("s").alias("place"), F.col("end").alias("_end")), ["_g", "place"], "left").withColumn("end", F.coalesce("end", "_end"))
    at = blocks.rows.select("_g", "place", F.col("_user.pos").alias("pos"))
    ends = starts.select("_g", "batch", F.col("place").alias("_from"), (F.col("end") - 1).alias("place")).join(at, ["_g", "place"]).select("_g", "batch", "_from", F.col("pos").alias("end_pos"))
    both = ends.join(at.select("_g", F.col("place").alias("_from"), F.col("pos").alias("start_pos")), ["_g", "_from"]).join(long, "_g")
    return out.unionByName(both.select("doc_id", "batch", "start_pos", "end_pos"))
