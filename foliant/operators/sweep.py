"""Intervals and points of a document in one ordered pass, without range joins.

Starts, ends and points of a document are sorted together. What is open at a
point follows from running counts and sums over that order, so that each row is
moved once, whatever the number of intervals that cover it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def owner(points: DataFrame, nodes: DataFrame, by: str = "depth", keep: bool = True, also: list[str] | None = None) -> DataFrame:
    """points (doc_id, pos, ...) with node_id (and also other columns) of the deepest node whose span [pos, end_pos) covers them, or null (keep false: without those).

    Spans nest or are disjoint; of equal ones that with the largest by is the
    deepest. The number of spans that are open, a running sum over starts and
    ends, is the height of a stack: the node on top at a point is the last one
    that started at that height.
    """
    node = F.struct("node_id", *(F.col(c) for c in also or []))
    point = F.struct(*(F.col(f"`{c}`") for c in points.columns))
    none = lambda kind: F.lit(None).cast(kind)
    spans = nodes.where("end_pos > pos").select("doc_id", F.col("pos").cast("long").alias("_at"), (-F.col("end_pos")).cast("long").alias("_end"), F.col(by).alias("_by"), node.alias("_node"))
    kinds = {f.name: f.dataType for f in spans.schema}
    starts = spans.select("doc_id", "_at", F.lit(1).alias("_kind"), "_end", "_by", "_node", F.lit(1).alias("_step"), none(points.select(point.alias("p")).schema["p"].dataType).alias("_point"))
    ends = spans.select("doc_id", (-F.col("_end")).alias("_at"), F.lit(0).alias("_kind"), none("long").alias("_end"), none(kinds["_by"]).alias("_by"), none(kinds["_node"]).alias("_node"), F.lit(-1).alias("_step"), none(starts.schema["_point"].dataType).alias("_point"))
    rows = points.select("doc_id", F.col("pos").cast("long").alias("_at"), F.lit(2).alias("_kind"), none("long").alias("_end"), none(kinds["_by"]).alias("_by"), none(kinds["_node"]).alias("_node"), F.lit(0).alias("_step"), point.alias("_point"))
    order = ["_at", "_kind", "_end", "_by", "_node"]
    so_far = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    events = starts.unionByName(ends).unionByName(rows).withColumn("_height", F.sum("_step").over(so_far)).where("_kind > 0")
    at_height = Window.partitionBy("doc_id", "_height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    top = F.when(F.col("_height") > 0, F.last("_node", True).over(at_height))
    out = events.withColumn("_top", top).where("_kind = 2").select("_point.*", *(F.col(f"_top.{c}").alias(c) for c in ["node_id", *(also or [])]))
    return out if keep else out.where("node_id IS NOT NULL")


def ranks(points: DataFrame, spans: DataFrame, key: list[str], weight: Column | dict[str, Column] | None = None) -> DataFrame:
    """doc_id, key, first, stop (and weight, or the names given): of each span [pos, end_pos) the places, from 0, of the points that it covers among its document's, stop excluded, and the sums of their weights.

    Spans may overlap; points with one pos have neighbouring places.
    """
    weights = {} if weight is None else weight if isinstance(weight, dict) else {"weight": weight}
    own = [F.coalesce(w, F.lit(0)).cast("long").alias(f"_w_{x}") for x, w in weights.items()]
    none = [F.lit(0).cast("long").alias(f"_w_{x}") for x in weights]
    id_ = F.struct(*key)
    kind = spans.select(id_.alias("k")).schema["k"].dataType
    bound = lambda c, name: F.struct(F.col(c).cast("long").alias("at"), F.lit(name).alias("name"))
    marks = spans.select("doc_id", id_.alias("_key"), F.explode(F.array(bound("pos", "first"), bound("end_pos", "stop"))).alias("_b"))
    marks = marks.select("doc_id", "_key", F.col("_b.at").alias("_at"), F.col("_b.name").alias("_name"), F.lit(0).alias("_point"), *none)
    rows = points.select("doc_id", F.lit(None).cast(kind).alias("_key"), F.col("pos").cast("long").alias("_at"), F.lit(None).cast("string").alias("_name"), F.lit(1).alias("_point"), *own)
    so_far = Window.partitionBy("doc_id").orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(rows).withColumns({"_n": F.sum("_point").over(so_far), **{f"_w_{x}": F.sum(f"_w_{x}").over(so_far) for x in weights}}).where("_name IS NOT NULL")
    of = lambda name, c: F.max(F.when(F.col("_name") == name, F.col(c)))
    out = both.groupBy("doc_id", "_key").agg(of("first", "_n").alias("first"), of("stop", "_n").alias("stop"), *((of("stop", f"_w_{x}") - of("first", f"_w_{x}")).alias(f"_w_{x}") for x in weights))
    return out.select("doc_id", "_key.*", "first", F.greatest("first", "stop").alias("stop"), *(F.greatest(f"_w_{x}", F.lit(0)).alias(x) for x in weights))


def covered(points: DataFrame, ranked: DataFrame) -> DataFrame:
    """ranked (see ranks()) without first and stop, joined with each point that a span covers: an equi-join by document and place.

    Neither side is broadcast: Spark judges a written ranked by its compressed files, and does not count the rows that explode makes.
    """
    placed = points.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    each = ranked.where("stop > first").withColumn("_rank", F.explode(F.sequence(F.col("first").cast("int"), (F.col("stop") - 1).cast("int")))).drop("first", "stop", "weight")
    return each.hint("merge").join(placed, ["doc_id", "_rank"]).drop("_rank")
