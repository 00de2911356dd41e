"""Connected components of an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.storage import cut, release


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component: each node of an edge with the smallest node that it reaches.

    Every round points each node at its smallest neighbour (or itself), follows
    two pointers on, and contracts the edges to the ends of the pointers, until
    no edge is left. Pointers never rise, so they are free of cycles. All
    minima are pre-aggregated, and what rounds hand on lies in the shared
    folder. Edges with a null end are left out; loops make a node of its own
    component; repeated edges count once.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    nodes = e.select("u").union(e.select("v")).distinct().select(F.col("u").alias("node"))
    e = cut(_contract(e), "edges")
    labels, last = None, e
    while not e.isEmpty():
        both = e.union(e.select(F.col("v"), F.col("u")))
        up = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
        near = cut(up.select("node", F.least("node", "low").alias("up")), "pointers")
        up = near
        for _ in range(2):
            on = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            up = up.join(on, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
        up = cut(up, "pointers")
        release(near)
        old = labels
        if labels is None:
            labels = cut(up.select("node", F.col("up").alias("component")), "labels")
        else:
            step = up.select(F.col("node").alias("component"), "up")
            labels = cut(labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        for end in ("u", "v"):
            step = up.select(F.col("node").alias(end), F.col("up").alias("to"))
            e = e.join(step, end, "left").withColumn(end, F.coalesce("to", end)).select("u", "v")
        whole, e = last, cut(_contract(e), "edges")
        release(whole, up, old)
        last = e
    if labels is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _contract(e: DataFrame) -> DataFrame:
    return e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
