"""Merkle manifests: trees of digests with a proof for each row, by butterfly exchange.

The rows of a tree stand in order and are cut into aligned blocks of fanout **
height leaves, which hash their own subtrees. Then blocks exchange roots, round
by round. Before round r a block holds the root of the aligned run of fanout **
r blocks that it lies in. In round r it meets the fanout blocks that stand at
its own place in the other runs below the same parent: all swap roots, and each
hashes the parent itself. So every block computes its ancestors, redundantly,
and has seen their children on the way: no pass back down is needed for proofs.
A last run may be shorter than the others; then its blocks stand in at the
places that it lacks. All digests are SHA-256, in lower-case hex text.

Groups of an exchange have fanout rows, whatever the size of a tree, and blocks
fanout ** height leaves, so nothing gathers a tree in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.places import placed
from foliant.llm.storage import cut


PATH = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class Shape:
    """Children of a node, and levels that a block hashes by itself."""

    fanout: int = 16
    height: int = 2

    @property
    def block(self) -> int:
        return self.fanout**self.height


def digest(*fields: Column) -> Column:
    """The digest of a row: each field as its UTF-8 length, a colon and its text, or a dash where it is null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _div(name: str, n: int) -> Column:
    return F.expr(f"{name} div {n}")


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _around(nodes: Column, at: Column) -> Column:
    """What a proof needs of a run of nodes: those left and right of a place (from 0)."""
    return F.struct(_joined(F.slice(nodes, 1, at)).alias("left"), _joined(F.slice(nodes, at + 2, F.size(nodes))).alias("right"))


def _parents(nodes: Column, fanout: int) -> Column:
    """The next level of some aligned nodes (at least one)."""
    last = F.floor((F.size(nodes) - 1) / F.lit(fanout)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(_joined(F.slice(nodes, i * fanout + 1, fanout)), 256))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and what stands around it, level by level."""
    return F.aggregate(path, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def siblings_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda text, level: F.concat(text, level["left"], level["right"])), 256)


def _hashed(blocks: DataFrame, shape: Shape) -> DataFrame:
    """blocks with the levels above level0 and the root of their own subtrees.

    A level is hashed only if the tree has several nodes on the level below;
    until then a block's one node is its root.
    """
    for k in range(shape.height):
        nodes = F.col(f"level{k}")
        blocks = blocks.withColumn(f"level{k + 1}", F.when(F.col("of") > shape.fanout**k, _parents(nodes, shape.fanout)).otherwise(nodes))
    return blocks.withColumn("root", F.element_at(f"level{shape.height}", 1)).drop(f"level{shape.height}")


def _within(place: Column, shape: Shape) -> Column:
    """What stands around a leaf (its place in the block) and its ancestors in the block, on the levels that the tree has."""
    out = []
    for k in range(shape.height):
        node = F.floor(place / shape.fanout**k).cast("int")
        at = (node % shape.fanout).cast("int")
        around = F.array(_around(F.slice(f"level{k}", node - at + 1, shape.fanout), at)).cast(PATH)
        out.append(F.when(F.col("of") > shape.fanout**k, around).otherwise(F.array().cast(PATH)))
    return F.concat(*out)


def exchange(blocks: DataFrame, shape: Shape) -> DataFrame:
    """tree, block, above (what stands around the block's ancestors, from its own root up), root (of the tree).

    blocks: tree, block, blocks (how many the tree has), root. A round for each
    power of fanout that the largest tree has blocks; trees that have reached
    their root wait.
    """
    fanout = shape.fanout
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    state = blocks.withColumn("above", F.array().cast(PATH))
    run = 1
    while run < most:
        waiting, busy = state.where(F.col("blocks") <= run), state.where(F.col("blocks") > run)
        sent = busy.withColumns({"_run": _div("block", run), "_low": F.col("block") % run})
        # a shorter last run's blocks stand in for the places that it lacks
        held = F.least(F.lit(run).cast("long"), F.col("blocks") - F.col("_run") * run)
        sent = sent.withColumns({"_up": _div("_run", fanout), "_at": F.explode(F.sequence(F.col("_low"), F.lit(run - 1).cast("long"), held))})
        group = Window.partitionBy("tree", "_up", "_at")  # fanout rows at most
        met = sent.withColumn("_met", F.transform(F.array_sort(F.collect_list(F.struct("_run", "root")).over(group)), lambda x: x["root"])).where("_at = _low")
        around = F.array(_around(F.col("_met"), (F.col("_run") % fanout).cast("int"))).cast(PATH)
        swapped = met.select("tree", "block", "blocks", F.sha2(_joined(F.col("_met")), 256).alias("root"), F.concat("above", around).alias("above"))
        state = cut(waiting.select("tree", "block", "blocks", "root", "above").unionByName(swapped), "round")
        run *= fanout
    return state.select("tree", "block", "above", "root")


def grown(leaves: DataFrame, order: list[str], by: str | None = None, shape: Shape = Shape()) -> DataFrame:
    """tree, block, of (leaves of the tree), rows, level0 (leaves) and the levels above, above, root: the blocks of a tree for each value of by, which may not be null.

    leaves: a written table with a column leaf, a digest. Rows ascend by order,
    nulls first; rows holds the other columns.
    """
    names = [c for c in leaves.columns if c not in ("leaf", by)]
    rows = placed(leaves, order, by)
    rows = rows.select((F.col(by) if by else F.lit("")).alias("tree"), _div("place", shape.block).alias("block"), "of", F.struct("place", "leaf", F.struct(*names).alias("row")).alias("r"))
    blocks = rows.groupBy("tree", "block", "of").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    blocks = cut(_hashed(blocks.select("tree", "block", "of", F.col("rows.row").alias("rows"), F.col("rows.leaf").alias("level0")), shape), "blocks")
    n = F.expr(f"(of + {shape.block - 1}) div {shape.block}").alias("blocks")
    paths = exchange(blocks.select("tree", "block", n, "root"), shape)
    return cut(blocks.drop("root").join(paths, ["tree", "block"]), "grown")


def proofs(blocks: DataFrame, shape: Shape = Shape(), rest: str | None = None) -> DataFrame:
    """tree, row, leaf, path, root: what stands around each leaf and its ancestors, from the leaf up (and on along rest, a column of blocks)."""
    on = [F.col("above"), *([F.col(rest)] if rest else [])]
    rows = F.transform("rows", lambda row, i: F.struct(row.alias("row"), F.element_at("level0", i + 1).alias("leaf"), F.concat(_within(i, shape), *on).alias("path")))
    return blocks.select("tree", "root", F.explode(rows).alias("r")).select("tree", "r.row", "r.leaf", "r.path", "root")


def manifest(docs: DataFrame, fields: list[str], doc_id: str = "doc_id", source: str = "source", changed: Column | None = None, shape: Shape = Shape()) -> DataFrame:
    """doc_id, leaf, subroot, root, path, found (a leaf to be verified): a proof for each row of docs.

    A row's leaf is the digest of its fields. Rows of a source form a tree,
    ascending by id (null first), then by leaf; the trees' roots, ordered by
    source (null first, by UTF-8 bytes), form the tree of the manifest. path
    leads from the leaf through the subroot to the root; see fold() and
    siblings_digest(). changed: the leaf to be held against the manifest, where
    it is not null (none: the row's own).

    Texts are read once and never shuffled, paths never written. A hot source
    is cut into ranges and blocks like any other; the tree over sources has as
    many leaves as there are sources and is built the same way. Repeated rows
    are leaves of their own, a table without rows has no proofs, and columns
    that are not asked for play no part, whatever their names.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("-")).alias("tree")
    found = (F.lit(None) if changed is None else changed).cast("string").alias("found")
    leaves = cut(docs.select(key, F.col(f"`{doc_id}`").alias("doc_id"), digest(*(F.col(f"`{x}`") for x in fields)).alias("leaf"), found), "leaves")
    trees = grown(leaves, ["doc_id", "leaf"], "tree", shape)
    roots = cut(trees.where("block = 0").select(F.col("tree").alias("name"), F.col("root").alias("leaf")), "subroots")
    top = cut(proofs(grown(roots, ["name"], shape=shape), shape).select(F.col("row.name").alias("tree"), F.col("path").alias("rest"), F.col("root").alias("top")), "tops")
    whole = proofs(trees.join(top, "tree").withColumn("root", F.struct(F.col("root").alias("sub"), F.col("top").alias("top"))), shape, "rest")
    return whole.select("row.doc_id", "leaf", F.col("root.sub").alias("subroot"), F.col("root.top").alias("root"), "path", F.coalesce("row.found", "leaf").alias("found"))
