"""Manifests and proofs beside a plain Merkle tree, and SQL."""

import hashlib

import pytest
from compare import assert_same, views
from pyspark.sql import functions as F

from foliant.llm import queries
from foliant.llm.merkle import Shape, fold, grown, manifest, proofs, siblings_digest
from foliant.llm.places import placed
from foliant.llm.storage import cut

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, tree string, root double"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row[:5]))


def climb(nodes, fanout):
    """All levels of a tree, from its leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def siblings(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        first = at // fanout * fanout
        out.append((level[first:at], level[at + 1 : first + fanout]))
        at //= fanout
    return out


def plain(rows, fanout):
    """(doc_id, leaf, subroot, root, siblings' digest), sorted."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: climb([x[2] for x in sorted(trees[s])], fanout) for s in names}
    top = climb([levels[s][-1][0] for s in names], fanout)
    out = []
    for i, s in enumerate(names):
        for at, (_, _, leaf, doc_id) in enumerate(sorted(trees[s])):
            path = siblings(levels[s], at, fanout) + siblings(top, i, fanout)
            out.append((doc_id, leaf, levels[s][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in path))))
    return sorted(out, key=str)


def found(spark, rows, shape):
    docs = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], SCHEMA)
    out = manifest(docs, FIELDS, shape=shape)
    assert out.where(fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    return sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path"))).collect()), key=str)


def row(i, source, text="text"):
    return (i, source, "en", len(text or ""), text)


@pytest.mark.parametrize(("fanout", "height", "n"), [(2, 1, 23), (3, 1, 28), (3, 2, 82), (4, 1, 65), (16, 2, 300)])
def test_one_hot_tree_and_small_ones(spark, fanout, height, n):
    rows = [row((i * 7919) % 10007, "hot", f"text {i}") for i in range(n)] + [row(5, "one"), row(1, "two"), row(2, "two")]
    assert found(spark, rows, Shape(fanout, height)) == plain(rows, fanout)


def test_nulls_repeats_and_odd_names(spark):
    rows = [row(1, None), row(1, None), row(None, None), row(None, "-"), (2, "", None, None, None), row(3, "=", "ä" * 1000), row(3, "=", ""), row(4, "é"), row(5, "z"), row(6, "\U0001f600"), row(7, "ﬁ")]
    assert found(spark, rows, Shape(3, 1)) == plain(rows, 3)


def test_many_sources_and_lone_rows(spark):
    rows = [row(i, f"s{i % 40}") for i in range(75)]
    assert found(spark, rows, Shape(3, 1)) == plain(rows, 3)
    (only,) = found(spark, [row(9, "s", "x" * 300_000)], Shape())
    assert only[1] == only[2] == only[3] and only[4] == sha("")


def test_empty_table(spark):
    assert found(spark, [], Shape()) == []


def test_changed_rows_do_not_verify(spark):
    docs = spark.createDataFrame([(*row(i, f"s{i % 3}", "Text"), 1, "x", 0.5) for i in range(60)], SCHEMA)
    changed = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("other"), 256))
    out = manifest(docs, FIELDS, changed=changed, shape=Shape(4, 1))
    assert {r[0] for r in out.where(fold(F.col("found"), F.col("path")) != F.col("root")).select("doc_id").collect()} == set(range(0, 60, 7))


def test_exchange_needs_no_pass_down(spark):
    """Blocks of a ragged tree have whole paths after the last round."""
    for n in (1, 2, 9, 10, 17, 27, 28):
        leaves = cut(spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("leaf")), "leaves")
        out = proofs(grown(leaves, ["id"], shape=Shape(3, 1)), Shape(3, 1))
        levels = climb([sha(str(i)) for i in range(n)], 3)
        want = {i: [("".join(a), "".join(b)) for a, b in siblings(levels, i, 3)] for i in range(n)}
        assert {r[0]: [tuple(x) for x in r[1]] for r in out.select("row.id", "path").collect()} == want


def test_places(spark):
    rows = cut(spark.range(500).select((F.col("id") % 3).alias("k"), F.when(F.col("id") > 20, F.col("id")).alias("v")), "rows")
    out = placed(rows, ["v"], "k").collect()
    for k in range(3):
        mine = sorted((r for r in out if r.k == k), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine))) and {r.of for r in mine} == {len(mine)}
        assert [r.v is not None for r in mine] == sorted(r.v is not None for r in mine)
        assert [r.v for r in mine if r.v is not None] == sorted(r.v for r in mine if r.v is not None)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    assert_same(queries.op12_merkle(spark, path), views(path), queries.OP12_SQL)
