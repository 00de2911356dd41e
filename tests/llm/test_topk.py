"""The exact top-k search beside brute force, SQL and its own bounds."""

import numpy as np
import pytest
from compare import assert_same, views
from pyspark.sql import functions as F

from foliant.llm import queries
from foliant.llm.topk import Cells, Plan, Scan, statistics, top_k

SMALL = Plan(levels=(2, 4), shard=40, chunk=7, tile=16)
SCHEMA = "vec_id long, v array<long>, row string, cell double, score int"


def brute(rows, asks, k):
    """query_id, rank, vec_id, score by whole numbers of any size; rows: (vec_id, v)."""
    out = []
    for i, (query, q) in enumerate(rows):
        if q is None or None in q or not asks(query):
            continue
        found = []
        for j, (other, c) in enumerate(rows):
            if i != j and c is not None and None not in c and len(c) == len(q):
                score = sum(a * b for a, b in zip(q, c, strict=True))
                found.append((-max(-(2**63), min(2**63 - 1, score)), other is None, other or 0, other))
        out += [(query, rank + 1, other, -score) for rank, (score, _, _, other) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def run(spark, rows, k=5, plan=SMALL, every=5):
    df = spark.createDataFrame([(i, v, "x", 0.5, 1) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in top_k(df, F.col("v"), F.col("vec_id") % every == 0, k, plan=plan).collect()), key=str)


def test_random_vectors(spark):
    x = np.random.default_rng(1).integers(-40, 40, (300, 10)).tolist()
    rows = list(enumerate(x))
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0, 5)


def test_ties_repeats_nulls_and_lengths(spark):
    same = [1, 2, 3, 4]
    rows = [(i, same) for i in range(100)] + [(7, same), (7, [9, 9, 9, 9]), (None, same), (None, [50, 50, 50, 50]), (200, None), (205, [1, None, 2, 3])]
    rows += [(300, [1]), (301, [2]), (305, []), (310, []), (315, [0, 0, 0, 0]), (320, [2**62, 2**62, 0, 0]), (325, [2**62, -(2**62), 1, 1]), (330, [3 * 10**9] * 4)]
    want = brute(rows, lambda i: i is not None and i % 5 == 0, 4)
    assert run(spark, rows, k=4) == want
    assert {q for q, *_ in want} >= {305, 310, 315, 320}


def test_empty_table_and_fewer_than_k(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, None)]) == []
    assert run(spark, [(5, [1, 2])]) == []
    assert run(spark, [(5, [1, 2]), (6, [3, 4])]) == [(5, 1, 6, 11)]


def test_bounds_hold_and_get_finer():
    x = np.random.default_rng(2).integers(-99, 99, (80, 21)).astype(float)
    exact = x @ x.T
    coarse, fine = (statistics(x, s) @ statistics(x, s).T for s in (3, 6))
    assert (coarse + 1e-6 >= exact).all() and (fine + 1e-6 >= exact).all()
    assert (fine - exact).mean() < (coarse - exact).mean()
    m, s = np.split(statistics(x, 3), 2, axis=1)
    cell = Cells(np.array([80]), m.min(axis=0)[None], m.max(axis=0)[None], s.max(axis=0)[None])
    assert (cell.reach(statistics(x, 3))[:, 0] + 1e-6 >= exact.max(axis=1)).all()


def test_smooth_vectors_are_pruned_and_still_exact():
    r = np.random.default_rng(3)
    x = np.repeat(r.integers(-100, 100, (3000, 4)), 8, axis=1) + r.integers(-3, 3, (3000, 32))
    scan = Scan(x[:50], np.full(50, -np.inf), 5, Plan())
    for lo in range(0, 3000, 250):
        scan.tile(x[lo : lo + 250], lo, np.arange(50))
    exact = x[:50] @ x.T
    exact[np.arange(50), np.arange(50)] = -(10**9)
    assert scan.score.reshape(50, 5).tolist() == (-np.sort(-exact, axis=1)[:, :5]).tolist()
    assert scan.compared < 0.2 * exact.size  # the first tile is compared whole


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    assert_same(queries.op11_topk(spark, path), views(path), queries.OP11_SQL)


def test_components_that_are_not_finite(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (1, [1.0, float("nan")]), (2, [float("inf"), 1.0]), (3, [1.0, None]), (4, None), (50, [0.999, -0.001])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op11_topk(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 50, 256 * 255 - 512), (50, 1, 0, 256 * 255 - 512)]
