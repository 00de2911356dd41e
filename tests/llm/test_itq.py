"""Links and components beside brute force, and recall near the threshold."""

import numpy as np
import pytest

from foliant.llm.itq import Index, fit, near_duplicates, near_pairs


def brute_force(ids, x, least):
    good = np.array([v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x])
    n = len(ids)
    links, up = np.zeros(n, int), list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    low = {}
    for i in range(n):
        low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return links, [low[root(i)] for i in range(n)]


def clusters(seed, groups, size, d, noise):
    r = np.random.default_rng(seed)
    return np.concatenate([r.standard_normal(d) + noise * r.standard_normal((size, d)) for _ in range(groups)])


def test_like_brute_force(spark):
    x = [[float(np.float32(v)) for v in row] for row in np.concatenate([clusters(1, 12, 6, 32, 0.1), clusters(2, 60, 1, 32, 0)])]
    x += [x[0], x[0], None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0], [float(np.float32(2 * v)) for v in x[5]]]
    ids = list(range(1000, 1000 + len(x)))
    df = spark.createDataFrame(list(zip(ids, x, [1] * len(x), strict=True)), "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in near_duplicates(df, least=0.9).collect()}
    links, components = brute_force(ids, x, 0.9)
    assert len(out) == len(ids)
    assert [out[i].n_links for i in ids] == links.tolist()
    assert [out[i].component_id for i in ids] == components
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


def test_recall_at_any_similarity(spark):
    r = np.random.default_rng(7)
    a = r.standard_normal((600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((600, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = r.uniform(0.9, 1, (600, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in near_duplicates(df).collect())
    s = x @ x.T
    want = (s >= 0.9).sum() - len(x)
    assert 0.9 * want <= found <= want


def test_blocks_of_a_large_bucket(spark):
    x = clusters(3, 2, 60, 16, 0.02)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(df, index=Index(chunk=16)).collect())
    links, components = brute_force(list(range(len(x))), x.tolist(), 0.9)
    assert out == list(zip(range(len(x)), links.tolist(), components, strict=True))


@pytest.mark.parametrize("kind", ["even", "clustered", "flat"])
def test_recall_on_planted_pairs(kind):
    """Pairs just at the limit, among other vectors: they meet in a table, are near by their codes, and pass the rerank."""
    r = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    d, n = 64, 4000
    a = r.standard_normal((n, d))
    if kind == "clustered":
        a = r.standard_normal((40, d))[r.integers(40, size=n)] * 2 + a
    if kind == "flat":
        a = a * np.linspace(3, 0.1, d)
    a, b = unit(a), r.standard_normal((n, d))
    b = unit(b - (a * b).sum(1, keepdims=True) * a)
    pairs = 0.901 * a + np.sqrt(1 - 0.901**2) * b
    for size in (2 * n, 5_000_000):
        index = Index().sized(size, d, 0.9)
        codes = fit(np.concatenate([a, pairs]), index)
        (ka, ca), (kb, cb) = codes.keys(a), codes.keys(pairs)
        met = (ka == kb).any(axis=1)
        apart = np.bitwise_count(ca.view(np.uint64) ^ cb.view(np.uint64)).sum(axis=1)
        assert (met & (apart <= index.radius(codes.length(), 0.9))).mean() >= 0.9
    assert index.bits == 13 and index.rotations > 2


def test_near_pairs_both_ways():
    r = np.random.default_rng(2)
    for spread in (0.01, 1.0):
        x = np.concatenate([r.standard_normal((1, 32)) + spread * r.standard_normal((200, 32)), r.standard_normal((30, 32))])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        index = Index().sized(len(x), 32, 0.9)
        _, code = fit(x, index).keys(x)
        left, right = np.arange(0, 230, 2), np.arange(1, 230, 2)
        a, b = near_pairs(x, code, left, right, index.radius(64 * code.shape[1], 0.9), 0.9)
        s = x[left] @ x[right].T >= 0.9
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(left[i], right[j]) for i, j in zip(*np.nonzero(s), strict=True)}


def test_null_and_repeated_ids(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, v), (None, w), (3, v), (3, w), (4, [0.0, 1.0, 0.01]), (5, None), (6, [0.0] * 3), (7, [1.0, float("nan"), 0.0])]
    out = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 8
    assert sorted((r.vec_id or 0, r.n_links) for r in out) == [(0, 1), (0, 2), (3, 1), (3, 2), (4, 2), (5, 0), (6, 0), (7, 0)]
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_buckets_beyond_the_bound_are_joined_by_key(spark, monkeypatch):
    from foliant.llm import itq

    r = np.random.default_rng(8)
    x = r.standard_normal((150, 16))
    x[75:] = x[:75] + 0.05 * r.standard_normal((75, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = lambda: sorted(map(tuple, itq.near_duplicates(df).collect()))
    sent = rows()
    monkeypatch.setattr(itq, "MOST_BUCKETS", 0)
    assert rows() == sent and sum(n for _, n, *_ in sent) >= 140
