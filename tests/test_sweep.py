"""Sweeps of intervals and points beside plain nested loops."""

import random

from foliant.operators.sweep import covered, owner, ranks


def nest(r, lo, hi, depth, out):
    """Random spans that nest or are disjoint."""
    at = lo
    while at < hi:
        a = at + r.randrange(3)
        z = min(hi, a + r.randrange(1, 12))
        if a < z:
            out.append((a, z, depth))
            if depth < 5 and r.random() < 0.7:
                nest(r, a, z, depth + 1, out)
        at = max(z, at + 1)


def made():
    r, spans, points = random.Random(4), [], []
    for d in range(12):
        mine = []
        nest(r, 0, 60, 1, mine)
        spans += [(d, a, z, depth, f"n{i}") for i, (a, z, depth) in enumerate(mine)]
        points += [(d, r.randrange(-3, 65), f"t{i}") for i in range(80)]
    return spans, points


def test_owner_is_the_deepest_cover(spark):
    spans, points = made()
    spans += [(0, 5, 5, 9, "empty"), (0, 9, 2, 9, "turned"), (1, 3, None, 9, "open")]
    nodes = spark.createDataFrame(spans, "doc_id long, pos int, end_pos int, depth int, node_id string")
    rows = spark.createDataFrame(points, "doc_id long, pos int, node string")
    deepest = {}
    for d, p, _ in points:
        over = [(depth, a, n) for x, a, z, depth, n in spans if x == d and z is not None and a <= p < z]
        deepest[d, p] = max(over)[::2][::-1] if over else (None, None)
    got = owner(rows, nodes, "depth", also=["depth"]).collect()
    assert len(got) == len(points)
    assert all((g.node_id, g.depth) == deepest[g.doc_id, g.pos] for g in got)
    inside = owner(rows, nodes, "depth", keep=False).collect()
    assert len(inside) == sum(deepest[d, p][0] is not None for d, p, _ in points)
    assert owner(rows, nodes.limit(0), "depth").where("node_id IS NOT NULL").count() == 0
    plan = owner(rows, nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_ranks_and_covers_of_any_spans(spark):
    spans, points = made()
    spans += [(2, 10, 40, 0, "x"), (2, 30, 55, 0, "y"), (2, 7, 7, 0, "z"), (99, 0, 5, 0, "lone")]
    nodes = spark.createDataFrame([(d, a, z, n) for d, a, z, _, n in spans], "doc_id long, pos int, end_pos int, node_id string")
    rows = spark.createDataFrame([(d, p, t, i % 7) for i, (d, p, t) in enumerate(points)], "doc_id long, pos int, text string, w int")
    found = ranks(rows, nodes, ["node_id"], rows["w"])
    want = {(d, n): sorted((p, t) for x, p, t in points if x == d and a <= p < z) for d, a, z, _, n in spans}
    weights = {(d, t): i % 7 for i, (d, _, t) in enumerate(points)}
    for r in found.collect():
        own = want[r.doc_id, r.node_id]
        assert r.stop - r["first"] == len(own) and r.weight == sum(weights[r.doc_id, t] for _, t in own)
    got = {}
    for r in covered(rows, found).collect():
        got.setdefault((r.doc_id, r.node_id), []).append((r.pos, r.text))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_covers_are_never_broadcast(spark):
    """What spans cover is more than the spans, which Spark judges the rows by."""
    points = spark.range(60).selectExpr("id % 3 AS doc_id", "CAST(id AS INT) AS pos")
    spans = spark.range(12).selectExpr("id % 3 AS doc_id", "concat('n', id) AS node_id", "CAST(id AS INT) AS pos", "CAST(id * 5 AS INT) AS end_pos")
    out = covered(points, ranks(points, spans, ["node_id"]))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == sum(max(0, len([p for p in range(60) if p % 3 == i % 3 and i <= p < i * 5])) for i in range(12))
