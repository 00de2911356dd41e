"""Components beside brute force."""

import random

from foliant.llm.graph import connected_components


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)] + [(500, 500 + i) for i in range(40)] + [(7, 7), (900, 900), (None, 3), (61, 61)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
