"""Targets and systematic sampling beside plain Python."""

import random
from collections import Counter

import pytest

from foliant.llm import mixing


def targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        left = sum(w[s] for s in free)
        level = (total - sum(most * sizes[s] for s in stopped)) / left if left else 0
        more = {s for s in free if most * sizes[s] < level * w[s]}
        if not more:
            return {s: most * sizes[s] if s in stopped else level * w[s] for s in names}
        stopped |= more


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "b", "ä", "z", None, "Z", ""]) if r.random() > 0.4 else "hot", "w " * r.choice([0, 1, 5, 40, 300])) for i in range(700)]
    rows += [(9999, "tiny", "one two"), (None, "a", None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    df = df.withColumn("size", mixing.n_words(df["text"]))
    out = mixing.mix(df, "size").collect()
    assert len(out) == len(rows)
    sizes, taken = Counter(), Counter()
    for x in out:
        sizes[x.source] += x.size
        taken[x.source] += x.size * x.copies
        assert 0 <= x.copies <= 3
    want = targets(sizes)
    for x in out:
        assert x.source_size == sizes[x.source]
        assert x.target == pytest.approx(want[x.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * sizes[s] + 400
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix(df.repartition(3), "size").collect()
    assert Counter((x.doc_id, x.copies) for x in again) == Counter((x.doc_id, x.copies) for x in out)


def test_take_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 5, 2), (2, "a", 5, 0), (3, "b", 1, None)], "doc_id long, source string, size int, copies long")
    assert sorted(r.doc_id for r in mixing.take(df).collect()) == [1, 1]
    assert mixing.mix(df.limit(0), "size").count() == 0


def test_all_sizes_zero(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, None, None)], "doc_id long, source string, size int")
    assert [(r.target, r.copies) for r in mixing.mix(df, "size").collect()] == [(0.0, 0), (0.0, 0)]


def test_rows_of_the_mix(spark):
    rows = [(i, f"w{i} " * (i % 7), "hot" if i % 3 else "b", i) for i in range(200)] + [(7, "again and again", "b", 1)] * 5 + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _a long").repartition(4)
    out = Counter(tuple(r) for r in mixing.mixed_rows(df, mixing.n_words(df["text"])).collect())
    assert set(out) <= set(map(tuple, rows))
    assert all(n <= 3 * Counter(map(tuple, rows))[row] for row, n in out.items())
    words = lambda row: len((row[1] or "").split())
    assert abs(sum(n * words(row) for row, n in out.items()) - sum(map(words, rows))) < 60
    assert out == Counter(tuple(r) for r in mixing.mixed_rows(df.repartition(2), mixing.n_words(df["text"])).collect())
    assert mixing.mixed_rows(df.limit(0), mixing.n_words(df["text"])).count() == 0
