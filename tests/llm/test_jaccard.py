"""Components of the n-gram Jaccard join beside brute force."""

import random
import re

import pytest

from foliant.llm.jaccard import Rule, jaccard_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_force(rows, rule):
    sets = [(d, shingles(t, rule.k)) for d, t in rows]
    up = {i: i for i in range(len(sets))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            if d is not None and e is not None and a and b and rule.den * len(a & b) >= rule.num * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(s), low[root(i)] if d is not None else None) for i, (d, s) in enumerate(sets)), key=str)


def found(spark, rows, rule):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df.repartition(3), rule=rule).collect()), key=str)


@pytest.mark.parametrize(("rule", "seed"), [(Rule(4, 85, 100), 1), (Rule(), 2), (Rule(1, 50, 100), 3)])
def test_like_brute_force(spark, words_of, rule, seed):
    r, rows = random.Random(seed), []
    for base in range(12):
        text = words_of(seed * 100 + base, r.choice([3, 30, 60, 150]))
        for _ in range(r.choice([1, 3, 8])):
            copy = list(text)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = f"x{r.randrange(50)}"
            rows.append((r.randrange(10**6), r.choice([" ", "\n", "\t "]).join(copy)))
    rows += [(5, None), (6, ""), (7, " \n"), (None, rows[0][1]), (8, "One Two"), (9, "one two"), (10, "one"), rows[3], rows[3]]
    assert found(spark, rows, rule) == brute_force(rows, rule)


def test_near_copies_that_link_only_through_the_middle(spark):
    base = [f"b{i}" for i in range(200)]
    rows = [(100, " ".join(base))]
    rows += [(i, " ".join([*base[: 3 * i], f"n{i}", *base[3 * i + 1 :]])) for i in range(40)]
    assert found(spark, rows, Rule(4, 95, 100)) == brute_force(rows, Rule(4, 95, 100))


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, component_id string")
    assert jaccard_components(df).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", "x", 9)], "doc_id long, text string, component_id string, cls int")
    assert jaccard_components(df).collect()[0] == (1, 2, 1)


def test_very_long_text(spark):
    text = " ".join(f"v{i % 5000}" for i in range(200_000)) + " " + "z" * 2_000_000
    rows = [(1, text), (2, text + " end"), (3, "short text of no one")]
    assert [(r.doc_id, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).orderBy("doc_id").collect()] == [(1, 1), (2, 1), (3, 3)]


def test_hot_classes_and_struct_ids(spark, monkeypatch, words_of):
    """One text with very many near copies, and ids that are no numbers."""
    from pyspark.sql import functions as F

    monkeypatch.setattr("foliant.llm.jaccard.HOT", 4)
    base = words_of(1, 120)
    rows = [(i, " ".join(base[:60] + [f"x{i}"] + base[60:])) for i in range(40)] + [(100, " ".join(base)), (101, None), (102, "quite other words here now")]
    df = spark.createDataFrame(rows, "n long, text string").select(F.struct("n", F.lit(1).alias("k")).alias("id"), "text")
    out = {r.doc_id.n: r.component_id.n for r in jaccard_components(df, "id").collect()}
    assert out == {i: 0 for i in range(40)} | {100: 0, 101: 101, 102: 102}
