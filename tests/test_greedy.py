"""Folds of long groups, in blocks, beside those of whole groups and a plain loop."""

import random

import pytest

from foliant.operators.greedy import greedy_batches, overlapping_batches


def plain(weights, limit, most=None, flush_empty=True):
    out, batch, total, n = [], 1, 0, 0
    for w in weights:
        full = n and total + w > limit and (flush_empty or total > 0)
        if full or (most is not None and n == most):
            batch, total, n = batch + 1, 0, 0
        total, n = total + w, n + 1
        out.append(batch)
    return out


def made(kind, n, seed):
    r = random.Random(seed)
    return [{"mixed": r.choice([0, 0, 1, 2, 3, 7, 30]), "ones": 1, "zeros": 0, "large": r.randrange(5, 40), "rare": 25 if r.random() < 0.05 else 0}[kind] for _ in range(n)]


KINDS = ["mixed", "ones", "zeros", "large", "rare"]


@pytest.mark.parametrize(("most", "flush_empty"), [(None, True), (None, False), (5, True), (5, False)])
def test_blocks_equal_a_plain_loop(spark, most, flush_empty):
    groups = {(kind if n != 33 else None, n): made(kind, n, n) for kind in KINDS for n in (1, 7, 8, 9, 33, 100, 257)}
    groups = {k: v for k, v in groups.items() if k[0] is not None or v == made("mixed", 33, 33)}
    rows = [(k, n, i, w, f"{k}-{i}", 20) for (k, n), weights in groups.items() for i, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "k string, n int, place int, w int, text string, top int")
    out = greedy_batches(df, ["k", "n"], "place", "w", "top", max_items=most, flush_empty=flush_empty, carry=["text"], block=8)
    got = {}
    for r in out.collect():
        assert r.text == f"{r.k}-{r.place}"
        got.setdefault((r.k, r.n), []).append((r.place, r.batch))
    assert {g: [b for _, b in sorted(x)] for g, x in got.items()} == {g: plain(w, 20, most, flush_empty) for g, w in groups.items()}


def plain_overlap(weights, target, overlap):
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    n, at, out = len(weights), 0, []
    while at < n:
        end = at + 1
        while end < n and total[end + 1] - total[at] <= target:
            end += 1
        out.append((at, end - 1))
        if end == n:
            break
        back = end
        while overlap > 0 and total[end] - total[back] < overlap and back > at + 1:
            back -= 1
        at = max(at + 1, back)
    return out


@pytest.mark.parametrize("overlap", [0, 4, 9, 25])
def test_overlaps_in_blocks_equal_whole_folds(spark, overlap):
    docs = {i: made(kind, n, i) for i, (kind, n) in enumerate((k, n) for k in KINDS for n in (5, 40, 130))}
    df = spark.createDataFrame([(d, i, w) for d, weights in docs.items() for i, w in enumerate(weights)], "doc_id long, pos int, w int")
    rows = lambda block: sorted(map(tuple, overlapping_batches(df, 20, overlap, block).collect()))
    whole = rows(1 << 16)
    assert rows(8) == whole
    if overlap in (0, 25):
        return
    for d, weights in docs.items():
        if all(weights):  # where items weigh nothing, several starts repeat as much
            assert [(a, z) for x, _, a, z in whole if x == d] == plain_overlap(weights, 20, overlap)


def test_a_hot_document_is_never_in_one_task(spark):
    """200,000 items of one document in blocks of 2,000: no row and no group has more."""
    df = spark.range(200_000).selectExpr("1L AS doc_id", "CAST(id AS INT) AS pos", "CAST(id * 7919 % 13 AS INT) AS w")
    out = greedy_batches(df, ["doc_id"], "pos", "w", 100, block=2_000)
    got = [r.batch for r in out.orderBy("pos").select("batch").collect()]
    assert got == plain([i * 7919 % 13 for i in range(200_000)], 100)
