"""Quotient filters and collocations beside plain counting, and SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import assert_same, views

from foliant.llm import collocations as co
from foliant.llm import queries
from foliant.llm.quotient import Layout, freeze, pack, summed, thaw, unpack


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain(docs, least, top):
    """Sorted rows by counting; docs: (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def found(spark, docs, least, top, **more):
    df = spark.createDataFrame([(t, lang, 1, "x", 2.0) for t, lang in docs], "text string, lang string, n int, words string, score double")
    return sorted(map(tuple, co.collocations(df, least=least, top=top, **more).collect()))


def made(seed, n, words=12):
    r = random.Random(seed)
    return [("".join(r.choice(["Ab", "c", "dé", "e'f", "g", "\x01", "ß", "H", "i", "j-j", "k", "l"][:words]) + r.choice([" ", " ", "  ", "\t", ". ", "\n", " ,"]) for _ in range(r.randrange(80))), r.choice(["en", "en", "de", None, "und"])) for _ in range(n)]


def test_beside_counting(spark):
    docs = made(1, 300) + [(None, "en"), ("", None), ("one", "fr"), (" . , ", "fr")] + [("the big red dog", "en")] * 40 + [("the big red dog runs", "xx")] * 9
    assert found(spark, docs, 8, 50) == plain(docs, 8, 50)


def test_small_chunks_and_shards(spark, monkeypatch):
    """Many chunks and shards give the same counts; workers get both numbers with their functions."""
    docs = made(2, 200, 5)
    chunks = co._chunks
    monkeypatch.setattr(co, "SHARD", 64)
    monkeypatch.setattr(co, "_chunks", lambda batches: chunks(b.slice(i, 3) for b in batches for i in range(0, b.num_rows, 3)))
    assert found(spark, docs, 5, 1000) == plain(docs, 5, 1000)


def test_no_frequent_words_and_no_rows(spark):
    assert found(spark, [("a b c d e f", "en")] * 3, 30, 10) == []
    assert found(spark, [], 30, 10) == []


def test_ties_rank_by_phrase_bytes_and_shorter_phrases_go(spark):
    docs = [("b a. é a. B z. z z z z z", "en")] * 6
    got = found(spark, docs, 3, 3)
    assert got == plain(docs, 3, 3) and len(got) == 3


def test_long_text(spark):
    docs = [("lorem ipsum dolor sit amet " * 60_000, "en"), ("lorem ipsum", "en")]
    assert found(spark, docs, 30, 10) == plain(docs, 30, 10)


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 9), (3, 5), (3, 21), (4, 16), (2, 32), (3, 30), (4, 17), (4, 32)])
def test_filters_lose_nothing(n, bits):
    r = np.random.default_rng(n * bits)
    layout = Layout(n, bits)
    ids = r.integers(0, 1 << bits, (4000, n)) if bits < 12 else np.where(r.random((4000, n)) < 0.5, r.integers(0, 40, (4000, n)), r.integers(0, 1 << bits, (4000, n)))
    keys = pack(list(ids.T), layout)
    assert (unpack(keys, layout) == ids).all()
    distinct, counts, place = summed(keys, None, layout)
    want = Counter(map(tuple, ids.tolist()))
    assert dict(zip(map(tuple, unpack(distinct, layout).tolist()), counts.tolist(), strict=True)) == want
    assert (unpack(distinct[place], layout) == ids).all()
    counts = counts + r.integers(0, 3, len(counts)) * 254
    for cut in (0, min(3, layout.left)):
        shard = distinct.left >> np.uint64(layout.left - cut) if cut else np.zeros(len(distinct), np.uint64)
        for s in np.unique(shard):
            at = shard == s
            back, numbers = thaw(freeze(distinct[at], counts[at], layout, cut), layout, cut, int(s))
            assert (back.left == distinct.left[at]).all() and (back.right == distinct.right[at]).all() and (numbers == counts[at]).all()


def test_filters_are_compact():
    ids = np.random.default_rng(0).integers(0, 1 << 16, (2, 200_000))
    layout = Layout(2, 16)
    keys, counts, _ = summed(pack(list(ids), layout), None, layout)
    assert len(freeze(keys, counts, layout, 0)) < 0.55 * 8 * len(keys)


def test_merging_adds_counts_across_filters():
    layout = Layout(3, 8)
    a, b = ([np.array(x) for x in zip(*p, strict=True)] for p in ([(1, 2, 3), (4, 5, 6), (4, 5, 6)], [(4, 5, 6), (7, 8, 9)]))
    both = [summed(pack(x, layout), None, layout) for x in (a, b)]
    joined = type(both[0][0])(np.concatenate([k.left for k, *_ in both]), np.concatenate([k.right for k, *_ in both]))
    keys, counts, _ = summed(joined, np.concatenate([c for _, c, _ in both]), layout)
    assert dict(zip(map(tuple, unpack(keys, layout).tolist()), counts.tolist(), strict=True)) == {(1, 2, 3): 1, (4, 5, 6): 3, (7, 8, 9): 1}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    assert_same(queries.op13_collocations(spark, path), views(path), queries.OP13_SQL)


def test_no_vocabulary_is_broadcast(spark, monkeypatch):
    """Only what has a row for each partition or language is."""
    plans, cut = {}, co.cut
    monkeypatch.setattr(co, "cut", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or cut(df, name))
    docs = made(3, 60)
    assert found(spark, docs, 8, 50) == plain(docs, 8, 50)
    assert sum("SortMergeJoin" in x for x in plans.values()) >= 3
    assert not [name for name, x in plans.items() if name != "vocabulary" and "BroadcastExchange" in x]
