"""Steps that know sizes and places from numbers beside those that have whole texts."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from foliant.functions.text import estimate_tokens
from foliant.operators import retrieve as E
from foliant.operators import tree as D

LINES = ["Ä heading", "plain words of a line", "größer als zuvor", "", "合同期限三年", "x", "a table"]


def made(spark):
    rows = [(d, p, "tbl" if p % 5 == 0 else "p", LINES[(d + p) % len(LINES)], 1 + p % 3 if p % 2 else None) for d in range(4) for p in range(1, 40)]
    b = spark.createDataFrame(rows, "doc_id long, pos int, kind string, text string, level int").where("doc_id <> 2 OR kind = 'tbl'")
    headings = b.where("level IS NOT NULL").select("doc_id", "pos", "level", F.col("text").alias("title"))
    return b, D.build_hierarchy(headings, b.groupBy("doc_id").agg((F.max("pos") + 1).alias("range_end")))


def shown(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_tokens_follow_from_sums(spark):
    b, nodes = made(spark)
    for tables in (False, True):
        whole = D.materialize_nodes(nodes, b, tables)
        want = {(r.doc_id, r.node_id): r.n for r in whole.select("doc_id", "node_id", estimate_tokens(F.col("text")).alias("n")).collect()}
        assert {(r.doc_id, r.node_id): r.tokens for r in whole.collect()} == want
        assert {(r.doc_id, r.node_id): r.tokens for r in D.measure_nodes(nodes, b, tables).collect()} == want
        assert len(set(want.values())) > 5


def test_search_needs_no_texts_of_nodes(spark):
    b, nodes = made(spark)
    nodes = nodes.withColumn("is_leaf", ~F.coalesce(F.lead("parent_id").over(D.W()) == F.col("node_id"), F.lit(False)))
    anchors = b.select("doc_id", "pos", "kind", "text")
    step = "query_id long, doc_id long, step_no int, method string, terms array<string>, regions array<string>, all_titles boolean, fallback boolean"
    steps = spark.createDataFrame([(d * 2 + k, d, 1, m, t, g, d == 1, False) for d in range(4) for k, m, t, g in ((0, "title", ["Ä", "x"], []), (1, "region", [], ["body/sec_001", "body/sec_002"]))], step)
    rows = lambda n, a: sorted(map(str, E.search(n, steps, a, budget=12).collect()))
    owned = D.own_anchors(anchors.withColumn("anchor", F.concat(F.lit("p"), "pos")), nodes)
    plain = rows(D.measure_nodes(nodes, b), anchors)
    assert plain == rows(D.materialize_nodes(nodes, b), owned)
    assert any("has_more=True" in r for r in plain) and len(plain) == 8


def test_contexts_move_texts_once(spark):
    b, nodes = made(spark)
    units = nodes.select("doc_id", F.col("doc_id").alias("query_id"), "pos", "end_pos", "title")
    assert shown(E.anchor_context(units, b)).count("text#") > 0
    moved = [x for x in shown(E.anchor_context(units, b)).splitlines() if "Window" in x or "SortMergeJoin" in x]
    assert moved and not any("text#" in x for x in moved)
    twice = b.unionByName(b.where("pos % 3 = 0"))
    assert E.anchor_context(units, twice).exceptAll(E.anchor_context(units, b)).isEmpty()


def test_parts_are_folded_without_texts(spark):
    b, nodes = made(spark)
    b = b.where("kind = 'p'")
    key = lambda df: sorted(map(str, df.select("doc_id", "node_id", "part", "text", "start_pos", "end_pos").collect()))
    whole = D.materialize_nodes(nodes, b).select("doc_id", "node_id", "pos", "end_pos", "text", "tokens")
    bare = E.chunk_oversized(D.measure_nodes(nodes, b), 12, b)
    want = key(E.chunk_oversized(whole, 12, b))
    assert key(bare) == want and any("part=2" in r for r in want)
    # no text is sorted, and only the lines' own array is shuffled
    assert not any("text#" in x for x in shown(bare).splitlines() if "Exchange" in x or "Window" in x or "Sort " in x)


def test_many_keywords_read_texts_of_leaves_once(spark):
    b, nodes = made(spark)
    nodes = nodes.withColumn("is_leaf", ~F.coalesce(F.lead("parent_id").over(D.W()) == F.col("node_id"), F.lit(False)))
    words = [(i, None, x) for i, x in enumerate(["word", "als", "Ä", "三年", "line", *(f"none{k}" for k in range(30))])]
    keywords = spark.createDataFrame(words, "query_id long, doc_id long, keyword string")
    leaves = D.materialize_nodes(nodes, b, only="is_leaf")
    assert leaves.where("NOT is_leaf AND text IS NOT NULL").isEmpty() and not leaves.where("is_leaf AND text <> ''").isEmpty()
    found = E.keyword_search(leaves, keywords)
    assert "MapInArrow" in shown(found)
    assert sorted(map(str, found.collect())) == sorted(map(str, E.keyword_search(D.materialize_nodes(nodes, b), keywords, few=1000).collect()))


def test_parts_of_an_index_share_their_nodes(spark):
    from foliant.plans.sources import index_parts

    parts = index_parts(spark, "/root/testdata/sf0.001")
    for name in ("structure", "content", "titles", "tokens"):
        assert "Exchange" not in shown(parts[name]), name
