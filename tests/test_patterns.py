"""The automaton beside contains, and searches that use it."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import patterns, review
from foliant.operators.retrieve import join_match, keyword_search, rule_match

TEXTS = ["the cat sat", "", None, "concatenate", "Straße über alles", "aaaa", "他说合同金额", "x😀y"]
TERMS = ["cat", "aa", "aaa", "ß", "über", "金额", "合同", "😀y", "no", "", None, "cat", "the cat sat"]


def expected(texts, terms):
    out = set()
    for i, row in enumerate(texts):
        for t in {x for x in terms if x is not None}:
            place = next((p for p, x in enumerate(row) if x is not None and t in x), None)
            if place is not None:
                out.add((i, t, place, row[place].index(t) + 1))
    return out


def found(spark, texts, terms):
    rows = spark.createDataFrame([(i, *row) for i, row in enumerate(texts)], "i int, a string, b string")
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    out = patterns.with_terms(rows, ["a", "b"], asked).select("i", F.explode("found").alias("f")).select("i", "f.*").collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


def test_terms_and_places(spark):
    texts = [(a, b) for a in TEXTS for b in reversed(TEXTS)]
    assert found(spark, texts, TERMS) == expected(texts, TERMS)
    assert found(spark, texts, []) == set() == found(spark, [], TERMS)


def test_tries_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(patterns, "TRIE_CHARS", 20)
    r = random.Random(1)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 5)))
    terms = [word() for _ in range(60)]
    texts = [(" ".join(word() for _ in range(6)), word()) for _ in range(50)]
    assert found(spark, texts, terms) == expected(texts, terms)


def test_a_hundred_thousand_terms_in_one_pass(spark):
    terms = spark.range(100_000).select(F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(";")).alias("term"))
    rows = spark.range(200).select("id", F.concat(F.lit("x t"), (F.col("id") * 499).cast("string"), F.lit("; y")).alias("text"))
    out = patterns.with_terms(rows, ["text"], terms)
    assert out.select("id", F.explode("found.term").alias("t")).where(F.col("t") == F.concat(F.lit("t"), (F.col("id") * 499).cast("string"), F.lit(";"))).count() == 200


def test_repeated_keywords_count_once_on_either_path(spark):
    nodes = spark.createDataFrame([(1, "n1", "red fox", "a red dog and a red cat", True), (1, "n2", "blue", "red", False), (2, "n3", None, "dog red", True), (3, "n4", "x", None, True)], "doc_id long, node_id string, title string, text string, is_leaf boolean")
    words = [(7, None, "red"), (7, None, "red"), (7, 1, "red"), (8, 1, "dog"), (8, 1, "dog"), (8, 2, "dog"), (9, None, ""), (9, None, None), (10, None, "cat")]
    keywords = spark.createDataFrame(words, "query_id long, doc_id long, keyword string")
    rows = lambda few: sorted(map(tuple, keyword_search(nodes, keywords, 3, few).collect()))
    want = [(7, 1, "n1", "red", "title", 1, "red fox"), (7, 2, "n3", "red", "text", 5, "og red"), (8, 1, "n1", "dog", "text", 7, "ed dog an"), (8, 2, "n3", "dog", "text", 1, "dog re"), (10, 1, "n1", "cat", "text", 21, "ed cat")]
    assert rows(1000) == want == rows(1)


def test_rules_and_joins_of_many_steps(spark):
    anchors = spark.createDataFrame([(1, "p_1", 1, "n1", "alpha beta"), (1, "p_2", 2, "n1", "beta"), (1, "p_3", 3, None, "alpha"), (2, "p_1", 1, "n9", "alpha")], "doc_id long, anchor string, pos int, node_id string, text string")
    steps = spark.createDataFrame([(5, 1, ["alpha", "beta"]), (5, 1, ["beta"]), (6, 2, ["beta"]), (7, 2, ["alpha", "x"])], "query_id long, doc_id long, terms array<string>")
    assert sorted((r.query_id, r.doc_id, r.anchor, r.text_override) for r in rule_match(anchors, steps).collect()) == [(5, 1, "p_1", "alpha beta"), (5, 1, "p_2", "beta"), (7, 2, "p_1", "alpha")]
    nodes = spark.createDataFrame([(1, "a", 4, "t", "s", "alpha", True), (1, "b", 2, "beta", None, None, True), (1, "c", 1, "beta", "", "", False), (1, "body", 0, "beta", "", "", True)], "doc_id long, node_id string, pos int, title string, summary string, text string, is_leaf boolean")
    joins = spark.createDataFrame([(5, 1, ["c", "a"], ["alpha", "beta"]), (6, 1, [], ["eta"])], "query_id long, doc_id long, regions array<string>, terms array<string>")
    assert sorted(map(tuple, join_match(nodes, joins).collect())) == [(5, 1, "a", 2), (5, 1, "b", 3), (5, 1, "c", 1), (6, 1, "b", 1)]


def test_rule_evidence(spark):
    criteria = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id long, criterion_id int")
    evidence = spark.createDataFrame([(1, 2)], "doc_id long, criterion_id int")
    anchors = spark.createDataFrame([(1, 3, "c", "pay now"), (1, 1, "a", "pay"), (1, 2, "b", "payment"), (2, 1, "a", None)], "doc_id long, pos int, anchor string, text string")
    rules = spark.createDataFrame([(1, "pay", 2), (2, "pay", 2)], "criterion_id int, keyword string, most int")
    assert sorted(map(tuple, review.enrich_rule_evidence(criteria, evidence, anchors, rules).collect())) == [(1, 1, "a"), (1, 1, "b")]


@pytest.mark.parametrize("text", ["", "abc", "aXbXc"])
def test_hits_are_first_occurrences(text):
    trie = patterns._trie(["X", "abc", "c"])
    assert {h["term"]: h["position"] for h in patterns.hits(trie, [text])} == {t: text.index(t) + 1 for t in ("X", "abc", "c") if t in text}
