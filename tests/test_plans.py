"""What plans repeat or move, where that decides how a query grows."""

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import retrieve as E
from foliant.operators import tree as D


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def sent(df):
    """Whether a join of a plan as it is made at first broadcasts a side."""
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_entries_are_made_once(spark):
    nodes = spark.range(4).selectExpr("id AS doc_id", "concat('n', id) AS node_id", "concat('t', id) AS title", "concat('s', id) AS summary", "concat('x ', id) AS text")
    out = E.vector_entries(nodes, 60)
    assert plan(out).count("concat_ws(") == 1
    assert [r.entry for r in out.where("doc_id = 2").collect()] == ["标题：t2\n摘要：s2\n正文：x 2"]


def test_measures_of_texts_beside_plain_patterns(spark):
    """Short cuts of strip(), truncate(), estimate_tokens() and extractive_summary() beside patterns over whole texts."""
    import random

    r = random.Random(3)
    letters = " \t\n\x0b\r\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200bab合同é\U0001f600.xyzxyz"
    rows = [("".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 60, 200, 400, 900]))),) for _ in range(500)]
    rows += [(None,), (" " * 999 + "x" * 181 + " " * 999,), ("x " * 180,), ("x" * 180 + "   ",), ("x" * 181,), ("a" * 180 + " b",), ("   ",)]
    t, s = F.col("t"), T.SPACE
    flat, n, wide = T.collapse(t), F.length("t"), F.length(F.regexp_replace("t", "[\\x00-\\x7F]", ""))
    tokens = F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(wide / 1.6 + (n - wide) / 4.0))).cast("int")
    head = F.substring("t", F.lit(1), F.greatest(F.lit(1), F.floor(n * 60 / F.greatest(tokens, F.lit(1)))).cast("int"))
    same = [
        T.strip(t).eqNullSafe(F.regexp_replace("t", f"^{s}+|{s}+$", "")),
        T.estimate_tokens(t).eqNullSafe(tokens),
        T.extractive_summary(t).eqNullSafe(F.when(F.length(flat) <= 180, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, 180)), F.lit("...")))),
        T.truncate(t, 60, 1, "..").eqNullSafe(F.when(tokens <= 60, t).otherwise(F.concat(F.regexp_replace(head, f"{s}+$", ""), F.lit("..")))),
    ]
    assert spark.createDataFrame(rows, "t string").where(~(same[0] & same[1] & same[2] & same[3])).count() == 0


def test_batches_are_merged_without_a_frame_each(spark):
    rows = spark.range(20).selectExpr("id % 5 AS doc_id", "CAST(id / 10 AS INT) AS batch", "CAST(id AS INT) AS pos", "CAST(1 + id % 3 AS INT) AS level")
    out = D.merge_batches(rows)
    assert "InPandas" not in plan(out) and out.count() == 20


def test_chunks_move_texts_once(spark):
    docs = spark.range(4).selectExpr("id AS doc_id", "concat('One two. ', repeat(concat('Three ', id, ' four. '), 40), '\\n\\nEnd.') AS text")
    out = E.chunk_text(docs, 20, 5)
    assert "Window" not in plan(out)
    assert out.where("doc_id = 1").orderBy("chunk").first().text.startswith("One two. Three 1 four.")


def test_hierarchies_read_headings_once(spark):
    """Also for six levels: no join of layers; a level beyond them counts as far as its depth does."""
    rows = [(1, 0, 2), (1, 1, 1), (1, 2, 3), (1, 3, 2), (1, 4, 3), (1, 5, 7), (1, 6, 3), (1, 7, 0), (1, 8, 7), (2, 0, 3)]
    ends = spark.createDataFrame([(1, 9)], "doc_id long, range_end int")
    out = D.build_hierarchy(spark.createDataFrame(rows, "doc_id long, pos int, level int"), ends)
    found = {(r.doc_id, r.pos): (r.node_id, r.parent_id, r.depth, r.end_pos) for r in out.collect()}
    assert found == {
        (1, 0): ("body/l2_001", "body", 1, 1),
        (1, 1): ("body/sec_001", "body", 1, 9),
        (1, 2): ("body/sec_001/l3_001", "body/sec_001", 2, 3),
        (1, 3): ("body/sec_001/l2_001", "body/sec_001", 2, 9),
        (1, 4): ("body/sec_001/l2_001/l3_001", "body/sec_001/l2_001", 3, 6),
        (1, 6): ("body/sec_001/l2_001/l3_002", "body/sec_001/l2_001", 3, 9),
        (1, 7): ("body/l0_001", "body", 1, 9),
        (2, 0): ("body/l3_001", "body", 1, None),
    }
    many = spark.range(9).selectExpr("1L AS doc_id", "CAST(id AS INT) AS pos", "CAST(1 + id % 6 AS INT) AS level", "'t' AS title")
    assert plan(D.hierarchy_nodes(many, ends, "a")).count("Join") == 1


def test_segments_and_candidates_are_never_broadcast(spark):
    """Written tables are small by their compressed files, and large on the driver."""
    candidates = spark.range(200).selectExpr("id % 5 AS doc_id", "CAST(id AS INT) AS pos", "CASE WHEN id % 2 = 0 THEN 'arabic_dot' ELSE 'letter' END AS family", "id % 7 > 2 AS required")
    segments = spark.range(40).selectExpr("id % 5 AS doc_id", "CAST(id AS INT) AS segment_no", "CAST(id * 3 AS INT) AS start_pos", "map('arabic_dot', CAST(id % 9 AS INT)) AS rules")
    out = D.segment_errors(candidates, segments)
    assert not sent(out)
    assert out.where("error = 'unknown_start'").count() == sum(x * 3 % 5 != x % 5 for x in range(40))


def test_cases_are_covered_by_all_their_nodes(spark, tmp_path):
    """The next block is a node too: it has the gold text whole, or some of its grams, each as often as it stands there."""
    from foliant.plans import registry

    texts = [(1, "abcdefgh\nxx abcd efgh yy\n\nzzzzzz"), (2, "abcdefgh\nefgh"), (3, "abcdefgh")]
    spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.case_id: r.coverage for r in registry.queries()["g03_coverage"](spark, str(tmp_path)).collect()}
    # of six grams the own copy has two (abcd), the next block of document 2 two others
    assert found == {"1-1": 1.0, "2-1": 4 / 6, "3-1": 2 / 6}
