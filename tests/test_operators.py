"""Operators on small literal rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import blocks as B
from foliant.operators import detect as C
from foliant.operators import evaluate as G
from foliant.operators import ops as H
from foliant.operators import retrieve as E
from foliant.operators import review as R
from foliant.operators import tree as D
from foliant.operators.greedy import greedy_batches
from foliant.sources import tables as A

LEVELS = [(1, r"^[一二三四五六七八九十]+、"), (2, r"^（[一二三四五六七八九十]+）"), (3, r"^\d+[.、]")]


def doc(spark, *texts):
    return spark.createDataFrame([(1, i, "p", t) for i, t in enumerate(texts)], "doc_id long, pos int, kind string, text string")


def families(df):
    f = C.number_family(F.col("text"))
    return [(r.f, r.o) for r in df.orderBy("pos").select(f.alias("f"), C.number_ordinal(F.col("text"), f).alias("o")).collect()]


def test_levels_and_families(spark):
    df = doc(spark, "一、服务范围", "（一）服务地点", "1.具体要求", "正文", "第三条 范围", "②条", " 附件 2-3 清单", "第十二节", "1.2.3 x", "(7)", "b) x", "Z、", "4）x")
    assert [r.l for r in df.orderBy("pos").limit(4).select(C.heading_level(F.col("text"), LEVELS).alias("l")).collect()] == [1, 2, 3, None]
    assert families(df) == [
        ("cn_comma", 1), ("cn_paren", 1), ("arabic_dot", 1), ("unnumbered", None), ("article", 3), ("unnumbered", None), ("subattachment", 3),
        ("section", 12), ("arabic_multilevel", 1), ("arabic_paren", 7), ("letter", 2), ("letter", 26), ("arabic_close", 4),
    ]


def test_chinese_ordinals(spark):
    df = doc(spark, "十、甲", "十二、乙", "二十、丙", "三十五、丁", "九、戊", "贰拾壹、己", "百、庚", "两、辛")
    assert [o for _, o in families(df)] == [10, 12, 20, 35, 9, 21, None, 2]


def test_long_numbers_do_not_fail(spark):
    assert families(doc(spark, "13800138000 call", "13800138000. call", "(99999999999999999999) x")) == [("unnumbered", None), ("arabic_dot", 13800138000), ("arabic_paren", None)]


def test_number_spacing_and_prefix(spark):
    df = doc(spark, "一 、x", "12  .x", "3 、x", "（一 ）x", "x 、")
    assert [r.t for r in df.orderBy("pos").select(T.normalize_number_spacing(F.col("text")).alias("t")).collect()] == ["一、x", "12.x", "3、x", "（一 ）x", "x 、"]
    df = doc(spark, "1 .已有", "第二条 已有", "（三）已有", "(3) 没有", "正文")
    assert [r.t for r in df.orderBy("pos").select(B.apply_prefix(F.col("text"), F.lit(" 五、 ")).alias("t")).collect()] == ["1.已有", "第二条 已有", "（三）已有", "五、(3) 没有", "五、正文"]
    assert [r.t for r in df.limit(1).select(B.apply_prefix(F.col("text"), F.lit(None)).alias("t")).collect()] == ["1.已有"]


def laid_out(spark, rows):
    schema = "doc_id long, pos int, kind string, text string, outline int, level int, alignment string, bold_fraction double, max_font_size int, visual_title boolean, plain_label boolean"
    df = spark.createDataFrame([(1, i, "p", t, o, None, a, b, 20, False, False) for i, (t, o, a, b) in enumerate(rows)], schema)
    return df.withColumn("family", C.number_family(F.col("text")))


def test_runs_of_numbers_are_required(spark):
    rows = [("附件1", None, "left", 0.0), ("内部管理细则", None, "center", 1.0), ("1、第一项", None, "left", 0.0), ("2、第二项", None, "left", 0.0), ("3、第三项", None, "left", 0.0), ("正文" * 60, None, "left", 0.0), ("7、远", None, "left", 0.0), ("9、outlined", 2, "left", 0.0), ("附件1-2", None, "left", 0.0)]
    out = C.required_sequences(C.hierarchy_candidates(laid_out(spark, rows))).orderBy("pos").collect()
    assert [(r.pos, r.required) for r in out] == [(0, False), (1, False), (2, True), (3, True), (4, True), (6, False), (7, True), (8, True)]
    assert out[1].signals == ["center", "bold", "attachment_opening"]
    assert out[6].signals == ["outline:2", "number:arabic_comma", "attachment_opening"]


def test_patterns_from_examples(spark):
    rows = [("v", 1, 1, "一、合作背景"), ("v", 1, 2, "二．x"), ("v", 2, 3, "（一）基本原则"), ("v", 3, 4, "1. 合作事项"), ("v", 3, 5, "没有编号"), ("w", 1, 1, "第一部分"), ("w", 2, 2, "第二部分")]
    ex = spark.createDataFrame(rows, "profile string, level int, place int, text string")
    patterns = C.infer_number_pattern(ex)
    found = {(r.profile, r.level): (r.kinds, r.pattern) for r in patterns.collect()}
    assert found["v", 2][0] == ["chinese_parenthesized"] and found["v", 1][0] == ["chinese_delimited"]
    assert found["v", 3] == (["arabic_dot"], "^(?:\\d+[.．])")
    assert sorted((r.profile, r.place, r.matched) for r in C.pattern_errors(ex, patterns).collect()) == [("v", 5, []), ("w", 1, [1, 2]), ("w", 2, [1, 2])]


def test_regions_overlap_where_the_body_starts_first(spark):
    b = spark.createDataFrame([(1, i) for i in range(1, 9)], "doc_id long, pos int")
    cuts = spark.createDataFrame([(1, 1, 5, 7)], "doc_id long, body_start int, tail_start int, attachment_start int")
    assert {(r.region, r.start, r.stop) for r in C.region_ranges(b, cuts).collect()} == {("frontmatter", 1, 2), ("body", 1, 5), ("tail", 5, 7), ("attachments", 7, 9)}
    assert sorted((r.pos, r.region) for r in C.assign_regions(b, cuts).where("pos < 3").collect()) == [(1, "body"), (1, "frontmatter"), (2, "body")]


def test_attachment_starts(spark):
    rows = [(1, 1, "p", "附件1 清单", None), (1, 2, "p", "1、附件1 列表", None), (1, 3, "p", "附件1", None), (1, 4, "p", "附件：《工作说明书》", 1), (1, 5, "p", "附件：《无大纲》", None)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, kind string, text string, outline int")
    out = C.attachment_starts(df, r"^附件\s*([0-9]+)(?:\s*$|[：:、\s])", r"^\d+[.、]\s*附件", r"^附件\s*[：:]\s*《?.+")
    assert sorted((r.number or "", r.pos) for r in out.collect()) == [("", 4), ("1", 3)]


def test_profiles(spark):
    df = doc(spark, "一、合作背景", "（一）基本原则", "1. 合作事项", "二、合作内容")
    other = [(1, r"^第.条")]
    row = C.score_profiles(df, [("other", other), ("variant", LEVELS)]).where("profile = 'variant'").first()
    assert (row.n1, row.n2, row.n3, row.orphans, row.score) == (2, 1, 1, 0, 24)
    assert C.select_profile(C.score_profiles(df, [("other", other), ("variant", LEVELS)])).first().profile == "variant"


def test_tree(spark):
    rows = [(1, 1, 1, "a"), (1, 2, 2, "b"), (1, 3, 3, "c"), (1, 4, 2, "d"), (1, 5, 3, "e"), (1, 6, 1, "f")]
    h = spark.createDataFrame(rows, "doc_id long, pos int, level int, title string")
    ends = spark.createDataFrame([(1, 8)], "doc_id long, range_end int")
    found = {r.pos: (r.node_id, r.end_pos) for r in D.build_hierarchy(h, ends).collect()}
    assert found[3] == ("body/sec_001/l2_001/l3_001", 4)
    assert found[4] == ("body/sec_001/l2_002", 6)
    assert found[6] == ("body/sec_002", 8)


def test_numbers_never_reset(spark):
    b = spark.createDataFrame([(1, i, "n", i % 2) for i in range(6)], "doc_id long, pos int, num_id string, num_ilvl int")
    lv = spark.createDataFrame([("n", 0, "chineseCounting", "%1、", 9), ("n", 1, "lowerLetter", "(%1)", 1)], "num_id string, ilvl int, num_format string, level_text string, start int")
    assert [r.number_text for r in B.number_blocks(b, lv).orderBy("pos").collect()] == ["九、", "(a)", "十、", "(b)", "十一、", "(c)"]


def test_style_cycles_end(spark):
    s = spark.createDataFrame([(1, "a", None, "b"), (1, "b", None, "a"), (1, "c", "2", None), (1, "d", None, "c"), (1, "e", "x", "none")], "doc_id long, style_id string, outline string, based_on string")
    assert {r.style_id: r.style_outline for r in B.resolve_style_outline(s).collect()} == {"a": None, "b": None, "c": 2, "d": 2, "e": None}


def test_long_style_chains_resolve(spark):
    rows = [(1, f"s{i}", None if i else "3", f"s{i - 1}" if i else None) for i in range(70)]
    s = spark.createDataFrame(rows, "doc_id long, style_id string, outline string, based_on string")
    assert {r.style_outline for r in B.resolve_style_outline(s).collect()} == {3}


def test_deep_runs_have_a_depth(spark):
    rows = [(i, i - 1 if i else None, 1.0, "bad" if i == 3 else None) for i in range(40)] + [(100, 101, 1.0, None), (101, 100, 1.0, None), (200, 999, 1.0, None), (201, 200, 1.0, None)]
    out = {r.run_id: r for r in H.span_tree(spark.createDataFrame(rows, "run_id long, parent_id long, duration double, error string")).collect()}
    assert [out[i].depth for i in range(40)] == list(range(40))
    assert all(out[i].depth is None for i in (100, 101, 200, 201))
    assert out[3].failed and not out[4].failed and out[5].self == 0.0


def test_large_table_headers(spark):
    def chunks(head, *rows):
        df = spark.createDataFrame([(1, 1, i + 1, w) for i, w in enumerate([head, *rows])], "doc_id long, table_id long, row int, tokens int")
        return [(r.first_row, r.last_row) for r in D.split_large_tables(df, 20, 18).orderBy("chunk").collect()]

    assert chunks(10, 4, 4, 4) == [(2, 3), (4, 4)]
    assert chunks(19, 1, 1) == [(2, 2), (3, 3)]
    assert chunks(40, 1, 1) == [(2, 2), (3, 3)]
    assert chunks(30) == [(2, 2)]


def test_log_values(spark):
    line = '2026-01-02 03:04:05,678 - api - ERROR - run_failed a=1 a=2 n=null q="x \\"y\\" = z" j={"k":["v w"]} e='
    r = A.parse_event_log(spark.createDataFrame([(line,), ("no log",)], "value string")).first()
    assert r.fields == {"a": "2", "n": None, "q": 'x "y" = z', "j": '{"k":["v w"]}', "e": ""}


def test_task_files(spark, tmp_path):
    for at, text in {"api/t1": '{"task_id": "t1", "client_dir": "api", "status": "done"}', "api/t2": '{"task_id": "t1", "client_dir": "api"}', "web/x/t3": '{\n"task_id": "t3", "client_dir": "web/x"}', "web/x/t4": "{broken", "else/t5": '{"task_id": "t5", "client_dir": "else"}'}.items():
        (tmp_path / at).mkdir(parents=True)
        (tmp_path / at / "task.json").write_text(text)
    assert sorted((r.task_id, r.status) for r in A.scan_tasks(spark, f"file://{tmp_path}").collect()) == [("t1", "done"), ("t3", None)]


def test_files(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    for name, data in {"a.docx": b"a", "~$a.docx": b"x", "in/b.docx": b"b", "c.txt": b"c"}.items():
        (tmp_path / name).write_bytes(data)
    found = A.fingerprint(A.discover_files(spark, str(tmp_path))).collect()
    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in found} == {"a.docx": hashlib.sha256(b"a").hexdigest(), "b.docx": hashlib.sha256(b"b").hexdigest()}


def test_nothing_is_left_of_merges_without_required(spark):
    rows = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 2), (2, 0, 1, 1), (2, 0, 2, 3), (3, 0, 1, 1)], "doc_id long, batch int, pos int, level int")
    need = spark.createDataFrame([(1, 2)], "doc_id long, pos int")
    assert {(r.doc_id, r.pos) for r in D.merge_batches(rows, required=need).collect()} == {(1, 1), (1, 2)}
    assert D.merge_batches(rows, required=spark.createDataFrame([(1, 9)], "doc_id long, pos int")).where("doc_id = 1").count() == 0


def test_silent_workers_raise_alerts(spark, tmp_path):
    from foliant.streaming import events as S

    rows = [(1, 1, "2026-01-01 00:00:00"), (2, 1, "2026-01-01 00:00:10"), (3, 1, "2026-01-01 00:05:00"), (4, 2, "2026-01-01 00:00:00"), (5, 3, "2026-01-05 00:00:00")]
    spark.createDataFrame(rows, "event_id long, worker long, t string").selectExpr("event_id", "worker", "CAST(t AS TIMESTAMP) AS ts").coalesce(1).write.parquet(f"{tmp_path}/beats")
    beats = spark.readStream.schema("event_id long, worker long, ts timestamp").parquet(f"{tmp_path}/beats")
    out = S.run_available(S.heartbeat_alerts(beats, 60.0), "append", "alerts").collect()
    assert sorted((r.worker, r.kind) for r in out) == [(1, "gap"), (1, "silent"), (2, "silent")]


def test_greedy_rules(spark):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate([0, 9, 1, 5, 5, 1])], "k long, pos int, w int")
    fold = lambda **a: [r.batch for r in greedy_batches(df, ["k"], "pos", "w", 6, **a).orderBy("pos").collect()]
    assert fold() == [1, 2, 3, 3, 4, 4]
    assert fold(flush_empty=False) == [1, 1, 2, 2, 3, 3]
    assert fold(max_items=1) == [1, 2, 3, 4, 5, 6]


def test_greedy_beside_a_plain_fold(spark):
    r = random.Random(4)
    for flush in (True, False):
        for most in (None, 3):
            rows = [(k, i, r.choice([0, 0, 1, 3, 7, 20])) for k in range(30) for i in range(r.randrange(1, 25))]
            want = {}
            for k in range(30):
                used, n, batch = 0, 0, 1
                for _, i, w in sorted(x for x in rows if x[0] == k):
                    full = used + w > 9 or (most is not None and n >= most)
                    if full and (n > 0 if flush else used > 0):
                        used, n, batch = 0, 0, batch + 1
                    used, n = used + w, n + 1
                    want[k, i] = batch
            got = greedy_batches(spark.createDataFrame(rows, "k long, pos int, w int"), ["k"], "pos", "w", 9, max_items=most, flush_empty=flush)
            if flush or most is None:
                assert {(x.k, x.pos): x.batch for x in got.collect()} == want


def test_merged_cells(spark):
    rows = [(1, 1, 1, 1, 1, 0, 2, None, "ab"), (1, 1, 1, 2, 1, 0, 1, "restart", "c"), (1, 1, 2, 1, 1, 0, 1, None, "d"), (1, 1, 2, 2, 1, 0, 1, None, "e"), (1, 1, 2, 3, 1, 0, 1, "continue", "")]
    c = spark.createDataFrame(rows, "doc_id long, table_id int, row int, cell_no int, para_no int, grid_before int, grid_span int, vmerge string, text string")
    grid = {(r.row, r.col): (r.slot, r.origin_row, r.origin_col) for r in B.restore_grid(c).collect()}
    assert grid[1, 1] == ("horizontal_inherited", 1, 0)
    assert grid[2, 2] == ("vertical_inherited", 1, 2)
    cells = B.render_cells(B.logical_cells(B.restore_grid(c), B.source_refs(c)))
    rows = B.render_rows(cells)
    assert [r.markdown for r in rows.orderBy("row").collect()] == ["| ab [S0001] | ↳同左S0001 | c [S0002] | \n", "| d [S0003] | e [S0004] | ↳同上S0002 | \n"]
    whole = B.render_tables(rows).first().markdown
    assert whole == "<!-- table_id: 1 -->\n| ab [S0001] | ↳同左S0001 | c [S0002] | \n| --- | --- | --- |\n| d [S0003] | e [S0004] | ↳同上S0002 | \n"
    assert {(r.row, r.col): whole[r.md_start : r.md_end] for r in cells.collect()} == {(1, 0): "ab [S0001]", (1, 1): "↳同左S0001", (1, 2): "c [S0002]", (2, 0): "d [S0003]", (2, 1): "e [S0004]", (2, 2): "↳同上S0002"}
    spans = B.markdown_spans(cells).collect()
    assert {(r.source_ref, whole[r.md_start : r.md_end]) for r in spans if not r.synthetic} == {("S0001", "ab"), ("S0002", "c"), ("S0003", "d"), ("S0004", "e")}
    assert sorted(r.source_ref for r in spans if r.synthetic) == ["S0001", "S0002"]
    b = spark.createDataFrame([(1, 1, "tbl", ""), (1, 2, "p", " end ")], "doc_id long, pos int, kind string, text string")
    paths = [(r.path, r.text) for r in B.path_anchors(b, B.restore_grid(c), c).orderBy("pos", "place").collect()]
    assert paths == [("path:body/tbl1/r1c1/p1", "ab"), ("path:body/tbl1/r1c3/p1", "c"), ("path:body/tbl1/r2c1/p1", "d"), ("path:body/tbl1/r2c2/p1", "e"), ("path:body/tbl1", "ab\nc\nd\ne"), ("path:body/p2", "end")]


def test_several_paragraphs_in_a_cell(spark):
    rows = [(1, 1, 1, 1, 1, 0, 1, None, "a|b"), (1, 1, 1, 1, 2, 0, 1, None, "c\\d\ne"), (1, 1, 1, 2, 1, 1, 1, None, "")]
    c = spark.createDataFrame(rows, "doc_id long, table_id int, row int, cell_no int, para_no int, grid_before int, grid_span int, vmerge string, text string")
    cells = B.render_cells(B.logical_cells(B.restore_grid(c), B.source_refs(c)))
    whole = B.render_tables(B.render_rows(cells)).first().markdown
    assert "a\\|b [S0001]<br>c\\\\d<br>e [S0002]" in whole
    assert [whole[r.md_start : r.md_end] for r in B.markdown_spans(cells).orderBy("source_ref").collect()] == ["a\\|b", "c\\\\d<br>e"]


def test_normal_form(spark):
    df = spark.createDataFrame([("ﬁ １２　“x”​",), (None,), ("",)], "text string")
    assert [r.t for r in df.select(T.normalize_text(F.col("text")).alias("t")).collect()] == ['fi12"x"', None, ""]


@pytest.mark.parametrize(("raw", "ok"), [('x ```json\n{"a": 1}\n```', True), ('{"a": "b\tc"}', True), ('{"a": "b\x01c"}', False), ("{bad", False), (None, False)])
def test_json(spark, raw, ok):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert (df.select(R.extract_json(F.col("raw")).alias("v")).first().v is not None) == ok


def test_percentile(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    assert tuple(df.agg(G.percentile(F.col("x"), 0.5), G.percentile(F.col("x"), 0.95)).first()) == (2.5, 3.85)
    assert df.where("x > 9").agg(G.percentile(F.col("x"), 0.5)).first()[0] is None


def test_gram_share_in_chunks(spark, monkeypatch):
    """Beside all pairs in columns, chunks of a few notes give the same best predictions."""
    monkeypatch.setattr(G, "CHUNK", 150)
    rng = random.Random(5)
    text = lambda most: None if rng.random() < 0.1 else "".join(rng.choices("ab\u4e2d\U0001f600", k=rng.randint(0, most)))
    rows = lambda n: [(rng.choice([1, 2, 3, None]), i, text(6), text(25)) for i in range(n)]
    human = spark.createDataFrame([*rows(60), (9, 1, "abc", "abcd")], "doc_id long, human_no int, clause string, point string")
    said = spark.createDataFrame([*rows(60), (1, None, "aaa", "aaaa")], "doc_id long, predicted_no int, clause string, point string")
    fast = G.match_annotations(human, said, 0.2, 0.15, G.gram_share)
    slow = G.match_annotations(human, said, 0.2, 0.15, lambda a, b: G.gram_share(a, b))
    assert fast.schema == slow.schema
    key = lambda r: (str(r.doc_id), r.human_no)
    assert sorted(fast.collect(), key=key) == sorted(slow.collect(), key=key)


def test_literal_terms(spark):
    df = spark.createDataFrame([('find "late fee"：price、是否the、payment terms。采购单位；承包人',)], "q string")
    assert df.select(E.literal_terms(F.col("q"), F.array(F.lit(" plan "), F.lit("x"))).alias("t")).first().t == ["payment terms", "late fee", "price", "plan", "采购单位", "承包人", "承包", "采购"]


def test_words_of_a_join(spark):
    df = spark.createDataFrame([("合同金额大小写是否一致", ["a"], ["见 履行期限 x"])], "q string, terms array<string>, slots array<string>")
    out = set(df.select(E.join_words(F.col("terms"), F.col("slots"), F.col("q")).alias("t")).first().t)
    assert {"a", "履行期限", "合同金额", "人民币", "大写"} <= out and "发票" not in out


def test_block_ratio(spark):
    rows = [(1, 1, "甲方应付款", "abcd"), (1, 2, "", "")]
    human = spark.createDataFrame(rows, "doc_id long, human_no int, clause string, point string")
    said = spark.createDataFrame([(1, 7, "甲方付款", "bcde"), (1, 8, "zz", "zz")], "doc_id long, predicted_no int, clause string, point string")
    out = {r.human_no: r for r in G.match_annotations(human, said).collect()}
    assert out[1].predicted_no == 7 and out[1].match == round(0.35 * 8 / 9 + 0.65 * 0.75, 6) and out[1].status == "hit"
    assert (out[2].match, out[2].status) == (0.0, "miss")


def test_scores_at_k(spark):
    gold = spark.createDataFrame([("c", 1, "有效期为三年", "anchor=P_5"), ("d", 1, "abcdef", "none"), ("e", 1, "", "")], "case_id string, row_number int, text string, notes string")
    got = spark.createDataFrame([("c", 1, "xx", "p_1", "p_2"), ("c", 2, "本合同有效期为三年。", "tbl_1", "tbl_1"), ("c", 3, "y", "p_4", "p_9"), ("d", 1, "abcd", "p_1", "p_1")], "case_id string, rank int, text string, start_anchor string, end_anchor string")
    out = {r.case_id: r for r in G.score_at_k(gold, got).collect()}
    assert (out["c"].coverage_at_1, out["c"].coverage_at_3, out["c"].anchor_hit_at_1, out["c"].anchor_hit_at_3, out["c"].hit_at_1, out["c"].hit) == (0.0, 1.0, 0, 1, 0, 1)
    assert (out["d"].coverage, out["d"].hit) == (0.5, 0)
    assert (out["e"].coverage, out["e"].anchor_hit, out["e"].hit) == (0.0, 0, 0)


def test_chunks_repeat_and_break_at_sentences(spark):
    text = "One two three. " * 20 + "\n\n" + "End."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    out = E.chunk_text(df, 20, 5).orderBy("chunk").collect()
    assert {r.doc_id for r in out} == {1}
    assert all(r.text.startswith(("One", "End")) for r in out)
    assert all(b.start_pos <= a.end_pos for a, b in zip(out, out[1:], strict=False)) and out[-1].text.endswith("End.")


def test_summaries_are_cut_by_tokens(spark):
    df = spark.createDataFrame([("合" * 1000,), ("short",), ("word " * 400,)], "t string")
    out = [r.t for r in df.select(T.truncate(F.col("t"), 200, 120).alias("t")).collect()]
    assert [len(x) for x in out] == [320, 5, 799] and not out[2].endswith(" ")


def test_table_evidence(spark):
    q = spark.createDataFrame([(1, 1, 1, "925129", None), (1, 1, 2, "重复", None), (1, 1, 3, "925129", "S0002"), (1, 1, 4, "９２５ １２９ 元", None), (1, 1, 5, "x", "S0009"), (1, 1, 6, " ", None)], "doc_id long, table_id long, quote_id int, quote string, source_ref string")
    s = spark.createDataFrame([(1, 1, "S0001", "925129元"), (1, 1, "S0002", "重复"), (1, 1, "S0003", "重复值")], "doc_id long, table_id long, source_ref string, text string")
    out = {r.quote_id: (r.status, r.resolved, r.matched_text) for r in R.resolve_table_evidence(q, s).collect()}
    assert out == {1: ("matched", "S0001", "925129"), 2: ("ambiguous", None, None), 3: ("source_mismatch", None, None), 4: ("matched", "S0001", "925129元"), 5: ("not_found", None, None), 6: ("not_found", None, None)}


def test_overlapping_batches_progress(spark):
    df = spark.createDataFrame([(1, i, 10) for i in range(6)], "doc_id long, pos int, w int")
    assert [(r.start_pos, r.end_pos) for r in D.batch_with_overlap(df, 30, 10).orderBy("batch").collect()] == [(0, 2), (2, 4), (4, 5)]


def test_sanitize(spark):
    df = spark.createDataFrame([("a\\b/c d?.txt",), ("...",)], "n string")
    assert [r.x for r in df.select(A.sanitize_name(F.col("n")).alias("x")).collect()] == ["c_d_.txt", "file"]


def test_batches_merge_on_one_scale(spark):
    rows = [(1, 0, 1, 1), (1, 0, 2, 2), (1, 0, 3, 2), (1, 1, 2, 1), (1, 1, 3, 1), (1, 1, 4, 2), (1, 2, 4, 6), (1, 2, 5, 1), (2, 5, 9, 8)]
    df = spark.createDataFrame(rows, "doc_id long, batch int, pos int, level int")
    assert {(r.doc_id, r.pos): r.level for r in D.merge_batches(df).collect()} == {(1, 1): 1, (1, 2): 2, (1, 3): 2, (1, 4): 3, (1, 5): 1, (2, 9): 6}


def test_empty_tables(spark):
    nodes = spark.createDataFrame([], "doc_id long, node_id string, parent_id string, pos int, level int, title string, tokens int")
    assert D.split_structure(nodes, 10).count() == 0
    assert E.structure_summary(nodes).count() == 0


def test_vectors_of_all_kinds(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [1.0, 0.1]), (1, 3, [0.0, 0.0]), (1, 4, None), (1, 5, [1.0]), (1, 6, [-1.0, 0.0]), (2, 7, [1.0, 0.0])], "doc_id long, node_id long, embedding array<double>")
    q = spark.createDataFrame([(9, 1, [2.0, 0.0]), (8, 3, [1.0, 0.0]), (7, 1, None)], "query_id long, doc_id long, vector array<double>")
    out = E.vector_search(q, v, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.node_id) for r in out] == [(7, 1), (7, 2), (7, 3), (7, 4), (7, 5), (9, 1), (9, 2), (9, 3), (9, 4), (9, 5)]
    assert out[5].score == 1.0 and [r.score for r in out[:5]] == [0.0] * 5


def test_vector_entries_hold_whole_texts(spark):
    rows = [(1, f"n{i}", "t", "s", "x" * 9000 + end) for i, end in enumerate(["a", "b"])] + [(1, "n2", "t", "s", " ")]
    out = E.vector_entries(spark.createDataFrame(rows, "doc_id long, node_id string, title string, summary string, text string")).collect()
    assert sorted(r.entry[-1] for r in out) == ["a", "b"]
    assert len({r.text_hash for r in out}) == 2


def test_best_predictions_equal_all_pairs_with_few_compared(spark):
    from difflib import SequenceMatcher

    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(r.randrange(n)))
    near = lambda x: x.replace("a", "", 1) + r.choice(words)
    said = [(i, text(8), text(40)) for i in range(60)] + [(60, "", ""), (61, "same clause", "same point"), (62, "same clause", "same point")]
    ratio = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 0.0
    compared = 0
    for clause, point in [("same clause", "same point"), ("", ""), *((near(c), near(p)) for _, c, p in said[:40])]:
        no, match, n = G.best_prediction(clause, point, said)
        want = min((-round(0.35 * ratio(clause, c) + 0.65 * ratio(point, p), 6), i) for i, c, p in said)
        assert (no, match) == (want[1], -want[0])
        compared += n
    assert compared < 0.1 * 42 * len(said)
    assert G.best_prediction("x", "y", []) is None


def test_annotations_without_predictions(spark):
    human = spark.createDataFrame([(1, 1, "a clause", "a point"), (2, 5, None, "b")], "doc_id long, human_no int, clause string, point string")
    said = spark.createDataFrame([(1, 7, "a clause", "a pint"), (1, 3, None, None)], "doc_id long, predicted_no int, clause string, point string")
    out = {r.doc_id: (r.predicted_no, r.status) for r in G.match_annotations(human, said).collect()}
    assert out == {1: (7, "hit"), 2: (None, "miss")}


def test_percentiles_of_a_hot_contract(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 100 = 0 THEN 'cold' WHEN id % 991 = 0 THEN NULL ELSE 'hot' END AS c", "CASE WHEN id % 7 <> 0 THEN CAST(id * 7919 % 1000 AS DOUBLE) / 3 END AS x")
    got = {r.c: (r.p50, r.p95) for r in G.contract_metrics(df, "c", "x").collect()}
    want = {r.c: (r.a, r.b) for r in df.groupBy("c").agg(G.percentile(F.col("x"), 0.5).alias("a"), G.percentile(F.col("x"), 0.95).alias("b")).collect()}
    assert got == want


def test_styles_in_a_long_chain_and_cycles(spark):
    n = 2000
    rows = [(1, f"s{i}", None if i else "3", f"s{i - 1}" if i else None) for i in range(n)] + [(2, "a", None, "b"), (2, "b", None, "a"), (3, "x", "no", "gone"), (3, "y", "5", "x")]
    df = spark.createDataFrame(rows, "doc_id long, style_id string, outline string, based_on string")
    out = {(r.doc_id, r.style_id): r.style_outline for r in B.resolve_style_outline(df).collect()}
    assert len(out) == len(rows) and all(out[1, f"s{i}"] == 3 for i in range(n))
    assert [out[k] for k in ((2, "a"), (2, "b"), (3, "x"), (3, "y"))] == [None, None, None, 5]


def test_time_above_caps_goes_on_across_hours(spark):
    rows = [("a", "2026-01-01 00:50:00", "2026-01-01 00:59:59"), ("a", "2026-01-01 00:55:00", "2026-01-01 01:05:00"), ("a", "2026-01-01 00:59:59", "2026-01-01 01:02:00"), ("b", "2026-01-01 00:00:00", None), ("b", "2026-01-01 00:09:00", "2026-01-01 00:09:00"), ("c", "2026-01-01 00:00:00", None)]
    calls = spark.createDataFrame(rows, "kind string, start string, end string").selectExpr("kind", "CAST(start AS TIMESTAMP) AS start", "CAST(end AS TIMESTAMP) AS end")
    caps = spark.createDataFrame([("a", 1), ("b", 0)], "kind string, cap int")
    got = sorted((r.kind, r.start % 86400, r.seconds, r.most) for r in H.time_above(calls, caps).collect())
    assert got == [("a", 3300.0, 420.0, 2), ("b", 0.0, 600.0, 1)]


def test_subtrees_fill_pages(spark):
    nodes = spark.createDataFrame([(1, "b/a", "b", 1, 5), (1, "b/a/x", "b/a", 2, 4), (1, "b/a/y", "b/a", 3, 9), (1, "b/c", "b", 4, 3), (1, "b/ab", "b", 5, 2)], "doc_id long, node_id string, parent_id string, pos int, tokens int")
    assert sorted((r.parent_id, r.node_id, r.page) for r in D.split_structure(nodes, 12).collect()) == [("b", "b/ab", 1), ("b", "b/c", 1), ("b/a", "b/a/x", 1), ("b/a", "b/a/y", 2)]


def test_clients_without_an_id(spark):
    import hashlib

    clients = spark.createDataFrame([(None, hashlib.sha256(b"k1").hexdigest(), True), (5, hashlib.sha256(b"k2").hexdigest(), True)], "client_id long, fingerprint string, enabled boolean")
    out = {r.request_id: (r.outcome, r.client_id) for r in H.client_lookup(spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k3"), (4, " ")], "request_id int, key string"), clients).collect()}
    assert out == {1: ("incomplete", None), 2: ("ok", 5), 3: ("unknown", None), 4: ("missing", None)}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_coverage_beside_counters(spark, monkeypatch, n):
    monkeypatch.setattr(G, "BLOCK", 7)
    rng = random.Random(n)
    text = lambda most: "".join(rng.choices("ab\u4e2d\U0001f600 ", k=rng.randint(0, most)))
    gold = [(i, text(30)) for i in range(60)]
    nodes = [(i, text(40) if rng.random() < 0.9 else None) for i, _ in gold for _ in range(rng.randint(0, 4))] + [(0, gold[0][1] + "b")]
    grams = lambda x: Counter([x[k : k + n] for k in range(len(x) - n + 1)] if len(x) >= n else [x] if x else [])
    want = {}
    for i, x in gold:
        own = [y or "" for j, y in nodes if i == j]
        have = sum((grams(y) for y in own), Counter())
        want[i] = 0.0 if not x else 1.0 if any(x in y for y in own) else sum((grams(x) & have).values()) / sum(grams(x).values())
    frame = lambda rows: spark.createDataFrame(rows, "case_id int, text string")
    assert {r.case_id: r.coverage for r in G.evidence_coverage(frame(gold), frame(nodes), n).collect()} == pytest.approx(want)


def test_coverage_in_slices(monkeypatch):
    """Workers turn few characters into strings at a time; slices give what single rows do."""
    import pyarrow as pa
    from pyspark.sql import types as T

    monkeypatch.setattr(G, "SLICE", 50)
    rng = random.Random(3)
    text = lambda: rng.choice([None, ""]) if rng.random() < 0.2 else "".join(rng.choices("ab中", k=rng.randint(1, 90)))
    golds, nodes = [text() for _ in range(80)], [None if rng.random() < 0.1 else [text() for _ in range(rng.randint(0, 3))] for _ in range(80)]

    class Rows:
        columns = ["text", "_nodes"]
        schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("_nodes", T.ArrayType(T.StringType()))])

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(golds, pa.string()), pa.array(nodes, pa.list_(pa.string()))], names=Rows.columns).slice(5)
    out = list(G._covered(Rows(), 3, (1, 2))(iter([batch])))
    assert len(out) > 20
    assert [x for b in out for x in b.column("_c").to_pylist()] == [G._coverage(x, [y or "" for y in own or []], 3, (1, 2)) for x, own in zip(golds[5:], nodes[5:], strict=True)]


def test_normal_form_composes(spark):
    from unicodedata import normalize

    from foliant.functions.text import nfkc

    rows = [None, "", "éＡ 한", "가éﬁ"] + [chr(i) * 2 for i in range(0xC0, 0x400)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", nfkc("x").alias("y")).collect()
    assert {r.i: r.y for r in got} == {i: x and normalize("NFKC", x) for i, x in enumerate(rows)}


def test_matching_blocks_as_arrays():
    import time
    from difflib import SequenceMatcher

    r = random.Random(21)
    plain = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 0.0
    for letters in ("a", "ab", "abc é\ud800😀", "abcdefghijklmnop qrstuvwxyz"):
        for _ in range(60):
            a, b = ("".join(r.choice(letters) for _ in range(r.randrange(1, 160))) for _ in "ab")
            b = r.choice([b, b + a, a[: len(a) // 2] + b[:9] + a[len(a) // 2 :], a])
            assert 2.0 * G.matching(a, b) / (len(a) + len(b)) == plain(a, b) == G.block_ratio(a, b)
            assert G.block_ratio(b, a) == plain(b, a)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    pairs = [tuple(" ".join(r.choice(words) for _ in range(n)) for n in (40, 190)) for _ in range(15)]
    took = []
    for f in (plain, G.block_ratio):
        began = time.process_time()
        found = [f(a, b) for a, b in pairs]
        took.append((time.process_time() - began, found))
    assert took[0][1] == took[1][1]
    assert took[1][0] < took[0][0] / 2


def test_notes_are_compared_by_many_tasks(spark):
    rows = spark.range(3 * G.NOTES).selectExpr("id AS doc_id", "1 AS human_no", "1 AS predicted_no", "'a clause' AS clause", "concat('point ', id) AS point")
    out = G.match_annotations(rows.drop("predicted_no"), rows.drop("human_no"))
    out.collect()
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("status = 'hit' AND match = 1").count() == 3 * G.NOTES


def test_visible_text_shuffles_no_pairs(spark):
    rows = [(1, 1, 2, "b"), (1, 1, 0, " a"), (1, 1, 1, None), (1, 1, 10, "c "), (2, 1, None, "x"), (2, 1, 0, "y"), (3, 1, 0, None)]
    for kind in ("int", "long"):
        out = B.visible_text(spark.createDataFrame(rows, f"doc_id long, pos int, run_no {kind}, text string").repartition(3))
        assert {r.doc_id: r.text for r in out.collect()} == {1: "abc", 2: "xy", 3: ""}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "collect_list(struct" not in plan and "collect_list(named_struct" not in plan


def test_tasks_grow_with_rows_of_tables(spark, monkeypatch):
    from foliant.sources import spread

    rows = spark.range(600).selectExpr("id % 30 AS doc_id", "1 AS table_id", "CAST(id AS INT) AS row", "4 AS tokens", "1 AS columns", "concat('| ', id, ' |\n') AS text")
    want = sorted(map(tuple, D.split_large_tables(rows, 20, 18).collect()))
    monkeypatch.setattr(spread, "ROWS", 60)
    out = D.split_large_tables(rows, 20, 18)
    plan = out._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and spread.spread(rows, ["doc_id"]).rdd.getNumPartitions() == 10
    assert sorted(map(tuple, out.collect())) == want and len(want) > 30
