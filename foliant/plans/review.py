"""Queries over review results."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import review as R
from foliant.plans.adapt import BLOCKS, CELLS, RUNS, blocks, cells, runs, table
from foliant.plans.blocks import NUMBERED, numbered


def anchored_blocks(s, d):
    return blocks(s, d).select("doc_id", "pos", F.concat(F.lit("p"), F.floor((F.col("pos") - 1) / 2).cast("string")).alias("anchor"), "text")


def quotes(s, d):
    """A quote for each block: from its own text, from nowhere, or on no anchor."""
    b = anchored_blocks(s, d)
    return b.selectExpr("doc_id", "pos AS quote_id", "CASE WHEN pos % 5 = 4 THEN 'none' ELSE anchor END AS anchor", "CASE WHEN pos % 3 = 2 THEN '@@@' ELSE concat(' ', substring(text, 3, 12)) END AS quote")


QUOTES = BLOCKS + """, ab AS (SELECT doc_id, pos, 'p' || (pos - 1) // 2 AS anchor, text FROM blocks),
quotes AS (SELECT doc_id, pos AS quote_id, CASE WHEN pos % 5 = 4 THEN 'none' ELSE anchor END AS anchor, trim(CASE WHEN pos % 3 = 2 THEN '@@@' ELSE ' ' || substr(text, 3, 12) END, ' ') AS q FROM ab),
hit AS (SELECT quotes.doc_id, quote_id, quotes.anchor, q, ab.pos, CASE WHEN q <> '' AND strpos(text, q) > 0 THEN strpos(text, q) END AS spot FROM quotes LEFT JOIN ab ON ab.doc_id = quotes.doc_id AND ab.anchor = quotes.anchor),
anchored AS (SELECT doc_id, quote_id, anchor, q, min(CASE WHEN spot IS NOT NULL THEN pos * 100000 + spot END) AS b, bool_or(pos IS NOT NULL) AS known FROM hit GROUP BY ALL),
spans AS (SELECT doc_id, quote_id, anchor, CAST(b // 100000 AS INT) AS pos, CAST(b % 100000 - 1 AS INT) AS start, CAST(b % 100000 - 1 + length(q) AS INT) AS "end", CASE WHEN b IS NOT NULL THEN 'anchored' WHEN known THEN 'missing_text_fallback' ELSE 'unmatched' END AS status FROM anchored)"""


def reviews(s, d):
    t = table(s, d, "orders")
    return t.selectExpr(
        "o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN 'compliant' WHEN 'O' THEN 'issues_found' WHEN 'P' THEN 'not_applicable' ELSE o_orderstatus END AS status",
        "CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE repeat('c', CAST(o_orderkey % 120 AS INT) + 1) END AS comment", "CASE WHEN o_orderkey % 3 = 0 THEN 'r' END AS reason",
        "CAST(o_orderkey % 3 AS INT) AS n_issues", "CAST(o_orderkey % 200 AS INT) AS longest_issue", "CASE WHEN o_orderkey % 7 = 0 THEN array('status', 'note') ELSE array('issues', 'status') END AS fields",
    )


REVIEWS = "r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'compliant' WHEN 'O' THEN 'issues_found' WHEN 'P' THEN 'not_applicable' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE repeat('c', CAST(o_orderkey % 120 AS INT) + 1) END AS comment, CASE WHEN o_orderkey % 3 = 0 THEN 'r' END AS reason, o_orderkey % 3 AS n, o_orderkey % 200 AS l FROM orders)"


def plan(s, d):
    return table(s, d, "lineitem").selectExpr("l_orderkey AS task_id", "l_linenumber AS criterion_id").distinct()


def results(s, d):
    t = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("criterion_id")).agg(F.min("l_returnflag").alias("status"), F.sum(F.col("l_quantity").cast("long")).alias("tokens"))
    return t.where("criterion_id % 3 <> 0")


RESULTS = "results AS (SELECT l_orderkey AS task_id, l_linenumber AS criterion_id, min(l_returnflag) AS status, sum(CAST(l_quantity AS BIGINT)) AS tokens FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY ALL)"


def criterion_states(s, d):
    return table(s, d, "events").selectExpr("user_id AS task_id", "concat(CASE WHEN event_id % 11 = 0 THEN ' a/' ELSE '' END, event_id % 5) AS criterion_id", "CASE event_type WHEN 'click' THEN 'input' WHEN 'view' THEN 'output' WHEN 'error' THEN 'error' ELSE 'x' END AS kind", "ts AS saved_at", "event_id AS attempt", "event_id AS payload")


def evidence(s, d):
    return anchored_blocks(s, d).where("pos % 2 = 1").selectExpr("doc_id", "pos % 4 AS criterion_id", "CASE WHEN pos % 9 = 1 THEN 'none' ELSE anchor END AS anchor", "CASE WHEN pos % 3 = 0 THEN substring(text, 2, 9) ELSE '@' END AS quote")


def one_anchor(s, d):
    return anchored_blocks(s, d).where("pos % 2 = 1")


def raw(s, d):
    return table(s, d, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN concat('Text ```json\n', props, '\n``` end') WHEN 1 THEN concat('x ', props, ' y') WHEN 2 THEN concat('x ', substring(props, 1, 5)) ELSE props END AS raw")


Q = {
    "f01_extract_json": (
        lambda s, d: raw(s, d).select("event_id", R.extract_json(F.col("raw")).alias("value")),
        "SELECT event_id, CASE WHEN event_id % 4 <> 2 THEN props END AS value FROM events",
    ),
    "f02_validate_review": (
        lambda s, d: R.validate_review(reviews(s, d)),
        f"WITH {REVIEWS}, v AS (SELECT id, unnest([CASE WHEN status NOT IN ('compliant', 'issues_found', 'not_applicable') THEN 'status' END, CASE WHEN trim(comment, ' ') = '' THEN 'comment_blank' END, CASE WHEN length(comment) > 100 THEN 'comment_long' END, CASE WHEN l > 160 THEN 'issue_long' END,"
        " CASE WHEN status = 'compliant' AND n > 0 THEN 'compliant_with_issues' END, CASE WHEN status = 'issues_found' AND n = 0 THEN 'issues_missing' END, CASE WHEN status = 'not_applicable' AND coalesce(reason, '') = '' THEN 'reason_missing' END, CASE WHEN status = 'not_applicable' AND n > 0 THEN 'not_applicable_with_issues' END, CASE WHEN id % 7 = 0 THEN 'unknown_field' END]) AS rule FROM r) SELECT id, rule FROM v WHERE rule IS NOT NULL",
    ),
    "f03_validate_summary": (
        lambda s, d: R.validate_summary(table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("parts"), F.max("role").alias("overall")).selectExpr("conv_id", "overall", "CASE WHEN conv_id % 5 = 0 THEN array(' ') ELSE parts END AS parts", "CAST(conv_id % 4 AS INT) AS attempt"), 900).select("conv_id", "valid"),
        "SELECT conv_id, conv_id % 5 <> 0 AND (sum(length(text)) + length(max(role)) <= 900 OR conv_id % 4 >= 3) AS valid FROM conversations GROUP BY conv_id",
    ),
    "f03_validate_plan": (
        lambda s, d: R.validate_plan(table(s, d, "nation").selectExpr("n_nationkey AS id").union(s.range(100, 103)), table(s, d, "supplier").selectExpr("s_nationkey AS id", "CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS criterion_id", "s_name AS section", "CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS criterion", "CASE s_suppkey % 4 WHEN 0 THEN array('a', ' ') WHEN 1 THEN array() ELSE array('b') END AS check_points")),
        "WITH c AS (SELECT s_nationkey AS id, s_suppkey AS k FROM supplier) SELECT id, unnest(list_filter([CASE WHEN k % 7 = 0 THEN 'criterion_id_missing' END, CASE WHEN k % 5 = 0 THEN 'criterion_missing' END, CASE WHEN k % 4 = 1 THEN 'check_points_missing' END, CASE WHEN k % 4 = 0 THEN 'check_point_blank' END], lambda x: x IS NOT NULL)) AS rule FROM c"
        " UNION ALL SELECT id, 'criteria_missing' FROM (SELECT n_nationkey AS id FROM nation UNION ALL SELECT unnest(range(100, 103))) WHERE id NOT IN (SELECT id FROM c)",
    ),
    "f03_validate_reflection": (
        lambda s, d: R.validate_reflection(table(s, d, "orders").selectExpr("o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'REJECT' ELSE o_orderstatus END AS status")),
        "SELECT o_orderkey AS id, 'status' AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
    ),
    "f04_pending": (
        lambda s, d: R.pending(plan(s, d), results(s, d), plan(s, d).selectExpr("task_id", "criterion_id", "CAST(task_id % 4 AS INT) AS attempt").where("attempt > 0")),
        f"WITH {RESULTS}, p AS (SELECT DISTINCT l_orderkey AS task_id, l_linenumber AS criterion_id FROM lineitem) SELECT task_id, criterion_id, CAST(task_id % 4 + 1 AS INT) AS attempt FROM p ANTI JOIN results USING (task_id, criterion_id) WHERE task_id % 4 + 1 <= 3",
    ),
    "f05_latest_state": (
        lambda s, d: R.latest_state(criterion_states(s, d)).withColumn("error_history", F.array_join("error_history", ",")),
        "WITH e AS (SELECT user_id AS task_id, CAST(event_id % 5 AS VARCHAR) AS criterion_id, event_type AS k, epoch_us(ts) AS t, event_id FROM events WHERE event_id % 11 <> 0) SELECT task_id, criterion_id, arg_max(event_id, (t, event_id)) FILTER (k = 'click') AS input, arg_max(event_id, (t, event_id)) FILTER (k = 'view') AS output, count(*) FILTER (k = 'error') AS errors, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY t, event_id) FILTER (k = 'error'), '') AS error_history, arg_max(event_id, (t, event_id)) FILTER (k = 'error') AS latest_error FROM e GROUP BY ALL",
    ),
    "f05_invalid_ids": (lambda s, d: R.invalid_ids(criterion_states(s, d)), "SELECT DISTINCT user_id AS task_id, ' a/' || event_id % 5 AS criterion_id FROM events WHERE event_id % 11 = 0"),
    "f06_combine_results": (
        lambda s, d: R.combine_results(plan(s, d), results(s, d).withColumn("error", F.when(F.col("status") == "ERROR", F.concat(F.lit("e"), F.col("tokens").cast("string"))))),
        f"WITH {RESULTS}, p AS (SELECT DISTINCT l_orderkey AS task_id, l_linenumber AS criterion_id FROM lineitem), j AS (SELECT p.*, coalesce(status, 'ERROR') AS st, tokens FROM p LEFT JOIN results USING (task_id, criterion_id)) SELECT task_id, string_agg(st, ',' ORDER BY criterion_id) AS statuses, bool_or(st = 'ERROR') AS failed, coalesce(string_agg(criterion_id || ': missing', '; ' ORDER BY criterion_id) FILTER (st = 'ERROR'), '') AS error_message, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens FROM j GROUP BY task_id",
    ),
    "f07_anchor_quotes": (lambda s, d: R.anchor_quotes(quotes(s, d), anchored_blocks(s, d)), f"WITH {QUOTES} SELECT * FROM spans"),
    "f08_anchor_stats": (
        lambda s, d: R.anchor_stats(R.anchor_quotes(quotes(s, d), anchored_blocks(s, d))),
        f"WITH {QUOTES} SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'anchored') AS anchored, count(*) FILTER (status = 'missing_text_fallback') AS missing_text_fallback, count(*) FILTER (status = 'unmatched') AS unmatched FROM spans GROUP BY doc_id",
    ),
    "f09_run_ranges": (
        lambda s, d: R.run_ranges(blocks(s, d).selectExpr("doc_id", "pos", "3 AS start", "12 AS end"), runs(s, d)),
        f"WITH {RUNS}, r AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id, pos ORDER BY run_no) AS z FROM runs) SELECT doc_id, pos, run_no, CAST(greatest(3, z - length(text)) - (z - length(text)) AS BIGINT) AS start, CAST(least(12, z) - (z - length(text)) AS BIGINT) AS \"end\" FROM r WHERE z - length(text) < 12 AND z > 3",
    ),
    "f10_table_evidence": (
        lambda s, d: R.resolve_table_evidence(
            cells(s, d).where("row = 1").selectExpr("doc_id", "table_id", "cell_no AS quote_id", "CASE WHEN cell_no = 1 THEN concat(' ', substring(text, 1, 1), ' ', substring(text, 2, 99)) ELSE text END AS quote", "CASE WHEN cell_no = 2 THEN 'S0002' WHEN cell_no = 3 AND doc_id % 2 = 0 THEN 'S0001' END AS source_ref"),
            cells(s, d).selectExpr("doc_id", "table_id", "concat('S', lpad(CAST((row - 1) * 3 + cell_no AS STRING), 4, '0')) AS source_ref", "text"),
        ).select("doc_id", "table_id", "quote_id", "status", "resolved", "matched_text", F.array_join("candidates", ",").alias("candidates")),
        f"WITH {CELLS}, q AS (SELECT doc_id, table_id, cell_no AS quote_id, trim(CASE WHEN cell_no = 1 THEN ' ' || substr(text, 1, 1) || ' ' || substr(text, 2, 99) ELSE text END, ' ') AS t, CASE WHEN cell_no = 2 THEN 'S0002' WHEN cell_no = 3 AND doc_id % 2 = 0 THEN 'S0001' END AS ref FROM cells WHERE row = 1),"
        " s AS (SELECT doc_id, table_id, 'S' || lpad(CAST((row - 1) * 3 + cell_no AS VARCHAR), 4, '0') AS r, text AS x FROM cells),"
        " p AS (SELECT q.doc_id, q.table_id, quote_id, ref, r, t, x, t <> '' AND contains(x, t) AS exact, replace(t, ' ', '') <> '' AND replace(t, ' ', '') = replace(x, ' ', '') AS equal FROM q JOIN s USING (doc_id, table_id)),"
        " e AS (SELECT doc_id, table_id, quote_id, ref, coalesce(bool_or(r = ref), false) AS ex, max(CASE WHEN exact THEN t ELSE x END) FILTER (r = ref AND (exact OR equal)) AS fit, list_sort(list(r) FILTER (exact)) AS a, list_sort(list(r) FILTER (equal)) AS b, min_by(x, r) FILTER (equal) AS bx, any_value(t) AS t FROM p GROUP BY ALL),"
        " g AS (SELECT *, coalesce(a, b, []) AS c, a IS NOT NULL AS by_word FROM e),"
        " z AS (SELECT *, CASE WHEN ref IS NOT NULL AND NOT ex THEN 'not_found' WHEN ref IS NOT NULL AND fit IS NULL THEN 'source_mismatch' WHEN ref IS NOT NULL THEN 'matched' WHEN len(c) = 0 THEN 'not_found' WHEN len(c) > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM g)"
        " SELECT doc_id, table_id, quote_id, status, CASE WHEN status = 'matched' THEN coalesce(ref, c[1]) END AS resolved, CASE WHEN status = 'matched' THEN CASE WHEN ref IS NOT NULL THEN fit WHEN by_word THEN t ELSE bx END END AS matched_text, array_to_string(c, ',') AS candidates FROM z",
    ),
    "f11_comment_text": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", R.comment_text(F.col("o_orderpriority"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string"))).alias("comment")),
        "SELECT o_orderkey, '[' || o_orderpriority || ']' || chr(10) || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'Criterion: ' || o_custkey ELSE '' END AS comment FROM orders",
    ),
    "f11_summary_text": (
        lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(R.summary_text(F.array_sort(F.collect_list("n_name"))).alias("summary")),
        "SELECT n_regionkey, string_agg(i || '. ' || n_name, chr(10) ORDER BY n_name) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) GROUP BY n_regionkey",
    ),
    "f12_flatten_issues": (
        lambda s, d: R.flatten_issues(
            table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_returnflag").alias("criterion_id"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), F.when(F.col("l_linenumber") != 2, F.col("l_linestatus")).alias("risk_level"), F.col("l_partkey").cast("string").alias("issue_comment"), F.array(F.col("l_suppkey")).alias("anchors")))).alias("issues"))
            .withColumns({"section": F.lit("s"), "criterion": F.concat(F.lit("c"), "criterion_id")})
        ).withColumn("anchors", F.col("anchors")[0]),
        "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_linestatus END NULLS FIRST, CAST(l_partkey AS VARCHAR), l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_orderkey AS t FROM lineitem), c AS (SELECT l_orderkey AS t, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY 1) SELECT l_orderkey AS task_id, l_returnflag AS criterion_id, 's' AS section, 'c' || l_returnflag AS criterion, CAST(i AS INT) AS issue_no, CASE WHEN l_linenumber <> 2 THEN l_linestatus ELSE '' END AS risk_level, CAST(l_partkey AS VARCHAR) AS issue_comment, l_suppkey AS anchors, k AS criteria_count, n AS issue_count FROM l JOIN c USING (t)",
    ),
    "f13_missing_evidence": (
        lambda s, d: R.missing_evidence_queries(table(s, d, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_size").alias("issue_no"), F.col("p_name").alias("check_point"), F.col("p_type").alias("criterion"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("anchors"))),
        "SELECT p_partkey AS task_id, p_size AS issue_no, '查找合同中是否约定以下检查要点：' || p_name || chr(10) || '所属审查标准：' || p_type AS query FROM part WHERE p_size % 2 <> 0",
    ),
    "f14_clean_context": (
        lambda s, d: blocks(s, d).select("doc_id", "pos", R.clean_context(F.concat(F.lit("## 检索结果 3 (相关度 0.5)\n[kept]\n"), F.col("text"), F.lit("\n\n\n\nx\n##检索结果1"))).alias("text")),
        f"WITH {BLOCKS} SELECT doc_id, pos, '[kept]' || chr(10) || text || chr(10) || chr(10) || 'x' AS text FROM blocks",
    ),
    "f15_token_stats": (
        lambda s, d: R.token_stats(table(s, d, "events").selectExpr("user_id", "event_type AS phase", "event_id AS tokens"), "user_id", ["click", "view"]),
        "SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN event_id ELSE 0 END) AS BIGINT) AS click, CAST(sum(CASE WHEN event_type = 'view' THEN event_id ELSE 0 END) AS BIGINT) AS view, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY user_id",
    ),
    "f16_validate_annotations": (
        lambda s, d: R.validate_annotations(evidence(s, d), one_anchor(s, d), blocks(s, d).selectExpr("doc_id", "pos % 4 AS criterion_id")),
        f"WITH {BLOCKS}, ab AS (SELECT doc_id, pos, 'p' || (pos - 1) // 2 AS anchor, text FROM blocks WHERE pos % 2 = 1), e AS (SELECT doc_id, pos % 4 AS criterion_id, CASE WHEN pos % 9 = 1 THEN 'none' ELSE anchor END AS anchor, CASE WHEN pos % 3 = 0 THEN substr(text, 2, 9) ELSE '@' END AS quote FROM ab), v AS (SELECT DISTINCT e.doc_id, criterion_id, e.anchor, CASE WHEN contains(text, trim(quote, ' ')) AND trim(quote, ' ') <> '' THEN trim(quote, ' ') ELSE text END AS quote FROM e JOIN ab ON e.doc_id = ab.doc_id AND e.anchor = ab.anchor) SELECT c.doc_id, c.criterion_id, anchor, quote FROM (SELECT DISTINCT doc_id, pos % 4 AS criterion_id FROM blocks) c LEFT JOIN v USING (doc_id, criterion_id)",
    ),
    "f17_rule_evidence": (
        lambda s, d: R.enrich_rule_evidence(
            table(s, d, "documents").select("doc_id").distinct().join(s.createDataFrame([(1, "the", 2), (2, "tion", 3)], "criterion_id int, keyword string, most int").select("criterion_id")),
            evidence(s, d).where("criterion_id = 1"), anchored_blocks(s, d), s.createDataFrame([(1, "the", 2), (2, "tion", 3)], "criterion_id int, keyword string, most int"),
        ),
        f"WITH {BLOCKS}, h AS (SELECT b.doc_id, c.criterion_id, 'p' || (b.pos - 1) // 2 AS anchor, c.most, row_number() OVER (PARTITION BY b.doc_id, c.criterion_id ORDER BY b.pos) AS i FROM blocks b JOIN (VALUES (1, 'the', 2), (2, 'tion', 3)) c(criterion_id, keyword, most) ON contains(b.text, c.keyword) WHERE NOT (c.criterion_id = 1 AND b.doc_id IN (SELECT doc_id FROM blocks WHERE pos % 4 = 1))) SELECT doc_id, criterion_id, anchor FROM h WHERE i <= most",
    ),
    "f18_build_gold": (
        lambda s, d: R.build_gold(table(s, d, "documents").select("doc_id").distinct().withColumn("criterion_id", F.lit(1)), evidence(s, d).withColumn("criterion_id", F.col("criterion_id").cast("int"))),
        f"WITH {BLOCKS}, e AS (SELECT doc_id, CASE WHEN pos % 9 = 1 THEN 'none' ELSE 'p' || (pos - 1) // 2 END AS anchor, CASE WHEN pos % 3 = 0 THEN substr(text, 2, 9) ELSE '@' END AS quote FROM blocks WHERE pos % 4 = 1), d AS (SELECT DISTINCT doc_id FROM documents) SELECT 'GRP' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(3, length(CAST(doc_id AS VARCHAR))) AS INT), '0') || '-C01' AS case_id, CASE WHEN anchor IS NOT NULL THEN 1 ELSE 0 END AS label, quote, 'anchor=' || anchor AS notes FROM d LEFT JOIN e USING (doc_id)",
    ),
    "f19_criteria_text": (
        lambda s, d: R.check_criteria_text(numbered(s, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text")), ["the", "tion", "eaux", "keit"], 100, 2, 2),
        f"WITH {NUMBERED}, t AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS text, count(*) FILTER (regexp_matches(text, '^\\s*\\d+[.、．]')) AS n FROM numbered GROUP BY doc_id) SELECT doc_id, length(trim(text, ' ')) >= 100 AND CAST(contains(text, 'the') AS INT) + CAST(contains(text, 'tion') AS INT) + CAST(contains(text, 'eaux') AS INT) + CAST(contains(text, 'keit') AS INT) >= 2 AND n >= 2 AS fits FROM t",
    ),
    "f20_meta_fields": (
        lambda s, d: R.require_meta_fields(table(s, d, "orders").selectExpr("o_orderkey AS id", "concat('{\"a\": ', CASE o_orderkey % 4 WHEN 0 THEN '\" \"' WHEN 1 THEN '7' WHEN 2 THEN '\" x \"' ELSE '[1]' END, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ', \"b\": \"y\"' END, '}') AS meta"), ["a", "b"]).select("id", F.col("meta_fields")["a"].alias("a"), F.array_join("missing", ",").alias("missing"), F.array_join("invalid", ",").alias("invalid")),
        "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 2 THEN 'x' ELSE '' END AS a, array_to_string(list_filter([CASE WHEN o_orderkey % 4 <> 2 THEN 'a' END, CASE WHEN o_orderkey % 3 = 0 THEN 'b' END], lambda x: x IS NOT NULL), ',') AS missing, CASE WHEN o_orderkey % 4 IN (1, 3) THEN 'a' ELSE '' END AS invalid FROM orders",
    ),
    "f21_start_anchor": (lambda s, d: R.document_start_anchor(anchored_blocks(s, d)), f"WITH {BLOCKS} SELECT doc_id, arg_min('p' || (pos - 1) // 2, pos) AS anchor FROM blocks GROUP BY doc_id"),
}
