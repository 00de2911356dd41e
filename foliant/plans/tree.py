"""Queries over section trees and greedy batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import blocks as B
from foliant.operators import detect as C
from foliant.operators import retrieve as E
from foliant.operators import tree as D
from foliant.plans.adapt import BLOCKS, blocks, ends, fold_sql, table, tokens_sql, truncate_sql
from foliant.plans.blocks import VISUAL as VISUAL_SQL
from foliant.plans.blocks import CANDIDATES, FAMILY, NUMBERED, REQUIRED, candidates, familied, numbered
from foliant.sources.scratch import cut


def nodes(s, d):
    b = blocks(s, d)
    headings = b.where("level is not null").select("doc_id", "pos", "level", F.col("text").alias("title"), "tokens")
    return D.build_hierarchy(headings, ends(b))


_TYPE = "CASE level WHEN 1 THEN 'section' WHEN 2 THEN 'heading' WHEN 3 THEN CASE WHEN tokens % 2 = 0 THEN 'table' END END"


def typed(s, d):
    """Nodes with a type; some have none."""
    return nodes(s, d).withColumn("node_type", F.expr(_TYPE))


def _pick(kind: str, test) -> str:
    return ", ".join(f"CASE WHEN {test(k)} THEN {kind}{k} END" for k in (1, 2, 3))


NODES = (
    BLOCKS
    + """, ends AS (SELECT doc_id, max(pos) + 1 AS range_end FROM blocks GROUP BY doc_id),
h0 AS (SELECT doc_id, pos, level, text AS title, tokens, """
    + ", ".join(f"max(CASE WHEN level = {k} THEN pos END) OVER b AS p{k}, min(CASE WHEN level = {k} THEN pos END) OVER a AS n{k}" for k in (1, 2, 3))
    + """ FROM blocks WHERE level IS NOT NULL
  WINDOW b AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
h1 AS (SELECT h0.*, greatest("""
    + _pick("p", lambda k: f"level > {k}")
    + ") AS parent_pos, coalesce(least("
    + _pick("n", lambda k: f"level >= {k}")
    + """), range_end) AS end_pos FROM h0 JOIN ends USING (doc_id)),
h2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_pos, level ORDER BY pos) AS ordinal FROM h1),
h3 AS (SELECT *, CASE WHEN level = 1 THEN 'sec' ELSE 'l' || level END || '_' || lpad(CAST(ordinal AS VARCHAR), 3, '0') AS own FROM h2),
t1 AS (SELECT *, 'body/' || own AS node_id, 'body' AS parent_id, 1 AS depth FROM h3 WHERE parent_pos IS NULL),
t2 AS (SELECT h3.*, t1.node_id || '/' || h3.own AS node_id, t1.node_id AS parent_id, 2 AS depth FROM h3 JOIN t1 ON h3.doc_id = t1.doc_id AND h3.parent_pos = t1.pos),
t3 AS (SELECT h3.*, t2.node_id || '/' || h3.own AS node_id, t2.node_id AS parent_id, 3 AS depth FROM h3 JOIN t2 ON h3.doc_id = t2.doc_id AND h3.parent_pos = t2.pos),
nodes AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)"""
)
COVER = " JOIN nodes n ON n.doc_id = b.doc_id AND b.pos >= n.pos AND b.pos < n.end_pos"


def spans(s, d):
    return nodes(s, d).select("doc_id", "node_id", "pos", "end_pos")


def materialized(s, d):
    return D.materialize_nodes(nodes(s, d).drop("tokens"), blocks(s, d))


MATERIAL = (
    NODES
    + r""", texts AS (SELECT n.doc_id, n.node_id, string_agg(b.text, chr(10) ORDER BY b.pos) AS text FROM blocks b"""
    + COVER
    + r""" WHERE b.kind = 'p' GROUP BY n.doc_id, n.node_id),
m0 AS (SELECT n.doc_id, n.node_id, n.parent_id, n.title, n.pos, coalesce(t.text, '') AS text FROM nodes n LEFT JOIN texts t USING (doc_id, node_id)),
material AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE greatest(1, CAST(ceil((length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) / 1.6::DOUBLE + length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 4.0::DOUBLE) AS INT)) END AS tokens FROM m0)"""
)
_FLAT = r"trim(regexp_replace(CASE WHEN tokens >= 300 THEN text ELSE title END, '\s+', ' ', 'g'), ' ')"
SUMMARY = f"CASE WHEN length({_FLAT}) <= 180 THEN {_FLAT} ELSE rtrim(substr({_FLAT}, 1, 180), ' ') || '...' END"


def table_rows(s, d):
    return table(s, d, "lineitem").selectExpr("l_suppkey AS doc_id", "l_partkey AS table_id", "l_orderkey", "l_linenumber", "CAST(l_quantity AS INT) * 10 AS tokens").selectExpr("doc_id", "table_id", "CAST(row_number() OVER (PARTITION BY doc_id, table_id ORDER BY l_orderkey, l_linenumber) AS INT) AS row", "tokens")


def supplier_tables(s, d):
    """Line items of a supplier as one table, in order; each row's tokens are those of its line."""
    line = F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" |\n"))
    return table(s, d, "lineitem").selectExpr("l_suppkey AS doc_id", "1 AS table_id", "l_orderkey * 10000 + l_linenumber * 1000 + l_partkey % 1000 AS row", "CAST(40 + l_linenumber * 8 AS INT) AS tokens", "1 AS columns", "l_partkey").withColumn("text", line)


def segments(s, d):
    b = numbered(s, d).where("pos % 15 = 1")
    rules = F.create_map(F.lit("arabic_dot"), F.lit(1), F.lit("arabic_paren"), (F.col("pos") % 3 + 1).cast("int"))
    return b.select("doc_id", F.col("pos").alias("segment_no"), F.col("pos").alias("start_pos"), rules.alias("rules"))


def faulty_segments(s, d):
    """Segments that start where no candidate is, twice, out of order, late or with too deep a level."""
    b = blocks(s, d).where("pos % 8 = 5")
    rules = F.create_map(F.lit("arabic_dot"), (F.col("pos") % 9).cast("int"))
    return b.select("doc_id", (F.col("pos") * 7 % 101).alias("segment_no"), (F.col("pos") - F.when(F.col("pos") % 16 == 13, 8).otherwise(0)).cast("int").alias("start_pos"), rules.alias("rules"))


def attachment_starts(s, d):
    return C.attachment_starts(numbered(s, d).withColumn("outline", F.col("direct_outline")), r"^(\d+)\.", r"^\d*4\.", "^.*tion").select("doc_id", "pos")


def kinds(s, d):
    b = C.visual_title(blocks(s, d), "tion")
    label = C.plain_label(F.col("text"), "^[A-M]", "tion")
    return b.withColumn("kind_of", F.when(F.col("kind") == "p", F.when(F.col("level").isNotNull(), "heading").when(F.col("visual_title"), "visual_title").when(label, "plain_label")))


def anchors(s, d):
    """Blocks with their anchor and owner; some have none."""
    b = B.assign_anchors(blocks(s, d).select("doc_id", "pos", "kind", "text", "tokens"))
    return b.withColumn("node_id", F.when(F.col("pos") % 13 != 12, F.concat(F.lit("body/n"), (F.col("pos") % 5).cast("string"))))


FAMILY_LEVELS = {"arabic_dot": 1, "arabic_paren": 2, "letter": 3}


def detected(s, d):
    """Lines that begin with a number, as headings: the family of a required candidate says its level, a rule of a segment another one."""
    found = C.required_sequences(candidates(s, d)).where("required AND family <> 'unnumbered'")
    found = cut(found.select("doc_id", "pos", "family", "text", "tokens"), "found")
    levels = F.create_map(*(F.lit(x) for pair in FAMILY_LEVELS.items() for x in pair))
    start = found.groupBy("doc_id").agg(F.min("pos").alias("start_pos")).select("doc_id", "start_pos", F.lit(1).alias("segment_no"), levels.alias("rules"))
    return D.apply_segments(found, start).where("level IS NOT NULL").join(found.select("doc_id", "pos", F.col("text").alias("title"), "tokens"), ["doc_id", "pos"])


DETECTED = REQUIRED + ", detected AS (SELECT n.doc_id, n.pos, CASE family " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FAMILY_LEVELS.items()) + """ END AS level, m.text, m.tokens FROM needed n JOIN numbered m ON m.doc_id = n.doc_id AND m.pos = n.pos WHERE required AND family IN ('arabic_dot', 'arabic_paren', 'letter'))""" + NODES[len(BLOCKS) :].replace("FROM blocks WHERE level IS NOT NULL", "FROM detected").replace("h1 AS", "hh1 AS").replace("FROM h1)", "FROM hh1)")


Q = {
    "d01_detected_tree": (
        lambda s, d: D.build_hierarchy(detected(s, d).drop("family", "segment_no"), ends(blocks(s, d))).select("doc_id", "pos", "level", "node_id", "parent_id", "end_pos"),
        f"WITH {DETECTED} SELECT doc_id, pos, level, node_id, parent_id, end_pos FROM nodes",
    ),
    "d09_detected_owners": (
        lambda s, d: D.own_anchors(B.assign_anchors(blocks(s, d)).select("doc_id", "pos", "anchor"), D.build_hierarchy(detected(s, d).drop("family", "segment_no"), ends(blocks(s, d)))).select("doc_id", "anchor", "node_id"),
        f"WITH {DETECTED}, an AS (SELECT doc_id, pos, kind || '_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS VARCHAR), 4, '0') AS anchor FROM blocks), o AS (SELECT b.doc_id, b.pos, arg_max(n.node_id, n.pos) AS node_id FROM blocks b{COVER} GROUP BY b.doc_id, b.pos) SELECT an.doc_id, anchor, node_id FROM an LEFT JOIN o USING (doc_id, pos)",
    ),
    "d01_hierarchy": (lambda s, d: nodes(s, d).select("doc_id", "pos", "level", "node_id", "parent_id", "parent_pos", "end_pos", "ordinal", "depth"), f"WITH {NODES} SELECT doc_id, pos, level, node_id, parent_id, parent_pos, end_pos, CAST(ordinal AS INT) AS ordinal, depth FROM nodes"),
    "d02_materialize": (lambda s, d: materialized(s, d).select("doc_id", "node_id", "text", "tokens", "summary"), f"WITH {MATERIAL} SELECT doc_id, node_id, text, tokens, {SUMMARY} AS summary FROM material"),
    "d06_split_leaves": (
        lambda s, d: D.split_long_leaves(spans(s, d), blocks(s, d), 150, 100).select("doc_id", "node_id", "chunk", "start_pos", "end_pos", F.col("tokens").cast("long").alias("tokens")),
        f"WITH RECURSIVE {NODES}, items AS (SELECT n.doc_id, n.node_id, b.pos, CASE WHEN kind = 'tbl' THEN 0 ELSE b.tokens END AS w0 FROM blocks b{COVER}), long AS (SELECT i.* FROM items i JOIN (SELECT doc_id, node_id FROM items GROUP BY ALL HAVING sum(w0) > 150) USING (doc_id, node_id)),"
        + fold_sql("long", "doc_id, node_id", "pos", "w0", "100", flush="used > 0")
        + ", c AS (SELECT doc_id, node_id, batch AS chunk, min(pos) AS start_pos, max(pos) AS end_pos, CAST(sum(w) AS BIGINT) AS tokens FROM folded GROUP BY ALL) SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY doc_id, node_id) > 1",
    ),
    "d07_attach_tables": (
        lambda s, d: D.attach_tables(blocks(s, d).where("kind = 'tbl'").select("doc_id", "pos"), nodes(s, d)).select("doc_id", "pos", "node_id", "level", "ordinal"),
        f"WITH {NODES}, o AS (SELECT b.doc_id, b.pos, arg_max(n.node_id, n.depth * 1000000 + n.pos) AS node_id, max(n.depth) AS depth FROM blocks b{COVER} WHERE b.kind = 'tbl' GROUP BY b.doc_id, b.pos) SELECT doc_id, pos, node_id, depth + 1 AS level, row_number() OVER (PARTITION BY doc_id, node_id ORDER BY pos) AS ordinal FROM o",
    ),
    "d08_split_tables": (
        lambda s, d: D.split_large_tables(supplier_tables(s, d), 2000, 1000),
        "WITH RECURSIVE l AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10000 + l_linenumber * 1000 + l_partkey % 1000) AS row, 40 + l_linenumber * 8 AS tokens, '| ' || l_partkey || ' |' || chr(10) AS text FROM lineitem), t AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id) AS total, max(CASE WHEN row = 1 THEN tokens END) OVER (PARTITION BY doc_id) AS head FROM l), large AS (SELECT doc_id, row, tokens / CAST(1000 - head AS DOUBLE) AS w0 FROM t WHERE total > 2000 AND row > 1),"
        + fold_sql("large", "doc_id", "row", "w0", "1.0000000001")
        + ", c AS (SELECT f.doc_id, batch, min(f.row) AS a, max(f.row) AS z, string_agg(l.text, '' ORDER BY f.row) AS body FROM folded f JOIN l ON l.doc_id = f.doc_id AND l.row = f.row GROUP BY ALL)"
        " SELECT c.doc_id, 1 AS table_id, batch AS chunk, a AS first_row, z AS last_row, 'rows_' || lpad(CAST(a AS VARCHAR), 4, '0') || '_' || lpad(CAST(z AS VARCHAR), 4, '0') AS name, '<!-- table_id: 1 -->' || chr(10) || l.text || '| --- |' || chr(10) || body AS text FROM c JOIN l ON l.doc_id = c.doc_id AND l.row = 1",
    ),
    "d09_own_anchors": (
        lambda s, d: D.own_anchors(blocks(s, d).select("doc_id", "pos"), nodes(s, d)).select("doc_id", "pos", "node_id"),
        f"WITH {NODES}, o AS (SELECT b.doc_id, b.pos, arg_max(n.node_id, n.pos) AS node_id FROM blocks b{COVER} GROUP BY b.doc_id, b.pos) SELECT b.doc_id, b.pos, o.node_id FROM blocks b LEFT JOIN o USING (doc_id, pos)",
    ),
    "d10_key_items": (
        lambda s, d: D.key_items(nodes(s, d)).select("doc_id", "parent_id", F.array_join("key_items", "|").alias("key_items")),
        f"WITH {NODES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY pos) AS i FROM nodes) SELECT doc_id, parent_id, string_agg(title, '|' ORDER BY i) FILTER (i <= 8) AS key_items FROM k GROUP BY doc_id, parent_id",
    ),
    "d11_preorder": (lambda s, d: D.flatten_preorder(nodes(s, d)).select("doc_id", "node_id", "preorder"), f"WITH {NODES} SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, depth) AS preorder FROM nodes"),
    "d12_structure_view": (lambda s, d: D.structure_view(materialized(s, d)), f"WITH {MATERIAL} SELECT m.doc_id, m.node_id, m.parent_id, n.level, m.title, {SUMMARY.replace('tokens', 'm.tokens').replace('title', 'm.title')} AS summary, m.tokens FROM material m JOIN nodes n USING (doc_id, node_id)"),
    "d13_attachments": (
        lambda s, d: D.attachment_nodes(kinds(s, d), attachment_starts(s, d), ends(blocks(s, d))),
        f"WITH {CANDIDATES}, ends AS (SELECT doc_id, max(pos) + 1 AS range_end FROM blocks GROUP BY doc_id), r AS (SELECT doc_id, pos, text, direct_outline, CASE WHEN regexp_extract(text, '^(\\d+)\\.', 1) <> '' AND NOT regexp_matches(text, '^\\d*4\\.') THEN regexp_extract(text, '^(\\d+)\\.', 1) END AS number FROM numbered WHERE kind = 'p'),"
        " st AS (SELECT doc_id, max(pos) AS pos FROM r WHERE number IS NOT NULL GROUP BY doc_id, number UNION ALL SELECT doc_id, pos FROM r WHERE number IS NULL AND direct_outline BETWEEN 0 AND 8 AND contains(text, 'tion')),"
        " sec AS (SELECT st.doc_id, st.pos, 'attachments/att_' || lpad(CAST(row_number() OVER (PARTITION BY st.doc_id ORDER BY st.pos) AS VARCHAR), 3, '0') AS node_id, coalesce(lead(st.pos) OVER (PARTITION BY st.doc_id ORDER BY st.pos), range_end) AS end_pos FROM st JOIN ends USING (doc_id)),"
        f" vk AS (SELECT *, {VISUAL_SQL} AS visual FROM blocks), k AS (SELECT doc_id, pos, text, CASE WHEN kind <> 'p' THEN NULL WHEN level IS NOT NULL THEN 'heading' WHEN visual THEN 'visual_title' WHEN regexp_matches(text, '^[A-M]') AND (n <= 16 OR regexp_matches(text, 'tion')) THEN 'plain_label' END AS kind_of FROM vk),"
        " ch AS (SELECT k.doc_id, sec.node_id AS parent_id, k.kind_of, k.text, k.pos, sec.end_pos AS stop, row_number() OVER (PARTITION BY k.doc_id, sec.node_id ORDER BY k.pos) AS i, lead(k.pos) OVER (PARTITION BY k.doc_id, sec.node_id ORDER BY k.pos) AS nxt FROM k JOIN sec ON sec.doc_id = k.doc_id AND k.pos > sec.pos AND k.pos < sec.end_pos WHERE kind_of IS NOT NULL)"
        " SELECT sec.doc_id, node_id, 'attachments/parent' AS parent_id, 'attachment_section' AS node_type, b.text AS title, sec.pos, sec.end_pos FROM sec JOIN blocks b ON b.doc_id = sec.doc_id AND b.pos = sec.pos"
        " UNION ALL SELECT doc_id, parent_id || '/' || kind_of || '_' || lpad(CAST(i AS VARCHAR), 3, '0'), parent_id, kind_of, text, pos, coalesce(nxt, stop) FROM ch",
    ),
    "d14_segments": (
        lambda s, d: D.apply_segments(familied(s, d).where("family <> 'unnumbered'"), segments(s, d), numbered(s, d).where("pos % 10 = 4").select("doc_id", "pos", F.lit(5).alias("level"))),
        f"WITH {NUMBERED}, c AS (SELECT doc_id, pos, {FAMILY} AS family FROM numbered), s AS (SELECT doc_id, pos AS segment_no FROM numbered WHERE pos % 15 = 1), j AS (SELECT c.doc_id, c.pos, c.family, max(s.segment_no) AS segment_no FROM c LEFT JOIN s ON c.doc_id = s.doc_id AND s.segment_no <= c.pos WHERE c.family <> 'unnumbered' GROUP BY ALL)"
        " SELECT *, CASE WHEN pos % 10 = 4 THEN 5 WHEN segment_no IS NULL THEN NULL WHEN family = 'arabic_dot' THEN 1 WHEN family = 'arabic_paren' THEN segment_no % 3 + 1 END AS level FROM j",
    ),
    "d14_segment_errors": (
        lambda s, d: D.segment_errors(C.required_sequences(candidates(s, d)), faulty_segments(s, d)),
        f"WITH {REQUIRED}, s AS (SELECT doc_id, pos * 7 % 101 AS segment_no, CAST(pos - CASE WHEN pos % 16 = 13 THEN 8 ELSE 0 END AS INT) AS start_pos, pos % 9 AS dot FROM blocks WHERE pos % 8 = 5),"
        " sw AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id, start_pos ORDER BY segment_no) AS k, max(start_pos) OVER (PARTITION BY s.doc_id ORDER BY segment_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, EXISTS (SELECT 1 FROM needed n WHERE n.doc_id = s.doc_id AND n.pos = start_pos) AS known FROM s),"
        " fs AS (SELECT doc_id, arg_min(segment_no, start_pos * 1000 + segment_no) AS segment_no, min(start_pos) AS a FROM s GROUP BY doc_id)"
        " SELECT doc_id, segment_no, unnest(list_filter([CASE WHEN NOT known THEN 'unknown_start' END, CASE WHEN k > 1 THEN 'duplicate_start' END, CASE WHEN start_pos < m THEN 'order' END], lambda x: x IS NOT NULL)) AS error, NULL AS detail FROM sw"
        " UNION ALL SELECT doc_id, segment_no, 'level_range', 'arabic_dot' FROM s WHERE dot NOT BETWEEN 1 AND 6"
        " UNION ALL SELECT DISTINCT n.doc_id, (SELECT arg_max(segment_no, start_pos * 1000 + segment_no) FROM s WHERE s.doc_id = n.doc_id AND s.start_pos <= n.pos), 'missing_family', family FROM needed n WHERE required AND family <> 'arabic_dot' AND EXISTS (SELECT 1 FROM s WHERE s.doc_id = n.doc_id AND s.start_pos <= n.pos)"
        " UNION ALL SELECT doc_id, segment_no, 'late_first', NULL FROM fs WHERE EXISTS (SELECT 1 FROM needed n WHERE n.doc_id = fs.doc_id AND required AND n.pos < a)",
    ),
    "d15_resolve_heading": (
        lambda s, d: D.resolve_heading(
            blocks(s, d).where("level = 1").select("doc_id", F.concat(F.lit("b"), (F.col("pos") + F.when(F.col("pos") % 2 == 0, 1).otherwise(0)).cast("string")).alias("anchor"), "pos", F.concat(F.when(F.col("pos") % 3 == 0, F.substring("text", 1, 20)).otherwise(F.col("text")), F.lit("..")).alias("title")),
            blocks(s, d).withColumn("anchor", F.concat(F.lit("b"), F.col("pos").cast("string"))),
        ).select("doc_id", "pos", "resolved"),
        f"WITH {BLOCKS}, k AS (SELECT doc_id, 'b' || pos AS a, regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '[.。]+$', '') AS t FROM blocks),"
        " w AS (SELECT doc_id, pos, 'b' || (pos + CASE WHEN pos % 2 = 0 THEN 1 ELSE 0 END) AS a, regexp_replace(regexp_replace(CASE WHEN pos % 3 = 0 THEN substr(text, 1, 20) ELSE text END || '..', '\\s+', '', 'g'), '[.。]+$', '') AS t FROM blocks WHERE level = 1),"
        " h AS (SELECT w.doc_id, w.pos, w.a, list(k.a) AS hits FROM w LEFT JOIN k ON w.doc_id = k.doc_id AND (k.t = w.t OR (length(w.t) >= 12 AND starts_with(k.t, w.t))) GROUP BY ALL)"
        " SELECT doc_id, pos, CASE WHEN list_contains(hits, a) THEN a WHEN len(hits) = 1 THEN hits[1] END AS resolved FROM h",
    ),
    "d17_hierarchy_nodes": (
        lambda s, d: D.hierarchy_nodes(nodes(s, d).select("doc_id", "pos", "level", "title"), ends(blocks(s, d)), "attachments/att_001").select("doc_id", "pos", "node_id", "parent_id", "end_pos"),
        f"WITH {NODES} SELECT doc_id, pos, 'attachments/att_001/h' || replace(replace(substr(node_id, 6), 'sec_', '1_'), '/l', '/h') AS node_id, CASE WHEN parent_id = 'body' THEN 'attachments/att_001' ELSE 'attachments/att_001/h' || replace(replace(substr(parent_id, 6), 'sec_', '1_'), '/l', '/h') END AS parent_id, end_pos FROM nodes",
    ),
    "d16_hierarchy_errors": (
        lambda s, d: D.hierarchy_errors(blocks(s, d).where("level is not null"), 2),
        f"WITH {BLOCKS}, l AS (SELECT doc_id, pos, level, lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM blocks WHERE level IS NOT NULL), e AS (SELECT doc_id, pos, level, CASE WHEN level NOT BETWEEN 1 AND 2 THEN 'range' WHEN p IS NULL AND level <> 1 THEN 'first' WHEN level > p + 1 THEN 'jump' END AS error FROM l) SELECT * FROM e WHERE error IS NOT NULL",
    ),
    "d18_overlap": (
        lambda s, d: D.batch_with_overlap(blocks(s, d).select("doc_id", "pos", F.col("tokens").alias("w")), 200, 40),
        f"WITH RECURSIVE {BLOCKS}, p AS (SELECT doc_id, pos, tokens AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(tokens) OVER (PARTITION BY doc_id ORDER BY pos) AS c, count(*) OVER (PARTITION BY doc_id) AS n FROM blocks),"
        " e AS (SELECT a.doc_id, a.i, any_value(a.n) AS n, greatest(a.i, coalesce(max(b.i) FILTER (b.c - (a.c - a.w) <= 200), 0)) AS e FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i >= a.i GROUP BY a.doc_id, a.i),"
        " nx AS (SELECT e.doc_id, e.i, e.e, any_value(e.n) AS n, greatest(e.i + 1, coalesce(max(k.i) FILTER (z.c - (k.c - k.w) >= 40), 0)) AS nxt FROM e JOIN p z ON z.doc_id = e.doc_id AND z.i = e.e JOIN p k ON k.doc_id = e.doc_id AND k.i <= e.e GROUP BY e.doc_id, e.i, e.e),"
        " walk AS (SELECT doc_id, i, e, nxt, n, 1 AS batch FROM nx WHERE i = 1 UNION ALL SELECT nx.doc_id, nx.i, nx.e, nx.nxt, nx.n, batch + 1 FROM walk JOIN nx ON nx.doc_id = walk.doc_id AND nx.i = walk.nxt WHERE walk.e < walk.n)"
        " SELECT walk.doc_id, batch, a.pos AS start_pos, z.pos AS end_pos FROM walk JOIN p a ON a.doc_id = walk.doc_id AND a.i = walk.i JOIN p z ON z.doc_id = walk.doc_id AND z.i = walk.e",
    ),
    "d19_merge_batches": (
        lambda s, d: D.merge_batches(blocks(s, d).where("level IS NOT NULL").select("doc_id", F.explode(F.expr("CASE WHEN pos % 14 < 3 THEN array(floor(pos / 14), floor(pos / 14) - 1) ELSE array(floor(pos / 14)) END")).alias("batch"), "pos", "level").selectExpr("doc_id", "CAST(batch AS INT) AS batch", "pos", "CAST(level + pmod(batch, 2) AS INT) AS level")),
        None,  # batches depend on those before; the tests merge by hand
    ),
    "d20_oversized_leaves": (lambda s, d: D.oversized_leaves(materialized(s, d), 100, 2).select("doc_id", "node_id", "tokens", "action"), f"WITH {MATERIAL} SELECT m.doc_id, m.node_id, m.tokens, CASE WHEN n.depth >= 2 THEN 'chunk' ELSE 'expand' END AS action FROM material m JOIN nodes n USING (doc_id, node_id) WHERE m.tokens > 100 AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.doc_id = m.doc_id AND c.parent_id = m.node_id)"),
    "d21_summary_inputs": (
        lambda s, d: D.summary_inputs(materialized(s, d), 100, 150, 300, 200),
        f"WITH {MATERIAL}, f AS (SELECT *, {SUMMARY} AS summary FROM material), l AS (SELECT doc_id, parent_id AS node_id, string_agg('- ' || title || ': ' || summary, chr(10) ORDER BY pos) AS lines FROM f GROUP BY doc_id, parent_id),"
        f" c AS (SELECT f.doc_id, f.node_id, coalesce(l.lines, f.text) AS content FROM f LEFT JOIN l USING (doc_id, node_id) WHERE l.lines IS NOT NULL OR f.tokens >= 100) SELECT doc_id, node_id, {truncate_sql('content', 150, 200, '...')} AS content FROM c",
    ),
    "d22_pack_batches": (lambda s, d: D.pack_batches(blocks(s, d), 150, 4), f"WITH RECURSIVE {BLOCKS}, " + fold_sql("blocks", "doc_id", "pos", "tokens", "150", "4") + " SELECT doc_id, pos, batch FROM folded"),
    "d23_apply_summaries": (
        lambda s, d: D.apply_summaries(materialized(s, d), materialized(s, d).where("pos % 2 = 1").select("doc_id", "node_id", F.when(F.col("pos") % 3 == 0, " ").otherwise(F.concat(F.lit("S "), F.col("title"))).alias("summary")), 30, 20).select("doc_id", "node_id", "summary"),
        f"WITH {MATERIAL}, f AS (SELECT *, {SUMMARY} AS summary, trim('S ' || title, ' ') AS given FROM material) SELECT doc_id, node_id, CASE WHEN pos % 2 = 1 AND pos % 3 <> 0 THEN {truncate_sql('given', 30, 20)} ELSE summary END AS summary FROM f",
    ),
    "d24_index_stats": (
        lambda s, d: D.index_stats(nodes(s, d), blocks(s, d)),
        f"WITH {NODES}, k AS (SELECT doc_id, level, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM nodes GROUP BY ROLLUP (doc_id, level)), a AS (SELECT doc_id, count(*) AS n_anchors, count(*) FILTER (kind = 'tbl') AS n_tables FROM blocks GROUP BY ROLLUP (doc_id)) SELECT k.*, n_anchors, n_tables FROM k LEFT JOIN a ON a.doc_id IS NOT DISTINCT FROM k.doc_id AND k.level IS NULL",
    ),
    "d24_largest": (lambda s, d: D.largest(nodes(s, d)), f"WITH {NODES} SELECT doc_id, node_id, tokens FROM nodes ORDER BY tokens DESC, doc_id, node_id LIMIT 10"),
    "d24_node_types": (
        lambda s, d: D.type_counts(typed(s, d)),
        f"WITH {NODES}, t AS (SELECT *, {_TYPE} AS node_type FROM nodes) SELECT doc_id, coalesce(node_type, 'unknown') AS node_type, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM t GROUP BY ALL UNION ALL SELECT doc_id, NULL, count(*), CAST(sum(tokens) AS BIGINT) FROM nodes GROUP BY doc_id UNION ALL SELECT NULL, NULL, count(*), CAST(sum(tokens) AS BIGINT) FROM nodes",
    ),
    "d25_title_rows": (
        lambda s, d: D.title_rows(typed(s, d)).select("doc_id", "node_id", "level", "node_type", "title", "tokens"),
        f"WITH {NODES}, t AS (SELECT *, {_TYPE} AS node_type FROM nodes) SELECT doc_id, node_id, level, node_type, title, tokens FROM t WHERE node_type IN ('section', 'heading')",
    ),
    "d25_attachment_tree": (
        lambda s, d: D.attachment_tree(typed(s, d), "body").select("doc_id", "node_id", "parent_id", "depth", F.array_join("path", " > ").alias("path")),
        f"WITH RECURSIVE {NODES}, t AS (SELECT doc_id, node_id, parent_id, 1 AS depth, title AS path FROM nodes WHERE parent_id = 'body' UNION ALL SELECT n.doc_id, n.node_id, n.parent_id, t.depth + 1, t.path || ' > ' || n.title FROM nodes n JOIN t ON n.doc_id = t.doc_id AND n.parent_id = t.node_id) SELECT * FROM t",
    ),
    "d25_token_rows": (lambda s, d: D.token_rows(nodes(s, d)), f"WITH {NODES} SELECT doc_id, node_id, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY tokens DESC, node_id) AS rank FROM nodes"),
    "d25_subtree": (lambda s, d: D.subtree(nodes(s, d), F.lit("body/sec_002")).select("doc_id", "node_id"), f"WITH {NODES} SELECT doc_id, node_id FROM nodes WHERE node_id = 'body/sec_002' OR starts_with(node_id, 'body/sec_002/')"),
    "e07_scan_batches": (
        lambda s, d: E.scan_batches(anchors(s, d), 120),
        f"WITH RECURSIVE {BLOCKS}, an AS (SELECT *, kind || '_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS VARCHAR), 4, '0') AS anchor, 'body/n' || pos % 5 AS node_id FROM blocks), ps AS (SELECT doc_id, pos, anchor, node_id, text, {tokens_sql('text')} AS w0 FROM an WHERE pos % 13 <> 12), "
        + fold_sql("ps", "doc_id", "pos", "w0", "120")
        + " SELECT f.doc_id, batch, 'scan/batch_' || lpad(CAST(batch AS VARCHAR), 3, '0') AS match_id, arg_min(ps.node_id, ps.pos) AS parent_id, min(ps.pos) AS start_pos, max(ps.pos) AS end_pos, arg_min(ps.anchor, ps.pos) AS start_anchor, arg_max(ps.anchor, ps.pos) AS end_anchor, string_agg(ps.text, chr(10) ORDER BY ps.pos) AS text FROM folded f JOIN ps ON ps.doc_id = f.doc_id AND ps.pos = f.pos GROUP BY f.doc_id, batch",
    ),
    "e21_split_structure": (
        lambda s, d: D.split_structure(nodes(s, d), 60),
        f"WITH RECURSIVE {NODES}, z AS (SELECT n.doc_id, n.node_id, n.parent_id, n.pos, sum(b.tokens) AS size, count(*) AS k FROM nodes n JOIN nodes b ON b.doc_id = n.doc_id AND (b.node_id = n.node_id OR starts_with(b.node_id, n.node_id || '/')) GROUP BY ALL),"
        " units AS (SELECT z.* FROM z LEFT JOIN z u ON u.doc_id = z.doc_id AND u.node_id = z.parent_id WHERE (z.size <= 60 OR z.k = 1) AND (u.size IS NULL OR u.size > 60)),"
        + fold_sql("units", "doc_id, parent_id", "pos", "size", "60")
        + " SELECT f.doc_id, f.parent_id, u.node_id, f.batch AS page FROM folded f JOIN units u ON u.doc_id = f.doc_id AND u.parent_id = f.parent_id AND u.pos = f.pos",
    ),
    "e26_paginate": (
        lambda s, d: E.paginate(blocks(s, d).select(F.col("doc_id").alias("query_id"), "doc_id", F.col("pos").alias("place"), "text"), 80).groupBy("doc_id", "page", "used", "has_more", "next_part").agg(F.count("*").alias("units")),
        f"WITH RECURSIVE {BLOCKS}, u AS (SELECT doc_id, pos, {tokens_sql('text')} AS w0 FROM blocks), "
        + fold_sql("u", "doc_id", "pos", "w0", "80")
        + ", g AS (SELECT doc_id, batch AS page, CAST(sum(w) AS BIGINT) AS used, count(*) AS units FROM folded GROUP BY ALL) SELECT doc_id, page, used, lead(page) OVER (PARTITION BY doc_id ORDER BY page) IS NOT NULL AS has_more, lead(page) OVER (PARTITION BY doc_id ORDER BY page) AS next_part, units FROM g",
    ),
    "e26_one_part": (
        lambda s, d: E.paginate(blocks(s, d).select(F.col("doc_id").alias("query_id"), "doc_id", F.col("pos").alias("place"), "text"), 80, part=2).select("doc_id", "place", "has_more"),
        f"WITH RECURSIVE {BLOCKS}, u AS (SELECT doc_id, pos, {tokens_sql('text')} AS w0 FROM blocks), " + fold_sql("u", "doc_id", "pos", "w0", "80") + " SELECT doc_id, pos AS place, max(batch) OVER (PARTITION BY doc_id) > 2 AS has_more FROM folded QUALIFY batch = 2",
    ),
}
