"""Queries over blocks: enrichment and detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import blocks as B
from foliant.operators import detect as C
from foliant.plans.adapt import BLOCKS, CELLS, RUNS, blocks, cells, runs, table

GRID = CELLS + """, gc AS (SELECT *, CAST(first_value(grid_before) OVER w + sum(grid_span) OVER w - grid_span AS INT) AS first_col FROM cells WINDOW w AS (PARTITION BY doc_id, table_id, row ORDER BY cell_no)),
gs AS (SELECT *, unnest(range(first_col, first_col + grid_span)) AS c FROM gc),
gt AS (SELECT *, last_value(CASE WHEN vmerge = 'restart' THEN row WHEN vmerge IS NULL THEN -1 END IGNORE NULLS) OVER u AS lr, last_value(CASE WHEN vmerge = 'restart' THEN first_col WHEN vmerge IS NULL THEN -1 END IGNORE NULLS) OVER u AS lc FROM gs WINDOW u AS (PARTITION BY doc_id, table_id, c ORDER BY row ROWS UNBOUNDED PRECEDING)),
grid AS (SELECT doc_id, table_id, row, CAST(c AS INT) AS col, cell_no, CASE WHEN h THEN lr ELSE row END AS origin_row, CASE WHEN h THEN lc ELSE first_col END AS origin_col,
  CASE WHEN h AND c > first_col THEN 'merged_inherited' WHEN h THEN 'vertical_inherited' WHEN c > first_col THEN 'horizontal_inherited' ELSE 'original' END AS slot FROM (SELECT *, coalesce(vmerge = 'continue' AND lr >= 0, false) AS h FROM gt))"""
LOGICAL = GRID + """, sr AS (SELECT doc_id, table_id, row, cell_no, text, 'S' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, table_id ORDER BY row, cell_no) AS VARCHAR), 4, '0') AS ref FROM cells WHERE trim(text, ' ') <> ''),
own AS (SELECT g.doc_id, g.table_id, g.row AS origin_row, g.col AS origin_col, 'C' || lpad(CAST(row_number() OVER (PARTITION BY g.doc_id, g.table_id ORDER BY g.row, g.cell_no) AS VARCHAR), 4, '0') AS cell_id, ref, text FROM grid g LEFT JOIN sr USING (doc_id, table_id, row, cell_no) WHERE slot = 'original'),
places AS (SELECT doc_id, table_id, row, CAST(unnest(range(0, last + 1)) AS INT) AS col FROM (SELECT DISTINCT doc_id, table_id, row, max(col) OVER (PARTITION BY doc_id, table_id) AS last FROM grid)),
logical AS (SELECT p.*, g.cell_no, coalesce(g.slot, 'empty') AS slot, o.cell_id, o.ref, o.text FROM places p LEFT JOIN grid g USING (doc_id, table_id, row, col) LEFT JOIN own o ON o.doc_id = g.doc_id AND o.table_id = g.table_id AND o.origin_row = g.origin_row AND o.origin_col = g.origin_col),
rendered AS (SELECT *, CASE WHEN slot = 'original' THEN coalesce(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), chr(13), '') || ' [' || ref || ']', '') WHEN slot = 'empty' THEN '' ELSE CASE WHEN slot = 'horizontal_inherited' THEN '↳同左' ELSE '↳同上' END || coalesce(ref, cell_id) END AS md,
  ref IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, table_id, row, ref ORDER BY col) = 1 AS first_in_row FROM logical)"""


def logical(s, d):
    return B.logical_cells(B.restore_grid(cells(s, d)), B.source_refs(cells(s, d)))


LEVELS = [(1, "^[A-E]"), (2, "^[F-L]"), (3, "^[M-Z]")]
OTHER = [(1, "^[T-Z]"), (2, "^[A-I]"), (3, "^[J-S]")]
NUMBERING = [("n1", 0, "decimal", "%1.", 1), ("n1", 1, "upperLetter", "(%1)", 1), ("n2", 0, "chineseCounting", "%1、", 3), ("n2", 1, "lowerLetter", "%1)", 2)]


def levels_table(s):
    return s.createDataFrame(NUMBERING, "num_id string, ilvl int, num_format string, level_text string, start int")


def styles(s, d):
    """A style for each supplier: based on the one before, with an outline at every fifth."""
    t = table(s, d, "supplier").withColumn("doc_id", F.col("s_nationkey"))
    return t.selectExpr("doc_id", "s_suppkey AS style_id", "CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey % 9 AS STRING) WHEN s_suppkey % 5 = 1 THEN 'x' END AS outline", "CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey - 1 END AS based_on").withColumn("doc_id", F.lit(0))


def numbered(s, d):
    """Blocks with a visible number in front."""
    return blocks(s, d).withColumn("text", F.expr("CASE pos % 4 WHEN 0 THEN concat(pos, '.', text) WHEN 1 THEN concat('(', pos % 9 + 1, ')', text) WHEN 2 THEN concat(char(CAST(97 + pos % 26 AS INT)), ')', text) ELSE text END"))


SPACED = "CASE pos % 4 WHEN 0 THEN concat(pos, '  .', text) WHEN 1 THEN concat('十二 、', text) WHEN 2 THEN concat(pos, ' 、 ', text) ELSE concat(pos, ' )', text) END"
NUMBERED = BLOCKS + r""", numbered AS (
  SELECT * REPLACE (CASE pos % 4 WHEN 0 THEN concat(pos, '.', text) WHEN 1 THEN concat('(', pos % 9 + 1, ')', text) WHEN 2 THEN concat(chr(CAST(97 + pos % 26 AS INT)), ')', text) ELSE text END AS text) FROM blocks
)"""
FAMILY = r"CASE WHEN regexp_matches(text, '^[（(]\d+[）)]') THEN 'arabic_paren' WHEN regexp_matches(text, '^\d+(?:\.\d+)+[.、）)]?') THEN 'arabic_multilevel' WHEN regexp_matches(text, '^\d+、') THEN 'arabic_comma' WHEN regexp_matches(text, '^\d+[.]') THEN 'arabic_dot' WHEN regexp_matches(text, '^\d+[）)]') THEN 'arabic_close' WHEN regexp_matches(text, '^[A-Za-z][.、）)]') THEN 'letter' ELSE 'unnumbered' END"
ORDINAL = r"CASE WHEN regexp_extract(text, '^[(（]?(\d+)[.、)）]', 1) <> '' THEN TRY_CAST(regexp_extract(text, '^[(（]?(\d+)', 1) AS BIGINT) WHEN regexp_matches(text, '^[A-Za-z][.、)）]') THEN ascii(upper(text[1])) - 64 END"
_KINDS = C.EXAMPLE_KINDS
EXAMPLES = NUMBERED + ", ex AS (SELECT source || '/' || doc_id % 3 AS profile, level, doc_id * 1000000 + pos AS place, text, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in _KINDS) + " END AS kind, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{p[1:]}'" for _, p in _KINDS) + """ END AS src FROM numbered WHERE level IS NOT NULL),
firsts AS (SELECT profile, level, kind, src, min(place) AS f FROM ex WHERE kind IS NOT NULL GROUP BY ALL),
kinds AS (SELECT profile, level, string_agg(kind, ',' ORDER BY f) AS kinds FROM (SELECT profile, level, kind, min(f) AS f FROM firsts GROUP BY ALL) GROUP BY ALL),
patterns AS (SELECT profile, level, kinds, '^(?:' || string_agg(src, '|' ORDER BY f) || ')' AS pattern FROM firsts JOIN kinds USING (profile, level) GROUP BY ALL)"""


def examples(s, d):
    return numbered(s, d).where("level is not null").select(F.concat_ws("/", "source", (F.col("doc_id") % 3).cast("string")).alias("profile"), "level", (F.col("doc_id") * 1000000 + F.col("pos")).alias("place"), "text")


LEVEL_SQL = "CASE WHEN regexp_matches(text, '^[A-E]') THEN 1 WHEN regexp_matches(text, '^[F-L]') THEN 2 WHEN regexp_matches(text, '^[M-Z]') THEN 3 END"
OTHER_SQL = "CASE WHEN regexp_matches(text, '^[T-Z]') THEN 1 WHEN regexp_matches(text, '^[A-I]') THEN 2 WHEN regexp_matches(text, '^[J-S]') THEN 3 END"


def _profile_sql(name: str, rank: int, level: str) -> str:
    return f"""
l{rank} AS (SELECT doc_id, pos, {level} AS level FROM scored WHERE {level} IS NOT NULL AND kind = 'p'),
a{rank} AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS l1 FROM l{rank} WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b{rank} AS (SELECT *, level = 2 AND l1 IS NOT NULL AS ok2, max(CASE WHEN level = 2 AND l1 IS NOT NULL THEN pos END) OVER w AS l2 FROM a{rank} WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p{rank} AS (SELECT doc_id, '{name}' AS profile, {rank} AS rank, count(*) FILTER (level = 1) AS n1, count(*) FILTER (level = 2) AS n2, count(*) FILTER (level = 3) AS n3, count(*) FILTER (level = 1) AS v1, count(*) FILTER (ok2) AS v2,
  count(*) FILTER (level = 3 AND l2 IS NOT NULL AND l2 > coalesce(l1, -1)) AS v3 FROM b{rank} GROUP BY doc_id)"""


SCORES = "," + _profile_sql("first", 0, LEVEL_SQL) + "," + _profile_sql("second", 1, OTHER_SQL) + r""",
scores AS (SELECT *, n2 - v2 + n3 - v3 AS orphans, 9 * v1 + 4 * v2 + 2 * v3 - 8 * (n2 - v2 + n3 - v3) AS score FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1))"""


PROFILES = BLOCKS + ", scored AS (SELECT * FROM blocks)" + SCORES


def scores(s, d, until=None):
    return C.score_profiles(blocks(s, d), [("first", LEVELS), ("second", OTHER)], until=until)


def early(s, d):
    """Where attachments may start if the body is taken to start with the document."""
    return C.attachment_start(blocks(s, d).withColumns({"outline": F.col("direct_outline"), "level": F.lit(None).cast("int")}), "^[VW].*a", "^[A-F].*z")


def cuts(s, d):
    b = blocks(s, d).withColumn("outline", F.col("direct_outline"))
    return C.body_start(b).join(C.tail_start(b, "^[XYZ]", "[aeiou]{3}"), "doc_id", "left").join(C.attachment_start(b, "^[VW].*a", "^[A-F]"), "doc_id", "left")


TAILS = r""", tails AS (
  SELECT doc_id, coalesce(max(CASE WHEN kind = 'p' AND regexp_matches(text, '^[XYZ]') THEN pos END), max(CASE WHEN kind <> 'p' AND regexp_matches(text, '[aeiou]{3}') THEN pos END),
    min(CASE WHEN kind = 'p' AND regexp_matches(text, '[aeiou]{3}') AND i > c - greatest(20, c // 3) THEN pos END)) AS tail_start
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM blocks) GROUP BY doc_id
), bodies AS (SELECT doc_id, coalesce(min(CASE WHEN level = 1 THEN pos END), 0) AS body_start FROM blocks GROUP BY doc_id),
atts AS (
  SELECT doc_id, coalesce(min(CASE WHEN pos >= body_start AND regexp_matches(text, '^[VW].*a') THEN pos END), min(CASE WHEN direct_outline BETWEEN 0 AND 8 AND regexp_matches(text, '^[A-F]') THEN pos END)) AS attachment_start
  FROM blocks JOIN bodies USING (doc_id) GROUP BY doc_id
)"""
VISUAL = r"""kind = 'p' AND n <= 55 AND num_id IS NULL AND (CASE WHEN alignment = 'center' THEN 1 ELSE 0 END + CASE WHEN bold_fraction >= 0.5 THEN 1 ELSE 0 END + CASE WHEN max_font_size >= 28 THEN 1 ELSE 0 END) >= 2
  AND (row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 8 OR regexp_matches(text, 'tion')) AND coalesce(max(CASE WHEN kind = 'tbl' OR level IS NOT NULL OR n > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) = 1"""

CANDIDATES = NUMBERED + f""", v AS (SELECT *, {VISUAL} AS visual, regexp_matches(text, '^[A-M]') AND (length(text) <= 16 OR regexp_matches(text, 'tion')) AS label, {FAMILY} AS family, {ORDINAL} AS ordinal FROM (SELECT * REPLACE (length(text) AS n) FROM numbered)),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM v WHERE kind = 'p' AND trim(text, ' ') <> ''),
x AS (SELECT *, coalesce(direct_outline BETWEEN 0 AND 8, false) AS outlined, alignment = 'center' AS center, bold_fraction >= 0.5 AS bold, max_font_size >= 28 AS large, place <= 8 AND length(text) <= 80 AS opening FROM w),
candidates AS (SELECT doc_id, pos, family, ordinal, family = 'subattachment' OR (outlined AND family <> 'unnumbered') AS required,
  list_filter([CASE WHEN outlined THEN 'outline:' || direct_outline END, 'deterministic_level:' || level, CASE WHEN family <> 'unnumbered' THEN 'number:' || family END, CASE WHEN visual THEN 'visual_title' END, CASE WHEN label THEN 'plain_label' END, CASE WHEN center THEN 'center' END, CASE WHEN bold THEN 'bold' END, CASE WHEN large THEN 'large_font' END, CASE WHEN opening THEN 'attachment_opening' END], lambda s: s IS NOT NULL) AS signals
  FROM x WHERE outlined OR family <> 'unnumbered' OR visual OR label OR ((center OR bold OR large) AND length(text) <= 120) OR opening)"""
REQUIRED = CANDIDATES + """, g AS (SELECT *, CASE WHEN ordinal = lag(ordinal) OVER (PARTITION BY doc_id, family, ordinal IS NULL ORDER BY pos) + 1 THEN 0 ELSE 1 END AS b FROM candidates),
h AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, family, ordinal IS NULL ORDER BY pos) AS isl FROM g),
needed AS (SELECT doc_id, pos, family, ordinal, required OR (family <> 'unnumbered' AND ordinal IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, family, ordinal IS NULL, isl) >= 2) AS required FROM h)"""


def familied(s, d):
    return numbered(s, d).withColumn("family", C.number_family(F.col("text")))


def candidates(s, d):
    b = C.visual_title(familied(s, d), "tion").withColumns({"outline": F.col("direct_outline"), "plain_label": C.plain_label(F.col("text"), "^[A-M]", "tion")})
    return C.hierarchy_candidates(b)


Q = {
    "b01_run_stats": (lambda s, d: B.run_stats(runs(s, d)), f"WITH {RUNS} SELECT doc_id, pos, CAST(sum(CASE WHEN bold THEN length(text) ELSE 0 END) AS DOUBLE) / sum(length(text)) AS bold_fraction, max(font_size) AS max_font_size FROM runs WHERE length(text) > 0 GROUP BY doc_id, pos"),
    "b02_style_outline": (
        lambda s, d: B.resolve_style_outline(styles(s, d)).select("style_id", "style_outline"),
        "SELECT s_suppkey AS style_id, CASE WHEN (s_suppkey // 5 * 5) <= (SELECT max(s_suppkey) FROM supplier) THEN CAST((s_suppkey // 5 * 5) % 9 AS INT) END AS style_outline FROM supplier",
    ),
    "b03_effective_outline": (lambda s, d: blocks(s, d).select("doc_id", "pos", B.effective_outline(F.col("direct_outline"), F.col("level") - 1).alias("outline")), f"WITH {BLOCKS} SELECT doc_id, pos, coalesce(direct_outline, level - 1) AS outline FROM blocks"),
    "b04_number_blocks": (
        lambda s, d: B.number_blocks(blocks(s, d), levels_table(s)).select("doc_id", "pos", "number_text"),
        f"WITH {BLOCKS}, k AS (SELECT doc_id, pos, num_id, num_ilvl, row_number() OVER (PARTITION BY doc_id, num_id, num_ilvl ORDER BY pos) AS i FROM blocks)"
        " SELECT doc_id, pos, CASE WHEN num_id = 'n1' AND num_ilvl = 0 THEN i || '.' WHEN num_id = 'n1' THEN '(' || CASE WHEN i <= 26 THEN chr(CAST(64 + i AS INT)) ELSE CAST(i AS VARCHAR) END || ')'"
        " WHEN num_id = 'n2' AND num_ilvl = 0 THEN CASE WHEN (i + 2) // 10 > 1 THEN substr('一二三四五六七八九', (i + 2) // 10, 1) ELSE '' END || CASE WHEN (i + 2) // 10 > 0 THEN '十' ELSE '' END || CASE WHEN (i + 2) % 10 > 0 THEN substr('一二三四五六七八九', (i + 2) % 10, 1) ELSE '' END || '、'"
        " WHEN num_id = 'n2' THEN CASE WHEN i + 1 <= 26 THEN chr(CAST(97 + i AS INT)) ELSE CAST(i + 1 AS VARCHAR) END || ')' END AS number_text FROM k",
    ),
    "b06_number_spacing": (
        lambda s, d: blocks(s, d).select("doc_id", "pos", T.normalize_number_spacing(F.expr(SPACED)).alias("text")),
        f"WITH {BLOCKS} SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN pos || '.' || text WHEN 1 THEN '十二、' || text WHEN 2 THEN pos || '、 ' || text ELSE pos || ' )' || text END AS text FROM blocks",
    ),
    "b07_apply_prefix": (
        lambda s, d: numbered(s, d).select("doc_id", "pos", B.apply_prefix(F.col("text"), F.concat(F.lit(" "), F.col("num_id"), F.lit("- "))).alias("text")),
        f"WITH {NUMBERED} SELECT doc_id, pos, CASE WHEN num_id IS NULL OR regexp_matches(text, '^\\d+[.、]') THEN text ELSE num_id || '-' || text END AS text FROM numbered",
    ),
    "b08_assign_anchors": (lambda s, d: B.assign_anchors(blocks(s, d)).select("doc_id", "pos", "anchor"), f"WITH {BLOCKS} SELECT doc_id, pos, kind || '_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS VARCHAR), 4, '0') AS anchor FROM blocks"),
    "b09_assign_pages": (
        lambda s, d: B.assign_pages(blocks(s, d)).select("doc_id", "pos", "page_start", "page_end"),
        f"WITH {BLOCKS}, w AS (SELECT doc_id, pos, page_breaks, sum(page_breaks) OVER (PARTITION BY doc_id ORDER BY pos) AS u, sum(page_breaks) OVER (PARTITION BY doc_id) AS t FROM blocks) SELECT doc_id, pos, CAST(CASE WHEN t > 0 THEN 1 + u - page_breaks END AS BIGINT) AS page_start, CAST(CASE WHEN t > 0 THEN 1 + u END AS BIGINT) AS page_end FROM w",
    ),
    "b10_drop_revisions": (lambda s, d: B.drop_revisions(runs(s, d)).groupBy("doc_id").agg(F.count("*").alias("n")), f"WITH {RUNS} SELECT doc_id, count(*) AS n FROM runs WHERE coalesce(revision, '') NOT IN ('del', 'moveFrom') GROUP BY doc_id"),
    "b11_visible_text": (lambda s, d: B.visible_text(B.drop_revisions(runs(s, d))), f"WITH {RUNS} SELECT doc_id, pos, trim(string_agg(text, '' ORDER BY run_no), ' ') AS text FROM runs WHERE coalesce(revision, '') NOT IN ('del', 'moveFrom') GROUP BY doc_id, pos"),
    "b12_table_text": (
        lambda s, d: B.table_text(cells(s, d)),
        f"WITH {CELLS}, w AS (SELECT doc_id, table_id, row, string_agg(text, chr(9) ORDER BY cell_no) AS text, bool_or(trim(text, ' ') <> '') AS f FROM cells GROUP BY ALL) SELECT doc_id, table_id, coalesce(string_agg(text, chr(10) ORDER BY row) FILTER (f), '[TABLE]') AS text FROM w GROUP BY doc_id, table_id",
    ),
    "b13_restore_grid": (
        lambda s, d: B.restore_grid(cells(s, d)),
        f"""WITH {CELLS}, o AS (SELECT *, CAST(first_value(grid_before) OVER w + sum(grid_span) OVER w - grid_span AS INT) AS first_col FROM cells WINDOW w AS (PARTITION BY doc_id, table_id, row ORDER BY cell_no)),
        s AS (SELECT *, unnest(range(first_col, first_col + grid_span)) AS c FROM o), t AS (SELECT *, last_value(CASE WHEN vmerge = 'restart' THEN row WHEN vmerge IS NULL THEN -1 END IGNORE NULLS) OVER u AS lr,
          last_value(CASE WHEN vmerge = 'restart' THEN first_col WHEN vmerge IS NULL THEN -1 END IGNORE NULLS) OVER u AS lc FROM s WINDOW u AS (PARTITION BY doc_id, table_id, c ORDER BY row ROWS UNBOUNDED PRECEDING))
        SELECT doc_id, table_id, row, CAST(c AS INT) AS col, cell_no, CASE WHEN h THEN lr ELSE row END AS origin_row, CASE WHEN h THEN lc ELSE first_col END AS origin_col,
          CASE WHEN h AND c > first_col THEN 'merged_inherited' WHEN h THEN 'vertical_inherited' WHEN c > first_col THEN 'horizontal_inherited' ELSE 'original' END AS slot
        FROM (SELECT *, coalesce(vmerge = 'continue' AND lr >= 0, false) AS h FROM t)""",
    ),
    "b14_source_refs": (lambda s, d: B.source_refs(cells(s, d)).select("doc_id", "table_id", "row", "cell_no", "source_ref"), f"WITH {CELLS} SELECT doc_id, table_id, row, cell_no, 'S' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, table_id ORDER BY row, cell_no) AS VARCHAR), 4, '0') AS source_ref FROM cells WHERE trim(text, ' ') <> ''"),
    "b15_render_rows": (
        lambda s, d: B.render_rows(B.render_cells(logical(s, d))).select("doc_id", "table_id", "row", "markdown", F.array_join("source_refs", ",").alias("source_refs")),
        f"WITH {LOGICAL} SELECT doc_id, table_id, row, '| ' || string_agg(md, ' | ' ORDER BY col) || ' | ' || chr(10) AS markdown, coalesce(string_agg(ref, ',' ORDER BY col) FILTER (first_in_row), '') AS source_refs FROM rendered GROUP BY ALL",
    ),
    "b15_cell_ranges": (
        lambda s, d: B.render_cells(logical(s, d)).select("doc_id", "table_id", "row", "col", "slot", "md_start", "md_end"),
        f"WITH {LOGICAL}, sizes AS (SELECT doc_id, table_id, row, 3 + sum(length(md) + 3) AS size, max(col) + 1 AS wide FROM rendered GROUP BY ALL), offs AS (SELECT *, length('<!-- table_id: ' || table_id || ' -->') + 1 + coalesce(sum(size) OVER (PARTITION BY doc_id, table_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN row_number() OVER (PARTITION BY doc_id, table_id ORDER BY row) > 1 THEN length('| ' || array_to_string(list_transform(range(wide), lambda i: '---'), ' | ') || ' |') + 1 ELSE 0 END AS o FROM sizes),"
        " c AS (SELECT r.*, o + 2 + coalesce(sum(length(md) + 3) OVER (PARTITION BY r.doc_id, r.table_id, r.row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM rendered r JOIN offs USING (doc_id, table_id, row)) SELECT doc_id, table_id, row, col, slot, CAST(a AS INT) AS md_start, CAST(a + length(md) AS INT) AS md_end FROM c",
    ),
    "b16_path_anchors": (
        lambda s, d: B.path_anchors(blocks(s, d), B.restore_grid(cells(s, d)), cells(s, d)).select("doc_id", "pos", "place", "path", "type", "text"),
        f"WITH {LOGICAL}, nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM blocks), inside AS (SELECT c.doc_id, nb.pos, i, l.row, l.col, c.text, row_number() OVER (PARTITION BY c.doc_id, nb.pos ORDER BY l.row, l.col) AS place FROM cells c JOIN logical l ON l.doc_id = c.doc_id AND l.table_id = c.table_id AND l.row = c.row AND l.cell_no = c.cell_no AND l.slot = 'original' JOIN nb ON nb.doc_id = c.doc_id AND nb.pos = c.table_id WHERE trim(c.text, ' ') <> '')"
        " SELECT doc_id, pos, 0 AS place, 'path:body/p' || i AS path, 'paragraph' AS type, text FROM nb WHERE kind = 'p'"
        " UNION ALL SELECT doc_id, pos, CAST(place AS INT), 'path:body/tbl' || i || '/r' || row || 'c' || (col + 1) || '/p1', 'paragraph', text FROM inside"
        " UNION ALL SELECT doc_id, pos, 1073741824, 'path:body/tbl' || i, 'table', string_agg(text, chr(10) ORDER BY row, col) FROM inside GROUP BY doc_id, pos, i",
    ),
    "b17_cell_sources": (
        lambda s, d: B.cell_sources(logical(s, d), 2, 0).select("doc_id", "table_id", F.array_join("source_refs", ",").alias("source_refs")),
        f"WITH {LOGICAL} SELECT doc_id, table_id, coalesce(ref, '') AS source_refs FROM rendered WHERE row = 2 AND col = 0",
    ),
    "b18_table_map": (
        lambda s, d: B.collect_table_map(logical(s, d), B.table_text(cells(s, d))).select("doc_id", "table_id", "text", "n_rows", "n_cols", F.array_join(F.transform("mapping", lambda x: F.concat_ws(":", x["row"].cast("string"), x["col"].cast("string"), x["slot"], F.array_join(x["source_refs"], "+"))), ",").alias("mapping")),
        f"WITH {LOGICAL}, w AS (SELECT doc_id, table_id, row, string_agg(text, chr(9) ORDER BY cell_no) AS text, bool_or(trim(text, ' ') <> '') AS f FROM cells GROUP BY ALL), t AS (SELECT doc_id, table_id, coalesce(string_agg(text, chr(10) ORDER BY row) FILTER (f), '[TABLE]') AS text FROM w GROUP BY doc_id, table_id)"
        " SELECT doc_id, table_id, any_value(t.text) AS text, count(DISTINCT row) AS n_rows, max(col) + 1 AS n_cols, string_agg(row || ':' || col || ':' || slot || ':' || coalesce(ref, ''), ',' ORDER BY row, col) AS mapping FROM rendered JOIN t USING (doc_id, table_id) GROUP BY doc_id, table_id",
    ),
    "c01_number_patterns": (
        lambda s, d: C.infer_number_pattern(examples(s, d)).select("profile", "level", F.array_join("kinds", ",").alias("kinds"), "pattern"),
        f"WITH {EXAMPLES} SELECT profile, level, kinds, pattern FROM patterns",
    ),
    "c01_pattern_errors": (
        lambda s, d: C.pattern_errors(examples(s, d), C.infer_number_pattern(examples(s, d))).select("profile", "level", "place", F.array_join(F.transform("matched", lambda x: x.cast("string")), ",").alias("matched")),
        f"WITH {EXAMPLES}, m AS (SELECT e.profile, e.level, place, kind, coalesce(string_agg(CAST(p.level AS VARCHAR), ',' ORDER BY p.level) FILTER (regexp_matches(e.text, p.pattern)), '') AS matched FROM ex e LEFT JOIN patterns p ON p.profile = e.profile GROUP BY ALL) SELECT profile, level, place, matched FROM m WHERE kind IS NULL OR matched <> CAST(level AS VARCHAR)",
    ),
    "c02_heading_level": (lambda s, d: blocks(s, d).select("doc_id", "pos", C.heading_level(F.col("text"), LEVELS).alias("found")), f"WITH {BLOCKS} SELECT doc_id, pos, {LEVEL_SQL} AS found FROM blocks"),
    "c03_score_profiles": (scores, f"WITH {PROFILES} SELECT * FROM scores"),
    "c04_select_profile": (lambda s, d: C.select_profile(scores(s, d, early(s, d))), f"WITH {BLOCKS}, cut AS (SELECT doc_id, coalesce(min(CASE WHEN regexp_matches(text, '^[VW].*a') THEN pos END), min(CASE WHEN direct_outline BETWEEN 0 AND 8 AND regexp_matches(text, '^[A-F].*z') THEN pos END)) AS z FROM blocks GROUP BY doc_id), scored AS (SELECT blocks.* FROM blocks JOIN cut USING (doc_id) WHERE z IS NULL OR pos < z) {SCORES} SELECT doc_id, arg_min(profile, CASE WHEN n1 >= 2 THEN rank ELSE 1000000 - score * 10 + rank END) AS profile FROM scores GROUP BY doc_id"),
    "c05_body_start": (lambda s, d: C.body_start(blocks(s, d)), f"WITH {BLOCKS} SELECT doc_id, coalesce(min(CASE WHEN level = 1 THEN pos END), 0) AS body_start FROM blocks GROUP BY doc_id"),
    "c05_without_profile": (
        lambda s, d: C.body_start_without_profile(blocks(s, d), "^[XYZ]", "^[A-D]"),
        f"WITH {BLOCKS} SELECT doc_id, coalesce(min(pos) FILTER (kind = 'p' AND regexp_matches(text, '^[XYZ]')), CASE WHEN count(*) FILTER (kind = 'p' AND regexp_matches(text, '^[A-D]')) >= 2 THEN min(pos) FILTER (kind = 'p' AND regexp_matches(text, '^[A-D]')) END, 0) AS body_start FROM blocks GROUP BY doc_id",
    ),
    "c06_attachment_start": (lambda s, d: C.attachment_start(blocks(s, d).withColumn("outline", F.col("direct_outline")), "^[VW].*a", "^[A-F]"), f"WITH {BLOCKS} {TAILS} SELECT * FROM atts"),
    "c07_tail_start": (lambda s, d: C.tail_start(blocks(s, d), "^[XYZ]", "[aeiou]{3}"), f"WITH {BLOCKS} {TAILS} SELECT * FROM tails"),
    "c08_regions": (
        lambda s, d: C.assign_regions(blocks(s, d).select("doc_id", "pos"), cuts(s, d)),
        f"WITH {BLOCKS} {TAILS}, e AS (SELECT doc_id, min(pos) AS a, max(pos) + 1 AS z FROM blocks GROUP BY doc_id), f AS (SELECT doc_id, a, z, greatest(body_start, a) AS b, coalesce(CASE WHEN attachment_start >= greatest(body_start, a) THEN attachment_start END, z) AS t, tail_start FROM e JOIN bodies USING (doc_id) JOIN tails USING (doc_id) JOIN atts USING (doc_id)),"
        " g AS (SELECT *, CASE WHEN tail_start >= b AND tail_start < t THEN tail_start END AS u FROM f), h AS (SELECT doc_id, 'frontmatter' AS region, a AS start, greatest(b, a + 1) AS stop FROM g UNION ALL SELECT doc_id, 'body', b, coalesce(u, t) FROM g UNION ALL SELECT doc_id, 'tail', u, t FROM g WHERE u IS NOT NULL UNION ALL SELECT doc_id, 'attachments', t, z FROM g)"
        " SELECT blocks.doc_id, pos, region FROM blocks JOIN h ON h.doc_id = blocks.doc_id AND pos >= start AND pos < stop",
    ),
    "c09_attachment_starts": (
        lambda s, d: C.attachment_starts(numbered(s, d).withColumn("outline", F.col("direct_outline")), r"^(\d+)\.", r"^\d*4\.", "^.*tion"),
        f"WITH {NUMBERED}, r AS (SELECT doc_id, pos, text, direct_outline, CASE WHEN regexp_extract(text, '^(\\d+)\\.', 1) <> '' AND NOT regexp_matches(text, '^\\d*4\\.') THEN regexp_extract(text, '^(\\d+)\\.', 1) END AS number FROM numbered WHERE kind = 'p')"
        " SELECT doc_id, number, max(pos) AS pos FROM r WHERE number IS NOT NULL GROUP BY ALL UNION ALL SELECT doc_id, number, pos FROM r WHERE number IS NULL AND direct_outline BETWEEN 0 AND 8 AND contains(text, 'tion')",
    ),
    "c10_visual_title": (lambda s, d: C.visual_title(blocks(s, d), "tion").where("visual_title").select("doc_id", "pos"), f"WITH {BLOCKS}, v AS (SELECT doc_id, pos, {VISUAL} AS v FROM blocks) SELECT doc_id, pos FROM v WHERE v"),
    "c11_plain_label": (lambda s, d: blocks(s, d).where(C.plain_label(F.col("text"), "^[A-M]", "tion")).select("doc_id", "pos"), f"WITH {BLOCKS} SELECT doc_id, pos FROM blocks WHERE regexp_matches(text, '^[A-M]') AND (n <= 16 OR regexp_matches(text, 'tion'))"),
    "c12_heading_score": (
        lambda s, d: C.heading_score(blocks(s, d).withColumns({"style_outline": F.col("level"), "in_attachment": F.col("pos") > 20})).select("doc_id", "pos", "score", F.array_join("evidence", ",").alias("evidence")),
        f"WITH {BLOCKS}, e AS (SELECT doc_id, pos, [CASE WHEN level IS NOT NULL THEN 'number_pattern' END, CASE WHEN direct_outline IS NOT NULL THEN 'direct_outline' END, CASE WHEN direct_outline IS NULL AND level IS NOT NULL THEN 'style_outline' END,"
        " CASE WHEN alignment = 'center' THEN 'center' END, CASE WHEN bold_fraction >= 0.5 THEN 'bold' END, CASE WHEN max_font_size >= 28 THEN 'large_font' END, CASE WHEN pos > 20 THEN 'inside_attachment' END] AS x FROM blocks)"
        " SELECT doc_id, pos, CAST(list_sum(list_transform(list_filter(x, lambda v: v IS NOT NULL), lambda v: CASE v WHEN 'number_pattern' THEN 2 WHEN 'direct_outline' THEN 4 WHEN 'style_outline' THEN 3 WHEN 'inside_attachment' THEN 2 ELSE 1 END)) AS INT) AS s0, array_to_string(list_filter(x, lambda v: v IS NOT NULL), ',') AS evidence FROM e",
    ),
    "c13_number_family": (
        lambda s, d: familied(s, d).select("doc_id", "pos", "family", C.number_ordinal(F.col("text"), F.col("family")).alias("ordinal")),
        f"WITH {NUMBERED} SELECT doc_id, pos, {FAMILY} AS family, {ORDINAL} AS ordinal FROM numbered",
    ),
    "c14_candidates": (lambda s, d: candidates(s, d).select("doc_id", "pos", F.array_join("signals", ",").alias("signals"), "ordinal", "required"), f"WITH {CANDIDATES} SELECT doc_id, pos, array_to_string(signals, ',') AS signals, ordinal, required FROM candidates"),
    "c15_required": (lambda s, d: C.required_sequences(candidates(s, d)).select("doc_id", "pos", "required"), f"WITH {REQUIRED} SELECT doc_id, pos, required FROM needed"),
    "c16_next_text": (lambda s, d: C.next_text(blocks(s, d)).select("doc_id", "pos", "next_text"), f"WITH {BLOCKS} SELECT doc_id, pos, substr(lead(text) OVER (PARTITION BY doc_id ORDER BY pos), 1, 100) AS next_text FROM blocks"),
    "c17_pattern_summary": (
        lambda s, d: C.pattern_summary(familied(s, d)).select("doc_id", "family", "n", F.array_join("examples", "|").alias("examples")),
        f"WITH {NUMBERED}, f AS (SELECT doc_id, pos, text, {FAMILY} AS family FROM numbered), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, family ORDER BY pos) AS i FROM f) SELECT doc_id, family, count(*) AS n, string_agg(substr(text, 1, 120), '|' ORDER BY i) FILTER (i <= 3) AS examples FROM k GROUP BY doc_id, family",
    ),
    "c18_title_sequence": (
        lambda s, d: C.title_sequence_check(familied(s, d).where("level is not null").withColumns({"parent_id": F.col("source"), "ordinal": C.number_ordinal(F.col("text"), F.col("family"))})).select("doc_id", "pos", "previous", "gap"),
        f"WITH {NUMBERED}, o AS (SELECT doc_id, pos, {ORDINAL} AS o, lag({ORDINAL}) OVER (PARTITION BY doc_id, level ORDER BY pos) AS p FROM numbered WHERE level IS NOT NULL) SELECT doc_id, pos, p AS previous, o - p AS gap FROM o WHERE o - p <> 1",
    ),
    "d03_tokens": (
        lambda s, d: table(s, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.document_mode(T.estimate_tokens(F.col("text"))).alias("mode")),
        r"WITH t AS (SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, CAST(ceil((length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) / 1.6::DOUBLE + length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 4.0::DOUBLE) AS INT)) END AS tokens FROM documents)"
        " SELECT doc_id, tokens, CASE WHEN tokens <= 6000 THEN 'compact' WHEN tokens <= 20000 THEN 'paged' ELSE 'filtered' END AS mode FROM t",
    ),
    "d05_summary": (
        lambda s, d: table(s, d, "documents").select("doc_id", T.extractive_summary(F.col("text")).alias("summary")),
        r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(substr(t, 1, 180), ' ') || '...' END AS summary FROM f",
    ),
}
Q["c12_heading_score"] = (Q["c12_heading_score"][0], f"SELECT doc_id, pos, coalesce(s0, 0) AS score, evidence FROM ({Q['c12_heading_score'][1]})")
