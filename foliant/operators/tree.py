"""Section trees: nodes from headings, spans, owners and token-bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from foliant.functions.text import estimate_tokens, extractive_summary, tokens_of, truncate, wide_characters
from foliant.operators.greedy import greedy_batches, overlapping_batches
from foliant.operators.sweep import covered, owner, ranks
from foliant.sources.scratch import cut
from foliant.sources.spread import spread
from foliant.sources.workers import give_back


def W() -> WindowSpec:  # noqa: N802
    """A document's rows in order."""
    return Window.partitionBy("doc_id").orderBy("pos")


def build_hierarchy(headings: DataFrame, ends: DataFrame, levels: int = 3, root: str = "body", first: str = "sec", below: str = "l") -> DataFrame:
    """Nodes of headings (doc_id, pos, level, title); ends has each document's range end (exclusive).

    A node's parent is the nearest heading before it of a smaller level, its
    end the next heading of no larger level. Ids are body/sec_001 at level 1,
    parent/l2_001 below; ordinals count siblings of one level.
    """
    h = headings
    before, after = W().rowsBetween(Window.unboundedPreceding, -1), W().rowsBetween(1, Window.unboundedFollowing)
    for k in range(1, levels + 1):
        at = F.when(F.col("level") == k, F.col("pos"))
        h = h.withColumns({f"_p{k}": F.last(at, True).over(before), f"_n{k}": F.first(at, True).over(after)})
    pick = lambda kind, f, test: f(*(F.when(test(k), F.col(f"_{kind}{k}")) for k in range(1, levels + 1)), F.lit(None).cast("int"))
    h = h.withColumns({"parent_pos": pick("p", F.greatest, lambda k: F.col("level") > k), "_next": pick("n", F.least, lambda k: F.col("level") >= k)})
    h = h.join(ends, "doc_id", "left").withColumn("end_pos", F.coalesce("_next", "range_end"))
    h = h.drop("_next", "range_end", *(f"_{a}{k}" for a in "pn" for k in range(1, levels + 1)))
    w = Window.partitionBy("doc_id", "parent_pos", "level").orderBy("pos")
    h = h.withColumn("ordinal", F.row_number().over(w))
    own = F.format_string("%s_%03d", F.when(F.col("level") == 1, first).otherwise(F.concat(F.lit(below), F.col("level").cast("string"))), F.col("ordinal"))
    # ids pass down within a document's order: a level's parents are known once the levels above it are
    inside = F.col("level").between(1, levels)

    def below_of(up: Column) -> Column:
        parent = F.coalesce(up["node_id"], F.lit(root))
        return F.struct(F.concat(parent, F.lit("/"), own).alias("node_id"), parent.alias("parent_id"), (F.coalesce(up["depth"], F.lit(0)) + 1).alias("depth"))

    h = h.withColumn("_node", F.when(F.col("parent_pos").isNull(), below_of(F.lit(None).cast("struct<node_id:string,depth:int>"))))
    for k in range(2, levels + 2):
        mine = F.col("parent_pos").isNotNull() & ((F.col("level") == k) if k <= levels else (F.col("level") > levels))
        h = h.withColumn("_up", F.last(F.when(inside & (F.col("level") < k), F.col("_node")), True).over(before))
        h = h.withColumn("_node", F.when(mine, below_of(F.col("_up"))).otherwise(F.col("_node"))).drop("_up")
    return h.select("*", "_node.node_id", "_node.parent_id", "_node.depth").drop("_node").where(F.col("depth") <= levels)


def hierarchy_nodes(headings: DataFrame, ends: DataFrame, root: str, levels: int = 6) -> DataFrame:
    """build_hierarchy() of an inferred hierarchy below root: ids root/h1_001, parent/h2_001, up to six levels."""
    return build_hierarchy(headings, ends, levels, root, "h1", "h")


def _line(with_tables: bool) -> Column:
    wanted = F.lit(True) if with_tables else F.col("kind") == "p"
    return F.when(wanted & (F.col("text") != ""), F.col("text"))


def _measured(nodes: DataFrame, blocks: DataFrame, with_tables: bool) -> DataFrame:
    """nodes with first, stop (see ranks()) and _tokens of the lines in their span, joined: from running sums of the lines' characters, so that no text is put together for it."""
    line = _line(with_tables)
    spans = ranks(blocks, nodes, ["node_id"], {"_chars": F.length(line) + 1, "_wide": wide_characters(line)})
    # a line end stands behind each line but the last
    tokens = tokens_of(F.greatest(F.col("_chars") - 1, F.lit(0)), F.col("_wide"))
    return nodes.join(spans.select("doc_id", "node_id", "first", "stop", tokens.alias("_tokens")), ["doc_id", "node_id"], "left").withColumn("_tokens", F.coalesce("_tokens", F.lit(0)))


def measure_nodes(nodes: DataFrame, blocks: DataFrame, with_tables: bool = False) -> DataFrame:
    """nodes with the tokens that materialize_nodes() gives them, without their texts."""
    return _measured(nodes, blocks, with_tables).withColumn("tokens", F.col("_tokens")).drop("first", "stop", "_tokens")


def materialize_nodes(nodes: DataFrame, blocks: DataFrame, with_tables: bool = False, only: str | None = None) -> DataFrame:
    """Add text (of paragraphs in the span, line by line, and of tables if asked for), tokens, summary, and, where blocks have them, start and end anchor and page range; spans are [pos, end_pos).

    A document's blocks are an array, of which a node takes a slice: texts are
    moved once, not for each node above them. only names a boolean column:
    where it is not true, text is null.
    """
    more = [c for c in ("anchor", "page_start", "page_end") if c in blocks.columns]
    line = F.struct("pos", _line(with_tables).alias("line"), *more)
    arrays = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("_b"))
    own = [c for c in nodes.columns if c != "doc_id"]
    each = _measured(nodes, blocks, with_tables).groupBy("doc_id").agg(F.collect_list(F.struct(*own, "first", "stop", "_tokens")).alias("_n"))

    def found(n: Column) -> Column:
        size = F.coalesce(n["stop"] - n["first"], F.lit(0)).cast("int")
        part = F.slice(F.coalesce("_b", F.array().cast(arrays.schema["_b"].dataType)), (F.coalesce(n["first"], F.lit(0)) + 1).cast("int"), size)
        text = F.array_join(part["line"], "\n")
        out = [(text if only is None else F.when(n[only], text)).alias("text"), n["_tokens"].alias("_tokens")]
        if "anchor" in more:
            out += [F.get(part["anchor"], F.lit(0)).alias("start_anchor"), F.get(part["anchor"], size - 1).alias("end_anchor")]
        if "page_start" in more:
            out += [F.array_min(part["page_start"]).alias("page_start"), F.array_max(part["page_end"]).alias("page_end")]
        return F.struct(*(n[c].alias(c) for c in own), *out)

    out = each.join(arrays, "doc_id", "left").select("doc_id", F.explode(F.transform("_n", found)).alias("n")).select("doc_id", "n.*")
    out = out.withColumn("tokens", F.col("_tokens")).drop("_tokens")
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.col("text"))
    return out.withColumn("summary", extractive_summary(F.when(F.col("tokens") >= 300, F.col("text")).otherwise(title)))


def split_long_leaves(leaves: DataFrame, blocks: DataFrame, threshold: int = 1000, target: int = 700) -> DataFrame:
    """doc_id, node_id, chunk, start_pos, end_pos (inclusive), tokens: pieces of leaves above threshold tokens; tables weigh nothing; a single piece is none."""
    items = blocks.select("doc_id", "pos", F.when(F.col("kind") == "tbl", 0).otherwise(estimate_tokens(F.col("text"))).alias("w"))
    items = cut(items, "items")
    long = ranks(items, leaves, ["node_id"], F.col("w")).where(F.col("weight") > threshold)
    folded = greedy_batches(covered(items, long), ["doc_id", "node_id"], "pos", "w", target, flush_empty=False, batch="chunk", carry=["w"])
    chunks = folded.groupBy("doc_id", "node_id", "chunk").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.sum("w").alias("tokens"))
    return chunks.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "node_id"))).where("_n > 1").drop("_n")


def attach_tables(tables: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tables with their deepest covering node, its depth + 1 as level, and the ordinal under it."""
    owned = owner(tables, nodes, "depth", keep=False, also=["depth"])
    w = Window.partitionBy("doc_id", "node_id").orderBy("pos")
    return owned.withColumns({"level": F.col("depth") + 1, "ordinal": F.row_number().over(w)}).drop("depth")


def own_anchors(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Anchors with the last node in pre-order whose range covers them; orphans keep a null."""
    return owner(anchors, nodes, "pos")


def split_large_tables(rows: DataFrame, limit: int = 20000, target: int = 18000) -> DataFrame:
    """doc_id, table_id, chunk, first_row, last_row, name, and text if rows have any: row chunks of tables above limit tokens.

    rows: doc_id, table_id, row, tokens, and text with columns for text (as
    markdown lines). Each chunk repeats the header (row 1) and counts its
    tokens; a header that leaves no room gives each row a chunk of its own. A
    table of a header alone has one chunk. Rows are ordered, not numbered
    throughout: names count them from 2.
    """
    key = ["doc_id", "table_id"]
    total = Window.partitionBy(*key)
    order = total.orderBy("row")
    # by document alone, which is never a constant that the plan drops from the keys
    large = spread(rows, ["doc_id"]).withColumns({"_n": F.row_number().over(order), "_all": F.sum("tokens").over(total)}).where(F.col("_all") > limit)
    head = F.max(F.when(F.col("_n") == 1, F.col("tokens"))).over(total)
    text = ["text"] if "text" in rows.columns else []
    large = large.withColumns({"_room": (F.lit(target) - head).cast("double"), "_rows": F.count("*").over(total)})
    # several branches read it
    large = cut(large.select(*key, "_n", "tokens", "_room", "_rows", *text, *(["columns"] if text else [])), "large")
    body = large.where("_n > 1").withColumnRenamed("_n", "_row")
    folded = greedy_batches(body, key, "_row", "tokens", "_room", batch="chunk", carry=text)
    lines = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "text"))), lambda x: x["text"]), "").alias("_lines")] if text else []
    out = folded.groupBy(*key, "chunk").agg(F.min("_row").alias("first_row"), F.max("_row").alias("last_row"), *lines)
    empty = [F.lit("").alias("_lines")] if text else []
    out = out.unionByName(large.where("_rows = 1").select(*key, F.lit(1).alias("chunk"), F.lit(2).alias("first_row"), F.lit(2).alias("last_row"), *empty))
    out = out.withColumn("name", F.format_string("rows_%04d_%04d", F.col("first_row"), F.col("last_row")))
    if not text:
        return out
    separator = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("columns")), " | "), F.lit(" |\n"))
    mark = F.concat(F.lit("<!-- table_id: "), F.col("table_id").cast("string"), F.lit(" -->\n"))
    heads = large.where("_n = 1").select(*key, F.concat(mark, "text", separator).alias("_head"))
    return out.join(heads, key).withColumn("text", F.concat("_head", "_lines")).drop("_head", "_lines")


def key_items(nodes: DataFrame, most: int = 8) -> DataFrame:
    """doc_id, parent_id, key_items: the first child titles of each node."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("pos")
    first = nodes.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    return first.groupBy("doc_id", "parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "title"))), lambda x: x["title"]).alias("key_items"))


def flatten_preorder(nodes: DataFrame) -> DataFrame:
    """Add preorder: place by start, parents before children."""
    return nodes.withColumn("preorder", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "depth")))


def structure_view(nodes: DataFrame) -> DataFrame:
    return nodes.select("doc_id", "node_id", "parent_id", "level", "title", "summary", "tokens")


def content_view(nodes: DataFrame) -> DataFrame:
    return nodes.select("doc_id", "node_id", "title", "text", "pos", "end_pos")


def sections_between(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """starts (doc_id, pos, ...) with ordinal and end_pos: up to the next start or the document's end."""
    out = starts.join(ends, "doc_id", "left").withColumns({"ordinal": F.row_number().over(W()), "_next": F.lead("pos").over(W())})
    return out.withColumn("end_pos", F.coalesce("_next", "range_end")).drop("_next", "range_end")


def attachment_nodes(blocks: DataFrame, starts: DataFrame, ends: DataFrame, parent: str = "attachments/parent") -> DataFrame:
    """doc_id, node_id, parent_id, node_type, title, pos, end_pos: a section for each start, and its flat children.

    starts: doc_id, pos; ends: doc_id, range_end. blocks: doc_id, pos, text and
    kind_of, which is heading, visual_title, plain_label or null. Every such
    block is a child of its section up to the next one or the section's end.
    """
    sections = sections_between(starts.select("doc_id", "pos"), ends)
    named = sections.join(blocks.select("doc_id", "pos", F.col("text").alias("title")), ["doc_id", "pos"], "left")
    own = named.select("doc_id", F.format_string("attachments/att_%03d", "ordinal").alias("node_id"), F.lit(parent).alias("parent_id"), F.lit("attachment_section").alias("node_type"), "title", "pos", "end_pos")
    marks = own.select("doc_id", "pos", F.struct("node_id", F.col("pos").alias("from"), F.col("end_pos").alias("to")).alias("_s"))
    last = F.last("_s", True).over(W().rangeBetween(Window.unboundedPreceding, 0))
    rows = blocks.where("kind_of IS NOT NULL").join(marks, ["doc_id", "pos"], "full_outer").withColumn("_s", last)
    # the section's own first block is its title
    rows = rows.where("kind_of IS NOT NULL AND _s IS NOT NULL AND pos > _s.from AND pos < _s.to").select("doc_id", "pos", "text", "kind_of", "_s")
    w = Window.partitionBy("doc_id", "_s.node_id").orderBy("pos")
    child = F.format_string("%s/%s_%03d", F.col("_s.node_id"), F.col("kind_of"), F.row_number().over(w))
    children = rows.select("doc_id", child.alias("node_id"), F.col("_s.node_id").alias("parent_id"), F.col("kind_of").alias("node_type"), F.col("text").alias("title"), "pos", F.coalesce(F.lead("pos").over(w), F.col("_s.to")).alias("end_pos"))
    return own.unionByName(children)


def _in_force(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """candidates with _s, the segment in force: the last that starts at or before them."""
    marks = segments.select("doc_id", F.col("start_pos").alias("pos"), F.struct("segment_no", "start_pos", "rules").alias("_s"), F.lit(0).alias("_k"))
    rows = candidates.withColumns({"_s": F.lit(None).cast(marks.schema["_s"].dataType), "_k": F.lit(1)})
    w = Window.partitionBy("doc_id").orderBy("pos", "_k", "_s.segment_no").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(rows, allowMissingColumns=True).withColumn("_s", F.last("_s", True).over(w))
    return both.where("_k = 1").drop("_k")


def apply_segments(candidates: DataFrame, segments: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Candidates (doc_id, pos, family) with segment_no and level of the segment in force: the last that starts at or before them.

    segments: doc_id, segment_no, start_pos, rules (map of family to level). A
    family without a rule has a null level. named: doc_id, pos, level of titles
    and further headings, which override the rules.
    """
    level = F.try_element_at(F.col("_s.rules"), F.col("family"))
    out = _in_force(candidates.select("doc_id", "pos", "family"), segments).select("doc_id", "pos", "family", F.col("_s.segment_no").alias("segment_no"), level.alias("level"))
    if named is None:
        return out
    best = named.groupBy("doc_id", "pos").agg(F.max_by("level", "level").alias("_level"))
    return out.join(best, ["doc_id", "pos"], "left").withColumn("level", F.coalesce("_level", "level")).drop("_level")


def segment_errors(candidates: DataFrame, segments: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, segment_no, error, detail: what is wrong with segments for candidates (doc_id, pos, family, required).

    unknown_start (no candidate there), duplicate_start, order (it starts before
    one of a smaller number), late_first (a required candidate stands before the
    first), level_range (detail: the family), missing_family (a required
    candidate's family has no rule; detail: the family).
    """
    # several branches read both; no texts are among them; Spark judges them by their compressed files, so no join may broadcast them
    candidates, segments = cut(candidates.select("doc_id", "pos", "family", "required"), "candidates"), cut(segments.select("doc_id", "segment_no", "start_pos", "rules"), "segments")
    known = candidates.select("doc_id", F.col("pos").alias("start_pos"), F.lit(True).alias("_known")).distinct()
    s = segments.join(known.hint("merge"), ["doc_id", "start_pos"], "left")
    again = F.row_number().over(Window.partitionBy("doc_id", "start_pos").orderBy("segment_no")) > 1
    before = F.max("start_pos").over(Window.partitionBy("doc_id").orderBy("segment_no").rowsBetween(Window.unboundedPreceding, -1))
    none = F.lit(None).cast("string").alias("detail")
    s = s.withColumns({"_again": again, "_before": before})
    wrong = F.array_compact(F.array(F.when(F.col("_known").isNull(), "unknown_start"), F.when(F.col("_again"), "duplicate_start"), F.when(F.col("start_pos") < F.col("_before"), "order")))
    starts = s.select("doc_id", "segment_no", F.explode(wrong).alias("error"), none)
    high = s.select("doc_id", "segment_no", F.explode("rules").alias("detail", "_level")).where(~F.col("_level").between(1, most))
    high = high.select("doc_id", "segment_no", F.lit("level_range").alias("error"), "detail")
    needed = _in_force(candidates.where("required").select("doc_id", "pos", "family"), segments)
    missing = needed.where(F.col("_s").isNotNull() & F.try_element_at(F.col("_s.rules"), F.col("family")).isNull())
    missing = missing.select("doc_id", F.col("_s.segment_no").alias("segment_no"), F.lit("missing_family").alias("error"), F.col("family").alias("detail")).distinct()
    first = segments.groupBy("doc_id").agg(F.min(F.struct("start_pos", "segment_no"))["segment_no"].alias("segment_no"))
    late = needed.where("_s IS NULL").select("doc_id").distinct().join(first.hint("merge"), "doc_id").select("doc_id", "segment_no", F.lit("late_first").alias("error"), none)
    return starts.unionByName(high).unionByName(missing).unionByName(late)


def resolve_heading(wanted: DataFrame, blocks: DataFrame, least: int = 12) -> DataFrame:
    """wanted (doc_id, anchor, title) with resolved: the anchor if its text has the title, else the only block whose text has it, else null.

    A text has a title if both are equal without white space and final dots, or
    begins with it if the title has least characters at least.
    """
    norm = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"[.。]+$", "")
    b = blocks.select("doc_id", F.col("anchor").alias("_a"), norm(F.col("text")).alias("_t"))
    w = wanted.withColumn("_title", norm(F.col("title")))
    # a title meets the texts that begin as it does: by its first characters, or all of it if it is short
    head = lambda c: F.substring(c, 1, least)
    pairs = w.select("doc_id", "_title").distinct().withColumn("_h", head(F.col("_title"))).join(b.withColumn("_h", head(F.col("_t"))), ["doc_id", "_h"])
    pairs = pairs.where((F.col("_t") == F.col("_title")) | ((F.length("_title") >= least) & F.startswith("_t", "_title")))
    hits = pairs.groupBy("doc_id", "_title").agg(F.collect_set("_a").alias("_all"), F.when(F.count("*") == 1, F.min("_a")).alias("_only"))
    out = w.join(hits, ["doc_id", "_title"], "left")
    return out.withColumn("resolved", F.when(F.array_contains("_all", F.col("anchor")), F.col("anchor")).otherwise(F.col("_only"))).drop("_title", "_all", "_only")


def hierarchy_errors(headings: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, pos, level, error: levels out of range, a first level other than 1, jumps down by more than one."""
    last = F.lag("level").over(W())
    error = F.when(~F.col("level").between(1, most), "range").when(last.isNull() & (F.col("level") != 1), "first").when(F.col("level") > last + 1, "jump")
    return headings.withColumn("error", error).where("error is not null").select("doc_id", "pos", "level", "error")


def batch_with_overlap(items: DataFrame, target: int, overlap: int) -> DataFrame:
    """doc_id, batch, start_pos, end_pos: overlapping batches of a document's items (doc_id, pos, w)."""
    return overlapping_batches(items, target, overlap)


# Types of nodes that are never expanded.
FINAL_TYPES = ("table", "table_chunk", "attachment_heading", "attachment_section", "attachment_parent")


def oversized_leaves(nodes: DataFrame, threshold: int, levels: int = 6) -> DataFrame:
    """Nodes without children above threshold tokens, with action: expand, or chunk from levels on. Tables and attachments stay as they are (node_type, if nodes have it)."""
    parents = nodes.select("doc_id", F.col("parent_id").alias("node_id")).distinct()
    out = nodes.join(parents, ["doc_id", "node_id"], "left_anti").where(F.col("tokens") > threshold)
    if "node_type" in nodes.columns:
        out = out.where(~F.coalesce(F.col("node_type").isin(*FINAL_TYPES), F.lit(False)))
    return out.withColumn("action", F.when(F.col("depth") >= levels, "chunk").otherwise("expand"))


def summary_inputs(nodes: DataFrame, least: int = 300, budget: int = 6000, table_budget: int = 20000, least_chars: int = 1000) -> DataFrame:
    """doc_id, node_id, content: of nodes with children a line for each child, of others their text; small leaves are left out.

    Contents above the budget of tokens (of tables, by node_type if nodes have
    it, a larger one) are cut in proportion, to least_chars at least, with three dots.
    """
    summary = F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(F.col("title"))
    lines = nodes.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- "), F.col("title"), F.lit(": "), summary).alias("s")))), lambda x: x["s"]), "\n").alias("_lines"))
    out = nodes.join(lines, ["doc_id", "node_id"], "left").where(F.col("_lines").isNotNull() | (F.col("tokens") >= least))
    content = F.coalesce("_lines", "text")
    cut = truncate(content, budget, least_chars, "...")
    if "node_type" in nodes.columns:
        cut = F.when(F.col("node_type").isin("table", "table_chunk"), truncate(content, table_budget, least_chars, "...")).otherwise(cut)
    return out.select("doc_id", "node_id", cut.alias("content"))


def pack_batches(tasks: DataFrame, limit: int = 20000, most: int = 10) -> DataFrame:
    """Tasks (doc_id, pos, tokens) in batches of at most most items and limit tokens."""
    return greedy_batches(tasks, ["doc_id"], "pos", "tokens", limit, max_items=most)


def apply_summaries(nodes: DataFrame, responses: DataFrame, tokens: int = 200, least_chars: int = 120) -> DataFrame:
    """nodes with the response's summary if not blank, cut to tokens (to least_chars at least), else their own."""
    out = nodes.join(responses.select("doc_id", "node_id", F.col("summary").alias("_s")), ["doc_id", "node_id"], "left")
    given = F.trim("_s")
    return out.withColumn("summary", F.when(given != "", truncate(given, tokens, least_chars)).otherwise(F.col("summary"))).drop("_s")


def index_stats(nodes: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """doc_id, level, n, tokens with subtotals (null level) and the total (null doc_id); with anchors (doc_id, kind) also n_anchors and n_tables of each document and in total."""
    out = nodes.rollup("doc_id", "level").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    if anchors is None:
        return out
    counts = anchors.rollup("doc_id").agg(F.count("*").alias("n_anchors"), F.count(F.when(F.col("kind") == "tbl", 1)).alias("n_tables"), F.grouping("doc_id").alias("_total"))
    out = out.withColumn("_total", F.col("doc_id").isNull().cast("int"))
    both = out.join(counts.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("level").isNull() & (out["_total"] == counts["_total"]), "left")
    return both.select("doc_id", "level", "n", "tokens", "n_anchors", "n_tables")


def largest(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of most tokens: a report, ties by id."""
    return nodes.orderBy(F.col("tokens").desc(), "doc_id", "node_id").limit(k).select("doc_id", "node_id", "tokens")


def token_rows(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.col("tokens").desc(), "node_id")
    return nodes.select("doc_id", "node_id", "tokens", F.row_number().over(w).alias("rank"))


# Types of nodes that are listed by their titles.
TITLE_TYPES = ("section", "attachment_parent", "attachment_section", "visual_title", "heading", "plain_label")


def title_rows(nodes: DataFrame) -> DataFrame:
    """Nodes of TITLE_TYPES with node_id, level, node_type, title, tokens and, where they have them, start and end anchor."""
    more = [x for x in ("start_anchor", "end_anchor") if x in nodes.columns]
    return nodes.where(F.col("node_type").isin(*TITLE_TYPES)).select("doc_id", "node_id", "level", "node_type", "title", "tokens", *more)


def type_counts(nodes: DataFrame) -> DataFrame:
    """doc_id, node_type, n, tokens with each document's subtotal (null type) and the total (null doc_id); nodes without a type count as unknown."""
    typed = nodes.withColumn("node_type", F.coalesce("node_type", F.lit("unknown")))
    return typed.rollup("doc_id", "node_type").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def attachment_tree(nodes: DataFrame, root: str = "attachments") -> DataFrame:
    """doc_id, node_id, parent_id, node_type, title, tokens, depth (from 1), path (titles from the top) of nodes below root, by the paths that ids are."""
    below = nodes.where(F.startswith("node_id", F.lit(f"{root}/")))
    parts = F.split(F.substring("node_id", len(root) + 2, 1 << 20), "/")
    each = below.select("doc_id", "node_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit(f"{root}/"), F.array_join(F.slice(parts, 1, i), "/")))).alias("_i", "_up"))
    titles = below.select("doc_id", F.col("node_id").alias("_up"), F.coalesce("title", F.lit("")).alias("_t"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda x: x["_t"])
    found = each.join(titles, ["doc_id", "_up"]).groupBy("doc_id", "node_id").agg(path.alias("path"))
    return below.join(found, ["doc_id", "node_id"]).select("doc_id", "node_id", "parent_id", "node_type", "title", "tokens", F.size("path").alias("depth"), "path")


def subtree(nodes: DataFrame, root: Column) -> DataFrame:
    """Nodes below (or equal to) root: by the path that an id is."""
    return nodes.where((F.col("node_id") == root) | F.startswith(F.col("node_id"), F.concat(root, F.lit("/"))))


def merge_batches(rows: DataFrame, most: int = 6, required: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, level: levels of overlapping batches (doc_id, batch, pos, level) on one scale.

    With required (doc_id, pos) a document gets no rows if any of those is
    missing, fewer than two headings are left, or hierarchy_errors() finds any.

    A batch is shifted by the most frequent difference on the positions that it
    shares with what is merged already (the first seen on ties), and clamped to
    1..most; positions keep the level of their first batch. A batch depends on
    those before it, so a document is merged as a whole, by its numbers alone.
    """

    @F.arrow_udf("array<struct<pos:int,level:int>>")
    def merged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            flat, out, at = part.flatten(), [], 0
            columns = [flat.field(c).to_pylist() for c in ("batch", "pos", "level")]
            for n in part.value_lengths().to_pylist():
                known: dict[int, int] = {}
                for _, rows in groupby(zip(*(c[at : at + n] for c in columns), strict=True), key=itemgetter(0)):
                    batch = [(pos, float("nan") if level is None else level) for _, pos, level in rows]
                    shift: dict[int, int] = {}
                    for pos, level in batch:
                        if pos in known:
                            shift[known[pos] - level] = shift.get(known[pos] - level, 0) + 1
                    offset = max(shift, key=shift.get) if shift else 0
                    for pos, level in batch:
                        known.setdefault(pos, min(most, max(1, level + offset)))
                out.append([{"pos": pos, "level": level} for pos, level in known.items()])
                at += n
            yield pa.array(out, pa.list_(pa.struct([("pos", pa.int32()), ("level", pa.int32())])))
            del part, flat, columns, out
            give_back()

    # null batches have no place among the others
    known = rows.where("batch IS NOT NULL").select("doc_id", F.struct("batch", "pos", "level").alias("_x"))
    each = known.groupBy("doc_id").agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    out = each.select("doc_id", F.explode(merged("_x")).alias("_y")).select("doc_id", "_y.pos", "_y.level")
    if required is None:
        return out
    lost = required.select("doc_id", "pos").join(out, ["doc_id", "pos"], "left_anti").select("doc_id")
    bad = lost.union(hierarchy_errors(out, most).select("doc_id")).union(out.groupBy("doc_id").count().where("count < 2").select("doc_id"))
    return out.join(bad.distinct(), "doc_id", "left_anti")


def split_structure(nodes: DataFrame, budget: int) -> DataFrame:
    """doc_id, parent_id, node_id, page: whole subtrees packed to budget tokens among their siblings.

    A subtree above the budget gives way to its children, under a page group of
    its own; a single node above it has a page for itself.
    """
    parts = F.split("node_id", "/")
    paths = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    sizes = nodes.select("doc_id", "tokens", paths.alias("node_id")).groupBy("doc_id", "node_id").agg(F.sum("tokens").alias("size"), F.count("*").alias("_k"))
    sized = nodes.select("doc_id", "node_id", "parent_id", "pos").join(sizes, ["doc_id", "node_id"])
    up = sized.select("doc_id", F.col("node_id").alias("parent_id"), F.col("size").alias("_above"))
    units = sized.join(up, ["doc_id", "parent_id"], "left").where(((F.col("size") <= budget) | (F.col("_k") == 1)) & (F.col("_above").isNull() | (F.col("_above") > budget)))
    return greedy_batches(units, ["doc_id", "parent_id"], "pos", "size", budget, batch="page", carry=["node_id"]).drop("pos")
