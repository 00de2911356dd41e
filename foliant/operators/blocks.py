"""Enrichment of a document's blocks: a row for each paragraph or table, ordered by pos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from foliant.functions.text import CHINESE_NUMBER, normalize_number_spacing, strip
from foliant.sources.scratch import cut


def W() -> WindowSpec:  # noqa: N802
    """A document's rows in order."""
    return Window.partitionBy("doc_id").orderBy("pos")

DIGITS = "一二三四五六七八九"


def run_stats(runs: DataFrame) -> DataFrame:
    """Share of characters in bold runs and largest font of each block; empty runs don't count."""
    full = runs.where(F.length("text") > 0)
    n = F.length("text")
    return full.groupBy("doc_id", "pos").agg((F.sum(F.when(F.col("bold"), n).otherwise(0)) / F.sum(n)).alias("bold_fraction"), F.max("font_size").alias("max_font_size"))


def resolve_style_outline(styles: DataFrame) -> DataFrame:
    """doc_id, style_id, style_outline: the first outline up the based_on chain.

    Each round every style without an outline looks at the one it points to and
    takes over that one's outline or pointer, so chains of any length take as
    many rounds as their length has binary digits. A cycle or a missing style
    ends without an outline; an outline that is no number is none.
    """
    number = F.col("outline").try_cast("int")
    rows = cut(styles.select("doc_id", "style_id", number.alias("style_outline"), F.when(number.isNull(), F.col("based_on")).alias("_next")), "styles")
    rounds = (rows.count() + 1).bit_length()  # no chain is longer than there are styles; a cycle stays open to the end
    settled = rows.where("_next IS NULL").drop("_next")
    rows_open = rows.where("_next IS NOT NULL")
    base = rows
    for _ in range(rounds):
        if rows_open.isEmpty():
            break
        up = base.select("doc_id", F.col("style_id").alias("_next"), F.col("style_outline").alias("_outline"), F.col("_next").alias("_up"))
        base = rows_open.join(up, ["doc_id", "_next"], "left").select("doc_id", "style_id", F.col("_outline").alias("style_outline"), F.when(F.col("_outline").isNull(), F.col("_up")).alias("_next"))
        base = cut(base.unionByName(settled.withColumn("_next", F.lit(None).cast(rows.schema["_next"].dataType))), "styles")
        settled, rows_open = base.where("_next IS NULL").drop("_next"), base.where("_next IS NOT NULL")
    return base.select("doc_id", "style_id", "style_outline")


def effective_outline(direct: Column, style: Column) -> Column:
    return F.coalesce(direct, style)


def number_blocks(blocks: DataFrame, levels: DataFrame) -> DataFrame:
    """Add number_text: the counter of each (num_id, level), never reset by parents, put for %1 in the level's text."""
    w = Window.partitionBy("doc_id", "num_id", "num_ilvl").orderBy("pos")
    own = levels.select("num_id", F.col("ilvl").alias("num_ilvl"), "num_format", "level_text", "start")
    keyed = blocks.withColumn("_n", F.when(F.col("num_id").isNotNull(), F.row_number().over(w)))
    joined = keyed.join(own, ["num_id", "num_ilvl"], "left")
    value = format_number(F.col("num_format"), F.col("_n") - 1 + F.col("start"))
    return joined.withColumn("number_text", F.replace("level_text", F.lit("%1"), value)).drop("_n", "num_format", "level_text", "start")


def format_number(kind: Column, n: Column) -> Column:
    """Chinese numerals up to 99, letters up to 26, else digits."""
    digit = lambda x: F.substring(F.lit(DIGITS), x.cast("int"), F.lit(1))
    tens, ones = F.floor(n / 10), n % 10
    chinese = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, digit(ones)).otherwise(""))
    letter = F.char(F.lit(64) + n)
    plain = n.cast("long").cast("string")
    is_chinese = kind.isin("chineseCounting", "chineseCountingThousand", "ideographDigital")
    return (
        F.when(is_chinese & n.between(1, 99), chinese)
        .when((kind == "upperLetter") & n.between(1, 26), letter)
        .when((kind == "lowerLetter") & n.between(1, 26), F.lower(letter))
        .otherwise(plain)
    )


# Beginnings of texts that already show a number.
NUMBERED = [f"^第[{CHINESE_NUMBER}0-9]+[条章]", f"^[{CHINESE_NUMBER}]+、", f"^（[{CHINESE_NUMBER}0-9]+）", r"^\d+[、.]"]


def apply_prefix(text: Column, prefix: Column, shown: list[str] | None = None) -> Column:
    """prefix, trimmed, before text, unless there is none or the text shows a number; blanks behind the text's own number go."""
    clean, mark = normalize_number_spacing(text), strip(F.coalesce(prefix, F.lit("")))
    has = F.lit(False)
    for pattern in shown or NUMBERED:
        has = has | clean.rlike(pattern)
    return F.when((mark == "") | has, clean).otherwise(strip(F.concat(mark, clean)))


def assign_anchors(blocks: DataFrame) -> DataFrame:
    """Add anchor: p_0001, tbl_0001, ... by kind within the document."""
    w = Window.partitionBy("doc_id", "kind").orderBy("pos")
    return blocks.withColumn("anchor", F.format_string("%s_%04d", F.col("kind"), F.row_number().over(w)))


def assign_pages(blocks: DataFrame) -> DataFrame:
    """Add page_start and page_end from page breaks; null in documents without any."""
    upto = F.sum("page_breaks").over(W().rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("page_breaks").over(Window.partitionBy("doc_id"))
    return blocks.withColumns({"page_start": F.when(total > 0, 1 + upto - F.col("page_breaks")), "page_end": F.when(total > 0, 1 + upto)})


def drop_revisions(runs: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """Runs without deleted and moved-away text; with keep_deleted all runs."""
    return runs if keep_deleted else runs.where(~F.coalesce("revision", F.lit("")).isin("del", "moveFrom"))


def visible_text(runs: DataFrame) -> DataFrame:
    """doc_id, pos, text: runs joined in order, trimmed."""
    # numbers and texts in lists of their own, which have one order, are fewer bytes to shuffle than a list of pairs; nothing is null, as lists leave nulls out
    least = F.lit(-(1 << (63 if runs.schema["run_no"].dataType.typeName() == "long" else 31)))
    lists = runs.groupBy("doc_id", "pos").agg(F.collect_list(F.coalesce("run_no", least)).alias("n"), F.collect_list(F.coalesce("text", F.lit(""))).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.arrays_zip("n", "t")), lambda r: r["t"]), "")
    return lists.select("doc_id", "pos", F.trim(joined).alias("text"))


def _ordered(order: list[str], value: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value)))), lambda r: r[value]), sep)


def table_text(cells: DataFrame, empty: str = "[TABLE]") -> DataFrame:
    """doc_id, table_id, text: cells joined by tabs, rows by line breaks, rows of empty cells left out."""
    cell = cells.groupBy("doc_id", "table_id", "row", "cell_no").agg(_ordered(["para_no"], "text", "\n").alias("text"))
    row = cell.groupBy("doc_id", "table_id", "row").agg(_ordered(["cell_no"], "text", "\t").alias("text"), F.max(F.trim("text") != "").alias("full"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("full"), F.struct("row", "text")))), lambda r: r["text"]), "\n")
    return row.groupBy("doc_id", "table_id").agg(F.when(whole == "", empty).otherwise(whole).alias("text"))


def restore_grid(cells: DataFrame) -> DataFrame:
    """Grid slots of each table: doc_id, table_id, row, col, cell_no, origin_row, origin_col, slot.

    A row's cursor starts at its grid_before and moves by each cell's span;
    vertical merges continue the cell that was last restarted in the column. A
    continuation without one is a cell of its own.
    """
    one = cells.groupBy("doc_id", "table_id", "row", "cell_no").agg(F.max("grid_before").alias("grid_before"), F.max("grid_span").alias("span"), F.max("vmerge").alias("vmerge"))
    w = Window.partitionBy("doc_id", "table_id", "row").orderBy("cell_no")
    begin = F.first("grid_before").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    one = one.withColumn("first_col", (begin + F.sum("span").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("span")).cast("int"))
    slots = one.withColumn("col", F.explode(F.sequence(F.col("first_col"), F.col("first_col") + F.col("span") - 1)))
    up = Window.partitionBy("doc_id", "table_id", "col").orderBy("row")
    opens = F.struct("row", "first_col")
    last = F.last(F.when(F.col("vmerge") == "restart", opens).when(F.col("vmerge").isNull(), F.struct(F.lit(-1).alias("row"), F.lit(-1).alias("first_col"))), ignorenulls=True).over(up)
    inherits = (F.col("vmerge") == "continue") & (last["row"] >= 0)
    across = F.col("col") > F.col("first_col")
    slot = F.when(F.coalesce(inherits, F.lit(False)) & across, "merged_inherited").when(inherits, "vertical_inherited").when(across, "horizontal_inherited").otherwise("original")
    return slots.select("doc_id", "table_id", "row", "col", "cell_no", F.when(inherits, last["row"]).otherwise(F.col("row")).alias("origin_row"), F.when(inherits, last["first_col"]).otherwise(F.col("first_col")).alias("origin_col"), slot.alias("slot"))


def source_refs(cells: DataFrame) -> DataFrame:
    """Add source_ref: S0001, ... for each paragraph with text, in order within its table."""
    w = Window.partitionBy("doc_id", "table_id").orderBy("row", "cell_no", "para_no")
    return cells.where(F.trim("text") != "").withColumn("source_ref", F.format_string("S%04d", F.row_number().over(w)))


def logical_cells(grid: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, table_id, row, col, origin_row, origin_col, slot, sources: every place of a table's full grid.

    Places that no cell covers are of slot empty. sources: array of struct
    (source_ref, text) of the paragraphs of the cell that stands there, in
    order; its id is C0001, ... by first place if it has none. refs: source_refs().
    """
    key = ["doc_id", "table_id"]
    own = grid.where("slot = 'original'").select(*key, F.col("row").alias("origin_row"), F.col("col").alias("origin_col"), "cell_no")
    own = own.withColumn("cell_id", F.format_string("C%04d", F.row_number().over(Window.partitionBy(*key).orderBy("origin_row", "cell_no"))))
    paragraphs = refs.groupBy(*key, F.col("row").alias("origin_row"), "cell_no").agg(F.array_sort(F.collect_list(F.struct("source_ref", "text"))).alias("sources"))
    own = own.join(paragraphs, [*key, "origin_row", "cell_no"], "left").drop("cell_no")
    wide = grid.groupBy(*key).agg(F.max("col").alias("_last"), F.collect_set("row").alias("_rows"))
    places = wide.select(*key, F.explode("_rows").alias("row"), "_last").select(*key, "row", F.explode(F.sequence(F.lit(0), "_last")).alias("col"))
    full = places.join(grid.drop("cell_no"), [*key, "row", "col"], "left").join(own, [*key, "origin_row", "origin_col"], "left")
    none = F.array().cast("array<struct<source_ref:string,text:string>>")
    return full.select(*key, "row", "col", F.coalesce("origin_row", "row").alias("origin_row"), F.coalesce("origin_col", "col").alias("origin_col"), F.coalesce("slot", F.lit("empty")).alias("slot"), "cell_id", F.coalesce("sources", none).alias("sources"))


def _escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.regexp_replace(text, r"([\\|])", r"\\$1"), F.lit("\r"), F.lit("")), "\n", "<br>")


# Marks of inherited cells, by direction.
_LEFT, _ABOVE = "↳同左", "↳同上"


def render_cells(cells: DataFrame) -> DataFrame:
    """logical_cells() with markdown, md_start and md_end: each cell's text and its place in its table's markdown.

    Original cells have their paragraphs with their refs, inherited ones a mark
    that points to the cell they repeat. Offsets count characters.
    """
    key = ["doc_id", "table_id"]
    paragraphs = F.array_join(F.transform("sources", lambda x: F.concat(_escaped(x["text"]), F.lit(" ["), x["source_ref"], F.lit("]"))), "<br>")
    target = F.coalesce(F.try_element_at("sources", F.lit(1))["source_ref"], "cell_id", F.lit(""))
    mark = F.concat(F.when(F.col("slot") == "horizontal_inherited", _LEFT).otherwise(_ABOVE), target)
    text = F.when(F.col("slot") == "original", paragraphs).when((F.col("slot") == "empty") | (target == ""), "").otherwise(mark)
    w = Window.partitionBy(*key).orderBy("row", "col")
    before = F.sum(F.length("markdown") + 3).over(w) - F.length("markdown") - 3
    out = cells.withColumn("markdown", text).withColumns({"_cells": before, "_wide": F.max("col").over(Window.partitionBy(*key)) + 1})
    out = out.withColumn("_rows", F.dense_rank().over(Window.partitionBy(*key).orderBy("row")) - 1)
    head = F.length(_table_head(F.col("table_id")))
    # each row before adds its opening and line break, the first one the separator behind it
    start = head + F.col("_cells") + 2 + 3 * F.col("_rows") + F.when(F.col("_rows") > 0, 6 * F.col("_wide") + 2).otherwise(0)
    return out.withColumn("md_start", start.cast("int")).withColumn("md_end", (F.col("md_start") + F.length("markdown")).cast("int")).drop("_cells", "_wide", "_rows")


def _table_head(table: Column) -> Column:
    return F.concat(F.lit("<!-- table_id: "), table.cast("string"), F.lit(" -->\n"))


def render_rows(rendered: DataFrame) -> DataFrame:
    """doc_id, table_id, row, markdown, source_refs of each row of render_cells()."""
    refs = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("col", "sources"))), lambda x: F.transform(x["sources"], lambda y: y["source_ref"]))))
    return rendered.groupBy("doc_id", "table_id", "row").agg(F.concat(F.lit("| "), _ordered(["col"], "markdown", " | "), F.lit(" | \n")).alias("markdown"), F.max("col").alias("last"), refs.alias("source_refs"))


def render_tables(rows: DataFrame) -> DataFrame:
    """doc_id, table_id, markdown of whole tables from render_rows(): head, rows, and a separator behind the first."""
    first = F.row_number().over(Window.partitionBy("doc_id", "table_id").orderBy("row")) == 1
    separator = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("last") + 1), " | "), F.lit(" |\n"))
    lines = rows.withColumn("line", F.concat("markdown", F.when(first, separator).otherwise("")))
    return lines.groupBy("doc_id", "table_id").agg(F.concat(_table_head(F.col("table_id")), _ordered(["row"], "line", "")).alias("markdown"))


def markdown_spans(rendered: DataFrame) -> DataFrame:
    """doc_id, table_id, source_ref, md_start, md_end, synthetic: where each paragraph's own text stands, and marks that point to it."""
    sizes = F.transform("sources", lambda x: F.length(_escaped(x["text"])))
    # behind each paragraph stand its ref in brackets and, if another follows, a break
    own = rendered.where("slot = 'original'").select("doc_id", "table_id", "md_start", F.posexplode("sources").alias("i", "source"), sizes.alias("sizes"))
    at = F.col("md_start") + F.aggregate(F.slice("sizes", F.lit(1), F.col("i")), F.lit(0), lambda a, n: a + n) + F.col("i") * (F.length("source.source_ref") + 7)
    plain = own.select("doc_id", "table_id", "source.source_ref", at.alias("md_start"), (at + F.element_at("sizes", F.col("i") + 1)).alias("md_end"), F.lit(False).alias("synthetic"))
    marks = rendered.where("slot NOT IN ('original', 'empty') AND size(sources) > 0")
    return plain.unionByName(marks.select("doc_id", "table_id", F.element_at("sources", 1)["source_ref"].alias("source_ref"), "md_start", "md_end", F.lit(True).alias("synthetic")))


def path_anchors(blocks: DataFrame, grid: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, path, type, text in document order (pos, then place): paragraphs with text, those of table cells, and behind them their table.

    Paths count blocks, rows and grid columns: path:body/p7,
    path:body/tbl3/r1c2/p1. A merged cell's paragraphs stand at its first place
    alone. table_id is the table's pos.
    """
    numbered = blocks.withColumn("_i", F.row_number().over(W()))
    at = lambda kind: F.concat(F.lit("path:body/"), F.lit(kind), F.col("_i").cast("string"))
    plain = numbered.where((F.col("kind") == "p") & (strip(F.col("text")) != "")).select("doc_id", "pos", F.lit(0).alias("place"), at("p").alias("path"), F.lit("paragraph").alias("type"), strip(F.col("text")).alias("text"))
    tables = numbered.where("kind <> 'p'").select("doc_id", "pos", "_i")
    own = grid.where("slot = 'original'").select("doc_id", "table_id", "row", "cell_no", "col")
    inside = cells.where(strip(F.col("text")) != "").join(own, ["doc_id", "table_id", "row", "cell_no"]).withColumnRenamed("table_id", "pos").join(tables, ["doc_id", "pos"])
    order = Window.partitionBy("doc_id", "pos").orderBy("row", "col", "para_no")
    inside = inside.withColumns({"text": strip(F.col("text")), "place": F.row_number().over(order), "path": F.concat(at("tbl"), F.format_string("/r%dc%d/p%d", F.col("row"), F.col("col") + 1, F.col("para_no")))})
    cell = inside.groupBy("doc_id", "pos", "_i", "row", "col").agg(_ordered(["para_no"], "text", " ").alias("text"))
    whole = cell.groupBy("doc_id", "pos", "_i").agg(_ordered(["row", "col"], "text", "\n").alias("text"))
    whole = whole.select("doc_id", "pos", F.lit(1 << 30).alias("place"), at("tbl").alias("path"), F.lit("table").alias("type"), "text")
    return plain.unionByName(inside.select("doc_id", "pos", "place", "path", F.lit("paragraph").alias("type"), "text")).unionByName(whole)


def cell_sources(cells: DataFrame, row: int, col: int) -> DataFrame:
    """doc_id, table_id, source_refs of the cell that stands at a row and column of each table's grid, from logical_cells()."""
    return cells.where((F.col("row") == row) & (F.col("col") == col)).select("doc_id", "table_id", F.transform("sources", lambda x: x["source_ref"]).alias("source_refs"))


def collect_table_map(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, table_id, text, n_rows, n_cols, mapping: of each table its text (table_text()) and all places of its grid, in order."""
    place = F.struct("row", "col", "origin_row", "origin_col", "slot", F.transform("sources", lambda x: x["source_ref"]).alias("source_refs"))
    out = cells.groupBy("doc_id", "table_id").agg(F.countDistinct("row").alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.array_sort(F.collect_list(place)).alias("mapping"))
    return out.join(texts, ["doc_id", "table_id"], "left").select("doc_id", "table_id", "text", "n_rows", "n_cols", "mapping")
