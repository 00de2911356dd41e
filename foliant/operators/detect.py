"""Detection of headings, regions and number sequences among a document's blocks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from foliant.functions.text import SPACE, strip


def W() -> WindowSpec:  # noqa: N802
    """A document's rows in order."""
    return Window.partitionBy("doc_id").orderBy("pos")


def ALL() -> WindowSpec:  # noqa: N802
    return Window.partitionBy("doc_id")


def BEFORE() -> WindowSpec:  # noqa: N802
    return W().rowsBetween(Window.unboundedPreceding, -1)


# Chinese numerals of the numbering families.
CHINESE = "一二三四五六七八九十百零〇两壹贰叁肆伍陆柒捌玖拾"
# Numbering families in the order in which they are tried.
FAMILIES = [
    ("subattachment", rf"^附件\s*[{CHINESE}0-9]+[-.]\d+"),
    ("chapter", rf"^第([{CHINESE}0-9]+)章"),
    ("article", rf"^第([{CHINESE}0-9]+)条"),
    ("section", rf"^第([{CHINESE}0-9]+)节"),
    ("cn_comma", rf"^[{CHINESE}]+[、.]"),
    ("cn_paren", rf"^[（(][{CHINESE}]+[）)]"),
    ("arabic_paren", r"^[（(]\d+[）)]"),
    ("arabic_multilevel", r"^\d+(?:\.\d+)+[.、）)]?"),
    ("arabic_comma", r"^\d+、"),
    ("arabic_dot", r"^\d+[.]"),
    ("arabic_close", r"^\d+[）)]"),
    ("letter", r"^[A-Za-z][.、）)]"),
]
# Numerals that stand for one digit.
ONES = {"零": 0, "〇": 0, "一": 1, "壹": 1, "二": 2, "两": 2, "贰": 2, "三": 3, "叁": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}

# Numerals, Roman and circled numbers of heading examples.
_CN = "一二三四五六七八九十百千万零〇两壹贰叁肆伍陆柒捌玖拾佰仟萬"
_ROMAN = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ"
_CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
# Kinds of numbers of heading examples, in the order in which they are tried, each with the pattern of all headings of its kind.
EXAMPLE_KINDS = [
    ("article", f"^第[{_CN}0-9]+条"),
    ("article", f"^第[{_CN}0-9]+章"),
    ("article", f"^第[{_CN}0-9]+节"),
    ("article", f"^第[{_CN}0-9]+部分"),
    ("arabic_multilevel", r"^\d+(?:[.．]\d+)+(?:[.．、])?"),
    ("arabic_parenthesized", r"^[（(]\d+[）)]"),
    ("chinese_parenthesized", f"^[（(][{_CN}]+[）)]"),
    ("chinese_delimited", f"^[{_CN}]+、"),
    ("chinese_delimited", f"^[{_CN}]+[.．]"),
    ("arabic_dot", r"^\d+[.．]"),
    ("arabic_comma", r"^\d+、"),
    ("arabic_closing_parenthesis", r"^\d+[)）]"),
    ("alphabetic", "^[A-Za-z][.．]"),
    ("alphabetic", "^[A-Za-z]、"),
    ("alphabetic", "^[A-Za-z]）"),
    ("alphabetic", r"^[A-Za-z]\)"),
    ("roman", f"^[{_ROMAN}]+[.．]"),
    ("roman", f"^[{_ROMAN}]+、"),
    ("roman", f"^[{_ROMAN}]+）"),
    ("roman", rf"^[{_ROMAN}]+\)"),
    ("circled", f"^[{_CIRCLED}]"),
    ("attachment", rf"^附件\s*[{_CN}0-9]+"),
]


def heading_level(text: Column, levels: list[tuple[int, str]]) -> Column:
    """The first level whose pattern fits, or null."""
    return F.coalesce(*(F.when(text.rlike(p), n) for n, p in levels))


def score_profiles(blocks: DataFrame, profiles: list[tuple[str, list[tuple[int, str]]]], weights: tuple[int, int, int, int] = (9, 4, 2, 8), until: DataFrame | None = None) -> DataFrame:
    """doc_id, profile, rank (declared order), n1 to n3, v1 to v3, orphans, score for each document and profile.

    Paragraphs with text count, before until's attachment_start if it is given.

    A level-2 heading counts if a level-1 one came before, a level-3 one if a
    counted level-2 one came since the last level-1 one; others are orphans.
    """
    parts = []
    blocks = blocks.where((F.col("kind") == "p") & (F.col("text") != ""))
    if until is not None:
        blocks = blocks.join(until, "doc_id", "left").where("attachment_start IS NULL OR pos < attachment_start").drop("attachment_start")
    for rank, (name, levels) in enumerate(profiles):
        lv = blocks.select("doc_id", "pos", heading_level(F.col("text"), levels).alias("level")).where("level is not null")
        last1 = F.max(F.when(F.col("level") == 1, F.col("pos"))).over(BEFORE())
        lv = lv.withColumn("_l1", last1).withColumn("_ok2", (F.col("level") == 2) & F.col("_l1").isNotNull())
        lv = lv.withColumn("_l2", F.max(F.when(F.col("_ok2"), F.col("pos"))).over(BEFORE()))
        ok3 = (F.col("level") == 3) & F.col("_l2").isNotNull() & (F.col("_l2") > F.coalesce("_l1", F.lit(-1)))
        n = lambda c: F.count(F.when(c, 1))
        each = lv.groupBy("doc_id").agg(*(n(F.col("level") == k).alias(f"n{k}") for k in (1, 2, 3)), n(F.col("level") == 1).alias("v1"), n(F.col("_ok2")).alias("v2"), n(ok3).alias("v3"))
        parts.append(each.withColumns({"profile": F.lit(name), "rank": F.lit(rank)}))
    out = reduce(DataFrame.unionByName, parts)
    orphans = F.col("n2") - F.col("v2") + F.col("n3") - F.col("v3")
    a, b, c, d = weights
    return out.withColumn("orphans", orphans).withColumn("score", a * F.col("v1") + b * F.col("v2") + c * F.col("v3") - d * F.col("orphans"))


def select_profile(scores: DataFrame) -> DataFrame:
    """doc_id, profile: the first declared one with two level-1 headings, else that of the highest score (first on ties)."""
    enough = F.when(F.col("n1") >= 2, 0).otherwise(1)
    key = F.struct(enough.alias("a"), F.when(enough == 0, F.lit(0)).otherwise(-F.col("score")).alias("b"), F.col("rank").alias("c"))
    return scores.groupBy("doc_id").agg(F.min_by("profile", key).alias("profile"))


def body_start(blocks: DataFrame) -> DataFrame:
    """doc_id, body_start: position of the first level-1 heading, else 0."""
    return blocks.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("level") == 1, F.col("pos"))), F.lit(0)).alias("body_start"))


def body_start_without_profile(blocks: DataFrame, section: str, listed: str) -> DataFrame:
    """doc_id, body_start: the first paragraph that begins as a section does, else the first of at least two listed ones, else 0."""
    at = lambda pattern: F.when((F.col("kind") == "p") & F.col("text").rlike(pattern), F.col("pos"))
    several = F.when(F.count(at(listed)) >= 2, F.min(at(listed)))
    return blocks.groupBy("doc_id").agg(F.coalesce(F.min(at(section)), several, F.lit(0)).alias("body_start"))


def attachment_start(blocks: DataFrame, formal: str, named: str) -> DataFrame:
    """doc_id, attachment_start: first formal heading from the body's start on, else the first outlined block of a given wording, else null."""
    start = blocks.join(body_start(blocks), "doc_id")
    first = F.min(F.when((F.col("pos") >= F.col("body_start")) & F.col("text").rlike(formal), F.col("pos")))
    other = F.min(F.when(F.col("outline").between(0, 8) & F.col("text").rlike(named), F.col("pos")))
    return start.groupBy("doc_id").agg(F.coalesce(first, other).alias("attachment_start"))


def tail_start(blocks: DataFrame, marker: str, signature: str) -> DataFrame:
    """doc_id, tail_start: last marker paragraph; else last signature table; else first signature line near the end."""
    n = F.count("*").over(ALL())
    rows = blocks.withColumns({"_n": n, "_i": F.row_number().over(W())})
    is_p, signs = F.col("kind") == "p", F.col("text").rlike(signature)
    late = F.col("_i") > F.col("_n") - F.greatest(F.lit(20), F.floor(F.col("_n") / 3))
    pick = lambda f, c: f(F.when(c, F.col("pos")))
    return rows.groupBy("doc_id").agg(F.coalesce(pick(F.max, is_p & F.col("text").rlike(marker)), pick(F.max, ~is_p & signs), pick(F.min, is_p & signs & late)).alias("tail_start"))


def region_ranges(blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """doc_id, region, start, stop: half-open ranges of positions, from the cuts body_start, tail_start and attachment_start (null: none).

    Front matter has the first block at least, even where the body starts with
    it; that block is in both. A tail counts only between body and attachments.
    """
    ends = blocks.groupBy("doc_id").agg(F.min("pos").alias("_a"), (F.max("pos") + 1).alias("_z")).join(cuts, "doc_id", "left")
    body = F.greatest(F.coalesce("body_start", F.lit(0)), F.col("_a"))
    stop = F.coalesce(F.when(F.col("attachment_start") >= body, F.col("attachment_start")), F.col("_z"))
    tail = F.when((F.col("tail_start") >= body) & (F.col("tail_start") < stop), F.col("tail_start"))
    of = lambda name, start, end: F.struct(F.lit(name).alias("region"), start.cast("int").alias("start"), end.cast("int").alias("stop"))
    ranges = F.array(of("frontmatter", F.col("_a"), F.greatest(body, F.col("_a") + 1)), of("body", body, F.coalesce(tail, stop)), of("tail", tail, stop), of("attachments", stop, F.col("_z")))
    return ends.select("doc_id", F.explode(F.filter(ranges, lambda r: r["start"] < r["stop"])).alias("r")).select("doc_id", "r.*")


def assign_regions(blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """blocks with region, a row for each range of region_ranges() that has them."""
    ranges = region_ranges(blocks, cuts).groupBy("doc_id").agg(F.collect_list(F.struct("region", "start", "stop")).alias("_r"))
    hit = F.filter("_r", lambda r: (F.col("pos") >= r["start"]) & (F.col("pos") < r["stop"]))
    return blocks.join(ranges, "doc_id").withColumn("region", F.explode(F.transform(hit, lambda r: r["region"]))).drop("_r")


def attachment_starts(blocks: DataFrame, numbered: str, listed: str, named: str) -> DataFrame:
    """doc_id, number, pos: the last paragraph of each number, list items left out, and every outlined one with a name (number null)."""
    number = F.regexp_extract("text", numbered, 1)
    p = blocks.where("kind = 'p'").withColumn("number", F.when((number != "") & ~F.col("text").rlike(listed), number))
    last = p.where("number IS NOT NULL").groupBy("doc_id", "number").agg(F.max("pos").alias("pos"))
    rest = p.where(F.col("number").isNull() & F.col("outline").between(0, 8) & F.col("text").rlike(named))
    return last.unionByName(rest.select("doc_id", "number", "pos"))


def visual_title(blocks: DataFrame, keyword: str, size: int = 55) -> DataFrame:
    """Add visual_title boolean: short, unnumbered, laid out as a title, and followed by text, a table or a heading."""
    after = W().rowsBetween(1, 5)
    content = F.max(((F.col("kind") == "tbl") | F.col("level").isNotNull() | (F.length("text") > 25)).cast("int")).over(after)
    score = (F.col("alignment") == "center").cast("int") + (F.col("bold_fraction") >= 0.5).cast("int") + (F.col("max_font_size") >= 28).cast("int")
    place = (F.row_number().over(W()) <= 8) | F.col("text").rlike(keyword)
    return blocks.withColumn("visual_title", (F.col("kind") == "p") & (F.length("text") <= size) & F.col("num_id").isNull() & (score >= 2) & place & (F.coalesce(content, F.lit(0)) == 1))


def plain_label(text: Column, label: str, keyword: str, size: int = 16) -> Column:
    return text.rlike(label) & ((F.length(text) <= size) | text.rlike(keyword))


def heading_score(blocks: DataFrame) -> DataFrame:
    """Add score int and evidence array: a level by its number 2, direct outline 4 or style outline 3, centred 1, bold 1, large 1, in an attachment 2."""
    signals = [
        ("number_pattern", F.col("level").isNotNull(), 2),
        ("direct_outline", F.col("direct_outline").isNotNull(), 4),
        ("style_outline", F.col("direct_outline").isNull() & F.col("style_outline").isNotNull(), 3),
        ("center", F.col("alignment") == "center", 1),
        ("bold", F.col("bold_fraction") >= 0.5, 1),
        ("large_font", F.col("max_font_size") >= 28, 1),
        ("inside_attachment", F.col("in_attachment"), 2),
    ]
    score = reduce(Column.__add__, (F.when(c, n).otherwise(0) for _, c, n in signals))
    return blocks.withColumns({"score": score, "evidence": F.array_compact(F.array(*(F.when(c, name) for name, c, _ in signals)))})


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use names it."""
    return F.transform(F.array(value), use)[0]


def _lead(text: Column) -> Column:
    """Without white space in front; what stands behind plays no part in a number."""
    return F.regexp_replace(text, f"^{SPACE}+", "")


def number_family(text: Column) -> Column:
    """The first family whose pattern fits, else unnumbered."""
    return F.when(text.isNotNull(), _let(_lead(text), lambda t: F.coalesce(*(F.when(t.rlike(p), name) for name, p in FAMILIES), F.lit("unnumbered"))))


def _number(value: Column) -> Column:
    """A number in digits, or in numerals up to 99; else null, as for ones too long for a bigint."""
    digits = F.create_map(*(F.lit(x) for pair in ONES.items() for x in pair))
    ten = F.split(value, "[十拾]", 2)
    tens = F.when(ten[0] == "", 1).otherwise(F.coalesce(F.try_element_at(digits, ten[0]), F.lit(1)))
    ones = F.coalesce(F.try_element_at(digits, F.try_element_at(ten, F.lit(2))), F.lit(0))
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("bigint")).when(value.rlike("[十拾]"), (tens * 10 + ones).cast("bigint")).otherwise(F.try_element_at(digits, value).cast("bigint"))


def number_ordinal(text: Column, family: Column) -> Column:
    """The number of a heading of a family: what stands in the place that the family has for it; null if it is none."""
    part = lambda t, pattern: F.regexp_extract(t, pattern, 1)

    def value(t: Column) -> Column:
        return (
            F.when(family == "subattachment", part(t, rf"^附件\s*[{CHINESE}0-9]+[-.](\d+)"))
            .when(family.isin("chapter", "article", "section"), part(t, rf"^第([{CHINESE}0-9]+)[章条节]"))
            .when(family.isin("cn_comma", "cn_paren"), part(t, rf"^[（(]?([{CHINESE}]+)"))
            .when(F.startswith(family, F.lit("arabic_")), part(t, r"^[（(]?(\d+)"))
        )

    letter = lambda t: (F.ascii(F.upper(F.substring(t, 1, 1))) - 64).cast("bigint")
    return F.when(family != "unnumbered", _let(_lead(text), lambda t: F.when(family == "letter", letter(t)).otherwise(_let(value(t), _number))))


def hierarchy_candidates(blocks: DataFrame, inside_attachment: bool = True) -> DataFrame:
    """Paragraphs that may be headings, with place (among paragraphs with text), signals array, ordinal and required.

    blocks: doc_id, pos, kind, text, outline, level (by fixed patterns),
    family, visual_title, plain_label and layout. A paragraph is one if it is
    outlined, numbered, a visual title, a label, short and formatted, or, inside
    an attachment, among the first eight and short. Sub-attachments and
    outlined numbers are required; see required_sequences() for the rest.
    """
    p = blocks.where((F.col("kind") == "p") & (strip(F.col("text")) != ""))
    p = p.withColumn("place", F.row_number().over(W()))
    outlined, numbered = F.coalesce(F.col("outline").between(0, 8), F.lit(False)), F.col("family") != "unnumbered"
    center, bold, large = F.col("alignment") == "center", F.col("bold_fraction") >= 0.5, F.col("max_font_size") >= 28
    opening = F.lit(inside_attachment) & (F.col("place") <= 8) & (F.length("text") <= 80)
    wanted = outlined | numbered | F.col("visual_title") | F.col("plain_label") | ((center | bold | large) & (F.length("text") <= 120)) | opening
    found = [
        (F.concat(F.lit("outline:"), F.col("outline").cast("string")), outlined),
        (F.concat(F.lit("deterministic_level:"), F.col("level").cast("string")), F.col("level").isNotNull()),
        (F.concat(F.lit("number:"), "family"), numbered),
        *((F.lit(name), c) for name, c in (("visual_title", F.col("visual_title")), ("plain_label", F.col("plain_label")), ("center", center), ("bold", bold), ("large_font", large), ("attachment_opening", opening))),
    ]
    signals = F.array_compact(F.array(*(F.when(c, name) for name, c in found)))
    required = (F.col("family") == "subattachment") | (outlined & numbered)
    return p.where(F.coalesce(wanted, F.lit(False))).withColumns({"signals": signals, "ordinal": number_ordinal(F.col("text"), F.col("family")), "required": required})


def required_sequences(candidates: DataFrame) -> DataFrame:
    """candidates with required also where a row lies in a run of at least two consecutive ordinals of its family in its document."""
    keys = ["doc_id", "family", F.col("ordinal").isNull()]
    w = Window.partitionBy(*keys).orderBy("pos")
    breaks = F.when(F.col("ordinal") == F.lag("ordinal").over(w) + 1, 0).otherwise(1)
    island = candidates.withColumn("_break", breaks).withColumn("_island", F.sum("_break").over(w))
    size = F.count("*").over(Window.partitionBy(*keys, "_island"))
    run = (F.col("family") != "unnumbered") & F.col("ordinal").isNotNull() & (size >= 2)
    return island.withColumn("required", F.coalesce("required", F.lit(False)) | run).drop("_break", "_island")


def next_text(blocks: DataFrame, size: int = 100) -> DataFrame:
    """Add next_text: the next text that is not empty, on one line, cut at size."""
    later = W().rowsBetween(1, Window.unboundedFollowing)
    found = F.first(F.when(F.col("text") != "", F.col("text")), ignorenulls=True).over(later)
    return blocks.withColumn("next_text", F.substring(F.replace(found, F.lit("\n"), F.lit(" ")), 1, size))


def pattern_summary(blocks: DataFrame, size: int = 120, examples: int = 3) -> DataFrame:
    """doc_id, family, n and the first examples of each number family, the unnumbered among them."""
    w = Window.partitionBy("doc_id", "family").orderBy("pos")
    ranked = blocks.withColumn("_k", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("_k") <= examples, F.struct("_k", F.substring("text", 1, size).alias("t")))))
    return ranked.groupBy("doc_id", "family").agg(F.count("*").alias("n"), F.transform(first, lambda x: x["t"]).alias("examples"))


def title_sequence_check(nodes: DataFrame) -> DataFrame:
    """Siblings whose ordinal doesn't follow the one before: with previous and gap."""
    w = Window.partitionBy("doc_id", "parent_id", "level").orderBy("pos")
    return nodes.withColumn("previous", F.lag("ordinal").over(w)).where(F.col("ordinal") - F.col("previous") != 1).withColumn("gap", F.col("ordinal") - F.col("previous"))


def number_kind(text: Column) -> Column:
    """struct(kind, source) of the first kind of EXAMPLE_KINDS that fits, or null."""
    return _let(_lead(text), lambda t: F.coalesce(*(F.when(t.rlike(p), F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("source"))) for kind, p in EXAMPLE_KINDS)))


def infer_number_pattern(examples: DataFrame) -> DataFrame:
    """profile, level, kinds, pattern: from example headings (profile, level, place, text) the pattern of each level, alternatives as first seen."""
    found = examples.withColumn("_k", number_kind(F.col("text"))).where("_k IS NOT NULL")
    first = found.groupBy("profile", "level", "_k").agg(F.min("place").alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_k")))
    bare = lambda x: F.substring(x["_k"]["source"], 2, 1 << 20)
    pattern = F.concat(F.lit("^(?:"), F.array_join(F.transform(ordered, bare), "|"), F.lit(")"))
    kinds = F.array_distinct(F.transform(ordered, lambda x: x["_k"]["kind"]))
    return first.groupBy("profile", "level").agg(kinds.alias("kinds"), pattern.alias("pattern"))


def pattern_errors(examples: DataFrame, patterns: DataFrame) -> DataFrame:
    """profile, level, place, matched of examples that no kind fits (matched empty) or that fit other levels than their own, or several."""
    levels = patterns.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("level", "pattern"))).alias("_levels"))
    rows = examples.join(levels, "profile", "left").withColumn("_t", strip(F.col("text")))
    hit = F.transform(F.filter("_levels", lambda x: F.rlike(F.col("_t"), x["pattern"])), lambda x: x["level"])
    rows = rows.withColumn("matched", F.coalesce(hit, F.array().cast("array<int>")))
    return rows.where(number_kind(F.col("text")).isNull() | (F.col("matched") != F.array("level"))).select("profile", "level", "place", "matched")
