"""Retrieval of evidence for many (document, query) pairs at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import document_mode, estimate_tokens, strip, truncate
from foliant.operators.greedy import greedy_batches, overlapping_batches
from foliant.operators.patterns import with_terms
from foliant.operators.sweep import covered, ranks
from foliant.sources.scratch import cut


#: Up to so many keywords are held against each node as literals, each of which reads all texts; more become an automaton, which reads them once.
FEW_KEYWORDS = 16


def keyword_search(nodes: DataFrame, keywords: DataFrame, margin: int = 30, few: int = FEW_KEYWORDS) -> DataFrame:
    """query_id, doc_id, node_id, keyword, field, position, snippet: a title hit for any node, else a text hit for leaves.

    keywords: query_id, doc_id (null: all documents), keyword; repeated ones
    count once, those of all documents instead of those of one. Few (their
    number is checked) are held against each node as literals; more become an
    automaton, which reads each text once. Either way nodes aren't shuffled.
    """
    n = nodes.select("doc_id", "node_id", "title", F.when(F.col("is_leaf"), F.col("text")).alias("_body"))
    k = keywords.where(F.coalesce("keyword", F.lit("")) != "").select("query_id", F.col("doc_id").alias("_doc"), "keyword").distinct()
    every = k.where("_doc IS NULL").select("query_id", "keyword")
    own = k.where("_doc IS NOT NULL").join(every, ["query_id", "keyword"], "left_anti")
    listed = k.select("keyword").distinct().limit(few + 1).collect()
    if len(listed) > few:
        found = with_terms(n, ["title", "_body"], k.select(F.col("keyword").alias("term"))).select("*", F.explode("found").alias("_f"))
        found = found.select("doc_id", "node_id", "title", "_body", F.col("_f.term").alias("keyword"), (F.col("_f.place") == 0).alias("_in_title"), F.col("_f.position").alias("position"))
    else:
        words = F.array(*(F.lit(r[0]) for r in listed)).cast("array<string>")
        fits = lambda x: F.contains("title", x) | F.contains("_body", x)
        found = n.select("*", F.explode(F.filter(words, fits)).alias("keyword"))
        found = found.withColumn("_in_title", F.coalesce(F.contains("title", "keyword"), F.lit(False)))
        found = found.withColumn("position", F.position("keyword", F.when(F.col("_in_title"), F.col("title")).otherwise(F.col("_body"))))
    first = F.greatest(F.lit(1), F.col("position") - margin)
    snippet = F.when(F.col("_in_title"), F.col("title")).otherwise(F.substring("_body", first, F.col("position") + F.length("keyword") + margin - first))
    found = found.select("doc_id", "node_id", "keyword", F.when(F.col("_in_title"), "title").otherwise("text").alias("field"), "position", snippet.alias("snippet"))
    both = found.join(every, "keyword").unionByName(found.join(own, (found["doc_id"] == own["_doc"]) & (found["keyword"] == own["keyword"])).drop("_doc").drop(own["keyword"]))
    return both.select("query_id", "doc_id", "node_id", "keyword", "field", "position", "snippet")


def title_match(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """query_id, doc_id, node_id, text_override: nodes with any of a step's terms in the title, or, if it asks for all titles, those of the catalogue.

    The catalogue has tails, body sections of depth 1 and attachment sections.
    The regions body and attachments themselves, and nodes without a title,
    never count. What a title says stands for its node, but for tails.
    """
    s = steps.select("query_id", "doc_id", "terms", "all_titles")
    kind = F.coalesce("node_type", F.lit("")) if "node_type" in nodes.columns else F.lit("")
    listed = (kind == "tail") | ((F.col("depth") == 1) & F.startswith("node_id", F.lit("body/sec_"))) | kind.isin("attachment_parent", "attachment_section")
    named = F.exists("terms", lambda t: F.contains(F.col("title"), t))
    plain = (strip(F.coalesce("title", F.lit(""))) != "") & ~kind.isin("body", "attachments") & ~F.col("node_id").isin("body", "attachments")
    hit = nodes.where(plain).withColumn("text_override", F.when(kind != "tail", strip(F.col("title")))).join(s, "doc_id")
    return hit.where(F.when(F.col("all_titles"), listed).otherwise(named)).select("query_id", "doc_id", "node_id", "text_override")


def region_match(nodes: DataFrame, steps: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, node_id, place: nodes of a step's regions, each once, in order.

    Without terms the regions themselves count, body and attachments by their
    children. With terms, titles with any of them count, below the regions or,
    if none is named, anywhere; those that prior (query_id, doc_id, node_id,
    place) matched come first.
    """
    s = steps.select("query_id", "doc_id", "terms", "regions")
    n = nodes.select("doc_id", "node_id", "parent_id", "title", "pos")
    both = n.join(s, "doc_id")
    whole = F.array_contains("regions", F.col("node_id")) & ~F.col("node_id").isin("body", "attachments")
    child = F.array_contains("regions", F.col("parent_id")) & F.col("parent_id").isin("body", "attachments")
    below = (F.size("regions") == 0) | F.exists("regions", lambda r: (F.col("node_id") == r) | F.startswith("node_id", F.concat(r, F.lit("/"))))
    named = F.exists("terms", lambda t: F.contains(F.col("title"), t))
    hit = both.where(F.when(F.size("terms") == 0, whole | child).otherwise(below & named)).select("query_id", "doc_id", "node_id", "terms", "pos")
    order = [F.col("pos"), F.col("node_id")]
    if prior is not None:
        seen = prior.groupBy("query_id", "doc_id", "node_id").agg(F.min("place").alias("_prior"))
        hit = hit.join(seen, ["query_id", "doc_id", "node_id"], "left").withColumn("_prior", F.when(F.size("terms") > 0, F.col("_prior")))
        order = [F.col("_prior").asc_nulls_last(), *order]
    first = hit.groupBy("query_id", "doc_id", "node_id").agg(F.min("pos").alias("pos"), *([F.min("_prior").alias("_prior")] if prior is not None else []))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(*order))).select("query_id", "doc_id", "node_id", "place")


def rule_match(anchors: DataFrame, steps: DataFrame) -> DataFrame:
    """query_id, doc_id, node_id, parent_id, pos, anchor, text_override: owned anchors whose text has any of a step's terms; see literal_terms()."""
    owned = anchors.where("node_id is not null")
    asked = steps.select("query_id", "doc_id", F.explode("terms").alias("term")).distinct()
    found = with_terms(owned.select("doc_id", "anchor", "text"), ["text"], asked).select("doc_id", "anchor", F.explode("found.term").alias("term"))
    pairs = found.join(asked, ["doc_id", "term"]).select("query_id", "doc_id", "anchor").distinct()
    hit = owned.join(pairs, ["doc_id", "anchor"])
    return hit.select("query_id", "doc_id", F.concat("node_id", F.lit("/match_"), "anchor").alias("node_id"), F.col("node_id").alias("parent_id"), "pos", "anchor", F.col("text").alias("text_override"))


# Words that mark a part of a query as a question, and endings of roles.
QUESTION_WORDS = ["是否", "如果", "需要", "检查"]
ROLE_ENDINGS = [("单位", 4), ("人", 3)]


def literal_terms(query: Column, planned: Column, questions: list[str] | None = None) -> Column:
    """Terms to look for word by word; longest first, then by alphabet.

    Planned terms of 2 to 30 characters, quoted ones, and the list behind the
    first colon (2 to 20 characters, without question words). A role named by
    its holder (two characters for 单位, one for 人) gives its root too, if that
    has two characters.
    """
    marks = r"^[ \t\r\n。；;：:]+|[ \t\r\n。；;：:]+$"
    quoted = F.transform(F.regexp_extract_all(query, F.lit(r'["“]([^"”]{2,30})["”]'), F.lit(1)), strip)
    listed = F.transform(F.split(F.regexp_extract(query, r"(?s)^[^:：]*[:：](.*)$", 1), r"[、，,；;。]"), lambda x: F.regexp_replace(x, marks, ""))
    asks = lambda x: F.exists(F.array(*map(F.lit, QUESTION_WORDS if questions is None else questions)), lambda q: F.contains(x, q))
    listed = F.filter(listed, lambda x: F.length(x).between(2, 20) & ~asks(x))
    given = F.filter(F.transform(F.coalesce(planned, F.array().cast("array<string>")), strip), lambda x: F.length(x).between(2, 30))
    every = F.concat(given, quoted, listed)

    def roots(end: str, least: int) -> Column:
        named = F.filter(every, lambda x: F.endswith(x, F.lit(end)) & (F.length(x) >= least))
        return F.filter(F.transform(named, lambda x: F.substring(x, F.lit(1), F.length(x) - len(end))), lambda x: F.length(x) >= 2)

    every = F.array_distinct(F.filter(F.concat(every, *(roots(*x) for x in ROLE_ENDINGS)), lambda x: x != ""))
    ranked = F.array_sort(F.transform(every, lambda x: F.struct((-F.length(x)).alias("a"), x.alias("t"))))
    return F.transform(ranked, lambda x: x["t"])


# Words that a query brings along for its leaves, and those that an amount in it adds.
PREFERRED = ["合同期限", "履行期限", "有效期", "服务期", "签订日期", "项目负责人", "支付方式", "合同金额", "付款", "发票", "维保", "保修", "甲方", "乙方", "附件", "签署", "以下无正文"]
AMOUNT, AMOUNT_MARKS = "金额", ["大小写", "大写", "小写", "一致"]
AMOUNT_WORDS = ["金额", "人民币", "元整", "¥", "大写", "小写", "含税价", "合计"]


def join_words(terms: Column, slots: Column, query: Column) -> Column:
    """All words that a join step looks for: its terms, the words of its slots (2 to 8 Chinese characters), and what its query brings along."""
    words = F.flatten(F.transform(F.coalesce(slots, F.array().cast("array<string>")), lambda x: F.regexp_extract_all(x, F.lit("([\u4e00-\u9fff]{2,8})"), F.lit(1))))
    asked = F.coalesce(query, F.lit(""))
    in_query = lambda each: F.filter(F.array(*map(F.lit, each)), lambda x: F.contains(asked, x))
    amount = F.when(F.contains(asked, F.lit(AMOUNT)) & (F.size(in_query(AMOUNT_MARKS)) > 0), F.array(*map(F.lit, AMOUNT_WORDS))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.coalesce(terms, F.array().cast("array<string>")), words, in_query(PREFERRED), amount))


def join_match(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """query_id, doc_id, node_id, place: a step's regions first, then leaves with any of its words in title, summary or text; each node once.

    steps: query_id, doc_id, regions, terms, and slots and query where there are any.
    """
    none = F.array().cast("array<string>")
    words = join_words(F.col("terms"), F.col("slots") if "slots" in steps.columns else none, F.col("query") if "query" in steps.columns else F.lit(""))
    s = steps.select("query_id", "doc_id", "regions", words.alias("_words"))
    regions = s.select("query_id", "doc_id", F.posexplode("regions").alias("o", "node_id"))
    named = nodes.select("doc_id", "node_id").join(regions, ["doc_id", "node_id"]).select("query_id", "doc_id", "node_id", F.struct(F.lit(0).alias("_rank"), F.col("o").alias("o")).alias("_k"))
    hay = F.concat_ws("\n", *(F.coalesce(x, F.lit("")) for x in ("title", "summary", "text")))
    leaves = nodes.where(F.col("is_leaf") & ~F.col("node_id").isin("body", "attachments")).select("doc_id", "node_id", "pos", hay.alias("_hay"))
    asked = s.select("query_id", "doc_id", F.explode("_words").alias("term")).distinct()
    found = with_terms(leaves, ["_hay"], asked).select("doc_id", "node_id", "pos", F.explode("found.term").alias("term"))
    hit = found.join(asked, ["doc_id", "term"]).select("query_id", "doc_id", "node_id", F.struct(F.lit(1).alias("_rank"), F.col("pos").cast("int").alias("o")).alias("_k"))
    first = named.unionByName(hit).groupBy("query_id", "doc_id", "node_id").agg(F.min("_k").alias("_k"))
    return first.select("query_id", "doc_id", "node_id", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("_k", "node_id")).alias("place"))


def scan_batches(anchors: DataFrame, budget: int = 12000) -> DataFrame:
    """doc_id, batch, match_id, parent_id, start_pos, end_pos, start_anchor, end_anchor, text: owned anchors with text, in order, packed to budget tokens.

    anchors: doc_id, pos, anchor, node_id, text. A batch belongs to the owner of its first anchor.
    """
    rows = anchors.where(F.col("node_id").isNotNull() & (strip(F.col("text")) != "")).withColumn("text", strip(F.col("text")))
    folded = greedy_batches(rows, ["doc_id"], "pos", estimate_tokens(F.col("text")), budget, carry=["anchor", "node_id", "text"])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    out = folded.groupBy("doc_id", "batch").agg(
        F.min_by("node_id", "pos").alias("parent_id"), F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.min_by("anchor", "pos").alias("start_anchor"), F.max_by("anchor", "pos").alias("end_anchor"), lines.alias("text")
    )
    return out.withColumn("match_id", F.format_string("scan/batch_%03d", "batch"))


def paginate(units: DataFrame, budget: int, part: int | None = None) -> DataFrame:
    """units (query_id, doc_id, place, text) with page (from 1), used (tokens of the page), has_more and next_part; with part, that page alone.

    Pages are known from places and tokens alone; texts meet them once.
    """
    key = ["query_id", "doc_id"]
    sized = units.select(*key, "place", estimate_tokens(F.col("text")).alias("_tokens"))
    items = cut(greedy_batches(sized, key, "place", "_tokens", budget, batch="page", carry=["_tokens"]), "pages")
    pages = items.groupBy(*key, "page").agg(F.sum("_tokens").alias("used"))
    pages = pages.withColumn("has_more", F.lead("page").over(Window.partitionBy(*key).orderBy("page")).isNotNull())
    if part is not None:
        pages = pages.where(F.col("page") == part)
    facts = items.drop("_tokens").join(pages, [*key, "page"])
    out = units.join(facts, [*key, "place"])
    return out.withColumn("next_part", F.when(F.col("has_more"), F.col("page") + 1))


def execute_route(steps: DataFrame, methods: dict[str, DataFrame]) -> DataFrame:
    """query_id, doc_id, node_id, source, step_no and what else matches have (place, text_override, parent_id, ...): what each step's method found, for steps that name it."""
    parts = []
    for name, found in methods.items():
        own = steps.where(F.col("method") == name).select("query_id", "doc_id", "step_no")
        parts.append(found.join(own, ["query_id", "doc_id"]).withColumn("source", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def normalize_route(raw: DataFrame) -> DataFrame:
    """query_id, method, terms, region from a JSON step with aliases of its fields."""
    get = lambda *keys: F.coalesce(*(F.get_json_object("step", f"$.{k}") for k in keys))
    terms = F.array_distinct(F.coalesce(F.from_json(get("terms", "params.terms", "keywords", "params.keywords", "check_keywords"), "array<string>"), F.array().cast("array<string>")))
    return raw.select("query_id", get("method", "type").alias("method"), terms.alias("terms"), F.split_part(get("region", "params.region", "target", "context_title"), F.lit("/"), F.lit(1)).alias("region"))


def merge_matches(structure: DataFrame, vector: DataFrame) -> DataFrame:
    """query_id, doc_id, node_id, sources (sorted), vector_score, structure_reason: what structure (with reason) and vector matches (with score) say of a node."""
    reason = F.col("reason") if "reason" in structure.columns else F.lit(None).cast("string")
    both = structure.select("query_id", "doc_id", "node_id", F.lit("structure").alias("source"), F.lit(None).cast("double").alias("score"), reason.alias("reason"))
    both = both.union(vector.select("query_id", "doc_id", "node_id", F.lit("vector"), "score", F.lit(None).cast("string"))).where("node_id IS NOT NULL")
    return both.groupBy("query_id", "doc_id", "node_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max("score").alias("vector_score"), F.max("reason").alias("structure_reason"))


def merge_routed(matches: DataFrame) -> DataFrame:
    """query_id, doc_id, node_id, first_step, sources, last_score and text_override: one row a node, in order of its first step.

    matches: query_id, doc_id, node_id, source, step_no, score, and place and
    text_override if they have any. The last score that isn't null counts, and
    the first step's override, unless a region names the node: then its whole text.
    """
    rows = matches.where("node_id IS NOT NULL")
    for name, kind in (("place", "int"), ("text_override", "string")):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
    at = F.struct("step_no", "place")
    out = rows.groupBy("query_id", "doc_id", "node_id").agg(
        F.min("step_no").alias("first_step"), F.min(at)["place"].alias("first_place"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.max_by("score", F.when(F.col("score").isNotNull(), F.col("step_no"))).alias("last_score"), F.min_by("text_override", at).alias("_text"), F.bool_or(F.col("source") == "region").alias("_region"),
    )
    return out.withColumn("text_override", F.when(~F.col("_region"), F.col("_text"))).drop("_text", "_region")


def fallback_needed(steps: DataFrame, matches: DataFrame) -> DataFrame:
    """query_id, doc_id of pairs that ask for a hybrid search, found nothing, or allow a fallback without a complete method."""
    plan = steps.groupBy("query_id", "doc_id").agg(F.bool_or(F.col("method") == "hybrid").alias("_hybrid"), F.bool_or("fallback").alias("_fallback"), F.bool_or(F.col("all_titles") | (F.col("method") == "scan")).alias("_complete"))
    found = matches.select("query_id", "doc_id").distinct().withColumn("_found", F.lit(True))
    out = plan.join(found, ["query_id", "doc_id"], "left")
    return out.where(F.col("_hybrid") | F.col("_found").isNull() | (F.col("_fallback") & ~F.col("_complete"))).select("query_id", "doc_id")


# Labels of an entry's lines.
ENTRY_LABELS = ("标题：", "摘要：", "正文：")


def vector_entries(nodes: DataFrame, tokens: int = 8000) -> DataFrame:
    """doc_id, node_id, entry, text_hash, embedded: labelled lines of title, summary and whole text, their hash, and what an embedder that takes so many tokens is sent.

    Nodes without text are left out, and so are the regions body and attachments.
    """
    kind = F.coalesce("node_type", F.lit("")) if "node_type" in nodes.columns else F.lit("")
    kept = nodes.where((strip(F.coalesce("text", F.lit(""))) != "") & ~kind.isin("body", "attachments") & ~F.col("node_id").isin("body", "attachments"))
    entry = strip(F.concat_ws("\n", *(F.concat(F.lit(label), F.coalesce(x, F.lit(""))) for label, x in zip(ENTRY_LABELS, ("title", "summary", "text"), strict=True))))
    # a column by itself, so that it is made once and not for each place that it stands in
    made = kept.select("doc_id", "node_id", entry.alias("entry"))
    return made.select("doc_id", "node_id", "entry", F.sha2("entry", 256).alias("text_hash"), truncate(F.col("entry"), tokens, 1).alias("embedded"))


def _nearest(k: int):
    """For the queries of a key and one block of its vectors: each query's k best of the block."""

    def best(key: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": q["query_id"].iloc[:0], "doc_id": q["doc_id"].iloc[:0], "node_id": v["node_id"].iloc[:0], "score": pd.Series(dtype=float)})
        if not len(q) or not len(v):
            return out
        sizes = [np.array([0 if x is None else len(x) for x in part]) for part in (q["vector"], v["embedding"])]
        ids = v["node_id"].to_numpy()
        found = []
        for lo in range(0, len(q), 512):
            score = np.zeros((min(512, len(q) - lo), len(v)))
            for d in set(sizes[0][lo : lo + 512]) & set(sizes[1]) - {0}:
                a, b = np.flatnonzero(sizes[0][lo : lo + 512] == d), np.flatnonzero(sizes[1] == d)
                x, y = (np.stack(part).astype(float) for part in (q["vector"].to_numpy()[lo + a], v["embedding"].to_numpy()[b]))
                norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
                score[np.ix_(a, b)] = np.divide(x @ y.T, norm, out=np.zeros(norm.shape), where=norm > 0)
            for i, row in enumerate(score):
                top = np.lexsort((ids, -row))[:k] if ids.dtype.kind in "iuf" else sorted(range(len(ids)), key=lambda j: (-row[j], ids[j]))[:k]
                found.append(pd.DataFrame({"query_id": q["query_id"].iloc[lo + i], "doc_id": q["doc_id"].iloc[lo + i], "node_id": ids[top], "score": row[top]}))
        return pd.concat(found)

    return best


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 30, least: float | None = 0.0, budget: int | None = None, block: int = 4096) -> DataFrame:
    """query_id, node_id, score, rank: the k nearest vectors of each query (ties by id), of those the ones at least so similar, and, with budget, up to the first that goes beyond it.

    queries (query_id, doc_id, vector) meet the vectors (doc_id, node_id,
    embedding, and tokens for a budget) of their own document. A document of
    more than block vectors is dealt to blocks by hash, as many as its count
    asks for; each block is one matrix product and keeps its own k best, so no
    pair is a row and a document with very many vectors spreads over tasks.
    Vectors that are null, empty, zero or of another length than the query have
    a score of 0.
    """
    large = vectors.groupBy("doc_id").count().where(F.col("count") > block).select("doc_id", F.ceil(F.col("count") / block).cast("int").alias("_blocks"))
    many = F.coalesce("_blocks", F.lit(1))
    v = vectors.join(large, "doc_id", "left").select("doc_id", "node_id", "embedding", F.pmod(F.xxhash64("node_id"), many).cast("int").alias("block"))
    q = queries.join(large, "doc_id", "left").select("query_id", "doc_id", "vector", F.explode(F.sequence(F.lit(0), many - 1)).alias("block"))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {queries.schema['doc_id'].dataType.simpleString()}, node_id {vectors.schema['node_id'].dataType.simpleString()}, score double"
    each = q.groupBy("doc_id", "block").cogroup(v.groupBy("doc_id", "block")).applyInPandas(_nearest(k), schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id")
    out = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = out if least is None else out.where(F.col("score") >= least)
    if budget is not None:
        out = out.join(vectors.select("doc_id", "node_id", "tokens"), ["doc_id", "node_id"])
        used = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumns({"_used": used, "_i": F.row_number().over(w)}).where((F.col("_used") <= budget) | (F.col("_i") == 1))
    return out.select("query_id", "node_id", "score", "rank")


def rerank_fit(candidates: DataFrame, budget: int) -> DataFrame:
    """The leading candidates (query_id, rank, tokens) whose tokens fit the budget together; always the first."""
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = candidates.withColumns({"used": F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_i": F.row_number().over(w)})
    return rows.where((F.col("used") <= budget) | (F.col("_i") == 1)).drop("_i")


def apply_rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates in the order of the response, each at its first mention, then the rest in their own order with no score: adds place."""
    first = scores.groupBy("query_id", "node_id").agg(F.min("pos").alias("_pos"), F.min_by("score", "pos").alias("rerank_score"))
    out = candidates.join(first, ["query_id", "node_id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.col("_pos").asc_nulls_last(), "rank")
    return out.withColumn("place", F.row_number().over(w)).drop("_pos")


def rerank_topn(candidates: DataFrame, results: DataFrame, n: int) -> DataFrame:
    """The n best by relevance_score, else score, else their own: query_id, node_id, final_score, place."""
    out = candidates.join(results, ["query_id", "rank"], "left").withColumn("final_score", F.coalesce("relevance_score", "score", "own_score"))
    w = Window.partitionBy("query_id").orderBy(F.col("final_score").desc(), "rank")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("query_id", "node_id", "final_score", "place")


def title_catalogue(nodes: DataFrame) -> DataFrame:
    """Titled nodes to depth 2, with their region."""
    return nodes.where((F.col("depth") <= 2) & (F.trim("title") != "")).select("doc_id", "node_id", "title", F.split_part("node_id", F.lit("/"), F.lit(1)).alias("region"), "parent_id")


def criterion_for_query(queries: DataFrame, criteria: DataFrame) -> DataFrame:
    """queries with criterion: that of the query's leading number, else the query itself."""
    number = F.regexp_extract("query", r"^\s*(\d{1,2})\D", 1).try_cast("int")
    return queries.withColumn("_n", number).join(criteria.select(F.col("criterion_id").alias("_n"), F.col("criterion").alias("_c")), "_n", "left").withColumn("criterion", F.coalesce("_c", "query")).drop("_n", "_c")


def structure_matches(responses: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, doc_id, node_id, place: named nodes that exist, each at its first mention."""
    real = responses.join(nodes.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi")
    first = real.groupBy("query_id", "doc_id", "node_id").agg(F.min("pos").alias("_pos"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("_pos"))).drop("_pos")


def prefer_specific(matches: DataFrame) -> DataFrame:
    """Matches (query_id, doc_id, node_id, sources) without those that have a matched node below them, unless titles or regions are among their sources.

    Each match names the nodes above it, so that a join by equal ids finds them.
    """
    parts = F.split("node_id", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = matches.where(F.size(parts) > 1).select("query_id", "doc_id", F.explode(ups).alias("node_id")).distinct().withColumn("_below", F.lit(True))
    out = matches.join(above, ["query_id", "doc_id", "node_id"], "left")
    return out.where(F.col("_below").isNull() | F.arrays_overlap("sources", F.array(F.lit("title"), F.lit("region")))).drop("_below")


def chunk_oversized(units: DataFrame, budget: int, anchors: DataFrame | None = None) -> DataFrame:
    """doc_id, node_id, part, text and, with anchors, start_pos and end_pos: texts above budget tokens in parts, others whole (part 0).

    anchors: doc_id, pos, text. A node's anchors (pos to end_pos, exclusive) fill
    parts up to the budget; a node without any is cut into slices of twice as
    many characters. Units that have no text stand for that of their anchors,
    line by line (see measure_nodes()).
    """
    size = 2 * budget
    large = F.col("tokens") > budget
    null = F.lit(None).cast("int")
    place = [null.alias("start_pos"), null.alias("end_pos")]
    bare = "text" not in units.columns
    rows, out = units.where(large), []
    if not bare:
        out.append(units.where(~large).select("doc_id", "node_id", F.lit(0).alias("part"), "text", *place))
    if anchors is not None:
        # folded by numbers alone; anchors at one pos are told apart by a hash
        text = F.coalesce("text", F.lit(""))
        points = cut(anchors.select("doc_id", "pos", F.xxhash64(text).alias("_h"), estimate_tokens(text).alias("_n")), "points")
        spans = (units if bare else rows).where("tokens IS NOT NULL").select("doc_id", "node_id", "pos", "end_pos", large.alias("_large"))
        ranked = cut(ranks(points, spans, ["node_id", "_large"]), "ranked")
        placed = points.withColumn("_at", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "_h")) - 1).drop("_h")
        items = covered(placed, ranked.where("_large").drop("_large"))
        folded = greedy_batches(items, ["doc_id", "node_id"], "_at", "_n", budget, batch="part", carry=["pos"])
        made = folded.groupBy("doc_id", "node_id", "part").agg(F.min("_at").alias("first"), (F.max("_at") + 1).alias("stop"), F.min("pos").cast("int").alias("start_pos"), F.max("pos").cast("int").alias("end_pos"))
        if bare:
            made = made.unionByName(ranked.where("NOT _large OR stop <= first").select("doc_id", "node_id", F.col("_large").cast("int").alias("part"), "first", "stop", *place))
        else:
            rows = rows.join(ranked.where("stop > first").select("doc_id", "node_id").distinct().hint("merge"), ["doc_id", "node_id"], "left_anti")
        # a document's anchors are an array, of which a part takes a slice: texts are moved once
        arrays = anchors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.xxhash64(text).alias("_h"), F.when(text != "", text).alias("line")))).alias("_b"))
        arrays = arrays.select("doc_id", F.transform("_b", lambda x: x["line"]).alias("_b"))
        each = made.groupBy("doc_id").agg(F.collect_list(F.struct(*(c for c in made.columns if c != "doc_id"))).alias("_m"))

        def joined(m: Column) -> Column:
            lines = F.slice(F.coalesce("_b", F.array().cast("array<string>")), (m["first"] + 1).cast("int"), (m["stop"] - m["first"]).cast("int"))
            return F.struct(m["node_id"].alias("node_id"), m["part"].alias("part"), F.array_join(lines, "\n").alias("text"), m["start_pos"].alias("start_pos"), m["end_pos"].alias("end_pos"))

        out.append(each.join(arrays, "doc_id", "left").select("doc_id", F.explode(F.transform("_m", joined)).alias("m")).select("doc_id", "m.*"))
    if not bare:
        parts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length("text") / size).cast("int")))).alias("part")
        out.append(rows.select("doc_id", "node_id", "text", parts).select("doc_id", "node_id", "part", F.substring("text", (F.col("part") - 1) * size + 1, F.lit(size)).alias("text"), *place))
    every = reduce(DataFrame.unionByName, out)
    return every if anchors is not None else every.drop("start_pos", "end_pos")


# How found anchors are presented, and what stands for none.
HEADER, TITLE_LINE, TEXT_LINE, NOTHING = "## 合同检索结果 ", "\n检索片段标题：", "\n内容：\n", "未找到相关合同内容。"


def anchor_context(units: DataFrame, anchors: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, context: texts of the anchors that units cover, each once, under numbered headers, in order of units, then of anchors.

    units: query_id, doc_id, pos, end_pos (exclusive), and place and title if
    they have any; anchors: doc_id, pos, kind (p or tbl), text. Pairs of asked
    (query_id, doc_id) without any get a message that says so.
    """
    place = F.col("place") if "place" in units.columns else F.col("pos")
    title = F.trim(F.coalesce("title", F.lit(""))) if "title" in units.columns else F.lit("")
    kind = F.when(F.col("kind") == "tbl", "table").otherwise("paragraph")
    texts = anchors.select("doc_id", "pos", kind.alias("kind"), strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''").withColumn("_h", F.xxhash64("text"))
    # anchors are numbered by place, kind and hash, once each: texts wait in their document's array, and are moved once
    points = texts.select("doc_id", "pos", "kind", "_h").distinct().withColumn("_at", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "kind", "_h")) - 1)
    arrays = texts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "kind", "_h", "text"))), lambda x: x["text"]).alias("_b"))
    spans = units.select("query_id", "doc_id", "pos", "end_pos", F.struct(place.alias("place"), title.alias("title")).alias("_u"))
    rows = covered(points.drop("_h"), ranks(points, spans, ["query_id", "_u", "pos"]).drop("pos"))
    # an anchor that several units cover stands where the first has it
    once = rows.groupBy("doc_id", "query_id", "_at", "pos", "kind").agg(F.min("_u").alias("_u"))
    once = once.withColumn("_i", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("_u.place", "_at")))
    path = F.concat(F.lit("path:body/"), F.when(F.col("kind") == "table", "tbl").otherwise("p"), F.col("pos").cast("string"))
    head = F.concat(F.lit(HEADER), F.col("_i").cast("string"), F.when(F.col("_u.title") != "", F.concat(F.lit(TITLE_LINE), F.col("_u.title"))).otherwise(""))
    head = F.concat(head, F.lit("\nxml_anchor_type: "), "kind", F.lit("\nxml_anchor_id: "), path, F.lit(TEXT_LINE))
    asks = once.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("_i", head.alias("head"), "_at"))).alias("_a"))
    asks = asks.groupBy("doc_id").agg(F.collect_list(F.struct("query_id", "_a")).alias("_q"))

    def joined(q: Column) -> Column:
        return F.struct(q["query_id"].alias("query_id"), F.array_join(F.transform(q["_a"], lambda a: F.concat(a["head"], F.get("_b", a["_at"]))), "\n\n---\n\n").alias("context"))

    out = asks.join(arrays, "doc_id").select("doc_id", F.explode(F.transform("_q", joined)).alias("c")).select("c.query_id", "doc_id", "c.context")
    if asked is None:
        return out
    pairs = asked.select("query_id", "doc_id").distinct()
    return pairs.join(out, ["query_id", "doc_id"], "left").withColumn("context", F.coalesce("context", F.lit(NOTHING)))


def node_lookup(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """wanted with found boolean and the node's title."""
    return wanted.join(nodes.select("doc_id", "node_id", "title"), ["doc_id", "node_id"], "left").withColumn("found", F.col("title").isNotNull())


def chunk_text(docs: DataFrame, size: int = 512, overlap: int = 100) -> DataFrame:
    """doc_id, chunk, start_pos, end_pos, text: texts (doc_id, text) in chunks of size tokens at most, each beginning with about overlap tokens of the one before.

    Paragraphs (behind empty lines) are the pieces; one above size is cut behind
    sentence ends, and a sentence above it into slices of 2 * size characters.
    start_pos and end_pos count pieces from 1. Rules for ties are this
    library's own.
    """
    paragraph = F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("p", "x")
    p = docs.select("doc_id", paragraph).where(strip(F.col("x")) != "")
    tokens = lambda: estimate_tokens(F.col("x"))
    sentences = F.split(F.regexp_replace("x", r"([.!?;])\s+|([。！？；])\s*", "$1$2\u0001"), "\u0001")
    s = p.select("doc_id", "p", F.posexplode(F.when(tokens() > size, sentences).otherwise(F.array("x"))).alias("s", "x")).where(strip(F.col("x")) != "")
    wide = 2 * size
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("x") / wide).cast("int") - 1)), lambda i: F.substring("x", i * wide + 1, F.lit(wide)))
    pieces = s.select("doc_id", "p", "s", F.posexplode(F.when(tokens() > size, slices).otherwise(F.array("x"))).alias("t", "x"))
    weights = pieces.select("doc_id", "p", "s", "t", tokens().alias("w"))
    numbered = weights.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("p", "s", "t")).alias("pos"), "w")
    ranges = overlapping_batches(numbered, size, overlap)
    # a document's pieces are an array, of which a chunk takes a slice: texts are moved once, whatever the overlap
    each = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("batch", "start_pos", "end_pos")).alias("_r"))
    arrays = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p", "s", "t", "x"))).alias("_b"))
    # pieces of one paragraph stay on a line
    marked = arrays.select("doc_id", F.transform("_b", lambda y, i: F.struct(F.when((i > 0) & (F.get("_b", i - 1)["p"] == y["p"]), " ").otherwise("\n\n").alias("mark"), y["x"].alias("x"))).alias("_b"))

    def made(r: Column) -> Column:
        part = F.slice("_b", r["start_pos"], r["end_pos"] - r["start_pos"] + 1)
        text = F.array_join(F.transform(part, lambda y, i: F.when(i == 0, y["x"]).otherwise(F.concat(y["mark"], y["x"]))), "")
        return F.struct(r["batch"].alias("chunk"), r["start_pos"].alias("start_pos"), r["end_pos"].alias("end_pos"), text.alias("text"))

    return marked.join(each, "doc_id").select("doc_id", F.explode(F.transform("_r", made)).alias("c")).select("doc_id", "c.*")


def search(
    nodes: DataFrame, steps: DataFrame, anchors: DataFrame, structure: DataFrame | None = None, vector: DataFrame | None = None, reranked: DataFrame | None = None, budget: int = 4000, scan_budget: int = 12000, most: int = 5, part: int = 1
) -> DataFrame:
    """query_id, doc_id, sources, used, has_more, next_part, context: the whole search for every (query, document) of steps.

    nodes: build_hierarchy() with tokens (of their text, see measure_nodes()),
    and with text, summary and is_leaf if a step is a join, which alone reads
    them. steps: query_id, doc_id, step_no, method (title, region, rule, join,
    scan or hybrid), terms, regions, all_titles, fallback. anchors: doc_id, pos,
    kind, text, and anchor and node_id if a step is a rule or a scan. Methods
    that no step names cost nothing. Routed matches are merged in the order of steps.
    Pairs that need it (fallback_needed()) also get structure matches
    (query_id, doc_id, node_id, place) and vector matches (query_id, doc_id,
    node_id, score); of their candidates, in the order of reranked (query_id,
    doc_id, node_id, pos, score) where there is one, the first most stay.
    General matches give way to specific ones, what is left becomes units of
    budget tokens at most (scan_budget for pairs that scan), units fill pages,
    and the asked page is expanded to its anchors. A pair without any has a
    message instead.
    """
    key = ["query_id", "doc_id"]
    steps = cut(steps, "steps")
    named = {r[0] for r in steps.where(F.col("method").isin("rule", "join", "scan")).select("method").distinct().collect()}
    if "join" in named and not {"text", "summary", "is_leaf"} <= set(nodes.columns):
        raise ValueError("joins look into texts, which these nodes lack")
    # columns that no branch reads aren't made
    of_nodes = ["doc_id", "node_id", "parent_id", "title", "pos", "end_pos", "depth", *(c for c in ("node_type",) if c in nodes.columns), *(["text", "summary", "is_leaf"] if "join" in named else [])]
    nodes = cut(nodes.select(*of_nodes, "tokens"), "nodes")
    anchors = cut(anchors.select("doc_id", "pos", "kind", "text", *(["anchor", "node_id"] if named & {"rule", "scan"} else [])), "anchors")
    of = lambda name: steps.where(F.col("method") == name)
    titles = title_match(nodes, of("title")).join(nodes.select("doc_id", "node_id", F.col("pos").alias("place")), ["doc_id", "node_id"])
    regions = region_match(nodes, of("region"), titles)
    found = {"title": titles, "region": regions}
    if "rule" in named:
        found["rule"] = rule_match(anchors, of("rule")).withColumns({"place": F.col("pos"), "end_pos": F.col("pos") + 1})
    if "join" in named:
        found["join"] = join_match(nodes, of("join"))
    if "scan" in named:
        batches = scan_batches(anchors.join(of("scan").select("doc_id").distinct(), "doc_id", "left_semi"), scan_budget)
        found["scan"] = of("scan").select(*key).join(batches.select("doc_id", F.col("match_id").alias("node_id"), "parent_id", F.col("start_pos").alias("pos"), (F.col("end_pos") + 1).alias("end_pos"), F.col("batch").alias("place"), F.col("text").alias("text_override")), "doc_id")
    routed = execute_route(steps, found)
    for name, kind in (("pos", "int"), ("end_pos", "int"), ("parent_id", "string")):
        routed = routed if name in routed.columns else routed.withColumn(name, F.lit(None).cast(kind))
    routed = cut(routed, "routed")
    spans = routed.groupBy(*key, "node_id").agg(F.max("pos").alias("_pos"), F.max("end_pos").alias("_end"), F.max("parent_id").alias("_parent"))
    merged = merge_routed(routed.withColumn("score", F.lit(None).cast("double"))).join(spans, [*key, "node_id"])
    needed = fallback_needed(steps, routed)
    none = steps.where("false").select(*key, *(F.lit(None).cast(kind).alias(name) for name, kind in (("node_id", "string"), ("place", "int"), ("score", "double"), ("pos", "int"))))
    more = merge_matches(none if structure is None else structure, none if vector is None else vector).join(needed, key, "left_semi")
    behind = more.select(*key, "node_id", F.lit(1 << 20).alias("first_step"), F.row_number().over(Window.partitionBy(*key).orderBy(F.col("vector_score").desc_nulls_first(), "node_id")).alias("first_place"), "sources")
    both = merged.unionByName(behind, allowMissingColumns=True)
    order = F.struct("first_step", "first_place", "node_id")
    found = both.groupBy(*key, "node_id").agg(F.min(order).alias("_o"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.max("text_override").alias("text_override"), F.max("_pos").alias("_pos"), F.max("_end").alias("_end"), F.max("_parent").alias("_parent"))
    scored = (none if reranked is None else reranked).groupBy(*key, "node_id").agg(F.min("pos").alias("_r"))
    w = Window.partitionBy(*key).orderBy(F.col("_r").asc_nulls_last(), "_o")
    found = found.join(scored, [*key, "node_id"], "left").join(needed.withColumn("_needed", F.lit(True)), key, "left")
    found = found.withColumn("_r", F.when(F.col("_needed"), F.col("_r"))).withColumn("place", F.row_number().over(w)).where(F.col("_needed").isNull() | (F.col("place") <= most))
    kept = prefer_specific(found)
    own = nodes.select("doc_id", F.col("node_id").alias("_node"), "title", "tokens", F.col("pos").alias("_a"), F.col("end_pos").alias("_z"))
    kept = kept.withColumn("_node", F.coalesce("_parent", "node_id")).join(own, ["doc_id", "_node"], "left")
    size = F.when(F.col("text_override").isNotNull(), estimate_tokens(F.col("text_override"))).otherwise(F.coalesce("tokens", F.lit(0)))
    scanning = of("scan").select(*key).distinct().withColumn("_scan", F.lit(True))
    kept = kept.join(scanning, key, "left").select(*key, "place", "sources", "node_id", "title", size.alias("_tokens"), F.col("text_override").isNotNull().alias("_over"), F.coalesce("_pos", "_a").alias("pos"), F.coalesce("_end", "_z").alias("end_pos"), F.when(F.col("_scan"), scan_budget).otherwise(budget).alias("_limit"))
    kept = cut(kept, "kept")
    large = (F.col("_tokens") > F.col("_limit")) & ~F.col("_over")
    whole = kept.where(~large).withColumn("_part", F.lit(0))
    points = anchors.select("doc_id", "pos", estimate_tokens(F.col("text")).alias("_n"))
    inside = covered(points, ranks(points, kept.where(large), ["query_id", "node_id", "_limit"])).withColumnRenamed("pos", "_p")
    folded = greedy_batches(inside, [*key, "node_id"], "_p", "_n", "_limit", batch="_part", carry=["_n"])
    folded = folded.groupBy(*key, "node_id", "_part").agg(F.min("_p").alias("_from"), F.max("_p").alias("_to"), F.sum("_n").alias("_tokens"))
    parts = kept.where(large).drop("_tokens").join(folded, [*key, "node_id"])
    parts = parts.withColumns({"pos": F.col("_from"), "end_pos": F.col("_to") + 1})
    units = whole.unionByName(parts.select(whole.columns))
    units = cut(units.withColumn("unit", F.row_number().over(Window.partitionBy(*key).orderBy("place", "_part"))), "units")
    pages = greedy_batches(units, key, "unit", "_tokens", "_limit", batch="page")
    paged = units.join(pages, [*key, "unit"]).withColumn("_last", F.max("page").over(Window.partitionBy(*key))).where(F.col("page") == part)
    paged = cut(paged, "paged")
    facts = paged.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.sum("_tokens").alias("used"), F.max(F.col("page") < F.col("_last")).alias("has_more"))
    facts = facts.withColumn("next_part", F.when(F.col("has_more"), part + 1))
    context = anchor_context(paged.select(*key, F.col("unit").alias("place"), "title", "pos", "end_pos"), anchors, steps)
    return context.join(facts, key, "left").select(*key, "sources", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("has_more", F.lit(False)).alias("has_more"), "next_part", "context")


def content_units(matches: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """doc_id, node_id, part, text: what matches (doc_id, node_id, text, text_override, is_table, tokens) give to a page.

    An override wins. A table without text gives its row chunks (doc_id,
    node_id, part, text), one with text stays whole; other texts above the
    budget are cut.
    """
    over = F.col("text_override").isNotNull()
    blank = F.coalesce("is_table", F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) == "")
    whole = matches.where(over | (F.col("is_table") & ~blank)).select("doc_id", "node_id", F.lit(0).alias("part"), F.coalesce("text_override", "text").alias("text"))
    rows = chunks.join(matches.where(~over & blank).select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").select("doc_id", "node_id", "part", "text")
    texts = chunk_oversized(matches.where(~over & ~F.coalesce("is_table", F.lit(False))), budget)
    return whole.unionByName(rows).unionByName(texts)


def structure_summary(nodes: DataFrame) -> DataFrame:
    """doc_id, nodes, tokens, mode, tree of each document: tree lists its nodes in order, with id, level, title and tokens."""
    line = F.struct("pos", "node_id", "level", "title", "tokens")
    out = nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(line)).alias("tree"))
    return out.withColumn("mode", document_mode(F.col("tokens")))
