"""Review results: parsing, validation, resuming and anchoring of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import SPACE, nfkc, strip
from foliant.operators.patterns import with_terms


def extract_json(raw: Column) -> Column:
    """The object in a response: of its first code fence, else from the first { to the last }; null if none parses.

    Raw tabs and line breaks within strings are allowed, other control
    characters aren't.
    """
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    plain = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    body = F.when(fenced != "", fenced).otherwise(plain)
    flat = F.trim(F.translate(body, "\t\r\n", "   "))
    bad = flat.rlike(r"[\x00-\x1F]") | (F.substring(flat, 1, 1) != "{")
    return F.when(~bad & F.try_parse_json(flat).isNotNull(), flat)


def validate_review(rows: DataFrame) -> DataFrame:
    """criterion rows' violations, one each: id, rule.

    rows: id, status, comment, reason, n_issues, longest_issue, and fields (the
    names that a row came with) if they are to be checked.
    """
    n = F.coalesce("n_issues", F.lit(0))
    rules = [
        ("status", ~F.coalesce(F.col("status").isin("compliant", "issues_found", "not_applicable"), F.lit(False))),
        ("comment_blank", F.trim(F.coalesce("comment", F.lit(""))) == ""),
        ("comment_long", F.length("comment") > 100),
        ("issue_long", F.coalesce("longest_issue", F.lit(0)) > 160),
        ("compliant_with_issues", (F.col("status") == "compliant") & (n > 0)),
        ("issues_missing", (F.col("status") == "issues_found") & (n == 0)),
        ("reason_missing", (F.col("status") == "not_applicable") & (F.trim(F.coalesce("reason", F.lit(""))) == "")),
        ("not_applicable_with_issues", (F.col("status") == "not_applicable") & (n > 0)),
    ]
    if "fields" in rows.columns:
        rules.append(("unknown_field", F.size(F.array_except("fields", F.array(*map(F.lit, REVIEW_FIELDS)))) > 0))
    return _broken(rows, rules)


# Fields of a review's answer.
REVIEW_FIELDS = ["status", "applicability_reason", "issues"]


def _broken(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """id, rule of each rule that a row breaks."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules)))
    return rows.select("id", F.explode(broken).alias("rule"))


def _blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def validate_plan(plans: DataFrame, criteria: DataFrame) -> DataFrame:
    """id, rule: what is wrong with plans (id) and their criteria (id, criterion_id, section, criterion, check_points).

    A plan has at least one criterion; each has an id, a section, a text and at
    least one check point, none of them blank.
    """
    empty = lambda name: F.coalesce(name, F.lit("")) == ""
    points = F.coalesce("check_points", F.array().cast("array<string>"))
    rules = [(f"{x}_missing", empty(x)) for x in ("criterion_id", "section", "criterion")]
    rules += [("check_points_missing", F.size(points) == 0), ("check_point_blank", F.exists(points, _blank))]
    none = plans.select("id").join(criteria.select("id"), "id", "left_anti").select("id", F.lit("criteria_missing").alias("rule"))
    return _broken(criteria, rules).unionByName(none)


def validate_reflection(rows: DataFrame) -> DataFrame:
    """id, rule of reflections (id, status) that neither pass nor reject."""
    return _broken(rows, [("status", ~F.coalesce(F.col("status").isin("PASS", "REJECT"), F.lit(False)))])


def validate_summary(rows: DataFrame, most: int = 200, attempts: int = 3) -> DataFrame:
    """rows (id, overall, parts array, attempt) with valid: no blank part, and together at most most characters, whatever their length behind the attempts that ask for it."""
    parts = F.coalesce("parts", F.array().cast("array<string>"))
    overall = F.length(F.coalesce("overall", F.lit(""))) if "overall" in rows.columns else F.lit(0)
    total = F.aggregate(F.transform(parts, lambda x: F.length(x)), overall, lambda a, x: a + x)
    return rows.withColumn("valid", ((total <= most) | (F.col("attempt") >= attempts)) & ~F.exists(parts, _blank))


def pending(plan: DataFrame, outputs: DataFrame, errors: DataFrame, limit: int = 3) -> DataFrame:
    """task_id, criterion_id, attempt of planned criteria without output whose attempts are below limit."""
    used = errors.groupBy("task_id", "criterion_id").agg(F.max("attempt").alias("_n"))
    rest = plan.join(outputs.select("task_id", "criterion_id"), ["task_id", "criterion_id"], "left_anti").join(used, ["task_id", "criterion_id"], "left")
    return rest.withColumn("attempt", F.coalesce("_n", F.lit(0)) + 1).where(F.col("attempt") <= limit).select("task_id", "criterion_id", "attempt")


# What a criterion's id may be made of.
CRITERION_ID = r"^[A-Za-z0-9_.-]+$"


def latest_state(states: DataFrame) -> DataFrame:
    """task_id, criterion_id, the last payload of inputs and outputs, number of errors, all of them in order, and the last one.

    Ids are trimmed; rows with another id than CRITERION_ID allows are left out, see invalid_ids().
    """
    rows = states.withColumn("criterion_id", strip(F.col("criterion_id").cast("string"))).where(F.col("criterion_id").rlike(CRITERION_ID))
    at = F.struct("saved_at", "attempt")
    last = lambda kind: F.max_by("payload", F.when(F.col("kind") == kind, at))
    history = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "error", F.struct("saved_at", "attempt", "payload")))), lambda x: x["payload"])
    return rows.groupBy("task_id", "criterion_id").agg(last("input").alias("input"), last("output").alias("output"), F.count(F.when(F.col("kind") == "error", 1)).alias("errors"), history.alias("error_history"), last("error").alias("latest_error"))


def invalid_ids(states: DataFrame) -> DataFrame:
    """task_id, criterion_id of rows whose criterion id is blank or has other characters."""
    return states.where(~F.coalesce(strip(F.col("criterion_id").cast("string")).rlike(CRITERION_ID), F.lit(False))).select("task_id", "criterion_id").distinct()


def combine_results(plan: DataFrame, results: DataFrame) -> DataFrame:
    """task_id, statuses in the order of the plan (missing: ERROR), failed, error_message, tokens.

    plan: task_id, criterion_id, and place if the order isn't that of ids.
    results: task_id, criterion_id, status, tokens, and error if they have any;
    the message joins those of failed criteria, by id.
    """
    place = F.col("place") if "place" in plan.columns else F.col("criterion_id")
    rows = plan.join(results if "error" in results.columns else results.withColumn("error", F.lit(None).cast("string")), ["task_id", "criterion_id"], "left")
    status = {"compliant": "COMPLIANT", "issues_found": "ISSUES_FOUND", "not_applicable": "NOT_APPLICABLE"}
    named = F.coalesce(*(F.when(F.col("status") == k, v) for k, v in status.items()), F.col("status"), F.lit("ERROR"))
    rows = rows.withColumns({"_place": place, "status": named})
    ordered = lambda x, sep: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["t"]), sep)
    failed = F.col("status") == "ERROR"
    message = F.when(failed, F.struct("_place", F.concat(F.col("criterion_id").cast("string"), F.lit(": "), F.coalesce("error", F.lit("missing"))).alias("t")))
    return rows.groupBy("task_id").agg(ordered(F.struct("_place", F.col("status").alias("t")), ",").alias("statuses"), F.max(failed).alias("failed"), ordered(message, "; ").alias("error_message"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


def anchor_quotes(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """quotes (doc_id, quote_id, anchor, quote) with pos, start, end, status: the first exact place in the anchor's scope.

    A table's anchor covers all its paragraphs, in order. blocks: doc_id,
    anchor, pos, text.
    """
    q = quotes.withColumn("_q", F.trim("quote"))
    scope = q.join(blocks.select("doc_id", "anchor", "pos", "text"), ["doc_id", "anchor"], "left")
    at = F.when(F.col("_q") != "", F.position("_q", "text"))
    hit = scope.withColumn("_at", F.when(at > 0, at))
    best = F.min(F.when(F.col("_at").isNotNull(), F.struct("pos", "_at")))
    out = hit.groupBy("doc_id", "quote_id", "anchor", "_q").agg(best.alias("_b"), F.max(F.col("pos").isNotNull()).alias("_known"))
    start = F.col("_b._at") - 1
    status = F.when(F.col("_b").isNotNull(), "anchored").when(F.col("_known"), "missing_text_fallback").otherwise("unmatched")
    return out.select("doc_id", "quote_id", "anchor", F.col("_b.pos").alias("pos"), start.alias("start"), (start + F.length("_q")).alias("end"), status.alias("status"))


def anchor_stats(anchored: DataFrame, key: str = "doc_id") -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return anchored.groupBy(key).agg(F.count("*").alias("total"), n("anchored"), n("missing_text_fallback"), n("unmatched"))


def run_ranges(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, pos, run_no, start, end: the part of each run that a block's character span covers."""
    w = Window.partitionBy("doc_id", "pos").orderBy("run_no")
    upto = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = runs.withColumn("_z", upto).withColumn("_a", F.col("_z") - F.length("text"))
    s = spans.select("doc_id", "pos", F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = r.join(s, ["doc_id", "pos"]).where((F.col("_a") < F.col("_e")) & (F.col("_z") > F.col("_s")))
    return hit.select("doc_id", "pos", "run_no", (F.greatest("_s", "_a") - F.col("_a")).alias("start"), (F.least("_e", "_z") - F.col("_a")).alias("end"))


def _plain(c: Column) -> Column:
    """Compatibility form without white space."""
    return F.regexp_replace(nfkc(c), SPACE, "")


def resolve_table_evidence(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quotes (doc_id, table_id, quote_id, quote, source_ref) with status, resolved, matched_text and candidates.

    sources: doc_id, table_id, source_ref, text (see source_refs()). A quote
    matches a paragraph that holds it, or equals it in compatibility form
    without white space; then the paragraph's own text is what matched. With a
    ref: not_found, source_mismatch or matched. Without: all paragraphs that
    hold it word by word, or, if none does, all that equal it; none is
    not_found, several are ambiguous, one is matched.
    """
    q = quotes.withColumn("_q", strip(F.col("quote"))).withColumn("_n", _plain(F.col("_q")))
    s = sources.select("doc_id", "table_id", F.col("source_ref").alias("_ref"), F.col("text").alias("_s"), _plain(F.col("text")).alias("_m"))
    exact = (F.col("_q") != "") & F.contains("_s", "_q")
    equal = (F.col("_n") != "") & (F.col("_n") == F.col("_m"))
    pairs = q.join(s, ["doc_id", "table_id"], "left").withColumns({"_exact": F.coalesce(exact, F.lit(False)), "_equal": F.coalesce(equal, F.lit(False)), "_own": F.col("_ref") == F.col("source_ref")})
    found = F.struct("_ref", F.when(F.col("_exact"), F.col("_q")).otherwise(F.col("_s")).alias("t"))
    each = pairs.groupBy("doc_id", "table_id", "quote_id", "source_ref").agg(
        F.max("_own").alias("_exists"), F.max(F.when(F.col("_own") & (F.col("_exact") | F.col("_equal")), found)).alias("_fit"),
        F.array_sort(F.collect_set(F.when(F.col("_exact"), found))).alias("_a"), F.array_sort(F.collect_set(F.when(F.col("_equal"), found))).alias("_b"),
    ).withColumn("_c", F.when(F.size("_a") > 0, F.col("_a")).otherwise(F.col("_b")))
    n = F.size("_c")
    status = F.when(F.col("source_ref").isNotNull(), F.when(~F.coalesce("_exists", F.lit(False)), "not_found").when(F.col("_fit").isNull(), "source_mismatch").otherwise("matched"))
    status = F.coalesce(status, F.when(n == 0, "not_found").when(n > 1, "ambiguous").otherwise("matched"))
    one = F.when(F.col("source_ref").isNotNull(), F.col("_fit")).otherwise(F.try_element_at("_c", F.lit(1)))
    out = each.withColumns({"status": status, "candidates": F.transform("_c", lambda x: x["_ref"])})
    hit = lambda x: F.when(F.col("status") == "matched", one[x])
    return out.select("doc_id", "table_id", "quote_id", "status", hit("_ref").alias("resolved"), hit("t").alias("matched_text"), "candidates")


def comment_text(risk: Column, text: Column, criterion: Column) -> Column:
    """Lines of a comment; null parts are left out."""
    return F.concat_ws("\n", F.concat(F.lit("["), risk, F.lit("]")), text, F.concat(F.lit("Criterion: "), criterion))


def summary_text(points: Column) -> Column:
    """A numbered list."""
    return F.array_join(F.transform(points, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def flatten_issues(results: DataFrame) -> DataFrame:
    """A row for each issue of each result, with its number, section, criterion, risk_level, issue_comment, anchors, and the task's number of criteria and issues.

    results: task_id, criterion_id, section, criterion, issues (array of struct
    with risk_level, issue_comment and anchors).
    """
    sizes = results.groupBy("task_id").agg(F.count("*").alias("criteria_count"), F.sum(F.size(F.coalesce("issues", F.array()))).alias("issue_count"))
    rows = results.select("task_id", "criterion_id", "section", "criterion", F.posexplode("issues").alias("issue_no", "_i"))
    text = lambda x: F.coalesce(F.col(f"_i.{x}"), F.lit("")).alias(x)
    return rows.join(sizes, "task_id").select("task_id", "criterion_id", "section", "criterion", "issue_no", text("risk_level"), text("issue_comment"), F.col("_i.anchors").alias("anchors"), "criteria_count", "issue_count")


# How a missing provision is searched for.
SEARCH_FOR, SEARCH_BY = "查找合同中是否约定以下检查要点：", "\n所属审查标准："


def missing_evidence_queries(issues: DataFrame) -> DataFrame:
    """task_id, issue_no, query: search texts for issues (check_point, criterion, anchors) without anchors."""
    text = lambda x: F.coalesce(x, F.lit(""))
    return issues.where(F.size(F.coalesce("anchors", F.array())) <= 0).select("task_id", "issue_no", F.concat(F.lit(SEARCH_FOR), text("check_point"), F.lit(SEARCH_BY), text("criterion")).alias("query"))


# Lines that retrieval puts around its results.
RESULT_HEADER = r"(?m)^##\s*检索结果\s*\d+(?:\s*\([^)]*\))?\s*$"


def clean_context(text: Column, header: str = RESULT_HEADER) -> Column:
    """Without retrieval headers, at most one empty line in a row, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(text, header, ""), r"\n{3,}", "\n\n"))


def token_stats(rows: DataFrame, key: str, phases: list[str]) -> DataFrame:
    """Tokens of each phase and in total."""
    return rows.groupBy(key).agg(*(F.sum(F.when(F.col("phase") == p, F.col("tokens")).otherwise(0)).alias(p) for p in phases), F.sum("tokens").alias("total"))


def validate_annotations(evidence: DataFrame, anchors: DataFrame, criteria: DataFrame | None = None) -> DataFrame:
    """Evidence on known anchors, each (criterion, anchor, quote) once; a quote that isn't in the text becomes the whole text.

    With criteria (doc_id, criterion_id) those without any evidence keep a row with null anchor and quote.
    """
    hit = evidence.join(anchors.where(F.coalesce("text", F.lit("")) != "").select("doc_id", "anchor", "text"), ["doc_id", "anchor"])
    quote = strip(F.coalesce("quote", F.lit("")))
    out = hit.select("doc_id", "criterion_id", "anchor", F.when((quote != "") & F.contains("text", quote), quote).otherwise(F.col("text")).alias("quote")).distinct()
    return out if criteria is None else criteria.select("doc_id", "criterion_id").distinct().join(out, ["doc_id", "criterion_id"], "left")


def enrich_rule_evidence(criteria: DataFrame, evidence: DataFrame, anchors: DataFrame, rules: DataFrame) -> DataFrame:
    """For (doc, criterion) without evidence the first anchors with the rule's keyword, up to its limit."""
    bare = criteria.join(evidence.select("doc_id", "criterion_id"), ["doc_id", "criterion_id"], "left_anti").join(rules, "criterion_id")
    found = with_terms(anchors.select("doc_id", "pos", "anchor", "text"), ["text"], rules.select(F.col("keyword").alias("term")))
    found = found.select("doc_id", "pos", "anchor", F.explode("found.term").alias("keyword"))
    hit = bare.join(found, ["doc_id", "keyword"])
    w = Window.partitionBy("doc_id", "criterion_id").orderBy("pos")
    return hit.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= F.col("most")).select("doc_id", "criterion_id", "anchor")


def build_gold(criteria: DataFrame, evidence: DataFrame) -> DataFrame:
    """case_id, label, recall, notes: a positive row for each evidence, else one negative."""
    rows = criteria.join(evidence, ["doc_id", "criterion_id"], "left")
    case = F.format_string("GRP%03d-C%02d", "doc_id", "criterion_id")
    return rows.select(case.alias("case_id"), F.col("anchor").isNotNull().cast("int").alias("label"), "quote", F.when(F.col("anchor").isNotNull(), F.concat(F.lit("anchor="), "anchor")).alias("notes"))


# Words of review criteria, and beginnings of their lines.
CRITERIA_WORDS = ["审查", "审核", "要点", "合同", "条款", "风险", "责任", "违约", "付款", "期限", "义务", "权利", "金额", "争议"]
NUMBERED_LINE = r"(?m)^\s*(?:\d+[.、．]|[一二三四五六七八九十]+[、.．]|第[一二三四五六七八九十\d]+条)"


def check_criteria_text(docs: DataFrame, keywords: list[str] | None = None, least_chars: int = 100, least_keywords: int = 2, least_numbered: int = 2) -> DataFrame:
    """docs with fits: long enough without outer white space, with enough keywords and numbered lines."""
    n = sum((F.contains("text", F.lit(k)).cast("int") for k in keywords or CRITERIA_WORDS), F.lit(0))
    lines = F.regexp_count("text", F.lit(NUMBERED_LINE))
    return docs.select("doc_id", ((F.length(strip(F.col("text"))) >= least_chars) & (n >= least_keywords) & (lines >= least_numbered)).alias("fits"))


def require_meta_fields(rows: DataFrame, fields: list[str], required: bool = True) -> DataFrame:
    """rows (id, meta: a JSON object) with meta_fields (map of trimmed values), missing and invalid field names.

    A field that is no string is invalid and counts as empty; if fields are
    required, empty ones are missing.
    """
    meta = F.try_parse_json("meta")
    value = lambda k: F.try_variant_get(meta, f"$.{k}", "string")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(meta, f"$.{k}", "variant"))
    other = lambda k: value(k).isNotNull() & (kind(k) != "STRING") & (kind(k) != "VOID") | kind(k).rlike("^(OBJECT|ARRAY)")
    clean = lambda k: F.when(F.coalesce(other(k), F.lit(False)), "").otherwise(strip(F.coalesce(value(k), F.lit(""))))
    pairs = F.create_map(*(x for k in fields for x in (F.lit(k), clean(k))))
    missing = F.array_compact(F.array(*(F.when(F.lit(required) & (clean(k) == ""), k) for k in fields)))
    invalid = F.array_compact(F.array(*(F.when(F.coalesce(other(k), F.lit(False)), k) for k in fields)))
    return rows.select("id", pairs.alias("meta_fields"), missing.alias("missing"), invalid.alias("invalid"))


def document_start_anchor(blocks: DataFrame) -> DataFrame:
    """doc_id, anchor of the first block with a letter or digit."""
    return blocks.where(F.regexp_replace("text", r"[\p{Punct}\s\p{IsPunctuation}]+", "") != "").groupBy("doc_id").agg(F.min_by("anchor", "pos").alias("anchor"))
