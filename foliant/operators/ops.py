"""Operations analytics over tasks, events, traces, users and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.sources.scratch import cut

ACTIVE = ("pending", "queued", "running")


def event_level(event: Column) -> Column:
    return F.when(event.rlike("failed|error|interrupted"), "ERROR").when(event.rlike("retry|cancelled|queued"), "WARNING").otherwise("INFO")


def event_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """start, event, level, n in tumbling windows; works on batches and streams alike."""
    return events.groupBy(F.window("ts", width).alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", event_level(F.col("event")).alias("level"), "n")


def classify_model_error(detail: Column) -> tuple[Column, Column]:
    """(kind, HTTP status): rerank before embed before default; status 100 to 599."""
    kind = F.when(F.contains(F.lower(detail), F.lit("rerank")), "rerank").when(F.contains(F.lower(detail), F.lit("embed")), "embed").otherwise("default")
    return kind, F.regexp_extract(detail, r"(?:^|\D)([1-5]\d\d)(?:\D|$)", 1).try_cast("int")


def task_state(events: DataFrame) -> DataFrame:
    """task_id, status, updated_at: that of the last event (by time, then id)."""
    last = F.struct("ts", "event_id")
    return events.groupBy("task_id").agg(F.max_by("status", last).alias("status"), F.max("ts").alias("updated_at"))


def active_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status").isin(*ACTIVE))


def reconcile_interrupted(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks with every active one failed, two events for each of those)."""
    hit = F.col("status").isin(*ACTIVE)
    fixed = tasks.withColumns({"status": F.when(hit, "failed").otherwise(F.col("status")), "error": F.when(hit, "WORKER_INTERRUPTED")})
    events = active_tasks(tasks).select("task_id", F.explode(F.array(F.lit("task_interrupted"), F.lit("task_failed"))).alias("event"))
    return fixed, events


def _seconds(name: str) -> Column:
    return F.col(name).cast("timestamp").cast("double")


def accepted_beats(beats: DataFrame, tasks: DataFrame) -> DataFrame:
    """Beats (worker, task_id, ...) of the worker that owns an active task (task_id, owner, status)."""
    own = active_tasks(tasks).select("task_id", F.col("owner").alias("worker"))
    return beats.join(own, ["task_id", "worker"], "left_semi")


def heartbeat_gaps(beats: DataFrame, timeout: float, tasks: DataFrame | None = None) -> DataFrame:
    """worker, event_id, gap: beats that come more than timeout seconds after the one before; with tasks only accepted_beats() count. As a stream: streaming.events.heartbeat_alerts()."""
    beats = beats if tasks is None else accepted_beats(beats, tasks)
    w = Window.partitionBy("worker").orderBy("ts", "event_id")
    gap = _seconds("ts") - F.lag(_seconds("ts")).over(w)
    return beats.withColumn("gap", F.round(gap, 3)).where(F.col("gap") > timeout).select("worker", "event_id", "gap")


def lease_concurrency(calls: DataFrame, ttl: float = 600.0) -> DataFrame:
    """kind, most: the largest number of leases held at once; a lease ends when released or after ttl seconds.

    A sweep over starts and ends: time is cut to hours first, so that a kind's
    sweep runs in many tasks, each starting from the leases still open.
    """
    a = _seconds("start")
    z = F.least(F.coalesce(_seconds("end"), a + ttl), a + ttl)
    leases = calls.select("kind", a.alias("a"), z.alias("z"))
    hours = F.explode(F.sequence(F.floor(F.col("a") / 3600), F.floor(F.col("z") / 3600))).alias("hour")
    pieces = leases.select("kind", "a", "z", hours)
    edges = pieces.select("kind", "hour", F.greatest(F.col("a"), F.col("hour") * 3600.0).alias("t"), F.lit(1).alias("d"), F.lit(1).alias("o")).union(pieces.select("kind", "hour", "z", F.lit(-1), F.lit(0)))
    w = Window.partitionBy("kind", "hour").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("_n", F.sum("d").over(w)).groupBy("kind").agg(F.max("_n").alias("most"))


def _lease_edges(calls: DataFrame, ttl: float) -> DataFrame:
    """kind, hour, t, d: starts (1) and ends (-1) of leases, cut at hours; ends come before starts of the same moment."""
    a = _seconds("start")
    z = F.least(F.coalesce(_seconds("end"), a + ttl), a + ttl)
    leases = calls.select("kind", a.alias("a"), z.alias("z")).where("z > a")
    pieces = leases.select("kind", "a", "z", F.explode(F.sequence(F.floor(F.col("a") / 3600), F.floor(F.col("z") / 3600))).alias("hour"))
    ends = F.array(F.struct(F.greatest(F.col("a"), F.col("hour") * 3600.0).alias("t"), F.lit(1).alias("d")), F.struct(F.least(F.col("z"), (F.col("hour") + 1) * 3600.0).alias("t"), F.lit(-1).alias("d")))
    return pieces.select("kind", "hour", F.explode(ends).alias("e")).select("kind", "hour", "e.*")


def time_above(calls: DataFrame, caps: DataFrame, ttl: float = 600.0) -> DataFrame:
    """kind, start, end (seconds), seconds, most: the maximal stretches of time in which more leases of a kind are held than its cap (caps: kind, cap), and the most that are held in each.

    Leases (kind, start, end) run out after ttl seconds. The running count is
    swept hour by hour, so that a kind's time spreads over tasks; stretches
    that go on into the next hour are then joined. Kinds without a cap have no
    stretches.
    """
    moments = _lease_edges(calls, ttl).groupBy("kind", "hour", "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("kind", "hour").orderBy("t")
    held = moments.withColumns({"n": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "to": F.lead("t").over(w)})
    above = held.join(caps.select("kind", "cap"), "kind").where("n > cap AND to IS NOT NULL").select("kind", "hour", F.col("t").alias("a"), F.col("to").alias("z"), "n")
    # within an hour, then across hours, of which a row is left for each stretch
    for keys in (["kind", "hour"], ["kind"]):
        w = Window.partitionBy(*keys).orderBy("a")
        first = F.coalesce(F.lag("z").over(w) != F.col("a"), F.lit(True)).cast("int")
        above = above.withColumn("_first", first).withColumn("_no", F.sum("_first").over(w)).groupBy(*keys, "_no").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.max("n").alias("n")).drop("_no")
    return above.select("kind", F.col("a").alias("start"), F.col("z").alias("end"), F.round(F.col("z") - F.col("a"), 3).alias("seconds"), F.col("n").alias("most"))


def lease_waits(calls: DataFrame, timeout: float = 300.0) -> DataFrame:
    """kind, n, granted, timed_out, mean, longest: waits (seconds) from request to grant of calls (kind, requested, start: null if never granted); those never granted, or later than timeout, have timed out and count in no wait."""
    wait = _seconds("start") - _seconds("requested")
    fine = wait.isNotNull() & (wait <= timeout)
    out = calls.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(fine, 1)).alias("granted"), F.avg(F.when(fine, wait)).alias("_mean"), F.max(F.when(fine, wait)).alias("_longest"))
    return out.select("kind", "n", "granted", (F.col("n") - F.col("granted")).alias("timed_out"), F.round("_mean", 3).alias("mean"), F.round("_longest", 3).alias("longest"))


def span_tree(runs: DataFrame) -> DataFrame:
    """run_id, depth, total, self, failed: depth below the root, the duration less that of direct children, and whether the run has an error.

    Every run points to the one above it; each round doubles how far pointers
    go, so a depth of any size takes as many rounds as it has binary digits.
    Runs below a parent that isn't there, and those in a cycle, have a null
    depth.
    """
    children = runs.where("parent_id is not null").groupBy(F.col("parent_id").alias("run_id")).agg(F.sum("duration").alias("_in"))
    up = cut(runs.select("run_id", F.col("parent_id").alias("_up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth")), "depths")
    while True:
        on = up.select(F.col("run_id").alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_more"), F.lit(True).alias("_there"))
        further = up.join(on, "_up", "left")
        # a pointer to nothing ends without a depth
        lost = F.col("_up").isNotNull() & F.col("_there").isNull()
        up_next = cut(further.select("run_id", F.when(~lost, F.col("_next")).alias("_up"), F.when(F.col("_up").isNull(), F.col("depth")).when(~lost, F.col("depth") + F.col("_more")).alias("depth")), "depths")
        open_before, open_now = (x.where("_up IS NOT NULL").count() for x in (up, up_next))
        up = up_next
        if open_now in (0, open_before) and (open_now == 0 or up.agg(F.max("depth")).first()[0] > up.count()):
            break
    depths = up.select("run_id", F.when(F.col("_up").isNull(), F.col("depth")).alias("depth"))
    error = F.coalesce("error", F.lit("")) != "" if "error" in runs.columns else F.lit(False)
    rows = runs.withColumn("failed", error).join(depths, "run_id", "left").join(children, "run_id", "left")
    return rows.select("run_id", "depth", F.round("duration", 3).alias("total"), F.round(F.col("duration") - F.coalesce("_in", F.lit(0.0)), 3).alias("self"), "failed")


# Actions that make up a workflow's main phases.
SUMMARY_ACTIONS = ["mcp_connect", "ingest_file(criteria)", "ingest_file(contract)", "contract_build_index", "design_tasks", "execute_criteria_complete", "compile_summary_comment", "generate_docx_report", "mcp_cleanup"]


def phase_durations(steps: DataFrame, actions: list[str] | None = None) -> DataFrame:
    """key, phase, seconds, tokens, n over the summary actions, and a row with a null phase for each key's total; steps (key, phase, action, seconds, tokens) without a phase are left out."""
    kept = steps.where(F.col("action").isin(actions or SUMMARY_ACTIONS) & (F.coalesce("phase", F.lit("")) != ""))
    each = kept.groupBy("key", "phase").agg(F.round(F.sum("seconds"), 2).alias("seconds"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.count("*").alias("n"))
    whole = each.groupBy("key").agg(F.round(F.sum("seconds"), 2).alias("seconds"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n"))
    return each.unionByName(whole.withColumn("phase", F.lit(None).cast("string")))


def stage_timings(records: DataFrame) -> DataFrame:
    """records (key, name, moment) with label: repeated names get #n from the second on."""
    i = F.row_number().over(Window.partitionBy("key", "name").orderBy("moment"))
    return records.withColumn("_i", i).withColumn("label", F.when(F.col("_i") == 1, F.col("name")).otherwise(F.concat("name", F.lit("#"), F.col("_i").cast("string")))).drop("_i")


def elapsed(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.format_string("%dm%02ds", F.floor(whole / 60), whole % 60)


def batch_summary(records: DataFrame, key: str) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return records.groupBy(key).agg(n("succeeded"), n("failed"), n("skipped"), F.count("*").alias("total"), elapsed(F.sum("seconds")).alias("elapsed"))


def user_rollup(users: DataFrame, history: DataFrame) -> DataFrame:
    """username, role, enabled, reviews, latest."""
    h = history.groupBy("username").agg(F.count("*").alias("_n"), F.max("created_at").alias("_last"))
    role = F.when(F.lower(F.trim("role")) == "admin", "admin").otherwise("user")
    return users.join(h, "username", "left").select("username", role.alias("role"), F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("_n", F.lit(0)).alias("reviews"), F.coalesce(F.date_format("_last", "yyyy-MM-dd"), F.lit("-")).alias("latest"))


def tenant_summary(users: DataFrame) -> DataFrame:
    """tenant, users, admins, disabled, reviews over rolled-up users."""
    return users.groupBy("tenant").agg(F.count("*").alias("users"), F.count(F.when(F.col("role") == "admin", 1)).alias("admins"), F.count(F.when(~F.col("enabled"), 1)).alias("disabled"), F.sum("reviews").alias("reviews"))


def recent_reviewers(users: DataFrame, k: int = 10) -> DataFrame:
    """tenant, place, username, latest: each tenant's k users (rolled up) of the newest reviews; users without any don't count, ties by name."""
    w = Window.partitionBy("tenant").orderBy(F.col("latest").desc(), "username")
    return users.where("latest <> '-'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("tenant", "place", "username", "latest")


def size_label(n: Column) -> Column:
    step = lambda d: F.format_string("%.1f", n / d)
    return F.when(n.isNull(), "-").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(step(1024.0), F.lit(" KB"))).when(n < 1 << 30, F.concat(step(float(1 << 20)), F.lit(" MB"))).otherwise(F.concat(step(float(1 << 30)), F.lit(" GB")))


def user_history(history: DataFrame, files: DataFrame, k: int = 20) -> DataFrame:
    """username, task_id, contract_name, report_name, contract_size, report_size, criteria_label, place: each user's newest k reports that exist.

    history: username, task_id, created_at, and contract_original_name,
    contract_stored_name, contract_bytes, report_name, criteria_source,
    criteria_name if it has them; files: task_id, bytes of stored reports.
    """
    have = lambda x, kind="string": F.col(x) if x in history.columns else F.lit(None).cast(kind)
    kept = history.join(files.select("task_id", "bytes"), "task_id")
    w = Window.partitionBy("username").orderBy(F.col("created_at").desc(), "task_id")
    top = kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    label = F.when(have("criteria_source") == "uploaded", F.concat(F.lit("Uploaded: "), F.coalesce(have("criteria_name"), F.lit("-")))).otherwise("Default criteria")
    contract = F.coalesce(have("contract_original_name"), have("contract_stored_name"), F.lit("-"))
    return top.select("username", "task_id", contract.alias("contract_name"), F.coalesce(have("report_name"), F.lit("-")).alias("report_name"), size_label(have("contract_bytes", "bigint")).alias("contract_size"), size_label(F.col("bytes")).alias("report_size"), label.alias("criteria_label"), "place")


def latest_task(tasks: DataFrame, logins: DataFrame) -> DataFrame:
    """username, task_id, running: the newest task; running if active and created since the login."""
    last = tasks.groupBy("username").agg(F.max_by(F.struct("task_id", "status", "created_at"), F.struct("created_at", "task_id")).alias("t"))
    rows = last.join(logins, "username", "left")
    return rows.select("username", "t.task_id", (F.col("t.status").isin(*ACTIVE) & F.coalesce(F.col("t.created_at") >= F.col("login_at"), F.lit(False))).alias("running"))


def upsert_history(history: DataFrame, records: DataFrame) -> DataFrame:
    """history with records of the same task replaced and new ones added."""
    return history.join(records.select("task_id"), "task_id", "left_anti").select(history.columns).unionByName(records)


def client_lookup(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """requests (request_id, key) with outcome: ok, missing, unknown, ambiguous, disabled or incomplete (a client without an id), and client_id if ok."""
    blank = F.trim(F.coalesce(F.col("client_id").cast("string"), F.lit(""))) == ""
    c = clients.groupBy("fingerprint").agg(F.count("*").alias("_n"), F.min("client_id").alias("_id"), F.bool_or("enabled").alias("_on"), F.bool_or(blank).alias("_blank"))
    out = requests.withColumn("fingerprint", F.sha2(F.col("key"), 256)).join(c, "fingerprint", "left")
    outcome = F.when(F.trim(F.coalesce("key", F.lit(""))) == "", "missing").when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous").when(~F.col("_on"), "disabled").when(F.col("_blank"), "incomplete").otherwise("ok")
    return out.select("request_id", outcome.alias("outcome"), F.when(outcome == "ok", F.col("_id")).alias("client_id"))


# What is shown of a client's task.
TASK_FIELDS = ("task_id", "status", "created_at", "started_at", "finished_at", "contract_filename", "result_filename")


def client_tasks(tasks: DataFrame, client: Column) -> DataFrame:
    """The fields of a client's tasks that are shown, as text, empty where a task has none; a task without a status could not be read."""
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")) if x in tasks.columns else F.lit("")
    shown = {x: text(x) for x in TASK_FIELDS} | {"task_id": F.col("task_id"), "status": F.coalesce("status", F.lit("unreadable"))}
    return tasks.where(F.col("client_id") == client).select(*(c.alias(x) for x, c in shown.items()))


def key_uniqueness(rows: DataFrame, key: str, pattern: str) -> DataFrame:
    """Keys that occur more than once or don't fit the pattern: key, n, valid."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).withColumn("valid", F.col("key").rlike(pattern)).where((F.col("n") > 1) | ~F.col("valid"))


def redact(fields: Column) -> Column:
    """A map with the values of key-like fields masked, unless empty."""
    secret = lambda k: F.lower(k).contains("api_key") | F.lower(k).contains("apikey") | (F.lower(k) == "key")
    return F.transform_values(fields, lambda k, v: F.when(secret(k) & (v != ""), "***").otherwise(v))


def conversation_flatten(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, call_no, tool_call_id, tool_name, arguments: a row for each message, and one for each further tool call of an assistant.

    messages: conv_id, turn, role, content (a string, or any other type, which
    is written as JSON), and tool_calls (array of struct id, name, arguments)
    and tool_call_id if they have them. Calls count for assistants, ids of
    answered calls for tools.
    """
    content = F.col("content") if dict(messages.dtypes)["content"] == "string" else F.to_json("content")
    calls = F.when(F.col("role") == "assistant", F.col("tool_calls")) if "tool_calls" in messages.columns else F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")
    answered = F.when(F.col("role") == "tool", F.col("tool_call_id")) if "tool_call_id" in messages.columns else F.lit(None).cast("string")
    rows = messages.select("conv_id", "turn", "role", content.alias("content"), answered.alias("_answered"), F.posexplode_outer(calls).alias("call_no", "_c"))
    return rows.select("conv_id", "turn", "role", "content", "call_no", F.coalesce("_c.id", "_answered").alias("tool_call_id"), F.col("_c.name").alias("tool_name"), F.col("_c.arguments").alias("arguments"))


def context_usage(messages: DataFrame, limit: int = 8000, rate: float = 0.3) -> DataFrame:
    """conv_id, messages, chars, tokens, over: estimated use of the context."""
    out = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    return out.withColumn("tokens", F.floor(F.col("chars") * rate)).withColumn("over", F.col("tokens") > limit)


def truncate_result(text: Column, most: int, rate: float = 0.3) -> Column:
    """A result cut where the estimate reaches most tokens, with a note."""
    return F.when(F.floor(F.length(text) * rate) <= most, text).otherwise(F.concat(F.substring(text, 1, int(most / rate)), F.lit("\n\n[... Content truncated ...]")))


def preview(text: Column, size: int) -> Column:
    """The first size characters, and how many are left out."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size), F.lit("...[truncated "), (F.length(text) - size).cast("string"), F.lit(" chars]")))


def call_payload_stats(messages: DataFrame, query: int = 200, answer: int = 500) -> DataFrame:
    """conv_id, message_count, input_chars, tool_count, tool_names, query_preview, output_chars, output_preview: of each call its size, its tools, and previews of the first and last message.

    messages: conv_id, turn, text, and tool (a name or null) if they have it.
    """
    tool = F.col("tool") if "tool" in messages.columns else F.lit(None).cast("string")
    rows = messages.withColumns({"_tool": F.when(tool != "", tool), "text": F.coalesce("text", F.lit(""))})
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("_tool").isNotNull(), F.struct("turn", "_tool")))), lambda x: x["_tool"])
    out = rows.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.sum(F.length("text")).alias("input_chars"), F.array_distinct(names).alias("tool_names"), F.min_by("text", "turn").alias("_q"), F.max_by("text", "turn").alias("_a"))
    return out.select("conv_id", "message_count", "input_chars", F.size("tool_names").alias("tool_count"), "tool_names", preview(F.col("_q"), query).alias("query_preview"), F.length("_a").alias("output_chars"), preview(F.col("_a"), answer).alias("output_preview"))


def task_listing(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """task_id, status, ready (succeeded, and its file exists) and, where tasks have a contract_path, stored: whether a folder of that path is named input."""
    have = files.select("task_id").distinct().withColumn("_f", F.lit(True))
    out = tasks.join(have, "task_id", "left")
    stored = [F.coalesce(F.array_contains(F.split("contract_path", r"[/\\\\]"), "input"), F.lit(False)).alias("stored")] if "contract_path" in tasks.columns else []
    return out.select("task_id", "status", ((F.col("status") == "succeeded") & F.col("_f").isNotNull()).alias("ready"), *stored)


def token_usage(calls: DataFrame) -> DataFrame:
    """task, agent, calls, prompt, completion, total, tool_calls, finish_reasons with subtotals and the total.

    calls: task, agent, prompt, completion, and total, tool_calls and
    finish_reason if they have them; a missing total is the sum of both.
    """
    both = F.coalesce("prompt", F.lit(0)) + F.coalesce("completion", F.lit(0))
    total = F.coalesce(F.col("total"), both) if "total" in calls.columns else both
    tools = F.coalesce("tool_calls", F.lit(0)) if "tool_calls" in calls.columns else F.lit(0)
    reason = F.col("finish_reason") if "finish_reason" in calls.columns else F.lit(None).cast("string")
    rows = calls.select("task", "agent", "prompt", "completion", total.alias("_total"), tools.alias("_tools"), reason.alias("_reason"))
    return rows.rollup("task", "agent").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("_total").alias("total"), F.sum("_tools").alias("tool_calls"), F.array_sort(F.collect_set("_reason")).alias("finish_reasons"))


def log_tasks(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """username, task_id, day, updated_at, has_log, place (newest update first): tasks (username, task_id, created_at, updated_at) and whether they have an event log (files: task_id)."""
    have = files.select("task_id").distinct().withColumn("_f", F.lit(True))
    w = Window.partitionBy("username").orderBy(F.col("updated_at").desc_nulls_last(), "task_id")
    day = F.substring(F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("")), 1, 10)
    return tasks.join(have, "task_id", "left").select("username", "task_id", day.alias("day"), "updated_at", F.col("_f").isNotNull().alias("has_log"), F.row_number().over(w).alias("place"))
