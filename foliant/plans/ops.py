"""Queries over operations analytics: events are task events, orders tasks, customers users, line items calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import ops as H
from foliant.plans.adapt import table

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' WHEN 'P' THEN 'pending' ELSE o_orderstatus END"


def events(s, d):
    return table(s, d, "events").selectExpr("event_id", "user_id", "user_id AS task_id", "ts", "event_type AS event", "event_type AS status", "value", "props")


def tasks(s, d):
    return table(s, d, "orders").selectExpr("o_orderkey AS task_id", "o_custkey AS username", f"{STATUS} AS status", "o_orderdate AS created_at", "o_custkey % 7 AS client_id")


TASKS = f"tasks AS (SELECT o_orderkey AS task_id, o_custkey AS username, {STATUS} AS status, o_orderdate AS created_at, o_custkey % 7 AS client_id FROM orders)"


def files(s, d):
    return table(s, d, "orders").where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS task_id", "CAST(o_totalprice * 10 AS LONG) AS bytes")


FILES = "files AS (SELECT o_orderkey AS task_id, CAST(floor(o_totalprice * 10) AS BIGINT) AS bytes FROM orders WHERE o_orderkey % 3 <> 0)"


def users(s, d):
    return table(s, d, "customer").selectExpr("c_custkey AS username", "CASE WHEN c_custkey % 9 = 0 THEN ' Admin' ELSE c_mktsegment END AS role", "CASE WHEN c_custkey % 5 = 0 THEN false WHEN c_custkey % 5 = 1 THEN true END AS enabled", "c_nationkey AS tenant")


ROLL = TASKS + """, h AS (SELECT username, count(*) AS n, max(created_at) AS last FROM tasks GROUP BY username), u AS (SELECT c_custkey AS username, c_nationkey AS tenant, CASE WHEN c_custkey % 9 = 0 THEN 'admin' ELSE 'user' END AS role, CASE WHEN c_custkey % 5 = 0 THEN false ELSE true END AS enabled FROM customer),
roll AS (SELECT u.*, coalesce(n, 0) AS reviews, coalesce(strftime(last, '%Y-%m-%d'), '-') AS latest FROM u LEFT JOIN h USING (username))"""


def spans(s, d):
    """Trace runs: each event under the one of half its number."""
    return table(s, d, "events").selectExpr("event_id AS run_id", "CASE WHEN event_id > 0 THEN CAST(CASE WHEN event_id % 9 = 8 THEN -5 WHEN event_id < 60 THEN event_id - 1 ELSE floor(event_id / 8) END AS BIGINT) END AS parent_id", "value AS duration", "CASE WHEN event_type = 'error' THEN event_type END AS error")


def leases(s, d):
    return table(s, d, "events").selectExpr("event_type AS kind", "ts AS start", "CASE WHEN event_id % 3 <> 0 THEN ts + make_interval(0, 0, 0, 0, 0, 0, event_id % 900) END AS end")


def caps(s):
    """Caps of two of the kinds of leases."""
    return s.createDataFrame([("click", 1), ("view", 2)], "kind string, cap int")


def keys(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("client_id"), F.sha2(F.concat(F.lit("k"), (F.col("s_suppkey") - F.when(F.col("s_suppkey") % 10 == 1, 1).otherwise(0)).cast("string")), 256).alias("fingerprint"), (F.col("s_suppkey") % 7 != 3).alias("enabled"))


Q = {
    "h01_event_level": (lambda s, d: events(s, d).select("event_id", H.event_level(F.col("event")).alias("level")), "SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level FROM events"),
    "h02_event_counts": (lambda s, d: H.event_counts(events(s, d)), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS event, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS n FROM events GROUP BY ALL"),
    "h03_model_error": (
        lambda s, d: events(s, d).select("event_id", *(c.alias(n) for c, n in zip(H.classify_model_error(F.concat(F.when(F.col("event_id") % 3 == 0, "Rerank ").when(F.col("event_id") % 3 == 1, "embed ").otherwise(""), F.lit("HTTP "), (F.col("event_id") % 700).cast("string"))), ("kind", "code"), strict=True))),
        "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'rerank' WHEN 1 THEN 'embed' ELSE 'default' END AS kind, CASE WHEN event_id % 700 BETWEEN 100 AND 599 THEN CAST(event_id % 700 AS INT) END AS code FROM events",
    ),
    "h04_task_state": (lambda s, d: H.task_state(events(s, d)), "SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at FROM events GROUP BY user_id"),
    "h05_active_tasks": (lambda s, d: H.active_tasks(tasks(s, d)).select("task_id"), f"WITH {TASKS} SELECT task_id FROM tasks WHERE status IN ('pending', 'queued', 'running')"),
    "h06_reconcile": (lambda s, d: H.reconcile_interrupted(tasks(s, d))[0].select("task_id", "status", "error"), f"WITH {TASKS} SELECT task_id, CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('pending', 'running') THEN 'WORKER_INTERRUPTED' END AS error FROM tasks"),
    "h06_reconcile_events": (lambda s, d: H.reconcile_interrupted(tasks(s, d))[1], f"WITH {TASKS} SELECT task_id, unnest(['task_interrupted', 'task_failed']) AS event FROM tasks WHERE status IN ('pending', 'running')"),
    "h07_heartbeat_gaps": (
        lambda s, d: H.heartbeat_gaps(events(s, d).withColumnRenamed("user_id", "worker"), 86400.0),
        "WITH g AS (SELECT user_id AS worker, event_id, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 1e6, 3) AS gap, epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 1e6 AS g FROM events) SELECT worker, event_id, gap FROM g WHERE gap > 86400",
    ),
    "h07_owned_beats": (
        lambda s, d: H.heartbeat_gaps(events(s, d).selectExpr("event_id", "ts", "event_id % 60 AS task_id", "user_id % 5 AS worker"), 7200.0, s.range(60).selectExpr("id AS task_id", "id % 5 AS owner", "CASE WHEN id % 4 = 0 THEN 'failed' ELSE 'running' END AS status")),
        "WITH b AS (SELECT event_id, ts, event_id % 60 AS t, user_id % 5 AS worker FROM events WHERE event_id % 60 % 4 <> 0 AND event_id % 60 % 5 = user_id % 5), g AS (SELECT worker, event_id, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER (PARTITION BY worker ORDER BY ts, event_id) / 1e6, 3) AS gap FROM b) SELECT worker, event_id, gap FROM g WHERE gap > 7200",
    ),
    "h08_lease_concurrency": (
        lambda s, d: H.lease_concurrency(leases(s, d)),
        "WITH l AS (SELECT event_type AS kind, epoch_us(ts) / 1e6 AS a, CASE WHEN event_id % 3 <> 0 THEN least(epoch_us(ts) / 1e6 + event_id % 900, epoch_us(ts) / 1e6 + 600) ELSE epoch_us(ts) / 1e6 + 600 END AS z FROM events), e AS (SELECT kind, a AS t, 1 AS d, 1 AS o FROM l UNION ALL SELECT kind, z, -1, 0 FROM l), w AS (SELECT kind, sum(d) OVER (PARTITION BY kind ORDER BY t, o ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT kind, CAST(max(n) AS BIGINT) AS most FROM w GROUP BY kind",
    ),
    "h08_time_above": (
        lambda s, d: H.time_above(leases(s, d), caps(s)).select("kind", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "seconds", "most"),
        "WITH l AS (SELECT event_type AS kind, epoch_us(ts) AS a, CASE WHEN event_id % 3 <> 0 THEN least(epoch_us(ts) + event_id % 900 * 1000000, epoch_us(ts) + 600000000) ELSE epoch_us(ts) + 600000000 END AS z FROM events), e AS (SELECT kind, t, sum(d) AS d FROM (SELECT kind, a AS t, 1 AS d FROM l WHERE z > a UNION ALL SELECT kind, z, -1 FROM l WHERE z > a) GROUP BY ALL),"
        " h AS (SELECT kind, t, sum(d) OVER w AS n, lead(t) OVER w AS t2 FROM e WINDOW w AS (PARTITION BY kind ORDER BY t)), o AS (SELECT *, CASE WHEN lag(t2) OVER (PARTITION BY kind ORDER BY t) = t THEN 0 ELSE 1 END AS f FROM h WHERE t2 IS NOT NULL AND n > CASE kind WHEN 'click' THEN 1 WHEN 'view' THEN 2 END),"
        " g AS (SELECT *, sum(f) OVER (PARTITION BY kind ORDER BY t) AS i FROM o) SELECT kind, round(min(t) / 1e6, 3) AS start, round(max(t2) / 1e6, 3) AS \"end\", round((max(t2) - min(t)) / 1e6, 3) AS seconds, CAST(max(n) AS BIGINT) AS most FROM g GROUP BY kind, i",
    ),
    "h08_lease_waits": (
        lambda s, d: H.lease_waits(table(s, d, "events").selectExpr("event_type AS kind", "ts AS requested", "CASE WHEN event_id % 7 <> 0 THEN ts + make_interval(0, 0, 0, 0, 0, 0, event_id % 400) END AS start")),
        "WITH c AS (SELECT event_type AS kind, CASE WHEN event_id % 7 <> 0 AND event_id % 400 <= 300 THEN event_id % 400 END AS w FROM events) SELECT kind, count(*) AS n, count(w) AS granted, count(*) - count(w) AS timed_out, round(avg(w), 3) AS mean, CAST(max(w) AS DOUBLE) AS longest FROM c GROUP BY kind",
    ),
    "h09_span_tree": (
        lambda s, d: H.span_tree(spans(s, d)).where("run_id > 0"),
        "WITH RECURSIVE r AS (SELECT event_id AS run_id, CASE WHEN event_id > 0 THEN CASE WHEN event_id % 9 = 8 THEN -5 WHEN event_id < 60 THEN event_id - 1 ELSE event_id // 8 END END AS parent_id, value, event_type FROM events), t AS (SELECT run_id, 0 AS depth FROM r WHERE parent_id IS NULL UNION ALL SELECT r.run_id, t.depth + 1 FROM r JOIN t ON r.parent_id = t.run_id), c AS (SELECT parent_id AS run_id, sum(value) AS inner_s FROM r WHERE parent_id IS NOT NULL GROUP BY 1) SELECT r.run_id, t.depth, round(r.value, 3) AS total, round(r.value - coalesce(c.inner_s, 0), 3) AS self, event_type = 'error' AS failed FROM r LEFT JOIN t USING (run_id) LEFT JOIN c USING (run_id) WHERE r.run_id > 0",
    ),
    "h10_phase_durations": (
        lambda s, d: H.phase_durations(table(s, d, "events").selectExpr("user_id AS key", "CASE event_id % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'run' ELSE '' END AS phase", "event_type AS action", "CAST(event_id % 100 AS DOUBLE) AS seconds", "event_id % 50 AS tokens"), ["click", "view"]),
        "WITH k AS (SELECT user_id AS key, CASE event_id % 3 WHEN 0 THEN 'plan' ELSE 'run' END AS phase, event_id % 100 AS s, event_id % 50 AS t FROM events WHERE event_type IN ('click', 'view') AND event_id % 3 <> 2) SELECT key, phase, CAST(sum(s) AS DOUBLE) AS seconds, CAST(sum(t) AS BIGINT) AS tokens, count(*) AS n FROM k GROUP BY GROUPING SETS ((key, phase), (key))",
    ),
    "h11_stage_timings": (
        lambda s, d: H.stage_timings(table(s, d, "events").selectExpr("user_id AS key", "event_type AS name", "event_id AS moment")).select("key", "moment", "label"),
        "WITH r AS (SELECT user_id AS key, event_id AS moment, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events) SELECT key, moment, CASE WHEN i = 1 THEN event_type ELSE event_type || '#' || i END AS label FROM r",
    ),
    "h12_batch_summary": (
        lambda s, d: H.batch_summary(tasks(s, d).selectExpr("client_id", "CASE status WHEN 'running' THEN 'failed' WHEN 'pending' THEN 'skipped' ELSE status END AS status", "CAST(task_id % 50 AS DOUBLE) AS seconds"), "client_id"),
        f"WITH {TASKS}, g AS (SELECT client_id, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'running') AS failed, count(*) FILTER (status = 'pending') AS skipped, count(*) AS total, CAST(sum(task_id % 50) AS BIGINT) AS x FROM tasks GROUP BY client_id) SELECT client_id, succeeded, failed, skipped, total, x // 60 || 'm' || lpad(CAST(x % 60 AS VARCHAR), 2, '0') || 's' AS elapsed FROM g",
    ),
    "h13_user_rollup": (lambda s, d: H.user_rollup(users(s, d), tasks(s, d)), f"WITH {ROLL} SELECT username, role, enabled, reviews, latest FROM roll"),
    "h14_tenant_summary": (
        lambda s, d: H.tenant_summary(users(s, d).select("username", "tenant").join(H.user_rollup(users(s, d), tasks(s, d)), "username")),
        f"WITH {ROLL} SELECT tenant, count(*) AS users, count(*) FILTER (role = 'admin') AS admins, count(*) FILTER (NOT enabled) AS disabled, CAST(sum(reviews) AS BIGINT) AS reviews FROM roll GROUP BY tenant",
    ),
    "h14_recent_reviewers": (
        lambda s, d: H.recent_reviewers(users(s, d).select("username", "tenant").join(H.user_rollup(users(s, d), tasks(s, d)), "username")),
        f"WITH {ROLL}, r AS (SELECT tenant, row_number() OVER (PARTITION BY tenant ORDER BY latest DESC, username) AS place, username, latest FROM roll WHERE latest <> '-') SELECT * FROM r WHERE place <= 10",
    ),
    "h15_user_history": (
        lambda s, d: H.user_history(tasks(s, d).selectExpr("*", "CASE WHEN task_id % 5 <> 0 THEN concat('c', task_id) END AS contract_original_name", "CASE WHEN task_id % 2 = 0 THEN 'stored' END AS contract_stored_name", "CASE WHEN task_id % 4 <> 0 THEN task_id * 700 END AS contract_bytes", "CASE WHEN task_id % 3 = 1 THEN 'uploaded' END AS criteria_source", "CASE WHEN task_id % 6 = 1 THEN 'mine' END AS criteria_name"), files(s, d), 5).drop("report_size"),
        f"WITH {TASKS}, {FILES}, r AS (SELECT username, task_id, coalesce(CASE WHEN task_id % 5 <> 0 THEN 'c' || task_id END, CASE WHEN task_id % 2 = 0 THEN 'stored' END, '-') AS contract_name, '-' AS report_name, CASE WHEN task_id % 4 = 0 THEN '-' WHEN task_id * 700 < 1024 THEN (task_id * 700) || ' B' WHEN task_id * 700 < 1048576 THEN printf('%.1f KB', task_id * 700 / 1024.0::DOUBLE) WHEN task_id * 700 < 1073741824 THEN printf('%.1f MB', task_id * 700 / 1048576.0::DOUBLE) ELSE printf('%.1f GB', task_id * 700 / 1073741824.0::DOUBLE) END AS contract_size, CASE WHEN task_id % 3 = 1 THEN 'Uploaded: ' || CASE WHEN task_id % 6 = 1 THEN 'mine' ELSE '-' END ELSE 'Default criteria' END AS criteria_label, row_number() OVER (PARTITION BY username ORDER BY created_at DESC, task_id) AS place FROM tasks JOIN files USING (task_id)) SELECT * FROM r WHERE place <= 5",
    ),
    "h16_latest_task": (
        lambda s, d: H.latest_task(tasks(s, d), table(s, d, "customer").selectExpr("c_custkey AS username", "TIMESTAMP '1997-01-01' AS login_at")),
        f"WITH {TASKS}, l AS (SELECT username, arg_max(task_id, (created_at, task_id)) AS task_id, arg_max(status, (created_at, task_id)) AS status, max(created_at) AS c FROM tasks GROUP BY username) SELECT username, task_id, status IN ('pending', 'running') AND c >= TIMESTAMP '1997-01-01' AS running FROM l",
    ),
    "h17_upsert_history": (
        lambda s, d: H.upsert_history(tasks(s, d).select("task_id", "status"), tasks(s, d).where("task_id % 4 = 0").selectExpr("task_id * 3 AS task_id", "'new' AS status")),
        f"WITH {TASKS}, n AS (SELECT task_id * 3 AS task_id, 'new' AS status FROM tasks WHERE task_id % 4 = 0) SELECT task_id, status FROM tasks ANTI JOIN n USING (task_id) UNION ALL SELECT * FROM n",
    ),
    "h18_client_lookup": (
        lambda s, d: H.client_lookup(table(s, d, "customer").selectExpr("c_custkey AS request_id", "CASE WHEN c_custkey % 13 = 0 THEN '' ELSE concat('k', c_custkey % 150) END AS key"), keys(s, d)),
        "WITH k AS (SELECT s_suppkey AS id, s_suppkey - CASE WHEN s_suppkey % 10 = 1 THEN 1 ELSE 0 END AS f, s_suppkey % 7 <> 3 AS enabled FROM supplier), c AS (SELECT f, count(*) AS n, min(id) AS id, bool_or(enabled) AS e FROM k GROUP BY f), r AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 150 END AS f FROM customer), o AS (SELECT request_id, CASE WHEN r.f IS NULL THEN 'missing' WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN NOT e THEN 'disabled' ELSE 'ok' END AS outcome, id FROM r LEFT JOIN c USING (f)) SELECT request_id, outcome, CASE WHEN outcome = 'ok' THEN id END AS client_id FROM o",
    ),
    "h19_client_tasks": (lambda s, d: H.client_tasks(tasks(s, d).withColumn("status", F.expr("CASE WHEN task_id % 10 <> 0 THEN status END")), F.lit(3)), f"WITH {TASKS} SELECT task_id, CASE WHEN task_id % 10 <> 0 THEN status ELSE 'unreadable' END AS status, CAST(created_at AS VARCHAR) AS created_at, '' AS started_at, '' AS finished_at, '' AS contract_filename, '' AS result_filename FROM tasks WHERE client_id = 3"),
    "h20_key_uniqueness": (
        lambda s, d: H.key_uniqueness(table(s, d, "part").withColumn("id", F.regexp_replace("p_name", " ", F.lit("_"))), "id", "^[a-m][a-z_]*$"),
        "SELECT replace(p_name, ' ', '_') AS key, count(*) AS n, regexp_matches(replace(p_name, ' ', '_'), '^[a-m][a-z_]*$') AS valid FROM part GROUP BY 1 HAVING count(*) > 1 OR NOT regexp_matches(replace(p_name, ' ', '_'), '^[a-m][a-z_]*$')",
    ),
    "h21_redact": (
        lambda s, d: table(s, d, "customer").select("c_custkey", F.to_json(H.redact(F.create_map(F.lit("My_API_Key"), F.col("c_name"), F.lit("key"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("v"), F.lit("seg"), F.col("c_mktsegment")))).alias("fields")),
        """SELECT c_custkey, '{"My_API_Key":"***","key":"' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '***' END || '","seg":"' || c_mktsegment || '"}' AS fields FROM customer""",
    ),
    "h22_conversation": (
        lambda s, d: H.conversation_flatten(table(s, d, "conversations").withColumn("content", F.col("text")).withColumn("tool_calls", F.expr("transform(slice(split(text, ' '), 1, CAST(turn % 3 AS INT)), x -> struct(concat('c', length(x)) AS id, x AS name, text AS arguments))")).withColumn("tool_call_id", F.lit("t"))).drop("arguments"),
        "WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN list_slice(string_split(text, ' '), 1, turn % 3) ELSE [] END AS w FROM conversations), x AS (SELECT *, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE range(len(w)) END) AS i FROM c) SELECT conv_id, turn, role, text AS content, CAST(i AS INT) AS call_no, coalesce('c' || length(w[i + 1]), CASE WHEN role = 'tool' THEN 't' END) AS tool_call_id, w[i + 1] AS tool_name FROM x",
    ),
    "h23_context_usage": (lambda s, d: H.context_usage(table(s, d, "conversations"), 500), "WITH c AS (SELECT conv_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id) SELECT *, CAST(floor(chars * 0.3::DOUBLE) AS BIGINT) AS tokens, floor(chars * 0.3::DOUBLE) > 500 AS over FROM c"),
    "h23_truncate": (lambda s, d: table(s, d, "conversations").select("conv_id", "turn", H.truncate_result(F.col("text"), 30).alias("text")), "SELECT conv_id, turn, CASE WHEN floor(length(text) * 0.3::DOUBLE) <= 30 THEN text ELSE substr(text, 1, 100) || chr(10) || chr(10) || '[... Content truncated ...]' END AS text FROM conversations"),
    "h24_call_payload": (
        lambda s, d: H.call_payload_stats(table(s, d, "conversations").withColumn("tool", F.when(F.col("turn") % 2 == 1, F.substring("text", 1, 1))), 20, 30).withColumn("tool_names", F.array_join("tool_names", ",")),
        "WITH c AS (SELECT conv_id, count(*) AS message_count, CAST(sum(length(text)) AS BIGINT) AS input_chars, arg_min(text, turn) AS q, arg_max(text, turn) AS a FROM conversations GROUP BY conv_id), f AS (SELECT conv_id, x, min(turn) AS t FROM (SELECT conv_id, turn, substr(text, 1, 1) AS x FROM conversations WHERE turn % 2 = 1 AND text <> '') GROUP BY ALL), n AS (SELECT conv_id, count(*) AS k, string_agg(x, ',' ORDER BY t) AS names FROM f GROUP BY conv_id)"
        " SELECT conv_id, message_count, input_chars, CAST(coalesce(k, 0) AS INT) AS tool_count, coalesce(names, '') AS tool_names, CASE WHEN length(q) > 20 THEN substr(q, 1, 20) || '...[truncated ' || (length(q) - 20) || ' chars]' ELSE q END AS query_preview, CAST(length(a) AS INT) AS output_chars, CASE WHEN length(a) > 30 THEN substr(a, 1, 30) || '...[truncated ' || (length(a) - 30) || ' chars]' ELSE a END AS output_preview FROM c LEFT JOIN n USING (conv_id)",
    ),
    "h25_task_listing": (lambda s, d: H.task_listing(tasks(s, d), files(s, d)), f"WITH {TASKS}, {FILES} SELECT task_id, status, status = 'succeeded' AND task_id IN (SELECT task_id FROM files) AS ready FROM tasks"),
    "h25_stored_inputs": (
        lambda s, d: H.task_listing(tasks(s, d).withColumn("contract_path", F.concat(F.lit("/tasks/"), F.col("task_id").cast("string"), F.when(F.col("task_id") % 2 == 0, "/input/").when(F.col("task_id") % 3 == 0, "/inputs/").otherwise("\\input\\"), F.lit("c.docx"))), files(s, d)),
        f"WITH {TASKS}, {FILES} SELECT task_id, status, status = 'succeeded' AND task_id IN (SELECT task_id FROM files) AS ready, task_id % 2 = 0 OR task_id % 3 <> 0 AS stored FROM tasks",
    ),
    "h26_token_usage": (
        lambda s, d: H.token_usage(table(s, d, "lineitem").selectExpr("l_returnflag AS task", "l_linestatus AS agent", "CAST(l_quantity AS LONG) AS prompt", "l_linenumber AS completion", "CASE WHEN l_linenumber > 2 THEN l_linenumber * 100 END AS total", "l_suppkey % 3 AS tool_calls", "CASE WHEN l_suppkey % 2 = 0 THEN 'stop' WHEN l_suppkey % 5 = 0 THEN 'length' END AS finish_reason")).withColumn("finish_reasons", F.array_join("finish_reasons", ",")),
        "SELECT l_returnflag AS task, l_linestatus AS agent, count(*) AS calls, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS prompt, CAST(sum(l_linenumber) AS BIGINT) AS completion, CAST(sum(CASE WHEN l_linenumber > 2 THEN l_linenumber * 100 ELSE CAST(l_quantity AS BIGINT) + l_linenumber END) AS BIGINT) AS total, CAST(sum(l_suppkey % 3) AS BIGINT) AS tool_calls, coalesce(string_agg(DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 'stop' WHEN l_suppkey % 5 = 0 THEN 'length' END, ',' ORDER BY CASE WHEN l_suppkey % 2 = 0 THEN 'stop' WHEN l_suppkey % 5 = 0 THEN 'length' END), '') AS finish_reasons FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    ),
    "h27_log_tasks": (
        lambda s, d: H.log_tasks(tasks(s, d).withColumn("updated_at", F.expr("created_at + make_interval(0, 0, 0, CAST(task_id % 40 AS INT))")), files(s, d)),
        f"WITH {TASKS}, {FILES}, t AS (SELECT *, created_at + to_days(CAST(task_id % 40 AS INT)) AS updated_at FROM tasks) SELECT username, task_id, strftime(created_at, '%Y-%m-%d') AS day, updated_at, task_id IN (SELECT task_id FROM files) AS has_log, row_number() OVER (PARTITION BY username ORDER BY updated_at DESC, task_id) AS place FROM t",
    ),
}
