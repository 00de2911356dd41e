"""Queries over sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import ops as H
from foliant.operators import tree as D
from foliant.plans.adapt import BLOCKS, blocks, table
from foliant.plans.blocks import NUMBERED, numbered
from foliant.plans.tree import NODES, nodes
from foliant.sources import tables as A
from foliant.sources.scratch import cut, scratch
from foliant.streaming import events as S


def before(s, d):
    return table(s, d, "part").where("p_partkey % 7 <> 0").selectExpr("CAST(p_partkey AS STRING) AS path", "sha2(p_name, 256) AS sha256")


def now(s, d):
    return table(s, d, "part").where("p_partkey % 5 <> 0").selectExpr("CAST(p_partkey AS STRING) AS path", "sha2(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END, 256) AS sha256")


MANIFEST = "a AS (SELECT CAST(p_partkey AS VARCHAR) AS path, sha256(p_name) AS x FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT CAST(p_partkey AS VARCHAR) AS path, sha256(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END) AS y FROM part WHERE p_partkey % 5 <> 0)"


def gold_rows(s, d):
    return table(s, d, "orders").selectExpr("o_orderkey + 2 AS row_number", "CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE concat(' ', o_custkey, ' ') END AS case_id", "o_orderpriority AS query", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS recall", "CAST(NULL AS STRING) AS notes", "CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(o_orderkey % 2 AS STRING) END AS label")


GOLD = "g AS (SELECT o_orderkey + 2 AS row_number, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS case_id, o_orderpriority AS query, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS recall, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 2 AS INT) END AS label FROM orders)"


def round_trip(s, d, write, read, name):
    path = scratch(s, name)
    write(path)
    return read(path)


def response_cache(s, d):
    """Lines as a cache appends them, in the order of events, and read in splits."""
    rows = table(s, d, "events").orderBy("event_id").select(F.to_json(F.struct(F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"))).alias("value"))
    return round_trip(s, d, lambda p: rows.write.text(p), lambda p: A.read_response_cache(s, p, ".txt", 1 << 20), "cache")


def log_lines(s, d):
    e = table(s, d, "events")
    return e.select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123 - api - INFO - "), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(' note="a \\"b\\" = c" id=first none=null data={"k":[1,"x y"]} id='), F.col("event_id").cast("string")).alias("value"))


def csv_round_trip(s, d):
    rows = table(s, d, "nation")
    return round_trip(s, d, lambda p: A.write_results_csv(rows, p, ["n_name"]), lambda p: s.read.schema("n_name string, n_nationkey int, n_regionkey int").csv(p, header=True), "csv")


def traces(s, d):
    e = table(s, d, "events").groupBy(F.col("user_id").cast("string").alias("trace_id")).agg(F.collect_list(F.struct(F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("parent_id"), F.col("value").alias("duration"))).alias("runs"))
    return round_trip(s, d, lambda p: e.write.json(p), lambda p: A.read_traces(s, p).select("trace_id", "run_id", "parent_id", "duration"), "traces")


def scanned(s, d):
    """Task files as rows: some broken, some without an id, some in another place than they say."""
    t = table(s, d, "orders")
    k = F.col("o_orderkey").cast("string")
    path = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("s3://x/api/"), k, F.lit("/task.json"))).otherwise(F.concat(F.lit("s3://x/web/t1/"), F.when(F.col("o_orderkey") % 10 == 7, "other").otherwise(k), F.lit("/task.json")))
    own = F.when(F.col("o_orderkey") % 10 != 4, k)
    client = F.when(F.col("o_orderkey") % 10 == 6, "web").when(F.col("o_orderkey") % 2 == 0, "api").otherwise("web/t1")
    return A.valid_tasks(t.select(path.alias("path"), own.alias("task_id"), client.alias("client_dir"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 10 == 3, "{broken").alias("_bad")))


def index_parts(s, d):
    b = blocks(s, d)
    # most parts read them
    n = cut(nodes(s, d).select("doc_id", "node_id", "parent_id", "level", "title", "tokens", "pos", "end_pos"), "index_nodes")
    a = D.own_anchors(b.select("doc_id", "pos", "kind", "text"), n)
    return A.index_stores(n.withColumns({"text": F.col("title"), "summary": F.col("title")}), a, b.where("kind = 'tbl'").select("doc_id", "pos", "text"))


def updated_index(s, d):
    """Titles of an index that was built for some documents and then followed a manifest with others: some are new, some changed, some gone."""
    docs = table(s, d, "documents").select("doc_id", "source", "n_chars", F.col("doc_id").cast("string").alias("path"))
    title = F.concat_ws(":", "source", F.col("sha256"))
    build = lambda rows: {"titles": rows.select("doc_id", title.alias("title"))}
    path = scratch(s, "kept_index")
    A.update_index(s, path, docs.where("doc_id % 3 <> 0").withColumn("sha256", F.col("n_chars").cast("string")), build, 8)
    A.update_index(s, path, docs.where("doc_id % 7 <> 0").withColumn("sha256", (F.col("n_chars") + (F.col("doc_id") % 5 == 0).cast("int")).cast("string")), build, 8)
    return s.read.parquet(f"{path}/titles").select("doc_id", "title")


Q = {
    "a01_discover_files": (lambda s, d: A.discover_files(s, d, "*.parquet").select(F.substring_index("path", "/", -1).alias("name"), "length"), None),
    "a02_fingerprint": (lambda s, d: A.fingerprint(A.discover_files(s, d, "*.parquet")).select(F.substring_index("path", "/", -1).alias("name"), "sha256"), None),
    "a03_manifest_diff": (lambda s, d: A.manifest_diff(before(s, d), now(s, d)), f"WITH {MANIFEST} SELECT path, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'deleted' WHEN x = y THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b USING (path)"),
    "a04_manifest_upsert": (lambda s, d: A.manifest_upsert(before(s, d), now(s, d)), f"WITH {MANIFEST} SELECT path, y AS sha256 FROM b"),
    "a05_load_gold": (lambda s, d: A.load_gold(gold_rows(s, d))[0].drop("notes"), f"WITH {GOLD} SELECT * FROM g WHERE case_id <> '' AND label IS NOT NULL AND NOT (label = 1 AND recall = '')"),
    "a05_gold_errors": (lambda s, d: A.load_gold(gold_rows(s, d))[1], f"WITH {GOLD}, e AS (SELECT row_number, unnest([CASE WHEN case_id = '' THEN 'case_id' END, CASE WHEN label IS NULL THEN 'label' END, CASE WHEN label = 1 AND recall = '' THEN 'recall' END]) AS rule FROM g) SELECT * FROM e WHERE rule IS NOT NULL"),
    "a06_case_identity": (lambda s, d: A.check_case_identity(A.load_gold(gold_rows(s, d))[0], ["query", "recall"]), f"WITH {GOLD} SELECT case_id, count(DISTINCT (query, recall)) AS variants FROM g WHERE case_id <> '' AND label IS NOT NULL AND NOT (label = 1 AND recall = '') GROUP BY case_id HAVING count(DISTINCT (query, recall)) > 1"),
    "a07_load_criteria": (
        lambda s, d: A.load_criteria(numbered(s, d)),
        f"WITH {NUMBERED}, c AS (SELECT doc_id AS set_id, CAST(regexp_extract(text, '^\\s*(\\d{{1,2}})[.、)）\\s](.+)$', 1) AS INT) AS criterion_id, trim(regexp_extract(text, '^\\s*(\\d{{1,2}})[.、)）\\s](.+)$', 2), ' ') AS criterion, pos FROM numbered WHERE regexp_matches(text, '^\\s*(\\d{{1,2}})[.、)）\\s](.+)$')) SELECT set_id, criterion_id, arg_max(criterion, pos) AS criterion FROM c GROUP BY ALL",
    ),
    "a07_missing_criteria": (
        lambda s, d: A.missing_criteria(A.load_criteria(numbered(s, d))),
        f"WITH {NUMBERED}, c AS (SELECT DISTINCT doc_id AS set_id, CAST(regexp_extract(text, '^\\s*(\\d{{1,2}})[.、)）\\s](.+)$', 1) AS INT) AS criterion_id FROM numbered WHERE regexp_matches(text, '^\\s*(\\d{{1,2}})[.、)）\\s](.+)$')), f AS (SELECT set_id, unnest(range(1, max(criterion_id) + 1)) AS criterion_id FROM c GROUP BY set_id) SELECT set_id, CAST(criterion_id AS INT) AS criterion_id FROM f ANTI JOIN c USING (set_id, criterion_id)",
    ),
    "a08_index_round_trip": (
        lambda s, d: round_trip(s, d, lambda p: A.write_index(index_parts(s, d), p, "level"), lambda p: A.read_index(s, p)[0].select("doc_id", "node_id", F.col("level").cast("int").alias("level"), "title", "text", "start_pos", "n_anchors"), "index"),
        f"WITH {NODES}, o AS (SELECT b.doc_id, b.pos, arg_max(n.node_id, n.pos) AS node_id FROM blocks b JOIN nodes n ON n.doc_id = b.doc_id AND b.pos >= n.pos AND b.pos < n.end_pos GROUP BY b.doc_id, b.pos), a AS (SELECT doc_id, node_id, min(pos) AS start_pos, count(*) AS k FROM o GROUP BY ALL) SELECT n.doc_id, n.node_id, level, title, title AS text, start_pos, coalesce(k, 0) AS n_anchors FROM nodes n LEFT JOIN a USING (doc_id, node_id)",
    ),
    "a09_index_report": (
        lambda s, d: round_trip(s, d, lambda p: A.write_index(index_parts(s, d), p), lambda p: s.read.parquet(f"{p}/report"), "index"),
        f"WITH {NODES}, a AS (SELECT doc_id, count(*) AS n_anchors, count(*) FILTER (kind = 'tbl') AS n_tables FROM blocks GROUP BY doc_id) SELECT n.doc_id, count(*) AS n_nodes, CAST(sum(tokens) AS BIGINT) AS tokens, any_value(n_anchors) AS n_anchors, any_value(n_tables) AS n_tables FROM nodes n JOIN a USING (doc_id) GROUP BY n.doc_id",
    ),
    "a09_update_index": (
        updated_index,
        "SELECT doc_id, source || ':' || n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS title FROM documents WHERE doc_id % 7 <> 0",
    ),
    "a10_response_cache": (response_cache, "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id) AS value FROM events GROUP BY user_id"),
    "a11_cache_misses": (
        lambda s, d: A.cache_lookup(table(s, d, "customer").select("c_custkey", A.cache_key(F.lit("v1"), F.col("c_custkey").cast("string")).alias("key")), table(s, d, "orders").select(A.cache_key(F.lit("v1"), F.col("o_custkey").cast("string")).alias("key")).distinct())[1],
        "SELECT c_custkey, sha256('v1' || chr(10) || c_custkey) AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    ),
    "a12_scan_tasks": (scanned, "SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'api' ELSE 'web/t1' END AS client_dir, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 NOT IN (3, 4, 6, 7)"),
    "a13_parse_event_log": (
        lambda s, d: A.parse_event_log(log_lines(s, d)).select("ts", "logger", "event", "level", *(F.col("fields")[x].alias(x) for x in ("user", "note", "id", "none", "data"))),
        "SELECT date_trunc('second', ts) AS ts, 'api' AS logger, event_type AS event, 'INFO' AS level, CAST(user_id AS VARCHAR) AS user, 'a \"b\" = c' AS note, CAST(event_id AS VARCHAR) AS id, NULL AS none, '{\"k\":[1,\"x y\"]}' AS data FROM events",
    ),
    "a14_read_traces": (traces, "SELECT CAST(user_id AS VARCHAR) AS trace_id, CAST(event_id AS VARCHAR) AS run_id, event_type AS parent_id, value AS duration FROM events"),
    "a15_read_steps": (lambda s, d: S.run_available(S.levels(S.read_events(s, d)).select("event_id", "level"), "append", "steps"), "SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level FROM events"),
    "a16_results_csv": (csv_round_trip, "SELECT n_name, n_nationkey, n_regionkey FROM nation"),
    "a17_heading_markdown": (
        lambda s, d: A.heading_markdown(blocks(s, d)),
        f"WITH {BLOCKS}, f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id) AS st, first_value(level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fl FROM blocks) SELECT doc_id, string_agg(CASE WHEN pos = st AND level IS NULL THEN repeat('#', coalesce(fl, 1)) || ' Text' || chr(10) ELSE '' END || CASE WHEN level IS NOT NULL THEN repeat('#', level) || ' ' ELSE '' END || text, chr(10) ORDER BY pos) AS markdown FROM f GROUP BY doc_id",
    ),
    "a18_doc_title": (
        lambda s, d: A.doc_title(blocks(s, d).where("doc_id % 6 <> 5"), "tion", docs=table(s, d, "documents").select("doc_id", F.concat(F.lit("/in/d.x"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"))),
        f"WITH {BLOCKS}, t AS (SELECT doc_id, coalesce(arg_min(text, pos) FILTER (contains(text, 'tion') AND n <= 80), substr(arg_min(text, pos), 1, 80)) AS title FROM blocks WHERE doc_id % 6 <> 5 GROUP BY doc_id) SELECT d.doc_id, coalesce(title, 'd.x' || d.doc_id) AS title FROM documents d LEFT JOIN t USING (doc_id)",
    ),
    "a19_task_prefix": (lambda s, d: table(s, d, "customer").select("c_custkey", A.strip_task_prefix(F.concat(F.when(F.col("c_custkey") % 3 == 0, "up\\\\").otherwise(""), F.when(F.col("c_custkey") % 2 == 0, "20240102_030405_0a1b2c3d_").otherwise("2024_"), "c_name")).alias("name")), "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '2024_' END || c_name AS name FROM customer"),
    "a19_sanitize_name": (lambda s, d: table(s, d, "pages").select("page_id", A.sanitize_name(F.col("url")).alias("name")), "SELECT page_id, substr(CASE WHEN n = '' THEN 'file' ELSE n END, 1, 120) AS name FROM (SELECT page_id, regexp_replace(regexp_replace(list_last(string_split(url, '/')), '[<>:\"|?*\\s]+', '_', 'g'), '^\\.+|\\.+$', '', 'g') AS n FROM pages)"),
    "a19_name_collisions": (lambda s, d: A.name_collisions(table(s, d, "part").withColumnRenamed("p_name", "name")), "SELECT replace(p_name, ' ', '_') AS clean, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1"),
    "h02_stream_counts": (lambda s, d: S.run_available(S.windowed_counts(S.read_events(s, d)), "complete", "counts"), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS event, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS n FROM events GROUP BY ALL"),
    "h02_stream_sessions": (
        lambda s, d: S.run_available(S.sessions(S.read_events(s, d)), "complete", "sessions"),
        "WITH g AS (SELECT user_id AS task_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), i AS (SELECT *, sum(b) OVER (PARTITION BY task_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT task_id, min(ts) AS start, count(*) AS n FROM i GROUP BY task_id, s",
    ),
    "h04_stream_task_state": (
        lambda s, d: S.run_available(S.task_state(S.read_events(s, d)), "update", "state", lambda r: r.groupBy("task_id").agg(F.max_by("status", F.struct("moment", "event_id")).alias("status"))),
        "SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id",
    ),
    "h07_stream_gaps": (
        lambda s, d: S.run_available(S.heartbeat_alerts(S.read_events(s, d).select("event_id", F.col("task_id").alias("worker"), "ts"), 6 * 3600.0), "append", "beats").where("kind = 'gap'").select("worker", "moment", F.round("gap", 3).alias("gap")),
        "WITH g AS (SELECT user_id AS worker, epoch_us(ts) AS moment, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 3) AS gap FROM events) SELECT worker, moment, gap FROM g WHERE gap > 21600",
    ),
    "h07_beats_per_worker": (lambda s, d: H.heartbeat_gaps(table(s, d, "events").withColumnRenamed("user_id", "worker"), 3600.0).groupBy("worker").agg(F.count("*").alias("gaps"), F.max("gap").alias("longest")), "WITH g AS (SELECT user_id AS worker, epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 1e6 AS g FROM events) SELECT worker, count(*) AS gaps, max(round(g, 3)) AS longest FROM g WHERE g > 3600 GROUP BY worker"),
}
