"""Files in and out: discovery, manifests, caches, logs and index tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import strip
from foliant.sources.digests import PIECE, long_digests
from foliant.sources.lines import SPLIT, read_lines
from foliant.sources.scratch import cut


def discover_files(spark: SparkSession, path: str, glob: str = "*.docx", exclude: str | None = None) -> DataFrame:
    """path, length, content of files below a folder; lock files (~$) are left out. Content is read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.substring_index("path", "/", -1)
    files = files.where(~F.startswith(name, F.lit("~$")))
    return files.where(~F.contains("path", F.lit(exclude))) if exclude else files


def fingerprint(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """path, sha256 of each file (path, length, content); the content of one longer than piece bytes is not taken from there, but read in pieces."""
    short = files.where(F.col("length") <= piece).select("path", F.sha2("content", 256).alias("sha256"))
    return short.unionByName(long_digests(files.where(F.col("length") > piece), piece))


def manifest_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, change: added, modified, deleted or unchanged."""
    a, b = before.select("path", F.col("sha256").alias("_a")), now.select("path", F.col("sha256").alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def manifest_upsert(before: DataFrame, now: DataFrame) -> DataFrame:
    """The new manifest: unchanged entries of the old one, new entries for what was added or modified, none for what was deleted."""
    diff = manifest_diff(before, now)
    kept = before.join(diff.where("change = 'unchanged'"), "path", "left_semi")
    fresh = now.join(diff.where("change IN ('added', 'modified')"), "path", "left_semi")
    return kept.unionByName(fresh.select(before.columns))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Rows of gold CSV files as strings, quotes and line breaks in fields allowed."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def load_gold(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gold, errors): trimmed rows that keep the rules, and one row for each broken rule.

    row_number counts from 2, as the header is line 1; label is 0 or 1, and a
    positive needs recall text.
    """
    text = ["case_id", "query", "recall", "notes"]
    clean = rows.select("row_number", *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in text), F.trim("label").try_cast("int").alias("label"))
    rules = [("case_id", F.col("case_id") == ""), ("query", F.col("query") == ""), ("label", ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))), ("recall", (F.col("label") == 1) & (F.col("recall") == ""))]
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules)))
    marked = clean.withColumn("_broken", broken)
    return marked.where(F.size("_broken") == 0).drop("_broken"), marked.select("row_number", F.explode("_broken").alias("rule"))


def check_case_identity(gold: DataFrame, columns: list[str]) -> DataFrame:
    """case_id, variants of cases that stand for more than one combination of columns."""
    return gold.groupBy("case_id").agg(F.countDistinct(F.struct(*columns)).alias("variants")).where("variants > 1")


def load_criteria(blocks: DataFrame, pattern: str = r"^\s*(\d{1,2})[.、)）\s](.+)$") -> DataFrame:
    """set_id, criterion_id, criterion: numbered lines, the last of a number wins."""
    number = F.regexp_extract("text", pattern, 1).try_cast("int")
    rows = blocks.where(number.isNotNull()).select(F.col("doc_id").alias("set_id"), number.alias("criterion_id"), F.trim(F.regexp_extract("text", pattern, 2)).alias("criterion"), "pos")
    return rows.groupBy("set_id", "criterion_id").agg(F.max_by("criterion", "pos").alias("criterion"))


def missing_criteria(criteria: DataFrame) -> DataFrame:
    """set_id, criterion_id of gaps in 1..max."""
    full = criteria.groupBy("set_id").agg(F.max("criterion_id").alias("m")).select("set_id", F.explode(F.sequence(F.lit(1), "m")).alias("criterion_id"))
    return full.join(criteria, ["set_id", "criterion_id"], "left_anti")


#: Parts of an index: each a table by document.
STORES = ("structure", "content", "anchors", "tables", "titles", "tokens", "attachments", "report")


def write_index(stores: dict[str, DataFrame], path: str, partition: str | None = None) -> None:
    """Index tables (of STORES) as Parquet folders below path; partition by a column of few values where a table has it."""
    unknown = set(stores) - set(STORES)
    if unknown:
        raise ValueError(f"no parts of an index: {sorted(unknown)}")
    for name, df in stores.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition) if partition in df.columns else writer).parquet(f"{path}/{name}")


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def index_broken(spark: SparkSession, path: str) -> bool:
    """Whether an update of the index began and did not end."""
    system, place = _folder(spark, f"{path}/_updating")
    return system.exists(place)


def update_index(spark: SparkSession, path: str, now: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]], buckets: int = 64) -> DataFrame:
    """Bring an index up to date with a manifest (doc_id, path, sha256) and return what changed (path, change).

    Parts lie in buckets by hash of the document. Only buckets with a changed
    document are written again: documents that stay keep their rows, build
    (documents -> parts, of STORES) makes those of new and modified ones. The
    buckets in work are noted before the first write and the manifest is
    written last; an update that broke off is seen by index_broken(), and the
    next one makes all documents of its buckets again.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    system, place = _folder(spark, f"{path}/manifest")
    before = spark.read.parquet(f"{path}/manifest") if system.exists(place) else spark.createDataFrame([], now.select("doc_id", "path", "sha256").schema)
    changes = cut(manifest_diff(before, now), "changes")
    ids = before.select("path", "doc_id").unionByName(now.select("path", "doc_id")).distinct()
    touched = changes.where("change <> 'unchanged'").join(ids, "path").select(bucket("doc_id").alias("bucket")).distinct()
    broken = index_broken(spark, path)
    if broken:
        touched = touched.unionByName(spark.read.parquet(f"{path}/_updating")).distinct()
    numbers = sorted(r[0] for r in touched.collect())  # at most buckets rows
    if not numbers:
        return changes
    spark.createDataFrame([(b,) for b in numbers], "bucket int").write.mode("overwrite").parquet(f"{path}/_updating")
    again = F.lit(True) if broken else F.col("change").isin("added", "modified")
    fresh = now.join(changes, "path").where(again & bucket("doc_id").isin(numbers)).select(now.columns)
    for name, df in build(fresh).items():
        if name not in STORES:
            raise ValueError(f"no part of an index: {name}")
        system, place = _folder(spark, f"{path}/{name}")
        new = df.withColumn("bucket", bucket("doc_id"))
        if system.exists(place) and not broken:
            old = spark.read.schema(new.schema).parquet(f"{path}/{name}").where(F.col("bucket").isin(numbers))
            gone = changes.where("change <> 'unchanged'").join(ids, "path").select("doc_id")
            new = old.join(gone, "doc_id", "left_anti").unionByName(new)
        # what is read here is overwritten below
        new = cut(new, "buckets")
        for b in set(numbers) - {r[0] for r in new.select("bucket").distinct().collect()}:
            system.delete(_folder(spark, f"{path}/{name}/bucket={b}")[1], True)
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{name}")
    manifest = cut(now.select("doc_id", "path", "sha256"), "manifest")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    system.delete(_folder(spark, f"{path}/_updating")[1], True)
    return changes


def index_stores(nodes: DataFrame, anchors: DataFrame, tables: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts that follow from nodes (doc_id, node_id, parent_id, level, title, text, summary, tokens, pos, end_pos) and anchors: structure without texts, content, anchors, tables, titles, tokens and a report for each document."""
    own = ["doc_id", "node_id"]
    report = nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.sum("tokens").alias("tokens"))
    report = report.join(anchors.groupBy("doc_id").agg(F.count("*").alias("n_anchors"), F.count(F.when(F.col("kind") == "tbl", 1)).alias("n_tables")), "doc_id", "left")
    out = {
        "structure": nodes.select(*own, "parent_id", "level", "title", "summary", "tokens", "pos", "end_pos"),
        "content": nodes.select(*own, "text"),
        "anchors": anchors,
        "titles": nodes.select(*own, "level", "title"),
        "tokens": nodes.select(*own, "tokens"),
        "report": report,
    }
    return out if tables is None else out | {"tables": tables}


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(nodes, anchors, tables or None): structure joined with content; nodes have start_pos and n_anchors, those of the anchors in their span that no node below has."""
    part = lambda name: spark.read.parquet(f"{path}/{name}")
    nodes = part("structure").join(part("content"), ["doc_id", "node_id"], "left")
    anchors = part("anchors")
    if "node_id" in anchors.columns:
        owned = anchors.where("node_id IS NOT NULL").groupBy("doc_id", "node_id").agg(F.min("pos").alias("start_pos"), F.count("*").alias("n_anchors"))
        nodes = nodes.join(owned, ["doc_id", "node_id"], "left").withColumn("n_anchors", F.coalesce("n_anchors", F.lit(0)))
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tables")
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return nodes, anchors, part("tables") if there else None


def read_response_cache(spark: SparkSession, path: str, suffix: str = "", split: int = SPLIT) -> DataFrame:
    """key, value (a string, or any other value as JSON) of JSON lines: the last line of a key wins, by file, then by place in it; blank lines and those without a key are dropped."""
    lines = read_lines(spark, path, suffix, split).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", "key string, value string").alias("r"), F.struct("path", "offset").alias("_at")).where("r.key IS NOT NULL")
    return rows.groupBy(F.col("r.key").alias("key")).agg(F.max_by("r.value", "_at").alias("value"))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with value, misses) by key."""
    return requests.join(cache, "key"), requests.join(cache, "key", "left_anti")


# What a task's id and its client's folder may be made of.
TASK_ID, CLIENT_DIR = r"^[A-Za-z0-9_.-]+$", r"^[^/\\]+$"


def scan_tasks(spark: SparkSession, root: str) -> DataFrame:
    """task_id, client_dir, status of task files below root, each one JSON object.

    Two layouts count: api/<task>/task.json and web/<tenant>/<task>/task.json.
    Files that can't be read, lack an id or client, or name another task or
    client than their folder, are dropped.
    """
    schema = "task_id string, client_dir string, status string, _bad string"
    files = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "task.json").json(root)
    return valid_tasks(files.withColumn("path", F.col("_metadata.file_path")))


def valid_tasks(rows: DataFrame) -> DataFrame:
    """scan_tasks() of rows (path, task_id, client_dir, status, _bad)."""
    at = F.regexp_extract("path", r"(?:^|/)((?:api/[^/]+|web/[^/]+/[^/]+))/task\.json$", 1)
    folder, task = F.regexp_extract(at, "^(.*)/[^/]+$", 1), F.substring_index(at, "/", -1)
    named = F.col("task_id").rlike(TASK_ID) & (F.coalesce("client_dir", F.lit("")) != "") & (at != "")
    # below api the client is the root of all its tasks, below web the tenant's folder
    fits = (F.col("task_id") == task) & (F.col("client_dir") == F.when(F.startswith(at, F.lit("api/")), F.lit("api")).otherwise(folder))
    return rows.where(F.col("_bad").isNull() & named & fits).select("task_id", "client_dir", "status")


#: asctime - logger - level - event k=v ...
LOG_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)(?:,\d+)? - (.+?) - ([A-Z]+) - (\S+)(.*)$"


def parse_event_log(lines: DataFrame) -> DataFrame:
    """ts, logger, level, event, fields (map) of log lines; other lines are dropped. Works on streams too.

    A value is null, a quoted string with JSON's escapes, JSON, or plain text
    up to the next blank; JSON stays as it stands. The last value of a key wins.
    """
    part = lambda i: F.regexp_extract("value", LOG_LINE, i)
    # JSON values hold no blanks outside their strings, so a value is a run of quoted strings and other characters
    pairs = F.regexp_extract_all(part(5), F.lit(r'(\w+=(?:"(?:[^"\\]|\\.)*"|[^\s"])*)'), F.lit(1))
    key = lambda x: F.regexp_extract(x, r"^(\w+)=", 1)

    def value(x: Column) -> Column:
        raw = F.regexp_replace(x, r"^\w+=", "")
        text = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
        return F.when(raw == "null", F.lit(None)).when(F.startswith(raw, F.lit('"')), F.coalesce(text, raw)).otherwise(raw)

    keys = F.transform("_pairs", key)
    later = lambda i: F.array_contains(F.slice("_keys", i + 2, F.size("_keys")), F.get("_keys", i))
    entry = F.transform("_pairs", lambda x, i: F.struct(key(x).alias("key"), value(x).alias("value"), later(i).alias("again")))
    last = F.transform(F.filter(entry, lambda e: ~e["again"]), lambda e: F.struct(e["key"], e["value"]))
    rows = lines.where(F.col("value").rlike(LOG_LINE)).withColumn("_pairs", pairs).withColumn("_keys", keys)
    return rows.select(F.to_timestamp(part(1)).alias("ts"), part(2).alias("logger"), part(3).alias("level"), part(4).alias("event"), F.map_from_entries(last).alias("fields"))


def read_traces(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """trace_id, created_at, metadata, and of each of its runs run_id, parent_id, name, type, status, start_time, end_time, duration (seconds), inputs, outputs, run_metadata and error; objects stay JSON.

    A file is one document (multi_line), or has one on each line.
    """
    run = "id: string, run_id: string, parent_id: string, name: string, type: string, status: string, start_time: timestamp, end_time: timestamp, duration_seconds: double, duration: double, inputs: string, outputs: string, metadata: string, error: string"
    rows = spark.read.schema(f"trace_id string, created_at timestamp, metadata string, runs array<struct<{run}>>").option("multiLine", str(multi_line).lower()).json(path)
    each = rows.select("trace_id", "created_at", "metadata", F.explode("runs").alias("r"))
    same = ["parent_id", "name", "type", "status", "start_time", "end_time"]
    return each.select(
        "trace_id", "created_at", "metadata", F.coalesce("r.run_id", "r.id").alias("run_id"), *(f"r.{x}" for x in same), F.coalesce("r.duration", "r.duration_seconds").alias("duration"),
        "r.inputs", "r.outputs", F.col("r.metadata").alias("run_metadata"), "r.error",
    )


def agent_steps(lines: DataFrame) -> DataFrame:
    """path, offset, moment, agent_name and fields (a map; values that are no strings as JSON) of JSON lines of agents' steps; others are dropped. lines: those of read_lines(), or of stream_lines() as they come."""
    step = F.from_json("value", "map<string,string>")
    rows = lines.withColumn("_s", step).where(F.col("_s")["agent_name"].isNotNull())
    fields = F.map_filter("_s", lambda k, _: ~k.isin("timestamp", "agent_name"))
    return rows.select("path", "offset", F.col("_s")["timestamp"].try_cast("timestamp").alias("moment"), F.col("_s")["agent_name"].alias("agent_name"), fields.alias("fields"))


def write_results_csv(rows: DataFrame, path: str, lead: list[str]) -> None:
    """CSV with fixed leading columns, then the others in their order."""
    rows.select(*lead, *(c for c in rows.columns if c not in lead)).write.mode("overwrite").csv(path, header=True)


def heading_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown: headings (level up to 6) marked by #; a document that starts with text, or has no heading, gets one before it."""
    w = Window.partitionBy("doc_id")
    first = F.min(F.when(F.col("level").isNotNull(), F.struct("pos", "level"))).over(w)
    start = F.min("pos").over(w)
    mark = lambda n: F.concat(F.repeat(F.lit("#"), F.least(n, F.lit(6))), F.lit(" "))
    line = F.when(F.col("level").isNotNull(), F.concat(mark(F.col("level")), "text")).otherwise(F.col("text"))
    lead = F.when((F.col("pos") == F.col("_start")) & F.col("level").isNull(), F.concat(mark(F.coalesce("_first.level", F.lit(1))), F.lit("Text\n"))).otherwise(F.lit(""))
    rows = blocks.withColumns({"_first": first, "_start": start}).select("doc_id", "pos", F.concat(lead, line).alias("line"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def doc_title(blocks: DataFrame, marker: str, size: int = 80, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, title: the first line with the marker and at most size characters, else the first line, cut; with docs (doc_id, path) else the file's name without its ending.

    blocks are those of the front matter; blank lines don't count.
    """
    line = strip(F.col("text"))
    fits = F.contains(line, F.lit(marker)) & (F.length(line) <= size)
    out = blocks.where(line != "").groupBy("doc_id").agg(F.coalesce(F.min_by(line, F.when(fits, F.col("pos"))), F.substring(F.min_by(line, "pos"), 1, size)).alias("title"))
    if docs is None:
        return out
    return docs.select("doc_id", "path").join(out, "doc_id", "left").select("doc_id", F.coalesce("title", stem(F.col("path"))).alias("title"))


def base_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def stem(path: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


# What uploads are named with in front.
TASK_PREFIX = r"^\d{8}_\d{6}_[0-9a-f]{8}_"


def strip_task_prefix(name: Column) -> Column:
    """A file's name without folders and the date, time and number of its task; null counts as empty."""
    return F.regexp_replace(base_name(F.coalesce(name, F.lit(""))), TASK_PREFIX, "")


def sanitize_name(name: Column, fallback: str = "file", size: int = 120) -> Column:
    """A file name without folders and reserved characters, at most size characters."""
    clean = F.regexp_replace(F.regexp_replace(base_name(name), r'[<>:"|?*\s]+', "_"), r"^\.+|\.+$", "")
    return F.substring(F.when(clean == "", fallback).otherwise(clean), 1, size)


def name_collisions(names: DataFrame) -> DataFrame:
    """clean, n of names that clash once cleaned."""
    return names.groupBy(sanitize_name(F.col("name")).alias("clean")).agg(F.count("*").alias("n")).where("n > 1")
