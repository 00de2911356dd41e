"""Lines with their places, in batches and as files grow; caches, steps and traces as they are on disk."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.sources import tables as A
from foliant.sources.lines import read_lines, stream_lines


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_lines_of_split_files(spark, tmp_path, split):
    data = {"a.log": b"one\n\ntwo \xc3\xa4\r\nlast without end", "sub/b.log": b"\n", "c.txt": b"no\n", "_d.log": b"no\n", "empty.log": b""}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.offset, r.value) for r in read_lines(spark, str(tmp_path), ".log", split).collect())
    assert got == [("a.log", 1, 0, "one"), ("a.log", 2, 4, ""), ("a.log", 3, 5, "two ä"), ("a.log", 4, 13, "last without end"), ("b.log", 1, 0, "")]


def test_no_files(spark, tmp_path):
    assert read_lines(spark, str(tmp_path), ".log").count() == 0


@pytest.mark.parametrize("split", [16, 1 << 20])
def test_cache_file_as_written(spark, tmp_path, split):
    records = [("a", "1"), ("b", {"x": [1, "ä"]}), ("a", "2"), ("c", None), ("b", "last")]
    (tmp_path / "cache.jsonl").write_text("".join(json.dumps({"key": k, "value": v}, ensure_ascii=False) + "\n" for k, v in records) + "\n", encoding="utf-8")
    got = {r.key: r.value for r in A.read_response_cache(spark, f"{tmp_path}/cache.jsonl", split=split).collect()}
    assert got["a"] == "2" and got["b"] == "last" and got.get("c") is None
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "z.jsonl").write_text('{"key": "a", "value": {"n": 1}}\n', encoding="utf-8")
    got = {r.key: r.value for r in A.read_response_cache(spark, str(tmp_path), ".jsonl").collect()}
    assert json.loads(got["a"]) == {"n": 1}


def test_stream_follows_growing_files(spark, tmp_path):
    logs, state = tmp_path / "logs", tmp_path / "state"
    logs.mkdir()
    step = lambda n, end="\n": json.dumps({"timestamp": f"2026-01-01T00:00:0{n}", "agent_name": "planner", "n": n}) + end
    seen = []

    def run():
        batches = []
        query = A.agent_steps(stream_lines(spark, str(logs), ".jsonl")).writeStream.foreachBatch(lambda b, _: batches.extend(int(r.fields["n"]) for r in b.collect())).option("checkpointLocation", str(state)).trigger(once=True).start()
        query.awaitTermination()
        seen.append(sorted(batches))

    (logs / "a.jsonl").write_text(step(1) + "not json\n" + step(2)[:10])
    run()
    with (logs / "a.jsonl").open("a") as f:
        f.write(step(2)[10:] + step(3))
    (logs / "b.jsonl").write_text(step(4))
    run()
    run()
    assert seen == [[1], [2, 3, 4], []]


def test_steps_of_a_file(spark, tmp_path):
    (tmp_path / "agent_steps.jsonl").write_text('{"timestamp": "2026-01-01T10:00:00", "agent_name": "a", "tool": {"x": 1}, "note": "n"}\n{"agent_name": "b"}\n{}\n')
    rows = A.agent_steps(read_lines(spark, str(tmp_path), ".jsonl")).orderBy("offset").collect()
    assert [(r.agent_name, str(r.moment), dict(r.fields)) for r in rows] == [("a", "2026-01-01 10:00:00", {"tool": '{"x":1}', "note": "n"}), ("b", "None", {})]


def test_traces_with_all_fields(spark, tmp_path):
    run = {"id": "r1", "parent_id": None, "name": "plan", "type": "chain", "status": "failed", "start_time": "2026-01-01T00:00:00", "end_time": "2026-01-01T00:00:02", "duration_seconds": 2.0, "inputs": {"q": "x"}, "outputs": {}, "metadata": {"k": 1}, "error": {"message": "no"}}
    (tmp_path / "t.json").write_text(json.dumps({"trace_id": "t", "created_at": "2026-01-01T00:00:00", "metadata": {"m": 2}, "runs": [run, run | {"id": "r2", "parent_id": "r1", "error": None}]}, indent=2))
    rows = A.read_traces(spark, str(tmp_path), multi_line=True).orderBy("run_id").collect()
    assert [(r.run_id, r.parent_id, r.duration, r.status) for r in rows] == [("r1", None, 2.0, "failed"), ("r2", "r1", 2.0, "failed")]
    assert json.loads(rows[0].inputs) == {"q": "x"} and json.loads(rows[0].error) == {"message": "no"} and rows[1].error is None and json.loads(rows[0].metadata) == {"m": 2}


def test_index_follows_its_manifest(spark, tmp_path):
    path, built = f"{tmp_path}/index", []

    def build(fail=False):
        def parts(docs):
            built.append(sorted(r.doc_id for r in docs.collect()))
            made = {"titles": docs.select("doc_id", F.concat("path", F.lit(":"), "sha256").alias("title"))}
            if fail:
                broken = F.udf(lambda x: 1 / 0, "int")
                return made | {"tokens": docs.select("doc_id", broken("doc_id").alias("tokens"))}
            return made | {"tokens": docs.select("doc_id", F.length("sha256").alias("tokens"))}

        return parts

    manifest = lambda rows: spark.createDataFrame([(i, f"p{i}", h) for i, h in rows.items()], "doc_id long, path string, sha256 string")
    titles = lambda: {r.doc_id: r.title for r in spark.read.schema("doc_id long, title string").parquet(f"{path}/titles").collect()}
    want = lambda rows: {i: f"p{i}:{h}" for i, h in rows.items()}
    first = {i: "a" for i in range(40)}
    A.update_index(spark, path, manifest(first), build(), 16)
    assert titles() == want(first) and built[-1] == list(range(40))
    second = first | {3: "b", 40: "a"}
    del second[7]
    changes = {r.path: r.change for r in A.update_index(spark, path, manifest(second), build(), 16).collect()}
    assert titles() == want(second) and built[-1] == [3, 40]
    assert (changes["p3"], changes["p40"], changes["p7"], changes["p0"]) == ("modified", "added", "deleted", "unchanged")
    A.update_index(spark, path, manifest(second), build(), 16)
    assert built[-1] == [3, 40]  # nothing changed, nothing built
    third = second | {5: "c"}
    with pytest.raises(Exception, match="division|PythonException"):
        A.update_index(spark, path, manifest(third), build(fail=True), 16)
    assert A.index_broken(spark, path)
    A.update_index(spark, path, manifest(third), build(), 16)
    assert not A.index_broken(spark, path) and titles() == want(third)
    assert {r.doc_id for r in spark.read.parquet(f"{path}/tokens").collect()} == set(third)
    A.update_index(spark, path, manifest({}), build(), 16)
    assert titles() == {}
