"""Beats of owning workers over several micro-batches of two streams."""

import os

import pytest
from pyspark.sql import functions as F

from foliant.streaming import events as S


def at(minute, second=0):
    return f"2026-01-01 {minute // 60:02d}:{minute % 60:02d}:{second:02d}"


@pytest.fixture
def feed(spark, tmp_path):
    """put(name, rows) adds a file that a later micro-batch reads; stream(name) is the stream of a folder."""
    schemas = {"beats": "worker long, task_id long, event_id long, t string", "states": "task_id long, owner long, status string, t string"}
    times = {"beats": "ts", "states": "since"}
    for name in schemas:
        (tmp_path / name).mkdir()
    count = [0]

    def put(name, rows):
        count[0] += 1
        df = spark.createDataFrame(rows, schemas[name]).withColumn(times[name], F.col("t").cast("timestamp")).drop("t").coalesce(1)
        df.write.parquet(f"{tmp_path}/make{count[0]}")
        part = next(f for f in os.listdir(f"{tmp_path}/make{count[0]}") if f.startswith("part"))
        os.rename(f"{tmp_path}/make{count[0]}/{part}", f"{tmp_path}/{name}/{count[0]:03d}.parquet")

    def stream(name):
        return spark.readStream.schema(schemas[name].replace(" t string", f" {times[name]} timestamp")).parquet(f"{tmp_path}/{name}")

    return put, stream


def drain(query_of, tmp_path, batches):
    """What a query writes while files come in, a run for each."""
    got = []
    for put in batches:
        put()
        query = query_of().writeStream.outputMode("append").foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return got


def test_only_owners_of_active_tasks_beat(spark, feed, tmp_path):
    put, stream = feed
    batches = [
        lambda: (put("states", [(1, 10, "running", at(0)), (2, 20, "running", at(0))]), put("beats", [(10, 1, 1, at(1)), (20, 1, 2, at(1)), (20, 2, 3, at(2)), (30, 3, 4, at(2))])),
        # task 2 is over, its late state arrives after the beat; a late beat of task 1 comes with them
        lambda: (put("beats", [(20, 2, 5, at(5)), (10, 1, 6, at(6))]), put("states", [(2, 20, "succeeded", at(4))]), put("beats", [(10, 1, 7, at(3))])),
        # task 1 changes hands
        lambda: (put("states", [(1, 11, "running", at(8))]), put("beats", [(10, 1, 8, at(9)), (11, 1, 9, at(9))])),
        lambda: (put("states", [(9, 9, "running", at(200))]), put("beats", [(9, 9, 99, at(201))])),
        lambda: (put("states", [(9, 9, "running", at(300))]), put("beats", [(9, 9, 100, at(301))])),
    ]
    got = drain(lambda: S.owned_beats(stream("beats"), stream("states")), tmp_path, batches)
    assert sorted(x[2] for x in got if x[2] < 99) == [1, 3, 6, 7, 9]


def test_alerts_come_from_owned_beats_alone(spark, feed, tmp_path):
    put, stream = feed
    batches = [
        lambda: (put("states", [(1, 10, "running", at(0)), (2, 20, "failed", at(0))]), put("beats", [(10, 1, 1, at(1)), (20, 2, 2, at(1)), (10, 2, 3, at(4)), (99, 1, 4, at(4))])),
        lambda: put("beats", [(10, 1, 5, at(7)), (20, 2, 6, at(30))]),
        lambda: (put("states", [(3, 30, "running", at(200))]), put("beats", [(30, 3, 7, at(201))])),
        lambda: (put("states", [(3, 30, "running", at(300))]), put("beats", [(30, 3, 8, at(301))])),
        lambda: (put("states", [(3, 30, "running", at(400))]), put("beats", [(30, 3, 9, at(401))])),
    ]
    owned, got = f"{tmp_path}/owned", []
    for put_batch in batches:
        put_batch()
        for name, query in (
            ("decide", lambda: S.owned_beats(stream("beats"), stream("states")).writeStream.format("parquet").option("path", owned)),
            ("alert", lambda: S.heartbeat_alerts(spark.readStream.schema("worker long, task_id long, event_id long, ts timestamp").parquet(owned), 300.0, "10 minutes").writeStream.foreachBatch(lambda b, _: got.extend(map(tuple, b.collect())))),
        ):
            query().outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    # worker 10 beats at 1 and 7 minutes: its beat of a foreign task at 4 hides no gap; then it falls silent
    assert [(w, k, round(g)) for w, k, _, g in got if w == 10] == [(10, "gap", 360), (10, "silent", 300)]
    assert not [x for x in got if x[0] in (20, 99)]
