"""Streaming jobs over task events. Each has a batch twin in foliant.operators.ops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.ops import ACTIVE, event_counts, event_level
from foliant.sources.scratch import scratch


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of task events."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select("event_id", F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """event_counts over a stream; windows older than late behind the newest event are closed."""
    return event_counts(events.withWatermark("ts", late), width)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """task_id, start, n: runs of a task's events without a gap."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "task_id").agg(F.count("*").alias("n"))
    return counted.select("task_id", F.col("w.start").alias("start"), "n")


def levels(events: DataFrame) -> DataFrame:
    return events.withColumn("level", event_level(F.col("event")))


def task_state(events: DataFrame, ttl: str = "30 days") -> DataFrame:
    """task_id, status, event_id, moment: the last event of each task, by time then id, kept as state.

    Events may arrive in any order. A task without events for ttl leaves the
    state when the watermark passes it.
    """
    rows = events.withWatermark("ts", "30 days").select("task_id", "event_id", "event", "ts", F.unix_micros("ts").alias("moment"))
    span = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        for part in parts:
            row = part.sort_values(["moment", "event_id"]).iloc[-1]
            now = (int(row["moment"]), int(row["event_id"]), str(row["event"]))
            best = now if best is None or now[:2] > tuple(best)[:2] else best
        state.update(tuple(best))
        state.setTimeoutTimestamp(max(best[0] // 1000, state.getCurrentWatermarkMs()) + span)
        yield pd.DataFrame({"task_id": [key[0]], "status": [best[2]], "event_id": [best[1]], "moment": [best[0]]})

    return rows.groupBy("task_id").applyInPandasWithState(step, "task_id long, status string, event_id long, moment long", "moment long, event_id long, event string", "update", GroupStateTimeout.EventTimeTimeout)


def heartbeat_alerts(beats: DataFrame, timeout: float, late: str = "1 day") -> DataFrame:
    """worker, kind, moment, gap of beats (worker, event_id, ts): gap for a beat that comes more than timeout seconds behind the one before, silent once the watermark says that none has come for so long.

    moment is the beat's time, or that of the last one, in microseconds. A beat
    that is older than the last one seen says nothing new.
    """
    rows = beats.withWatermark("ts", late).select("worker", "event_id", "ts", F.unix_micros("ts").alias("moment"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"worker": [key[0]], "kind": ["silent"], "moment": [last], "gap": [float(timeout)]})
            return
        moments = np.sort(np.concatenate([part["moment"].to_numpy() for part in parts]))
        if state.exists:
            moments = np.concatenate(([state.get[0]], moments[moments > state.get[0]]))
        gaps = np.diff(moments) / 1e6
        late_ones = np.flatnonzero(gaps > timeout)
        state.update((int(moments[-1]),))
        state.setTimeoutTimestamp(max(int(moments[-1] // 1000 + timeout * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"worker": key[0], "kind": "gap", "moment": moments[late_ones + 1], "gap": gaps[late_ones]})

    kind = dict(beats.dtypes)["worker"]
    return rows.groupBy("worker").applyInPandasWithState(step, f"worker {kind}, kind string, moment long, gap double", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def owned_beats(beats: DataFrame, states: DataFrame, horizon: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """worker, task_id, event_id, ts: beats (those columns) of the worker that owns an active task, by the states of tasks (task_id, owner, status, since) as two streams.

    A beat meets the states of its task of the horizon before it, and the last
    of them decides: beats of a worker that does not own the task, or of a task
    that is not active by then, are dropped, and so are beats without a state.
    Either side may come late; a beat is decided when the watermark (late
    behind the newest of both) has passed it, and what comes later is left out.
    Written as a table of their own they feed heartbeat_alerts() as a stream:
    Spark has no state of one's own behind an aggregation.
    """
    b = beats.select("worker", "task_id", "event_id", "ts").withWatermark("ts", late)
    s = states.select(F.col("task_id").alias("_task"), "owner", "status", "since").withWatermark("since", late)
    near = (F.col("task_id") == F.col("_task")) & (F.col("since") <= F.col("ts")) & (F.col("since") >= F.col("ts") - F.expr(f"INTERVAL {horizon}"))
    decided = b.join(s, near).groupBy("worker", "task_id", "event_id", "ts").agg(F.max_by(F.struct("owner", "status"), "since").alias("_s"))
    return decided.where((F.col("_s.owner") == F.col("worker")) & F.col("_s.status").isin(*ACTIVE)).drop("_s")


def run_available(stream: DataFrame, mode: str, name: str, latest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there now and return what it wrote; latest reduces updates to their last state."""
    spark = stream.sparkSession
    path = scratch(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{path}/data").drop("batch")
    if mode == "complete":
        rows = rows.where(F.col("_batch") == (rows.agg(F.max("_batch")).first()[0] or 0))
    return (latest(rows) if latest else rows).drop("_batch")
