"""The queue as a stream: state, timers, batches and restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graniq.streaming import leases

START = datetime(2024, 1, 1)
SCHEMA = "job_id long, dedupe_key string, action string, at timestamp, seq long, max_attempts int, delay_s long"


def made(n, seed):
    """Events in order of time, a few minutes apart."""
    rng, at, out = random.Random(seed), START, []
    for i in range(n):
        at += timedelta(seconds=rng.randrange(1, 240), microseconds=rng.randrange(1_000_000))
        out.append((i, rng.choice(["a", "b", "c", None]), rng.choice(["enqueue", "enqueue", "claim", "claim", "finish", "fail"]), at, i, 2, rng.choice([0, 0, 90, None])))
    return out


def naive(events, until):
    """The last state of each job: status, attempts."""
    last, states = {}, {}

    def put(key, job, status, attempts, run_at, locked):
        states[key] = (job, status, attempts, run_at, locked)
        last[job] = (status, attempts)

    def expire(key, now):
        job, status, attempts, run_at, locked = states.get(key, (None, None, 0, None, None))
        if status == "running" and locked + timedelta(minutes=20) < now:
            put(key, job, "dead" if attempts >= 2 else "queued", attempts, run_at, None)

    for i, key, action, at, _, most, delay in events:
        key = key or i
        expire(key, at)
        job, status, attempts, run_at, locked = states.get(key, (None, None, 0, None, None))
        if action == "enqueue" and status not in ("queued", "running"):
            put(key, i, "queued", 0, at + timedelta(seconds=delay or 0), None)
        elif action == "claim" and status == "queued" and run_at <= at:
            put(key, job, "running", attempts + 1, run_at, at)
        elif action == "finish" and status == "running":
            put(key, job, "done", attempts, run_at, None)
        elif action == "fail" and status == "running":
            put(key, job, "dead" if attempts >= most else "queued", attempts, at + timedelta(seconds=min(600, 5 * 2**attempts)), None)
    for key in list(states):
        expire(key, until)
    return last


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_equals_one_pass(spark, tmp_path, parts):
    """However the events are cut into batches, and after a restart from the checkpoint, the jobs end the same."""
    events = made(160, 11)
    step = -(-len(events) // parts)
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    for k in range(parts):
        own = events[k * step : (k + 1) * step]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        # A run for each part: all but the first go on from the checkpoint.
        leases.changes(spark.readStream.schema(SCHEMA).parquet(str(source)), target, checkpoint).awaitTermination()
    got = {r["job_id"]: (r["status"], r["attempts"]) for r in leases.current(spark, target).collect()}
    assert got == naive(events, events[-1][3] - timedelta(minutes=10))
    assert {"done", "dead", "queued"} <= {s for s, _ in got.values()}
    numbers = spark.read.parquet(target).groupBy("key").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.count_distinct("n").alias("d")).collect()
    assert all(r["c"] == r["m"] == r["d"] for r in numbers)


def test_repeated_batch_leaves_one_version(spark, tmp_path):
    """A batch that is written again replaces itself."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    events = made(60, 3)
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.parquet(source)
    for k in range(2):
        leases.changes(spark.readStream.schema(SCHEMA).parquet(source), target, str(tmp_path / f"checkpoint{k}")).awaitTermination()
    got = {r["job_id"]: (r["status"], r["attempts"]) for r in leases.current(spark, target).collect()}
    assert got == naive(events, events[-1][3] - timedelta(minutes=10))
