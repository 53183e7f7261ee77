"""The job queue as a stream: events of jobs in, changes of jobs out, with a timer for each lease.

An event is (job_id, dedupe_key, action, at) and, of an enqueued job, max_attempts and delay_s. Jobs
of one dedupe key share a state, which holds the last of them; a job without a key has a state of its own:

- enqueue: a queued job, due after its delay; nothing while a job of the key is queued or running;
- claim: a due job runs, which counts as an attempt;
- finish: a running job is done;
- fail: a running job waits, longer each time, or is dead after its last attempt;
- a job that has run longer than its lease is queued again, or dead after its last attempt.

Events of a key are taken in order of time within a batch; the watermark says how much later they may come, and rows
behind it are dropped by Spark. A lease ends when the watermark passes it, by a timer, or with the
next event after it, whatever comes first: so the changes of a job do not depend on how the
stream is cut into batches. State and timers are those of the checkpoint; ``changes`` writes
each batch below its number, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times of the state are microseconds, which are the same in every zone.
_STATE = "n long, job_id long, status string, attempts int, max_attempts int, run_at long, locked_at long"
#: A change: n numbers those of a key.
CHANGES = "key string, n long, job_id long, status string, attempts int, max_attempts int, run_at timestamp, locked_at timestamp"
SECOND = 1_000_000
LEASE = 20 * 60 * SECOND
ACTIVE = ("queued", "running")


def _timer(locked_at: int) -> int:
    """The first millisecond after a lease."""
    return (locked_at + LEASE) // 1000 + 1


class Job(tuple):
    """A state row: n, job_id, status, attempts, max_attempts, run_at, locked_at."""

    @staticmethod
    def new(n: int, job_id: int, most: int, run_at: int) -> Job:
        return Job((n, job_id, "queued", 0, most, run_at, None))

    def turned(self, status: str, **more) -> Job:
        names = ("n", "job_id", "status", "attempts", "max_attempts", "run_at", "locked_at")
        return Job({**dict(zip(names, self)), "n": self[0] + 1, "status": status, **more}[k] for k in names)

    def lost(self, at: int) -> bool:
        return self[2] == "running" and self[6] + LEASE < at

    def expired(self) -> Job:
        return self.turned("dead" if self[3] >= self[4] else "queued", locked_at=None)


def step(job: Job | None, event: Row) -> Job | None:
    """The state after an event, or none where nothing changes."""
    at, action = event["at"], event["action"]
    if action == "enqueue":
        if job is not None and job[2] in ACTIVE:
            return None
        return Job.new(job[0] + 1 if job else 1, event["job_id"], event["max_attempts"], at + (event["delay_s"] or 0) * SECOND)
    if job is None:
        return None
    if action == "claim" and job[2] == "queued" and job[5] <= at:
        return job.turned("running", attempts=job[3] + 1, locked_at=at)
    if action == "finish" and job[2] == "running":
        return job.turned("done", locked_at=None)
    if action == "fail" and job[2] == "running":
        if job[3] >= job[4]:
            return job.turned("dead", locked_at=None)
        return job.turned("queued", locked_at=None, run_at=at + min(600, 5 * 2 ** min(job[3], 20)) * SECOND)
    return None


class Leases(StatefulProcessor):
    """The state machine of a key."""

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def _keep(self, job: Job, before: Job | None) -> None:
        for old, act in ((before, self.handle.deleteTimer), (job, self.handle.registerTimer)):
            if old is not None and old[2] == "running":
                act(_timer(old[6]))
        self.job.update(tuple(job))

    def _get(self) -> Job | None:
        return Job(self.job.get()) if self.job.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        job = first = self._get()
        for event in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            if job is not None and job.lost(event["at"]):
                job = job.expired()
                yield Row(key=key[0], **_named(job))
            if (new := step(job, event)) is not None:
                job = new
                yield Row(key=key[0], **_named(job))
        if job is not first:
            self._keep(job, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job = self._get()
        if job is not None and job.lost(expiredTimerInfo.getExpiryTimeInMs() * 1000):
            new = job.expired()
            self.job.update(tuple(new))
            yield Row(key=key[0], **_named(new))

    def close(self) -> None:
        pass


def _named(job: Job) -> dict:
    return dict(zip(("n", "job_id", "status", "attempts", "max_attempts", "run_at", "locked_at"), job))


def stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """CHANGES of a stream of events (job_id, dedupe_key, action, at, seq, max_attempts, delay_s); seq orders events of the same time."""
    own = F.coalesce(F.concat(F.lit("key:"), "dedupe_key"), F.concat(F.lit("job:"), F.col("job_id").cast("string")))
    keyed = events.withColumn("key", own).withWatermark("at", delay).select("key", "job_id", "action", "seq", "max_attempts", "delay_s", F.col("at").alias("moment"), F.unix_micros("at").alias("at"))
    found = keyed.groupBy("key").transformWithState(statefulProcessor=Leases(), outputStructType=f"key string, {_STATE}", outputMode="Update", timeMode="EventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("run_at", "locked_at")})


def changes(events: DataFrame, target: str, checkpoint: str, interval: str | None = None, delay: str = "10 minutes"):
    """Start a query that writes the changes of a stream of events below ``target/batch=<id>``; without an interval it ends with the events that are there."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream(events, delay).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The last state of each job, from the written changes: job_id, status, attempts, max_attempts, run_at, locked_at."""
    rows = spark.read.schema(f"{CHANGES}, batch long").parquet(target)
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("status", "attempts", "max_attempts", "run_at", "locked_at"), "n").alias("s"))
    return last.select("job_id", "s.*")
