"""The durable job queue as table rewrites.

Jobs: job_id, kind, status (queued, running, done, failed, dead), priority, run_at, attempts,
max_attempts, locked_at, dedupe_key. Each function returns the new table; a caller writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ["queued", "running"]


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """New jobs whose dedupe_key isn't active yet, once each; null keys are always new."""
    active = jobs.filter(F.col("status").isin(ACTIVE) & F.col("dedupe_key").isNotNull()).select("dedupe_key").distinct()
    nth = F.row_number().over(Window.partitionBy("dedupe_key").orderBy("job_id"))
    once = new.withColumn("__n", nth).filter((F.col("__n") == 1) | F.col("dedupe_key").isNull()).drop("__n")
    return jobs.unionByName(once.join(active, "dedupe_key", "left_anti").select(*jobs.columns))


def claim_order(jobs: DataFrame, as_of: Column, n: int) -> DataFrame:
    """The next n due jobs: least priority, then the earliest."""
    return jobs.filter((F.col("status") == "queued") & (F.col("run_at") <= as_of)).orderBy("priority", "run_at", "job_id").limit(n)


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(600), F.lit(5) * F.pow(F.lit(2.0), F.least(attempts, F.lit(20)))).cast("long")


def finish(jobs: DataFrame, finished: Column, as_of: Column) -> DataFrame:
    """Finished jobs are done and give their lease back."""
    out = jobs.withColumns({"status": F.when(finished, "done").otherwise(F.col("status")), "locked_at": F.when(~finished, F.col("locked_at"))})
    return out.withColumn("finished_at", F.when(finished, as_of))


def fail(jobs: DataFrame, failed: Column, as_of: Column) -> DataFrame:
    """Failed jobs wait longer each time, and are dead after their last attempt."""
    last = F.col("attempts") >= F.col("max_attempts")
    later = F.timestamp_add("SECOND", backoff_seconds(F.col("attempts")), as_of)
    return jobs.withColumns({"status": F.when(failed, F.when(last, "dead").otherwise("queued")).otherwise(F.col("status")), "run_at": F.when(failed & ~last, later).otherwise(F.col("run_at")), "locked_at": F.when(~failed, F.col("locked_at"))})


def expire_leases(jobs: DataFrame, as_of: Column, minutes: int = 20) -> DataFrame:
    """Jobs that ran longer than their lease are queued again, or dead after their last attempt."""
    lost = (F.col("status") == "running") & (F.col("locked_at") < as_of - F.expr(f"INTERVAL {minutes} MINUTES"))
    return jobs.withColumns({"status": F.when(lost, F.when(F.col("attempts") >= F.col("max_attempts"), "dead").otherwise("queued")).otherwise(F.col("status")), "locked_at": F.when(~F.coalesce(lost, F.lit(False)), F.col("locked_at"))})


def retry(jobs: DataFrame, job_id: int, as_of: Column) -> DataFrame:
    own = F.col("job_id") == job_id
    return jobs.withColumns({"status": F.when(own, "queued").otherwise(F.col("status")), "attempts": F.when(own, 0).otherwise(F.col("attempts")), "run_at": F.when(own, as_of).otherwise(F.col("run_at"))})
