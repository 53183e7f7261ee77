"""Runs of pipeline steps: one at a time for each step, with counters that come with the write and a log that is kept.

The runs of a pipeline are a table in versions, to which each change of a run adds a row. A run is queued against the
version that has just been read, so of two that queue the same step at once only one gets through. What a step has
made is counted by an observation on its plan while it is written: no second pass over it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graniq.functions import scores as S
from graniq.plans.plugins import Registry, coerce
from graniq.sources import versions

_ROW = "run_id string, step string, plugin string, nth int, status string, error string, counts map<string,bigint>, log string, at timestamp"
ACTIVE = ("queued", "running")
# Lines and characters of a log that are kept, characters of an error.
LINES, CHARACTERS, ERROR = 400, 20_000, 1500


class Conflict(Exception):
    """A step that is off, or that has a run already."""


def _log(lines: list[str]) -> str:
    return "\n".join(lines[-LINES:])[-CHARACTERS:]


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each run."""
    if not versions.latest(path):
        return spark.createDataFrame([], _ROW)
    last = F.max_by(F.struct(*[F.col(c.split()[0]) for c in _ROW.split(", ")[1:]]), "nth").alias("s")
    return versions.read(spark, path).groupBy("run_id").agg(last).select("run_id", "s.*")


def _add(spark: SparkSession, path: str, base: int | None = None, **row: Any) -> None:
    versions.register(spark)
    told = {"error": "", "counts": {}, "log": "", "at": datetime.now(UTC).replace(tzinfo=None), **row}
    one = spark.createDataFrame([tuple(told[c.split()[0]] for c in _ROW.split(", "))], _ROW).coalesce(1)
    writer = one.write.format("versions").mode("append")
    (writer if base is None else writer.option("base", base)).save(path)


def queue_run(spark: SparkSession, path: str, step: str, plugin: str, enabled: bool = True) -> str:
    """Queue a run of a step; a step that is off, or has a run that waits or works, is a conflict."""
    if not enabled:
        raise Conflict(f"step {step} is off")
    base = versions.latest(path)
    if not current(spark, path).filter((F.col("step") == step) & F.col("status").isin(*ACTIVE)).isEmpty():
        raise Conflict(f"step {step} has a run already")
    run_id = uuid.uuid4().hex
    try:
        _add(spark, path, base, run_id=run_id, step=step, plugin=plugin, nth=0, status="queued")
    except Exception as e:
        if versions.latest(path) != base:
            raise Conflict(f"step {step} has been queued by another") from e
        raise
    return run_id


def counters(df: DataFrame) -> dict[str, Column]:
    """What is counted of a step's rows, by the columns that they have."""
    out = {"rows": F.count("*")}
    if "created" in df.columns:
        out |= {"created": F.count_if("created"), "updated": F.count_if(~F.col("created"))}
    if "labels" in df.columns:
        out["tagged"] = F.count_if(F.size("labels") > 0)
    if "tier" in df.columns:
        out |= {tier: F.count_if(F.col("tier") == tier) for tier in S.TIER_NAMES}
    return out


def execute(spark: SparkSession, path: str, run_id: str, registry: Registry, settings: dict[str, Any], df: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, Any]:
    """Run a queued step over df and write what it makes: status, error, counts. A step's own failure is a result of the run, not an error of the caller."""
    found = current(spark, path).filter(F.col("run_id") == run_id).first()
    if found is None:
        return {"status": "skipped", "error": "no such run", "counts": {}}
    own = {"run_id": run_id, "step": found["step"], "plugin": found["plugin"]}
    lines = [f"{found['plugin']}: begins"]
    _add(spark, path, **own, nth=1, status="running", log=_log(lines))
    status, error, counts = "done", "", {}
    try:
        plugin = registry.plugins[found["plugin"]]
        given = coerce(plugin, settings)
        lines += [f"{s.key} = {'…' if s.type == 'secret' else given[s.key]}" for s in plugin.settings]
        made, seen = plugin.run(df, given), Observation(run_id)
        write(made.observe(seen, *[c.cast("long").alias(name) for name, c in counters(made).items()]))
        counts = {k: v or 0 for k, v in seen.get.items()}
        lines += [f"{k}: {v}" for k, v in counts.items()]
    except Exception as e:  # noqa: BLE001 a plug-in's own failure is a result here
        status, error = "failed", f"{type(e).__name__}: {str(e)[:ERROR]}"
        lines.append(error)
    _add(spark, path, **own, nth=2, status=status, error=error, counts=counts, log=_log(lines))
    return {"status": status, "error": error, "counts": counts}
