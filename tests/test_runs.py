"""Runs of pipeline steps."""

import pytest
from pyspark.sql import functions as F

from graniq.plans import runs
from graniq.plans.plugins import Plugin, Registry, Setting
from graniq.sources import store


@pytest.fixture
def registry():
    r = Registry()
    mark = lambda df, c: df.withColumns({"created": F.col("id") % 2 == 0, "labels": F.when(F.col("id") < c["few"], F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), "tier": F.when(F.col("id") < 2, "core").otherwise("long")})
    r.register(Plugin("mark", "enrich", "Mark", mark, (Setting("few", "number", 3), Setting("key", "secret"))))
    r.register(Plugin("bad", "enrich", "Bad", lambda df, c: df.select(F.raise_error(F.lit("broken here")).cast("int").alias("x"))))
    return r


def test_counters_come_with_the_write(spark, registry):
    path, target = store.folder(spark, "runs"), store.folder(spark, "made")
    run = runs.queue_run(spark, path, "s1", "mark")
    done = runs.execute(spark, path, run, registry, {"few": "4", "key": "hidden"}, spark.range(10), lambda df: df.write.parquet(target))
    assert done == {"status": "done", "error": "", "counts": {"rows": 10, "created": 5, "updated": 5, "tagged": 4, "core": 2, "short": 0, "long": 8}}
    kept = runs.current(spark, path).first()
    assert kept["status"] == "done" and kept["counts"]["tagged"] == 4 and "few = 4" in kept["log"] and "hidden" not in kept["log"]
    assert spark.read.parquet(target).count() == 10


def test_one_run_at_a_time(spark, registry):
    path = store.folder(spark, "runs")
    run = runs.queue_run(spark, path, "s1", "mark")
    with pytest.raises(runs.Conflict):
        runs.queue_run(spark, path, "s1", "mark")
    with pytest.raises(runs.Conflict):
        runs.queue_run(spark, path, "s2", "mark", enabled=False)
    other = runs.queue_run(spark, path, "s2", "mark")
    runs.execute(spark, path, run, registry, {}, spark.range(3), lambda df: df.count())
    assert runs.queue_run(spark, path, "s1", "mark") not in (run, other)
    assert {r["status"] for r in runs.current(spark, path).filter("step = 's2'").collect()} == {"queued"}


def test_failures_are_results(spark, registry):
    path = store.folder(spark, "runs")
    run = runs.queue_run(spark, path, "s1", "bad")
    done = runs.execute(spark, path, run, registry, {}, spark.range(3), lambda df: df.write.format("noop").mode("overwrite").save())
    assert done["status"] == "failed" and "broken here" in done["error"] and done["counts"] == {}
    lost = runs.queue_run(spark, path, "s2", "nowhere")
    assert runs.execute(spark, path, lost, registry, {}, spark.range(3), lambda df: None)["error"].startswith("KeyError")
    assert runs.execute(spark, path, "unknown", registry, {}, spark.range(3), lambda df: None)["status"] == "skipped"
    kept = runs.current(spark, path).filter("step = 's1'").first()
    assert kept["status"] == "failed" and "broken here" in kept["log"] and runs.queue_run(spark, path, "s1", "bad")
