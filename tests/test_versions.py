"""Tables in versions, and streams with state."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graniq.sources import versions
from graniq.streaming import joins


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(path):
    return len(os.listdir(path.removeprefix("file://") + "/data"))


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def test_append_overwrite_and_old_versions(spark, path):
    versions.register(spark)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    versions.append(spark.range(10), path)
    versions.append(spark.range(10, 15), path)
    versions.overwrite(spark.range(3), path)
    assert versions.latest(path) == 3
    assert [versions.read(spark, path, n).count() for n in (1, 2, 3)] == [10, 15, 3] and versions.read(spark, path).count() == 3
    versions.overwrite(spark.range(0), path)
    assert versions.read(spark, path).count() == 0 and versions.read(spark, path, 2).count() == 15


def test_replace_rewrites_touched_buckets_alone(spark, path):
    old = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("old").alias("v"))
    versions.overwrite(old, path, ["k"], 16)
    before = {tuple(f) for f in versions.manifest(path)["files"]}
    new = spark.createDataFrame([(5, "new"), (5, "again"), (5000, "more"), (None, "none")], "k long, v string")
    versions.replace(new, path, ["k"], 16)
    got = rows(versions.read(spark, path).select(F.coalesce("k", F.lit(-1)), "v"))
    assert got == sorted([(i, "old") for i in range(1, 1000) if i != 5] + [(5, "again"), (5, "new"), (5000, "more"), (-1, "none")])
    after = {tuple(f) for f in versions.manifest(path)["files"]}
    assert len({b for _, b, _ in before - after}) <= 3 and len(before & after) >= 13
    assert versions.read(spark, path, 1).filter("v = 'old'").count() == 1000


def test_failed_task_leaves_no_version(spark, path):
    versions.append(spark.range(5), path)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.append(bad, path)
    assert versions.latest(path) == 1 and rows(versions.read(spark, path)) == [(i,) for i in range(5)]


def test_second_writer_fails(spark, path):
    versions.overwrite(spark.range(5).withColumnRenamed("id", "k"), path, ["k"], 4)
    one = versions.VersionWriter({"path": path, "base": "1"}, spark.range(1).schema, False)
    two = versions.VersionWriter({"path": path, "base": "1"}, spark.range(1).schema, False)
    one.publish([])
    with pytest.raises(RuntimeError):
        two.publish([])
    assert versions.latest(path) == 2


def test_stream_batches_commit_once(spark, path, tmp_path):
    versions.register(spark)
    source = str(tmp_path / "in")
    spark.range(6).coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema("id long").parquet(source)
        writer = stream.writeStream.format("versions").option("path", path).option("stream", "s").option("checkpointLocation", str(tmp_path / "checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()

    run()
    spark.range(6, 9).coalesce(1).write.mode("append").parquet(source)
    run()
    assert rows(versions.read(spark, path)) == [(i,) for i in range(9)] and versions.latest(path) == 2
    again = versions.VersionStreamWriter({"path": path, "stream": "s"}, spark.range(1).schema, False)
    again.commit([], 1)  # a batch that has been committed, once more
    assert versions.latest(path) == 2


def stream(spark, folder, data, schema, parts=2):
    """A stream over files in order of time, one for each batch."""
    step = -(-len(data) // parts)
    for k in range(parts):
        target = f"{folder}/{k}"
        spark.createDataFrame(data[k * step : (k + 1) * step], schema).coalesce(1).write.parquet(target)
        os.utime(target, (k, k))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def test_sessions_and_late_rows(spark, tmp_path):
    """A row behind the watermark is dropped; an open session is not given yet."""
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    data = [("a", at(0), 1.0), ("a", at(20), 2.0), ("b", at(5), 1.0), ("a", at(300), 4.0), ("b", at(301), 8.0), ("a", at(1), 100.0), ("b", at(600), 1.0)]
    schema = "k string, ts timestamp, value double"
    found = joins.sessions(stream(spark, str(tmp_path / "in"), data, schema, 7), "k", "30 minutes")
    joins.batches(found, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = joins.given(spark, str(tmp_path / "out"), found)
    assert sorted((r["k"], r["n"], r["total"]) for r in got.collect()) == [("a", 1, 4.0), ("a", 2, 3.0), ("b", 1, 1.0), ("b", 1, 8.0)]


def test_interval_join(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    left = [("a", at(0), 1), ("a", at(50), 2), ("b", at(10), 3), ("c", at(900), 4)]
    right = [("a", at(55), 10), ("a", at(60), 11), ("b", at(9), 12), ("b", at(71), 13), ("c", at(890), 14)]
    one = stream(spark, str(tmp_path / "l"), left, "k string, ts timestamp, left_id long")
    two = stream(spark, str(tmp_path / "r"), right, "k string, ts timestamp, right_id long")
    found = joins.within(one, two, "k", "60 MINUTES", how="left_outer")
    joins.batches(found, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted((r["left_id"], r["right_id"] or 0) for r in joins.given(spark, str(tmp_path / "out"), found).collect())
    assert got == [(1, 10), (1, 11), (2, 10), (2, 11), (3, 0)]
