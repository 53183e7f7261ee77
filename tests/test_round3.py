"""Steps that grew faster than their input, and tables that are folders."""

import os

from pyspark.sql import functions as F

from graniq import queries
from graniq.operators import records
from graniq.sources import corpus

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_taxonomy_moves_hits_alone(spark):
    """Runs of characters meet the taxonomy without a shuffle, however large Spark takes it to be."""
    texts = spark.createDataFrame([(1, "large brass case"), (2, "aa bras"), (3, "")], "id long, t string")
    taxonomy = spark.createDataFrame([(0, "Metal > Brass"), (1, "Large/aa")], "pos int, label string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = records.classify(texts, taxonomy, "id", F.col("t"))
        assert "BroadcastHashJoin [__gram" in plan(got)
        assert {r["id"]: r["labels"] for r in got.collect()} == {1: ["Metal > Brass", "Large/aa"], 2: ["Large/aa"], 3: []}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reviews_of_a_target_are_cut_before_they_meet_records(spark):
    """Many records of one target: its older reviews meet none of them."""
    own = spark.range(20).select(F.col("id").alias("record_id"))
    links = spark.range(20).select(F.lit(7).cast("long").alias("link_id"), F.col("id").alias("from_id"), (F.col("id") + 100).alias("to_id"), F.lit(1.0).alias("score"))
    scores = own.withColumn("score_id", F.lit(3).cast("long"))
    reviews = spark.range(400).select(F.element_at(F.array(F.lit("link"), F.lit("score")), (F.col("id") % 2 + 1).cast("int")).alias("target_type"), F.when(F.col("id") % 2 == 0, 7).otherwise(3).cast("long").alias("target_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("verdict"), F.lit(0).alias("at"), F.col("id").alias("review_id"))
    got = records.record_reviews(own, links, scores, reviews, limit=5)
    assert "windowspecdefinition(target_type" in plan(got)
    rows = got.collect()
    assert len(rows) == 100 and all(r["verdict"] == f"v{400 - r['nth']}" for r in rows)


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    """Documents and events as folders of files, as Spark writes them."""
    for name in os.listdir(SF):
        if name not in ("documents.parquet", "events.parquet"):
            os.symlink(f"{SF}/{name}", tmp_path / name)
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    read = lambda d: spark.readStream.schema(docs.schema).parquet(corpus.stream_path(d, "documents"))
    for i, d in enumerate((SF, str(tmp_path))):
        read(d).writeStream.format("memory").queryName(f"docs{i}").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(f"docs{i}").count() == docs.count()
    assert queries.stream_ingest(spark, str(tmp_path)).select("node_id").distinct().count() > 0
