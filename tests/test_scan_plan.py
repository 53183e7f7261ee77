"""What the search by scans sends through a shuffle."""

from graniq import queries

SF = "/root/testdata/sf0.001"


def test_scan_shuffles_no_text(spark):
    """Where no table is small enough to be broadcast, the join with the vectors is the only one that shuffles, and it has no text."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES["hybrid_search_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    assert len(joins) == 1 and "chunk_id" in joins[0], joins
