"""What sections and chunks send through a shuffle."""

from graniq.operators import chunking


def test_texts_of_chunks_stay(spark):
    """Chunks in sections and in runs come as they are written: of all joins only that of section texts with their numbers is left."""
    docs = spark.createDataFrame([(1, "# a\nb\n# c\nd\n[page 2]\ne"), (2, "x\n[page 3]\ny"), (2, "z"), (None, "# q\nr"), (3, None)], "node_id long, text string")
    parts = chunking.structure(docs, target=5, most=9, overlap=2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = parts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "section" in joins[0], joins
    got = sorted((str(r["node_id"]), r["kind"], r["ordinal"], r["title"] or "", r["text"]) for r in parts.collect())
    assert got == sorted([
        ("1", "chunk", 0, "", "b"), ("1", "chunk", 1, "", "d\ne"), ("1", "section", 0, "a", "b\n"), ("1", "section", 1, "c", "d\ne\n"),
        ("2", "chunk", 0, "", "x\ny"), ("2", "section", 0, "p.3", "x\ny"), ("2", "chunk", 0, "", "z"), ("2", "section", 0, "본문 1", "z"),
        ("None", "chunk", 0, "", "r"), ("None", "section", 0, "본문 1", "r"),
    ])
