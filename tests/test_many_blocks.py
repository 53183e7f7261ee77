"""Blocks of queries against blocks of texts."""

import random

from pyspark.sql import functions as F

from graniq.functions import text as T
from graniq.plans import many


def test_substrings_of_odd_texts(spark):
    """Null texts, terms of two characters and with underscores, marks inside words, ties: as by a look at every pair; and a task count that is asked for, as a block costs more than its bytes tell."""
    rng = random.Random(5)
    words = ["alpha", "beta_gamma", "ab", "x_1", "gamma", "Δelta", "alphabet", "a", "_", "betagamma", "12", "be-ta"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(300)] + [None, "", "_ _", "alpha  ", "𝒳ab 𝒳"]
    asked = ["alpha ab", "beta_gamma", "x_1 12", "δelta", "zz", "", None, "gamma x_", "__", "ta"]
    rows, queries = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = many.substrings(queries, rows, 24)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    pair = rows.withColumnRenamed("text", "t").crossJoin(queries.withColumnRenamed("text", "q"))
    pair = pair.filter(F.exists(T.query_terms(F.col("q")), lambda w: F.contains(F.lower("t"), w))).select("query_id", "id", T.similarity(T.trigrams(F.col("t")), T.trigrams(F.col("q"))).alias("score"), F.length("t").alias("n"))
    want = {}
    for r in sorted(pair.collect(), key=lambda r: (r["query_id"], -r["score"], r["n"], r["id"])):
        want.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    found = {}
    for r in got.orderBy("query_id", "rnk").collect():
        found.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    assert found == {q: x[:24] for q, x in want.items()} and len(found) >= 6
