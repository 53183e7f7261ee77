"""Searches of many queries: what grows with the texts."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from graniq.config import SearchConfig
from graniq.functions import text as T
from graniq.operators import index
from graniq.plans import many, stored
from graniq.sources import corpus, store

SF = "/root/testdata/sf0.001"


def test_a_block_sends_the_best_of_its_slices(spark, monkeypatch):
    """A block of texts is ranked slice by slice and sends n rows of a query, those that a look at every pair gives; few cells make slices of a text."""
    rng = random.Random(7)
    words = ["alpha", "alphabet", "de", "tide", "x_1", "be", "gamma", "gam", "Ünder"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    asked = ["alpha de", "gamma", "x_1", "ünder be"]
    rows, queries = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    q = many._parts(queries).toArrow()
    t = rows.select("id", F.lower("text").alias("lower"), F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ").alias("words"), F.length("text").cast("long").alias("length")).toArrow()
    pair = rows.withColumnRenamed("text", "t").crossJoin(queries.withColumnRenamed("text", "q"))
    pair = pair.filter(F.exists(T.query_terms(F.col("q")), lambda w: F.contains(F.lower("t"), w))).select("query_id", "id", T.similarity(T.trigrams(F.col("t")), T.trigrams(F.col("q"))).alias("score"), F.length("t").alias("n"))
    want = {}
    for r in sorted(pair.collect(), key=lambda r: (r["query_id"], -r["score"], r["n"], r["id"])):
        want.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    for slices, cells in ((32, many.CELLS), (2048, many.CELLS), (2048, 1)):
        monkeypatch.setattr(many, "TEXTS", slices)
        monkeypatch.setattr(many, "CELLS", cells)
        got = {}
        for r in many._most_similar(q, t, 5).to_pylist():
            got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
        assert got == {i: x[:5] for i, x in want.items()} and len(got) == 4
    assert many._most_similar(q, t.slice(0, 0), 5).num_rows == 0 and isinstance(q, pa.Table)


def test_other_words_are_looked_up_for_few(spark, monkeypatch):
    """Of the chunks of a query's rarest word only those that have the next rarest too are looked at for its other words."""
    texts = [f"common word rare{i % 2} seldom{i % 3} n{i}" for i in range(600)]
    chunks = spark.createDataFrame([(i, i, i, 0, x, "r", f"/{i}", "ready") for i, x in enumerate(texts)], "chunk_id long, node_id long, section_id long, ordinal long, text string, repository string, path string, status string")
    nodes = chunks.select("node_id", "path", "repository", F.lit("file").alias("kind"), "status")
    own = stored.Stored(index.build(chunks, nodes))
    kept, write = {}, store.written

    def written(df, path, by=None):
        out = write(df, path, by)
        kept[path.rsplit("/", 1)[1].split("-")[0]] = out
        return out

    monkeypatch.setattr(store, "written", written)
    queries = spark.createDataFrame([(1, "common word rare1 seldom2"), (2, "rare1"), (3, "common nowhere"), (4, "word rare0")], "query_id long, text string")
    got = {}
    for r in many.lexical(own, queries, 10**6).collect():
        got.setdefault(r["query_id"], set()).add(r["chunk_id"])
    assert got == {1: {i for i in range(600) if i % 6 == 5}, 2: set(range(1, 600, 2)), 4: set(range(0, 600, 2))}
    assert kept["asked"].count() == 100 * 2


def test_lists_give_wanted_chunks(spark):
    """Few wanted chunks are looked up in a list; for many the list is gone through."""
    rows = [("w", list(range(0, 200, 2)), [2 * i for i in range(100)], [v for i in range(100) for v in (i, i + 7)], [4, 5, 198]), ("v", [3], [0], [9, 9, 9], [3])]
    postings = spark.createDataFrame(rows, "word string, at array<int>, start array<int>, place array<int>, wanted array<int>")
    every = {(r["word"], r["at"]): r["places"] for r in index.each(postings, "word").collect()}
    assert len(every) == 101 and every["w", 198] == [99, 106] and every["v", 3] == [9, 9, 9]
    got = {(r["word"], r["at"]): r["places"] for r in index.each(postings, "word", wanted="wanted").collect()}
    assert got == {k: every[k] for k in (("w", 4), ("w", 198), ("v", 3))}


def test_few_passages_go_to_the_texts(spark):
    """Where the table of chunks is larger than what is sent to all tasks, hits and passages are sent instead."""
    own = stored.of_tables(spark, SF)
    queries = corpus.table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), "text").limit(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40k")
    try:
        found = many.search(own, queries, SearchConfig(top_k=4))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan, plan
        assert found.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
