"""Long texts are used to their end."""

import pytest
from pyspark.sql import functions as F

from graniq.operators import chunking
from graniq.plans import indexing, providers


def test_structure_goes_to_the_end(spark):
    """More chunks than 4,000, with headings and without: the last line of each text is in its last chunk and section."""
    plain = "\n".join(f"w{i} x" for i in range(4500))
    headed = "\n".join(f"# H{i}" if i % 9 == 0 else f"w{i} x" for i in range(5400))
    docs = spark.createDataFrame([(1, plain), (2, headed), (3, "short one")], "node_id long, text string")
    parts = chunking.structure(docs, target=2, most=9, overlap=2)
    got = {(r["node_id"], r["kind"]): (r["n"], r["last"]) for r in parts.groupBy("node_id", "kind").agg(F.count("*").alias("n"), F.max_by("text", "ordinal").alias("last")).collect()}
    assert {k: n for k, (n, _) in got.items()} == {(1, "chunk"): 4500, (1, "section"): 750, (2, "chunk"): 4800, (2, "section"): 600, (3, "chunk"): 1, (3, "section"): 1}
    assert got[1, "chunk"][1] == "w4499 x" and got[1, "section"][1].endswith("w4499 x") and got[2, "chunk"][1] == "w5399 x" and got[2, "section"][1].endswith("w5399 x\n")


def indexed(spark, text, **how):
    files = spark.createDataFrame([(1, "r", "/a", "a", text, None)], "node_id long, repository string, path string, name string, text string, error string")
    return indexing.index_nodes(files, sizes={"target": 2, "most": 9, "overlap": 2}, **how)


def test_files_are_indexed_to_the_end(spark):
    """All parts of a long file are counted; none stands beside a list of all others."""
    got = indexed(spark, "\n".join(f"# H{i}" if i % 9 == 0 else f"w{i} x" for i in range(5400)))
    node = got.nodes.first()
    assert (node["chunk_count"], node["section_count"], node["tokens"]) == (4800, 600, 9600)
    assert got.chunks.agg(F.max("chunk_id")).first()[0] == 1_004_799 and got.sections.agg(F.max("ordinal")).first()[0] == 599


def test_files_of_too_many_parts_fail(spark, monkeypatch):
    """Rather than take the ids of the next file."""
    monkeypatch.setattr(indexing, "STRIDE", 20)
    assert indexed(spark, "\n".join(f"w{i} x" for i in range(20))).nodes.first()["chunk_count"] == 20
    with pytest.raises(Exception, match="more than 20 parts"):
        indexed(spark, "\n".join(f"w{i} x" for i in range(21)))


def test_vectors_of_all_sections(spark):
    """The last section of a long file has its own words and a vector, as all before it."""
    got = indexed(spark, "\n".join(f"# H{i}" if i % 9 == 0 else f"w{i} x" for i in range(4602)), embedder=providers.HashEmbedder(16), dim=16)
    last = got.sections.orderBy(F.desc("ordinal")).first()
    assert got.sections.filter("embedding IS NOT NULL").count() == 512 and last["summary"] == "H4599: w4600 x w4601 x" and sum(x * x for x in last["embedding"]) > 0.99
