"""The tools of a turn."""

import pytest
from pyspark.sql import functions as F

from graniq.plans import stored, tools


@pytest.fixture(scope="module")
def turn(spark):
    texts = ["alpha beta", "beta gamma", "gamma alpha", "delta"]
    rows = [(n * 1_000_000 + k, n, n * 1_000_000, k, f"{t} {n}", "rs"[n % 2], f"/d{n % 2}/f{n}.md", "ready", f"Part {k}", k + 1) for n in range(6) for k, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, node_id long, section_id long, ordinal long, text string, repository string, path string, status string, heading_path string, page int")
    nodes = chunks.select("node_id", "repository", "path").distinct().withColumns({"kind": F.lit("file"), "status": F.lit("ready"), "name": F.substring_index("path", "/", -1), "size_bytes": F.lit(10)})
    sections = nodes.select("node_id", F.lit(0).cast("long").alias("ordinal"), F.lit(2).alias("level"), F.lit("Head").alias("title"), F.concat(F.lit("about "), "name").alias("summary"))
    return tools.Turn(stored.build(chunks, nodes), nodes, sections, ["r"])


def test_search_numbers_stay(turn):
    first = turn.call("rag_search", query="alpha beta", top_k=2).collect()
    assert [r["number"] for r in first] == [1, 2] and all(r["path"].startswith("/d0/") for r in first)
    again = turn.call("rag_search", query="alpha beta", top_k="3").collect()
    assert [r["number"] for r in again][:2] == [1, 2] and again[2]["number"] == 3
    assert turn.call("rag_search", query="alpha", path="/d1").count() == 0


def test_browse_outline_read(turn):
    assert [(r["kind"], r["path"]) for r in turn.call("rag_browse").collect()] == [("folder", "/d0")]
    assert [r["name"] for r in turn.call("rag_browse", path="/d0/").collect()] == ["f0.md", "f2.md", "f4.md"]
    for path in ("/d0/f2.md", "d0/f2.md", "f2.md", "/shown/otherwise/f2.md"):
        assert [(r["node_id"], r["line"], r["summary"]) for r in turn.call("rag_outline", path=path).collect()] == [(2, "  Head", "about f2.md")]
    assert turn.call("rag_read", path="f2.md").first()["text"] == "alpha beta 2\nbeta gamma 2\ngamma alpha 2\ndelta 2"
    assert turn.call("rag_read", path="f2.md", section="part 1").first()["text"] == "beta gamma 2"
    assert turn.call("rag_read", path="f2.md", page=3).first()["text"] == "gamma alpha 2"


def test_bad_calls(turn):
    for name, given, kind in (("rag_write", {}, LookupError), ("rag_search", {}, ValueError), ("rag_search", {"query": "  "}, ValueError), ("rag_search", {"query": "a", "top_k": "many"}, ValueError), ("rag_read", {"path": "f1.md"}, LookupError), ("rag_browse", {"where": "/"}, ValueError)):
        with pytest.raises(kind):
            turn.call(name, **given)
    assert all(s["type"] == "object" and set(s["required"]) <= set(s["properties"]) for s in tools.SCHEMAS.values())
