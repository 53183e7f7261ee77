"""Indexing end to end, against its rules."""

from pyspark.sql import functions as F

from graniq.plans import indexing, providers, stored
from graniq.sources import store, versions

COLUMNS = "node_id long, repository string, path string, name string, text string, error string"


def made(spark, rows):
    return spark.createDataFrame([(i, "r", f"/d/{i}.md", f"{i}.md", text, error) for i, text, error in rows], COLUMNS)


def test_states_counters_and_summaries(spark):
    long = "# One\n" + "word " * 60 + "\n## Two\n" + "more " * 60
    files = made(spark, [(1, long, None), (2, "  \n ", None), (3, None, "parser: broken" + "!" * 600), (4, "plain", None), (5, None, None)])
    got = indexing.index_nodes(files, providers.HashEmbedder(32), dim=48)
    nodes = {r["node_id"]: r for r in got.nodes.collect()}
    assert {i: r["status"] for i, r in nodes.items()} == {1: "ready", 2: "failed", 3: "failed", 4: "ready", 5: "failed"}
    assert nodes[2]["error"] == nodes[5]["error"] == "no_text" and nodes[3]["error"].startswith("parser: broken") and len(nodes[3]["error"]) == 500
    assert nodes[1]["section_count"] == 2 and nodes[1]["embedding_model"] == "hash/32" and nodes[1]["text_preview"] == long[:2000]
    sections = sorted(got.sections.filter("node_id = 1").collect(), key=lambda r: r["ordinal"])
    assert [s["title"] for s in sections] == ["One", "Two"] and sections[1]["parent_id"] == sections[0]["section_id"]
    assert sections[0]["summary"] == "One: " + ("word " * 60).strip() and nodes[1]["summary"] == sections[0]["summary"]
    chunks = got.chunks.filter("node_id = 1").collect()
    assert len(chunks) == nodes[1]["chunk_count"] and sum(c["tokens"] for c in chunks) == nodes[1]["tokens"]
    assert {c["section_id"] for c in chunks} == {s["section_id"] for s in sections}
    assert all(len(c["embedding"]) == 48 and abs(sum(x * x for x in c["embedding"]) - 1) < 1e-9 and c["embedding"][32:] == [0.0] * 16 for c in [*chunks, *sections])


def test_without_a_model_words_carry_the_search(spark):
    got = indexing.index_nodes(made(spark, [(1, "alpha beta", None), (2, "beta gamma", None)]))
    assert got.chunks.filter("embedding IS NOT NULL").count() == 0 and got.nodes.filter("embedding_model <> ''").count() == 0
    nodes = got.nodes.withColumn("kind", F.lit("file"))
    found = stored.search(stored.build(got.chunks, nodes), "beta").collect()
    assert sorted(r["node_id"] for r in found) == [1, 2]


def test_summaries_by_a_model(spark):
    """A model is asked where there is enough text; where it says nothing the beginning stays."""
    model = providers.Scripted(lambda prompt: F.when(F.contains(prompt, F.lit("silent")), F.lit(None).cast("string")).otherwise(F.concat(F.lit("said "), F.length(prompt).cast("string"))))
    text = "# A\n" + "x" * 199 + "\n# B\n" + "y" * 200 + "\n# C\n" + "silent " * 40
    own = {r["title"]: r["summary"] for r in indexing.index_nodes(made(spark, [(1, text, None)]), model=model).sections.collect()}
    assert own["A"] == "A: " + "x" * 199 and own["C"].startswith("C: silent silent") and own["B"] == f"B: said {len('[문서] 1.md') + len(chr(10) + '[섹션] B') + 2 + 200}"


def test_persist_replaces_nodes(spark):
    path = store.folder(spark, "persisted")
    one = indexing.index_nodes(made(spark, [(1, "a\n\nb", None), (2, "c", None)]), sizes={"target": 1, "most": 2, "overlap": 1})
    indexing.persist(one, path, 4)
    two = indexing.index_nodes(made(spark, [(2, "d e", None), (3, "f", None), (1, None, "gone")]))
    indexing.persist(two, path, 4)
    nodes = {r["node_id"]: (r["status"], r["chunk_count"]) for r in versions.read(spark, f"{path}/nodes").collect()}
    assert nodes == {1: ("failed", 0), 2: ("ready", 1), 3: ("ready", 1)}
    assert sorted((r["node_id"], r["text"]) for r in versions.read(spark, f"{path}/chunks").collect()) == [(1, "a"), (1, "b"), (2, "d e"), (3, "f")]
    assert versions.latest(f"{path}/nodes") == 2
