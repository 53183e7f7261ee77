import io
import zipfile

import pytest
from pyspark.sql import functions as F

from graniq.config import SearchConfig
from graniq.functions import scores
from graniq.functions import vectors as V
from graniq.operators import browse, chunking, fusion, legs, matching, records
from graniq.plans import plugins, providers, search
from graniq.plans.default_plugins import default_registry
from graniq.sources import corpus, files
from graniq.streaming import handlers, ingest

SF = "/root/testdata/sf0.001"
MARKDOWN = "# 개요\n첫 문장이다.\n## 범위\n둘째 문장이다.\n### 세부\n셋째 문장이다.\n## 기간\n넷째 문장이다."


def structured(spark, text, **how):
    rows = chunking.structure(spark.createDataFrame([(1, text)], "node_id long, text string"), **how).collect()
    return [r for r in rows if r["kind"] == "section"], [r for r in rows if r["kind"] == "chunk"]


def test_nested_headings(spark):
    sections, chunks = structured(spark, MARKDOWN, target=40, most=80, overlap=10)
    by = {s["title"]: s for s in sections}
    assert by["세부"]["parent"] == by["범위"]["ordinal"] and by["세부"]["heading_path"] == "개요 > 범위 > 세부"
    assert by["기간"]["parent"] == by["개요"]["ordinal"]
    assert {c["section"] for c in chunks} <= {s["ordinal"] for s in sections}


def test_text_without_headings(spark):
    sections, chunks = structured(spark, "\n\n".join(f"문단 {i} " + "말 " * 30 for i in range(40)), target=60, most=120, overlap=10)
    assert len(sections) > 1 and all(0 <= s["first"] <= s["last"] < len(chunks) for s in sections)


def test_pages(spark):
    text = "\n".join(f"[page {i}]\n" + "\n".join("한 문장이 여기 있다." for _ in range(12)) for i in range(1, 6))
    sections, chunks = structured(spark, text, target=50, most=100, overlap=10)
    assert any(c["page"] for c in chunks) and any(s["title"].startswith("p.") for s in sections)


def test_byte_cap_and_windows(spark):
    pieces = chunking.by_bytes("가" * 5000)
    assert all(len(p.encode()) <= chunking.MAX_BYTES for p in pieces) and len("".join(pieces)) >= 4990
    lines = "\n".join("x" * 99 for _ in range(100))
    assert [len(p) for p in chunking.by_bytes(lines)] == [6999, 3000]
    got = spark.createDataFrame([("a b c d e f g",), ("a  b, c",), ("a b",)], "t string").select(chunking.windows(F.col("t"), 3, 1)).collect()
    assert [r[0] for r in got] == [["a b c", "c d e", "e f g"], ["a  b,", ", c"], ["a b"]]


def test_structure_of_odd_texts(spark):
    text = "intro\n[page 2]\n\n### Deep\nx\n[page 3]\n### Next\ny\n# Top\n## Empty\n## Sub\n" + "w " * 25 + "\nend\n[page 9]"
    sections, chunks = structured(spark, text, target=6, most=10, overlap=4)
    seen = {(s["ordinal"], s["title"], s["heading_path"], s["parent"], s["page"], s["first"], s["last"]) for s in sections}
    # Skipped levels nest in the path, siblings included, while the parent is the nearest lower level.
    assert seen == {(0, "본문", "", None, None, 0, 0), (1, "Deep", "Deep", 0, 2, 1, 1), (2, "Next", "Deep > Next", 0, 3, 2, 2), (5, "Sub", "Top > Sub", 3, 3, 3, 7)}
    assert [(c["ordinal"], c["section"], c["page"]) for c in sorted(chunks, key=lambda c: c["ordinal"])] == [(0, 0, 2), (1, 1, 3), (2, 2, 3), (3, 5, 3), (4, 5, 3), (5, 5, 3), (6, 5, 3), (7, 5, 9)]
    assert [c["tokens"] for c in sorted(chunks, key=lambda c: c["ordinal"])] == [1, 1, 1, 10, 10, 10, 7, 1]
    for empty in (None, "", " \n\n", "# only\n## headings", "[page 1]"):
        assert structured(spark, empty) == ([], [])
    _, capped = structured(spark, "\n".join("a b c d e" for _ in range(30)), target=5, max_chunks=7)
    assert sorted(c["ordinal"] for c in capped) == list(range(7))
    runs, _ = structured(spark, "\n".join(f"[page {p}]\none two three" for p in (1, 1, 2, 2, 2, 3)), target=3)
    assert [(s["title"], s["first"], s["last"]) for s in sorted(runs, key=lambda s: s["ordinal"])] == [("p.1–2", 0, 3), ("p.3", 4, 5)]


def test_fold_equals_native_packing(spark):
    docs = corpus.table(spark, SF, "documents").select(F.col("doc_id").alias("node_id"), "text")
    fold = chunking.structure(docs, target=120, most=10**9).filter("kind = 'chunk'")
    native = chunking.pack_lines(docs, "node_id", 120)
    # The fold also cuts at 7000 bytes; compare the documents where it doesn't.
    short = docs.filter(F.octet_length("text") < 7000).select("node_id")
    a = {(r["node_id"], r["ordinal"], r["text"]) for r in fold.join(short, "node_id").collect()}
    b = {(r["node_id"], r["ordinal"], r["text"]) for r in native.join(short, "node_id").collect()}
    assert a == b


def test_scope_and_blank_search(spark):
    c, n = corpus.chunks(spark, SF), corpus.nodes(spark, SF)
    assert legs.scope(c, ["en"], "/src1/").filter("repository <> 'en' OR NOT startswith(path, '/src1/')").isEmpty()
    assert search.search(c, n, None, "  ").count() == 0 and search.search(c, n, None, "de la", repositories=[]).count() == 0
    few = search.search(c, n, None, "de la en", cfg=SearchConfig(top_k=3, rerank=True, weight_path=0))
    assert 0 < few.count() <= 3


def test_budget_and_diversity(spark):
    rows = spark.createDataFrame([(1, 0, 0.9, "a" * 500), (1, 9, 0.8, "b" * 500), (2, 0, 0.1, "c" * 500)], "node_id long, first long, score double, text string")
    placed = fusion.diversify(rows, 1, 10)
    assert [r["node_id"] for r in placed.orderBy("place").collect()] == [1, 2, 1]
    fit = fusion.fit_budget(placed, 250).orderBy("place").collect()
    assert [len(r["text"]) for r in fit] == [500, 251] and fit[1]["text"].endswith("…")


def test_upsert_keeps_summary_and_merges(spark):
    schema = "collection string, external_id string, title string, summary string, attributes map<string,string>, labels array<string>, evidence array<string>"
    old = spark.createDataFrame([("c", "1", "old", "s", {"a": "1", "b": "2"}, ["x"], [])], schema)
    new = spark.createDataFrame([("c", "1", "new", "", {"b": "3"}, [], None), ("c", "2", "more", "t", {}, None, [])], schema)
    got = {r["external_id"]: r for r in records.upsert_records(old, new).collect()}
    assert (got["1"]["title"], got["1"]["summary"], got["1"]["attributes"], got["1"]["labels"], got["1"]["created"]) == ("new", "s", {"a": "1", "b": "3"}, [], False)
    assert got["2"]["created"]


def test_nearest_equals_brute_force(spark):
    e = corpus.table(spark, SF, "embeddings").filter("vec_id < 60").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = {r["id"]: r["vector"] for r in e.collect()}
    left = {i: v for i, v in rows.items() if i < 5}
    got = {(r["from_id"], r["rnk"]): r["to_id"] for r in matching.nearest(e.filter("id < 5"), e.filter("id >= 5"), 4, -1.0).collect()}
    for i, v in left.items():
        best = sorted((j for j in rows if j >= 5), key=lambda j: (-sum(a * b for a, b in zip(v, rows[j])), j))[:4]
        assert [got[i, k + 1] for k in range(4)] == best


def test_paths(spark):
    nodes = spark.createDataFrame([(1, "/a/x"), (2, "/a_b/y"), (3, "/ab")], "node_id long, path string")
    assert [r["path"] for r in browse.move_subtree(nodes, "/a", "/z").orderBy("node_id").collect()] == ["/z/x", "/a_b/y", "/ab"]
    with pytest.raises(ValueError):
        browse.move_subtree(nodes, "/a", "/a/b")
    assert browse.delete_subtree(nodes, [], "/a")[0].count() == 2
    slugs = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "id int, slug string")
    assert [r["unique_slug"] for r in browse.unique_slugs(slugs).orderBy("id").collect()] == ["s", "s-1", "t"]


def test_plugins(spark):
    r = default_registry()
    assert {p.kind for p in r.catalog()} == set(plugins.KINDS)
    link = r.plugins["semantic_link"]
    assert plugins.coerce(link, {"left": "a", "right": "b", "top_k": "7"})["top_k"] == 7
    for bad in ({"left": "a"}, {"left": "a", "right": "b", "top_k": "many"}):
        with pytest.raises(ValueError):
            plugins.coerce(link, bad)
    with pytest.raises(ValueError):
        r.register(link)
    df = spark.createDataFrame([("t", 1)], "title string, record_id int")
    out, runs = plugins.run_pipeline(r, [("select_records", {}), ("weighted_rubric", {}), ("report", {})], df)
    assert out.first()[0] == "t" and [x.status for x in runs] == ["done", "failed", "done"]
    assert scores.DEFAULT_CARD[0][1] == 0.25


def test_files(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(z.getvalue())
    (tmp_path / "p.html").write_text("<html><head><title>T&amp;U</title><script>x()</script></head><body><nav>n</nav><h2>H</h2><p>Hi</p></body></html>")
    (tmp_path / "bad.pptx").write_bytes(b"no")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "skip.exe").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.extract(files.uploads(spark, str(tmp_path))).collect()}
    assert got["d.docx"]["text"] == "# Top\nBody\na | b" and got["p.html"]["text"] == "T&U\n\n## H\n\nHi"
    assert got["bad.pptx"]["status"] == got["x.pdf"]["status"] == "failed" and "skip.exe" not in got


def test_csv(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text("﻿name;id;note\nA;1;x\n;2;y\nB;;\n", encoding="utf-8")
    rows = {r["title"]: r for r in files.csv_records(spark, str(f), "name", "id").collect()}
    assert set(rows) == {"A", "B"} and rows["A"]["attributes"] == {"id": "1", "note": "x"} and rows["B"]["external_id"] == "B"
    with pytest.raises(ValueError):
        files.csv_records(spark, str(f), "title")


def test_a_node_that_lost_its_text_loses_its_chunks(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    to_nodes = lambda df: df.select(F.col("doc_id").alias("node_id"), "text")
    for rows in ([(1, "one"), (2, "two")], [(1, "")]):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(source)
        ingest.ingest(spark, source, spark.createDataFrame([], "doc_id long, text string").schema, target, str(tmp_path / "cp"), to_nodes).awaitTermination()
    assert [(r["node_id"], r["text"]) for r in ingest.latest(spark, target).collect()] == [(2, "two")]


def test_stream_equals_batch(spark, tmp_path):
    docs = corpus.table(spark, SF, "documents").select("doc_id", "text").limit(40).coalesce(1)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    docs.repartition(3).write.parquet(source)
    to_nodes = lambda df: df.select(F.col("doc_id").alias("node_id"), "text")
    ingest.ingest(spark, source, docs.schema, target, str(tmp_path / "cp"), to_nodes).awaitTermination()
    got = {(r["node_id"], r["ordinal"], r["text"]) for r in ingest.latest(spark, target).collect()}
    want = {(r["node_id"], r["ordinal"], r["text"]) for r in ingest.chunk_table(to_nodes(spark.read.parquet(source))).collect()}
    assert got == want and got


def test_models_and_handlers(spark):
    parts = spark.createDataFrame([(1, "A > B", "x y"), (2, " ", "x y"), (3, None, None)], "id long, heading_path string, text string")
    got = {r["id"]: r["embedding"] for r in providers.embedded(parts, providers.HashEmbedder(16), 20).collect()}
    one = spark.range(1).select(V.pad(V.hash_embedding(F.lit("x y"), 16), 20).alias("v")).first()["v"]
    assert got[2] == one != got[1] and len(got[1]) == 20
    table = {r["id"]: r["embedding"] for r in V.hash_embeddings(parts, "id", 16).collect()}
    assert table[1] == pytest.approx(one[:16]) and not any(table[3])
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "job_id long, kind string")
    reg = handlers.Handlers()
    assert {r["error"] for r in reg.dispatch(rows).collect()} == {"no handler"}
    reg.register("a", lambda jobs: jobs.filter("job_id = 1").select("job_id", F.lit("ok").alias("result")))
    assert {(r["job_id"], r["result"], r["error"]) for r in reg.dispatch(rows).collect()} == {(1, "ok", None), (2, None, "no handler"), (3, None, "no result")}
    with pytest.raises(ValueError, match="already"):
        reg.register("a", lambda jobs: jobs)


def test_hidden_repositories_are_errors(spark):
    repositories = spark.createDataFrame([("en", "me", "private"), ("de", "you", "private")], "repository string, owner_id string, visibility string")
    c, n = corpus.chunks(spark, SF), corpus.nodes(spark, SF)
    with pytest.raises(LookupError, match="de"):
        search.search_visible(c, n, None, repositories, "me", "de la", wanted=["en", "de"])
    assert {r["repository"] for r in search.search_visible(c, n, None, repositories, "me", "the").join(n, "node_id").collect()} <= {"en"}
