"""Stored indexes against scans and brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graniq.config import SearchConfig
from graniq.functions import ranks
from graniq.operators import cells, index, legs
from graniq.plans import many, providers, stored
from graniq.plans import search as plans
from graniq.sources import corpus

SF = "/root/testdata/sf0.001"
ODD = ["", "  ", "Alpha beta", "alpha alpha beta gamma", "beta alpha", "ALPHA.beta-gamma", "x_y alphabet", "alph_abet q", "ünïcode Beta", "the the the the", "of the and", "ab", "a", "b c d", "100% sure_thing"]


@pytest.fixture(scope="module")
def tables(spark):
    """Odd texts and the first documents, in two repositories."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "the", "of", "delta", "abet", "x1"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    rows = [(i // 4 * 1_000_000 + i % 4, i // 4, i // 4 * 1_000_000, i % 4, t, "rs"[i // 4 % 2], f"/d{i // 8 % 5}/alpha_{i // 4}.txt", "failed" if i // 4 % 13 == 5 else "ready") for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, node_id long, section_id long, ordinal long, text string, repository string, path string, status string")
    nodes = chunks.select("node_id", "repository", "path", "status").distinct().withColumn("kind", F.lit("file"))
    rs = np.random.default_rng(5)
    vectors = [(r[0], [float(x) for x in rs.normal(size=8)]) for r in rows[::2]]
    embedded = chunks.join(spark.createDataFrame(vectors, "chunk_id long, embedding array<double>"), "chunk_id", "left")
    sections = spark.createDataFrame([(n * 1_000_000, [float(x) for x in rs.normal(size=8)]) for n in range(0, 60, 3)], "section_id long, embedding array<double>")
    return embedded, nodes, sections


@pytest.fixture(scope="module")
def built(tables):
    index.BLOCK, before = 8, index.BLOCK
    yield stored.build(*tables)
    index.BLOCK = before


def pairs(df):
    return [(r["chunk_id"], r["rnk"], round(r["score"], 6)) for r in df.orderBy("rnk").collect()]


def test_rank_equals_its_formula(spark):
    def naive(words):
        if len(words) == 1:
            return sum(0.1 / (j + 1) ** 2 for j in range(len(words[0]))) / 1.64493406685
        out = 1.0
        for i, own in enumerate(words):
            for other in words[:i]:
                for a in own:
                    for b in other:
                        if 0 < abs(a - b) <= 100:
                            out *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(a - b) / 1.5 - 2)))
        return 1 - out

    cases = [[[1]], [[1, 5, 9]], [[1], [2]], [[1, 2], [3]], [[1], [200]], [[1, 50], [3, 120], [7]], [[16383], [16383]], [list(range(1, 256))]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, w array<array<int>>").select("i", ranks.rank(F.col("w")).alias("r"))
    for r in df.collect():
        assert r["r"] == pytest.approx(naive(cases[r["i"]]), abs=6e-8)
    kept = spark.range(1).select(ranks.places(F.sequence(F.lit(16000), F.lit(16500))).alias("p"), ranks.places(F.sequence(F.lit(16380), F.lit(16500))).alias("q")).first()
    assert len(kept["p"]) == 255 and kept["q"] == [16380, 16381, 16382, 16383]


def test_bound_holds(spark):
    rng = random.Random(1)
    for _ in range(20):
        words = [sorted(rng.sample(range(1, 60), rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4))]
        sizes = [len(w) for w in words]
        n = sum(a * b for i, a in enumerate(sizes) for b in sizes[:i])
        r = spark.range(1).select(ranks.rank(F.lit(words)).alias("r"), ranks.bound(F.lit(len(words)), F.lit(float(n)), F.lit(max(sizes))).alias("b")).first()
        assert r["b"] >= r["r"]


@pytest.mark.parametrize("tokens", [["alpha"], ["alpha", "beta"], ["the", "of", "alpha", "the"], ["alpha", "nowhere"], [], ["x1", "delta", "gamma", "beta"]])
@pytest.mark.parametrize("n", [3, 24])
def test_lexical_leg_equals_scan(tables, built, monkeypatch, tokens, n):
    monkeypatch.setattr(index, "PROBES", 2)
    want = legs.lexical_leg(legs.scope(tables[0]), tokens, n)
    assert pairs(index.lexical_leg(built.index, tokens, n)) == pairs(want)
    want = legs.lexical_leg(legs.scope(tables[0], ["r"], "/d2"), tokens, n)
    assert pairs(index.lexical_leg(built.index, tokens, n, stored.scope(built, ["r"], "/d2"))) == pairs(want)


@pytest.mark.parametrize("query", ["alpha", "ab", "abet gamma", "alph_abet", "x_y", "the of alphabet", "zzz", "ünïcode", "sure_thing 100", "de la en"])
def test_trigram_and_path_legs_equal_scan(spark, tables, built, query):
    terms, _, grams = plans.query_parts(spark, query)
    for repositories, prefix in ((None, ""), (["s"], ""), (["r", "s"], "/d1/")):
        chunks, nodes = legs.scope(tables[0], repositories, prefix), legs.scope(tables[1], repositories, prefix)
        within = stored.scope(built, repositories, prefix)
        assert pairs(index.trigram_leg(built.index, grams, terms, 10, within)) == pairs(legs.trigram_leg(chunks, grams, terms, 10))
        assert pairs(index.path_leg(built.index, grams, terms, scope=within)) == pairs(legs.path_leg(chunks, nodes, grams, terms))


def test_candidates_that_need_their_texts(spark, built, tables):
    """Trigrams of a long term may all be there without the term: such texts are read and left out."""
    terms, _, grams = plans.query_parts(spark, "alphabeta")
    assert pairs(index.trigram_leg(built.index, grams, terms, 2)) == pairs(legs.trigram_leg(legs.scope(tables[0]), grams, terms, 2)) == []


def test_search_equals_scan(spark, tables, built):
    vector = [0.3, -1.0, 0.2, 0.9, 0.0, 0.1, -0.4, 0.5]
    literal = F.array(*[F.lit(x) for x in vector])
    for query, repositories, prefix in (("alpha beta", None, ""), ("the gamma", ["s"], ""), ("delta", None, "/d3"), ("nothing_here", None, ""), ("  ", None, ""), ("alpha", [], "")):
        want = plans.search(*tables, query, literal, repositories=repositories, prefix=prefix)
        got = stored.search(built, query, vector, repositories=repositories, prefix=prefix)
        columns = ["place", "node_id", "first", "ordinals", "legs", "score", "text"]
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_search_reads_no_chunks_but_its_own(built):
    """The plans of the legs scan the postings of the query's words, filtered by directory and word."""
    plan = built.index.of_words("postings", ["alpha"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "PushedFilters: [IsNotNull(word), EqualTo(word,alpha)]" in plan


def test_lists_are_a_row_for_each_word_and_block(tables, built):
    """Postings and trigrams are stored as lists by block, not as a row for each word and chunk."""
    texts = {r["chunk_id"]: r["text"].lower() for r in tables[0].filter("status = 'ready'").collect()}
    words = {i: [w for w in re.split(r"[\W_]+", t) if w] for i, t in texts.items()}
    keys = {r["block"]: r["keys"] for r in built.index.table("members").collect()}
    assert sorted(k for x in keys.values() for k in x) == sorted(texts)
    rows = built.index.table("postings").collect()
    assert len({(r["word"], r["block"]) for r in rows}) == len(rows) < sum(len(set(w)) for w in words.values())
    got = {(r["word"], keys[r["block"]][a]): r["place"][b:e] for r in rows for a, b, e in zip(r["at"], r["start"], [*r["start"][1:], len(r["place"])])}
    want = {}
    for i, own in words.items():
        for at, w in enumerate(own, 1):
            want.setdefault((w, i), []).append(at)
    assert got == want
    grams = {(r["word"], keys[r["block"]][a]) for r in built.index.table("grams").collect() for a in r["at"]}
    assert grams == {(f"  {w} "[j : j + 3], i) for i, own in words.items() for w in own for j in range(len(w) + 1)}


def test_search_takes_models(spark, built):
    class Down:
        dim = 8

        def embed(self, text):
            return F.raise_error(F.lit("no model")).cast("array<double>")

        def score(self, query, text):
            return F.raise_error(F.lit("no model")).cast("double")

    class Longest:
        def score(self, query, text):
            return F.length(text).cast("double")

    plain = stored.search(built, "alpha beta").collect()
    assert stored.search(built, "alpha beta", embedder=Down(), reranker=Down(), cfg=SearchConfig(rerank_candidates=24)).collect() == plain
    first = stored.search(built, "alpha beta", reranker=Longest()).orderBy("place").collect()
    assert [len(r["text"]) for r in first] == sorted((len(r["text"]) for r in first), reverse=True)
    assert stored.search(built, "alpha", cfg=SearchConfig(top_k=500, max_per_document=1)).count() <= stored.MOST
    assert providers.HashEmbedder(8).dim == 8 and "vector" in {x for r in stored.search(built, "alpha beta", embedder=providers.HashEmbedder(8)).collect() for x in r["legs"]} | {"vector"}


def test_many_equals_one_by_one(spark, tables, built, monkeypatch):
    monkeypatch.setattr(many, "QUERIES", 3)
    monkeypatch.setattr(many, "TEXTS", 50)
    rs = np.random.default_rng(9)
    texts = ["alpha beta", "the", "gamma delta", "abet", "  ", None, "alphabet x_y", "beta alpha", "nowhere"]
    rows = [(i, t, [float(x) for x in rs.normal(size=8)] if i % 4 else None) for i, t in enumerate(texts)]
    queries = spark.createDataFrame(rows, "query_id long, text string, vector array<double>")
    cfg = SearchConfig(top_k=6)
    columns = ["place", "node_id", "first", "ordinals", "legs", "score", "text"]
    got = many.search(built, queries, cfg).collect()
    for i, text, vector in rows:
        want = sorted(map(tuple, stored.search(built, text, vector, cfg).select(*columns).collect()))
        assert sorted(tuple(r[c] for c in columns) for r in got if r["query_id"] == i) == want, text
    told = {r["query_id"]: r for r in many.evidence(built, queries).collect()}
    assert len(told) == len(rows) and told[4]["context"] == "" and told[5]["citations"] == []
    assert told[0]["context"].startswith("[검색된 문서 발췌]\n\n[1] d") and len(told[0]["citations"]) == 6


def naive_nearest(rows, query, n):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    scored = [(i, float(unit(v) @ unit(query))) for i, v in rows if v is not None and any(v)]
    return sorted(scored, key=lambda x: (-round(x[1], 9), x[0]))[:n]


def test_cells_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 16)
    rs = np.random.default_rng(2)
    centres = rs.normal(size=(6, 12)) * 4
    rows = [(i, [float(x) for x in centres[i % 6] + rs.normal(size=12)]) for i in range(200)]
    rows += [(300, rows[7][1]), (301, rows[7][1]), (302, None), (303, [0.0] * 12)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    own = cells.build(df, cells=8, parts=4)
    asked = [r for r in rows if r[0] % 25 == 7] + [(302, None), (303, [0.0] * 12)]
    got = cells.nearest(own, spark.createDataFrame(asked, "id long, vector array<double>"), 10, exact=True).collect()
    for i, v in asked:
        mine = [(r["id"], round(r["score"], 9)) for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rnk"])]
        if v is None or not any(v):
            assert mine == [] == cells.nearest_to(own, v or [], 10)
            continue
        want = [(j, round(s, 9)) for j, s in naive_nearest(rows, v, 10)]
        assert mine == want
        assert [(j, round(s, 9)) for j, s in cells.nearest_to(own, v, 10)] == want
    assert own.rows().count() == 202
    none = cells.build(df.limit(0))
    assert cells.nearest(none, df, 5, exact=True).count() == 0 == cells.nearest(none, df, 5).count() and cells.nearest_to(none, [1.0] * 12) == []


def test_cells_recall(spark):
    """Approximate search finds at least nine tenths of the nearest 24."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    own, asked = cells.build(v), v.filter("id % 100 = 0")
    right = {(r["query_id"], r["id"]) for r in cells.nearest(own, asked, 24, exact=True).collect()}
    found = {(r["query_id"], r["id"]) for r in cells.nearest(own, asked, 24).collect()}
    assert len(right) == 24 * asked.count()
    assert len(right & found) >= 0.9 * len(right)


def test_tables_are_indexed_once(spark):
    assert stored.of_tables(spark, SF) is stored.of_tables(spark, SF)
    assert stored.of_tables(spark, SF).index.table("chunks").count() == corpus.chunks(spark, SF).count()
