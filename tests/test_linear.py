"""Long texts and long lists: what must not grow with a square."""

import random
import time

from pyspark.sql import functions as F

from graniq.operators import chunking, records
from graniq.sources import store


def test_packing_is_linear(spark):
    """A text of 200,000 lines, each joined to a chunk once."""
    text = "\n".join("word " * (i % 9) + str(i) for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "a\n\nb"), (3, ""), (4, None)], "doc long, text string")
    start = time.monotonic()
    got = chunking.pack_lines(docs, "doc", 120).filter("doc = 1").agg(F.count("*").alias("n"), F.max("ordinal").alias("last"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most")).first()
    assert time.monotonic() - start < 60
    assert got["n"] == got["last"] + 1 and got["most"] <= 120 and got["tokens"] == sum(i % 9 + 1 for i in range(200_000))
    assert [tuple(r) for r in chunking.pack_lines(docs, "doc", 1).filter("doc > 1").select("doc", "ordinal", "text").orderBy("doc", "ordinal").collect()] == [(2, 0, "a"), (2, 1, "b")]


def test_structure_of_a_long_text(spark):
    text = "\n".join(f"# Part {i}" if i % 500 == 0 else f"line {i} of it" for i in range(50_000))
    docs = spark.createDataFrame([(1, text)], "node_id long, text string")
    start = time.monotonic()
    parts = chunking.structure(docs, target=200, most=400, overlap=20, max_chunks=10**6)
    counts = {r["kind"]: r["n"] for r in parts.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert time.monotonic() - start < 90
    assert counts["section"] == 100 and counts["chunk"] >= 1000
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "array_append" not in plan and "monotonically" not in plan


def test_folds_equal_their_rules():
    rng = random.Random(4)
    for _ in range(50):
        n = rng.randrange(0, 40)
        sections, weights, alone = sorted(rng.randrange(3) for _ in range(n)), [rng.randrange(12) for _ in range(n)], [rng.random() < 0.1 for _ in range(n)]
        parts = chunking.filled(sections, weights, alone, 20)
        groups = {}
        for i, p in enumerate(parts):
            groups.setdefault(p, []).append(i)
        for own in groups.values():
            assert len({sections[i] for i in own}) == 1 and (len(own) == 1 or not any(alone[i] for i in own))
            assert sum(weights[i] for i in own) <= 20 or sum(weights[i] > 0 for i in own) == 1
        assert parts == sorted(parts)
    assert chunking.runs_of([None, None, 1, 1, 2, 3, 3]) == [0, 0, 1, 1, 2, 2, 2]


def test_taxonomy_of_many_terms(spark):
    """20,000 labels meet records by equality: no nested loop, no product; labels equal those of a search for each term."""
    rng = random.Random(2)
    letters = "abcdefgh"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    labels = [" > ".join(word(rng.randrange(2, 7)) for _ in range(rng.randrange(1, 3))) for _ in range(20_000)]
    texts = [" ".join(word(rng.randrange(1, 12)) for _ in range(rng.randrange(0, 12))) for _ in range(30)] + [None, "", "A"]
    taxonomy = spark.createDataFrame(list(enumerate(labels)), "pos int, label string")
    rows = spark.createDataFrame(list(enumerate(texts)), "record_id int, text string")
    got = records.classify(rows, taxonomy, "record_id", F.col("text"))
    want = {}
    for i, t in enumerate(texts):
        hits = []
        for pos, label in enumerate(labels):
            n = sum(w in (t or "").lower() for w in {w for w in label.replace(">", " ").split() if len(w) >= 2})
            if n:
                hits.append((-n, pos, label))
        want[i] = [label for *_, label in sorted(hits)[:3]]
    assert {r["record_id"]: r["labels"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbers_of_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = store.numbered(rows, ["k"]).collect()
    assert sorted((r["number"], r["k"]) for r in got) == [(i + 1, i) for i in range(1000)]
    assert store.numbered(rows.limit(0), ["k"]).count() == 0
