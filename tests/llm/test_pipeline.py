import corpus_pipeline as pipe
import duckdb
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipe.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights", "token files"]
    sizes = [docs.count()]
    for name, stage in pipe.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        if name != "mixing to target weights":
            assert out.join(docs, out.columns, "left_anti").isEmpty() and out.count() == out.distinct().count()
        docs = out
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    rows = pipe.STAGES[-1][1](spark, docs, SF)
    assert rows.count() == docs.count()


def test_near_duplicates_keep_one_of_each(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " more"), (3, "other words are here now"), (3, "other words are here now"), (4, None), (None, base), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("lang", "source")})
    got = sorted(str(r["doc_id"]) for r in pipe.near_duplicates(spark, docs, SF).collect())
    assert got == ["1", "3", "4", "5"]


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r[0] for r in pipe.quality(spark, docs, sf).select("doc_id").collect()}
    clean = [r[0] for r in duckdb.sql(f"select doc_id from '{sf}/labels.parquet' where quality = 1 and toxic = 0").fetchall()]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_stages_of_odd_rows(spark):
    """Nulls, repeated ids and rows, long and empty texts, clashing names, and no rows at all."""
    rows = [(1, "some plain words here", None, None), (1, "other plain words there", "en", "s"), (None, "w " * 3000, "en", None), (2, None, "de", "s"), (3, "", "en", "t"), (3, "", "en", "t"), (4, "x" * 20000, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({"n_chars": F.length("text").cast("long"), "keep": F.lit("mine"), "score": F.lit(7.5), "a": F.lit("mine"), "rows": F.lit(1), "x.y": F.lit(2)})
    for _, stage in pipe.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.filter("keep <> 'mine' OR score <> 7.5 OR a <> 'mine' OR rows <> 1 OR `x.y` <> 2").isEmpty()
        assert stage(spark, docs.limit(0), SF).count() == 0
    # None of these is a copy of another or holds a benchmark item; rows equal in all are one to the join only with words.
    assert pipe.near_duplicates(spark, docs, SF).count() == pipe.decontamination(spark, docs, SF).count() == len(rows)
    tokens = pipe.tokens(spark, docs, SF)
    assert tokens.count() == len(rows) and tokens.filter("n_tokens = 1").count() == 3
    assert pipe.tokens(spark, docs.limit(0), SF).count() == 0


def test_contaminated_rows_go_alone(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(1, f"before {item} after"), (1, "a clean text under the same number"), (None, item), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("lang", "source")})
    assert sorted(str(r["text"])[:7] for r in pipe.decontamination(spark, docs, SF).collect()) == ["None", "a clean"]
