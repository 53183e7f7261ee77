import math
import random

import duckdb
from pyspark.sql import functions as F

from graniq.config import SearchConfig, overlay
from graniq.functions import scores as S
from graniq.functions import text as T
from graniq.functions import vectors as V
from graniq.sqls import round_even


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_query_terms(spark):
    terms = lambda q: one(spark, T.query_terms(F.lit(q)))
    assert terms("보증기간을") == terms("보증기간이") == ["보증기간"]
    assert terms("What is the 보증 범위에서는") == ["보증", "범위"]
    assert terms("") == [] and terms("a") == [] and terms(None) == []
    assert terms("café_x y2 café_x") == ["café_x", "y2"]
    assert len(terms(" ".join(f"w{i}x" for i in range(20)))) == 8


def test_trigram_similarity(spark):
    sim = lambda a, b: one(spark, T.similarity(T.trigrams(F.lit(a)), T.trigrams(F.lit(b))))
    assert sim("word", "word") == 1.0 and sim("", "") == 0.0
    assert math.isclose(sim("word", "two words"), 4 / 11)


def test_names(spark):
    name = lambda s: one(spark, T.clean_name(F.lit(s)))
    assert [name(s) for s in ("../../etc/passwd", "a\\b\\c.txt", " . ", "", "x\x00y.md", "..")] == ["passwd", "c.txt", None, None, "xy.md", None]
    assert one(spark, T.slugify(F.lit(" My Repo / 문서! "))) == "my-repo-문서"
    assert one(spark, T.slugify(F.lit("!!"))) == "repo"
    assert one(spark, T.mask(F.lit("12345678"))) == "********" and one(spark, T.mask(F.lit("abcdefghijkl"))) == "abcd…ijkl"


def test_text(spark):
    assert one(spark, T.clean(F.lit(" a \r\nb\t\n\n\n\nc "))) == "a\nb\n\nc"
    assert one(spark, T.title_of(F.lit("\n first line\nsecond"))) == "first line"
    assert one(spark, T.summary(F.lit("a  b\nc"), F.lit(""), F.lit("T"))) == "T: a b c"
    assert one(spark, T.lenient_json(F.lit('```json\n{"a": 1}\n```'))) == '{"a":1}'
    assert one(spark, T.lenient_json(F.lit('so: [1, 2] ok'))) == "[1,2]"
    assert one(spark, T.lenient_json(F.lit("none"))) is None
    assert one(spark, T.cite(F.lit(2), F.lit("/a/b.md"), F.lit("H"), F.lit(3))) == "[2] a/b.md > H p.3"


def test_vectors(spark):
    v = F.array(*[F.lit(0.1)] * 768)
    padded = one(spark, V.pad(v, 1536))
    assert len(padded) == 1536 and padded[767] == 0.1 and padded[768] == 0.0
    assert len(one(spark, V.pad(F.array_repeat(F.lit(0.1), 3072), 1536))) == 1536
    e = one(spark, V.hash_embedding(F.lit("보증 기간 안내 보증"), 32))
    assert math.isclose(sum(x * x for x in e), 1.0) and e == one(spark, V.hash_embedding(F.lit("보증 기간 안내 보증"), 32))
    assert set(one(spark, V.hash_embedding(F.lit(""), 8))) == {0.0}
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_weights(spark):
    dims = lambda *d: F.array(*[F.struct(F.lit(k).alias("key"), F.lit(w).alias("weight")) for k, w in d])
    weights = lambda *d: {x["key"]: x["weight"] for x in one(spark, S.normalise_weights(dims(*d)))}
    assert weights(("a", 25.0), ("b", 75.0)) == weights(("a", 0.25), ("b", 0.75)) == {"a": 0.25, "b": 0.75}
    assert weights(("a", 0.0), ("b", 0.0)) == {"a": 0.5, "b": 0.5}
    assert weights(("a", 1.0), ("", 3.0)) == {"a": 1.0}
    assert weights(("a", -1.0), ("b", 3.0)) == {"a": 0.0, "b": 1.0}
    assert len(S.DEFAULT_CARD) == 5 and math.isclose(sum(w for _, w in S.DEFAULT_CARD), 1)
    assert [one(spark, S.clamp(F.lit(x))) for x in ("120", "-3", "7.5", "x", None)] == [100.0, 0.0, 7.5, 0.0, 0.0]
    assert [one(spark, S.tier(F.lit(x))) for x in (78.0, 60.0, 59.9)] == ["core", "short", "long"]


def test_config():
    c = overlay({"top_k": 3, "nope": 1}, {"top_k": None, "rrf_k": 0})
    assert c.top_k == 3 and c.resolved().rrf_k == 60 and SearchConfig(weight_path=0).resolved().weight_path == 0


def test_round_even_is_pythons(spark):
    rng = random.Random(8)
    values = [2.25, 0.15, 0.05, 0.25, 0.35, 99.95, 1e-9, 0.0, -0.15, -2.25, 77.95, 59.95, 100.0, 0.049999999999999996, 5e-324, 2.0**60] + [round(rng.uniform(0, 100), 2) for _ in range(500)] + [rng.randrange(4001) / 40 for _ in range(500)] + [rng.uniform(0, 1) for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        got = [r[0] for r in df.select(S.round_even(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values]
    assert spark.range(1).select(S.round_even(F.lit(None).cast("double"))).first()[0] is None
    con = duckdb.connect()
    assert [con.execute(f"SELECT {round_even('?::DOUBLE')}", [abs(v)]).fetchone()[0] for v in values[:15] + values[16:300]] == [round(abs(v), 1) for v in values[:15] + values[16:300]]


def test_safe_stem_is_cut_last(spark):
    """Blanks go before the cut, so that one may stay at its end."""
    assert one(spark, T.safe_stem(F.lit("  " + "a" * 79 + " b/c  "))) == "a" * 79 + " "
    assert one(spark, T.safe_stem(F.lit("?*"))) == one(spark, T.safe_stem(F.lit(None).cast("string"))) == "card"
