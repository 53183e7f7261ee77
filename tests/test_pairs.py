"""Links that are all pairs of a key."""

from collections import Counter

from graniq import queries
from graniq.operators import records

SF = "/root/testdata/sf0.01"


def test_links_in_many_tasks(spark, monkeypatch):
    """No task of the links makes much more than its share, and a key of many pairs is cut; the links stay the same."""
    whole = Counter(map(tuple, queries._links(spark, SF).collect()))
    monkeypatch.setattr(records, "PAIRS", 20)
    parts = [sum(1 for _ in p) for p in queries._links(spark, SF).rdd.glom().collect()]
    assert sum(parts) == sum(whole.values()) and max(parts) <= 200 and sum(n > 0 for n in parts) >= 8
    assert Counter(map(tuple, queries._links(spark, SF).collect())) == whole
    left = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 7), (None, 1)], "k int, a int")
    right = spark.createDataFrame([(1, i) for i in range(60)] + [(3, 7), (None, 1)], "k int, b int")
    got = records.pairs(left, right, ["k"], most=100)
    assert Counter((r["a"], r["b"]) for r in got.collect()) == Counter((i, j) for i in range(40) for j in range(60))
    assert records.pairs(left.limit(0), right, ["k"]).count() == 0
