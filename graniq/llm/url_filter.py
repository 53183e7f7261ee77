"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

A rule is (host, path, verdict). It fits its host and all subdomains, if the url's
path starts with the rule's; of the rules that fit, the longest wins. Canonical form
of a url: the host with A-Z lower-cased, and the path without query and fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block has 8 words of 64 bits, and a key sets one bit in each.
WORDS = 8


def _lower(host: Column) -> Column:
    """A-Z alone, in rules as in urls."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and for urls without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _hashes(host: Column, path: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """Block number, and a mask for each word of the block."""
    key, bits = F.xxhash64(host, path), F.xxhash64(path, host, F.lit(1))
    masks = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]
    return F.pmod(key, F.lit(n_blocks)).alias("__block"), masks


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", bits_per_rule: int = 16, max_filter_bytes: int = 16 << 20) -> DataFrame:
    """``pages`` with the columns host, path, rule (host + path; null: none fits) and verdict.

    rules: host, path, verdict. Of equal rules the least verdict counts. The filter is
    broadcast; its size is at most ``max_filter_bytes``, whatever the number of rules (a
    fuller filter passes more false hits, and the join still removes them). Null urls get
    the default verdict. Columns of these names in ``pages`` are replaced; rows are kept
    as they are, repeated ones included.
    """
    host, path = canonical(F.col(url))
    base = pages.drop("rule", "verdict").withColumns({"host": host, "path": path})
    rules = rules.groupBy(_lower(F.col("host")).alias("__host"), F.coalesce("path", F.lit("")).alias("__path")).agg(F.min("verdict").alias("verdict"))
    rules = rules.filter(F.col("__host").isNotNull())
    shapes = rules.select(F.size(F.split("__host", r"\.")).alias("labels"), F.length("__path").alias("chars")).groupBy("labels", "chars").count().collect()
    n = sum(x["count"] for x in shapes)
    n_blocks = max(1, min(max_filter_bytes // (8 * (WORDS + 2)), -(-n * bits_per_rule // (64 * WORDS))))

    block, masks = _hashes(F.col("__host"), F.col("__path"), n_blocks)
    blocks = rules.select(block, *[m.alias(f"__w{i}") for i, m in enumerate(masks)]).groupBy("__block").agg(*[F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(WORDS)])

    # Every suffix of the host and prefix of the path that has the shape of some rule.
    places = F.array(*[F.struct(F.lit(x["labels"]).alias("l"), F.lit(x["chars"]).alias("c")) for x in shapes]) if shapes else F.expr("array_remove(array(named_struct('l', 0, 'c', 0)), named_struct('l', 0, 'c', 0))")
    labels = F.split("host", r"\.")
    urls = base.select("host", "path").filter(F.col("host") != "").distinct().withColumn("__labels", labels)
    fits = F.filter(places, lambda s: (s["l"] <= F.size("__labels")) & (s["c"] <= F.length("path")))
    keys = F.transform(fits, lambda s: F.struct(F.array_join(F.slice("__labels", F.size("__labels") - s["l"] + 1, s["l"]), ".").alias("h"), F.substr("path", F.lit(1), s["c"]).alias("p")))
    asked = urls.select("host", "path", F.explode(keys).alias("__k")).select("host", "path", F.col("__k.h").alias("__host"), F.col("__k.p").alias("__path"))
    block, masks = _hashes(F.col("__host"), F.col("__path"), n_blocks)
    possible = asked.withColumn("__block", block).join(F.broadcast(blocks), "__block")
    for i, m in enumerate(masks):
        possible = possible.filter(F.col(f"__w{i}").bitwiseAND(m) == m)
    hits = possible.select("host", "path", "__host", "__path").join(rules, ["__host", "__path"])
    rule = F.concat("__host", "__path")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("__host").alias("h"), rule.alias("rule"), F.col("verdict"))).alias("__best"))
    out = base.join(best, ["host", "path"], "left").withColumns({"rule": F.col("__best.rule"), "verdict": F.coalesce(F.col("__best.verdict"), F.lit(default))})
    return out.select(*[c for c in base.columns], "rule", "verdict")
