"""Vector functions as Column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero or null vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def pad(v: Column, dim: int = 1536) -> Column:
    """Cut, or filled up with zeros, to dim numbers."""
    return F.slice(F.concat(doubles(v), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def bucket(word: Column, dim: int) -> Column:
    """A word's place in a bag of dim buckets: its MD5's first 28 bits, so that any engine can follow."""
    return F.conv(F.substr(F.md5(word.cast("binary")), F.lit(1), F.lit(7)), 16, 10).cast("long") % dim


def hash_counts(texts: DataFrame, key: str, dim: int = 256, text: str = "text") -> DataFrame:
    """The offline embedding as a sparse table: key, bucket, n (words), weight (at unit length)."""
    words = texts.select(key, F.explode(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")).alias("__word"))
    counts = words.groupBy(key, bucket(F.col("__word"), dim).alias("bucket")).agg(F.count("*").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.withColumn("weight", F.col("n") / length)


def hash_embeddings(texts: DataFrame, key: str, dim: int = 256, text: str = "text") -> DataFrame:
    """key, embedding: the offline embedding of each text; a text without words has zeros. Keys are distinct."""
    weights = hash_counts(texts, key, dim, text).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "weight"))).alias("__map"))
    place = lambda i: F.coalesce(F.try_element_at("__map", i), F.lit(0.0))
    return texts.select(key).join(weights, key, "left").select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), place).alias("embedding"))


def hash_embedding(text: Column, dim: int = 256) -> Column:
    """The offline embedding of a single text, such as a query; tables take hash_embeddings."""
    places = F.array_sort(F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: bucket(w, dim)))
    start = F.array_repeat(F.lit(0.0), dim)
    counts = F.aggregate(places, start, lambda s, p: F.concat(F.slice(s, 1, p.cast("int")), F.array(F.element_at(s, p.cast("int") + 1) + 1.0), F.slice(s, p.cast("int") + 2, dim)))
    return normalise(counts)
