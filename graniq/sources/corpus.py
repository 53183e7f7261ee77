"""The test tables as a corpus: repositories, nodes, chunks, sections, records, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION_CHUNKS = 6
STRIDE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_path(sf_dir: str, name: str) -> str:
    """A table's path for a file stream, be it a file or a folder of files: as a pattern, since a stream takes no single file's name."""
    return f"{sf_dir}/{name}.parque[t]"


def node_path() -> Column:
    return F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document: its language is the repository, its source the folder."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.col("lang"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(F.col("doc_id").alias("node_id"), F.col("lang").alias("repository"), name.alias("name"), node_path().alias("path"), F.col("source").alias("folder"), F.lit("file").alias("kind"), F.lit("ready").alias("status"), F.col("n_chars").alias("size_bytes"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk per line that isn't blank; runs of six chunks are a section."""
    docs = table(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(r"\S")))
    rows = docs.select(F.col("doc_id").alias("node_id"), F.col("lang").alias("repository"), node_path().alias("path"), F.posexplode(lines).alias("ordinal", "text"))
    ordinal = F.col("ordinal").cast("long")
    section = F.col("node_id") * STRIDE + F.floor(F.col("ordinal") / SECTION_CHUNKS)
    return rows.select((F.col("node_id") * STRIDE + ordinal).alias("chunk_id"), "node_id", section.alias("section_id"), ordinal.alias("ordinal"), "text", "repository", "path", F.lit("ready").alias("status"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of chunks: that of its number for the first of each node."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") * STRIDE).alias("chunk_id"), "embedding")


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks, the first of each node with the vector of its number, where there is one."""
    return chunks(spark, sf_dir).join(vectors(spark, sf_dir), "chunk_id", "left")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first section of each node that has a vector, with that vector."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") * STRIDE).alias("section_id"), "embedding")
