"""The corpus pipeline: documents to token files.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graniq.llm.decontaminate import decontaminate
from graniq.llm.jaccard_join import keep_one
from graniq.llm.mixing import apply_mix
from graniq.llm.quality import keep_good
from graniq.llm.storage import materialize
from graniq.llm.token_files import read_tokens, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null texts, languages and sources are judged as they are; rows are judged each by itself, so
    repeated ids and rows stay or go one by one; an empty table stays empty; further columns are
    handed on, whatever their names.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a Jaccard similarity of 0.8 or more on five words, the one with the least doc_id stays.

    Rows are judged by doc_id and text: another text under the same doc_id is a document of its
    own, a null doc_id comes last, and of rows equal in both one stays. Documents without words stay.
    """
    return keep_one(docs, shingle=5, num=8, den=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain at least half of a benchmark item, in tiles of four words or more, go.

    Rows are judged by doc_id and text, null ids like others; null and empty texts stay.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_match=4, threshold=0.5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: weights 3, 1, 2, 150 % of all words, at most two copies.

    A null source is one, the last; null and empty texts have no words and stay once; equal rows
    share their copies; further columns are handed on.
    """
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, null texts as empty ones; what is read back from them, a row for each."""
    return read_tokens(write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("token files", tokens),
]

#: The classifier and the rounding of the mix are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
