"""Rows of documents told apart by doc_id and text, and decisions on rows that shuffle few texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniq.llm.storage import materialize

#: Bits of the filter of wanted rows: 8 MB, whatever their number.
FILTER_BITS = 1 << 26


def row_key() -> list[Column]:
    """Two numbers that tell a row from those of another doc_id or text; never null."""
    return [F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(7), "text", "doc_id").alias("b")]


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns by their names as they are, dots included."""
    return [F.col(f"`{c}`") for c in docs.columns]


def _place(column: str) -> Column:
    """Spark's bitmaps count from 1."""
    return F.pmod(F.col(column), F.lit(FILTER_BITS)) + 1


def bitmaps(wanted: DataFrame, column: str) -> DataFrame:
    """__bucket (from 1), __bits: which of the lowest bits of a column occur, FILTER_BITS bits in all."""
    return wanted.select(_place(column).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__bits"))


def possible(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with the row key, in those whose key is perhaps that of a wanted row and those for which it surely is not."""
    rows = docs.withColumn("__h", _place("a")).withColumn("__bucket", F.bitmap_bucket_number("__h"))
    found = F.expr("coalesce((cast(conv(hex(substring(__bits, cast(bitmap_bit_position(__h) div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(bitmap_bit_position(__h) % 8 as int))) <> 0, false)")
    marked = rows.join(F.broadcast(bitmaps(wanted, "a")), "__bucket", "left").withColumn("__found", found)
    return marked.filter("__found").select(*columns_of(docs)), marked.filter("NOT __found").select(*columns_of(docs))


def without(docs: DataFrame, dropped: DataFrame, kept_once: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` but those of ``dropped`` (a, b), and those of ``kept_once`` (a, b) once each."""
    judged = dropped.select("a", "b", F.lit(False).alias("__once"))
    if kept_once is not None:
        judged = judged.unionByName(kept_once.select("a", "b", F.lit(True).alias("__once")))
    judged = materialize(judged, "rows-judged")
    # The row's own columns are in a struct, so that their names meet no others.
    asked, others = possible(docs.select(*row_key(), F.struct(*columns_of(docs)).alias("row")), judged)
    met = asked.join(judged, ["a", "b"], "left")
    once = met.filter("__once").groupBy("a", "b").agg(F.first("row").alias("row")).select("row")
    kept = others.select("row").unionByName(met.filter("__once IS NULL").select("row")).unionByName(once)
    return kept.select([F.col("row")[c].alias(c) for c in docs.columns])
