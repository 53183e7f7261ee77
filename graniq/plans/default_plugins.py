"""The plug-ins that come with the engine, bound to its operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from graniq.functions import scores as S
from graniq.operators import matching, records
from graniq.plans.plugins import Plugin, Registry, Setting


def default_registry() -> Registry:
    r = Registry()
    r.register(Plugin("select_records", "source", "Records with a title", lambda df, _: df.filter(F.trim(F.coalesce("title", F.lit(""))) != "")))
    r.register(Plugin("record_text", "enrich", "Text of a record", lambda df, _: df.withColumn("text", records.record_text(F.col("title"), F.col("summary"), F.col("attributes"), F.col("labels")))))
    r.register(Plugin("weighted_rubric", "score", "Weighted scorecard", lambda df, c: records.weighted_scores(df, c["key"], S.DEFAULT_CARD), (Setting("key", default="record_id", required=True),)))
    r.register(
        Plugin(
            "semantic_link", "match", "Similar records", lambda df, c: matching.nearest(df.filter(F.col("collection") == c["left"]), df.filter(F.col("collection") == c["right"]), max(1, min(20, c["top_k"])), c["least"]),
            (Setting("left", "collection", required=True), Setting("right", "collection", required=True), Setting("top_k", "number", 5), Setting("least", "number", 0.3)),
        )
    )
    r.register(Plugin("report", "export", "One line per record", lambda df, c: df.select(F.concat_ws(": ", *[F.col(x).cast("string") for x in c["columns"].split(",")]).alias("line")), (Setting("columns", default="title", required=True),)))
    return r
