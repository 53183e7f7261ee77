"""Handlers of job kinds: claimed jobs are dealt to them as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Handlers:
    """A handler takes the claimed jobs of its kind and returns job_id and result."""

    def __init__(self):
        self.by_kind: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, kind: str, run: Callable[[DataFrame], DataFrame]) -> None:
        if kind in self.by_kind:
            raise ValueError(f"jobs of the kind {kind} have a handler already")
        self.by_kind[kind] = run

    def dispatch(self, claimed: DataFrame) -> DataFrame:
        """job_id, result, error of every claimed job. A kind without a handler, or a job that its handler leaves out, is an error of that job alone."""
        done = [run(claimed.filter(F.col("kind") == kind)).select("job_id", "result") for kind, run in self.by_kind.items()]
        known = F.col("kind").isin(list(self.by_kind))
        if not done:
            return claimed.select("job_id", F.lit(None).cast("string").alias("result"), F.lit("no handler").alias("error"))
        results = done[0]
        for more in done[1:]:
            results = results.unionByName(more)
        results = results.withColumn("__done", F.lit(True))
        error = F.when(~known, "no handler").when(F.col("__done").isNull(), "no result")
        return claimed.join(results, "job_id", "left").select("job_id", "result", error.alias("error"))
