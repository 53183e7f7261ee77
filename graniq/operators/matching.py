"""Similarity join: the k nearest records of another collection, by pairs of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block. A task holds one block of either side, and the similarities of PART left rows.
BLOCK, PART = 16_384, 512
_FOUND = "from_id long, to_id long, s double"


def _unit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows whose vector is neither null nor zero."""
    rows = [(i, v) for i, v in zip(table["id"].to_pylist(), table["vector"].to_pylist()) if v is not None and any(v)]
    v = np.array([v for _, v in rows], dtype=np.float64)
    return np.array([i for i, _ in rows], dtype=np.int64), v / np.linalg.norm(v, axis=1, keepdims=True) if rows else v


def nearest(left: DataFrame, right: DataFrame, k: int = 5, least: float = 0.0) -> DataFrame:
    """from_id, to_id, score (4 decimals), rnk: for each left row (id, vector) the k most similar right rows of at least ``least``.

    Both sides are cut into blocks by a hash of the id, and each pair of blocks meets in a task,
    which sends each left row's best k on: exact, and neither side passes through the driver.
    Null and zero vectors match nothing; ties go to the smaller to_id.
    """

    def top(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, own = _unit(a)
        others, theirs = _unit(b)
        out = []
        for at in range(0, len(ids) if len(others) else 0, PART):
            s = own[at : at + PART] @ theirs.T
            bound = np.partition(s, -k, axis=1)[:, -k] if len(others) > k else np.full(len(s), -2.0)
            row, column = np.nonzero((s >= bound[:, None]) & (s >= least))  # ties with the k-th included
            value, to = s[row, column], others[column]
            order = np.lexsort((to, -value, row))
            row, value, to = row[order], value[order], to[order]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            nth = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
            keep = nth < k
            out.append((ids[at + row[keep]], to[keep], value[keep]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], names=["from_id", "to_id", "s"])

    def blocks(side: DataFrame, n: int, of: int, own: str, other: str) -> DataFrame:
        rows = side.filter(F.col("vector").isNotNull()).select(F.col("id").cast("long").alias("id"), "vector")
        return rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long"))))

    n, m = (max(1, -(-side.count() // BLOCK)) for side in (left, right))
    pairs = blocks(left, n, m, "l", "r").groupBy("l", "r").cogroup(blocks(right, m, n, "r", "l").groupBy("l", "r"))
    rank = F.row_number().over(Window.partitionBy("from_id").orderBy(F.col("s").desc(), "to_id"))
    found = pairs.applyInArrow(top, _FOUND).withColumn("rnk", rank.cast("long"))
    return found.filter(F.col("rnk") <= k).select("from_id", "to_id", F.round("s", 4).alias("score"), "rnk")


def both_ways(left: DataFrame, right: DataFrame, k: int = 5, least: float = 0.0) -> DataFrame:
    """Links found from either side, each pair once with its score: from_id on the left."""
    one = nearest(left, right, k, least).select("from_id", "to_id", "score")
    two = nearest(right, left, k, least).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "score")
    return one.unionByName(two).groupBy("from_id", "to_id").agg(F.max("score").alias("score"))
