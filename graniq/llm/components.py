"""Connected components of an edge table.

Few edges are joined in one task of a bounded size; more by minimum labels and pointer jumping
over tables. Both give the same labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniq.llm.storage import forget, materialize

#: Edges, at 16 bytes, that one task takes.
LOCAL = 1_000_000


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the least vertex that each is connected with."""
    vertices, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(vertices))
    while True:
        p, q = root[x], root[y]
        open_ = p != q
        if not open_.any():
            return vertices, vertices[root]
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if parts:
            v, label = labels_of(*(np.concatenate(c) for c in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(label)], names=["v", "label"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "v long, label long")


def connect(edges: DataFrame) -> DataFrame:
    """Per vertex of edges(a, b): v, label, the least vertex that it is connected with.

    Of more than LOCAL edges, a step gives each vertex the least label of its neighbours and then
    that label's own label, which halves the way; states are tables in the shared folder. Vertices
    with many edges are aggregated before the shuffle, and their join is a skewed equi-join.
    """
    once = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    if once.count() <= LOCAL:
        return materialize(_in_one_task(once), "cc-state")
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), "cc-state")
    while True:
        near = both.join(state.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        stepped = state.join(near, "v").select("v", "label", F.least("label", "near").alias("to"))
        jump = state.select(F.col("v").alias("to"), F.col("label").alias("far"))
        new = materialize(stepped.join(jump, "to").select("v", F.least("to", "far").alias("label"), (F.least("to", "far") != F.col("label")).alias("moved")), "cc-state")
        forget(state)
        state = new.select("v", "label")
        if new.filter("moved").isEmpty():
            return state
