"""A stored vector index: cells around centroids, and short codes of what is left.

Vectors go to the nearest of ``cells`` centroids; the rest of each is cut into ``parts``, each
replaced by the number of the nearest of 256 code vectors. Centroids and code vectors are fitted by
Lloyd's steps, each of them a pass over a sample table in Spark: a task adds up the members of each
centroid in its share, and sums meet by centroid. The sample is the SAMPLE rows at most with the
least hash of their id, a documented bound of what the fit sees; every row is indexed. What the
driver holds are centroids and code vectors, bounded by the parameters.

How many cells a search must probe depends on the data, so it is measured: for ASKED vectors of the
sample, the true nearest among all rows and the cells that hold them give the least number of
cells that finds TARGET of these.

A search takes many queries at once. Approximate: the nearest cells of a query are
scored by their codes, which are read without the vectors, and the best candidates are ranked
exactly by their vectors. Exact: a cell's least cosine to its centroid bounds what it can hold, so
after the nearest cells only those are read whose bound reaches the k-th best score so far.
Cells are dealt in blocks of BLOCK vectors, and a query meets only the blocks of its cells.

Null and zero vectors are not indexed, and match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graniq.functions import vectors as V
from graniq.sources import store

SAMPLE, BLOCK, CODES, STEPS = 65_536, 16_384, 256, 5
ASKED, NEAREST, TARGET = 64, 24, 0.95


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls and of one length as a matrix, from its flat values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(rows.reshape(-1)))


def closest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row."""
    return np.argmin((centroids**2).sum(1)[None, :] - 2 * rows @ centroids.T, axis=1) if len(rows) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Codes:
    """Centroids (cells x dim) and code vectors (parts x codes x dim / parts)."""

    centroids: np.ndarray
    books: np.ndarray

    def split(self, rest: np.ndarray) -> list[np.ndarray]:
        return np.split(rest, len(self.books), axis=1)

    def encode(self, rest: np.ndarray) -> np.ndarray:
        return np.stack([closest(part, book) for part, book in zip(self.split(rest), self.books)], axis=1).astype(np.uint8)

    def products(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Products of queries with what codes stand for."""
        out = np.zeros((len(queries), len(codes)))
        for p, (part, book) in enumerate(zip(self.split(queries), self.books)):
            out += (part @ book.T)[:, codes[:, p]]
        return out


def unit(vectors: DataFrame) -> DataFrame:
    """The rows (id, vector, ...) whose vector is neither null nor zero, with doubles of unit length."""
    rows = vectors.filter("vector IS NOT NULL").withColumns({"id": F.col("id").cast("long"), "vector": V.doubles(F.col("vector"))}).withColumn("__n", V.norm(F.col("vector"))).filter("__n > 0")
    return rows.withColumn("vector", F.transform("vector", lambda x: x / F.col("__n"))).drop("__n")


def _lloyd(rows: DataFrame, start: list[np.ndarray], of, steps: int) -> list[np.ndarray]:
    """Lloyd's steps for several sets of centroids at once: ``of`` cuts a matrix of rows into a matrix for each set. A centroid without members stays."""
    sets = start

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(c)) for c in sets]
        total = [np.zeros_like(c) for c in sets]
        for batch in batches:
            for i, part in enumerate(of(matrix(batch.column("vector"))) if batch.num_rows else []):
                own = closest(part, sets[i])
                n[i] += np.bincount(own, minlength=len(sets[i]))
                np.add.at(total[i], own, part)
        for i, c in enumerate(sets):
            at = np.flatnonzero(n[i])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(n[i][at]), lists(total[i][at])], names=["i", "c", "n", "total"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts)
            key = t.column("i").to_numpy() * (1 << 32) + t.column("c").to_numpy()
            keys, at = np.unique(key, return_inverse=True)
            rows_, width = matrix(t.column("total")), len(t.column("total")[0])
            total, n = np.zeros((len(keys), width)), np.zeros(len(keys))
            np.add.at(total, at, rows_)
            np.add.at(n, at, t.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), lists(total / n[:, None])], names=["i", "c", "mean"])

    for _ in range(steps):
        sums = rows.mapInArrow(summed, "i long, c long, n double, total array<double>")
        found = sums.repartition("i", "c").mapInArrow(met, "i long, c long, mean array<double>").collect()  # a row for each centroid
        sets = [c.copy() for c in sets]
        for r in found:
            sets[r["i"]][r["c"]] = r["mean"]
    return sets


@dataclass(frozen=True)
class CellIndex:
    """rows: cell, block, id, code, vector and what else was indexed, by cell; cells: cell, n, blocks, least (the smallest cosine of a member to the centroid)."""

    spark: SparkSession
    folder: str
    codes: Codes
    probes: int
    opened: dict = field(default_factory=dict, compare=False)

    def _table(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.folder}/{name}")
        return self.opened[name]

    def rows(self) -> DataFrame:
        return self._table("rows")

    def cells(self) -> DataFrame:
        return self._table("cells")

    def known(self) -> list:
        """The rows of cells, in order; at most 4,096."""
        if "known" not in self.opened:
            self.opened["known"] = self.cells().orderBy("cell").collect()
        return self.opened["known"]


def build(vectors: DataFrame, folder: str | None = None, cells: int | None = None, parts: int = 16) -> CellIndex:
    """Index vectors (id, vector, and columns that a scope may ask for) of one length. Ids are distinct. Without a number of cells there are about as many as the square root of the rows, 4,096 at most."""
    spark = vectors.sparkSession
    folder = folder or store.folder(spark, "cells")
    every = store.written(unit(vectors), f"{folder}/unit")
    total = every.count()
    sample = store.written(every.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE), f"{folder}/sample") if total > SAMPLE else every.select("id", "vector")
    cells = max(1, min(cells or int(total**0.5), 4096, total))
    first = sample.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(max(cells, CODES)).toArrow()
    seeds = matrix(first.column("vector"))
    if not len(seeds):
        seeds = np.zeros((1, parts))
    dim = seeds.shape[1]
    parts = next(p for p in range(min(parts, dim), 0, -1) if dim % p == 0)
    centroids = _lloyd(sample, [seeds[:cells]], lambda m: [m], STEPS)[0]
    rest = seeds[:CODES] - centroids[closest(seeds[:CODES], centroids)]
    books = _lloyd(sample, np.split(rest, parts, axis=1), lambda m: np.split(m - centroids[closest(m, centroids)], parts, axis=1), STEPS)
    codes = Codes(centroids, np.stack(books))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column("vector"))
                cell = closest(m, codes.centroids)
                own = codes.centroids[cell]
                length = np.linalg.norm(own, axis=1)
                near = (m * own).sum(1) / np.where(length > 0, length, 1)
                code = [c.tobytes() for c in codes.encode(m - own)]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(code, pa.binary()), pa.array(near), *batch.columns], names=["cell", "code", "near", *batch.schema.names])

    kinds = ", ".join(f"`{c}` {t}" for c, t in every.dtypes)
    placed = store.written(every.mapInArrow(encode, f"cell long, code binary, near double, {kinds}"), f"{folder}/placed")
    per = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"))
    index = CellIndex(spark, folder, codes, _probes(placed, codes.centroids, seeds[:ASKED]))
    index.opened["cells"] = sizes = store.written(per.withColumn("blocks", F.ceil(F.col("n") / BLOCK)), f"{folder}/cells")
    dealt = placed.join(F.broadcast(sizes.select("cell", "blocks")), "cell")  # a row for each of 4,096 cells at most
    rows = dealt.select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "code", *every.columns)
    index.opened["rows"] = store.written(rows.repartitionByRange("cell", "block", "id").sortWithinPartitions("cell", "id"), f"{folder}/rows", "cell")
    return index


def _probes(placed: DataFrame, centroids: np.ndarray, asked: np.ndarray) -> int:
    """The least number of cells that holds TARGET of the NEAREST true neighbours of the vectors asked."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = asked @ matrix(batch.column("vector")).T
                row, at = np.nonzero(score >= np.partition(score, -min(NEAREST, score.shape[1]), axis=1)[:, [-min(NEAREST, score.shape[1])]])
                yield pa.RecordBatch.from_arrays([pa.array(row), batch.column("id").take(pa.array(at)), pa.array(score[row, at]), batch.column("cell").take(pa.array(at))], names=["query_id", "id", "score", "cell"])

    found = _ranked(placed.select("id", "cell", "vector").mapInArrow(near, "query_id long, id long, score double, cell long"), NEAREST).select("query_id", "cell").collect()  # ASKED x NEAREST rows
    order = np.argsort((centroids**2).sum(1)[None, :] - 2 * asked @ centroids.T, axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.sort([place[r["query_id"], r["cell"]] + 1 for r in found])
    return int(needed[int(np.ceil(TARGET * len(needed))) - 1]) if len(needed) else 1


def _probed(index: CellIndex, queries: DataFrame, probes: int | None, least: Column | None = None) -> DataFrame:
    """query_id, vector, cell, block, bound: a row for each block of the cells of a query: the nearest, or all with their bounds."""
    known = {r["cell"]: (r["least"], r["blocks"]) for r in index.known()}
    ids = np.array(sorted(known), dtype=np.int64)
    if not len(ids):
        return index.spark.createDataFrame([], "query_id long, vector array<double>, cell long, block long, bound double")
    centroids = index.codes.centroids[ids]
    length = np.linalg.norm(centroids, axis=1, keepdims=True)
    centres = centroids / np.where(length > 0, length, 1)
    angle = np.arccos(np.clip([known[c][0] for c in ids], -1, 1))
    blocks = np.array([known[c][1] for c in ids])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column("vector"))
            distance = (centroids**2).sum(1)[None, :] - 2 * q @ centroids.T
            # Two vectors' angle is at least the difference of their angles to a third.
            bound = np.cos(np.maximum(0, np.arccos(np.clip(q @ centres.T, -1, 1)) - angle[None, :]))
            order = np.argsort(distance, axis=1, kind="stable")[:, : probes or len(ids)]
            row = np.repeat(np.arange(len(q)), order.shape[1])
            cell = order.reshape(-1)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("vector").take(pa.array(row)), pa.array(ids[cell]), pa.array(blocks[cell]), pa.array(bound[row, cell])], names=["query_id", "vector", "cell", "blocks", "bound"])

    found = queries.mapInArrow(near, "query_id long, vector array<double>, cell long, blocks long, bound double")
    return found.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")


def nearest_to(index: CellIndex, vector: list[float], n: int = 24, scope: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> list[tuple[int, float]]:
    """The n nearest (id, cosine) of one vector, exactly: the cells of the highest bounds that hold n rows, then those whose bound reaches the n-th score. ``scope`` filters the index's rows."""
    own = np.asarray(vector, dtype=np.float64)
    length = float(np.linalg.norm(own))
    known = index.known()
    if not length or not known or n <= 0:
        return []
    own = own / length
    centres = index.codes.centroids[[r["cell"] for r in known]]
    lengths = np.linalg.norm(centres, axis=1)
    between = np.arccos(np.clip(centres @ own / np.where(lengths > 0, lengths, 1), -1, 1)) - np.arccos(np.clip([r["least"] for r in known], -1, 1))
    bounds = np.cos(np.clip(between, 0, np.pi))
    order = np.argsort(-bounds, kind="stable")
    held = np.cumsum([known[i]["n"] for i in order])
    first = order[: int(np.searchsorted(held, n)) + 1]
    score = V.dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in own]))

    def best(cells: list[int]) -> list[tuple[int, float]]:
        rows = scope(index.rows().filter(F.col("cell").isin(cells))).select("id", score.alias("score"))
        return [(r["id"], r["score"]) for r in rows.orderBy(F.col("score").desc(), "id").limit(n).collect()]

    found = best([known[i]["cell"] for i in first])
    floor = found[-1][1] if len(found) == n else -2.0
    more = [known[i]["cell"] for i in order[len(first) :] if bounds[i] >= floor - 1e-9]
    return sorted(found + (best(more) if more else []), key=lambda x: (-x[1], x[0]))[:n]


def _best(n: int):
    """For a block of queries and one of rows: each query's n best rows and those that tie with the n-th."""

    def pick(score: np.ndarray, queries: np.ndarray, ids: np.ndarray, least: np.ndarray | float) -> pa.Table:
        at = np.partition(score, -n, axis=1)[:, -n] if score.shape[1] > n else np.full(len(score), -np.inf)
        row, column = np.nonzero(score >= np.maximum(at, least)[:, None])
        return pa.table([pa.array(queries[row]), pa.array(ids[column]), pa.array(score[row, column])], names=["query_id", "id", "score"])

    return pick


_FOUND = "query_id long, id long, score double"


def _ranked(found: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rnk", (rank - 1).cast("long")).filter(F.col("rnk") < n)


def _scored(pairs: DataFrame, rows: DataFrame, n: int, score) -> DataFrame:
    """query_id, id, score: the best n of each block for each query that asks it. ``score`` gives the products of a block."""
    pick = _best(n)

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "id", "score"])
        return pick(score(q, r), q.column("query_id").to_numpy(), r.column("id").to_numpy(), -np.inf)

    return pairs.groupBy("cell", "block").cogroup(rows.groupBy("cell", "block")).applyInArrow(run, _FOUND)


def nearest(index: CellIndex, queries: DataFrame, n: int = 24, probes: int | None = None, exact: bool = False, candidates: int = 8) -> DataFrame:
    """query_id, id, score (cosine), rnk (from 0): the n nearest rows of each query (id, vector); ties go to the smaller id.

    Approximate: from the ``probes`` nearest cells (as many as the index has measured, without a number), by codes, the best ``candidates`` times n are
    ranked by their vectors. Exact: the same result as comparing with all rows.
    """
    asked = store.written(unit(queries), store.folder(index.spark, "asked"))
    # Plain names: the functions below travel to tasks, where the session is not.
    codes = index.codes
    def whole(q: pa.Table, r: pa.Table) -> np.ndarray:
        return matrix(q.column("vector")) @ matrix(r.column("vector")).T

    def by_code(q: pa.Table, r: pa.Table) -> np.ndarray:
        m, cell = matrix(q.column("vector")), r.column("cell")[0].as_py()
        held = np.frombuffer(b"".join(r.column("code").to_pylist()), dtype=np.uint8).reshape(r.num_rows, -1)
        return (m @ codes.centroids[cell])[:, None] + codes.products(m, held)

    if not exact:
        pairs = _probed(index, asked, probes or index.probes)
        rough = _ranked(_scored(pairs, index.rows().select("cell", "block", "id", "code"), candidates * n, by_code), candidates * n).select("query_id", "id")
        met = rough.join(index.rows().select("id", "vector"), "id").join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("asked")), "query_id")
        return _ranked(met.select("query_id", "id", V.dot(F.col("vector"), F.col("asked")).alias("score")), n)
    every = store.written(_probed(index, asked, None), store.folder(index.spark, "probes"))
    rows = index.rows().select("cell", "block", "id", "vector")
    near = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "cell"))
    held = index.cells().select("cell", "n")
    # The cells of the highest bounds that hold n rows together.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = every.select("query_id", "cell", "bound").distinct().join(F.broadcast(held), "cell").withColumns({"place": near, "before": before})
    cells = store.written(cells.select("query_id", "cell", "bound", (F.col("before") < n).alias("first")), store.folder(index.spark, "order"))
    begun = store.written(_ranked(_scored(every.join(cells.filter("first").select("query_id", "cell"), ["query_id", "cell"], "left_semi"), rows, n, whole), n), store.folder(index.spark, "begun"))
    floor = begun.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("got"))
    more = cells.filter("NOT first").join(floor, "query_id", "left").filter((F.coalesce("got", F.lit(0)) < n) | (F.col("bound") >= F.col("floor") - 1e-9)).select("query_id", "cell")
    rest = _scored(every.join(more, ["query_id", "cell"], "left_semi"), rows, n, whole)
    return _ranked(begun.select("query_id", "id", "score").unionByName(rest), n)
