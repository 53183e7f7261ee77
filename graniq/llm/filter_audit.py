"""How filters interact: every order of them, evaluated from one aggregation.

A row fails some of n filters, which is a mask of n bits. Per part and label the rows are
aggregated to the 2^n signed parity sums of their masks (a Walsh-Hadamard transform: for each
set of filters, rows with an even number of failures in it less those with an odd one). The
transform is its own inverse but for the factor 2^n, so the number of rows of each mask comes
back exactly. Whatever an order of filters does follows from these cells alone: a filter removes
at its step the rows that fail it and none before it. Over all orders, a row that fails k
filters is removed by each of them in n!/k of the orders, which gives Shapley values in closed
form.

One row a part and label leaves each task, so hot parts cost nothing; the result has n! * n rows
a part.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniq.llm.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
_COUNTS = ["all", "good", "toxic"]


def mask_of(failures: list[Column]) -> Column:
    """Bit i is set where failure i is true; null is no failure."""
    return reduce(lambda a, b: a + b, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)])


def _sign(mask: Column, k: Column) -> Column:
    """1 or -1: the parity of the bits of the mask that are in k."""
    return (F.lit(1) - 2 * (F.bit_count(mask.bitwiseAND(k)) % 2)).cast("long")


def _masks(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit((1 << n) - 1))


def _total(masks: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(masks, F.lit(0).cast("long"), lambda s, x: s + of(x))


def parity_sums(rows: DataFrame, n: int) -> DataFrame:
    """part, good, toxic, sums: the 2^n signed parity sums of the rows (part, good, toxic, mask) of each part and label."""
    sums = [F.sum(_sign(F.col("mask"), F.lit(k))) for k in range(1 << n)]
    return rows.groupBy("part", "good", "toxic").agg(F.array(*sums).alias("sums"))


def cells(sums: DataFrame, n: int) -> DataFrame:
    """part and the arrays in_all, in_good, in_toxic: the number of rows of each mask, by the inverse transform."""
    count = lambda m: F.shiftright(_total(_masks(n), lambda k: F.element_at("sums", k + 1) * _sign(m, k)), n)
    labels = sums.select("part", "good", "toxic", F.transform(_masks(n), count).alias("cells")).groupBy("part").agg(F.collect_list(F.struct("good", "toxic", "cells")).alias("labels"))  # four at most
    of = lambda r, label: F.lit(True) if label == "all" else r[label]
    one = lambda label: F.transform(_masks(n), lambda m: _total(F.col("labels"), lambda r: F.when(of(r, label), F.element_at(r["cells"], m + 1)).otherwise(0)))
    return labels.select("part", *[one(label).alias(f"in_{label}") for label in _COUNTS])


def audit(cells_: DataFrame, filters: list[str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order of the filters."""
    n, spark = len(filters), cells_.sparkSession
    orders = math.factorial(n)
    # A filter and the set of those before it, whatever their order among themselves: n * 2^(n-1) turns a part.
    turns = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(before).alias("before")) for f in range(n) for before in range(1 << n) if not before >> f & 1])
    turn = cells_.select("*", F.explode(turns).alias("t")).select("part", *[f"in_{label}" for label in _COUNTS], "t.*")
    shares = F.array(*[F.lit(orders // max(1, m.bit_count())) for m in range(1 << n)])

    def total(label: str, of: Callable[[Column], Column], weight: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
        cell = lambda m: F.when(of(m), F.element_at(f"in_{label}", m + 1) * weight(m)).otherwise(F.lit(0).cast("long"))
        return _total(_masks(n), cell)

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    reached = lambda m: m.bitwiseAND(F.col("before")) == 0
    removed = lambda m: fails(m) & reached(m)
    seen = turn.select(
        "part", "f", "before", total("all", lambda m: ~fails(m) & reached(m)).alias("kept"), total("all", removed).alias("removed"), total("all", lambda m: fails(m) & ~reached(m)).alias("redundant"),
        F.element_at("in_all", F.col("bit") + 1).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), total("all", fails, lambda m: F.element_at(shares, m + 1)).alias("shapley"),
    )
    steps = [("".join(filters[i] for i in order), at + 1, f, sum(1 << i for i in order[:at])) for order in permutations(range(n)) for at, f in enumerate(order)]
    plan = spark.createDataFrame(steps, "filter_order string, step int, f int, before int")  # n! * n rows, whatever the input
    met = seen.join(F.broadcast(plan), ["f", "before"])
    return met.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(rows: DataFrame, filters: list[str], max_filters: int = 6) -> DataFrame:
    """The audit of rows (part, good, toxic, mask): see ``audit``. Null labels are false, a null part is its own."""
    if not 0 < len(filters) <= max_filters:
        raise ValueError(f"1 to {max_filters} filters")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    sums = materialize(parity_sums(rows.select("part", *flags, "mask"), len(filters)), "audit-sums")
    return audit(cells(sums, len(filters)), filters)


def text_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of documents: A few words, B few different ones, C many capitals, D marks, E copies of a text with a smaller doc_id.

    Null texts are empty, null sources the part "". A null doc_id is no smaller than any, nor any
    smaller than it. Equal texts meet by their SHA-256; of a text in a third of all rows, a
    task sends one row on to find its smallest doc_id, and the join with it is one that Spark splits.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    held = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.array(words).alias("words"))
    # The words are an array's only element, so that they are made once for what counts and compares them.
    shape = F.element_at(F.transform("words", lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("kinds"))), 1)
    capitals = F.length(F.col("text")) - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    marks = F.rlike(F.col("text"), F.lit(r"[#$%&*|]"))
    counted = held.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), shape.alias("w"), (capitals * F.lit(100).cast("long")).alias("capitals"), F.length("text").alias("chars"), marks.alias("marks"))
    own = mask_of([F.col("w.n") < 200, 100 * F.col("w.kinds") < 50 * F.col("w.n"), F.col("capitals") > 2 * F.col("chars"), F.col("marks")])
    rows = materialize(counted.select("doc_id", "part", "digest", own.alias("mask")), "audit-rows")
    first = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "audit-copies")
    copied = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    return rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + copied).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good (quality 1) and toxic (toxic 1) of their doc_id; several labels of one id count together."""
    per = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    return rows.join(materialize(per.filter("doc_id IS NOT NULL"), "audit-labels"), "doc_id", "left")
