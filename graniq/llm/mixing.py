"""Mixing sources to target weights by entropy balancing.

Each document gets a rate (expected copies) min(cap, exp(lambda * size / mean size)), an
exponential tilt of one copy under the constraint that the source's expected words equal its
target: the solution nearest in relative entropy to one copy each, with rates of at most
``cap``. The dual is convex in a source's lambda; Newton steps, kept inside a bracket, solve
it. A step's sums run over the table of (source, size, number of documents), which has the
exact sums of all documents; it is a distributed aggregation, and the state of all sources is
a table as well, so neither documents nor sources pass through the driver.

Rates become copies by carrying the rounding error of a source from its largest sizes to its
smallest: of the documents of one source and size, which share a rate, as many get the extra
copy as bring the words so far nearest to their expectation; so a source's words end within
about its smallest documents of the target. Which documents get it follows from a hash of
doc_id and text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniq.llm.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Parts into which the documents of one source and size are dealt to be ranked.
SALTS = 256


def targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """Per source: source_size, target. sizes: source, size.

    Sources in code point order, null last, take the weights in turn and share ``share``
    times all words by weight. Targets stop at cap times the source's size; the excess goes
    to the others by weight, until none is above: a capped source stays capped, as what is left for
    the free ones per weight only grows. Each step is an aggregation over the table of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    n, spark = len(weights), sizes.sparkSession
    # Numbers in order: within ranges of sources, after the numbers of sources in the ranges before.
    ranges = per.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("source").isNull(), F.col("source"))
    ranges = materialize(ranges.withColumn("part", F.spark_partition_id()), "mix-sources")
    before, sums = 0, {}
    for r in ranges.groupBy("part").count().orderBy("part").collect():  # a row for each range
        sums[r["part"]] = before
        before += r["count"]
    first = F.create_map(*[F.lit(x) for kv in sums.items() for x in kv])[F.col("part")] if sums else F.lit(0)
    number = first + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % n + 1).cast("int"))
    per = materialize(ranges.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")), "mix-sources")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        full = F.col("most") <= F.col("weight") * level
        r = per.agg(F.count_if(full).alias("capped"), F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("filled"), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("heavy")).first()
        if r["capped"] == capped or not r["heavy"]:
            break
        capped, level = r["capped"], max(level, (total - r["filled"]) / r["heavy"])
    return per.select("source", "source_size", F.when(F.lit(not r["heavy"]), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * level)).alias("target"))


def solve(cells: DataFrame, goals: DataFrame, cap: float, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Per source: lam (null: every document has cap copies) and mean, the unit of sizes.

    cells: source, size, n. goals: source, source_size, target. Sources are matched null-safe.
    """
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goals.join(mean, goals["source"].eqNullSafe(mean["source"]), "left").select(
        goals["source"], "source_size", "target", F.greatest(F.coalesce("mean", F.lit(1.0)), F.lit(1e-9)).alias("mean"), full.alias("full"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), (full | (F.col("source_size") == 0)).alias("done"),
    )
    state = materialize(state, "mix-state")
    for _ in range(steps):
        open_ = state.filter(~F.col("done"))
        if open_.isEmpty():
            break
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        words = F.col("size") * F.col("n")
        sums = (
            cells.join(open_.select(F.col("source").alias("of"), "lam", "mean"), F.col("source").eqNullSafe(F.col("of")))
            .groupBy("of")
            .agg(F.sum(words * F.least(tilt, F.lit(float(cap)))).alias("got"), F.sum(F.when(tilt < cap, words * tilt * x).otherwise(0.0)).alias("slope"))
        )
        s = state.join(sums, state["source"].eqNullSafe(sums["of"]), "left")
        gap = F.col("got") - F.col("target")
        near = F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        # Outside the bracket, or with no slope, halve it; with one side open, go out.
        inside = (low.isNull() | (newton > low)) & (high.isNull() | (newton < high)) & (F.abs(newton - F.col("lam")) < 8)
        other = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(gap < 0, F.col("lam") * 2 + 1).otherwise(F.col("lam") * 2 - 1)
        lam = F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(other)
        same = F.col("done") | near
        state = materialize(
            s.select("source", "source_size", "target", "mean", "full", F.when(same, F.col("lam")).otherwise(lam).alias("lam"), F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"), F.coalesce(same, F.lit(True)).alias("done")),
            "mix-state",
        )
    return state.select("source", "source_size", "target", "mean", F.when(~F.col("full"), F.col("lam")).alias("lam"))


def _round(cells: pd.DataFrame) -> pd.DataFrame:
    """Extra copies per size of one source, the error carried from large to small sizes."""
    cells = cells.sort_values("size", ascending=False)
    carry, extra = 0.0, []
    for size, n, rate, whole in zip(cells["size"], cells["n"], cells["rate"], cells["whole"]):
        want = n * (rate - whole) * size + carry
        got = min(max(round(want / size), 0), n) if size and rate > whole else 0
        carry = want - got * size
        extra.append(got)
    return cells.assign(extra=pd.array(extra, dtype="int64"))


def mix(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, size: Column | None = None) -> DataFrame:
    """Copies of each document: doc_id, source, size, source_size, target, rate, key, copies.

    docs: doc_id, text, source. Size is the number of words (null text: 0) unless given.
    A null source is a source, the last one. Documents without words keep one copy, as no
    constraint touches them. Repeated rows are documents of their own; which of fully equal
    rows gets an extra copy makes no difference. An empty table gives no row. Reruns agree.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long") if size is None else size
    key = F.xxhash64("doc_id", "text")
    base = materialize(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(SALTS)).alias("salt")), "mix-sizes")
    parts = base.groupBy("source", "size", "salt").count()
    cells = materialize(parts.groupBy("source", "size").agg(F.sum("count").alias("n")), "mix-cells")
    goals = targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), list(weights), share, cap)
    rates = solve(cells, goals, cap)

    lam = rates.withColumnRenamed("source", "of")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(cap)).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(cap))))
    c = cells.join(lam, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    c = c.select("source", "size", "n", "source_size", "target", "rate", F.floor("rate").alias("whole"))
    # A source's distinct sizes: at most as many as its longest document has words.
    c = c.groupBy("source").applyInPandas(_round, "source string, size long, n long, source_size long, target double, rate double, whole long, extra long")
    c = c.withColumnsRenamed({"source": "s", "size": "z"})
    c = materialize(c, "mix-rates")

    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    rows = base.join(c, on).drop("s", "z")
    out = ["doc_id", "source", "size", "source_size", "target", "rate"]
    ranked = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    plain = rows.filter(~ranked).select(*out, "key", (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("copies"))
    # Where some but not all of a cell's documents get the extra copy, they are ranked salt by salt.
    salts = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.join(c.filter(ranked), on).select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("t"), F.coalesce(F.sum("count").over(salts), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("key", "doc_id"))
    split = rows.filter(ranked).join(before, on & (F.col("salt") == F.col("t"))).withColumn("rank", rank)
    chosen = split.select(*out, "key", (F.col("whole") + F.when(F.col("before") + F.col("rank") <= F.col("extra"), 1).otherwise(0)).alias("copies"))
    return plain.unionByName(chosen)


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Rows of equal doc_id, source and text share their copies, those with the least numbers
    first; only such rows are numbered. A row without copies is left out.
    """
    key = ["doc_id", "source", "key"]
    taken = mix(docs, **how).groupBy(*key).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    t = materialize(taken.withColumnsRenamed({"doc_id": "__d", "source": "__s", "key": "__k"}), "mix-copies")
    own = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__key") == F.col("__k"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = own.join(t.filter("__rows = 1 AND __copies > 0"), same).select(*columns, "__copies")
    equal = own.join(t.filter("__rows > 1 AND __copies > 0"), same)
    number = F.row_number().over(Window.partitionBy("doc_id", "source", "__key").orderBy(F.lit(0)))
    each = F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__nth") <= F.col("__copies") % F.col("__rows")).cast("long")
    many = equal.withColumn("__nth", number).select(*columns, each.alias("__copies")).filter("__copies > 0")
    return one.unionByName(many).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*columns)
