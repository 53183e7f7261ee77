"""A Merkle manifest of a dataset: groups of rows as trees, their roots as the leaves of one more.

Nodes of a group are numbered in order; every ``fanout`` consecutive ones are a run, whose
digests, in order, are hashed to a node of the next level, until one is left. A level is a
written table of runs, grouped by group and number div fanout, so each holds ``fanout`` digests
at most and no group of rows meets in one task: numbers come from ranges of rows in order, plus
the count of those before.

Then, from the top down, each level's runs are joined with the level above, an eighth as
many rows, and append the siblings of their own node to the path of the one above; the leaves get
theirs from their run. A path is an array of what stands left and right of the node on each level,
so a leaf folds up to the root by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniq.llm.storage import materialize

_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A field so that no two records read the same: - for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a record."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings of its path."""
    return F.aggregate(path, digest, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (grp, ...) with n (rows of the group) and idx, from 0 in the order within the group.

    Rows are ranged and sorted by group and order, and numbered within their range as they are
    written; the counts of the ranges, a row for each range and group in it, give the rest. Rows equal in all
    of this stand in any order and are dealt over ranges by a random number.
    """
    at = rows.withColumn("__salt", F.rand(7)).repartitionByRange("grp", *order, "__salt").sortWithinPartitions("grp", *order)
    at = materialize(at.drop("__salt").withColumn("__at", F.monotonically_increasing_id()), "merkle-rows").withColumn("__range", F.shiftright("__at", 33))
    ranges = at.groupBy("grp", "__range").agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("grp").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("grp", "__range", (before - F.col("__from")).alias("__shift"), F.sum("__n").over(Window.partitionBy("grp")).alias("n"))
    met = at.join(materialize(ranges, "merkle-ranges"), ["grp", "__range"])
    return met.withColumn("idx", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")


def _runs(nodes: DataFrame, fanout: int, more: list[str]) -> DataFrame:
    """grp, run, n (nodes left above), nodes (in order: idx, digest and more), digest of the run. A lone node stays itself."""
    met = nodes.groupBy("grp", F.floor(F.col("idx") / fanout).alias("run")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest", *more))).alias("nodes"))
    whole = F.array_join(F.transform("nodes", lambda x: x["digest"]), "")
    digest = F.when(F.col("n") > 1, F.sha2(whole, 256)).otherwise(whole)
    return materialize(met.select("grp", "run", F.ceil(F.col("n") / fanout).alias("n"), (F.col("n") == 1).alias("lone"), "nodes", digest.alias("digest")), "merkle-runs")


def _step(nodes: Column, nth: Column) -> Column:
    """What stands left and right of a run's nth node (from 0)."""
    side = lambda part: F.array_join(F.transform(part, lambda x: x["digest"]), "")
    return F.struct(side(F.slice(nodes, 1, nth.cast("int"))).alias("left"), side(F.slice(nodes, nth.cast("int") + 2, F.size(nodes))).alias("right"))


class Tree:
    """The trees of all groups of leaves (grp, digest, in the order of the columns ``order``, which with the digest tell a group's leaves apart as far as it matters)."""

    def __init__(self, leaves: DataFrame, order: list[str], fanout: int = 8):
        self.order, self.fanout = order, fanout
        self.more = [c for c in leaves.columns if c not in ("grp", "digest")]
        nodes = numbered(leaves, [*order, "digest"])
        self.levels = [_runs(nodes, fanout, self.more)]
        left = self.levels[0].agg(F.max("n")).first()[0] or 0
        while left > 1:
            level = self.levels[-1].filter("n > 1").select("grp", F.col("run").alias("idx"), "n", "digest")
            self.levels.append(_runs(level, fanout, []))
            left = -(-left // fanout)

    def roots(self) -> DataFrame:
        """grp, digest of each group's root."""
        tops = [runs.filter("n = 1").select("grp", "digest") for runs in self.levels]
        out = tops[0]
        for more in tops[1:]:
            out = out.unionByName(more)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """The leaves with their path: grp, digest, order, more columns, path, and the columns of ``above``.

        above: grp, path (from the group's root on) and further columns, a row for each group.
        """
        extra = [c for c in above.columns if c not in ("grp", "path")]
        known = None  # grp, run, nodes, path and extra of the runs of the level above
        for runs in reversed(self.levels):
            last = runs.filter("n = 1").join(above, "grp").select("grp", "run", "lone", "nodes", "path", *extra)
            if known is not None:
                up = known.select("grp", F.col("run").alias("__up"), F.col("nodes").alias("__nodes"), "path", *extra)
                own = runs.filter("n > 1").withColumn("__up", F.floor(F.col("run") / self.fanout)).join(up, ["grp", "__up"])
                step = _step(F.col("__nodes"), F.col("run") % self.fanout)
                last = last.unionByName(own.select("grp", "run", "lone", "nodes", F.concat(F.array(step), "path").alias("path"), *extra))
            known = last
        each = known.select("grp", "lone", "nodes", "path", *extra, F.posexplode("nodes").alias("__nth", "__leaf"))
        path = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(_step(F.col("nodes"), F.col("__nth"))), F.col("path")))
        return each.select("grp", F.col("__leaf.digest").alias("digest"), *[F.col(f"__leaf.{c}").alias(c) for c in self.more], path.alias("path"), *extra)


def merkle_manifest(docs: DataFrame, group: str, order: str, values: list[str], claimed: dict[str, Column] | None = None, fanout: int = 8) -> DataFrame:
    """Per row: group, order, leaf, subroot, root, path, and for each of ``claimed`` the digest of the row with values exchanged.

    values: the columns of a leaf. claimed: names and digests of other leaves in the rows' place, say
    of a second copy of the data, that are to be held against the root; null where it is the row's own.
    Groups and orders may be null, which come first; rows of a group with the same order stand by
    their leaf. An empty table has no rows and no root. Other columns play no part.
    """
    own = leaf(*[F.col(f"`{c}`") for c in values])
    others = [digest.alias(name) for name, digest in (claimed or {}).items()]
    # A null group comes before the others, whose names keep their order as UTF-8 bytes.
    grp = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = docs.select(grp.alias("grp"), F.col(f"`{order}`").alias("__order"), own.alias("digest"), *others)
    tree = Tree(leaves, ["__order"], fanout)
    roots = materialize(tree.roots().select(F.lit(0).alias("grp"), "digest", F.col("grp").alias("__name")), "merkle-roots")
    crown = Tree(roots, ["__name"], fanout)
    top = crown.roots().select("grp", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    above = materialize(crown.paths(top).select(F.col("__name").alias("grp"), F.col("digest").alias("subroot"), "root", "path"), "merkle-crown")
    name = F.when(F.col("grp") != "", F.substr("grp", F.lit(2)))
    return tree.paths(above).select(name.alias(group), F.col("__order").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "path", *[F.coalesce(c, "digest").alias(c) for c in claimed or {}])
