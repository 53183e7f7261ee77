"""Reading a corpus: listings, outlines, pages of chunks, and edits of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniq.functions import text as T

MAX_DEPTH = 12


def slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.translate(path, "/", ""))


def with_folders(nodes: DataFrame) -> DataFrame:
    """The file nodes and a row for each folder of their paths (kind, name, path, size and files below)."""
    files = nodes.select("repository", F.lit("file").alias("kind"), "name", "path", F.col("size_bytes").cast("long").alias("size_bytes"), F.lit(1).cast("long").alias("n_files"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = nodes.select("repository", "size_bytes", F.explode(F.when(F.size(parts) > 2, above).otherwise(F.array().cast("array<string>"))).alias("path"))
    folders = folders.groupBy("repository", "path").agg(F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("n_files"))
    return files.unionByName(folders.select("repository", F.lit("folder").alias("kind"), F.substring_index("path", "/", -1).alias("name"), "path", "size_bytes", "n_files"))


def children(nodes: DataFrame, prefix: str = "", limit: int = 200) -> DataFrame:
    """What is directly below a path: folders first, then by name."""
    prefix = prefix.rstrip("/")
    below = nodes.filter(F.col("path").startswith(prefix + "/") & (slashes(F.col("path")) == prefix.count("/") + 1))
    return below.orderBy(F.col("kind").desc(), "name", "repository").limit(limit)


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    """node_id, depth, crumb, crumb_path for each part of a node's path; at most 14."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    rows = nodes.select("node_id", parts.alias("parts")).select("node_id", "parts", F.posexplode(F.slice("parts", 1, 14)).alias("depth", "crumb"))
    return rows.select("node_id", F.col("depth").cast("long"), "crumb", F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("depth") + 1), "/")).alias("crumb_path"))


def outline(sections: DataFrame, limit: int = 300) -> DataFrame:
    """Section titles, indented by level, with a short summary; the first of each node."""
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy("ordinal"))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.col("title"))
    return sections.withColumn("nth", nth).filter(F.col("nth") <= limit).select("node_id", "ordinal", line.alias("line"), T.preview(F.col("summary"), 180).alias("summary"))


def read_document(chunks: DataFrame, max_chunks: int = 80, max_chars: int = 6000) -> DataFrame:
    """The text of each node: chunks in order while characters are left; the last is cut. max_chars is kept from 500 to 20000."""
    max_chars = min(20000, max(500, max_chars))
    w = Window.partitionBy("node_id").orderBy("ordinal")
    nth = F.row_number().over(w)
    before = F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = chunks.select("node_id", "ordinal", "text", nth.alias("nth"), before.alias("before")).filter((F.col("nth") <= max_chunks) & (F.col("before") < max_chars))
    part = F.substr("text", F.lit(1), (F.lit(max_chars) - F.col("before")).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", part.alias("part")))), lambda x: x["part"]), "\n")
    return kept.groupBy("node_id").agg(F.count("*").alias("n_chunks"), joined.alias("text"))


def read_part(chunks: DataFrame, section: str = "", page: int | None = None, max_chunks: int = 80, max_chars: int = 6000) -> DataFrame:
    """read_document of the chunks under headings that contain a text, and of one page, where these are asked for."""
    part = chunks.filter(T.contains_text(F.col("heading_path"), section))
    return read_document(part if page is None else part.filter(F.col("page") == page), max_chunks, max_chars)


def section_sizes(sections: DataFrame) -> DataFrame:
    """Sections with the number of their chunks; an empty one ends before it begins."""
    return sections.withColumn("n_chunks", F.greatest(F.lit(0), F.col("last") - F.col("first") + 1))


def create_folders(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Folders to make (repository, parent, name): path and error, null where it can be made.

    The parent, "" for the top, must be a folder of the repository; the name is cleaned; a path
    that is taken, also by an earlier row of the same ask, is a conflict.
    """
    name = T.clean_name(F.col("name"))
    folders = nodes.filter("kind = 'folder'").select("repository", F.col("path").alias("parent"), F.lit(True).alias("is_folder"))
    taken = nodes.select("repository", "path", F.lit(True).alias("is_taken")).distinct()
    rows = asked.withColumn("path", F.concat("parent", F.lit("/"), name)).join(folders, ["repository", "parent"], "left").join(taken, ["repository", "path"], "left")
    nth = F.row_number().over(Window.partitionBy("repository", "path").orderBy("ask_id"))
    error = F.when(F.col("path").isNull(), "bad_name").when((F.col("parent") != "") & F.col("is_folder").isNull(), "parent_not_folder").when(slashes(F.col("path")) > MAX_DEPTH, "too_deep").when(F.col("is_taken") | (nth > 1), "name_exists")
    return rows.select("ask_id", "repository", "path", error.alias("error"))


def content_page(chunks: DataFrame, node_id: int, offset: int = 0, limit: int = 100) -> DataFrame:
    return chunks.filter(F.col("node_id") == node_id).orderBy("ordinal").offset(offset).limit(min(limit, 100))


def move_subtree(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """Paths below ``old`` begin with ``new`` instead. A move into itself, or below the greatest depth, is an error."""
    if new == old or new.startswith(old + "/"):
        raise ValueError("a folder can't be moved into itself")
    inside = F.col("path").startswith(old + "/") | (F.col("path") == old)
    moved = F.concat(F.lit(new), F.substr("path", F.lit(len(old) + 1)))
    path = F.when(inside, moved).otherwise(F.col("path"))
    ok = F.when(slashes(path) <= MAX_DEPTH, path).otherwise(F.raise_error(F.lit("too deep")).cast("string"))
    return nodes.withColumn("path", ok)


def delete_subtree(nodes: DataFrame, children_: list[DataFrame], path: str) -> list[DataFrame]:
    """Nodes without those at or below a path, and each child table without their rows."""
    gone = nodes.filter(F.col("path").startswith(path + "/") | (F.col("path") == path)).select("node_id")
    return [t.join(gone, "node_id", "left_anti") for t in (nodes, *children_)]


def resolve(nodes: DataFrame, name: str) -> DataFrame:
    """The node of exactly this path, else the first by path of this name."""
    rank = F.when(F.col("path") == name, 0).otherwise(1)
    return nodes.filter((F.col("path") == name) | (F.col("name") == name)).orderBy(rank, "path", "node_id").limit(1)


def visible(repositories: DataFrame, user: str, admin: bool = False) -> DataFrame:
    return repositories.filter(F.lit(admin) | (F.col("owner_id") == user) | (F.col("visibility") == "shared"))


def unique_slugs(slugs: DataFrame) -> DataFrame:
    """Adds ``unique_slug``: the first of a slug keeps it, the next get -1, -2 and so on."""
    n = F.row_number().over(Window.partitionBy("slug").orderBy("id")) - 1
    return slugs.withColumn("unique_slug", F.when(n > 0, F.concat("slug", F.lit("-"), n.cast("string"))).otherwise(F.col("slug")))
