"""Texts to sections and chunks, as a plan over the table of lines.

Pages, headings and their paths are windows over a text's lines; a heading's place in the path
has a closed form. Sections and their synthesis are aggregations. Which chunk a line belongs to
depends on all lines before it: the numbers of a text's lines go through one pass in Python, which
is linear in them, and so does a chunk beyond the byte cap, to be cut.

The table of lines and that of chunks are written once, in the shared folder: texts have a number
there that all branches agree on, whatever is computed again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from graniq.functions import text as T
from graniq.sources import store

# Limits of chunks and sections, and the marks of pages and headings.
MAX_BYTES, SECTION_CHUNKS, BODY = 7000, 6, "본문"
PAGE = r"^\s*\[page (\d+)\]$"
HEADING = r"^(#{1,4})\s+(.*)$"
LEVELS = range(1, 5)


def by_bytes(text: str, most: int = MAX_BYTES) -> list[str]:
    """Pieces of at most ``most`` UTF-8 bytes, cut before the last newline of the second half if there is one; cut-off characters are dropped."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    while at < len(raw):
        end = min(at + most, len(raw))
        if end < len(raw):
            newline = raw.rfind(b"\n", at + most // 2, end)
            end = end if newline < 0 else newline
        out.append(raw[at:end].decode("utf-8", "ignore"))
        at = end
    return [piece for piece in out if piece.strip()]


@F.pandas_udf(ArrayType(StringType()))
def _cut(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else by_bytes(t))


def filled(sections: list[int], weights: list[int], alone: list[bool], target: int) -> list[int]:
    """The number of the chunk of each line: a line joins the open chunk unless that would exceed the target, a section begins, or one of both stands alone."""
    out, part, open_, section, before = [], 0, 0, None, False
    for s, w, own in zip(sections, weights, alone):
        new = s != section or own or before or (open_ > 0 and open_ + w > target)
        part, open_, section, before = part + new, w if new else open_ + w, s, own
        out.append(part)
    return out


def runs_of(pages: list[int | None]) -> list[int]:
    """The number of the run of each chunk: by page, two at least before a new page begins one."""
    out, run, length, before = [], -1, 2, -1
    for p in pages:
        page = -2 if p is None or p != p else int(p)
        new = length >= 2 and page != before
        run, length, before = run + new, 1 if new else length + 1, page
        out.append(run)
    return out


def _filled(sections: Column, weights: Column, alone: Column, target: int) -> Column:
    @F.pandas_udf(ArrayType(LongType()))
    def number(s: pd.Series, w: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([filled(x.tolist(), y.tolist(), z.tolist(), target) for x, y, z in zip(s, w, a)])

    return number(sections, weights, alone)


@F.pandas_udf(ArrayType(LongType()))
def _runs_of(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: runs_of(p.tolist()))


def windows(line: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens of a text, each repeating ``overlap`` of the one before, as an array; what is between tokens is kept."""
    tokens = F.regexp_extract_all(line, F.lit(rf"({T.TOKEN})\s*"), F.lit(0))
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / step).cast("int")) * step, F.lit(step))
    return F.transform(starts, lambda i: F.regexp_replace(F.array_join(F.slice(tokens, i + 1, size), ""), r"\s+$", ""))


def joined(order: str, text: str, separator: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _last(value: Column, over) -> Column:
    return F.last(value, ignorenulls=True).over(over)


def marked_lines(docs: DataFrame, key: str) -> DataFrame:
    """A row per line but those of page marks: doc (a number for each row of docs), key, pos, line, head, opens, section, level, title, path, parent, page (in force), after (in force at the next line)."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(key), lines.alias("lines")).repartition("doc")  # whole texts move once, for all windows
    each = numbered.select("doc", key, F.posexplode("lines").alias("pos", "line"))
    order = Window.partitionBy("doc").orderBy("pos")
    number = F.when(F.col("line").rlike(PAGE), F.regexp_extract("line", PAGE, 1).cast("int"))
    each = each.withColumn("number", number)
    each = each.withColumns({"page": _last(F.col("number"), order), "final": _last(F.col("number"), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    rows = each.filter("number IS NULL").withColumn("head", F.col("line").rlike(HEADING))
    rows = rows.withColumns({
        "opens": F.col("head") | (F.row_number().over(order) == 1),
        "level": F.when(F.col("head"), F.length(F.regexp_extract("line", HEADING, 1))).otherwise(1),
        "nth": F.sum(F.col("head").cast("int")).over(order),
        "after": F.when(F.lead("pos").over(order).isNull(), F.col("final")).otherwise(F.lead("page").over(order)),
    })
    rows = rows.withColumn("section", F.sum(F.col("opens").cast("long")).over(order) - 1)
    name = F.trim(F.regexp_extract("line", HEADING, 2))
    title = F.when(F.col("head"), F.when(name != "", name).otherwise(F.concat(F.lit("섹션 "), (F.col("section") + 1).cast("string")))).otherwise(BODY)
    # A heading stands one place deeper than the one before it, and no deeper than its level.
    least = F.min(F.when(F.col("head"), F.col("level") - F.col("nth"))).over(order)
    rows = rows.withColumns({"title": title, "depth": F.when(F.col("head"), F.col("nth") + F.least(F.lit(0), least))})
    depth = F.coalesce(_last(F.col("depth"), order), F.lit(0))
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    path = F.concat_ws(" > ", *[F.when(depth >= d, _last(F.when(F.col("depth") == d, F.col("title")), order)) for d in LEVELS])
    parent = F.greatest(*[F.when(F.col("level") > d, _last(F.when(F.col("opens") & (F.col("level") == d), F.col("section")), above)) for d in LEVELS])
    return rows.withColumns({"path": path, "parent": parent})


def _packed(content: DataFrame, key: str, target: int, most: int, overlap: int) -> DataFrame:
    """doc, key, section, path, page, pos, n, text: the pieces of all texts, in order of pos, n."""
    weight = T.token_count(F.col("line"))
    line = F.struct("pos", "line", "section", "path", "page", "after", weight.alias("w"), (weight > most).alias("long"))
    rows = content.groupBy("doc", key).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    parts = _filled(F.col("lines.section"), F.col("lines.w"), F.col("lines.long"), target)
    each = rows.select("doc", key, F.explode(F.arrays_zip("lines", parts.alias("part"))).alias("x")).select("doc", key, "x.lines.*", "x.part")
    # A chunk has the page in force where the next line ends it; a long line stands for itself.
    whole = each.groupBy("doc", key, "part").agg(
        F.min("section").alias("section"), F.max("path").alias("path"), F.max("long").alias("long"), F.min("pos").alias("pos"),
        F.max_by(F.when(F.col("long"), F.col("page")).otherwise(F.col("after")), "pos").alias("page"), joined("pos", "line").alias("raw"),
    )
    whole = whole.withColumn("text", _stripped(F.col("raw")))
    fits = F.octet_length("text") <= MAX_BYTES
    cut = _cut(F.when(~fits & ~F.col("long"), F.col("text")))
    pieces = F.when(F.col("long"), windows(F.col("raw"), most, overlap)).when(F.col("text") == "", F.array().cast("array<string>")).when(fits, F.array("text")).otherwise(cut)
    return whole.select("doc", key, "section", "path", "page", "pos", F.posexplode(pieces).alias("n", "text"))


def _divided(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks with how many sections of their text have any (kept), and where that is a single one with their run: by page, two at least before a new page begins one; without pages in runs of six. from and to: the pages of a run.

    All of it by text, as the chunks come, so that they move no more.
    """
    own = Window.partitionBy("doc", key)
    begins = F.coalesce(F.col("section") != F.lag("section").over(own.orderBy("ordinal")), F.lit(True))
    kept = chunks.withColumn("begins", begins.cast("int")).withColumn("kept", F.sum("begins").over(own))
    c = F.struct("ordinal", "page", "tokens", "text", "path", "section")
    rows = kept.groupBy("doc", key, "kept").agg(F.array_sort(F.collect_list(c)).alias("chunks"))
    paged = F.exists("chunks", lambda x: F.coalesce(x["page"], F.lit(0)) > 0)
    runs = F.when(paged, _runs_of(F.col("chunks.page"))).otherwise(F.transform("chunks", lambda x: F.floor(x["ordinal"] / SECTION_CHUNKS)))
    each = rows.select("doc", key, "kept", F.explode(F.arrays_zip("chunks", runs.alias("run"))).alias("x")).select("doc", key, "kept", "x.chunks.*", "x.run")
    real, run = F.when(F.col("page") > 0, F.col("ordinal")), Window.partitionBy("doc", key, "run")
    return each.withColumns({"from": F.min_by("page", real).over(run), "to": F.max_by("page", real).over(run)})


def structure(docs: DataFrame, key: str = "node_id", target: int = 700, most: int = 1000, overlap: int = 100, max_chunks: int | None = None) -> DataFrame:
    """Sections and chunks of texts (key, text): key, kind (section or chunk), and the part's columns.

    A null or blank text has none; no sections but a single one are replaced by synthetic ones. Texts are
    used to their end, unless a caller asks for the first ``max_chunks`` of each.
    """
    spark = docs.sparkSession
    lines = store.written(marked_lines(docs, key), store.folder(spark, "lines"))
    content = lines.filter("NOT head")
    place = F.row_number().over(Window.partitionBy("doc", key).orderBy("pos", "n")) - 1
    chunks = _packed(content, key, target, most, overlap).withColumns({"ordinal": place.cast("long"), "tokens": T.token_count(F.col("text"))})
    chunks = chunks if max_chunks is None else chunks.filter(F.col("ordinal") < max_chunks)
    chunks = store.written(_divided(chunks, key), store.folder(spark, "chunks"))

    # Of sections only numbers are counted; their texts move once, to their lines' sections.
    spans = chunks.groupBy("doc", "section").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    spans = spans.withColumn("kept", F.count("*").over(Window.partitionBy("doc"))).filter("kept > 1").drop("kept")
    body = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n"), F.lit("\n"))
    opened = lines.groupBy("doc", "section").agg(F.first(key).alias(key), F.min_by(F.struct("level", "title", "path", "parent", "page"), "pos").alias("o"), body.alias("text")).select("doc", key, "section", "o.*", "text")
    plain = opened.join(spans, ["doc", "section"])
    plain = plain.select(key, F.lit("section").alias("kind"), F.col("section").alias("ordinal"), "level", "title", F.col("path").alias("heading_path"), "parent", "page", "section", "first", "last", T.token_count(F.col("text")).alias("tokens"), "text")
    null = lambda kind: F.lit(None).cast(kind)
    part = lambda rows, section, path: rows.select(key, F.lit("chunk").alias("kind"), "ordinal", null("int").alias("level"), null("string").alias("title"), path.alias("heading_path"), null("long").alias("parent"), "page", section.alias("section"), null("long").alias("first"), null("long").alias("last"), "tokens", "text")
    in_sections = part(chunks.filter("kept > 1"), F.col("section"), F.col("path"))

    pages = F.concat(F.lit("p."), F.col("from").cast("string"), F.when(F.col("from") != F.col("to"), F.concat(F.lit("–"), F.col("to").cast("string"))).otherwise(""))
    run = chunks.filter("kept = 1").withColumn("title", F.coalesce(pages, F.concat(F.lit(f"{BODY} "), (F.col("run") + 1).cast("string"))))
    made = run.groupBy("doc", "run").agg(F.first(key).alias(key), F.first("title").alias("title"), F.first("from").alias("from"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.sum("tokens").alias("tokens"), joined("ordinal", "text").alias("text"))
    synthetic = made.select(key, F.lit("section").alias("kind"), F.col("run").alias("ordinal"), F.lit(1).alias("level"), "title", F.col("title").alias("heading_path"), null("long").alias("parent"), F.col("from").alias("page"), F.col("run").alias("section"), "first", "last", "tokens", "text")
    in_runs = part(run, F.col("run"), F.when(F.col("path") != "", F.col("path")).otherwise(F.col("title")))
    return plain.unionByName(in_sections).unionByName(synthetic).unionByName(in_runs)


def pack_lines(docs: DataFrame, key: str, target: int = 700) -> DataFrame:
    """Chunks of texts without headings: key, ordinal, tokens, text. Keys are distinct.

    A line joins the open chunk unless that would exceed the target; blank chunks are dropped.
    Each line gets the number of its chunk, then lines of a number are joined within the text's row.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    rows = docs.select(key, lines.alias("lines")).withColumn("w", F.transform("lines", T.token_count))
    none = F.transform("w", lambda _: F.lit(False))
    each = rows.select(key, "lines", _filled(F.transform("w", lambda _: F.lit(0)), F.col("w"), none, target).alias("parts"))
    # Where a chunk begins: lines whose number is not that of the line before.
    starts = F.filter(F.transform("parts", lambda p, i: F.when((i == 0) | (p != F.element_at("parts", F.greatest(i, F.lit(1)))), i + 1)), lambda i: i.isNotNull())
    cut = each.select(key, "lines", starts.alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("lines") + 1))
    texts = F.transform(F.arrays_zip("starts", ends.alias("ends")), lambda x: _stripped(F.array_join(F.slice("lines", x["starts"], x["ends"] - x["starts"]), "\n")))
    packed = cut.select(key, F.posexplode(F.filter(texts, lambda t: t != "")).alias("ordinal", "text"))
    return packed.select(key, F.col("ordinal").cast("long"), T.token_count(F.col("text")).alias("tokens"), "text")


def sliding(text: Column, size: int, overlap: int) -> Column:
    """Native windows of words with an overlap, as an array of texts."""
    all_words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(all_words)
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")) * step, F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(all_words, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))
