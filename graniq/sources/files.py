"""Files to text: routing by type, HTML by native expressions, office formats in Arrow tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniq.functions import text as T

# Accepted types and limits.
SUFFIXES = ["pdf", "docx", "pptx", "xlsx", "html", "htm", "md", "txt", "csv", "json", "yaml", "yml", "xml", "log", "rst"]
MAX_UPLOAD, MAX_INPUT = 50 << 20, 32 << 20
MAX_ENTRIES, MAX_INFLATED, MAX_RATIO, BIG_ENTRY = 5000, 100 << 20, 200, 10 << 20
MAX_SHEETS, MAX_ROWS, MAX_COLUMNS, MAX_SLIDES = 100, 2000, 200, 500


def html_text(html: Column) -> Column:
    """Title and text of a page: no scripts, styles, navigation, headers' marks as ``## ``. Not a readability heuristic: all that is left is kept."""
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "footer", "noscript"):
        x = F.regexp_replace(x, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    title = T.one_line(F.regexp_extract(x, r"(?is)<title[^>]*>(.*?)</title>", 1))
    x = F.regexp_replace(x, r"(?is)<head\b.*?</head\s*>", " ")
    x = F.regexp_replace(x, r"(?i)<h[1-3](\s[^>]*)?>", "\n\n## ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|article|section|li|ul|ol|table|tr|h[1-6]|br|blockquote|pre)(\s[^>]*)?/?>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x, title = F.replace(x, F.lit(name), F.lit(mark)), F.replace(title, F.lit(name), F.lit(mark))
    body = T.clean(F.regexp_replace(x, r"[ \t]+", " "))
    return F.when(title != "", F.concat(title, F.lit("\n\n"), body)).otherwise(body)


def kind_of(path: Column, mime: Column) -> Column:
    """How a file is read, by MIME type or suffix; the first that fits."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    mime = F.lower(F.coalesce(mime, F.lit("")))
    is_ = lambda name, *suffixes: mime.contains(name) | suffix.isin(*suffixes)
    return F.when(is_("pdf", "pdf"), "pdf").when(is_("wordprocessing", "docx"), "docx").when(is_("presentation", "pptx"), "pptx").when(is_("spreadsheet", "xlsx"), "xlsx").when(is_("html", "html", "htm"), "html").when(mime.startswith("text/") | (mime == "") & suffix.isin(SUFFIXES) | suffix.isin("md", "txt", "csv", "json", "yaml", "yml", "xml", "log", "rst"), "text").otherwise("unsupported")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder within the limits: path, name, size_bytes, sha256, kind, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/", -1)
    ok = (F.col("length") <= MAX_UPLOAD) & F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(SUFFIXES)
    return files.filter(ok).select("path", name.alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), kind_of(F.col("path"), F.lit(None).cast("string")).alias("kind"), "content")


def _open(raw: bytes) -> zipfile.ZipFile:
    """An office file, unless it would inflate too much."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    infos = z.infolist()
    if len(infos) > MAX_ENTRIES or sum(i.file_size for i in infos) > MAX_INFLATED or any(i.file_size > BIG_ENTRY and i.file_size > MAX_RATIO * max(1, i.compress_size) for i in infos):
        raise ValueError("archive_too_large")
    return z


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _texts(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _name(x) == "t")


def _docx(raw: bytes) -> str:
    body = ElementTree.fromstring(_open(raw).read("word/document.xml"))
    inside = {id(p) for t in body.iter() if _name(t) == "tbl" for p in t.iter() if _name(p) == "p"}
    lines = []
    for p in (x for x in body.iter() if _name(x) == "p" and id(x) not in inside):
        style = next((v for x in p.iter() if _name(x) == "pStyle" for v in x.attrib.values()), "")
        level = re.fullmatch(r"[Hh]eading ?(\d)", style)
        if text := _texts(p).strip():
            lines.append(("#" * min(int(level[1]), 4) + " " if level else "") + text)
    for row in (x for x in body.iter() if _name(x) == "tr"):
        lines.append(" | ".join(_texts(c).strip() for c in row if _name(c) == "tc"))
    return "\n".join(lines)


def _numbered(z: zipfile.ZipFile, pattern: str, most: int) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)[:most]]


def _pptx(raw: bytes) -> str:
    z, out = _open(raw), []
    for i, name in enumerate(_numbered(z, r"ppt/slides/slide(\d+)\.xml", MAX_SLIDES), 1):
        paragraphs = [_texts(p).strip() for p in ElementTree.fromstring(z.read(name)).iter() if _name(p) == "p"]
        out += [f"## Slide {i}", *(p for p in paragraphs if p)]
    return "\n".join(out)


def _xlsx(raw: bytes) -> str:
    z = _open(raw)
    shared = [_texts(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _name(s) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
    titles = [s.attrib.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _name(s) == "sheet"]
    out = []
    for i, name in enumerate(_numbered(z, r"xl/worksheets/sheet(\d+)\.xml", MAX_SHEETS)):
        out.append(f"## {titles[i] if i < len(titles) else name}")
        for row in [x for x in ElementTree.fromstring(z.read(name)).iter() if _name(x) == "row"][:MAX_ROWS]:
            cells = []
            for c in [x for x in row if _name(x) == "c"][:MAX_COLUMNS]:
                value = next((v.text or "" for v in c if _name(v) == "v"), _texts(c))
                cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
            if any(x.strip() for x in cells):
                out.append(" | ".join(x for x in cells if x.strip()))
    return "\n".join(out)


_READERS = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}


def office_text(files: DataFrame) -> DataFrame:
    """path, text, error of office files (path, kind, content), one by one in Arrow tasks. A file that can't be read has a null text and a reason; so have PDF files, for which no reader is installed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, kind, raw in zip(*(c.to_pylist() for c in batch.columns)):
                text, error = None, None
                try:
                    if kind not in _READERS:
                        raise ValueError("unsupported_type")
                    if len(raw or b"") > MAX_INPUT:
                        raise ValueError("too_large")
                    text = _READERS[kind](raw) or None
                    error = None if text else "no_text"
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    error = str(e)[:200] or type(e).__name__
                rows.append((path, text, error))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "text", "error"])

    return files.select("path", "kind", "content").mapInArrow(run, "path string, text string, error string")


def extract(files: DataFrame) -> DataFrame:
    """path, text, status, error of any files (path, kind, content): text kinds by native expressions, office kinds in tasks."""
    raw = F.col("content").cast("string")
    plain = files.filter(F.col("kind").isin("text", "html")).select("path", T.clean(F.when(F.col("kind") == "html", html_text(raw)).otherwise(raw)).alias("text"), F.lit(None).cast("string").alias("error"))
    both = plain.unionByName(office_text(files.filter(~F.col("kind").isin("text", "html"))))
    error = F.when(F.coalesce("text", F.lit("")) == "", F.coalesce("error", F.lit("no_text")))
    return both.select("path", "text", F.when(error.isNull(), "ready").otherwise("failed").alias("status"), error.alias("error"))


def sniff(head: str) -> str:
    """The delimiter of a CSV file, from its first characters: the one of , TAB ; | that its header line has most."""
    line = head[:4000].lstrip("﻿").split("\n", 1)[0]
    return max(",\t;|", key=line.count)


def csv_records(spark: SparkSession, path: str, title: str, external_id: str | None = None, summary: str | None = None, limit: int | None = None) -> DataFrame:
    """Records of a CSV file with a header, all values strings: external_id, title, summary, attributes. A missing title column is an error that lists the columns; rows without title are skipped after the limit."""
    head = (spark.read.text(path).limit(1).first() or [""])[0]
    rows = spark.read.csv(path, header=True, sep=sniff(head), inferSchema=False, multiLine=True, escape='"')
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    if title not in rows.columns:
        raise ValueError(f"no column {title}; there are: {', '.join(rows.columns[:12])}")
    if limit:
        rows = rows.limit(limit)
    others = [c for c in rows.columns if c not in (title, summary)]
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in others]), F.array(*[F.col(f"`{c}`") for c in others])) if others else F.create_map().cast("map<string,string>")
    attributes = F.map_filter(pairs, lambda _, v: F.coalesce(v, F.lit("")) != "")
    key = F.coalesce(F.nullif(F.col(f"`{external_id}`"), F.lit("")), F.col(f"`{title}`")) if external_id else F.col(f"`{title}`")
    return rows.filter(F.trim(F.coalesce(F.col(f"`{title}`"), F.lit(""))) != "").select(F.substr(key, F.lit(1), F.lit(200)).alias("external_id"), F.col(f"`{title}`").alias("title"), (F.col(f"`{summary}`") if summary else F.lit("")).alias("summary"), attributes.alias("attributes"))
