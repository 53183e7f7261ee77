"""Secrets in texts, told apart by how many owners hold the same one.

Three base kinds are found by their patterns in every whole text. Beside them, any long run of
token characters is a candidate. Of every candidate value only its SHA-256 leaves the scan; the
digests are aggregated over the corpus to the number of distinct owners and of their
repositories. A value that many owners hold is a copied example; one that a single owner holds
and that looks like a credential is live, and each of its places becomes a span of its own.

All of it is DataFrame functions. A match's place is the sum of the gaps before it (``split``)
and of the matches so far (``regexp_extract_all``), by a window over the matches of one text.
Counts are combined before each shuffle, a level for each of repository, owner and value, so a
value in a third of all rows is a row a task; only matches are shuffled, never texts.

Null texts count as empty, and null owners as one owner. Rows equal in id, text, owner and
repository are scanned once and get the same spans. Texts and their matches may be of any
length; further columns, whatever their names, play no part.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniq.llm.storage import materialize

#: The kinds in the order in which spans of one start are listed; the last is the method's own.
KINDS = ["assign", "access", "hex", "live"]
#: Of the base kinds and of candidate runs. A match of hex or access that is too short holds no longer one, so these ask for the length at once.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_RUN_KIND = len(KINDS)


class Findings(NamedTuple):
    """matches: a, b (the row's key), kind, start, stop, begin (of the value, which ends at stop), digest, credible, owner, repository.

    owners: digest, owners, repositories, times (rows of matches). Both are written tables.
    """

    matches: DataFrame
    owners: DataFrame


def _keys(docs: DataFrame, doc: str, text: str, owner: str, repository: str) -> DataFrame:
    """a, b, __text, owner, repository and the id: what is needed of a row, under names that meet no others."""
    own = [F.col(f"`{c}`") for c in (doc, owner, repository)]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    a, b = F.xxhash64(*own, body), F.xxhash64(F.lit(7), body, *own[::-1])
    return docs.select(a.alias("a"), b.alias("b"), own[0].alias("__id"), body.alias("__text"), own[1].alias("owner"), own[2].alias("repository"))


def credible(value: Column, least: int, most: int) -> Column:
    """Whether a value looks like a credential: letters and digits, at least eight different characters, ``least`` to ``most`` long."""
    mixed = F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))
    return F.length(value).between(least, most) & mixed & (F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)))) >= 8)


def _hits(kind: int, pattern: str, group: int, least: int, most: int) -> Column:
    """Array of a text's matches in order: kind, nth, gap (characters since the last match), length, value's length, digest, credible."""
    text = F.col("__text")

    def hit(gap: Column, match: Column) -> Column:
        value = F.regexp_extract(match, pattern, group) if group else match
        return F.struct(F.length(gap).alias("gap"), F.length(match).alias("length"), F.length(value).alias("size"), F.sha2(value, 256).alias("digest"), credible(value, least, most).alias("credible"))

    met = F.filter(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.when(m.isNotNull(), hit(g, m))), lambda x: x.isNotNull())
    numbered = F.transform(met, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), *[x[c].alias(c) for c in ("gap", "length", "size", "digest", "credible")]))
    return F.when(F.rlike(text, F.lit(pattern)), numbered).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,length:int,size:int,digest:string,credible:boolean>>"))


def find(docs: DataFrame, doc: str = "doc_id", text: str = "text", owner: str = "owner", repository: str = "repository", least: int = 16, most: int = 256) -> Findings:
    """All matches in all texts, and how widely each value is held. A credential has ``least`` to ``most`` characters."""
    rows = _keys(docs, doc, text, owner, repository)
    hits = [_hits(0, ASSIGN, 1, least, most), _hits(1, ACCESS, 0, least, most), _hits(2, HEX, 0, least, most), _hits(_RUN_KIND, RUN, 0, least, most)]
    each = rows.select("a", "b", "owner", "repository", F.explode(F.concat(*hits)).alias("hit")).select("a", "b", "owner", "repository", "hit.*")
    each = each.dropDuplicates(["a", "b", "kind", "nth"])
    so_far = Window.partitionBy("a", "b", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap").cast("long") + F.col("length")).over(so_far)
    placed = each.withColumn("stop", stop).filter(((F.col("kind") == 0) & (F.col("size") >= 6)) | F.col("kind").between(1, 2) | F.col("credible"))
    columns = ["a", "b", "kind", (F.col("stop") - F.col("length")).alias("start"), "stop", (F.col("stop") - F.col("size")).alias("begin"), "digest", "credible", "owner", "repository"]
    matches = materialize(placed.select(*columns), "secret-matches")
    held = matches.groupBy("digest", "owner", "repository").agg(F.count("*").alias("times"))
    held = held.groupBy("digest", "owner").agg(F.count("*").alias("repositories"), F.sum("times").alias("times"))
    held = held.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("times").alias("times"))
    return Findings(matches, materialize(held, "secret-owners"))


def judged(found: Findings, max_owners: int = 1) -> DataFrame:
    """The table of values: digest, owners, repositories, times, verdict (live, copied; null: not like a credential)."""
    looks = found.matches.filter("credible").select("digest").distinct()
    verdict = F.when(F.col("__looks"), F.when(F.col("owners") <= max_owners, "live").otherwise("copied"))
    return found.owners.join(looks.withColumn("__looks", F.lit(True)), "digest", "left").select("digest", "owners", "repositories", "times", verdict.alias("verdict"))


def spans(found: Findings, max_owners: int = 1) -> DataFrame:
    """a, b, kind, start, stop, each once: those of the base kinds, and the value of each live one."""
    base = found.matches.filter(F.col("kind") < KINDS.index("live")).select("a", "b", "kind", "start", "stop")
    few = found.owners.filter(F.col("owners") <= max_owners).select("digest")
    live = found.matches.filter("credible").join(few, "digest", "left_semi")
    own = live.select("a", "b", F.lit(KINDS.index("live")).alias("kind"), F.col("begin").alias("start"), "stop").distinct()
    return materialize(base.unionByName(own), "secret-spans")


def _listed(places: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(places, lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["stop"].cast("string"))), ",")


def secret_scan(docs: DataFrame, doc: str = "doc_id", text: str = "text", owner: str = "owner", repository: str = "repository", max_owners: int = 1) -> DataFrame:
    """Per row: its id, n_assign, n_access, n_hex, n_live (long), base and spans: ``kind:start:stop`` in code points, by start and kind, comma-joined.

    base has the spans of the base kinds, spans those of live credentials as well: values of
    at most ``max_owners`` owners.
    """
    found = find(docs, doc, text, owner, repository)
    places = F.array_sort(F.collect_list(F.struct("start", "kind", "stop")))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    per = spans(found, max_owners).groupBy("a", "b").agg(*counts, places.alias("places"))
    per = materialize(per.select("a", "b", *[f"n_{k}" for k in KINDS], _listed(F.filter("places", lambda x: x["kind"] < KINDS.index("live"))).alias("base"), _listed(F.col("places")).alias("spans")), "secret-rows")
    rows = _keys(docs, doc, text, owner, repository).select(F.col("__id").alias(doc), "a", "b")
    met = rows.join(per, ["a", "b"], "left")
    return met.select(doc, *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], *[F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")])
