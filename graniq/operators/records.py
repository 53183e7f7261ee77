"""Records: upserts, labels, scores, links, reviews and reports, as joins over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graniq.functions import scores as S
from graniq.functions import text as T

#: Pairs that a task makes.
PAIRS = 500_000


def merge_maps(old: Column, new: Column) -> Column:
    """Both maps; the new value wins. Independent of the session's policy for doubled keys."""
    old, new = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (old, new))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def upsert_records(old: DataFrame, new: DataFrame, max_evidence: int = 20) -> DataFrame:
    """Both tables by (collection, external_id): the title is the new one, the summary too unless empty, attributes are merged, labels and evidence replaced where given; ``created`` marks new keys.

    Columns: collection, external_id, title, summary, attributes (map), labels, evidence (arrays). Of new rows with one key the last by title counts.
    """
    key = ["collection", "external_id"]
    latest = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("title").desc()))
    n = new.withColumn("__n", latest).filter("__n = 1").drop("__n").withColumn("__new", F.lit(True)).alias("n")
    o = old.withColumn("__old", F.lit(True)).alias("o")
    both = o.join(n, key, "full")
    return both.select(
        *key,
        F.coalesce("n.title", "o.title").alias("title"),
        F.when(F.coalesce("n.summary", F.lit("")) != "", F.col("n.summary")).otherwise(F.col("o.summary")).alias("summary"),
        merge_maps(F.col("o.attributes"), F.col("n.attributes")).alias("attributes"),
        F.coalesce("n.labels", "o.labels").alias("labels"),
        F.slice(F.coalesce("n.evidence", "o.evidence"), 1, max_evidence).alias("evidence"),
        (F.col("__old").isNull() & F.col("__new").isNotNull()).alias("created"),
    )


def upsert_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links by (from_id, to_id, kind): a reviewed one keeps status and rationale and takes the new score; another is overwritten as a candidate."""
    key = ["from_id", "to_id", "kind"]
    both = old.alias("o").join(new.alias("n"), key, "full")
    reviewed = F.col("o.status").isin("approved", "rejected")
    fresh = F.col("n.score").isNotNull()
    return both.select(
        *key,
        F.coalesce("n.score", "o.score").alias("score"),
        F.when(reviewed | ~fresh, F.col("o.rationale")).otherwise(F.col("n.rationale")).alias("rationale"),
        F.when(reviewed | ~fresh, F.col("o.status")).otherwise(F.lit("candidate")).alias("status"),
        F.col("o.status").isNull().alias("created"),
    )


def upsert_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scores by (record_id, card_id): a new score replaces the old one, and its verdict is open again."""
    key = ["record_id", "card_id"]
    both = old.alias("o").join(new.alias("n"), key, "full")
    fresh = F.col("n.total").isNotNull()
    return both.select(*key, F.coalesce("n.total", "o.total").alias("total"), F.when(fresh, F.col("n.tier")).otherwise(F.col("o.tier")).alias("tier"), F.when(fresh, F.lit("candidate")).otherwise(F.col("o.status")).alias("status"))


def replace_children(old: DataFrame, new: DataFrame, key: str = "node_id") -> DataFrame:
    """The new rows, and the old ones of the keys that have no new row."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, defaults: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(defaults.join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def record_text(title: Column, summary: Column, attributes: Column, labels: Column) -> Column:
    """Title, summary, attributes in order of keys and labels, line by line; at most 8000 characters."""
    entries = F.transform(F.filter(F.array_sort(F.map_entries(attributes)), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    named = F.when(F.size(labels) > 0, F.concat(F.lit("분류: "), F.array_join(labels, ", ")))
    full = F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(summary, F.lit("")), F.nullif(F.array_join(entries, "\n"), F.lit("")), named)
    return F.substr(full, F.lit(1), F.lit(8000))


def classify(records: DataFrame, taxonomy: DataFrame, key: str, haystack: Column, cap: int = 3) -> DataFrame:
    """Labels of records by their terms: key, labels (array), at most cap, most matched terms first, then in the taxonomy's order.

    taxonomy: pos, label. Terms and records meet by equality, on a term's first three characters (or
    two, of a term that has no more), which are held against the distinct runs of three and two
    characters of a record's text; where a term is longer, the text is then asked for all of it.
    The taxonomy, a list that people keep, is broadcast: runs and texts stay where they are, and
    what travels are the hits. Keys are distinct.
    """
    terms = F.filter(T.label_terms(F.col("label")), lambda t: F.length(t) >= 2)
    asked = taxonomy.select("pos", "label", F.explode(F.array_distinct(terms)).alias("__term")).withColumn("__gram", F.substr("__term", F.lit(1), F.lit(3)))
    text = records.select(F.col(key), F.lower(haystack).alias("__text"))
    runs = lambda n: F.when(F.length("__text") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length("__text") - n + 1, F.lit(1))), lambda i: F.substr("__text", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = text.select(key, "__text", F.explode(F.array_distinct(F.concat(runs(3), runs(2)))).alias("__gram"))
    sure = grams.join(F.broadcast(asked), "__gram").filter((F.length("__term") <= 3) | F.contains("__text", "__term"))
    hits = sure.groupBy(key, "pos", "label").agg(F.count("*").alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "pos", "label"))), 1, cap)
    labels = hits.groupBy(key).agg(F.transform(best, lambda x: x["label"]).alias("labels"))
    return records.select(key).join(labels, key, "left").select(key, F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def weighted_scores(values: DataFrame, key: str, card: list[tuple[str, float]]) -> DataFrame:
    """Totals of records (key and a column from 0 to 100 for each dimension): key, total (one decimal, by the sum's exact value), tier."""
    weights = [max(0.0, float(w)) for _, w in card]
    all_of = sum(weights)
    weights = [w / all_of if all_of > 0 else 1 / len(card) for w in weights]
    total = reduce(lambda a, b: a + b, [S.clamp(F.col(name)) * F.lit(w) for (name, _), w in zip(card, weights)])
    return values.select(key, S.round_even(total).alias("total")).withColumn("tier", S.tier(F.col("total")))


def unscored(records: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    return records.join(scores.select(key), key, "left_anti")


def ranked_records(records: DataFrame, scores: DataFrame, limit: int, tier: str | None = None) -> DataFrame:
    """Records with one score each (the greatest card's), best first; 0 and none come last. The tier filter follows the limit, as a page of results does."""
    one = scores.groupBy("record_id").agg(F.max_by(F.struct("total", "tier"), "card_id").alias("s")).select("record_id", "s.total", "s.tier")
    order = F.when(F.coalesce("total", F.lit(0.0)) != 0, F.col("total")).otherwise(-1.0).desc()
    page = records.join(one, "record_id", "left").orderBy(order, "record_id").limit(limit)
    return page if tier is None else page.filter(F.col("tier") == tier)


def pairs(left: DataFrame, right: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """The join of two tables on keys of which each has many rows on both sides, in tasks of some ``most`` pairs (PAIRS) whatever the number of pairs.

    Rows are few and pairs many, so Spark, which goes by bytes, would make a handful of tasks. A key of
    more pairs is cut into blocks of the right rows, which its left rows meet one by one.
    """
    most = most or PAIRS
    met = left.groupBy(*keys).agg(F.count("*").alias("__l")).join(right.groupBy(*keys).agg(F.count("*").alias("__r")), keys).select((F.col("__l") * F.col("__r")).alias("n"))
    largest, total = met.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks, tasks = max(1, -(-largest // most)), max(1, -(-total // most))
    each = left.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    cut = right.withColumn("__block", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)))
    on = [*keys, "__block"]
    return each.repartition(tasks, *on).join(cut.repartition(tasks, *on), on).drop("__block")


def links_of(links: DataFrame, records: DataFrame) -> DataFrame:
    """Each record's links from either side, with the other record's title: record_id, other_id, title, score.

    A union of two equi-joins instead of a join on an OR.
    """
    sides = links.select(F.col("from_id").alias("record_id"), F.col("to_id").alias("other_id"), "score").unionByName(links.select(F.col("to_id").alias("record_id"), F.col("from_id").alias("other_id"), "score"))
    named = records.select(F.col("record_id").alias("other_id"), "title")
    return sides.join(named, "other_id", "left").select("record_id", "other_id", F.coalesce("title", F.lit("")).alias("title"), "score")


def latest_verdict(reviews: DataFrame) -> DataFrame:
    """Status by target from an append-only log (target_id, verdict, at): that of the newest verdict."""
    newest = F.max_by("verdict", F.struct("at", "verdict"))
    return reviews.groupBy("target_id").agg(newest.alias("verdict"), F.count("*").alias("n_reviews")).withColumn("status", F.when(F.col("verdict").isin("approved", "rejected"), F.col("verdict")).otherwise("candidate"))


def percent(weight: Column) -> Column:
    return F.concat(F.bround(weight.cast("double") * 100).cast("int").cast("string"), F.lit("%"))


def _lines(title: str, rows: Column, *head: str) -> Column:
    """A block with its heading and a blank line after it; null, and so left out, without rows."""
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(*[F.lit(x) for x in (title, "", *head)]), rows, F.array(F.lit(""))), "\n"))


# The wording of cards.
CARD_END = "이 카드는 자동으로 생성되었습니다. 점수와 판단 근거는 전문가 검증(Human-in-the-Loop) 대상입니다."


def evidence_cards(records: DataFrame, scores: DataFrame, links: DataFrame, tier: str = "short", limit: int = 20, collection: str | None = None, top: int = 5) -> DataFrame:
    """Markdown cards of the best scored records of a tier or above: record_id, file, markdown.

    records: record_id, collection, title, summary, labels, attributes (map). scores: record_id,
    total, tier, status, dimensions (array of label, weight, score, rationale), evidence (array of
    path, heading, page, quote). links: from_id, to_id, score, status, rerank_score, rationale; a
    card lists the links that go out from its record. The limit is one of scores: the collection
    is asked for after it, as is whether the record is there.
    """
    wanted = {"core": ["core"], "short": ["core", "short"], "long": ["core", "short", "long"]}[tier]
    best = scores.filter(F.col("tier").isin(wanted)).orderBy(F.col("total").desc(), "record_id").limit(limit)
    own = best.join(records if collection is None else records.filter(F.col("collection") == collection), "record_id")
    nth = F.row_number().over(Window.partitionBy("record_id").orderBy(F.col("score").desc(), "to_id"))
    out = links.withColumnRenamed("from_id", "record_id").join(best.select("record_id"), "record_id", "left_semi").withColumn("nth", nth).filter(F.col("nth") <= top)
    out = out.join(records.select(F.col("record_id").alias("to_id"), F.col("title").alias("other")), "to_id", "left")
    again = F.when(F.col("rerank_score").isNotNull(), F.concat(F.lit(", 재평가 "), F.col("rerank_score").cast("string"))).otherwise("")
    why = F.when(F.coalesce("rationale", F.lit("")) != "", F.concat(F.lit(" — "), F.col("rationale"))).otherwise("")
    line = F.concat(F.lit("- "), S.shown(F.col("status"), S.VERDICT_MARKS, F.lit("· 후보")), F.lit(" **"), F.coalesce("other", F.col("to_id").cast("string")), F.lit("** (유사도 "), F.col("score").cast("string"), again, F.lit(")"), why)
    lists = out.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"]).alias("link_lines"))
    cards = own.join(lists, "record_id", "left")
    head = F.array_join(F.array(F.concat(F.lit("# "), F.col("title")), F.lit(""), F.concat(F.lit("- 종합점수: **"), F.col("total").cast("string"), F.lit("** ("), S.shown(F.col("tier"), S.TIER_NAMES, F.col("tier")), F.lit(")")), F.concat(F.lit("- 분류: "), F.when(F.size("labels") > 0, F.array_join("labels", ", ")).otherwise("-")), F.concat(F.lit("- 검토상태: "), F.col("status")), F.lit("")), "\n")
    about = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("## 개요\n"), F.col("summary"), F.lit("\n")))
    entries = F.transform(F.filter(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != ""), lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), e["value"]))
    facts = F.when(F.size("attributes") > 0, F.array_join(F.concat(F.array(F.lit("## 주요 항목"), F.lit("")), entries, F.array(F.lit(""))), "\n"))
    rated = F.transform("dimensions", lambda d: F.concat(F.lit("| "), d["label"], F.lit(" | "), percent(d["weight"]), F.lit(" | "), d["score"].cast("string"), F.lit(" | "), F.translate(F.coalesce(d["rationale"], F.lit("")), "|", "/"), F.lit(" |")))
    table = F.array_join(F.concat(F.array(*[F.lit(x) for x in ("## 차원별 평가", "", "| 차원 | 가중치 | 점수 | 판단 근거 |", "|---|---|---|---|")]), rated, F.array(F.lit(""))), "\n")
    where = lambda e: F.concat(F.array_join(F.filter(F.array(e["path"], e["heading"]), lambda x: F.coalesce(x, F.lit("")) != ""), " > "), F.when(F.coalesce(e["page"], F.lit(0)) != 0, F.concat(F.lit(" p."), e["page"].cast("string"))).otherwise(""))
    cited = F.transform("evidence", lambda e, i: F.concat(F.lit("**["), (i + 1).cast("string"), F.lit("]** "), where(e), F.lit("\n\n> "), F.translate(F.coalesce(e["quote"], F.lit("")), "\n", " "), F.lit("\n")))
    body = F.concat_ws("\n", head, about, facts, table, _lines("## 매칭 후보", F.col("link_lines")), F.when(F.size("evidence") > 0, F.array_join(F.concat(F.array(F.lit("## 근거 인용"), F.lit("")), cited), "\n")), F.lit("---\n"), F.lit(CARD_END))
    return cards.select("record_id", F.concat(T.safe_stem(F.col("title")), F.lit(".md")).alias("file"), body.alias("markdown"))


def visible_attributes(attributes: Column) -> Column:
    """Without the keys that begin with an underscore."""
    return F.map_filter(attributes, lambda k, _: ~k.startswith("_"))


def record_list(records: DataFrame, scores: DataFrame, q: str = "", collection: str = "", tier: str = "", limit: int = 60) -> DataFrame:
    """Active records whose title or summary contains a text, the newest ``limit`` (300 at most) of them; then of a tier, the best scored first.

    records: record_id, collection, title, summary, status, created_at. A record's score is that
    of its last row by score_id; 0 and none rank last.
    """
    rows = records.filter("status = 'active'")
    if collection:
        rows = rows.filter(F.col("collection") == collection)
    if q:
        rows = rows.filter(T.contains_text(F.col("title"), q) | T.contains_text(F.col("summary"), q))
    page = rows.orderBy(F.col("created_at").desc(), F.col("record_id").desc()).limit(min(limit, 300))
    last = scores.join(page.select("record_id"), "record_id", "left_semi").groupBy("record_id").agg(F.max_by(F.struct("total", "tier"), "score_id").alias("s"))
    out = page.join(last, "record_id", "left").select(*page.columns, F.col("s.total").alias("total"), F.col("s.tier").alias("tier"))
    if tier:
        out = out.filter(F.col("tier") == tier)
    return out.orderBy(F.when(F.coalesce("total", F.lit(0.0)) != 0, F.col("total")).otherwise(-1.0).desc(), F.col("created_at").desc(), F.col("record_id").desc())


def record_reviews(records: DataFrame, links: DataFrame, scores: DataFrame, reviews: DataFrame, limit: int = 30, link_limit: int = 20) -> DataFrame:
    """Per record the newest reviews of it, of its best links and of its score: record_id, nth, target_type, target_id, verdict.

    links: link_id, from_id, to_id, score. scores: score_id, record_id. reviews: target_type,
    target_id, verdict, at, review_id.
    """
    known = records.select("record_id")
    both = links.select(F.col("from_id").alias("record_id"), "link_id", "score").unionByName(links.select(F.col("to_id").alias("record_id"), "link_id", "score")).join(known, "record_id", "left_semi")
    best = F.row_number().over(Window.partitionBy("record_id").orderBy(F.col("score").desc(), "link_id"))
    both = both.withColumn("n", best).filter(F.col("n") <= link_limit)
    one = scores.groupBy("record_id").agg(F.min("score_id").alias("target_id"))
    target = lambda rows, kind, key: rows.select("record_id", F.lit(kind).alias("target_type"), F.col(key).alias("target_id"))
    targets = target(records, "record", "record_id").unionByName(target(both, "link", "link_id")).unionByName(target(one, "score", "target_id")).join(known, "record_id", "left_semi").distinct()
    # No record shows more than the newest of a target's reviews, so only these meet the records.
    order = F.col("at").desc(), F.col("review_id").desc()
    few = reviews.withColumn("__n", F.row_number().over(Window.partitionBy("target_type", "target_id").orderBy(*order))).filter(F.col("__n") <= limit).drop("__n")
    newest = F.row_number().over(Window.partitionBy("record_id").orderBy(*order))
    found = targets.join(few, ["target_type", "target_id"]).withColumn("nth", newest).filter(F.col("nth") <= limit)
    return found.select("record_id", "nth", "target_type", "target_id", "verdict")


def update_cards(cards: DataFrame, changes: DataFrame) -> DataFrame:
    """Scorecards by card_id with their changes: dimensions normalised, the old ones where none are left; the name where one is given; a card made the default is the only one of its repository."""
    c, n = cards.alias("c"), changes.alias("n")
    dims = S.normalise_weights(F.col("n.dimensions"))
    chosen = changes.filter("is_default").join(cards.select("card_id", "repository"), "card_id").groupBy("repository").agg(F.max("card_id").alias("default_id"))
    out = c.join(n, "card_id", "left").select("card_id", "c.repository", F.coalesce(F.nullif(F.substr("n.name", F.lit(1), F.lit(120)), F.lit("")), "c.name").alias("name"), F.when(F.size(dims) > 0, dims).otherwise(F.col("c.dimensions")).alias("dimensions"), F.col("c.is_default").alias("was"))
    out = out.join(chosen, "repository", "left")
    return out.select("card_id", "repository", "name", "dimensions", F.when(F.col("default_id").isNotNull(), F.col("card_id") == F.col("default_id")).otherwise(F.col("was")).alias("is_default"))


def pipeline_page(steps: DataFrame, runs: DataFrame, limit: int = 40) -> tuple[DataFrame, DataFrame]:
    """The steps of a pipeline in order, and its newest runs with the names of their steps."""
    newest = runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)
    named = newest.join(steps.select("step_id", F.col("name").alias("step")), "step_id", "left")
    return steps.orderBy("sort_order", "created_at", "step_id"), named


def document_records(nodes: DataFrame, chunks: DataFrame, folder: str = "", first: int = 4) -> DataFrame:
    """Records of the ready files below a folder: external_id (path), title (stem), summary (from the first chunks, 400 characters), no labels."""
    inside = nodes.filter((F.col("kind") == "file") & (F.col("status") == "ready") & F.col("path").startswith(folder.rstrip("/") + "/"))
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy("ordinal"))
    head = chunks.join(inside.select("node_id"), "node_id", "left_semi").withColumn("nth", nth).filter(F.col("nth") <= first)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"])
    texts = head.groupBy("node_id").agg(F.array_join(ordered, " ").alias("text"))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    out = inside.join(texts, "node_id", "left")
    return out.select("node_id", F.substr("path", F.lit(1), F.lit(200)).alias("external_id"), stem.alias("title"), F.substr(T.one_line(F.coalesce("text", F.lit(""))), F.lit(1), F.lit(400)).alias("summary"), F.array().cast("array<string>").alias("labels"))


def missing_attribute(records: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` records whose attribute is absent or empty, of the first 3 * limit by record_id."""
    empty = F.coalesce(F.col("attributes")[key], F.lit("")) == ""
    return records.orderBy("record_id").limit(3 * limit).filter(empty).orderBy("record_id").limit(limit)


def single_default(rows: DataFrame, chosen: Column) -> DataFrame:
    """Exactly the chosen row is the default."""
    return rows.withColumn("is_default", F.coalesce(chosen, F.lit(False)))


def choose_card(cards: DataFrame, wanted: int | None = None) -> DataFrame:
    """The card of this id, else the default, else the first enabled one."""
    rank = F.when(F.col("card_id") == F.lit(wanted), 0).when(F.col("is_default"), 1).when(F.col("enabled"), 2)
    return cards.withColumn("rank", rank).filter("rank IS NOT NULL").orderBy("rank", "card_id").limit(1).drop("rank")


def grouped_ids(bridge: DataFrame, key: str, other: str) -> DataFrame:
    """The other side of an n-to-m bridge, as a sorted list for each key."""
    return bridge.groupBy(key).agg(F.array_sort(F.collect_set(other)).alias(other))


def replace_set(bridge: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The bridge with the keys of ``new`` bound to its rows alone."""
    return bridge.join(new.select(key).distinct(), key, "left_anti").unionByName(new.distinct())


def link_page(links: DataFrame, records: DataFrame, status: str | None = None, limit: int = 400, to: DataFrame | None = None) -> DataFrame:
    """Links of a status by score with both titles; an unknown record's title is empty. ``to``: the records of the other side, where they are another table."""
    own = links if status is None else links.filter(F.col("status") == status)
    best = own.orderBy(F.col("score").desc(), "from_id", "to_id").limit(min(limit, 400))
    title = lambda table, side: table.select(F.col("record_id").alias(f"{side}_id"), F.col("title").alias(f"{side}_title"))
    both = best.join(title(records, "from"), "from_id", "left").join(title(records if to is None else to, "to"), "to_id", "left")
    return both.select("from_id", "to_id", F.coalesce("from_title", F.lit("")).alias("from_title"), F.coalesce("to_title", F.lit("")).alias("to_title"), "score")
