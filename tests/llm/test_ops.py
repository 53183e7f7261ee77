"""The ten operators on small tables, held against brute force."""

import base64
import collections
import hashlib
import io
import math
import re
import tracemalloc
import zipfile
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graniq.llm import components as components_module
from graniq.llm import katz as lm
from graniq.llm import media, quality, token_files, warc
from graniq.llm.chat_format import chat_windows, escape, read_windows, unescape
from graniq.llm.components import connect
from graniq.llm.decontaminate import contaminated, decontaminate, tile
from graniq.llm import jaccard_join as join
from graniq.llm.jaccard_join import Rule, jaccard_components, keep_one, keys_of
from graniq.llm.mixing import apply_mix, mix
from graniq.llm.queries import ORACLES, QUERIES
from graniq.llm.url_filter import url_filter
from graniq.llm.words import gram_hashes, word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  \n", "one", "one", "Ünï CÖDE wörds", "a" * 3000, "x y z " * 2000, "a b\u0085c", "\U0001f600 ok"]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_words_split_and_hash():
    col = pa.array(ODD + ["The cat. THE"])
    w = word_hashes(col.slice(1), begins=(2,))
    seen = {}
    for i, text in enumerate((ODD + ["The cat. THE"])[1:]):
        own = w.hashes[w.offsets[i] : w.offsets[i + 1]].tolist()
        assert len(own) == len(words(text))
        for a, b in zip(words(text), own):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen) and len(w.begins[0]) == len(w.hashes)
    assert len(gram_hashes(w.hashes[:2], 3)) == 0
    plain = word_hashes(pa.array(["the, cat", "THE cat!"]), punctuation=False).hashes
    assert plain[:2].tolist() == plain[2:].tolist()


# 1


def test_warc(spark):
    big = "<p>" + "é" * 800 + "</p>"
    rows = [(1, "http://a/\r\nx%", big, 1), (2, "http://b", big, 1), (3, None, big, 1), (4, "http://c", "small", 1), (5, "http://d", "small", 1), (6, "http://e", None, 1), (7, "http://f", "", 1), (3, "http://g", big, 1), (None, "http://h", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path int")
    first = warc.write_archives(pages.repartition(3))
    heads = warc.headers(first)
    assert sorted(x["url"] or "" for x in heads.collect()) == sorted(r[1] or "" for r in rows)
    second = warc.deduplicate(first, heads)
    got = warc.resolved(warc.headers(second)).collect()
    assert len(got) == len(rows)
    raw = {r[0]: (r[2] or "").encode() for r in rows}
    responses = [r for r in got if r["record_type"] == "response"]
    for r in got:
        assert r["payload_bytes"] == len(raw[r["page_id"]]) and r["payload_digest"] == hashlib.sha1(raw[r["page_id"]]).hexdigest()
        if r["record_type"] == "revisit":
            assert r["refers_to"] == 3
    assert sorted(str(r["page_id"]) for r in responses) == ["3", "4", "5", "6", "7"]
    records = [warc.parse(m) for r in second.collect() for _, m in warc.members(r["path"])]
    assert [f["WARC-Type"] for f, _ in records].count("warcinfo") == second.count() and second.agg(F.sum("records")).first()[0] == len(rows)
    again = [f for f, _ in records if f["WARC-Type"] == "revisit"]
    assert all(f["WARC-Refers-To"] == "<urn:page:3>" and f["WARC-Refers-To-Date"] > "2020" for f in again)
    assert {f.get("WARC-Refers-To-Target-URI") for f in again} <= {None, "http://g"}
    fields, block = next((f, b) for f, b in records if f["WARC-Type"] == "response")
    assert fields["WARC-Payload-Digest"].startswith("sha1:") and base64.b32decode(fields["WARC-Payload-Digest"][5:]) and block.startswith(b"HTTP/1.1")
    assert warc.headers(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_of_extreme_ids_and_long_pages(spark):
    long = "z" * (3 << 20)
    rows = [(-(2**63), "u", long), (None, "v", long), (None, "w", "y" * 1000), (-(2**63), None, "y" * 1000)]
    first = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.resolved(warc.headers(warc.deduplicate(first, warc.headers(first)))).collect()
    assert sorted((r["url"] or "", r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == [("", "response", None, 1000), ("u", "response", None, 3 << 20), ("v", "revisit", -(2**63), 3 << 20), ("w", "revisit", -(2**63), 1000)]


def test_op1_equals_brute_force(spark):
    got = {r["page_id"]: r.asDict() for r in QUERIES["op1_warc_revisits"](spark, SF).collect()}
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    last = {}
    for i, p in pages.items():
        last[p] = max(i, last.get(p, i))
    assert set(got) == set(pages)
    for i, p in pages.items():
        again = len(p) >= 1000 and last[p] != i
        assert got[i] == {"page_id": i, "payload_bytes": len(p), "payload_digest": hashlib.sha1(p).hexdigest(), "record_type": "revisit" if again else "response", "refers_to": last[p] if again else None}


# 2


def components(texts, w, num, den):
    sets = []
    for t in texts:
        ws = words(t)
        sets.append(frozenset(tuple(ws[i : i + w]) for i in range(len(ws) - w + 1)) if len(ws) >= w else frozenset([tuple(ws)] if ws else []))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("w", "num", "den"), [(3, 90, 100), (5, 8, 10), (1, 6, 10)])
def test_jaccard_equals_brute_force(spark, w, num, den):
    rng = np.random.default_rng(w)
    texts = list(ODD)
    shared = " ".join(f"p{i}" for i in range(30))
    for family in range(8):
        base = [f"w{rng.integers(400)}" for _ in range(rng.integers(9, 150))]
        for _ in range(rng.integers(1, 25)):
            own = list(base)
            for _ in range(rng.integers(0, 6)):
                own[rng.integers(len(own))] = f"n{rng.integers(60)}"
            texts.append(" ".join(own) + (" " + shared if rng.random() < 0.3 else ""))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs_of(spark, texts).repartition(5), w, num, den).collect()}
    assert got == components(texts, w, num, den)


def families(seed, count=6, most=40):
    """Chains of near copies, some with a passage that all families share."""
    rng = np.random.default_rng(seed)
    shared, texts = [f"p{i}" for i in range(40)], list(ODD)
    for family in range(count):
        own = [f"w{family}x{rng.integers(400)}" for _ in range(rng.integers(12, 90))]
        for _ in range(rng.integers(2, most)):
            for _ in range(rng.integers(0, 3)):
                own[rng.integers(len(own))] = f"n{rng.integers(90)}"
            texts.append(" ".join(own + (shared if rng.random() < 0.4 else [])))
    texts += [" ".join([f"u{i}y{k}" for k in range(6)] + shared) for i in range(30)]
    return texts


@pytest.mark.parametrize(("block", "sets", "seed"), [(2000, 1000, 1), (10**6, 7, 2), (600, 3, 3)])
def test_jaccard_of_large_families_equals_brute_force(spark, monkeypatch, block, sets, seed):
    """Families cut into blocks, keys that several components share."""
    monkeypatch.setattr(join, "BLOCK", block)
    monkeypatch.setattr(join, "SETS", sets)
    monkeypatch.setattr(join, "PIVOTS", 2)
    monkeypatch.setattr(join, "HUGE", seed)  # families of more blocks go by keys
    monkeypatch.setattr(join, "CHUNK", 3000)
    monkeypatch.setattr(join, "RANGE", 2000)
    texts = families(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs_of(spark, texts).repartition(3), 3, 8, 10).collect()}
    assert got == components(texts, 3, 8, 10)


def test_keys_alone_make_no_large_family(spark, monkeypatch):
    """Unrelated sets that keys chain are no family of many blocks, in which each would meet all others."""
    monkeypatch.setattr(join, "SETS", 20)
    seen = []
    link = join._link
    monkeypatch.setattr(join, "_link", lambda families, *rest: (seen.append(families.groupBy("family").count().agg(F.max("count")).first()[0]), link(families, *rest))[1])
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 30, replace=False)) for _ in range(120)]
    texts += [f"{t} more" for t in texts[:9]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs_of(spark, texts), 1, 8, 10).collect()}
    assert got == components(texts, 1, 8, 10) and sum(c != d for d, (_, c) in got.items()) == 9
    assert seen[0] <= 20


@pytest.mark.parametrize(("num", "den"), [(9, 10), (8, 10), (1, 2)])
def test_sketches_leave_out_no_similar_pair(num, den):
    rng, rule, sets = np.random.default_rng(den), Rule(num, den), []
    for n in (12, 16, 17, 60, 64, 65, 300):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for k in (0, 1, n // 20, n // 9, n // 4, n // 2, n):
            sets.append(np.unique(np.concatenate([base[k:], rng.integers(0, 2**63, k // 2).astype(np.uint64)])))
    sets.append(np.arange(3000, dtype=np.uint64) << np.uint64(20))  # all of one value: a count above a byte
    sets = [x for x in sets if len(x)]
    sketches = join.Sketches(np.array([len(x) for x in sets]), [join.sketch(x) for x in sets], rule)
    a, b = np.triu_indices(len(sets), 1)
    possible = sketches.possible(a, b)
    similar = np.array([den * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b)])
    assert similar.any() and possible[similar].all() and possible.mean() < 0.5 and join.sketch(sets[-1]) == b""


def test_text_score_depends_on_its_own_row():
    """A row's sum of weights is the same beside any other rows, however large their sums."""
    weights = np.zeros(1 << quality.TEXT_BITS, np.float32)
    weights[:3], weights[3:2000] = [0.1, 0.2, -0.3], 1e4
    one = quality.Views(np.array([0, 1, 2], np.int32), np.array([0, 3]), np.zeros((1, quality.PAGE_SIZE)))
    many = quality.Views(np.concatenate([np.arange(3, 2000), [0, 1, 2]]).astype(np.int32), np.array([0, 1997, 1997, 2000]), np.zeros((3, quality.PAGE_SIZE)))
    assert quality._sums(weights, many)[1:].tolist() == [0.0, *quality._sums(weights, one)]


def test_labelled_rows_are_laid_out_with_little_memory():
    rng = np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 1 << quality.TEXT_BITS, 6000)).astype(np.int32) for _ in range(1500)]
    parts[3] = parts[3][:0]
    v = quality.Views(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.zeros((1500, 1)))
    rows, y = np.arange(0, 1500, 2)[::-1], (np.arange(750) % 3 == 0).astype(float)
    tracemalloc.start()
    got = quality.Rows(v, rows, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    slots = np.concatenate([parts[r] for r in rows])
    owner = np.repeat(np.arange(750), [len(parts[r]) for r in rows])
    assert np.array_equal(got.known[got.slots], slots) and np.array_equal(got.of, owner[np.argsort(slots, kind="stable")])
    assert np.array_equal(got.counts[1], np.bincount(slots[y[owner] > 0.5], minlength=1 << quality.TEXT_BITS))
    assert peak < 110 << 20


def test_keep_one_judges_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(7, base, "a"), (3, base + " more", "b"), (7, "another text of this number", "c"), (9, "z y x", "d"), (9, "z y x", "d"), (None, base, "e"), (None, "nobody's own words here", "f"), (5, None, "g"), (5, "", "h"), (None, None, "i"), (None, "q r s", "j"), (None, "q r s", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").withColumns({"a": F.lit(1), "k1": F.lit("x"), "row.x": F.lit(2), "__rows": F.lit(None).cast("int")})
    got = keep_one(docs, 5, 8, 10)
    assert got.columns == docs.columns and sorted(r["mark"] for r in got.collect()) == list("bcdfghij")
    assert keep_one(docs.limit(0)).count() == 0


def test_jaccard_families_send_less_than_a_row_for_each_set(spark, monkeypatch):
    sent, connect_ = [], join.connect
    monkeypatch.setattr(join, "connect", lambda edges: sent.append(edges.count()) or connect_(edges))
    tokens = np.arange(40, dtype=np.uint64)
    own = spark.createDataFrame([(i, True, len(tokens), bytearray(join.sketch(tokens))) for i in range(60)], "idx long, able boolean, n long, sketch binary")
    members = spark.createDataFrame([(k, 0, i, len(tokens)) for k in range(3) for i in range(60)], "key long, least long, idx long, n long").coalesce(1)
    found = join._families(members, own, Rule(9, 10)).collect()
    assert {(r["idx"], r["family"]) for r in found} == {(i, 0) for i in range(60)}
    assert sent[0] <= 3 * 59  # all pairs of a key are 1,770


def test_jaccard_edges(spark):
    assert jaccard_components(docs_of(spark, ["a"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_components(rows).collect()), key=str)
    assert got == [(7, 7), (7, 7), (None, 7), (None, None)]


def test_keys_share_when_similar():
    rng = np.random.default_rng(5)
    rule, limit = Rule(8, 10), np.uint64(2**63)
    for _ in range(200):
        universe = rng.integers(1, 2**63, 60).astype(np.uint64) * np.uint64(2)
        counts = dict(zip(universe.tolist(), rng.integers(2, 60, 60).tolist()))
        x = np.unique(rng.choice(universe, 40))
        y = np.unique(np.concatenate([x[rng.permutation(len(x))[: len(x) - 2]], rng.choice(universe, 2)]))
        if 10 * len(np.intersect1d(x, y)) >= 8 * len(np.union1d(x, y)):
            a, b = (keys_of(s, np.array([counts[t] for t in s.tolist()]), len(s), rule, limit) for s in (x, y))
            assert len(np.intersect1d(a, b))


@pytest.mark.parametrize("local", [0, 10**6])
def test_connect(spark, monkeypatch, local):
    monkeypatch.setattr(components_module, "LOCAL", local)
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (2, 1)], "a long, b long")
    assert {r["v"]: r["label"] for r in connect(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}
    assert connect(edges.limit(0)).count() == 0


def test_connect_labels_equal_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 30, 200):
        a, b = rng.integers(0, n, (2, n))
        near = collections.defaultdict(set)
        for x, y in zip(a.tolist(), b.tolist()):
            near[x].add(y)
            near[y].add(x)
        v, label = components_module.labels_of(a, b)
        for x, least in zip(v.tolist(), label.tolist()):
            seen, todo = {x}, [x]
            while todo:
                for y in near[todo.pop()] - seen:
                    seen.add(y)
                    todo.append(y)
            assert least == min(seen)


# 3


def test_quality_held_out(spark, documents):
    rng = np.random.default_rng(1)
    texts, good = [], []
    for i in range(900):
        own = [f"w{rng.integers(300)}" for _ in range(40)]
        kind = i % 6
        if kind == 0:
            own = [x.upper() + "!!" for x in own]
        if kind == 1:
            own[rng.integers(40)] = "insult"
        texts.append(" ".join(own))
        good.append(int(kind > 1))
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 6 != 0), int(i % 6 == 1)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels).collect()}
    assert len(got) == 900 and np.mean([got[i] == bool(good[i]) for i in range(600, 900)]) > 0.95


def test_quality_edges(spark):
    docs = docs_of(spark, ODD).withColumn("keep", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, none)
    assert out.count() == len(ODD) and out.filter("keep").count() == len(ODD)
    assert quality.classify(docs.limit(0), none).count() == 0
    odd = docs.withColumns({"score": F.lit(7.5), "text_score": F.lit("mine"), "x.y": F.lit(1), "row": F.lit(2)})
    assert quality.keep_good(odd, none).columns == odd.columns and quality.keep_good(odd, none).filter("score = 7.5 AND keep = 'clash'").count() == len(ODD)
    assert "x.y" in quality.classify(odd, none).columns


def test_quality_learns_from_all_unlabelled_rows(spark):
    """Words that only a few unlabelled rows hold, last in the order of the hash, are learned from their pages."""
    rng = np.random.default_rng(2)
    ids = spark.range(3400).orderBy(F.xxhash64("id", F.lit(3)), "id").toPandas()["id"].tolist()
    labelled = set(ids[:400])
    rows = []
    for place, i in enumerate(ids):
        own, bad = [f"w{rng.integers(300)}" for _ in range(30)], i % 3 == 0
        if bad:
            own = [x.upper() + "!!" for x in (own if i % 4 else [*own[:-1], "awful"])]
            if place >= len(ids) - 200:
                own[:3] = ["ZORP!!", "BLIM!!", "QUAX!!"]
        rows.append((i, " ".join(own), "en", "s"))
    asked = [f"w{rng.integers(300)}" for _ in range(27)]
    rows += [(9000, " ".join(["zorp", "blim", "quax", *asked]), "en", "s"), (9001, " ".join(["new1", "new2", "new3", *asked]), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in labelled], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["text_score"] for r in quality.classify(docs, labels).filter("doc_id >= 9000").collect()}
    assert got[9000] < got[9001] - 0.1


def test_quality_sums_cover_every_unlabelled_row(spark):
    texts = [f"{'Bad' if i % 2 else 'good'} word{i % 7} w{i}" for i in range(3000)] + ODD
    docs = docs_of(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 10 < 9, F.col("doc_id")))
    known = spark.createDataFrame([(i,) for i in range(0, 100)], "doc_id long")
    rows = [r for r in docs.collect() if r["doc_id"] is None or r["doc_id"] >= 100]
    own = quality.views(*(pa.array([r[c] for r in rows], pa.string()) for c in ("text", "lang", "source")))
    own = own._replace(pages=own.pages.astype("<f4").astype(np.float64))
    sure = np.zeros(1 << quality.TEXT_BITS, np.float32)
    page = np.zeros(quality.PAGE_SIZE + 1)
    page[-1] = 9  # sure of every row
    model = quality.Model(sure, -9.0, page, np.array([[1.0, 0.0], [1.0, 0.0]]), np.zeros(4))
    got = quality._learn_from(quality._unlabelled(docs.repartition(5), known), [model], 0.98)
    assert got.n_words.tolist() == [0, len(rows)] and got.n_page.tolist() == [len(rows), 0]
    for a, b in zip(got, quality.add_up(own, [model], 0.98)):
        assert (a == b).all()


# 4


def naive_tiles(item, doc, least):
    """Greedy tiling by looking at every pair of places in every round."""
    free_a, free_b, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        tiles.append(best)
        free_a[i : i + n] = [False] * n
        free_b[j : j + n] = [False] * n


def test_tiling_equals_naive_tiling():
    assert tile(np.array([1, 2, 3, 4, 5, 6], np.uint64), np.array([4, 5, 6, 0, 1, 2, 3, 4], np.uint64), 2) == [(4, 0, 4), (2, 4, 1)]
    rng = np.random.default_rng(3)
    for k in range(150):
        a, b = (rng.integers(1, 2 + k % 5, rng.integers(0, 25)).astype(np.uint64) for _ in range(2))
        assert tile(a, b, 1 + k % 4) == naive_tiles(a.tolist(), b.tolist(), 1 + k % 4)


def naive_found(docs, items, least, threshold):
    """doc_id, item_id, covered words, tiles, longest tile of the pairs of documents and items that are found."""
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = set()
    for doc, text in docs:
        for item, asked in items:
            a, b = split(asked), split(text)
            tiles = naive_tiles(a, b, least) if len(a) >= least else []
            if tiles and sum(n for n, _, _ in tiles) >= threshold * len(a):
                out.add((doc, item, sum(n for n, _, _ in tiles), len(tiles), tiles[0][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "threshold"), [(3, 0.5), (4, 0.8), (2, 0.3)])
def test_decontamination_equals_naive_search(spark, least, threshold):
    rng = np.random.default_rng(least)
    word = lambda: f"w{int(rng.zipf(1.4)) % 60}"
    items = [(i % 9, " ".join(word() for _ in range(rng.integers(1, 30)))) for i in range(12)]
    docs = [(i, t) for i, t in enumerate(ODD[:-4])]
    for i in range(40):
        own = [word() for _ in range(rng.integers(0, 40))]
        for _ in range(rng.integers(0, 3)):
            asked = items[rng.integers(12)][1].split()
            cut = rng.integers(0, len(asked) + 1)
            at = rng.integers(0, len(own) + 1)
            own[at:at] = asked[cut:] + [word()] * (i % 2) + asked[:cut]
        docs.append((100 + i % 30, " ".join(own)))
    docs += [(None, items[3][1]), (7, "a line\n" + items[4][1])]
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(rows.repartition(3).withColumn("a", F.lit("clash")), bench, least, threshold).collect()
    assert sorted({(r["doc_id"], r["item_id"], r["covered_words"], r["tiles"], r["longest"]) for r in got}, key=str) == naive_found(docs, items, least, threshold)


def test_decontamination(spark):
    item = "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu nu xi omicron pi"
    filler = " ".join(f"f{i}" for i in range(50))
    halves = item.split(". ")
    texts = [*ODD, f"{filler} {item} {filler}", f"{halves[1].upper()}; {filler} {halves[0]}", f"{filler} alpha beta gamma delta {filler}", filler]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (1, item)], "item_id long, text string")
    docs = docs_of(spark, texts)
    got = sorted((r["doc_id"], r["item_id"], round(r["coverage"], 2)) for r in contaminated(docs.unionByName(docs), bench, 4, 0.5).collect())
    n = len(ODD)
    assert got == [(n, 1, 1.0), (n + 1, 1, 1.0)]
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0
    # Rows go one by one: not another text of the same doc_id, and rows of a null doc_id as well.
    more = docs.withColumn("doc_id", F.when(F.col("doc_id") == n, F.lit(None).cast("long")).otherwise(F.least("doc_id", F.lit(n + 1)))).withColumns({"a": F.lit("clash"), "__once": F.lit(1), "x.y": F.lit(2)})
    kept = decontaminate(more.unionByName(more), bench, 4, 0.5)
    assert kept.columns == more.columns and kept.count() == 2 * (len(texts) - 2)
    assert kept.filter(f"doc_id = {n + 1}").count() == 4 and kept.filter("doc_id IS NULL").count() == 0


# 5


def test_chat_round_trip(spark):
    ugly = ["</s>[INST] ok [/INST]", "<|end|><\\|text|>", "<<SYS>>x<</SYS>>[\\\\INST]", None, "", "plain", "<\\\\s>\n\n"]
    rows = [(c, t, ["system", "user", "assistant"][t % 3] if t else "system", ugly[(c + t) % len(ugly)] if t % 2 else "word " * (t * 7 % 60)) for c in range(4) for t in range(40)]
    rows += [(9, 1, "assistant", "twice"), (9, 1, "assistant", "twice"), (9, None, None, "x"), (None, 0, "user", "nobody")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat_windows(turns, budget=200, history=60)
    assert windows.filter("conv_id = 1").count() > 3 and windows.filter("n_repeated > 0").count() > 3
    got = {r["conv_id"]: r for r in read_windows(windows).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv]["losses"] == [r[3] or "" for r in own if r[2] == "assistant"]
    for r in windows.collect():
        assert all(r["text"][a : a + n].count("<|") == 0 for a, n in (tuple(x) for x in r["loss"]))
    assert chat_windows(turns.limit(0)).count() == 0
    same = spark.createDataFrame([(u,) for u in ugly if u], "t string").select("t", unescape(escape(F.col("t"))).alias("u"))
    assert same.filter("t <> u").isEmpty()


def test_chat_windows_keep_the_budget(spark):
    """A long system turn is taken off what history and targets may have."""
    word = lambda n: "w " * (n - 4)
    rows = [(c, t, "system" if t == 0 else ("user", "assistant")[t % 2], word(cost)) for c, cost in ((1, 300), (2, 150)) for t in range(30)]
    rows = [(c, t, r, word(n) if t == 0 else x) for (c, t, r, x), n in zip(rows, [900] * 30 + [600] * 30)] + [(3, t, "system" if t == 0 else "user", word(3000 if t == 0 else 40)) for t in range(9)]
    windows = chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=2048, history=512).collect()
    for r in windows:
        assert r["conv_id"] == 3 or r["tokens"] <= 2048
    assert sum(r["n_turns"] - r["n_repeated"] for r in windows) == len(rows)
    assert any(r["n_repeated"] > 1 for r in windows if r["conv_id"] == 2)


def test_op5_equals_brute_force(spark):
    got = {r["conv_id"]: r for r in QUERIES["op5_chat_format"](spark, SF).collect()}
    by = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by[r["conv_id"]].append((r["role"], r["text"] or ""))
    by[-1] = [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    assert set(got) == set(by)
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


# 6


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    ids = np.array([0, 1, 49407, 2**31, 2**32 - 1] * 13, dtype="<u4")
    assert (token_files.from_planes(token_files.to_planes(ids, kind), len(ids)) == ids).all()


def test_token_files_equal_tokenizer(spark, documents):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    texts = [*ODD, "l'eau 's don't I'M", "<|startoftext|> x<|ENDOFTEXT|>y <|endoftext|>", "İİ ΣΑΣ Étÿ", "é ́ a.́"]
    docs = docs_of(spark, texts).select("doc_id", "text").unionByName(documents.select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    manifest = token_files.write_tokens(docs.repartition(5), VOCABULARY)
    got, start = token_files.read_tokens(manifest).orderBy("start").collect(), 0
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    for r, row in zip(got, rows):
        ids = [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_token_file_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 16)
    w = token_files.Writer(f"file://{tmp_path}", "bit", 1)
    ids = np.arange(1000, dtype="<u4") * 7
    for a, b in ((0, 5), (5, 5), (5, 700), (700, 1000)):
        w.add(None if a == b else a, ids[a:b].tobytes())
    path, n, docs = w.close()
    r = token_files.Reader(path)
    assert (n, docs) == (1000, 4) and (r.ids(3, 777) == ids[3:777]).all() and len(r.ids(9, 9)) == 0
    assert [(d, len(x)) for d, x in r.documents()] == [(0, 5), (None, 0), (5, 695), (700, 300)]


def test_token_files_empty(spark):
    docs = docs_of(spark, ["x"]).limit(0)
    assert token_files.read_tokens(token_files.write_tokens(docs, VOCABULARY)).count() == 0


# 7


def test_url_filter(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("com", "/a", "block"), ("b.com", "", "allow"), ("com", "/a", "allow"), ("É.ORG", "/", "block")]
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    urls = [None, "", "nourl", "http://x.NET/q", "https://example.net/en/1?x#y", "http://a.example.net/en", "http://net", "http://net?x/", "http://b.com/a", "http://c.com/ab#", "http://notcom/a", "http://.com/a", "ftp://b.com", "http://X.com//a", "http://É.org/a", "http://x.É.Org/", "http://é.org/"]
    pages = spark.createDataFrame([(i % 12, u, "clash") for i, u in enumerate(urls * 2)], "page_id int, url string, rule string")
    got = url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.count() == 2 * len(urls)
    for r in got.collect():
        rest = r["url"].split("://", 1)[1] if r["url"] and "://" in r["url"] else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = lower(m[1]), m[2]
        fits = [(len(h + p), len(h), lower(h) + p, min(v for a, b, v in rules if (a, b) == (h, p))) for h, p, _ in rules if (host == lower(h) or host.endswith("." + lower(h))) and path.startswith(p)] if host else []
        best = max(fits, default=(0, 0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[2], best[3])
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter(pages, none).filter("verdict <> 'allow'").isEmpty() and url_filter(pages.limit(0), none).count() == 0


def test_url_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(map(str, con.execute(ORACLES["op7_url_filter"]).fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES["op7_url_filter"](spark, SF).collect()) == want


# 8


def test_mix(spark, documents):
    docs = documents.select("doc_id", "text", "source").unionByName(docs_of(spark, ODD).select((F.col("doc_id") + 10**6).alias("doc_id"), "text", "source"))
    rows = mix(docs).collect()
    again = {(r["doc_id"], r["size"]): r["copies"] for r in mix(docs.repartition(7)).collect()}
    assert len(rows) == docs.count() and all(again[r["doc_id"], r["size"]] == r["copies"] <= 2 for r in rows)
    sizes, got, goal, texts = collections.Counter(), collections.Counter(), {}, {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or ""))
        sizes[r["source"]] += r["size"]
        got[r["source"]] += r["size"] * r["copies"]
        goal[r["source"]] = r["target"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, want = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            want |= share
            break
        for s in above:
            want[s] = 2 * sizes[s]
            left -= want[s]
            free.discard(s)
    for s in order:
        assert math.isclose(goal[s], want[s], rel_tol=1e-9)
        # A source can't come nearer than its documents allow: half of the largest, where small ones are few.
        assert abs(got[s] - want[s]) <= max(r["size"] for r in rows if r["source"] == s) / 2 + 0.01 * want[s]
    copies = collections.Counter(r["doc_id"] for r in apply_mix(docs.withColumn("copies", F.lit("clash"))).collect())
    assert copies == collections.Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def test_mix_edges(spark):
    docs = docs_of(spark, ODD)
    assert apply_mix(docs.limit(0)).count() == 0
    twice = docs.unionByName(docs)
    assert apply_mix(twice).columns == docs.columns
    assert apply_mix(twice).count() == sum(r["copies"] for r in mix(twice).collect())


# 9


def test_katz_equals_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 3000)
    monkeypatch.setattr(lm, "RANGE", 700)
    docs = documents.select("doc_id", "text").unionByName(docs_of(spark, ODD).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    model = lm.katz(docs, F.col("doc_id") % 5 != 2)
    got = {r["doc_id"]: r for r in model.scores.collect()}
    tokens = {r["doc_id"]: [*words(r["text"]), None] for r in docs.collect()}
    uni, pair, seen = collections.Counter(), collections.Counter(), collections.Counter()
    for i, ws in tokens.items():
        if i % 5 != 2:
            before = ["\n", *ws[:-1]]
            uni.update(ws)
            pair.update(zip(before, ws))
            seen.update(before)
    n, v = sum(uni.values()), len(uni)

    def discounts(counts):
        return lm.discounts([sum(c == r for c in counts.values()) for r in range(1, lm.K + 2)])

    du, dp = discounts(uni), discounts(pair)
    unknown = sum(c * (1 - du[min(c, lm.K + 1)]) for c in uni.values()) / n
    p1 = lambda w: du[min(uni[w], lm.K + 1)] * uni[w] / n if uni[w] else unknown
    mass, lost = collections.Counter(), collections.Counter()
    for (h, w), c in pair.items():
        mass[h] += p1(w)
        lost[h] += (1 - dp[min(c, lm.K + 1)]) * c

    def p2(h, w):
        if not seen[h]:
            return p1(w)
        z, left = (seen[h], lost[h]) if lost[h] > 0 else (seen[h] + 1, 1)
        c = pair[h, w]
        return dp[min(c, lm.K + 1)] * c / z if c else left / z / (1 - mass[h]) * p1(w)

    for i, ws in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(uni[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p2(h, w)) for h, w in zip(["\n", *ws[:-1]], ws)), rel_tol=1e-9)
    for h in ("the", "\n", list(uni)[0]):
        assert math.isclose(sum(p2(h, w) for w in uni) + p2(h, "never seen"), 1, rel_tol=1e-9)
    assert model.counts.count() > 1 and model.weights.count() > 0


@pytest.mark.parametrize("order", [3, 4])
def test_katz_of_higher_order_equals_recursion(spark, documents, monkeypatch, order):
    monkeypatch.setattr(lm, "CHUNK", 3000)
    monkeypatch.setattr(lm, "RANGE", 700)
    docs = documents.select("doc_id", "text").limit(60).unionByName(docs_of(spark, ODD).select((F.col("doc_id") + 10**6).alias("doc_id"), "text")).cache()
    model = lm.katz(docs, F.col("doc_id") % 5 != 2, order=order)
    got = {r["doc_id"]: r for r in model.scores.collect()}
    tokens = {r["doc_id"]: [*words(r["text"]), None] for r in docs.collect()}
    count, seen, after = [collections.Counter() for _ in range(order + 1)], collections.Counter(), collections.defaultdict(set)
    runs = lambda ws: [tuple((["\n"] * (order - 1) + ws)[i : i + order]) for i in range(len(ws))]
    for i, ws in tokens.items():
        for run in runs(ws) if i % 5 != 2 else []:
            for m in range(1, order + 1):
                count[m][run[order - m :]] += 1
                seen[run[order - m : -1]] += 1
                after[run[order - m : -1]].add(run[-1])
    d = [None, *(lm.discounts([sum(c == r for c in count[m].values()) for r in range(1, lm.K + 2)]) for m in range(1, order + 1))]
    off = lambda m, c: d[m][min(c, lm.K + 1)]
    n, memo = sum(count[1].values()), {}
    unknown = sum(c * (1 - off(1, c)) for c in count[1].values()) / n

    def p(run):
        m, h, c = len(run), run[:-1], count[len(run)][run]
        if m == 1:
            return off(1, c) * c / n if c else unknown
        if not seen[h]:
            return p(run[1:])
        if h not in memo:
            lost = sum((1 - off(m, count[m][(*h, w)])) * count[m][(*h, w)] for w in after[h])
            z, left = (seen[h], lost) if lost > 0 else (seen[h] + 1, 1)
            memo[h] = z, left / z / (1 - sum(p((*h[1:], w)) for w in after[h]))
        z, alpha = memo[h]
        return off(m, c) * c / z if c else alpha * p(run[1:])

    for i, ws in tokens.items():
        assert math.isclose(got[i]["score"], sum(math.log10(p(run)) for run in runs(ws)), rel_tol=1e-7)


def test_katz_edges(spark):
    docs = docs_of(spark, ODD)
    assert lm.katz(docs.limit(0), F.lit(True)).scores.count() == 0
    nothing = lm.katz(docs, F.lit(False)).scores.collect()
    assert len(nothing) == len(ODD) and all(r["n_known"] == 0 and r["score"] <= 0 for r in nothing)


# 10


def test_media_round_trip(spark):
    texts = [*ODD, "n" * 64, "n" * 65]
    folder = media.write_media(docs_of(spark, texts).repartition(3))
    rows = media.read_media(spark, folder, range_bytes=3000).collect()
    assert len(rows) == len(texts) and all(r["error"] is None and r["attempts"] == 1 for r in rows)
    for r in rows:
        text = (texts[int(r["member"].split("-")[0])] or "").encode()
        samples, n = media.from_png(bytes(r["media"]))
        assert n == len(text) and samples == text.ljust(max(64, -(-n // 64) * 64), b"\0")
    empty = media.write_media(docs_of(spark, texts).limit(0))
    assert media.read_media(spark, empty).count() == 0


def test_media_retries_members_alone(spark):
    folder = media.write_media(docs_of(spark, ["abc", "def", "ghi"]).coalesce(1))
    reader = media.MediaReader({"path": folder, "retries": "2"})
    calls, whole = collections.Counter(), media.MediaReader.member

    def flaky(self, file, info):
        calls[info.filename] += 1
        if info.filename.startswith("1-") and calls[info.filename] < 3 or info.filename.startswith("2-"):
            raise OSError("lost")
        return whole(self, file, info)

    reader.member = flaky.__get__(reader)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["member"][:1], r["attempts"], r["media"] is None, r["error"]) for r in rows] == [("0", 1, False, None), ("1", 3, False, None), ("2", 3, True, "lost")]
    assert calls["0-00000000.png"] == 1


def test_media_damage_costs_one_member(spark, tmp_path):
    folder = media.write_media(docs_of(spark, ["abc" * 50, "def" * 50, "ghi" * 50]).coalesce(1))
    path = next(Path(folder.removeprefix("file://")).glob("*.zip"))
    whole = path.read_bytes()
    second = whole.index(b"PK\x03\x04", 4)
    path.write_bytes(whole[:second] + b"XXXX" + whole[second + 4 :])
    read = lambda: [r for p in media.MediaReader({"path": folder, "retries": "1"}).partitions() for b in media.MediaReader({"path": folder, "retries": "1"}).read(p) for r in b.to_pylist()]
    assert [(r["attempts"], r["media"] is None, r["error"] is None) for r in read()] == [(1, False, True), (2, True, False), (1, False, True)]
    path.write_bytes(whole[:second])  # cut off, and so without a directory
    assert [(r["member"], r["media"], r["attempts"]) for r in read()] == [(None, None, 2)]
    reader = media.MediaReader({"path": folder})
    short = zipfile.ZipInfo("x")
    short.header_offset = 0
    with pytest.raises(OSError, match="no header"):
        reader.member(io.BytesIO(b"PK"), short)


def test_op10_equals_brute_force(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op10_media_archives"](spark, SF).collect()}
    by_text = collections.defaultdict(set)
    assert len(got) == documents.count()
    for doc in documents.collect():
        r, raw = got[doc["doc_id"]], (doc["text"] or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        image = media.to_png(raw)
        x = list(padded)
        feature = f"sum={sum(x)};squares={sum(b * b for b in x)};crossings={sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:]))}"
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), feature)
        by_text[doc["text"]].add((r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in by_text.values())
