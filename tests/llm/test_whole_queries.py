"""The queries op2, op4, op6, op8 and op9 as they are, over the whole smallest tables."""

import collections
import math
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graniq.llm.decontaminate import tile
from graniq.llm.queries import ORACLES, QUERIES
from graniq.llm.words import word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    return {d: (t or "", s) for d, t, s in duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()}


def test_op2_equals_sql(spark, documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({ORACLES['op2_jaccard_join']})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["op2_jaccard_join"](spark, SF).select("doc_id", "n_shingles", "component_id").collect()) == want
    assert any(d != c for d, _, c in want)


def test_op4_equals_tiling_of_all_pairs(spark, documents):
    """Every document against every item, without seeds, a join or an index; tile itself is held against naive tiling elsewhere."""
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    split = lambda texts: word_hashes(pa.array(texts), punctuation=False)
    d, i = split([t for t, _ in documents.values()]), split([t or "" for _, t in items])
    rows = lambda w: [w.hashes[a:b] for a, b in zip(w.offsets, w.offsets[1:])]
    want = set()
    for doc, own in zip(documents, rows(d)):
        for (item, _), asked in zip(items, rows(i)):
            if len(asked) >= 4 and len(np.intersect1d(own, asked)) * 2 >= len(np.unique(asked)) / 2:
                tiles = tile(asked, own, 4)
                covered = sum(n for n, _, _ in tiles)
                if covered >= 0.5 * len(asked):
                    want.add((doc, item, covered))
    got = {(r["doc_id"], r["item_id"], r["covered_words"]) for r in QUERIES["op4_decontaminate"](spark, SF).collect()}
    assert got == want and want


def test_op6_equals_the_tokenizer(spark, documents):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for doc in sorted(documents):
        ids = [*model.encode(documents[doc][0], add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op6_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op8_equals_its_contract(spark, documents):
    rows = QUERIES["op8_mixing"](spark, SF).collect()
    size = {d: len(WORD.findall(t)) for d, (t, _) in documents.items()}
    per, taken, most = collections.Counter(), collections.Counter(), collections.Counter()
    for d, (_, s) in documents.items():
        per[s] += size[d]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, want = 1.5 * sum(per.values()), set(order), {}
    while above := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * per[s]}:
        for s in above:
            want[s] = 2.0 * per[s]
        left -= sum(want[s] for s in above)
        free -= above
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        s = documents[r["doc_id"]][1]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], per[s]) and math.isclose(r["target"], want[s], rel_tol=1e-9)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    for s in order:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 0.01 * want[s]
    again = QUERIES["op8_mixing"](spark, SF).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_op9_equals_its_contract(spark, documents):
    tokens = {d: [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)), None] for d, (t, _) in documents.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in documents}
    counts = collections.Counter(w for d, own in tokens.items() if not held[d] for w in own)
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op9_katz"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    gain = 0.0
    for r in rows:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(counts[w] > 0 for w in own), n)
        base = math.fsum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in own)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9) and -math.inf < r["score"] < 0
        gain += (r["score"] - r["base_score"]) * (not held[r["doc_id"]])
    assert gain > 0  # the model knows more of what it has learned from than single words tell
