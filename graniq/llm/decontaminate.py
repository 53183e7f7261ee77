"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits (ASCII marks separate, A-Z lower-cased). Runs of
``min_match`` words of the benchmark are seeds, a table. As tiles must cover ``threshold`` of an
item, a document that covers it has many of the item's seeds, so the item's most common ones need
no entry. One pass over the documents, whatever the size of the benchmark, gives the runs that a
bitmap of seeds lets through; a join by seed leaves documents with the items that they may cover,
and only the texts of these are shuffled.

For each of them, tiling by running Karp-Rabin repeatedly marks the longest match of unmarked
words in both texts: hashes of windows of any length come from prefix sums, the greatest length
with a match is found by halving, and windows of equal hash are compared word by word. The share
of the item's words under tiles is its coverage; passages in another order cover as much.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graniq.llm.rows import FILTER_BITS, bitmaps, possible, row_key, without
from graniq.llm.storage import bounded_batches, materialize
from graniq.llm.words import U64, gram_hashes, word_hashes

FOUND = "doc_id long, item_id long, item_words long, covered_words long, tiles long, longest long, coverage double"
_NAMES = [x.split()[0] for x in FOUND.split(", ")]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Windows:
    """Words, marks of those under tiles, and the hashes of windows of any length."""

    def __init__(self, words: np.ndarray):
        self.words, self.free = words, np.ones(len(words), bool)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64)])
        self.shift = _powers(_INVERSE, len(words))

    def open(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of each window without marks."""
        marks = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marks[length:] == marks[:-length])
        return (self.sums[at + length] - self.sums[at]) * self.shift[at], at


def _meet(item: Windows, doc: Windows, length: int) -> list[tuple[int, list[int]]]:
    """Places in the item, ascending, each with those in the document where the same words are, ascending."""
    a, at = item.open(length)
    b, by = doc.open(length)
    same = np.isin(b, a)
    where = defaultdict(list)
    for h, j in zip(b[same].tolist(), by[same].tolist()):
        where[h].append(j)
    out = []
    for h, i in zip(a.tolist(), at.tolist()):
        own = item.words[i : i + length]
        if places := [j for j in where.get(h, ()) if np.array_equal(doc.words[j : j + length], own)]:
            out.append((i, places))
    return out


def tile(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (length, item place, document place), the longest first; of equal ones that with the least item place, then document place."""
    a, b, tiles = Windows(item), Windows(doc), []
    most = min(len(item), len(doc))
    while most >= min_match:
        low, high, met = min_match - 1, most, []  # a match of some length holds one of every lesser length
        while low < high:
            middle = (low + high + 1) // 2
            if found := _meet(a, b, middle):
                low, met = middle, found
            else:
                high = middle - 1
        for i, places in met:
            if a.free[i : i + low].all():
                j = next((j for j in places if b.free[j : j + low].all()), None)
                if j is not None:
                    a.free[i : i + low] = b.free[j : j + low] = False
                    tiles.append((low, i, j))
        most = low - 1 if met else 0
    return tiles


def _stretches(doc: np.ndarray, grams: np.ndarray, seeds: np.ndarray, min_match: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of the document that lie in runs of an item's seeds, a word that occurs nowhere between such stretches; and which seeds there are."""
    at = np.flatnonzero(np.isin(grams, seeds))
    reach = np.zeros(len(doc) + 1, dtype=np.int64)
    reach[at] += 1
    np.add.at(reach, at + min_match, -1)
    inside = np.cumsum(reach)[:-1] > 0
    starts = inside & ~np.concatenate([[False], inside[:-1]])
    # Seeds side by side may be no run of the item; a tile ends where its words end to be equal.
    kept = np.flatnonzero(inside)
    return np.insert(doc[kept], np.flatnonzero(starts[kept]), U64(0)), np.unique(grams[at])


def coverage(item: np.ndarray, doc: np.ndarray, grams: np.ndarray, min_match: int, threshold: float) -> tuple[int, int, int] | None:
    """Words under tiles, number of tiles and the longest, if they cover ``threshold`` of the item. grams: the document's runs of min_match words."""
    own = gram_hashes(item, min_match)
    words, seen = _stretches(doc, grams, own, min_match)
    reach = np.zeros(len(item) + 1, dtype=np.int64)  # words that any seed covers bound the coverage
    held = np.flatnonzero(np.isin(own, seen))
    reach[held] += 1
    np.add.at(reach, held + min_match, -1)
    if np.count_nonzero(np.cumsum(reach)[:-1]) < threshold * len(item):
        return None
    tiles = tile(item, words, min_match)
    covered = sum(n for n, _, _ in tiles)
    return (covered, len(tiles), tiles[0][0]) if tiles and covered >= threshold * len(item) else None


def _items(benchmark: DataFrame, min_match: int) -> DataFrame:
    """ia, ib (key), item_id, n, words, seeds (distinct) and how often each occurs, of the items with at least min_match words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, rows = word_hashes(batch.column(3), punctuation=False), []
            for key, a, b in zip(zip(*(batch.column(i).to_pylist() for i in range(3))), w.offsets, w.offsets[1:]):
                if b - a >= min_match:
                    own = w.hashes[a:b]
                    seeds, times = np.unique(gram_hashes(own, min_match), return_counts=True)
                    rows.append((*key, int(b - a), own.tobytes(), seeds.view(np.int64), times))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["ia", "ib", "item_id", "n", "words", "seeds", "times"])

    key = [F.xxhash64("item_id", "text").alias("ia"), F.xxhash64(F.lit(7), "text", "item_id").alias("ib")]
    rows = benchmark.filter(F.col("text").isNotNull()).select(*key, F.col("item_id").cast("long").alias("item_id"), "text")
    found = rows.mapInArrow(run, "ia long, ib long, item_id long, n long, words binary, seeds array<long>, times array<long>")
    return materialize(found.dropDuplicates(["ia", "ib"]), "bench-items")


def _index(items: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """seed, ia, ib: of each item all seeds but its most common ones, as far as no covering document can do with these alone."""
    each = items.select("ia", "ib", "n", F.explode(F.arrays_zip("seeds", "times")).alias("s")).select("ia", "ib", "n", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"))
    often = each.groupBy("seed").agg(F.count("*").alias("items"))
    # Tiles of some words have at least that number / min_match places of seeds.
    need = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * threshold) / min_match))
    common_first = Window.partitionBy("ia", "ib").orderBy(F.desc("items"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    return each.join(often, "seed").withColumn("sum", F.sum("times").over(common_first)).filter(F.col("sum") >= need).select("seed", "ia", "ib")


def _seeds_of(rows: DataFrame, bits: bytes, min_match: int) -> DataFrame:
    """a, b, seed: the distinct runs of each row that the bitmap lets through."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            w = word_hashes(batch.column(2), punctuation=False)
            grams = gram_hashes(w.hashes, min_match)
            place = (grams & U64(FILTER_BITS - 1)).astype(np.int32)
            at = np.flatnonzero(seen[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            row = np.searchsorted(w.offsets, at, side="right") - 1
            ok = at + min_match <= w.offsets[row + 1]
            if ok.any():
                pairs = np.unique(np.rec.fromarrays([row[ok], grams[at[ok]]], names="row,seed"))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs.row)), batch.column(1).take(pa.array(pairs.row)), pa.array(pairs.seed.view(np.int64))], names=["a", "b", "seed"])

    return rows.select("a", "b", "text").mapInArrow(run, "a long, b long, seed long")


def found_in(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5) -> DataFrame:
    """FOUND with the key of the row, a and b."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = _items(benchmark, min_match)
    index = materialize(_index(items, min_match, threshold), "bench-index")
    bits = bytearray(FILTER_BITS // 8)  # the bitmap is of a fixed size, whatever that of the benchmark
    for r in bitmaps(index, "seed").collect():
        at = (r["__bucket"] - 1) * len(r["__bits"])
        bits[at : at + len(r["__bits"])] = r["__bits"]
    met = _seeds_of(rows, bytes(bits), min_match).join(index, "seed").select("a", "b", "ia", "ib").distinct()
    asked = met.join(items.select("ia", "ib", "item_id", "words"), ["ia", "ib"]).groupBy("a", "b").agg(F.collect_list(F.struct("item_id", "words")).alias("items"))
    asked = materialize(asked, "bench-asked")
    texts = possible(rows, asked)[0].groupBy("a", "b").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 8 + [pa.float64()]
        for batch in batches:
            w, out = word_hashes(batch.column(3), punctuation=False), []
            for i in range(batch.num_rows):
                doc = w.hashes[w.offsets[i] : w.offsets[i + 1]]
                grams = gram_hashes(doc, min_match)
                for asked in batch.column(4)[i].as_py():
                    item = np.frombuffer(asked["words"], np.uint64)
                    if c := coverage(item, doc, grams, min_match, threshold):
                        out.append((*(batch.column(k)[i].as_py() for k in range(3)), asked["item_id"], len(item), *c, c[0] / len(item)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["a", "b", *_NAMES])

    return materialize(texts.join(asked, ["a", "b"]).mapInArrow(search, f"a long, b long, {FOUND}"), "contaminated")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5) -> DataFrame:
    """One row per document and item with coverage of at least ``threshold``: FOUND.

    docs: doc_id, text. benchmark: item_id, text. Null and empty texts, and items of fewer
    than min_match words, meet nothing. Rows are told apart by id and text: documents equal in
    both are one, and so are items; another text under the same id is judged by itself. Null
    ids are kept. Other columns are ignored.
    """
    return found_in(docs, benchmark, min_match, threshold).select(*_NAMES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, but those that contain benchmark items."""
    return without(docs, found_in(docs, benchmark, min_match, threshold).select("a", "b").distinct())
