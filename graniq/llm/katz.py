"""Katz backoff language model with Good-Turing discounts, fitted and evaluated by exchange.

P(w | h) = d(c) * c / c(h) where the words of h and w were seen c times in training, else
alpha(h) * P(w | h without its first word); P(w) = d(c) * c / N, and the mass that this leaves is that of one unknown
word. Discounts follow Good and Turing up to K, and alpha(h) is the mass that the pairs of h
leave, over the lower order's mass of the words not seen after h: every distribution sums to one. A history
whose pairs leave no mass has its count raised by one, so that no word gets probability 0.

Documents are cut into chunks of some million tokens, stored once. A chunk sends each distinct
word, pair and longer run once, with its training count, to the owner of its hash range; the owner adds
up, keeps the counts as its part of the model's tables, and answers. So a word that is a
third of all tokens costs one entry a chunk. Of the chunks that sent a pair, one is told to
add it to its history's sums, which meet, again by hash range, in the table of backoff
weights, from the shortest histories to the longest, as each needs the order below. With
these answers a chunk evaluates its tokens recursively.

A hash has 48 bits besides the number of its range; ranges grow in number with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graniq.llm.storage import bounded_batches, materialize
from graniq.llm.words import U64, mix, word_hashes

CHUNK, RANGE = 1_500_000, 1_000_000
#: Counts above K are not discounted.
K = 5
END, BEGIN = U64(0x0E4D), U64(0xBE61)
_LOW = U64((1 << 48) - 1)

ANSWERS = "kind int, bucket int, chunk long, a binary, b binary"
_ANSWERS = ["kind", "bucket", "chunk", "a", "b"]


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """The low 48 bits of sorted keys of one range."""
    low = keys & _LOW
    return (low & U64(0xFFFFFFFF)).astype("<u4").tobytes() + (low >> U64(32)).astype("<u2").tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw[4 * n :], dtype="<u2").astype(np.uint64) << U64(32) | np.frombuffer(raw[: 4 * n], dtype="<u4").astype(np.uint64)


def _planes(ids: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _ids(raw: bytes) -> np.ndarray:
    planes = unpack(raw, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


class Grams(NamedTuple):
    """Distinct runs of some words: key, the run without its last word (of the level below), the last word, the run without its first word (of the level below); each token's run; and the order of the keys. Run 0 is that of beginnings alone."""

    key: np.ndarray
    history: np.ndarray
    word: np.ndarray
    lower: np.ndarray
    of: np.ndarray
    order: np.ndarray


def _next(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(key * U64(0x9E3779B97F4A7C15) + word * U64(0xC2B2AE3D27D4EB4F))


class Chunk(NamedTuple):
    """Documents, their token counts and training marks; words by hash, and each token's word. Word 0 is the beginning of a text, word 1 its end."""

    docs: list
    train: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    tokens: np.ndarray

    def grams(self, order: int) -> list[Grams]:
        """Runs of 1 to ``order`` words."""
        own = np.arange(len(self.words))
        levels = [Grams(self.words, own, own, own, self.tokens, np.argsort(self.words))]
        starts = np.cumsum(self.counts)[:-1]
        for _ in range(order - 1):
            below = levels[-1]
            before = np.concatenate([[0], below.of[:-1]]).astype(np.int64)
            before[starts] = 0
            runs, of = np.unique(np.concatenate([[0], before << 32 | self.tokens]), return_inverse=True)  # no token is a beginning, so the first is run 0
            del before
            of = of[1:].astype(np.int32)
            history, word = (runs >> 32).astype(np.int32), (runs & 0xFFFFFFFF).astype(np.int32)
            del runs
            lower = np.zeros(len(word), dtype=np.int32)
            lower[of] = below.of
            key = _next(below.key[history], self.words[word])
            levels.append(Grams(key, history, word, lower, of, np.argsort(key).astype(np.int32)))
        return levels

    def learned(self) -> np.ndarray:
        """Whether each token is one of training."""
        return np.repeat(self.train, self.counts)


def _chunks(docs: DataFrame, train: Column) -> DataFrame:
    """chunk, docs (array), train, counts, words, tokens."""

    def row(part: list) -> pa.RecordBatch:
        docs, train, counts, hashes = (sum((p[0] for p in part), []), *(np.concatenate([p[i] for p in part]) for i in (1, 2, 3)))
        words, tokens, n = np.unique(hashes, return_inverse=True, return_counts=True)
        n[np.isin(words, [BEGIN, END])] = 0
        order = np.argsort(-n, kind="stable")  # frequent words have small numbers
        order = order[~np.isin(words[order], [BEGIN, END])]
        number = np.zeros(len(words), dtype=np.int64)
        number[order] = np.arange(len(order)) + 2
        number[words == END] = 1
        words = np.concatenate([[BEGIN, END], words[order]])
        columns = [pa.array([docs], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (train.tobytes(), counts.astype("<i8").tobytes(), words.tobytes(), _planes(number[tokens])))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([int(counts.sum())], pa.int64())], names=["docs", "train", "counts", "words", "tokens", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for batch in batches:
            w = word_hashes(batch.column(1))
            counts = np.diff(w.offsets) + 1
            hashes = np.insert(w.hashes, w.offsets[1:], END)
            part.append((batch.column(0).to_pylist(), np.array(batch.column(2).to_pylist(), dtype=bool), counts, hashes))
            size += len(hashes)
            if size >= CHUNK:
                yield row(part)
                part, size = [], 0
        if part:
            yield row(part)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.coalesce(train, F.lit(True)))
    cut = rows.mapInArrow(run, "docs array<long>, train binary, counts binary, words binary, tokens binary, n long")
    return materialize(cut.withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks")


def _read(row: dict) -> Chunk:
    return Chunk(row["docs"], np.frombuffer(row["train"], dtype=bool), np.frombuffer(row["counts"], dtype="<i8"), np.frombuffer(row["words"], dtype=np.uint64), _ids(row["tokens"]))


def _split(keys: np.ndarray, bits: int, *values: np.ndarray) -> Iterator[tuple]:
    """Sorted keys and what goes with them, by range; the empty ranges left out."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << U64(64 - bits)) if bits else np.zeros(0, np.int64)
    for b, parts in enumerate(zip(*(np.split(x, cuts) for x in (keys, *values)))):
        if len(parts[0]):
            yield b, *parts


def _bits(n: float) -> int:
    return max(0, math.ceil(math.log2(max(1.0, n / RANGE))))


def _count(chunks: DataFrame, bits: list[int]) -> DataFrame:
    """Training counts of runs of each length (the kind): answers to chunks, the model's tables (chunk -1: keys, counts), and statistics (chunk -2: types and tokens, numbers of types seen 1 to K + 1 times)."""
    begins = [np.array([BEGIN])]
    for _ in bits[1:]:
        begins.append(_next(begins[-1], begins[0]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _read(row)
                learned = c.learned()
                for kind, g in enumerate(c.grams(len(bits)), 1):
                    n = np.bincount(g.of[learned], minlength=len(g.key))
                    n[0] = int(c.train.sum()) if kind == 1 or kind < len(bits) else 0
                    parts = [(kind, b, row["chunk"], pack_keys(x), pack(y.astype("<i8"))) for b, x, y in _split(g.key[g.order], bits[kind - 1], n[g.order])]
                    for i in range(0, len(parts), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts[i : i + 64]), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=_ANSWERS)

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        kind, bucket = rows[0]["kind"], rows[0]["bucket"]
        asked = [unpack_keys(r["a"]) for r in rows]
        keys, first, at = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([unpack(r["b"], "<i8") for r in rows])).astype(np.int64)
        owner = np.zeros(len(at), dtype=bool)
        owner[first] = True  # the first chunk that sent the key
        owner &= total[at] > 0
        out, k = [], 0
        for r, own in zip(rows, asked):
            part = slice(k, k + len(own))
            out.append((kind, bucket, r["chunk"], pack(total[at[part]].astype("<i8")), pack(np.packbits(owner[part]))))
            k += len(own)
        seen = total > 0
        out.append((kind, bucket, -1, pack_keys(keys[seen]), pack(total[seen].astype("<i8"))))
        begin, bit = begins[kind - 1][0], bits[kind - 1]
        here = not bit or bucket == int(begin >> U64(64 - bit))
        words = total[keys != begin & _LOW] if here else total
        stats = np.concatenate([[np.count_nonzero(words), words.sum()], np.bincount(np.minimum(words, K + 2), minlength=K + 3)[1 : K + 2]])
        out.append((kind, bucket, -2, stats.astype("<i8").tobytes(), b""))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=_ANSWERS)

    return chunks.mapInArrow(ask, ANSWERS).groupBy("kind", "bucket").applyInArrow(add, ANSWERS)


def discounts(seen: list[int]) -> np.ndarray:
    """d(0) to d(K + 1), of which d(0) = 0 and the last holds for all greater counts.

    seen: the numbers of types seen 1 to K + 1 times. Where the counts are too few for Good
    and Turing (a factor not between 0 and 1), the factor is that of taking off one half.
    """
    d = np.ones(K + 2)
    d[0] = 0
    common = (K + 1) * seen[K] / seen[0] if seen[0] else 0.0
    for r in range(1, K + 1):
        good = ((r + 1) * seen[r] / (r * seen[r - 1]) - common) / (1 - common) if seen[r - 1] and common < 1 else 0.0
        d[r] = good if 0 < good < 1 else (r - 0.5) / r
    return d


class Level(NamedTuple):
    types: int
    tokens: int
    d: np.ndarray
    unknown: float  # the mass of the unknown word


def _level(rows: list) -> Level:
    total = np.sum([np.frombuffer(r["a"], dtype="<i8") for r in rows], axis=0) if rows else np.zeros(K + 3, np.int64)
    types, tokens, seen = int(total[0]), int(total[1]), total[2 : K + 3].tolist()
    d = discounts(seen)
    left = sum(n * r * (1 - d[r]) for r, n in enumerate(seen[:K], 1))
    if tokens and left <= 0:  # no rare words at all: one count is put aside
        d = d * tokens / (tokens + 1)
        left = tokens / (tokens + 1)
    return Level(types, tokens, d, left / tokens if tokens else 1.0)


def _answers(right: pa.Table, kind: int) -> list[dict]:
    return sorted((r for r in right.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])


def _joined(rows: list[dict], column: str, kind, g: Grams) -> np.ndarray:
    """What the owners answered, in the order of the chunk's runs."""
    out = np.empty(len(g.key), dtype=kind)
    out[g.order] = np.concatenate([unpack(r[column], kind) for r in rows])
    return out


class Known(NamedTuple):
    """Of each run of a level: its count, whether the chunk adds it up, its last word's probability after the others, and that of the unknown word after the run's own last words (of the level below)."""

    count: np.ndarray
    owned: np.ndarray
    p: np.ndarray
    unknown: np.ndarray


def _known(grams: list[Grams], right: pa.Table, levels: list[Level], weighed: int) -> list[Known]:
    """Of each level that has its backoff weights, ``weighed`` of them, and the next, evaluated; of all further levels counts only."""
    out: list[Known] = []
    for kind, g in enumerate(grams, 1):
        rows = _answers(right, kind)
        count = _joined(rows, "a", "<i8", g)
        owned = np.empty(len(count), dtype=bool)
        sizes = [len(unpack(r["a"], "<i8")) for r in rows]
        owned[g.order] = np.concatenate([np.unpackbits(unpack(r["b"], np.uint8), count=n).astype(bool) for r, n in zip(rows, sizes)])
        owned[0] = False
        d = levels[kind - 1].d[np.minimum(count, K + 1)]
        if kind == 1:
            p = np.where(count > 0, d * count / max(1, levels[0].tokens), levels[0].unknown)
            unknown = np.full(len(count), levels[0].unknown)
        elif kind <= weighed + 1:
            below, weights = out[-1], _answers(right, 1 - kind)
            alpha, more = (_joined(weights, c, t, grams[kind - 2]) for c, t in (("a", np.float64), ("b", np.uint8)))
            p = np.where(count > 0, d * count / np.maximum(below.count[g.history] + more[g.history].astype(np.float64), 1), alpha[g.history] * below.p[g.lower])
            unknown = (alpha * below.unknown)[g.lower]
        else:
            p = unknown = np.zeros(0)
        out.append(Known(count, owned, p, unknown))
    return out


def _weigh(chunks: DataFrame, answers: DataFrame, levels: list[Level], length: int, bits: int) -> DataFrame:
    """Backoff weights of histories of some length (the kind is less than 0): answers to chunks (a: weights; b: what is added to the count), and the table (chunk -1)."""
    top = levels[length]

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            grams = _read(row).grams(length + 1)
            known = _known(grams, right, levels, length - 1)
            g, h, n, owned = grams[length], grams[length - 1], known[length].count, known[length].owned
            at, own = g.history[owned], known[length - 1]
            lost = np.bincount(at, weights=((1 - top.d[np.minimum(n, K + 1)]) * n)[owned], minlength=len(h.key))
            mass = np.bincount(at, weights=own.p[g.lower[owned]], minlength=len(h.key))
            for b, key, *sums in _split(h.key[h.order], bits, *(x[h.order] for x in (lost, mass, own.count.astype(np.float64), own.unknown))):
                out.append((-length, b, row["chunk"], pack_keys(key), pack(np.concatenate(sums))))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=_ANSWERS)

    def weigh(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        bucket, asked = rows[0]["bucket"], [unpack_keys(r["a"]) for r in rows]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        sent = [unpack(r["b"], np.float64).reshape(4, -1) for r in rows]
        lost, mass = (np.bincount(at, weights=np.concatenate([s[i] for s in sent])) for i in (0, 1))
        count, least = np.zeros(len(keys)), np.zeros(len(keys))
        count[at] = np.concatenate([s[2] for s in sent])
        least[at] = np.concatenate([s[3] for s in sent])
        more = ((count > 0) & (lost <= 0)).astype(np.float64)
        rest = np.maximum(1 - mass, least)
        alpha = np.where(count > 0, np.where(more > 0, 1.0, lost) / np.maximum(count + more, 1) / rest, 1.0)
        out, k = [], 0
        for r, own in zip(rows, asked):
            part = at[k : k + len(own)]
            k += len(own)
            out.append((-length, bucket, r["chunk"], pack(alpha[part]), pack(more[part].astype(np.uint8))))
        seen = count > 0
        out.append((-length, bucket, -1, pack_keys(keys[seen]), pack(np.concatenate([alpha[seen], count[seen] + more[seen]]))))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=_ANSWERS)

    sent = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask, ANSWERS)
    return sent.groupBy("kind", "bucket").applyInArrow(weigh, ANSWERS)


SCORES = "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(chunks: DataFrame, answers: DataFrame, levels: list[Level]) -> DataFrame:
    words = levels[0]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(7)]
        for row in left.to_pylist():
            c = _read(row)
            grams = c.grams(len(levels))
            known = _known(grams, right, levels, len(levels) - 1)
            count, of = known[0].count, grams[-1].of
            each = np.log10(np.maximum(known[-1].p, 1e-300))
            base = np.log10((count + 1) / (words.tokens + words.types + 1))
            starts = np.cumsum(c.counts) - c.counts
            add = lambda x: np.add.reduceat(x, starts)
            m = len(c.docs)
            for column, x in zip(out, (c.docs, c.train.tolist(), c.counts.tolist(), add((count > 0)[c.tokens].astype(np.int64)).tolist(), [words.tokens] * m, add(base[c.tokens]).tolist(), add(each[of]).tolist())):
                column += x
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds)], names=[x.split()[0] for x in SCORES.split(", ")])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SCORES)


class Katz(NamedTuple):
    """Tables by hash range: runs with counts, histories with backoff weights; and the statistics of words, of pairs, and of all levels. scores: all documents, evaluated."""

    counts: DataFrame
    weights: DataFrame
    words: Level
    pairs: Level
    scores: DataFrame
    levels: list[Level]


def katz(docs: DataFrame, train: Column, order: int = 2) -> Katz:
    """Fit on the documents where ``train`` holds (null: holds), and score all: SCORES.

    order: the words of the longest run, 2 or more.
    docs: doc_id, text. A token is a word, with A-Z lower-cased, or the end of a text, so a
    null or empty text has one token. Base score: add-one unigrams. Rows with equal doc_id
    are texts of their own. Without training documents every word is the unknown one.
    """
    bounded_batches(docs.sparkSession)
    chunks = _chunks(docs, train)
    n = chunks.agg(F.sum("n")).first()[0] or 0
    bits = [_bits(n / 8), *(_bits(n * share) for share in (0.65, 0.9, *[1.0] * order)[: order - 1])]
    counts = materialize(_count(chunks, bits), "lm-counts")
    stats = counts.filter("chunk = -2").select("kind", "a").collect()
    levels = [_level([r for r in stats if r["kind"] == k]) for k in range(1, order + 1)]
    answers, weights = counts.filter("chunk >= 0"), []
    for length in range(1, order):
        needed = answers.filter(F.col("kind") <= length + 1)
        weights.append(materialize(_weigh(chunks, needed, levels, length, bits[length - 1]), "lm-weights"))
        answers = answers.unionByName(weights[-1].filter("chunk >= 0"))
    tables = weights[0]
    for more in weights[1:]:
        tables = tables.unionByName(more)
    return Katz(counts.filter("chunk = -1"), tables.filter("chunk = -1"), levels[0], levels[1], _score(chunks, answers, levels), levels)
