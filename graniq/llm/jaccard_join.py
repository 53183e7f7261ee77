"""Exact Jaccard join of word-shingle sets, by token-combination prefixes.

Tokens (shingles) have one global order, rare ones first. Two sets with a similarity of at
least t share, in the first n - ceil(t * n) + 1 tokens of each, at least one. Frequent tokens
are divided into groups; within the prefix a group shares a *pair* of tokens or at most one
token, so if the prefix is longer by one token for each group it has, two similar sets share
a rare token or a pair of some group. Rare tokens are indexed one by one, frequent ones as
the pairs of their group, and candidates are verified on the whole sets.

Frequencies are counted over all distinct sets, for a part of the token universe chosen by hash
that is large enough for the prefixes (sets for which it is not count all their tokens); any
global function of the token is a valid order, so this part bounds the work, never the result.
Tasks write the counted tokens of their sets in chunks to the shared folder. A chunk asks the
owner of each hash range for the frequencies of its tokens, each token once a chunk, so that a
token of a third of all sets costs one entry a chunk.

Equal sets are one vertex. Sets that keys connect are a family; similar sets are of one. As the
corpus grows, chance keys chain unrelated sets, so a key connects those alone whose sketches
let them be similar: a sketch counts a set's tokens by some of their bits, and the sum of the
lesser counts is an upper bound of what two sets share. A
family of at most a block is verified in one task by the lists of sets that share a token. A
larger one is cut into blocks by hash, each verified by itself together with some common pivots,
which joins most near copies; then, where keys have sets of several components still, those
outside the largest component are verified against all sets, in blocks: of the family, or of
each such key in a huge one. Work on a family of near copies thus follows its size. Tasks return what the links connect, a row for each
set at most; pairs are never rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniq.llm.components import connect, labels_of
from graniq.llm.rows import possible, row_key, without
from graniq.llm.storage import bounded_batches, forget, materialize, open_fs, remove, shared_dir
from graniq.llm.words import U64, gram_hashes, mix, word_hashes

#: Tokens of a chunk of sets, and of a range of the hash space.
CHUNK, RANGE = 400_000, 1_000_000
#: Tokens and sets of a block that is verified at once, and sets that all blocks of a family have in common.
BLOCK, SETS, PIVOTS = 500_000, 1_000, 8
#: Blocks beyond which a family's verification goes by keys.
HUGE = 32
#: Sets of a key up to which all pairs are looked at at once, rows of keys that a task takes, and bytes of sketches that meet at once.
FEW, ROWS, PART = 128, 20_000, 1 << 24
#: Sets that share a token from which it is frequent, and tokens of a group in a prefix.
FREQUENT, GROUP = 16, 6


class Rule:
    """Similarity num / den, as whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ratio = math.log(den / num) * 1.001
        self.part = min(1.0, 2.5 * (1 - num / den))  # of the token universe that is counted first

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def bands(self, n: int) -> tuple[int, int]:
        """Two numbers; similar sets have one of them in common."""
        b = int(math.log(n) / self.ratio)
        return b, b + 1

    def groups(self, band: int) -> int:
        """Groups of frequent tokens for sets that meet under this number."""
        longest = math.exp((band + 1) * self.ratio)
        return max(1, int(((1 - self.num / self.den) * longest + 1) / GROUP))

    def need(self, n: int) -> int:
        """Most tokens that any prefix of a set of n tokens takes."""
        return min(n, self.prefix(n) + self.groups(self.bands(n)[1]))

    def similar(self, same: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        return self.den * same >= self.num * (a + b - same)


def shingles(column: pa.Array, w: int) -> Iterator[np.ndarray]:
    """The set of each row, sorted; the whole sequence where there are fewer than w words."""
    words = word_hashes(column)
    grams = gram_hashes(words.hashes, w)
    for a, b in zip(words.offsets, words.offsets[1:]):
        if b - a >= w:
            yield np.unique(grams[a : b - w + 1])
        elif b > a:
            yield gram_hashes(words.hashes[a:b], int(b - a)) + U64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(tokens ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)), int(mix(tokens * U64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).astype(np.int64))


def sketch(tokens: np.ndarray) -> bytes:
    """How many tokens have each value of their lowest bits: 4 to 8 tokens a value, so that it is small beside the set. Empty (it tells nothing) where a count exceeds a byte."""
    counts = np.bincount((tokens & U64(_values(len(tokens)) - 1)).astype(np.int64), minlength=_values(len(tokens)))
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _values(n: int) -> int:
    return 1 << max(4, (max(1, n) - 1).bit_length() - 3)


class Sketches:
    """Sketches of sets of n tokens, laid out by their length, and folded to that of a shorter one where they meet it."""

    def __init__(self, n: np.ndarray, sketches: list[bytes], rule: Rule):
        self.n, self.rule, self.width = n, rule, np.array([len(x) for x in sketches])
        self.at, self.folded = np.zeros(len(n), np.int64), {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.at[own] = np.arange(len(own))
            self.folded[w, w] = np.frombuffer(b"".join(sketches[i] for i in own.tolist()), np.uint8).reshape(len(own), w)

    def _rows(self, width: int, to: int, at: np.ndarray) -> np.ndarray:
        rows = self.folded[width, width][at].astype(np.uint16)
        while width > to:  # the lower bits stay
            width //= 2
            rows = rows[:, :width] + rows[:, width:]
        return rows

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets a[i] and b[i] can be similar, by their sizes and sketches."""
        n, m, rule = self.n[a], self.n[b], self.rule
        out = rule.den * np.minimum(n, m) >= rule.num * np.maximum(n, m)
        open_ = np.flatnonzero(out & (self.width[a] > 0) & (self.width[b] > 0))
        kinds = self.width[a[open_]] << 32 | self.width[b[open_]]
        for kind in np.unique(kinds).tolist():
            u, v, own = kind >> 32, kind & 0xFFFFFFFF, open_[kinds == kind]
            for part in np.array_split(own, 1 + len(own) * max(u, v) // PART):
                same = np.minimum(self._rows(u, min(u, v), self.at[a[part]]), self._rows(v, min(u, v), self.at[b[part]])).sum(axis=1, dtype=np.int64)
                out[part] = rule.similar(same, n[part], m[part])
        return out


_OWN = "doc_id long, a long, b long, n long, k1 long, k2 long, idx long, able boolean, chunk long, file string, at long, size long, sketch binary"


def _sets(docs: DataFrame, w: int, rule: Rule, folder: str) -> DataFrame:
    """A row per document: its key, set size n, the set's fingerprint k1, k2 and number idx, whether tokens of it are counted (able), and the chunk with its place in a file.

    A chunk has n and the number of counted tokens of each of its sets, then these tokens; the number of its first set is the chunk's.
    """
    limit = U64(min(2**64 - 1, int(rule.part * 2**64)))
    names = [x.split()[0] for x in _OWN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rows, parts, drawn, size, sink, path, at = TaskContext.get().partitionId() << 36, [], [], [], 0, None, "", 0

        def chunk() -> pa.RecordBatch:
            nonlocal sink, path, at, first, rows, parts, drawn, size
            if sink is None:
                fs, where = open_fs(folder)
                fs.create_dir(where, recursive=True)
                path = f"{folder}/{uuid.uuid4().hex}"
                sink = fs.open_output_stream(open_fs(path)[1])
            data = np.array([len(rows), *(r[3] for r in rows), *(len(p) for p in parts)], dtype=np.int64).tobytes() + b"".join(p.tobytes() for p in parts)
            sink.write(data)
            own = [(*r, first + i, len(p) > 0, first, path, at, len(data), x) for i, (r, p, x) in enumerate(zip(rows, parts, drawn))]
            at, first, rows, parts, drawn, size = at + len(data), first + len(rows), [], [], [], 0
            kinds = [pa.int64()] * 7 + [pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own), kinds)], names=names)

        for batch in batches:
            for key, tokens in zip(zip(*(batch.column(i).to_pylist() for i in range(3))), shingles(batch.column(3), w)):
                n, some = len(tokens), tokens[:0]
                if n * (rule.den - rule.num) >= rule.num:  # smaller sets are similar to equal ones alone
                    counted = tokens[: np.searchsorted(tokens, limit)]
                    some = (counted if len(counted) >= rule.need(n) else tokens).copy()
                rows.append((*key, n, *fingerprint(tokens)))
                parts.append(some)
                drawn.append(sketch(tokens) if len(some) else None)
                size += len(some) + 16
                if size >= CHUNK:
                    yield chunk()
        if rows:
            yield chunk()
        if sink is not None:
            sink.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), "text").mapInArrow(run, _OWN)


class Chunk:
    """Sets of a chunk but for those to skip: n, sizes, places (in the chunk) and tokens, one set after the other; and the distinct tokens, cut into ranges."""

    def __init__(self, file: str, at: int, size: int, skip: list[int] | None, bits: int):
        fs, where = open_fs(file)
        with fs.open_input_file(where) as f:
            f.seek(at)
            data = f.read(size)
        m = int(np.frombuffer(data, np.int64, 1)[0])
        n, sizes = np.frombuffer(data, np.int64, 2 * m, 8).reshape(2, m)
        tokens = np.frombuffer(data, np.uint64, offset=8 * (2 * m + 1))
        own = np.ones(m, bool)
        own[skip or []] = False
        self.places = np.flatnonzero(own & (sizes > 0))
        self.tokens, self.n, self.sizes = tokens[np.repeat(own, sizes)], n[self.places], sizes[self.places]
        self.distinct, self.of, self.counts = np.unique(self.tokens, return_inverse=True, return_counts=True)
        self.ranges = [0, *(np.searchsorted(self.distinct, np.arange(1, 1 << bits, dtype=np.uint64) << U64(64 - bits)) if bits else []), len(self.distinct)]


def _pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _chunks(own: DataFrame) -> DataFrame:
    """chunk, file, at, size, skip: the places of sets that another set equals, of which the one with the least idx is not skipped."""
    twice = own.filter("able").groupBy("k1", "k2").agg(F.min("idx").alias("kept"), F.count("*").alias("m")).filter("m > 1")
    # As a table of its own, so that the join can split the rows of a hot set.
    again = own.filter("able").join(materialize(twice, "join-twice"), ["k1", "k2"]).filter("idx <> kept").groupBy("chunk").agg(F.collect_list((F.col("idx") - F.col("chunk")).cast("int")).alias("skip"))
    return own.filter("able").groupBy("chunk").agg(F.first("file").alias("file"), F.first("at").alias("at"), F.first("size").alias("size"), F.count("*").alias("sets")).join(again, "chunk", "left")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _frequencies(chunks: DataFrame, bits: int) -> DataFrame:
    """Per chunk and range: which of the chunk's tokens others have as well (a bit each), and how many sets have these.

    Tokens are asked for by 32 bits below those of their range: a frequency is that of all tokens with these bits.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c, rows = Chunk(r["file"], r["at"], r["size"], r["skip"], bits), []
                for b, (low, high) in enumerate(zip(c.ranges, c.ranges[1:])):
                    if high > low:
                        rows.append((b, r["chunk"], _pack(np.diff((c.distinct[low:high] << U64(bits)) >> U64(32), prepend=U64(0))), _pack(c.counts[low:high])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "tokens", "counts"])

    def count(table: pa.Table) -> pa.Table:
        asked = [np.cumsum(_unpack(x), dtype=np.uint32) for x in table["tokens"].to_pylist()]
        _, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([_unpack(x) for x in table["counts"].to_pylist()]))[at].astype(np.uint32)
        shared, counts, k = [], [], 0
        for own in asked:
            c = total[k : k + len(own)]
            k += len(own)
            shared.append(np.packbits(c > 1).tobytes())
            counts.append(_pack(c[c > 1]))
        return pa.table([table["chunk"], table["bucket"], pa.array(shared, pa.binary()), pa.array(counts, pa.binary())], names=["chunk", "bucket", "shared", "counts"])

    asked = chunks.mapInArrow(ask, "bucket int, chunk long, tokens binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(count, "chunk long, bucket int, shared binary, counts binary")


def keys_of(tokens: np.ndarray, counts: np.ndarray, n: int, rule: Rule, limit: np.uint64) -> np.ndarray:
    """Index keys of a set of n tokens, of which ``tokens`` (sorted) are counted: rare tokens and pairs of frequent ones that its prefixes hold."""
    order = np.lexsort((tokens, counts, tokens >= limit))
    tokens, counts = tokens[order], counts[order]
    often, p, keys, longest = counts >= FREQUENT, rule.prefix(n), [], 0
    for band in rule.bands(n):
        group = (tokens % U64(rule.groups(band))).astype(np.int64)
        group[~often] = -1
        first = np.zeros(len(tokens), dtype=np.int64)
        first[np.unique(group, return_index=True)[1]] = 1
        first[~often] = 0
        end = int(np.searchsorted(np.cumsum(1 - first), p)) + 1
        longest = max(longest, end)
        inside = group[:end]
        for g in np.unique(inside[inside >= 0]).tolist():
            own = np.sort(tokens[:end][inside == g])
            if len(own) > 1:
                a, b = np.triu_indices(len(own), 1)
                keys.append(mix(own[a] * U64(0x9E3779B97F4A7C15) + own[b] * U64(0xC2B2AE3D27D4EB4F) + U64(band)))
    single = ~often[:longest] & (counts[:longest] > 1)
    return np.unique(np.concatenate([tokens[:longest][single], *keys]))


def _keys(chunks: DataFrame, frequencies: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """key, idx, n: what each set is indexed under. Sets whose prefix has only tokens of their own have no key."""
    limit = U64(min(2**64 - 1, int(rule.part * 2**64)))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        r = next(r for r in rows if r["file"] is not None)
        c = Chunk(r["file"], r["at"], r["size"], r["skip"], bits)
        known = np.ones(len(c.distinct), dtype=np.int64)
        for x in rows:
            if x["file"] is None:
                low, high = c.ranges[x["bucket"]], c.ranges[x["bucket"] + 1]
                known[low + np.flatnonzero(np.unpackbits(np.frombuffer(x["shared"], np.uint8), count=high - low))] = _unpack(x["counts"])
        counts = known[c.of]
        ends = np.cumsum(c.sizes)
        own = np.concatenate([[0], np.cumsum((counts == 1) & (c.tokens < limit))])
        alone = own[ends] - own[ends - c.sizes]
        key, idx, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(c.places)):
            size = int(c.n[i])
            if alone[i] < rule.prefix(size):
                a, b = ends[i] - c.sizes[i], ends[i]
                key.append(keys_of(c.tokens[a:b], counts[a:b], size, rule, limit))
                idx.append(np.full(len(key[-1]), r["chunk"] + c.places[i]))
                n.append(np.full(len(key[-1]), size))
        return pa.table([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(idx)), pa.array(np.concatenate(n))], names=["key", "idx", "n"])

    # The rows are small, the work on a chunk is not: tasks are not merged by bytes.
    asked = chunks.unionByName(frequencies, allowMissingColumns=True).repartition(_tasks(chunks.sparkSession), "chunk")
    return asked.groupBy("chunk").applyInArrow(run, "key long, idx long, n long")


def _members(keys: DataFrame) -> DataFrame:
    """Rows of the keys that several sets have. Keys with the same members say the same; one of them is kept."""
    same = keys.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("idx")).alias("f"), F.bit_xor(F.xxhash64("idx", F.lit(5))).alias("g"), F.min("idx").alias("least")).filter("m > 1")
    kept = same.groupBy("m", "f", "g").agg(F.min("key").alias("key"), F.min("least").alias("least"))
    return materialize(keys.join(kept.select("key", "least"), "key").select("key", "least", "idx", "n"), "join-members")


def chained(keys: np.ndarray, sets: np.ndarray, sketches: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that connect all those of a key that can be similar; rows (key, set) sorted by key, each pair of a key and a set once."""
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[begin, len(keys)])
    left, right = [], []
    for m in np.unique(size[(size > 1) & (size <= FEW)]).tolist():
        i, j = np.triu_indices(m, 1)
        rows = sets[begin[size == m][:, None] + np.arange(m)]
        left.append(rows[:, i].reshape(-1))
        right.append(rows[:, j].reshape(-1))
    if left:
        pairs = np.unique(np.stack([np.minimum(a, b) << 32 | np.maximum(a, b) for a, b in [(np.concatenate(left), np.concatenate(right))]]))
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        met = sketches.possible(a, b)
        left, right = [a[met]], [b[met]]
    for k in np.flatnonzero(size > FEW).tolist():
        rest, reached = sets[begin[k] : begin[k] + size[k]], []
        while len(rest):
            at = reached.pop() if reached else None
            if at is None:
                at, rest = rest[0], rest[1:]
            met = sketches.possible(np.full(len(rest), at), rest)
            own, rest = rest[met], rest[~met]
            left.append(np.full(len(own), at))
            right.append(own)
            reached += own.tolist()
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _families(members: DataFrame, own: DataFrame, rule: Rule) -> DataFrame:
    """idx, n, family: sets that keys connect and that can be similar, be they so or not. Sets that are left alone are in none."""

    def run(table: pa.Table) -> pa.Table:
        idx, first, sets = np.unique(table["idx"].to_numpy(), return_index=True, return_inverse=True)
        sketches = Sketches(table["n"].to_numpy()[first], table["sketch"].take(pa.array(first)).to_pylist(), rule)
        order = np.lexsort((sets, table["key"].to_numpy()))
        # Pairs of a key grow with the square of its sets; what leaves the task is less than a row for each set.
        sets, first = labels_of(*chained(table["key"].to_numpy()[order], sets[order], sketches))
        a, b = first[first != sets], sets[first != sets]
        return pa.table([pa.array(idx[a]), pa.array(idx[b])], names=["a", "b"])

    # A key of more sets than a block connects them all.
    many = materialize(members.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > SETS).select("key"), "join-many")
    stars = members.join(many, "key", "left_semi").filter("idx <> least").select(F.col("least").alias("a"), F.col("idx").alias("b"))
    asked = members.join(many, "key", "left_anti").select("key", "idx").join(own.filter("able").select("idx", "n", "sketch"), "idx")
    buckets = max(_tasks(own.sparkSession), -(-members.count() // ROWS))
    near = asked.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInArrow(run, "a long, b long")
    ties = connect(near.unionByName(stars)).select(F.col("v").alias("idx"), F.col("label").alias("family"))
    return ties.join(own.select("idx", "n"), "idx").select("idx", "n", "family")


def _whole_sets(docs: DataFrame, wanted: DataFrame, w: int) -> DataFrame:
    """idx, deals, tokens of the wanted sets (idx, a, b, deals), from the whole texts."""
    kind = "array<struct<t: long, u: long, v: long, left: boolean, label: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = pa.array([t.tobytes() for t in shingles(batch.column(0), w)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), tokens], names=["idx", "deals", "tokens"])

    rows, _ = possible(docs.select(*row_key(), "text"), wanted)
    once = rows.groupBy("a", "b").agg(F.first("text").alias("text"))
    return once.join(wanted, ["a", "b"]).select("text", "idx", "deals").mapInArrow(run, f"idx long, deals {kind}, tokens binary")


def linked(sets: list[np.ndarray], rule: Rule, left: np.ndarray | None = None, labels: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of the first set that links connect it with, sets compared by their shared tokens.

    All sets are compared, or those of ``left`` with all; sets of one label are connected from the start.
    """
    sizes = np.array([len(x) for x in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, run, many = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = many[run] > 1
    run, owner = run[shared], owner[shared]
    own = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))])
    posted = owner[np.argsort(run, kind="stable")]  # the sets of each token, one token after the other
    many = np.where(many > 1, many, 0)
    first = np.cumsum(many) - many
    root = np.arange(len(sets)) if labels is None else np.unique(labels, return_index=True, return_inverse=True)
    root = root if labels is None else root[1][root[2]]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(1, len(sets)) if left is None else np.flatnonzero(left).tolist():
        mine = run[own[i] : own[i + 1]]
        if not len(mine):
            continue
        n = many[mine]
        at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        same = np.bincount(posted[at], minlength=len(sets))
        similar = rule.similar(same, sizes[i], sizes) & (same > 0)
        for j in np.flatnonzero(similar[:i] if left is None else similar).tolist():
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(len(sets))])


def _verify(sets: DataFrame, rule: Rule) -> DataFrame:
    """a, b: what the links connect in each deal (t, u, v)."""

    def run(table: pa.Table) -> pa.Table:
        rows: dict[int, list] = {}
        for idx, left, label, tokens in zip(*(table[c].to_pylist() for c in ("idx", "left", "label", "tokens"))):
            if idx in rows:
                rows[idx][0] |= left
            else:
                rows[idx] = [left, label, tokens]
        idx = np.array(sorted(rows), dtype=np.int64)
        left, label, tokens = zip(*(rows[i] for i in idx.tolist()))
        left = np.array(left)
        root = linked([np.frombuffer(x, np.uint64) for x in tokens], rule, *((None, None) if left.all() else (left, np.array(label))))
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([pa.array(idx[root[tied]]), pa.array(idx[tied])], names=["a", "b"])

    one = sets.select("idx", "tokens", F.explode("deals").alias("d")).select("idx", "tokens", "d.*")
    return one.groupBy("t", "u", "v").applyInArrow(run, "a long, b long")


def _deal(t: Column, u: Column, v: Column, left: Column, label: Column) -> Column:
    return F.struct(*[x.cast(k).alias(n) for n, x, k in (("t", t, "long"), ("u", u, "long"), ("v", v, "long"), ("left", left, "boolean"), ("label", label, "long"))])


def _blocks(n: str, count: str = "*") -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sum(n) / BLOCK), F.ceil(F.count(count) / SETS)).cast("long")


def _span(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), n - 1)


def _link(families: DataFrame, members: DataFrame, own: DataFrame, docs: DataFrame, w: int, rule: Rule) -> DataFrame:
    """v, label of the sets that links connect."""
    spark = docs.sparkSession
    place = own.select("idx", "a", "b")
    # Pivots: of each family, the sets with the least of some hashes.
    pivots = [F.min(F.struct(F.xxhash64("idx", F.lit(s)).alias("h"), "idx")).getField("idx") for s in range(PIVOTS)]
    sizes = materialize(families.groupBy("family").agg(_blocks("n").alias("blocks"), F.sum("n").alias("tokens"), F.array(*pivots).alias("pivots")), "join-sizes")
    total = sizes.filter("blocks = 1").agg(F.sum("tokens")).first()[0] or 0
    buckets = max(total // BLOCK + 1, _tasks(spark))
    rows = families.join(sizes, "family")
    one = F.col("blocks") == 1
    block = F.pmod(F.xxhash64("idx", F.lit(11)), F.col("blocks"))
    whole = lambda u: _deal(F.lit(0), F.col("family"), u, F.lit(True), F.col("idx"))
    mine = F.when(one, F.array(_deal(F.lit(-1), F.pmod(F.xxhash64("family", F.lit(13)), F.lit(buckets)), F.lit(0), F.lit(True), F.col("idx"))))
    mine = mine.when(F.array_contains("pivots", F.col("idx")), F.transform(_span(F.col("blocks")), whole)).otherwise(F.array(whole(block)))
    wanted = materialize(rows.select("idx", mine.alias("deals")).join(place, "idx"), "join-wanted")
    links = materialize(_verify(_whole_sets(docs, wanted, w), rule), "join-links")
    labels = connect(links)
    large = sizes.filter("blocks > 1").select("family", "blocks")
    if large.isEmpty():
        return labels

    # The sets outside the largest component are compared with all: of the family or, of a huge one, of each key that has sets of several components still.
    held = families.join(large, "family").join(labels.withColumnRenamed("v", "idx"), "idx", "left").select("family", "blocks", "idx", "n", F.coalesce("label", "idx").alias("label"))
    held = materialize(held, "join-held")
    whole, cut = held.filter(F.col("blocks") <= HUGE).withColumn("group", F.col("family")), held.filter(F.col("blocks") > HUGE)
    rows = whole if cut.isEmpty() else whole.unionByName(members.select("key", "idx").join(cut, "idx").select(F.xxhash64("key", "family").alias("group"), "family", "blocks", "idx", "n", "label"))
    many = lambda n, m: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(m / SETS)).cast("long")
    parts = rows.groupBy("group", "label").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    most = parts.groupBy("group").agg(F.max(F.struct("m", "label", "n")).alias("most"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    divided = most.select("group", F.col("most.label").alias("giant"), many(F.col("n"), F.col("m")).alias("all"), many(F.col("n") - F.col("most.n"), F.col("m") - F.col("most.m")).alias("rest"))
    open_ = rows.join(materialize(divided, "join-divided"), "group")
    left = F.col("label") != F.col("giant")
    at, of = F.pmod(F.xxhash64("idx", F.lit(17)), F.col("all")), F.pmod(F.xxhash64("idx", F.lit(19)), F.col("rest"))
    right_deals = F.transform(_span(F.col("rest")), lambda r: _deal(F.col("group"), r, at, F.lit(False), F.col("label")))
    left_deals = F.when(left, F.transform(_span(F.col("all")), lambda a: _deal(F.col("group"), of, a, F.lit(True), F.col("label")))).otherwise(F.array().cast("array<struct<t: long, u: long, v: long, left: boolean, label: long>>"))
    deals = open_.select("idx", F.explode(F.concat(right_deals, left_deals)).alias("d")).groupBy("idx").agg(F.collect_list("d").alias("deals"))
    wanted = materialize(deals.join(place, "idx"), "join-wanted")
    more = materialize(_verify(_whole_sets(docs, wanted, w), rule), "join-links")
    return connect(labels.select(F.col("label").alias("a"), F.col("v").alias("b")).filter("a <> b").unionByName(more))


def _classes(docs: DataFrame, w: int, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (_OWN); and of each set with words k1, k2, the first row of its component (best: by doc_id, nulls last, then a, b) and the component's rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_dir(spark, "join-chunks")
    own = materialize(_sets(docs, w, rule, folder), "join-documents")
    chunks = materialize(_chunks(own), "join-chunk-list")
    n_tokens = (chunks.agg(F.sum("size")).first()[0] or 0) / 8
    bits = max(0, math.ceil(math.log2(max(1, n_tokens / RANGE))))
    keys = materialize(_keys(chunks, _frequencies(chunks.repartition(_tasks(spark)), bits), rule, bits), "join-keys")
    remove(folder)
    members = _members(keys)
    forget(keys)
    families = materialize(_families(members, own, rule), "join-families")
    labels = _link(families, members, own, docs, w, rule)

    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")).alias("best")
    by_set = own.filter("n > 0").groupBy("k1", "k2").agg(best, F.min("idx").alias("idx"), F.count("*").alias("rows"))
    named = materialize(by_set.join(labels.withColumnRenamed("v", "idx"), "idx", "left").select("k1", "k2", "best", "rows", "label"), "join-classes")
    # A table of its own, so that the join can split the sets of a large component.
    whole = materialize(named.filter("label IS NOT NULL").groupBy("label").agg(F.min("best").alias("first"), F.sum("rows").alias("all")), "join-components")
    tied = named.filter("label IS NOT NULL").join(whole, "label").select("k1", "k2", F.col("first").alias("best"), F.col("all").alias("rows"))
    return own, tied.unionByName(named.filter("label IS NULL").select("k1", "k2", "best", "rows"))


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    docs: doc_id, text; other columns are ignored. Two documents link when den * intersection
    >= num * union of their sets. component_id is the smallest doc_id reachable. Documents
    without words have an empty set and link with nothing. Repeated rows and equal texts are
    linked. Rows with a null doc_id take part, but name no component; a component of such rows
    alone has a null id. An empty table gives no row.
    """
    own, classes = _classes(docs, shingle, Rule(num, den))
    found = own.filter("n > 0").join(classes, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"))
    return found.unionByName(own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, but of each component the one with the least doc_id alone.

    Rows are judged by doc_id and text, so that another row of the same doc_id is not touched; a
    null doc_id comes last. Of equal doc_ids the row is chosen by a hash of its text; of rows
    equal in both, any one stays. Documents without words stay, all of them.
    """
    own, classes = _classes(docs, shingle, Rule(num, den))
    kept = (F.col("a") == F.col("best.a")) & (F.col("b") == F.col("best.b"))
    judged = own.filter("n > 0").join(classes.filter("rows > 1"), ["k1", "k2"]).groupBy("a", "b").agg(F.max(kept).alias("kept"), F.count("*").alias("rows"))
    judged = materialize(judged, "join-judged")
    return without(docs, judged.filter("NOT kept"), judged.filter("kept AND rows > 1"))
