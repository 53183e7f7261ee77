"""Quality classifier by co-training of two views.

The text view has the words of a document and their beginnings, the page view what is known about it: language,
source, length, and the shape of its characters and lines. Each view has a logistic model.
Over rounds, each labels all unlabelled rows of which it is sure, for the other to learn.
Then each view is calibrated on labelled rows that neither has learned, a combination of the
two calibrated views is fitted there, and all documents are scored in one pass.

Labelled rows are fitted on the driver, at most ``max_labelled`` of them in order of a hash of
doc_id, repeated ids included: a documented, bounded sample. Unlabelled rows have no bound: their features are stored
once, and each round is a pass over them that adds up what the models learn from. That is, for
the text view, the rows of each class that hold a slot, whose log ratio is where its weights
start and are drawn to; for the page view, the gradient and a bound of the second derivatives
of the loss. Scoring covers every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniq.llm.rows import columns_of, possible
from graniq.llm.storage import bounded_batches, forget, materialize
from graniq.llm.words import U64, text_buffers, word_hashes

TEXT_BITS = 20
#: Bytes of word beginnings that are features as well.
BEGINS = (4, 6, 8)
LANGS, SOURCES = 16, 64
SHAPES = 14
PAGE_SIZE = SHAPES + LANGS + SOURCES
#: Documents of a stored block of features, and ranges of slots that are added up apart.
BLOCK, RANGES = 1024, 16
#: Values that are summed at once on the driver.
PART = 1 << 20


class Views(NamedTuple):
    """Word slots of row i: slots[offsets[i]:offsets[i + 1]], each once; and a row of page features each."""

    slots: np.ndarray
    offsets: np.ndarray
    pages: np.ndarray


def _kinds() -> np.ndarray:
    kinds = np.zeros((256, 7), dtype=np.float64)  # upper, lower, digit, space, newline, bar or hash etc., other mark
    for b in range(256):
        c = chr(b)
        k = 1 if b >= 128 or "a" <= c <= "z" else 0 if "A" <= c <= "Z" else 2 if c.isdigit() else 4 if c in "\n\r" else 3 if c.isspace() else 6 if c in ".,;:?'\"()-" else 5
        kinds[b, k] = 1
    return kinds


_KINDS = _kinds()


def views(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> Views:
    """Both views of rows; null texts are empty, null languages and sources are kinds of their own."""
    words = word_hashes(texts, punctuation=False, begins=BEGINS)
    raw, at = text_buffers(texts)
    n = len(texts)
    parts, counts, distinct = [], np.diff(words.offsets), np.zeros(n)
    for i in range(n):
        own = np.unique(words.hashes[words.offsets[i] : words.offsets[i + 1]])
        distinct[i] = len(own)
        own = np.concatenate([own, *(h[words.offsets[i] : words.offsets[i + 1]] * U64(2 * n + 3) for n, h in zip(BEGINS, words.begins))])
        parts.append(np.unique((own >> U64(64 - TEXT_BITS)).astype(np.int32)))
    slots = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    size = np.diff(at)
    shapes = np.zeros((n, SHAPES))
    for i in range(n):
        seen = np.bincount(raw[at[i] : at[i + 1]], minlength=256).astype(np.float64) @ _KINDS
        shapes[i, :7] = seen / max(1, size[i])
        shapes[i, 7:9] = np.log1p(seen[5]) / 5, seen[0] / max(1.0, seen[0] + seen[1])
    shapes[:, 9] = np.log1p(size) / 10
    shapes[:, 10] = np.log1p(counts) / 8
    shapes[:, 11] = distinct / np.maximum(1, counts)
    shapes[:, 12] = np.minimum(20, size / np.maximum(1, counts)) / 10
    shapes[:, 13] = 1
    page = np.zeros((n, PAGE_SIZE))
    page[:, :SHAPES] = shapes
    for column, base, width in ((langs, SHAPES, LANGS), (sources, SHAPES + LANGS, SOURCES)):
        for i, v in enumerate(column.to_pylist()):
            slot = 0 if v is None else 1 + sum((k + 1) * b for k, b in enumerate(str(v).encode("utf-8", "surrogatepass"))) % (width - 1)
            page[i, base + slot] = 1
    return Views(slots, offsets, page)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(weights: np.ndarray, v: Views) -> np.ndarray:
    """The sum of each row's weights, as doubles, by some rows at a time: a row's sum depends on no other row."""
    out = np.zeros(len(v.offsets) - 1)
    for first in range(0, len(out), BLOCK // 4):
        at = v.offsets[first : first + BLOCK // 4 + 1]
        full = np.flatnonzero(np.diff(at))
        if len(full):
            out[first + full] = np.add.reduceat(weights[v.slots[at[0] : at[-1]]].astype(np.float64), at[full] - at[0])
    return out


class _Ranges:
    """Sums over consecutive ranges of given lengths, with little memory beside the values."""

    def __init__(self, lengths: np.ndarray):
        self.n, self.full = len(lengths), np.flatnonzero(lengths)
        self.starts = (np.cumsum(lengths) - lengths)[self.full]

    def sums(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A part of the ranges at a time."""
        out = np.zeros(self.n)
        cuts = [0, *(np.flatnonzero(np.diff(self.starts // PART)) + 1).tolist(), len(self.full)]
        for low, high in zip(cuts, cuts[1:]) if len(self.full) else ():
            first, last = self.starts[low], self.starts[high] if high < len(self.full) else len(at)
            out[self.full[low:high]] = np.add.reduceat(values[at[first:last]], self.starts[low:high] - first)
        return out


class Sums(NamedTuple):
    """What a pass over the unlabelled rows found, by class 0 and 1 of the label that the other view gave.

    words: of the rows for the text view, those that hold each slot; n_words: all of them. n_page: rows for the page view;
    slope and curve: at the page weights of the pass, the sums of x (p - y) and of x x', x with a 1 at its end.
    """

    words: np.ndarray
    n_words: np.ndarray
    n_page: np.ndarray
    slope: np.ndarray
    curve: np.ndarray


def no_sums() -> Sums:
    d = PAGE_SIZE + 1
    return Sums(np.zeros((2, 1 << TEXT_BITS), np.int64), np.zeros(2, np.int64), np.zeros(2, np.int64), np.zeros((2, d)), np.zeros((2, d, d)))


class Rows:
    """Word slots of some labelled rows, laid out once for sums by row and by slot; known: the slots that occur."""

    def __init__(self, v: Views, rows: np.ndarray, y: np.ndarray):
        sizes = np.diff(v.offsets)[rows]
        self.y, self.by_row = y, _Ranges(sizes)
        self.counts = np.zeros((2, 1 << TEXT_BITS), dtype=np.int32)
        for r, good in zip(rows, y > 0.5):  # a row has a slot once
            self.counts[int(good), v.slots[v.offsets[r] : v.offsets[r + 1]]] += 1
        present = self.counts.any(axis=0)
        self.known, number = np.flatnonzero(present), np.cumsum(present, dtype=np.int32) - 1
        ends = np.cumsum(sizes)
        self.slots = np.empty(sizes.sum(), dtype=np.int32)
        for r, a, b in zip(rows, ends - sizes, ends):
            self.slots[a:b] = number[v.slots[v.offsets[r] : v.offsets[r + 1]]]
        many = self.counts.sum(axis=0)[self.known]
        self.by_slot = _Ranges(many)
        # The rows of each slot, one slot after the other, sorted for a part of the slots at a time.
        self.of, starts, cuts = np.empty(len(self.slots), dtype=np.int32), np.concatenate([[0], np.cumsum(many)]), np.linspace(0, len(many), 4 * RANGES + 1).astype(np.int64)
        for low, high in zip(cuts, cuts[1:]):
            at = np.flatnonzero((self.slots >= low) & (self.slots < high))
            at = at[np.argsort(self.slots[at], kind="stable")]
            self.of[starts[low] : starts[high]] = np.searchsorted(ends, at, side="right")


def fit_text(rows: Rows, sums: Sums, steps: int = 120, penalty: float = 2e-4, least: int = 3) -> tuple[np.ndarray, float]:
    """Weights by slot and a bias: logistic regression on the presence of words in at least ``least`` rows.

    Where unlabelled rows of both classes were learned, weights start at and are drawn to the log ratio of a slot's
    shares of the classes, in the scale that fits the labelled rows; else to 0.
    """
    y, known = rows.y, rows.known
    often = (rows.counts.sum(axis=0) + sums.words.sum(axis=0)) >= least
    out, bias = np.zeros(1 << TEXT_BITS), 0.0
    if sums.n_words.all():
        n = sums.n_words + [(y <= 0.5).sum(), (y > 0.5).sum()]
        for c, sign in ((0, -1), (1, 1)):
            out += sign * np.log((rows.counts[c] + sums.words[c] + 0.5) / (n[c] + 1))
        out[~often] = 0
        z = rows.by_row.sums(out[known], rows.slots)
        size = max(1.0, float(np.abs(z).mean()))
        slope, bias = fit_dense(z[:, None] / size, y)
        out *= max(0.0, slope) / size
    w, bias, free = out[known], float(bias), often[known]
    middle = w.copy()
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    for k in range(1, steps + 1):
        e = (sigmoid(rows.by_row.sums(w, rows.slots) + bias) - y) * weight
        g, gb = (rows.by_slot.sums(e, rows.of) + penalty * (w - middle)) * free, e.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        fix1, fix2 = 1 - 0.9**k, 1 - 0.99**k
        w -= 0.1 * (m / fix1) / (np.sqrt(s / fix2) + 1e-8)
        bias -= 0.1 * (mb / fix1) / (np.sqrt(sb / fix2) + 1e-8)
    out[known] = w
    return out.astype(np.float32), float(bias)


def fit_dense(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 30, balanced: bool = True, more: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the bias. more: a place, slope and curve of a quadratic loss that is added."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())) if balanced else np.full(len(y), 1 / max(1, len(y)))
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ ((p - y) * weight) + penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        if more is not None:
            g += more[1] + more[2] @ (w - more[0])
            h += more[2]
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Calibrated log odds of both views and the lesser: one view's doubt can settle it."""
    return np.c_[a, b, np.minimum(a, b)]


class Model(NamedTuple):
    """Weights of both views, their calibration (slope, shift) and the combination (text, page, the lesser of them, bias). Without both classes among the labels, ``prior`` alone."""

    words: np.ndarray
    bias: float
    page: np.ndarray
    scales: np.ndarray
    both: np.ndarray
    prior: float | None = None

    def logits(self, v: Views) -> tuple[np.ndarray, np.ndarray]:
        return _sums(self.words, v) + self.bias, v.pages @ self.page[:-1] + self.page[-1]

    def scores(self, v: Views) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of each view, and of both, that a row is good."""
        if self.prior is not None:
            same = np.full(len(v.offsets) - 1, self.prior)
            return same, same, same
        a, b = (s * z + t for z, (s, t) in zip(self.logits(v), self.scales))
        return sigmoid(a), sigmoid(b), sigmoid(_both(a, b) @ self.both[:-1] + self.both[-1])


def fit_page(v: Views, rows: np.ndarray, y: np.ndarray, sums: Sums, at: np.ndarray | None) -> np.ndarray:
    """Page weights from labelled rows and the sums of unlabelled ones, taken at the weights ``at``.

    The loss of unlabelled rows is its quadratic upper bound there. A class of them weighs no more than its labelled rows.
    """
    if at is None or not sums.n_page.any():
        return fit_dense(v.pages[rows], y)
    own = np.array([(y <= 0.5).sum(), (y > 0.5).sum()])
    weight = 0.5 / own * np.minimum(1, own / np.maximum(1, sums.n_page))
    return fit_dense(v.pages[rows], y, more=(at, weight @ sums.slope, np.tensordot(weight / 4, sums.curve, 1)))


def co_train(v: Views, y: np.ndarray, learn_from: Callable[[list[Model]], Sums], rounds: int = 3) -> Model:
    """v, y: labelled rows, of which every third is kept for calibration. learn_from: the sums of all unlabelled rows, by the models of the rounds so far."""
    if len(np.unique(y)) < 2 or min((y == 1).sum(), (y == 0).sum()) < 6:
        prior = float(y.mean()) if len(y) else 1.0
        return Model(np.zeros(1 << TEXT_BITS), 0.0, np.zeros(PAGE_SIZE + 1), np.ones((2, 2)), np.zeros(4), prior)
    held = np.zeros(len(y), bool)
    for c in (0, 1):  # both classes in both parts
        held[np.flatnonzero(y == c)[::3]] = True
    learn, check = np.flatnonzero(~held), np.flatnonzero(held)
    models, sums, page, rows = [], no_sums(), None, Rows(v, learn, y[learn])
    for k in range(rounds + 1):
        words, bias = fit_text(rows, sums)
        page = fit_page(v, learn, y[learn], sums, page)
        model = Model(words, bias, page, np.ones((2, 2)), np.zeros(4))
        z = model.logits(v)
        scales = np.array([fit_dense(z[i][check][:, None] / 4, y[check], balanced=False) / [4, 1] for i in range(2)])
        models.append(model._replace(scales=scales))
        if k < rounds:
            sums = learn_from(models)
    a, b = (s * x[check] + t for x, (s, t) in zip(z, scales))
    both = fit_dense(_both(a, b), y[check], balanced=False)
    return models[-1]._replace(both=both)


def _taught(v: Views, models: list[Model], sure: float) -> tuple[np.ndarray, np.ndarray]:
    """For the text and the page view, the label of each row by the other view: 1, 0, or -1 where it was never sure. The first round that was sure counts."""
    labels = np.full((2, len(v.offsets) - 1), -1, np.int8)
    for model in models:
        for i, (z, (s, t)) in enumerate(zip(model.logits(v), model.scales)):
            p, other = sigmoid(s * z + t), labels[1 - i]
            other[(other < 0) & (p >= sure)] = 1
            other[(other < 0) & (p <= 1 - sure)] = 0
    return labels[0], labels[1]


def add_up(v: Views, models: list[Model], sure: float) -> Sums:
    """Page features and errors are rounded to binary fractions, so that sums are exact and come in any order."""
    text, page = _taught(v, models, sure)
    of = np.repeat(text, np.diff(v.offsets))
    words = np.array([np.bincount(v.slots[of == c], minlength=1 << TEXT_BITS) for c in (0, 1)])
    x = np.c_[np.round(v.pages * 1024) / 1024, np.ones(len(page))]
    error = np.round((sigmoid(v.pages @ models[-1].page[:-1] + models[-1].page[-1]) - page) * 65536) / 65536
    parts = [(x[page == c], error[page == c]) for c in (0, 1)]
    return Sums(words, np.array([(text == c).sum() for c in (0, 1)]), np.array([len(e) for _, e in parts]), np.array([e @ r for r, e in parts]), np.array([r.T @ r for r, _ in parts]))


def _planes(x: np.ndarray, kind: str) -> bytes:
    raw = np.ascontiguousarray(x.astype(kind).reshape(-1).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _unlabelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Features of all rows whose doc_id is not in ``known``, null ids among them, in blocks: slots (as steps), counts, page."""
    # A bitmap of labelled ids tells most rows that have none; of the others only ids are joined, and no texts.
    key = F.xxhash64("doc_id").alias("a")
    rows = docs.select("doc_id", "text", *_page_columns(docs))
    keyed = rows.filter("doc_id IS NOT NULL").select("*", key)
    asked, others = possible(keyed, known.select(key))
    false = materialize(asked.select("doc_id").distinct().join(known.select("doc_id"), "doc_id", "left_anti"), "quality-ids")
    met = possible(asked, false.select(key))[0].join(false, "doc_id", "left_semi")
    parts = [x.select("text", "lang", "source") for x in (others, met, rows.filter("doc_id IS NULL"))]
    rest = parts[0].unionByName(parts[1]).unionByName(parts[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                v = _views_of(batch.slice(i, BLOCK), 0)
                steps = np.diff(v.slots, prepend=0)
                full = v.offsets[:-1][np.diff(v.offsets) > 0]
                steps[full] = v.slots[full]
                columns = [[_planes(steps, "<u4")], [_planes(np.diff(v.offsets), "<u4")], [_planes(v.pages, "<f4")]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["slots", "counts", "page"])

    return materialize(rest.mapInArrow(run, "slots binary, counts binary, page binary"), "quality-unlabelled")


def _views_in(slots: bytes, counts: bytes, page: bytes) -> Views:
    offsets = np.concatenate([[0], np.cumsum(_from_planes(counts, "<u4"), dtype=np.int64)])
    ends = np.concatenate([[0], np.cumsum(_from_planes(slots, "<u4"), dtype=np.int64)])
    return Views((ends[1:] - np.repeat(ends[offsets[:-1]], np.diff(offsets))).astype(np.int32), offsets, _from_planes(page, "<f4").astype(np.float64).reshape(-1, PAGE_SIZE))


_PARTS = "part int, sums binary"


def _learn_from(blocks: DataFrame, models: list[Model], sure: float) -> Sums:
    """The sums of all blocks: each task's are added up by ranges of slots (part 0 on) and, for all else, in part -1."""
    shared = blocks.sparkSession.sparkContext.broadcast(models)

    def table(parts: list[tuple[int, np.ndarray]], kind: type) -> pa.RecordBatch | pa.Table:
        packed = [_planes(x, "<i8" if part >= 0 else "<f8") for part, x in parts]
        return kind.from_arrays([pa.array([part for part, _ in parts], pa.int32()), pa.array(packed, pa.binary())], names=["part", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                own = add_up(_views_in(row["slots"], row["counts"], row["page"]), shared.value, sure)
                total = own if total is None else Sums(*(a + b for a, b in zip(total, own)))
        if total is not None:
            yield table([*enumerate(np.split(total.words, RANGES, axis=1)), (-1, np.concatenate([x.reshape(-1).astype(np.float64) for x in total[1:]]))], pa.RecordBatch)

    def add(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        return table([(part, sum(_from_planes(x, "<i8" if part >= 0 else "<f8") for x in rows.column("sums").to_pylist()))], pa.Table)

    found = {r["part"]: r["sums"] for r in blocks.mapInArrow(run, _PARTS).groupBy("part").applyInArrow(add, _PARTS).collect()}
    shared.destroy()
    if not found:
        return no_sums()
    rest, d = _from_planes(found[-1], "<f8"), PAGE_SIZE + 1
    words = np.concatenate([_from_planes(found[i], "<i8").reshape(2, -1) for i in range(RANGES)], axis=1)
    return Sums(words, rest[:2].astype(np.int64), rest[2:4].astype(np.int64), rest[4 : 4 + 2 * d].reshape(2, d), rest[4 + 2 * d :].reshape(2, d, d))


def _views_of(batch: pa.RecordBatch, first: int) -> Views:
    return views(*(batch.column(i) for i in range(first, first + 3)))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, rounds: int = 3, sure: float = 0.98) -> Model:
    """labels: doc_id, quality, toxic. Good is quality 1 and not toxic; rows without quality or doc_id are not labels, and of several rows for a document the worst counts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    by_hash = F.xxhash64("doc_id", F.lit(3))
    good = F.min(F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1.0).otherwise(0.0))
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(good.alias("y"))
    some = known.orderBy(by_hash, "doc_id").limit(max_labelled)
    chosen = docs.join(F.broadcast(some), "doc_id").select("doc_id", "y", "text", *_page_columns(docs))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _views_of(batch, 2)
            packed = [v.slots[a:b].astype("<i4").tobytes() for a, b in zip(v.offsets, v.offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array([p.astype("<f4").tobytes() for p in v.pages], pa.binary())], names=["doc_id", "y", "slots", "page"])

    # A labelled id may be that of many rows; the sample is one of rows, so its bound is theirs.
    rows = chosen.mapInArrow(featurize, "doc_id long, y double, slots binary, page binary").orderBy(by_hash, "doc_id", "slots", "page").limit(max_labelled).toArrow()
    rows = rows.take(np.argsort(rows["doc_id"].to_numpy().astype(np.uint64) * U64(0x9E3779B97F4A7C15), kind="stable"))
    y, slots = rows["y"].to_numpy(), [np.frombuffer(s.as_buffer(), dtype="<i4") for c in rows["slots"].chunks for s in c]
    pages = np.array([np.frombuffer(p.as_buffer(), dtype="<f4") for c in rows["page"].chunks for p in c], dtype=np.float64).reshape(-1, PAGE_SIZE)
    v = Views(np.concatenate([np.zeros(0, np.int32), *slots]), np.concatenate([[0], np.cumsum([len(s) for s in slots])]).astype(np.int64), pages)
    del rows, slots
    pa.default_memory_pool().release_unused()
    blocks: list[DataFrame] = []

    def learn_from(models: list[Model]) -> Sums:
        if not blocks:
            blocks.append(_unlabelled(docs, known))
        return _learn_from(blocks[0], models, sure)

    model = co_train(v, y, learn_from, rounds)
    for table in blocks:
        forget(table)
    return model


def _page_columns(docs: DataFrame) -> list:
    return [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]


#: What the classifier adds to a row.
SCORES = "text_score double, page_score double, score double, keep boolean"


def _scored(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """row (the row of ``docs`` as it is) and, beside it, SCORES."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), *_page_columns(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, both = shared.value.scores(views(batch.column(0).field("text"), batch.column(1), batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= threshold)], names=["row", *(x.split()[0] for x in SCORES.split(", "))])

    schema = rows.select("row").schema
    for name, kind in (x.split() for x in SCORES.split(", ")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """All rows of ``docs`` with text_score, page_score, score and keep (score >= threshold).

    docs: doc_id, text, and lang and source where it has them. Null or empty texts are
    scored by the page view and the text model's bias. Columns of these names are replaced.
    """
    new = [x.split()[0] for x in SCORES.split(", ")]
    return _scored(docs, model, threshold).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *new)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Fit on the labelled sample and all unlabelled rows, then score all documents."""
    return score(docs, fit(docs, labels, **how))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns and none of its own, whatever their names."""
    return _scored(docs, fit(docs, labels, **how), threshold).filter("keep").select(*[F.col("row")[c].alias(c) for c in docs.columns])
