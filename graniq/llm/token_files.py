"""Token ids of documents in plane-shuffled binary files.

A file has blocks of BLOCK ids (the last may be shorter). A block is cut into byte planes
(all lowest bytes, then the next ones, ...) or bit planes; each plane is compressed with
zstandard by itself, and a plane of zeros takes no bytes. After the blocks come the document
table (ids and token counts) and the chunk index (place of each plane), and a fixed footer:
any range of ids is read from the blocks that hold it alone.

Documents are dealt by ranges of doc_id, sorted inside a range, tokenised and written by one
streaming task a range; the files, in order, are the corpus in ascending doc_id order.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniq.llm.storage import bounded_batches, materialize, open_fs, shared_dir

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
#: Ids after which a task begins a new file.
ROLL = 32 << 20
#: Runs and words whose ids a worker remembers; then it begins anew.
REMEMBERED = 600_000
_FOOTER = struct.Struct("<QQQ8s")

# The normalizer and pre-tokenizer of the vocabulary whose words can be encoded apart.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Runs(dict):
    """Ids of runs between ASCII white space, each encoded when it is first met.

    A run of Latin letters followed by ASCII marks is encoded as its lower-cased word and the
    marks, which are tokens of their own; other runs by the whole tokenizer.
    """

    #: Letters that normalization leaves as they are but for case.
    LETTERS = "A-Za-zÀ-ÖØ-Þß-öø-ÿ"

    def __init__(self, tokenizer, added: list[str]):
        super().__init__()
        self.tokenizer, self.words = tokenizer, {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: 256 + i for i, b in enumerate(hidden)}  # bytes as letters, as byte-level vocabularies write them
        # An apostrophe may begin a token with letters, and marks of added tokens may be parts of these.
        marks = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'" and not any(c in t for t in added))
        self.plain = re.compile(f"([{self.LETTERS}]+)([{re.escape(marks)}]*)").fullmatch

    def pack(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = self.words[word] = self.pack([t.id for t in self.tokenizer.model.tokenize(written)])
        return ids

    def __missing__(self, run: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = run.decode("utf-8", "surrogatepass")
        if m := self.plain(text):
            word, marks = m.groups()
            ids = self.word(word.lower()) + self.word(marks) if marks else self.word(word.lower())
        else:
            ids = self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self[run] = ids
        return ids


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers.

    Where the vocabulary's own pipeline works on each run between ASCII white space alone
    (nothing in it looks across white space), each distinct run is encoded once and its ids
    remembered. Other vocabularies encode text by text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        added = spec["added_tokens"]
        self.wordwise = all(spec[k] == v for k, v in _WORDWISE.items()) and spec["model"]["type"] == "BPE" and not any(t["lstrip"] or t["rstrip"] or t["content"].isalpha() for t in added)
        self.runs = Runs(self.tokenizer, [t["content"] for t in added])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.wordwise:
            return [self.runs.pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        get = self.runs.__getitem__
        return [b"".join(map(get, t.encode("utf-8", "surrogatepass").split())) for t in texts]


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path)


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first: 4 byte planes or 32 bit planes."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, i].tobytes() for i in range(4)]
    return [np.packbits((octets[:, i // 8] >> (i % 8)) & 1).tobytes() for i in range(32)]


def from_planes(planes: list[bytes | None], n: int) -> np.ndarray:
    """Inverse of to_planes; None is a plane of zeros."""
    octets = np.zeros((n, 4), dtype=np.uint8)
    for i, plane in enumerate(planes):
        if plane is None:
            continue
        if len(planes) == 4:
            octets[:, i] = np.frombuffer(plane, dtype=np.uint8)
        else:
            octets[:, i // 8] |= np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n) << (i % 8)
    return octets.reshape(-1).view("<u4")


class Writer:
    """One file; add() documents, then close()."""

    def __init__(self, folder: str, kind: str, level: int):
        fs, where = open_fs(folder)
        fs.create_dir(where, recursive=True)
        self.path, self.kind = f"{folder}/{uuid.uuid4().hex}.ids", kind
        self.file = fs.open_output_stream(open_fs(self.path)[1])
        self.file.write(MAGIC)
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at, self.waiting, self.size, self.n_ids = len(MAGIC), [], 0, 0
        self.index: list[int] = []
        self.docs: list[int] = []
        self.counts: list[int] = []
        self.absent: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if doc_id is None:
            self.absent.append(len(self.docs))
        self.docs.append(doc_id or 0)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4")
        end = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for a in range(0, end, BLOCK):
            block = ids[a : min(a + BLOCK, end)]
            places = []
            for plane in to_planes(block, self.kind):
                packed = self.zstd.compress(plane) if any(plane[:1]) or any(plane) else b""
                self.file.write(packed)
                places.append(len(packed))
            self.index += [self.at, len(block), *places]
            self.at += sum(places)
            self.n_ids += len(block)
        self.waiting = [ids[end:].tobytes()]
        self.size = len(self.waiting[0])

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        table = [np.array(x, dtype="<i8").tobytes() for x in (self.docs, self.counts, self.absent)]
        meta = self.zstd.compress(json.dumps({"kind": self.kind, "docs": len(self.docs), "absent": len(self.absent), "blocks": len(self.index) // (2 + (4 if self.kind == "byte" else 32))}).encode())
        docs, index = self.zstd.compress(b"".join(table)), self.zstd.compress(np.array(self.index, dtype="<i8").tobytes())
        for part in (docs, index, meta):
            self.file.write(part)
        self.file.write(_FOOTER.pack(self.at, len(docs), len(index), MAGIC))
        self.file.close()
        return self.path, self.n_ids, len(self.docs)


class Reader:
    """Random access to a file through its chunk index."""

    def __init__(self, path: str):
        fs, where = open_fs(path)
        self.file = fs.open_input_file(where)
        size = self.file.size()
        self.file.seek(size - _FOOTER.size)
        at, docs, index, magic = _FOOTER.unpack(self.file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a file of id planes")
        self.file.seek(at)
        tail = self.file.read(size - _FOOTER.size - at)
        self.zstd = zstandard.ZstdDecompressor()
        meta = json.loads(self.zstd.decompress(tail[docs + index :]))
        table = np.frombuffer(self.zstd.decompress(tail[:docs]), dtype="<i8") if meta["docs"] else np.zeros(0, "<i8")
        n = meta["docs"]
        self.docs: list[int | None] = table[:n].tolist()
        for i in table[2 * n :].tolist():
            self.docs[i] = None
        self.counts = table[n : 2 * n]
        self.planes = 4 if meta["kind"] == "byte" else 32
        flat = np.frombuffer(self.zstd.decompress(tail[docs : docs + index]), dtype="<i8") if meta["blocks"] else np.zeros(0, "<i8")
        self.index = flat.reshape(-1, 2 + self.planes)
        self.firsts = np.concatenate([[0], np.cumsum(self.index[:, 1])]) if len(self.index) else np.zeros(1, np.int64)

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k].tolist()
        self.file.seek(at)
        data, planes, p = self.file.read(sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.zstd.decompress(data[p : p + s]) if s else None)
            p += s
        return from_planes(planes, n)

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids low to high - 1 of the file."""
        if high <= low:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(self.firsts, [low, high - 1], side="right") - 1
        whole = np.concatenate([self.block(k) for k in range(a, b + 1)])
        return whole[low - self.firsts[a] : high - self.firsts[a]]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, block by block."""
        rest, k = np.zeros(0, "<u4"), 0
        for doc, n in zip(self.docs, self.counts.tolist()):
            if len(rest) < n:
                parts, have = [rest], len(rest)
                while have < n:
                    parts.append(self.block(k))
                    have += len(parts[-1])
                    k += 1
                rest = np.concatenate(parts)
            yield doc, rest[:n]
            rest = rest[n:]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, kind: str = "byte", level: int = 1) -> DataFrame:
    """Write all documents; the manifest of the files: position, part, path, n_ids, n_docs.

    docs: doc_id, text; other columns are ignored. A null text is empty and has the end id
    alone. Rows are in ascending doc_id order, nulls first. Rows with equal doc_id stand by a hash
    of their text from one file to the next, and by the text within a file.
    ``position`` orders the files of the corpus.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_dir(spark, "token-files")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours, out, files = encoder(tokenizer), None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc, ids in zip(some.column(0).to_pylist(), ours.encode(texts)):
                    out = out or Writer(folder, kind, level)
                    out.add(doc, ids + end)
                    if out.n_ids >= ROLL:
                        files.append(out.close())
                        out = None
        if out:
            files.append(out.close())
        if files:
            part = TaskContext.get().partitionId()
            columns = [[part] * len(files), list(range(len(files))), *zip(*files)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["position", "part", "path", "n_ids", "n_docs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return materialize(ranges.mapInArrow(write, "position long, part long, path string, n_ids long, n_docs long"), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all before it), n_tokens, ids_crc32.

    The driver adds up the counts of files, of which there is one for each range and ROLL ids.
    """
    spark = manifest.sparkSession
    at, listed = 0, []
    for row in manifest.orderBy("position", "part").collect():
        listed.append((row["path"], at))
        at += row["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for doc, ids in Reader(path).documents():
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(listed, "path string, start long")
    if listed:
        files = files.repartition(min(len(listed), 4 * spark.sparkContext.defaultParallelism))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
