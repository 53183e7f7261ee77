"""Media columns: payloads as PNG images in ZIP archives, read by a custom data source.

A payload is stored as the samples of an 8-bit grey image 64 samples wide. Tasks write
archives under names of their own and return manifest rows; only archives of the manifest
are read. The data source plans byte ranges of the archives: a task takes the members
that begin in its range, as the archive's directory tells, streams them as bounded Arrow
batches, checks each against the directory's checksum, and reads a member that fails again
by its offset, alone, before it gives up on that member only.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graniq.llm.storage import bounded_batches, materialize, open_fs, shared_dir

WIDTH = 64
ROLL = 64 << 20
BATCH = 8 << 20
_MANIFEST = pa.schema([("path", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())])
_MEMBERS = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("attempts", pa.int32()), ("error", pa.string())])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(content: bytes) -> bytes:
    """A grey image of the content, padded with zeros to a positive multiple of 64; its length is in a text chunk."""
    rows = max(1, -(-len(content) // WIDTH))
    lines = np.zeros((rows, WIDTH + 1), dtype=np.uint8)  # each line begins with filter type 0
    flat = np.zeros(rows * WIDTH, dtype=np.uint8)
    flat[: len(content)] = np.frombuffer(content, dtype=np.uint8)
    lines[:, 1:] = flat.reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(content)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[bytes, int]:
    """All samples, and the length of the content before padding. For unfiltered grey images."""
    at, data, n, rows = 8, [], -1, 0
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, rows, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not an 8-bit grey image of this width")
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n = int(body[8:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(rows, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read")
    return lines[:, 1:].tobytes(), n


def write_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> str:
    """Write a member per row; the folder, whose manifest lists its archives. A null text is empty, a null key is named null; repeated rows are members of their own; an empty table gives no archive."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_dir(spark, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(folder)
        fs.create_dir(where, recursive=True)
        done, pack, n = [], None, 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if pack is None:
                    path = f"{folder}/{uuid.uuid4().hex}.zip"
                    sink = fs.open_output_stream(open_fs(path)[1])
                    pack, n = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED), 0
                pack.writestr(zipfile.ZipInfo(f"{'null' if name is None else name}-{n:08d}.png"), to_png((content or "").encode("utf-8", "surrogatepass")))
                n += 1
                if sink.tell() >= ROLL:
                    pack.close()
                    done.append((path, n, sink.tell()))
                    sink.close()
                    pack = None
        if pack is not None:
            pack.close()
            done.append((path, n, sink.tell()))
            sink.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _MANIFEST)], schema=_MANIFEST)

    files = docs.select(F.col(key), F.col(text)).mapInArrow(write, "path string, members long, bytes long")
    manifest = materialize(files, "media-manifest")
    # A row per archive, of at least ROLL bytes each but for one a task.
    listed = [[r["path"], r["bytes"]] for r in manifest.select("path", "bytes").toLocalIterator()]
    fs, where = open_fs(folder)
    fs.create_dir(where, recursive=True)
    with fs.open_output_stream(f"{where}/_manifest.json") as out:
        out.write(json.dumps(listed).encode())
    return folder


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``; options rangeBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary, attempts int, error string"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.size = int(options.get("rangebytes", options.get("rangeBytes", 16 << 20)))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[InputPartition]:
        fs, where = open_fs(self.folder)
        with fs.open_input_stream(f"{where}/_manifest.json") as file:
            listed = json.loads(file.read())
        size = max(self.size, sum(n for _, n in listed) // 100_000)
        return [_Range(path, low, min(low + size, n)) for path, n in listed for low in range(0, n, size)] or [_Range("", 0, 0)]

    def open(self, path: str):
        fs, where = open_fs(path)
        return fs.open_input_file(where)

    def member(self, file, info: zipfile.ZipInfo) -> bytes:
        """The bytes of the member at its offset, checked against the directory."""
        file.seek(info.header_offset)
        head = file.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise OSError(f"member {info.filename} at {info.header_offset} has no header")
        skip = sum(struct.unpack_from("<HH", head, 26))
        data = file.read(skip + info.compress_size)[skip:]
        if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
            raise OSError(f"member {info.filename} at {info.header_offset} is damaged")
        return data

    def directory(self, path: str) -> list[zipfile.ZipInfo]:
        """The archive's members, read again after an error like a member is."""
        for attempt in range(self.retries + 1):
            try:
                with self.open(path) as file:
                    return zipfile.ZipFile(file).infolist()
            except (OSError, zipfile.BadZipFile) as e:
                error = e
        raise OSError(f"the directory of {path} can't be read: {error}")

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        rows, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MEMBERS)], schema=_MEMBERS)
        try:
            listed = [x for x in self.directory(part.path) if part.low <= x.header_offset < part.high]
        except OSError as e:  # no member can be found without it: one row says so, from the archive's first range
            if part.low == 0:
                rows.append((part.path, None, None, None, self.retries + 1, str(e)))
                yield batch()
            return
        file = None
        try:
            for info in listed:
                data, error, attempts = None, None, 0
                while data is None and attempts <= self.retries:
                    attempts += 1
                    try:
                        file = file or self.open(part.path)
                        data, error = self.member(file, info), None
                    except (OSError, struct.error, zlib.error) as e:
                        error = str(e)
                        if file is not None:
                            file.close()
                        file = None
                rows.append((part.path, info.filename, info.header_offset, data, attempts, error))
                size += len(data or b"")
                if size >= BATCH:
                    yield batch()
                    rows, size = [], 0
        finally:
            if file is not None:
                file.close()
        if rows:
            yield batch()


def read_media(spark: SparkSession, folder: str, range_bytes: int = 16 << 20, retries: int = 3) -> DataFrame:
    """A row per member: archive, member, offset, media (null after all retries failed), attempts, error.

    A damaged or cut off member costs itself alone; an archive whose directory can't be read is a
    row without a member.
    """
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("rangeBytes", str(range_bytes)).option("retries", str(retries)).load(folder)


def features(samples: bytes) -> str:
    """Sum, sum of squares, and crossings of the middle level, of all samples."""
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256)
    high = x >= 128
    return f"sum={int(counts @ level)};squares={int(counts @ (level * level))};crossings={int(np.count_nonzero(high[1:] != high[:-1]))}"

