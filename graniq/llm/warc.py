"""WARC archives and revisit resolution.

Archives hold one gzip member per record. Tasks write archives under names of their own
into the shared folder and return a manifest row for each; only archives in the manifest
(written once, as a table) count, so a repeated or lost task leaves nothing but unread files.

Resolution reads the headers, shuffles them by payload digest, takes the original of each
digest, and joins the others to it. Each archive is then rewritten by one streaming task
that knows the revisits of that archive: payloads are never shuffled.

Archives may come from elsewhere. Revisits in them stay revisits: they are joined to the original of
the digest that they name, and keep what they say of it where no such payload is in the input.
Records that are neither responses nor revisits are handed on as they are. So resolving twice
gives what resolving once does.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniq.llm.storage import bounded_batches, materialize, open_fs, shared_dir

MANIFEST = "path string, records long, bytes long"
HEADERS = "path string, offset long, page_id long, url string, date string, record_type string, refers_to long, payload_bytes long, payload_digest string, name string"
_HEADERS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("name", pa.string())])
_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL = 96 << 20


def _uri(text: str | None) -> str | None:
    return text if text is None else text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(text: str | None) -> str | None:
    return text if text is None else text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


class Original(NamedTuple):
    """What a revisit says of the record that it refers to; null where it says nothing."""

    name: str | None
    url: str | None
    date: str | None


#: Names of the fields that are read, whatever their case in the archive.
_FIELDS = {n.lower(): n for n in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Refers-To-Date", "WARC-Refers-To-Target-URI", "WARC-Profile", "Content-Length")}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _packed(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _member(lines: list[str], block: bytes) -> bytes:
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""])
    return _packed(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n")


def info(name: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: graniq\r\nformat: WARC File Format 1.1\r\n"
    return _member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {_now()}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], block)


def page_name(page_id: int | None) -> str:
    """The id of a page's record; rows with the same page_id have the same."""
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(name: str, url: str | None, head: bytes, payload: bytes, digest: str | None, date: str, refers_to: Original | None = None, profile: str = PROFILE) -> bytes:
    """A record as a gzip member; a revisit, which refers to an original, has the HTTP header and no payload. digest: as the field has it; date: of the capture."""
    lines = [f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if digest is not None:
        lines.append(f"WARC-Payload-Digest: {digest}")
    if refers_to:
        lines.append(f"WARC-Profile: {profile}")
        told = [("WARC-Refers-To", refers_to.name), ("WARC-Refers-To-Date", refers_to.date), ("WARC-Refers-To-Target-URI", _uri(refers_to.url))]
        lines += [f"{field}: {value}" for field, value in told if value is not None]
    return _member([*lines, "Content-Type: application/http;msgtype=response"], head if refers_to else head + payload)


def sha1_field(payload: bytes) -> str:
    return f"sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}"


def _digest(text: str | None) -> str | None:
    """A payload's digest as bare hex where it is a SHA-1, in base 32 or 16; of another kind as it is."""
    kind, _, value = (text or "").partition(":")
    if kind.lower() != "sha1":
        return text
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in " \t" and last:  # a value goes on in the next line
            fields[last] += " " + line.strip()
            continue
        field, _, value = line.partition(":")
        last = _FIELDS.get(field.strip().lower(), field.strip())
        fields[last] = value.strip()
    return fields, rest[: int(fields["Content-Length"])]


def _parted(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header, with the blank line after it, and payload of a response's block."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark else (b"", block)


def members(path: str) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every gzip member, one at a time."""
    fs, where = open_fs(path)
    with fs.open_input_stream(where) as file:
        data, at = file.read(1 << 20), 0
        while data:
            unpack, parts, took = zlib.decompressobj(31), [], 0
            while True:
                parts.append(unpack.decompress(data))
                took += len(data) - len(unpack.unused_data)
                if unpack.eof:
                    break
                if not (data := file.read(1 << 20)):
                    raise EOFError(f"{path}: the member at {at} is cut off")
            yield at, b"".join(parts)
            at += took
            data = unpack.unused_data or file.read(1 << 20)


def _id(name: str | None) -> int | None:
    """The page_id that a record's id names; none in archives from elsewhere."""
    inner = name[len("<urn:page:") : -1] if name and name.startswith("<urn:page:") else "null"
    return int(inner) if inner.lstrip("-").isdigit() else None


def read_headers(paths: Iterator[str]) -> Iterator[pa.RecordBatch]:
    """A row per response or revisit; length and digest are those of the payload just read, for revisits those the record names."""
    rows: list[tuple] = []
    for path in paths:
        for offset, raw in members(path):
            fields, block = parse(raw)
            if fields["WARC-Type"] not in ("response", "revisit"):
                continue
            if fields["WARC-Type"] == "revisit":
                size, digest = None, _digest(fields.get("WARC-Payload-Digest"))
            else:
                payload = _parted(block)[1]
                size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            name = fields["WARC-Record-ID"]
            rows.append((path, offset, _id(name), _plain(fields.get("WARC-Target-URI")), fields["WARC-Date"], fields["WARC-Type"], _id(fields.get("WARC-Refers-To")), size, digest, name))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _HEADERS)], schema=_HEADERS)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _HEADERS)], schema=_HEADERS)


class _Archive:
    """Archives of a task, a new one after ROLL bytes."""

    def __init__(self, folder: str):
        self.folder, self.done, self.file = folder, [], None

    def add(self, member: bytes) -> None:
        if self.file is None:
            fs, where = open_fs(self.folder)
            fs.create_dir(where, recursive=True)
            self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            head = info(self.path.rpartition("/")[2])
            self.file, self.records, self.bytes = fs.open_output_stream(open_fs(self.path)[1]), 0, len(head)
            self.file.write(head)
        self.file.write(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)
        if self.bytes >= ROLL:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((self.path, self.records, self.bytes))
            self.file = None

    def manifest(self) -> Iterator[pa.RecordBatch]:
        self.close()
        if self.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.done), _MANIFEST)], schema=_MANIFEST)


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write each row as a response record; the manifest of the archives. A null html is an empty payload; null ids and urls stay null; other columns are ignored."""
    bounded_batches(pages.sparkSession)
    folder = shared_dir(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Archive(folder)
        for batch in batches:
            for key, link, text in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (text or "").encode("utf-8", "surrogatepass")
                out.add(record(page_name(key), link, HTTP % len(payload), payload, sha1_field(payload), _now()))
        yield from out.manifest()

    rows = pages.select(F.col(page_id).cast("long"), F.col(url), F.col(html))
    return materialize(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def _spread(spark: SparkSession, df: DataFrame, files: int) -> DataFrame:
    """A task per archive, up to a few per slot."""
    return df.repartition(max(1, min(files, 4 * spark.sparkContext.defaultParallelism)))


def headers(manifest: DataFrame) -> DataFrame:
    """HEADERS of all records of the archives, payloads read and measured in streaming tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from read_headers(batch.column(0).to_pylist())

    return _spread(manifest.sparkSession, manifest.select("path"), manifest.count()).mapInArrow(read, HEADERS)


def resolve(heads: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """What becomes of records: path, offset, refers_to (name, url and date of the original).

    Of responses with equal payloads of at least min_bytes, that with the largest page_id stays
    (nulls are least; of these, the first by path and offset), and the others become revisits of it.
    Revisits of the input refer to the response, of any size, that stays of the digest which they name;
    those whose digest no response has are not in the table.

    Only digests that occur twice meet the join; counting them is combined before the
    shuffle, and a digest that many records share is split by the adaptive skew join.
    """
    place = F.struct((-F.hash("path").cast("long")).alias("h"), F.col("path"), (-F.col("offset")).alias("o"))
    response = F.col("record_type") == "response"
    best = heads.filter(F.col("payload_digest").isNotNull()).groupBy("payload_digest").agg(F.max(F.when(response, F.struct("page_id", place.alias("p"), "name", "url", "date"))).alias("best"), F.count("*").alias("n"))
    best = best.filter("n > 1 AND best IS NOT NULL").select("payload_digest", "best")
    own = heads.filter(~response | (F.col("payload_bytes") >= min_bytes)).select("path", "offset", "payload_digest")
    both = own.join(best, "payload_digest")
    again = both.filter(~((F.col("path") == F.col("best.p.path")) & (F.col("offset") == -F.col("best.p.o"))))
    return again.select("path", "offset", F.struct("best.name", "best.url", "best.date").alias("refers_to"))


def deduplicate(manifest: DataFrame, heads: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write the archives anew, revisits without payload, all with fresh headers; their manifest.

    A header is made from the record's id, uri and capture date, its payload's digest computed anew,
    and of a revisit what its original says. Revisits of the input keep their digest and profile, and what they say of an
    original that isn't in the input. Records of other types are copied. A task gets an archive's path and its revisits, at most
    as many as the archive has records.
    """
    spark = manifest.sparkSession
    folder = shared_dir(spark, "warc-dedup")
    revisits = resolve(heads, min_bytes).groupBy("path").agg(F.collect_list(F.struct("offset", "refers_to")).alias("revisits"))
    plan = manifest.select("path").join(revisits, "path", "left")

    def fresh(raw: bytes, original: Original | None) -> bytes | None:
        fields, block = parse(raw)
        if fields["WARC-Type"] == "warcinfo":  # each archive has its own
            return None
        if fields["WARC-Type"] not in ("response", "revisit"):
            return _packed(raw)
        head, payload = _parted(block)
        told = fields["WARC-Record-ID"], _plain(fields.get("WARC-Target-URI")), head, payload
        if fields["WARC-Type"] == "response":
            return record(*told, sha1_field(payload), fields["WARC-Date"], original)
        said = Original(fields.get("WARC-Refers-To"), _plain(fields.get("WARC-Refers-To-Target-URI")), fields.get("WARC-Refers-To-Date"))
        return record(*told, fields.get("WARC-Payload-Digest"), fields["WARC-Date"], original or said, fields.get("WARC-Profile", PROFILE))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Archive(folder)
        for batch in batches:
            for path, revisits in zip(*(c.to_pylist() for c in batch.columns)):
                target = {r["offset"]: Original(**r["refers_to"]) for r in revisits or []}
                for offset, raw in members(path):
                    if (member := fresh(raw, target.get(offset))) is not None:
                        out.add(member)
        yield from out.manifest()

    return materialize(_spread(spark, plan.select("path", "revisits"), manifest.count()).mapInArrow(rewrite, MANIFEST), "warc-dedup-manifest")


def resolved(heads: DataFrame) -> DataFrame:
    """Headers of deduplicated archives; revisits joined to their responses for the payload's length. A key may be that of several responses; the digest is part of the join."""
    kept = heads.filter(F.col("record_type") == "response")
    sizes = kept.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("size"))
    again = heads.filter(F.col("record_type") == "revisit").drop("payload_bytes")
    same = again["refers_to"].eqNullSafe(sizes["refers_to"]) & (again["payload_digest"] == sizes["payload_digest"])
    joined = again.join(sizes, same, "left").select(*[again[c] for c in again.columns], F.col("size").alias("payload_bytes"))
    return kept.unionByName(joined)
