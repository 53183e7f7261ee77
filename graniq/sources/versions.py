"""Tables in versions: tasks write files, the driver publishes one manifest.

A version is a JSON manifest that names its files, each with the bucket of keys that its rows are of. Tasks
write files under names of their own and report them; only the driver's commit makes them a version, by a
manifest that appears under its number at once. So a task that is lost or repeated leaves nothing but files that
no manifest names, readers see a whole version, and older versions stay readable.

``replace`` puts rows in the place of those with the same key: it rewrites the buckets of the new keys
alone, and takes all other files over from the version before. A stream commits each batch with its number,
and a batch that is committed already is passed over.

Two writers at once: the one that finds its number taken fails, and nothing of it is seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

BUCKETS = 64
#: Column by which a file's rows are told apart; not part of the table.
BUCKET = "__bucket"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _manifests(path: str) -> dict[int, str]:
    where, inner = _open(f"{path}/_versions")
    found = where.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return {int(f.base_name.removesuffix(".json")): f.path for f in found if f.base_name.endswith(".json")}


def latest(path: str) -> int:
    """The number of the last version, 0 where there is none."""
    return max(_manifests(path), default=0)


def manifest(path: str, version: int | None = None) -> dict:
    """files (name, bucket, rows), schema and batch of a version; of the last without a number."""
    known = _manifests(path)
    if not known:
        return {"files": [], "schema": None, "batches": {}}
    where, _ = _open(path)
    with where.open_input_stream(known[max(known) if version is None else version]) as file:
        return json.loads(file.read())


def _publish(path: str, version: int, content: dict) -> None:
    """Write a manifest beside its place and move it there; a number that is taken is an error."""
    where, inner = _open(f"{path}/_versions")
    where.create_dir(inner, recursive=True)
    draft, final = f"{inner}/.{uuid.uuid4().hex}", f"{inner}/{version:020d}.json"
    with where.open_output_stream(draft) as out:
        out.write(json.dumps(content).encode())
    if where.get_file_info(final).type != fs.FileType.NotFound:
        where.delete_file(draft)
        raise RuntimeError(f"version {version} of {path} has been written by another")
    where.move(draft, final)


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: name, bucket, rows."""

    files: list[tuple[str, int, int]]


class _Files:
    """What tasks and the commit have in common."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.base = int(options.get("base", "-1"))
        self.names = [f.name for f in schema.fields if f.name != BUCKET]
        self.schema = StructType([f for f in schema.fields if f.name != BUCKET]).json()
        self.bucketed = BUCKET in schema.fieldNames()
        self.stream = options.get("stream", "")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, inner = _open(f"{self.path}/data")
        where.create_dir(inner, recursive=True)
        open_: dict[int, tuple[str, pq.ParquetWriter]] = {}
        rows: dict[int, int] = {}
        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                for bucket in sorted(set(batch.column(BUCKET).to_pylist())) if self.bucketed else [-1]:
                    own = table.filter(pc.equal(table[BUCKET], bucket)) if self.bucketed else table
                    own = own.select(self.names)
                    if bucket not in open_:
                        name = f"{uuid.uuid4().hex}.parquet"
                        open_[bucket] = name, pq.ParquetWriter(f"{inner}/{name}", own.schema, filesystem=where, compression="zstd")
                    open_[bucket][1].write_table(own)
                    rows[bucket] = rows.get(bucket, 0) + own.num_rows
        finally:
            for _, writer in open_.values():
                writer.close()
        return Written([(name, bucket, rows[bucket]) for bucket, (name, _) in open_.items()])

    def publish(self, messages: list[Written | None], batch: int | None = None) -> None:
        before, number = manifest(self.path), latest(self.path)
        done = before["batches"]
        if batch is not None and done.get(self.stream, -1) >= batch:
            self.remove(messages)
            return
        if 0 <= self.base != number:
            raise RuntimeError(f"{self.path} has changed since version {self.base}")
        files = [list(f) for m in messages if m for f in m.files]
        touched = {bucket for _, bucket, _ in files}
        kept = [] if self.overwrite else [f for f in before["files"] if not (self.bucketed and f[1] in touched)]
        batches = done if batch is None else {**done, self.stream: batch}
        _publish(self.path, number + 1, {"files": kept + files, "schema": self.schema, "batches": batches})

    def remove(self, messages: list[Written | None]) -> None:
        where, inner = _open(f"{self.path}/data")
        for m in messages:
            for name, _, _ in m.files if m else []:
                where.delete_file(f"{inner}/{name}")


class VersionWriter(_Files, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        self.publish(messages)

    def abort(self, messages) -> None:
        self.remove(messages)


class VersionStreamWriter(_Files, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId) -> None:
        self.publish(messages, batchId)

    def abort(self, messages, batchId) -> None:
        self.remove(messages)


class VersionedTable(DataSource):
    """``df.write.format("versions").mode("append" or "overwrite").save(path)``; a stream takes the option ``stream``, the name by which its batches are known."""

    @classmethod
    def name(cls) -> str:
        return "versions"

    def writer(self, schema: StructType, overwrite: bool) -> VersionWriter:
        return VersionWriter(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> VersionStreamWriter:
        return VersionStreamWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VersionedTable)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, of the last without a number."""
    told = manifest(path, version)
    if told["schema"] is None:
        raise FileNotFoundError(f"{path} has no version")
    schema = StructType.fromJson(json.loads(told["schema"]))
    files = [f"{path}/data/{name}" for name, *_ in told["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def append(df: DataFrame, path: str) -> None:
    register(df.sparkSession)
    df.write.format("versions").mode("append").save(path)


def overwrite(df: DataFrame, path: str, key: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """A new version of these rows alone; with a key, in buckets by it, as ``replace`` needs them."""
    register(df.sparkSession)
    rows = df if key is None else _bucketed(df, key, buckets)
    rows.write.format("versions").mode("overwrite").save(path)


def _bucketed(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).repartition(BUCKET)


def replace(new: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> None:
    """A version in which the rows of ``new`` stand in the place of all with their keys; other rows stay. The table has been written by ``overwrite`` with the same key and buckets.

    A null key is a key like others.
    """
    spark = new.sparkSession
    register(spark)
    base, told = latest(path), manifest(path)
    rows = _bucketed(new, key, buckets)
    touched = {r[BUCKET] for r in rows.select(BUCKET).distinct().collect()}  # at most ``buckets`` numbers
    schema = StructType.fromJson(json.loads(told["schema"]))
    files = [f"{path}/data/{name}" for name, bucket, _ in told["files"] if bucket in touched]
    old = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    keys = new.select([F.col(k).alias(f"__{k}") for k in key]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    kept = _bucketed(old.join(keys, same, "left_anti"), key, buckets)
    kept.unionByName(rows.select(*old.columns, BUCKET)).repartition(BUCKET).write.format("versions").option("base", base).mode("append").save(path)
