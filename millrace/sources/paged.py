"""A catalog read page by page as a stream that can be resumed, and reports and tables that are written whole or not at all.

Files are reached through pyarrow's file systems, by the driver for what it lists and by the tasks for what they read or
write: a path may be local, or a URI of a store that pyarrow knows.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from . import sinks


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Rows(InputPartition):
    """Rows from..to of one row group of one file; the first of them is row `at` of the catalog."""

    file: str
    group: int
    start: int
    end: int
    at: int


class PageStream(DataSourceStreamReader):
    """Offsets are pages; a batch reads the pages between two offsets, each row group that holds some of them once."""

    def __init__(self, options: dict):
        self.path, self.page = options["path"], int(options.get("page", 50))
        self.until = int(options["until"]) if "until" in options else None
        self.columns = [c.strip() for c in options["columns"].split(",")]

    def groups(self) -> list[tuple[str, int, int]]:
        """(file, row group, rows) in order, from the files' footers."""
        store, path = opened(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        out = []
        for f in sorted(x.path for x in found if x.type == fs.FileType.File and x.path.endswith(".parquet")):
            about = parquet.read_metadata(f, filesystem=store)
            out += [(f, g, about.row_group(g).num_rows) for g in range(about.num_row_groups)]
        return out

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        pages = -(-sum(n for _, _, n in self.groups()) // self.page)
        return {"page": pages if self.until is None else min(pages, self.until)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.between(start["page"] * self.page, end["page"] * self.page)

    def between(self, first: int, last: int) -> list[Rows]:
        """The row groups, or parts of them, that hold the catalog's rows from `first` up to `last`."""
        at, out = 0, []
        for file, group, n in self.groups():
            if at < last and at + n > first:
                out.append(Rows(file, group, max(0, first - at), min(n, last - at), max(at, first)))
            at += n
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        rows = parquet.ParquetFile(store.open_input_file(partition.file)).read_row_group(partition.group, columns=self.columns).slice(partition.start, partition.end - partition.start)
        page = pa.array([(partition.at + i) // self.page for i in range(rows.num_rows)], pa.int32())
        yield from rows.select(self.columns).append_column("page", page).to_batches()

    def commit(self, end: dict) -> None:
        """Nothing to do: pages stay where they are, and the stream's checkpoint says which have been read."""


class PagedStream(DataSource):
    """spark.dataSource.register(PagedStream); readStream.format("paged_stream").schema(...) with the columns and `page`.

    Options: path (Parquet in the order of the cursor), columns, page (rows of one), until (pages offered at most).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_stream"

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


@dataclass
class Part(WriterCommitMessage):
    file: str
    rows: int


MANIFEST = "_manifest.json"


class ReportWriter(DataSourceArrowWriter):
    """Tasks write JSON lines to a folder of their job; committing lists them in the manifest, which is put in place last.

    Readers read what the manifest lists: of a job that failed, or a task that was run again, nothing is seen.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, path = opened(self.path)
        task = TaskContext.get()
        name, n = f"{self.job}/part-{task.partitionId():05}-{task.taskAttemptId()}.jsonl", 0
        store.create_dir(f"{path}/{self.job}", recursive=True)
        with store.open_output_stream(f"{path}/{name}") as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(json.dumps(row, default=str, ensure_ascii=False, separators=(",", ":")).encode() + b"\n")
                    n += 1
        return Part(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = opened(self.path)
        parts = [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.rows]
        kept = [] if self.overwrite else listed(store, path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{MANIFEST}.{self.job}") as out:
            out.write(json.dumps(kept + parts).encode())
        store.move(f"{path}/{MANIFEST}.{self.job}", f"{path}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = opened(self.path)
        if store.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.job}")


def listed(store: fs.FileSystem, path: str) -> list[dict]:
    if store.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.File:
        return []
    with store.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


class ReportReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(p["file"]) for p in listed(*opened(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        store, path = opened(self.path)
        with store.open_input_stream(f"{path}/{partition.value}") as f:
            for line in io.TextIOWrapper(f, "utf-8", newline="\n"):
                yield (line.removesuffix("\n"),)


class JsonReport(DataSource):
    """spark.dataSource.register(JsonReport); write.format("json_report").save(path), and read back as lines of JSON."""

    @classmethod
    def name(cls) -> str:
        return "json_report"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], overwrite)

    def reader(self, schema) -> ReportReader:
        return ReportReader(self.options["path"])


class UpsertTable:
    """A table that batches are upserted into by key, each under its number.

    Rows are dealt into buckets by key. A batch writes new files for the buckets that it has rows of, and then its
    manifest: which files each bucket has now. Batches before it are read through the last manifest with a smaller number,
    so a batch that comes again writes the same again, and one that fails before its manifest leaves nothing to be seen.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets
        self.manifests = f"{path}/manifest"

    def _files(self, before: int | None = None) -> dict[int, str]:
        """The folder of each bucket, as of all batches, or of those before one."""
        self.spark.createDataFrame([], "bucket int, folder string, batch long").write.mode("ignore").partitionBy("batch").parquet(self.manifests)
        rows = self.spark.read.schema("bucket int, folder string, batch long").parquet(self.manifests)
        rows = rows if before is None else rows.where(F.col("batch") < before)
        last = rows.agg(F.max("batch")).first()[0]
        return {} if last is None else {r["bucket"]: r["folder"] for r in rows.where(F.col("batch") == last).collect()}  # a row a bucket

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        return self._read(sorted(self._files().values()))

    def upsert(self, batch: DataFrame, number: int, order: list[str] | None = None) -> None:
        """batch's rows in place of those of their keys; of rows that share a key the last by `order` (or by all columns) counts."""
        names = self._read([]).columns
        last = F.max(F.struct(*[F.col(c).alias(f"_by_{c}") for c in order or []], *[c for c in names if c not in self.keys]))
        fresh = batch.groupBy(*self.keys).agg(last.alias("_last")).select(*self.keys, *[F.col(f"_last.{c}").alias(c) for c in names if c not in self.keys]).select(*names)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        fresh = fresh.persist()
        try:
            touched = [r["bucket"] for r in fresh.select(bucket).distinct().collect()]  # at most a row a bucket
            held = self._files(number)
            out = f"{self.path}/data/batch={number}"
            merged = sinks.upsert(self._read([held[b] for b in touched if b in held]), fresh, self.keys)
            merged.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
            now = held | {b: f"{out}/bucket={b}" for b in touched}
            self.spark.createDataFrame(sorted(now.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.manifests}/batch={number}")
        finally:
            fresh.unpersist()

    def sink(self, order: list[str] | None = None):
        """For writeStream.foreachBatch."""
        return lambda df, number: self.upsert(df, number, order)
