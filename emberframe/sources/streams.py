"""Python data sources: a sampler of a table by row offsets, a tail of stored batches, an exporter that commits batches.

Offsets say what has been read, so a query that starts again goes on where its checkpoint ends. The exporter's tasks write files
under new names; only a batch's commit makes its files part of the export, so that failed and repeated tasks leave no trace.
"""

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema

from emberframe.sources import plugins

SAMPLER, TAIL, EXPORTER = "emberframe_sampler", "emberframe_tail", "emberframe_exporter"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def _files(fs: pafs.FileSystem, folder: str) -> list[str]:
    return sorted(i.path for i in fs.get_file_info(pafs.FileSelector(folder)) if i.is_file and not i.base_name.startswith(("_", ".")))


def _batch_number(name: str) -> int | None:
    head, _, number = name.partition("=")
    return int(number) if head == "batch" and number.isdigit() else None


def stored_batches(path: str, after: int = -1) -> list[int]:
    """Numbers of the batch folders of a table, those above ``after``. Only folder names are listed."""
    fs, root = file_system(path)
    numbers = (_batch_number(i.base_name) for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)))
    return sorted(n for n in numbers if n is not None and n > after)


def any_file(path: str) -> str:
    """A file of the newest batch that has one."""
    fs, root = file_system(path)
    return next(f for b in reversed(stored_batches(path)) for f in _files(fs, f"{root}/batch={b}"))


def _schema_of(path: str) -> pa.Schema:
    fs, root = file_system(path)
    return pq.read_schema(root, filesystem=fs)


def _without_zone(schema: pa.Schema) -> pa.Schema:
    """Times in microseconds, which is what Spark holds."""
    return pa.schema([pa.field(f.name, pa.timestamp("us", f.type.tz)) if pa.types.is_timestamp(f.type) else pa.field(f.name, f.type) for f in schema])


@dataclass
class Rows(InputPartition):
    """Rows ``first`` to before ``end`` of a file."""

    path: str
    first: int
    end: int


class SamplerSource(DataSource):
    """The rows of a Parquet file ``path`` in the order they are written, as if they came one after the other.

    ``until``: how many rows there are so far (all, if left out); ``rows``: the most that a task reads."""

    @classmethod
    def name(cls):
        return SAMPLER

    def schema(self):
        return from_arrow_schema(_without_zone(_schema_of(self.options["path"])), prefer_timestamp_ntz=True)

    def streamReader(self, schema):
        return SamplerReader(self.options)


class SamplerReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.until = int(options.get("until", -1))
        self.rows = int(options.get("rows", 100_000))

    def initialOffset(self):
        return {"row": 0}

    def latestOffset(self):
        fs, path = file_system(self.path)
        there = pq.read_metadata(path, filesystem=fs).num_rows
        return {"row": there if self.until < 0 else min(there, self.until)}

    def partitions(self, start, end):
        return [Rows(self.path, at, min(at + self.rows, end["row"])) for at in range(start["row"], end["row"], self.rows)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(partition.path)
        file = pq.ParquetFile(path, filesystem=fs)
        schema = _without_zone(file.schema_arrow)
        at = 0
        for group in range(file.num_row_groups):
            n = file.metadata.row_group(group).num_rows
            if at < partition.end and at + n > partition.first:
                for batch in file.iter_batches(row_groups=[group]):
                    low, high = max(partition.first - at, 0), min(partition.end - at, batch.num_rows)
                    if low < high:
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.slice(low, high - low).columns, schema)], schema=schema)
                    at += batch.num_rows
            else:
                at += n


class TailSource(DataSource):
    """Batches of a table stored below ``path`` in folders ``batch=<number>``, those after ``after``. The offset is the number
    of the last batch read; folders up to it are neither listed nor opened. ``like`` is a file that has the columns."""

    @classmethod
    def name(cls):
        return TAIL

    def schema(self):
        return from_arrow_schema(_without_zone(_schema_of(self.options["like"])), prefer_timestamp_ntz=True)

    def streamReader(self, schema):
        return TailReader(self.options)


@dataclass
class Stored(InputPartition):
    path: str


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.after = int(options.get("after", -1))

    def initialOffset(self):
        return {"batch": self.after}

    def latestOffset(self):
        return {"batch": max(stored_batches(self.path, self.after), default=self.after)}

    def partitions(self, start, end):
        fs, root = file_system(self.path)
        batches = [b for b in stored_batches(self.path, start["batch"]) if b <= end["batch"]]
        return [Stored(f) for b in batches for f in _files(fs, f"{root}/batch={b}")]

    def read(self, partition: Stored) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        file = pq.ParquetFile(partition.path, filesystem=fs)
        schema = _without_zone(file.schema_arrow)
        for batch in file.iter_batches():
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    """A file that a task has written, none if it had no rows."""

    path: str | None
    rows: int


class ExporterSource(DataSource):
    """Micro-batches as Parquet files below ``path``; ``commits/<batch>.json`` names those of a batch."""

    @classmethod
    def name(cls):
        return EXPORTER

    def streamWriter(self, schema, overwrite):
        return ExporterWriter(self.options["path"])


class ExporterWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        name, rows, out = f"{root}/data/{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if out is None:
                    fs.create_dir(f"{root}/data", recursive=True)
                    out = pq.ParquetWriter(name, batch.schema, filesystem=fs)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, rows)

    def commit(self, messages: list, batchId: int) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(f"{root}/commits", recursive=True)
        named = {"files": [m.path for m in messages if m is not None and m.path], "rows": sum(m.rows for m in messages if m is not None)}
        # whole or not at all; a batch committed again replaces itself
        draft = f"{root}/commits/.{batchId}-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps(named).encode())
        fs.move(draft, f"{root}/commits/{batchId}.json")

    def abort(self, messages: list, batchId: int) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            if m is not None and m.path and fs.get_file_info(m.path).type != pafs.FileType.NotFound:
                fs.delete_file(m.path)


def committed_files(path: str) -> list[str]:
    """Files of all batches that have been committed."""
    fs, root = file_system(path)
    out = []
    for name in _files(fs, f"{root}/commits"):
        with fs.open_input_stream(name) as commit:
            out += json.loads(commit.read())["files"]
    return out


def read_export(spark: SparkSession, path: str, schema) -> DataFrame:
    """What has been committed; ``schema`` serves an export without rows."""
    files = committed_files(path)
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def register_streams(spark: SparkSession) -> None:
    """The sources of this module as plugins, known to the session."""
    for source in (SamplerSource, TailSource, ExporterSource):
        if source.name() not in plugins.by_kind("source"):
            plugins.register("source", source.name(), lambda source=source: source)
    plugins.register_data_sources(spark)
