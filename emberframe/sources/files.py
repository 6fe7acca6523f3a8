"""Trace and snapshot files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.functions.scalars import file_timestamp
from emberframe.operators.tree_json import decode_files, decode_parts, tree_lines
from emberframe.schemas import TRACE_EVENTS


def _with_defaults(events: DataFrame) -> DataFrame:
    """Numbers left out of a record are 0."""
    return events.select(
        *[
            F.col(f.name) if isinstance(f.dataType, T.ArrayType) else F.coalesce(f.name, F.lit(0).cast(f.dataType)).alias(f.name)
            for f in TRACE_EVENTS.fields
        ]
    )


def read_trace_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Trace files with one JSON event per line; a bad line fails the query."""
    return _with_defaults(spark.read.schema(TRACE_EVENTS).option("mode", "FAILFAST").json(path))


def stream_trace_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """The same for a folder to which files keep being added."""
    return _with_defaults(spark.readStream.schema(TRACE_EVENTS).option("mode", "FAILFAST").json(path))


#: Folder of one part of a snapshot's text.
PART = r"/part=([0-9]+)/[^/]*$"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files (JSON, plain or gzip, told apart by content) as frame rows; the file is the snapshot. Files in folders
    ``part=<number>`` are the parts of one text, as ``write_snapshots`` leaves them; the folder above is the snapshot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    is_part = F.col("path").rlike(PART)
    parts = files.select("path").filter(is_part)  # names alone, no contents
    if parts.isEmpty():
        return decode_files(files)
    of_parts = decode_parts(files.filter(is_part), F.regexp_replace("path", PART, "/"), F.regexp_extract("path", PART, 1))
    return of_parts if files.select("path").filter(~is_part).isEmpty() else of_parts.unionByName(decode_files(files.filter(~is_part)))


def write_snapshots(
    frames: DataFrame, path: str, us: Column, prefix: str = "snapshot", compress: bool = False, keys: list[str] = ["snapshot_id"]
) -> None:
    """One JSON document per snapshot, in a folder ``snapshot=<prefix>-<time>-<id>``; the target must not exist.

    ``us`` is the time of a snapshot as an expression of its keys. A document is written in as many parts as the ranges of
    nodes that it lies in, ``part=00000`` and so on: put together in their order, the files are the document. No task holds one.
    """
    name = F.concat_ws("-", F.lit(prefix), file_timestamp(us), *keys)
    (
        tree_lines(frames, keys)
        .select(name.alias("snapshot"), F.format_string("%05d", "_part").alias("part"), "_row", F.col("line").alias("value"))
        .sortWithinPartitions("snapshot", "part", "_row")
        .drop("_row")
        .write.mode("errorifexists")
        .option("compression", "gzip" if compress else "none")
        .partitionBy("snapshot", "part")
        .text(path)
    )
