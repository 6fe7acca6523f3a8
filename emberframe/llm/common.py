"""Helpers that the operators of this package share."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.workspace import fresh_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: what follows does not depend on this run's executors."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and text alone, so that no other column can clash with an operator's; a null text is empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def per_text(docs: DataFrame, rows: Callable[[list, list], dict[str, list]], schema: str) -> DataFrame:
    """``rows(doc_ids, texts)`` gives columns for a few hundred documents at a time; ``schema`` names and types them."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 512):
                piece = part.slice(at, 512)
                columns = rows(piece.column(0).to_pylist(), piece.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(batches, schema)


def _checksum(edges: DataFrame) -> tuple:
    """Number, sum and exclusive or of the edges' hashes: equal for equal sets of edges."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


#: Edges that one task takes at once, 16 bytes each.
GATHERED = 10_000


def _united(edges: DataFrame) -> DataFrame:
    """``a, b``: each node of a few edges and the smallest node reachable, where that is another one."""

    def unite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for part in parts:
            for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        found = [(x, root(x)) for x in list(parent)]
        found = [f for f in found if f[0] != f[1]]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return edges.select("a", "b").coalesce(1).mapInArrow(unite, "a long, b long")


def components(edges: DataFrame, label: str, gathered: int = 0) -> DataFrame:
    """Connected components: ``node, component`` (the smallest node reachable) for every node of ``a, b`` edges.

    Alternates large-star and small-star steps until nothing changes. Each step is two aggregations combined before
    their shuffle and two joins that adaptive execution splits when a node is hot; it is stored, so a lost executor costs
    one step. A node with a million neighbours is never gathered in one place. ``gathered`` edges or fewer, between BIGINT
    nodes, are united by one task instead, which takes one job in place of some dozens.
    """
    edges = stored(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-edges"
    )
    seen = _checksum(edges)
    while seen[0] > gathered:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        new = stored(small.filter("a != b").distinct(), f"{label}-step")
        before, seen, edges = seen, _checksum(new), new
        if seen == before:
            break
    else:  # few from the start, or left by a step that need not be the last
        edges = stored(_united(edges), f"{label}-step") if seen[0] else edges
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
