"""Vectors as rows in, blocks of a bounded number of vectors out."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import numpy as np


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v`` (array of double) of the rows whose vector is there, not empty and holds finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of equally long lists as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def blocks_of(rows: DataFrame, keys: list[str], block: Column | str) -> DataFrame:
    """One row per key and block: ``ids`` and ``vectors`` as bytes (int64, float64), ids ascending."""
    schema = ", ".join(f"{k} long" for k in keys) + ", block long, n long, ids binary, vectors binary"

    def packed(group: pa.Table) -> pa.Table:
        ids, v = group["vec_id"].to_numpy(), matrix(group["v"])
        order = np.argsort(ids, kind="stable")
        head = {k: pa.array([group[k][0].as_py()], pa.int64()) for k in [*keys, "block"]}
        return pa.table(
            head
            | {
                "n": pa.array([len(ids)], pa.int64()),
                "ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()),
                "vectors": pa.array([np.ascontiguousarray(v[order]).tobytes()], pa.binary()),
            }
        )

    block = F.col(block) if isinstance(block, str) else block
    return rows.withColumn("block", block.cast("long")).select(*keys, "block", "vec_id", "v").groupBy(*keys, "block").applyInArrow(packed, schema)


def met(candidates: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Each block of candidates with each block of queries of the same keys: ``query_ids, queries, ids, vectors``.

    Both sides are repeated for the other's blocks and joined on both numbers, so that the pairs spread over all tasks
    however few keys there are. Only numbers of blocks are gathered per key, never blocks.
    """
    asked = queries.select(*keys, F.col("block").alias("other")).groupBy(*keys).agg(F.collect_list("other").alias("others"))
    held = candidates.select(*keys, "block").groupBy(*keys).agg(F.collect_list("block").alias("blocks"))
    left = candidates.join(asked, keys).withColumn("other", F.explode("others"))
    right = queries.join(held, keys).select(
        *keys, F.explode("blocks").alias("block"), F.col("block").alias("other"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")
    )
    return left.select(*keys, "block", "other", "ids", "vectors").join(right, [*keys, "block", "other"]).select(*keys, "query_ids", "queries", "ids", "vectors")


def unpacked(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, np.float64).reshape(len(ids), -1)


def best_of(partial: DataFrame, k: int, score: str) -> DataFrame:
    """From ``query_id, top`` (arrays of (score, vec_id) structs, one per part) the ``k`` best of each query, highest
    first, ties to the smaller id. A query has one short array per part, and the parts are merged by a sorted array."""
    ordered = F.array_sort(F.flatten(F.collect_list("top")), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0))
    best = partial.groupBy("query_id").agg(F.slice(ordered, 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").cast(score).alias("score")
    )


def top_rows(query_ids: np.ndarray, query: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    """``query_id, top`` rows: the ``k`` best of the hits (number of the query, score, id) of each query."""
    order = np.lexsort((ids, -scores, query))
    query, scores, ids = query[order], scores[order], ids[order]
    begin = np.searchsorted(query, np.arange(len(query_ids) + 1))
    keep = np.arange(len(query)) - begin[query] < k
    ends = np.concatenate([[0], np.cumsum(np.minimum(np.diff(begin), k))])
    hits = pa.StructArray.from_arrays([pa.array(scores[keep], pa.float64()), pa.array(ids[keep], pa.int64())], ["score", "vec_id"])
    top = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)
    return pa.RecordBatch.from_arrays([pa.array(query_ids, pa.int64()), top], ["query_id", "top"])


TOP = "query_id long, top array<struct<score:double,vec_id:long>>"
