"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

The candidates are dealt into blocks. A block has one list per component, sorted by value. A query reads every list from
its better end, some entries at a time, and keeps for each candidate the sum of what it has read: with the worst value of
each unread list that is a lower bound of its score, with the value last read an upper bound. It stops reading when no
candidate outside the k best lower bounds can reach them, and resolves the scores of the few that are left.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import table
from emberframe.llm.vectors import TOP, best_of, blocks_of, met, top_rows, unpacked, usable

#: Vectors in a block of candidates and in a block of queries.
BLOCK, QUERIES = 4096, 512
#: Shares of the lists at which the bounds are looked at.
STEPS = (0.25, 0.5, 0.7, 0.85, 1.0)


def search(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Candidates left when reading stops, among them the k best of each query, never itself: number of the query, score,
    id. Integer components, exact in doubles."""
    n, dims = x.shape
    order = np.argsort(-x, axis=0, kind="stable")
    sorted_x = np.take_along_axis(x, order, axis=0)
    from_top = np.empty((n, dims), np.int32)
    np.put_along_axis(from_top, order, np.broadcast_to(np.arange(n, dtype=np.int32)[:, None], (n, dims)), axis=0)
    found = []
    active = np.arange(len(queries))
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    partial = np.zeros((n, len(queries)))
    read = 0
    for share in STEPS:
        depth = max(1, int(np.ceil(share * n)))
        # the next entries of each list, from the top for positive weights and from the bottom for negative ones
        new_up = (from_top >= read) & (from_top < depth)
        new_down = (from_top < n - read) & (from_top >= n - depth)
        partial += np.where(new_up, x, 0) @ up[active].T + np.where(new_down, x, 0) @ down[active].T
        read = depth
        last_up, last_down = sorted_x[depth - 1], sorted_x[n - depth]
        worst_up, worst_down = sorted_x[-1], sorted_x[0]
        unread_up, unread_down = (from_top >= depth).astype(np.float64), (from_top < n - depth).astype(np.float64)
        own = ids[:, None] == query_ids[active][None, :]
        upper = partial + unread_up @ (up[active] * last_up).T + unread_down @ (down[active] * last_down).T
        upper[own] = -np.inf
        if depth < n:
            lower = partial + unread_up @ (up[active] * worst_up).T + unread_down @ (down[active] * worst_down).T
            lower[own] = -np.inf
        else:
            lower = upper
        kth = np.partition(lower, -k, axis=0)[-k] if n > k else np.full(len(active), -np.inf)
        open_ = upper >= kth
        done = (open_.sum(axis=0) <= 4 * k) | (depth >= n)
        for column in np.flatnonzero(done):
            left = np.flatnonzero(open_[:, column] & ~own[:, column])
            q = active[column]
            found.append((np.full(len(left), q), x[left] @ queries[q], ids[left]))
        active, partial = active[~done], np.ascontiguousarray(partial[:, ~done])
        if not len(active):
            break
    return [np.concatenate(column) for column in zip(*found)]


def exact_top_k(vectors: DataFrame, is_query, k: int, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for each row where ``is_query`` holds.

    Components are floor(scale * x); the score is their integer inner product, ties go to the smaller id. Rows whose id or
    vector is null or whose vector holds a null or non-finite component take no part, as do empty vectors. Only vectors of
    one length are compared. An id that repeats is one candidate per row; no row is matched with a query of its own id. An
    empty table gives no rows. Every block of queries meets every block of candidates, which is the stated search; blocks
    are bounded, so copies and hot sources change nothing.
    """
    rows = usable(vectors, vec_id, embedding).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("v"), F.size("v").cast("long").alias("dims")
    )
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    dealt = lambda n, block: F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // block))))
    candidates = blocks_of(rows, ["dims"], dealt(sizes["n"], BLOCK))
    queries = blocks_of(rows.filter(is_query), ["dims"], dealt(sizes["q"], QUERIES))
    pairs = met(candidates, queries, ["dims"]).drop("dims")

    def batches(parts):
        for part in parts:
            for row in zip(*[part.column(i) for i in range(4)]):
                query_ids, q = unpacked(row[0].as_py(), row[1].as_py())
                ids, x = unpacked(row[2].as_py(), row[3].as_py())
                yield top_rows(query_ids, *search(q, query_ids, x, ids, k), k)

    return best_of(pairs.mapInArrow(batches, TOP), k, "long")


def op9_exact_topk(spark, sf_dir):
    """The five best of all vectors for every fiftieth one, by integer inner product."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
