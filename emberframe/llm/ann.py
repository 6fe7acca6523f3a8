"""Approximate nearest neighbours by inner product: adaptive dimension scan in the probed lists of an inverted file.

Vectors get one more component, the root of (largest squared norm - own squared norm), queries a zero there: the largest
inner product is then the smallest distance. A random rotation spreads each difference evenly over the components. A scan
adds up squared differences one block of components at a time; after each, a candidate is given up when the distance that
the part suggests is larger than the k-th best by more than chance allows.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import stored, table
from emberframe.llm.vectors import TOP, best_of, blocks_of, matrix, met, top_rows, unpacked, usable

#: Vectors that the lists are fitted on, at most: those whose ids hash lowest. All vectors are indexed.
SAMPLE = 32_768
#: Lists per root of the number of vectors, at most SAMPLE / 8; share of the lists that a query probes.
LISTS, PROBED = 0.5, 0.7
#: Share of the lists that is scanned first; the k-th best found there bounds the scan of the others.
FIRST = 0.05
ROUNDS, SEED = 8, 20
#: Components added between two tests, and how much chance a test allows (larger: safer and slower).
COLUMNS, ALLOWED = 32, 1.2
BLOCK, QUERIES = 4096, 512
#: Pairs looked at together.
PAIRS = 1 << 17


def raised(v: np.ndarray, top: float) -> np.ndarray:
    """Candidates with the component that makes all norms equal."""
    rest = np.sqrt(np.maximum(0.0, top - np.einsum("ij,ij->i", v, v)))
    return np.hstack([v, rest[:, None]])


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centres by k-means. ``sample`` holds at most SAMPLE rows."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = nearest(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        held = np.bincount(own, minlength=len(centres))
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def nearest(v: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest centres of each row, nearest first."""
    far = np.einsum("ij,ij->i", centres, centres) - 2 * v @ centres.T
    some = np.argpartition(far, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)


def scan(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, top: float, turn: np.ndarray):
    """What the scan leaves of all pairs of a query and a candidate with another id: number of the query, inner product, id.
    Holds the best ``k`` of each query, but for the chance that the tests allow. The last column of ``queries`` is the
    squared distance beyond which nothing is of use."""
    dims = len(turn)
    queries, known = queries[:, :-1], queries[:, -1]
    rx = raised(x, top) @ turn
    rq = np.hstack([queries, np.zeros((len(queries), 1))]) @ turn
    ends = [*range(COLUMNS, dims, COLUMNS), dims]
    found = []
    for at in range(0, len(rq), max(1, PAIRS // len(rx))):
        part_of = slice(at, at + max(1, PAIRS // len(rx)))
        q, h = rq[part_of], ends[0]
        part = np.square(rx[:, :h]).sum(axis=1)[:, None] + np.square(q[:, :h]).sum(axis=1) - 2 * rx[:, :h] @ q[:, :h].T
        part[ids[:, None] == query_ids[part_of][None, :]] = np.inf
        limit = np.full(len(q), np.inf)
        if len(rx) > k:
            first = np.argpartition(part, k - 1, axis=0)[:k]
            far = np.square(rx[first] - q[None, :, :]).sum(axis=2)
            limit = np.where(np.take_along_axis(part, first, axis=0) < np.inf, far, np.inf).max(axis=0)
        limit = np.minimum(limit, known[part_of])
        c, j = np.nonzero(part <= np.minimum(limit * _allowed(h, dims), np.finfo(float).max)[None, :])
        p = part[c, j]
        for begin, end in zip(ends, ends[1:]):
            p = p + np.square(rx[c, begin:end] - q[j, begin:end]).sum(axis=1)
            stay = p <= limit[j] * _allowed(end, dims)
            c, j, p = c[stay], j[stay], p[stay]
        found.append((j + at, np.einsum("ij,ij->i", x[c], queries[part_of][j]), ids[c]))
    return [np.concatenate(column) for column in zip(*found)]


def _allowed(at: int, dims: int) -> float:
    """How large a share of the k-th best squared distance the first ``at`` components may have."""
    return at / dims * (1 + ALLOWED / np.sqrt(at)) ** 2 if at < dims else 1 + 1e-9


def approximate_top_k(vectors: DataFrame, is_query, k: int, vec_id: str = "vec_id", embedding: str = "embedding", probed: float = PROBED) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the ``k`` best of all other rows for each row where ``is_query`` holds.

    The score is the inner product of the vectors as given, in doubles; ties go to the smaller id. Rows whose id or vector
    is null, whose vector is empty or zero or holds a null or non-finite component take no part. Vectors of each length are
    a table of their own, with its own index, and are compared with each other only. An id that repeats is one candidate
    per row. An empty table gives no rows. Lists are dealt out in bounded blocks, however large one becomes.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding).filter(F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    lengths = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max("norm").alias("top")).orderBy(F.desc("n"), "dims").collect()
    found = [_of_one_length(rows.filter(F.size("v") == dims), dims, n, top, is_query, k, probed) for dims, n, top in lengths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_one_length(rows: DataFrame, dims: int, n: int, top: float, is_query, k: int, probed: float) -> DataFrame:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    sample = raised(matrix(sample["v"]), top)
    centres = fitted(sample, min(SAMPLE // 8, int(np.ceil(LISTS * np.sqrt(n)))))
    turn = rotation(dims + 1)
    probes = max(1, int(np.ceil(probed * len(centres))))
    first = max(1, int(np.ceil(FIRST * len(centres))))

    def listed(as_query: bool):
        def batches(parts):
            for part in parts:
                ids, v = part.column(0), matrix(part.column(1))
                if not len(v):
                    continue
                own = np.hstack([v, np.zeros((len(v), 1))]) if as_query else raised(v, top)
                lists = nearest(own, centres, probes if as_query else 1)
                yield pa.RecordBatch.from_arrays([ids, part.column(1), pa.array(lists.tolist(), pa.list_(pa.int64()))], ["vec_id", "v", "lists"])

        return batches

    def in_lists(part: DataFrame, as_query: bool) -> DataFrame:
        part = part.select("vec_id", "v").mapInArrow(listed(as_query), "vec_id long, v array<double>, lists array<long>")
        return part.select("vec_id", "v", F.posexplode("lists").alias("probe", "list"))

    def blocks(part: DataFrame, most: int) -> DataFrame:
        held = part.groupBy("list").agg(F.ceil(F.count("*") / most).alias("blocks"))
        return blocks_of(part.join(held, "list"), ["list"], F.pmod(F.xxhash64("vec_id"), F.col("blocks")))

    def batches(parts):
        for part in parts:
            for row in zip(*[part.column(i) for i in range(4)]):
                query_ids, q = unpacked(row[0].as_py(), row[1].as_py())
                ids, x = unpacked(row[2].as_py(), row[3].as_py())
                yield top_rows(query_ids, *scan(q, query_ids, x, ids, k, top, turn), k)

    def scanned(part: DataFrame, limit) -> DataFrame:
        part = part.select("vec_id", "list", F.concat("v", F.array(limit)).alias("v"))
        return met(candidates, blocks(part, QUERIES), ["list"]).drop("list").mapInArrow(batches, TOP)

    candidates = stored(blocks(stored(in_lists(rows, False), "ann-lists"), BLOCK), "ann-blocks")
    asked = stored(in_lists(rows.filter(is_query), True), "ann-queries")
    near = stored(scanned(asked.filter(F.col("probe") < first), F.lit(float("inf"))), "ann-near")
    bound = best_of(near, k, "double").filter(F.col("rank") == k).groupBy("query_id").agg(F.min("score").alias("kth"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    far = asked.filter(F.col("probe") >= first).join(bound, F.col("vec_id") == F.col("query_id"), "left")
    rest = scanned(far, F.coalesce(F.lit(float(top)) + norm - 2 * F.col("kth") + 1e-9, F.lit(float("inf"))))
    return best_of(near.unionByName(rest), k, "double")


def op2_ann(spark, sf_dir):
    """About the twenty nearest of all vectors for every twentieth one."""
    return approximate_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
