"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import ann, exact_topk

SCHEMA = "vec_id bigint, embedding array<float>, rank string, score string"
BAD = [(None, [1.0, 2.0]), (9001, None), (9002, []), (9003, [1.0, None]), (9004, [float("nan"), 1.0]), (9005, [float("inf"), 1.0])]


def table(spark, vectors, bad=True):
    rows = [(i, [float(x) for x in v], "r", "s") for i, v in vectors] + [(i, v, "r", "s") for i, v in (BAD if bad else [])]
    return spark.createDataFrame(rows, SCHEMA)


def best(vectors, query, k, score):
    found = sorted((-score(query[1], v), i) for i, v in vectors if i != query[0] and len(v) == len(query[1]))[:k]
    return [(i, -s) for s, i in found]


@pytest.mark.parametrize("block, queries", [(4096, 512), (7, 3)])
def test_exact(spark, monkeypatch, block, queries):
    monkeypatch.setattr(exact_topk, "BLOCK", block)
    monkeypatch.setattr(exact_topk, "QUERIES", queries)
    rng = np.random.default_rng(4)
    vectors = [(i, v) for i, v in enumerate(np.round(rng.normal(size=(150, 6)), 1).astype(np.float32))]
    vectors += [(200 + i, vectors[3][1]) for i in range(12)] + [(300, np.float32([1, 2, 3])), (310, np.float32([1, 0, 0]))]  # ties, another length
    got = exact_topk.exact_top_k(table(spark, vectors), F.col("vec_id") % 10 == 0, 5).collect()
    floor = lambda v: np.floor(256 * v.astype(np.float64))
    whole = [(i, floor(v)) for i, v in vectors]
    want = {}
    for q in whole:
        if q[0] % 10 == 0:
            want[q[0]] = best(whole, q, 5, lambda a, b: int(a @ b))
    have = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        have.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert have == want


def test_exact_of_few_and_none(spark):
    assert exact_topk.exact_top_k(table(spark, []), F.col("vec_id") % 10 == 0, 5).count() == 0
    assert exact_topk.exact_top_k(table(spark, [(10, [1.0])]), F.col("vec_id") % 10 == 0, 5).count() == 0
    rows = exact_topk.exact_top_k(table(spark, [(10, [1.0]), (11, [0.5]), (11, [0.5])]), F.col("vec_id") % 10 == 0, 5).collect()
    assert [(r.vec_id, r.score) for r in rows] == [(11, 256 * 128)] * 2


def test_approximate(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, v) for i, v in enumerate(rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, size=(1500, 1)))]
    vectors = [(i, v.astype(np.float32)) for i, v in vectors] + [(5000, np.zeros(24, np.float32))]
    got = ann.approximate_top_k(table(spark, vectors), F.col("vec_id") % 20 == 0, 10).collect()
    exact = [(i, v.astype(np.float64)) for i, v in vectors if v.any()]
    by_id, hits = dict(exact), 0
    have = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        assert r.score == pytest.approx(by_id[r.query_id] @ by_id[r.vec_id], abs=1e-12)
        have.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    queries = [q for q in exact if q[0] % 20 == 0]
    for q in queries:
        assert have[q[0]] == sorted(have[q[0]]) and len(have[q[0]]) == 10
        hits += len({i for _, i in have[q[0]]} & {i for i, _ in best(exact, q, 10, lambda a, b: a @ b)})
    assert hits >= 0.9 * 10 * len(queries)


def test_approximate_of_few_and_none(spark):
    ask = F.col("vec_id") % 20 == 0
    assert ann.approximate_top_k(table(spark, []), ask, 3).count() == 0
    rows = ann.approximate_top_k(table(spark, [(20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0])]), ask, 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(1, 2.0), (2, 2.0)]


def test_vectors_of_every_length_are_searched(spark):
    r = np.random.default_rng(4)
    made = [(i, r.standard_normal(n).tolist()) for i, n in enumerate([8] * 60 + [5] * 31 + [2] * 3 + [3])]
    got = ann.approximate_top_k(spark.createDataFrame(made, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0, 3, probed=1.0).collect()
    of = dict(made)
    alike = {i: [j for j in of if j != i and len(of[j]) == len(of[i])] for i in of if i % 2 == 0}
    assert {(i, min(3, len(js))) for i, js in alike.items() if js} == {(i, sum(x.query_id == i for x in got)) for i in {x.query_id for x in got}}
    best = {(i, j) for i, js in alike.items() for j in sorted(js, key=lambda j: -np.dot(of[i], of[j]))[:3]}
    assert len(best & {(x.query_id, x.vec_id) for x in got}) >= 0.95 * len(best)
    assert all(abs(x.score - np.dot(of[x.query_id], of[x.vec_id])) < 1e-9 for x in got)
