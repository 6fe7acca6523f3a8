import random

import pytest
from pyspark.sql import functions as F

from emberframe.operators.ordered import in_ranges, ordered_columns, with_position


def rows(seed, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if r.random() < 0.5 else f"k{r.randint(0, 9)}"
        # a burst: many rows share one moment
        at = 500 if r.random() < 0.4 else r.randint(0, 1_000_000)
        out.append((key, at, i, r.choice([None, r.randint(-5, 5)])))
    return out


def model(data):
    out, state = set(), {}
    for key, at, i, v in sorted(data, key=lambda x: (x[0], x[1], x[2])):
        before, total, known = state.get(key, (None, 0, None))
        total += v or 0
        known = v if v is not None else known
        out.add((key, at, i, before, total, known))
        state[key] = (v, total, known)
    return out


@pytest.mark.parametrize("max_rows", [10_000, 40, 7])
def test_hot_keys_and_bursts_give_the_same_rows(spark, max_rows):
    data = rows(max_rows)
    df = spark.createDataFrame(data, "k string, at bigint, i bigint, v bigint")
    got = ordered_columns(
        df, ["k"], ["at", "i"],
        previous={"before": F.col("v")},
        running={"total": F.coalesce("v", F.lit(0).cast("long"))},
        last_known={"known": F.col("v")},
        max_rows=max_rows,
    )
    assert {(r.k, r.at, r.i, r.before, r.total, r.known) for r in got.collect()} == model(data)
    assert got.count() == len(data)


def test_ranges_are_bounded_and_hot_moments_are_cut(spark):
    data = [("k", 7, i, i) for i in range(400)] + [("l", i, i, i) for i in range(30)]
    df = spark.createDataFrame(data, "k string, at bigint, i bigint, v bigint")
    sizes = in_ranges(df, ["k", "at", "i"], 40).groupBy("_part").count()
    assert sizes.agg(F.max("count")).first()[0] <= 60
    got = ordered_columns(df, ["k"], ["at", "i"], previous={"before": F.col("v")}, running={"total": F.col("v")}, max_rows=40)
    assert {(r.k, r.i): (r.before, r.total) for r in got.collect()} == {
        (k, i): (i - 1 if i else None, i * (i + 1) // 2) for k, _, i, _ in data
    }


def test_equal_places_give_the_same_in_both_plans(spark):
    data = [("k", i // 10, i % 7, (i * 37) % 11) for i in range(300)]
    df = spark.createDataFrame(data, "k string, at bigint, i bigint, v bigint")
    plans = [ordered_columns(df, ["k"], ["at"], previous={"before": F.col("v")}, running={"total": F.col("v")}, max_rows=n) for n in (10_000, 25)]
    assert sorted(map(tuple, plans[0].collect()), key=repr) == sorted(map(tuple, plans[1].collect()), key=repr)


def test_position(spark):
    data = rows(5)
    df = spark.createDataFrame(data, "k string, at bigint, i bigint, v bigint").repartition(5)
    got = with_position(df, ["at", "i"])
    order = sorted(data, key=lambda x: (x[1], x[2]))
    assert {r.i: r.position for r in got.collect()} == {x[2]: n + 1 for n, x in enumerate(order)}
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert with_position(df.limit(0), ["at", "i"]).count() == 0
