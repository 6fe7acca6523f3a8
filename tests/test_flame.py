import random

import pytest
from pyspark.sql import functions as F

from emberframe.operators import flame

SAMPLES = "snapshot_id string, stack array<string>, weight bigint"
FRAMES = "snapshot_id string, root_name string, path array<string>, name string, value bigint"


def build(spark, samples, **options):
    rows = [("s", stack, weight) for stack, weight in samples]
    return flame.flame_build(spark.createDataFrame(rows, SAMPLES), **options)


def tree(spark, nodes, snapshot="s"):
    rows = [(snapshot, "root", p.split("/") if p else [], p.split("/")[-1] if p else "root", v) for p, v in nodes.items()]
    return spark.createDataFrame(rows, FRAMES)


def values(df, column="value"):
    return {"/".join(r["path"]): r[column] for r in df.collect()}


def random_samples(seed, n=60):
    r = random.Random(seed)
    return [([r.choice("abc") for _ in range(r.randint(0, 4))], r.randint(-3, 3)) for _ in range(n)]


def model_build(samples):
    out = {"": 0}
    for stack, weight in samples:
        for i in range(1, len(stack) + 1) if weight else ():
            key = "/".join(stack[:i])
            out[key] = out.get(key, 0) + weight
    return out


def model_diff(head, base):
    delta = {p: head.get(p, 0) - base.get(p, 0) for p in set(head) | set(base)}
    leads = lambda p: any(d and (not p or q == p or q.startswith(p + "/")) for q, d in delta.items())
    return {p: d for p, d in delta.items() if leads(p)}


def test_build_gives_every_node_on_the_path_the_weight(spark):
    rows = build(
        spark,
        [(["main", "doWork", "heavyFunction"], 100), (["main", "doWork", "lightFunction"], 50)],
        root_name="test-root",
    )
    assert values(rows) == {
        "": 0, "main": 150, "main/doWork": 150, "main/doWork/heavyFunction": 100, "main/doWork/lightFunction": 50
    }
    assert {r["name"] for r in rows.filter(F.size("path") == 0).collect()} == {"test-root"}


@pytest.mark.parametrize("sample", [([], 100), (["main"], 0)])
def test_rejected_sample_leaves_the_root_alone(spark, sample):
    assert values(build(spark, [sample])) == {"": 0}
    assert flame.sample_admission(spark.createDataFrame([("s", *sample)], SAMPLES)).count() == 0


def test_negative_weight(spark):
    assert values(build(spark, [(["main"], 100), (["main"], -30)]))["main"] == 70


def test_weights_that_cancel_leave_a_node_of_zero(spark):
    assert values(build(spark, [(["a"], 5), (["a"], -5)])) == {"": 0, "a": 0}


def test_many_writers(spark):
    assert values(build(spark, [(["main", "worker"], 1)] * 1000))["main/worker"] == 1000


@pytest.mark.parametrize("seed", range(3))
def test_build_and_merge_agree_with_a_model(spark, seed):
    a, b = random_samples(seed), random_samples(seed + 100)
    built_a, built_b, both = build(spark, a), build(spark, b), build(spark, a + b)
    assert values(built_a) == model_build(a)
    assert values(flame.flame_merge([built_a, built_b])) == values(both) == model_build(a + b)


def test_merge_keeps_the_first_name(spark):
    a = tree(spark, {"": 0, "x": 1}).withColumn("name", F.concat(F.lit("a-"), "name"))
    b = tree(spark, {"": 2, "x": 5, "y": 1})
    assert values(flame.flame_merge([a, b]), "name") == {"": "a-root", "x": "a-x", "y": "y"}
    assert values(flame.flame_merge([b, a]), "value") == {"": 2, "x": 6, "y": 1}


def test_flatten_values(spark):
    flat = flame.flame_flatten(tree(spark, {"": 0, "a": 3, "a/b": 2}))
    assert values(flat, "cumulative") == {"": 5, "a": 5, "a/b": 2}
    assert values(flat, "self") == {"": 0, "a": 3, "a/b": 2}
    assert values(flat, "self_exclusive") == {"": -3, "a": 1, "a/b": 2}
    assert values(flat, "depth") == {"": 0, "a": 1, "a/b": 2}


def test_flatten_order_and_top(spark):
    flat = flame.flame_flatten(tree(spark, {"": 0, "m": 5, "m/a": 3, "m/b": 2, "z": 1, "mé": 4}))
    ordered = ["/".join(r["path"]) for r in flat.orderBy(flame.flatten_order()).collect()]
    assert ordered == ["", "z", "mé", "m", "m/b", "m/a"]
    assert ["/".join(r["path"]) for r in flame.top_k(flat, 3).collect()] == ["", "z", "mé"]
    assert ["/".join(r["path"]) for r in flame.top_k(flat, 3, "hottest").collect()] == ["", "m", "mé"]
    with pytest.raises(ValueError):
        flame.top_k(flat, 3, "coldest")


@pytest.mark.parametrize("seed", range(2))
def test_exclusive_values_add_up_and_summary(spark, seed):
    frames = build(spark, random_samples(seed))
    flat = flame.flame_flatten(frames).cache()
    exclusive, inclusive = values(flat, "self_exclusive"), values(frames)
    for top in inclusive:
        if top:
            assert sum(v for p, v in exclusive.items() if p == top or p.startswith(top + "/")) == inclusive[top]
    summary = flame.replay_summary(flat).first()
    assert summary["nodes"] == len(inclusive) and summary["total_self"] == sum(inclusive.values())
    assert summary["total_cumulative"] == sum(inclusive.values())


def test_diff_keeps_what_leads_to_a_change(spark):
    base = tree(spark, {"": 0, "m": 5, "m/a": 3, "m/b": 2, "z": 1})
    head = tree(spark, {"": 0, "m": 5, "m/a": 1, "m/c": 4, "z": 1})
    assert values(flame.flame_diff(head, base), "delta") == {"": 0, "m": 0, "m/a": -2, "m/b": -2, "m/c": 4}


@pytest.mark.parametrize("seed", range(3))
def test_diff_agrees_with_a_model(spark, seed):
    a, b = random_samples(seed), random_samples(seed + 50)
    head, base = build(spark, a), build(spark, b)
    assert values(flame.flame_diff(head, base), "delta") == model_diff(model_build(a), model_build(b))
    assert flame.flame_diff(head, head).count() == 0


def test_diff_takes_the_name_of_the_head(spark):
    base = tree(spark, {"": 0, "x": 1, "gone": 1}).withColumn("name", F.concat(F.lit("z-"), "name"))
    head = tree(spark, {"": 0, "x": 2}).withColumn("name", F.concat(F.lit("h-"), "name"))
    assert values(flame.flame_diff(head, base), "name") == {"": "h-root", "x": "h-x", "gone": "z-gone"}


def test_search_keeps_matches_and_their_ancestors(spark):
    frames = tree(spark, {"": 0, "m": 2, "m/a": 1, "m/b": 1, "z": 1})
    found = flame.flame_search(frames, "A")
    assert values(found, "matched") == {"": False, "m": False, "m/a": True}
    assert flame.flame_search(frames, "").count() == 5
    # what lies below a match stays only if it matches itself or leads to a match
    assert set(values(flame.flame_search(frames, "M"))) == {"", "m"}
    assert flame.flame_search(frames, "nowhere").count() == 0


def test_closure_has_every_prefix(spark):
    closed = flame.ancestor_closure(tree(spark, {"a/b/c": 1, "a/x": 1}))
    assert {"/".join(r["path"]) for r in closed.collect()} == {"", "a", "a/b", "a/b/c", "a/x"}


def deep(spark, levels, chains):
    """``chains`` stacks of ``levels`` frames that part at half their depth, value 1 each."""
    names = F.transform(F.sequence(F.lit(1), F.col("d")), lambda i: F.when(i <= levels // 2, F.concat(F.lit("f"), i)).otherwise(F.concat(F.lit("g"), i, F.lit("-"), F.col("c"))))
    nodes = spark.range(chains).withColumnRenamed("id", "c").select("c", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("d"))
    nodes = nodes.filter((F.col("c") == 0) | (F.col("d") > levels // 2)).select(F.lit("s").alias("snapshot_id"), F.lit("root").alias("root_name"), names.alias("path"))
    nodes = nodes.select("*", F.element_at("path", -1).alias("name"), F.lit(1).cast("long").alias("value"))
    return nodes.unionByName(tree(spark, {"": 0}))


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_two_hundred_levels_over_many_ranges(spark, many_ranges):
    levels, chains = 200, 40
    flat = flame.flame_flatten(deep(spark, levels, chains))
    assert "Generate" not in flat._jdf.queryExecution().toString()
    got = values(flat, "cumulative")
    half = levels // 2
    assert len(got) == 1 + half + chains * (levels - half)
    trunk = lambda d: "/".join(f"f{i}" for i in range(1, d + 1))
    assert got[""] == half + chains * (levels - half)
    for d in (1, 50, half):
        assert got[trunk(d)] == half - d + 1 + chains * (levels - half)
    assert sum(v for p, v in got.items() if p.endswith(f"g{half + 1}-7")) == levels - half
    assert got[trunk(half)] - 1 == sum(v for p, v in got.items() if p.count("/") == half)


def brute(frames, keys):
    rows = [(tuple(r[k] for k in keys), tuple(r["path"]), r["value"]) for r in frames.collect()]
    out = {}
    for k in {k for k, _, _ in rows}:
        mine = [(p, v) for kk, p, v in rows if kk == k]
        for q in {p[:d] for p, _ in mine for d in range(len(p) + 1)}:
            own = [v for p, v in mine if p == q]
            kids = sum(v for p, v in mine if len(p) == len(q) + 1 and p[: len(q)] == q)
            below = sum(v for p, v in mine if p[: len(q)] == q)
            out[(*k, q)] = (sum(own) if own else None, below, sum(own) - kids if own else None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_flatten_of_odd_trees_over_many_ranges(spark, many_ranges, seed):
    # nodes without parents, rows of one path twice, several snapshots, a null one, no roots
    r = random.Random(seed)
    rows = [(r.choice(["s", "t", None]), "x", [r.choice("abé") for _ in range(r.randint(0, 5))], "n", r.randint(-3, 9)) for _ in range(250)]
    frames = spark.createDataFrame(rows, FRAMES).repartition(5)
    flat = flame.flame_flatten(frames).collect()
    got = {(x["snapshot_id"], tuple(x["path"])): (x["self"], x["cumulative"], x["self_exclusive"]) for x in flat}
    assert got == brute(frames, ["snapshot_id"]) and len(got) == len(flat)
    closed = flame.ancestor_closure(frames).collect()
    assert {(x["snapshot_id"], tuple(x["path"])) for x in closed} == set(got) and len(closed) == len(got)
    whole = flame.flame_flatten(frames, keys=[]).collect()
    assert {(tuple(x["path"]),): (x["self"], x["cumulative"], x["self_exclusive"]) for x in whole} == brute(frames, [])


def test_one_row_per_path_whatever_its_names(spark):
    frames = spark.createDataFrame([("s", "r1", ["k"], "n1", 5), ("t", "r2", ["k"], "n2", 7), ("s", "r1", [], "r1", 0), ("t", "r2", [], "r2", 0)], FRAMES)
    assert [(r["path"], r["name"], r["value"], r["root_name"]) for r in flame.flame_merge([frames]).orderBy("path").collect()] == [([], "r1", 0, "r1"), (["k"], "n1", 12, "r1")]
    assert [(r["path"], r["name"], r["self"]) for r in flame.flame_flatten(frames, keys=[]).orderBy("path").collect()] == [([], "r1", 0), (["k"], "n1", 12)]


def test_null_snapshots_are_searched_and_merged(spark):
    frames = tree(spark, {"": 0, "m": 2, "m/a": 1}, None).unionByName(tree(spark, {"": 0, "a": 1}))
    found = flame.flame_search(frames, "a")
    assert sorted((r["snapshot_id"] or "", "/".join(r["path"]), r["matched"]) for r in found.collect()) == [
        ("", "", False), ("", "m", False), ("", "m/a", True), ("s", "", False), ("s", "a", True),
    ]
    merged = flame.flame_merge([frames, frames], keys=["snapshot_id"])
    assert sorted((r["snapshot_id"] or "", "/".join(r["path"]), r["value"], r["root_name"]) for r in merged.collect()) == [
        ("", "", 0, "root"), ("", "m", 4, "root"), ("", "m/a", 2, "root"), ("s", "", 0, "root"), ("s", "a", 2, "root"),
    ]
