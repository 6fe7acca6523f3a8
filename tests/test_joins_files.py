import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from emberframe.operators import flame, json_nodes, spans, symbols, tree_json
from emberframe.sources import files, plugins

FRAMES = "snapshot_id string, root_name string, path array<string>, name string, value bigint"


@pytest.mark.parametrize("max_rows", [10_000, 15])
def test_trace_attach(spark, max_rows):
    r = random.Random(max_rows)
    trace = "0af7651916cd43dd8448eb211c80319c"
    gid = lambda: 1 if r.random() < 0.5 else r.randint(2, 5)
    anns = [(gid(), r.randint(0, 500) * 1_000_000, i, f"trace_id={trace},{i:016x}" if i % 5 else "trace_id=bad") for i in range(80)]
    frames = [(i, r.randint(0, 500) * 1_000_000, gid()) for i in range(80)] + [(900, 10**9, None)]
    f = spark.createDataFrame(
        [(i, us, "s", "root", [f"goroutine-{g}" if g else "main"], f"goroutine-{g}" if g else "main", 1) for i, us, g in frames],
        "frame_id bigint, us bigint, " + FRAMES,
    )
    a = spark.createDataFrame(anns, "gid bigint, us bigint, event_id bigint, ann string")
    got = {}
    for row in spans.trace_attach(f, a, max_rows=max_rows).collect():
        if row.path[-1] == "_trace":
            assert row.value == 0 and len(row.path) == 2
            got[row.frame_id] = row.name
    want = {}
    for i, us, g in frames:
        seen = [(at, e) for ag, at, e, ann in anns if ag == g and at <= us and us - at <= 120_000_000 and "bad" not in ann]
        if seen:
            want[i] = f"{trace}:{max(seen)[1]:016x}"
    assert got == want and len(want) > 20


@pytest.mark.parametrize("max_rows", [1000, 3])
def test_symbolise(spark, max_rows):
    table = spark.createDataFrame(
        [(100, 110, "x/a.A"), (110, 400, "x/b.B"), (500, 501, "c.C"), (600, 610, "runtime.goexit")], "start_pc bigint, end_pc bigint, func string"
    )
    samples = spark.createDataFrame(
        [("s1", [111, 110, 501, 601]), ("s2", [0, 450, 400, 401, 111]), ("s3", [601]), ("s4", [100])], "sample_id string, pcs array<bigint>"
    )
    got = {r.sample_id: r.stack for r in symbols.symbolise(samples, table, max_rows).collect()}
    assert got == {"s1": ["c.C", "a.A", "b.B"], "s2": ["b.B", "b.B"]}


def test_symbolise_far_and_nested_functions(spark):
    table = [(i * 10, i * 10 + 10, f"m.F{i}") for i in range(1, 40)] + [(2**62, 2**62 + 5, "far.F"), (1000, 1100, "outer.A"), (1020, 1030, "inner.B")]
    table = spark.createDataFrame(table, "start_pc bigint, end_pc bigint, func string")
    samples = spark.createDataFrame([("s", [16, 2**62 + 1, 1026, 1006, 1051])], "sample_id string, pcs array<bigint>")
    # the last start decides: after the inner function's end nothing is known
    assert symbols.symbolise(samples, table).first().stack == ["outer.A", "inner.B", "far.F", "m.F1"]


def test_trace_attach_replaces_an_old_child(spark):
    frames = [(1, 10, "s", "root", ["goroutine-7"], "goroutine-7", 1), (2, 10, "s", "root", ["goroutine-7", "_trace"], "old", 0), (3, 10, "s", "root", ["goroutine-8", "_trace"], "kept", 0)]
    f = spark.createDataFrame(frames, "frame_id bigint, us bigint, " + FRAMES)
    a = spark.createDataFrame([(7, 5, 1, "trace_id=0af7651916cd43dd8448eb211c80319c")], "gid bigint, us bigint, event_id bigint, ann string")
    got = {(tuple(r.path), r.name) for r in spans.trace_attach(f, a).collect()}
    assert got == {(("goroutine-7",), "goroutine-7"), (("goroutine-7", "_trace"), "0af7651916cd43dd8448eb211c80319c:0000000000000000"), (("goroutine-8", "_trace"), "kept")}


def test_agents(spark):
    facts = spark.createDataFrame([(1, "x"), (2, "y")], "agent_id bigint, v string")
    agents = spark.createDataFrame([(1, "h")], "id bigint, hostname string")
    assert {(r.v, r.hostname) for r in spans.agent_enrich(facts, agents, "agent_id").collect()} == {("x", "h"), ("y", None)}


def frames_of(spark):
    rows = [
        ("s", "root", [], "root", 0), ("s", "root", ["a"], "a<\"é\n", 3), ("s", "root", ["a", "x"], "x", 2),
        ("s", "root", ["a", "x", "_trace"], "12:34", 0), ("s", "root", ["a-b"], "a-b", 1), ("s", "root", ["b"], "b", -1),
        ("t", "empty", [], "empty", 0),
    ]
    return spark.createDataFrame(rows, FRAMES)


def test_tree_text(spark):
    texts = {r.snapshot_id: r.payload for r in tree_json.tree_to_json(frames_of(spark)).collect()}
    assert texts["t"] == '{"name":"empty","value":0}'
    s = json.loads(texts["s"])
    assert list(s["children"]) == ["a", "a-b", "b"] and s["children"]["a"]["name"] == 'a<"é\n'
    assert "\\u003c" in texts["s"] and "children" not in s["children"]["b"]


def test_round_trip(spark):
    frames = frames_of(spark)
    back = tree_json.tree_explode(tree_json.tree_to_json(frames))
    assert back.exceptAll(frames).count() == frames.exceptAll(back).count() == 0


def test_test_tree_json(spark):
    built = flame.flame_build(spark.createDataFrame([("s", ["main", "work"], 42)], "snapshot_id string, stack array<string>, weight bigint"))
    text = tree_json.tree_to_json(built).first().payload
    assert all(part in text for part in ('"name":"root"', '"name":"main"', '"name":"work"', '"value":42'))


def chain(levels):
    path = [f"f{i}" for i in range(levels)]
    return [("s", "root", path[:i], path[i - 1] if i else "root", 1) for i in range(levels + 1)]


def test_deep_tree(spark):
    frames = spark.createDataFrame(chain(300), FRAMES)
    assert tree_json.tree_explode(tree_json.tree_to_json(frames)).count() == 301


def nested(levels, last='{"name":"end","value":1}'):
    return "".join('{"name":"n%d","value":%d,"children":{"k%d":' % (i, i, i) for i in range(levels)) + last + "}}" * levels


def test_twenty_thousand_levels():
    depth = seen = 0
    for _, (_, root_name, path, name, value) in zip(range(200), tree_json._nodes("s", nested(20_000))):
        # the deepest node ends first
        assert root_name == "n0" and path[0] == "k0" and len(path) == 20_000 - seen
        assert (name, value) == (("end", 1) if seen == 0 else (f"n{len(path)}", len(path)))
        seen += 1
    deep = spark_free_depths(nested(6_000))
    assert deep == list(range(6_000, -1, -1))


def spark_free_depths(text):
    return [len(path) for _, _, path, _, _ in tree_json._nodes("s", text)]


def test_deep_documents_are_exploded(spark):
    docs = spark.createDataFrame([("a", nested(3_000)), ("b", nested(2))], "snapshot_id string, payload string")
    got = tree_json.tree_explode(docs).selectExpr("snapshot_id", "size(path) AS d", "root_name", "name")
    assert got.groupBy("snapshot_id").count().orderBy("snapshot_id").collect() == [("a", 3001), ("b", 3)]
    assert got.filter("d = 2999").first().name == "n2999"


DOCUMENTS = [
    '{"name":"r","value":1}',
    ' {"value" : -3 , "children" : { "a" : {"name":"\\u00e9\\n\\"{", "value":2, "more":[{"children":{"x":{}}}, "}"]}, "b":null }, "name":"late", "other":{"name":"no"}}',
    '{"children":null,"name":null,"value":null}',
    '{"children":{"":{"children":{}}},"unknown":true}',
    '{"name":"a","value":1e2}',
]


@pytest.mark.parametrize("text", DOCUMENTS)
def test_both_decoders_agree(text):
    plain = sorted((tuple(p), r, n, v) for _, r, p, n, v in tree_json.tree_rows("s", json.loads(text)))
    assert sorted((tuple(p), r, n, v) for r, p, n, v in json_nodes.tree_nodes(text)) == plain


@pytest.mark.parametrize("text", ["", "3", "[1]", '{"name":"a"', '{"children":{"a":{}}', '{"children":{"a":3}}', "{}}"])
def test_broken_documents_fail(text):
    with pytest.raises(ValueError):
        list(json_nodes.tree_nodes(text))


def odd_forest():
    r = random.Random(4)
    nodes = {(s, p) for s in "stu" for p in [()]}
    for s in "stu":
        for _ in range(120):
            path = tuple(r.choice(["a", "b\n", '"', "é<", "{}", "a-b"]) for _ in range(r.randint(1, 6)))
            nodes |= {(s, path[:d]) for d in range(len(path) + 1)}
    rows = [(s, f"root {s}", list(p), p[-1] + "!" if p else f"root {s}", r.randint(-5, 99)) for s, p in sorted(nodes)]
    return rows + [("single", "x", [], "x", 0)]


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("compress", [True, False])
def test_snapshots_in_several_parts(spark, tmp_path, many_ranges, compress):
    frames = spark.createDataFrame(odd_forest() + chain(150), FRAMES).filter("NOT (snapshot_id = 's' AND root_name = 'root')").repartition(6)
    target = tmp_path / "out"
    files.write_snapshots(frames, str(target), F.lit(0), compress=compress)
    back = files.read_snapshots(spark, str(target)).withColumn("snapshot_id", F.regexp_extract("snapshot_id", "-([a-z]+)/$", 1))
    assert back.exceptAll(frames).count() == frames.exceptAll(back).count() == 0
    parts = sorted(target.glob("snapshot=*-t/part=*/part-*"))
    assert len(parts) > 1
    text = b"".join(gzip.decompress(p.read_bytes()) if compress else p.read_bytes() for p in parts)
    rows = tree_json.tree_rows("t", json.loads(text))
    assert {(r, tuple(p), n, v) for _, r, p, n, v in rows} == {(r.root_name, tuple(r.path), r.name, r.value) for r in frames.filter("snapshot_id = 't'").collect()}
    texts = {r.snapshot_id: r.payload for r in tree_json.tree_to_json(frames).collect()}
    assert json.loads(texts["t"]) == json.loads(text) and len(texts) == 4


def test_parts_and_whole_files_side_by_side(spark, tmp_path, many_ranges):
    files.write_snapshots(spark.createDataFrame(odd_forest(), FRAMES), str(tmp_path / "x"), F.lit(0))
    (tmp_path / "plain.json").write_bytes(b'{"name":"r","value":1}')
    assert files.read_snapshots(spark, str(tmp_path)).count() == len(odd_forest()) + 1


def test_files_plain_and_gzip_whatever_their_name(spark, tmp_path):
    doc = b'{"name":"r","value":1,"children":{"k":{"name":"n","value":2}}}'
    (tmp_path / "plain.fgo").write_bytes(doc)
    (tmp_path / "packed.json").write_bytes(gzip.compress(doc))
    rows = files.read_snapshots(spark, str(tmp_path)).collect()
    assert sorted((r.snapshot_id.rsplit("/", 1)[1], tuple(r.path), r.name, r.value) for r in rows) == [
        ("packed.json", (), "r", 1), ("packed.json", ("k",), "n", 2), ("plain.fgo", (), "r", 1), ("plain.fgo", ("k",), "n", 2),
    ]


@pytest.mark.parametrize("compress", [True, False])
def test_write_snapshots(spark, tmp_path, compress):
    target = str(tmp_path / "out")
    files.write_snapshots(frames_of(spark), target, F.lit(1_700_000_000_123_456), compress=compress)
    back = files.read_snapshots(spark, target)
    assert back.drop("snapshot_id").exceptAll(frames_of(spark).drop("snapshot_id")).count() == 0 and back.count() == 7
    assert "snapshot-20231114T221320.123-s" in {r.snapshot_id.split("snapshot=")[1].split("/")[0] for r in back.collect()}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_snapshots(frames_of(spark), target, F.lit(0))


def test_ndjson(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.json").write_text('{"ts":18446744073709551615,"g":3,"p":-1,"type":1000,"val":5,"stack":[1,18446744073709551615]}\n{"ts":1,"g":1,"p":0,"type":1}\n')
    rows = sorted(files.read_trace_ndjson(spark, str(good)).collect(), key=lambda r: r.ts)
    assert int(rows[1].ts) == 2**64 - 1 and int(rows[1].stack[1]) == 2**64 - 1 and rows[0].val == 0 and rows[0].stack is None
    (good / "b.json").write_text('{"ts":1,"g":1}\nnot json\n')
    with pytest.raises(Exception):
        files.read_trace_ndjson(spark, str(good)).collect()


def test_plugins(spark):
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Idle(DataSource):
        @classmethod
        def name(cls):
            return "idle_sampler"

        def schema(self):
            return "process_id string, stack array<string>, weight bigint"

        def reader(self, schema):
            return IdleReader()

    class IdleReader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(3)]

        def read(self, partition):
            yield (f"p{partition.value}", ["idle"], 1)

    plugins.register("source", "idle", lambda: Idle)
    with pytest.raises(ValueError):
        plugins.register("source", "idle", lambda: Idle)
    assert set(plugins.by_kind("source")) == {"idle"} and plugins.by_kind("none") == {}
    plugins.register_data_sources(spark)
    built = flame.flame_build(spark.read.format("idle_sampler").load(), keys=[])
    assert {tuple(r.path): r.value for r in built.collect()} == {(): 0, ("idle",): 3}
    plugins.register("function", "twice", lambda: (lambda x: str(x) * 2))
    plugins.register_functions(spark)
    assert spark.sql("SELECT twice('a')").first()[0] == "aa"
