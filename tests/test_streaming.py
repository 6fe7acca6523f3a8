"""Streams in several micro-batches against the batch operators on the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from emberframe.functions.rules import Rule
from emberframe.operators import alerts, counters, flame
from emberframe.plans import queries
from emberframe.sources import streams
from emberframe.streaming import joins, sinks, state, windows
from emberframe.workspace import fresh_dir


def feed(spark, df, order, batches=3):
    """A stream that brings ``df`` in time order, one file per micro-batch."""
    path = fresh_dir(spark, "feed")
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, mode="append", sink=None):
    out = fresh_dir(spark, "out")
    sinks.run_available(stream, sink or sinks.table_sink(out), fresh_dir(spark, "checkpoint"), mode)
    return spark.read.parquet(out) if sink is None else None


def same(a, b):
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_windows(spark):
    r = random.Random(1)
    rows = [(r.choice("pq"), i * 100_000, [r.choice("ab"), r.choice("cd")], r.randint(0, 2)) for i in range(90)]
    df = spark.createDataFrame(rows, "process_id string, us bigint, stack array<string>, weight bigint").withColumn("ts", F.timestamp_micros("us"))
    got = run(spark, windows.flame_window(feed(spark, df, "us"), watermark="0 seconds"))
    want = flame.flame_build(df.withColumn("window", F.window("ts", "500 milliseconds")), ["window", "process_id"])
    closed = want.filter(F.unix_micros("window.end") <= 8_900_000)
    same(got.select(closed.columns), closed)
    assert got.count() > 50
    sliding = run(spark, windows.flame_window(feed(spark, df, "us"), "1 second", "0 seconds", slide="500 milliseconds"))
    assert sliding.filter("size(path) = 0").count() > 30
    bursts = run(spark, windows.flame_session(feed(spark, df, "us"), "150 milliseconds", "0 seconds"))
    assert bursts.count() > 10


def test_counters(spark):
    r, count, rows = random.Random(2), 0, []
    for i in range(120):
        count += r.choice([0, 0, 1, 3, 600])
        rows.append((r.choice([1, 1, 2]), i, r.randint(0, 9), count, [(s * 7) % 5 for s in range(256)]))
    df = spark.createDataFrame(rows, "process_id bigint, us bigint, heap_alloc bigint, num_gc bigint, pause_ns array<bigint>")
    want = counters.heap_delta(df).unionByName(counters.gc_unroll(df).drop("cycle"))
    for max_rows in (1000, 10):
        out = fresh_dir(spark, "samples")
        count = state.stream_counters(fresh_dir(spark, "last"), sinks.table_sink(out), ["us"], max_rows)
        run(spark, feed(spark, df, "us"), sink=count)
        same(spark.read.parquet(out).select(want.columns), want)


def test_counters_of_a_repeated_batch(spark):
    schema = "process_id bigint, us bigint, heap_alloc bigint, num_gc bigint, pause_ns array<bigint>"
    rows = lambda *pairs: spark.createDataFrame([(1, t, h, 0, [1] * 256) for t, h in pairs], schema)
    seen = []
    count = state.stream_counters(fresh_dir(spark, "last"), lambda b, i: seen.append([(r.us, r.weight) for r in b.collect()]))
    count(rows((1, 10)), 0)
    for _ in range(2):
        count(rows((2, 15)), 1)
    count(rows((3, 11)), 2)
    assert seen == [[], [(2, 5)], [(2, 5)], [(3, -4)]]


def test_packed_counters(spark, tmp_path):
    """A sink gets a row per reading, however many collections lie between two; short rings, restarts and nulls are as before."""
    ring = [(s * 7) % 5 for s in range(256)]
    rows = [(1, 1, 5, 10, ring), (1, 2, 5, 1300, ring), (1, 3, 8, 1300, ring), (1, 4, 9, 3, ring), (1, 5, None, 4, None), (1, 6, 9, None, ring), (1, 7, 9, 70, ring)]
    rows += [(2, 1, 5, 0, [3, 4]), (2, 2, 6, 2, [3, 4]), (None, 1, 1, 0, ring), (None, 2, 1, 256, ring), (None, 3, 2, 512 + 7, ring)]
    df = spark.createDataFrame(rows, "process_id bigint, us bigint, heap_alloc bigint, num_gc bigint, pause_ns array<bigint>")
    out, sizes = fresh_dir(spark, "steps"), []
    write = sinks.multi_sink([sinks.table_sink(out), lambda b, i: sizes.append(b.count())])
    state.stream_counters(fresh_dir(spark, "last"), write, packed=True)(df, 0)
    got = counters.samples_of(spark.read.parquet(out), ["us"])
    same(got, counters.heap_delta(df).filter("us != 7").unionByName(counters.gc_unroll(df).drop("cycle")))
    assert got.count() > 1000 and sizes == [8]


def test_event_stream_of_several_files(spark, tmp_path):
    """A micro-batch is many files, so many tasks make it, and micro-batches still follow each other in time."""
    rows = spark.range(4000).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, pmod(id * 7919, 4001)) AS ts", "id % 7 AS user_id", "'view' AS event_type", "1.5D AS value", "'' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    for file_rows, files in ((100, 9), (1000, 1)):
        seen = []
        watch = lambda b, i: seen.append((*b.agg(F.min("us"), F.max("us"), F.count("*")).first(), len(b.select(F.input_file_name()).distinct().collect()) if i else 0))
        sinks.run_available(queries.event_stream(spark, str(tmp_path), file_rows=file_rows), watch, fresh_dir(spark, "checkpoint"))
        assert len(seen) == 4 and sum(n for *_, n, _ in seen) == 4000
        assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
        assert all(f >= files for *_, f in seen[1:])


def test_spans(spark):
    trace = "0af7651916cd43dd8448eb211c80319c"
    rows = [(i % 3, i * 1_000_000, i, f"trace_id={trace},{i:016x}" if i % 4 else "bad") for i in range(30)]
    rows += [(9, 1, 99, f"trace_id={trace}")]
    df = spark.createDataFrame(rows, "gid bigint, us bigint, event_id bigint, ann string")
    path, seen = fresh_dir(spark, "spans"), []
    handle = state.span_state(path, lambda b, i: seen.append((i, b.count())), ttl_us=15_000_000)
    run(spark, feed(spark, df, "us"), sink=handle)
    assert [i for i, _ in seen] == [0, 1, 2] and all(n for _, n in seen)
    newest = {r.gid: r.label for r in state.remembered(spark, path, 2).collect()}
    # goroutine 9 is forgotten
    assert newest == {g: f"{trace}:{max(i for i in range(30) if i % 3 == g and i % 4):016x}" for g in range(3)}


def test_alerts(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 1, 2]), i, float(r.randint(0, 10))) for i in range(150)]
    df = spark.createDataFrame(rows, "process_id bigint, us bigint, x double")
    rules = [Rule("high", "x > 2", 10), Rule("odd", "safe_div(x, missing) < 1 AND x < 9", 4)]
    out, kept, ran = fresh_dir(spark, "out"), fresh_dir(spark, "kept"), []
    handle = state.stream_alerts(kept, sinks.multi_sink([sinks.table_sink(out), lambda b, i: ran.append(i)]), rules)
    run(spark, feed(spark, df, "us", 5), sink=handle)
    got = spark.read.parquet(out)
    want = alerts.alert_hold(alerts.rule_eval(df, rules, ["process_id", "us"]), alerts.hold_of(rules), ["rule", "process_id"])
    same(got.select(want.columns), want)
    assert got.count() > 3 and ran == [0, 1, 2, 3, 4]
    # of runs that are over nothing is kept
    last = {(r.rule, r.process_id): r.x for r in alerts.rule_eval(df, rules, ["process_id", "us"]).groupBy("rule", "process_id").agg(F.max_by("holds", "us").alias("x")).collect()}
    assert {(r.rule, r.process_id) for r in state.remembered(spark, kept, 4).collect()} == {k for k, holds in last.items() if holds}


def test_dedup(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(f"r{r.randint(0, 12)}", i) for i in range(150)], "rule string, us bigint")
    out = fresh_dir(spark, "out")
    run(spark, feed(spark, df, "us", 4), sink=state.stream_dedup_lru(fresh_dir(spark, "kept"), sinks.table_sink(out), capacity=5))
    same(spark.read.parquet(out).select("rule", "us"), alerts.alert_dedup_lru(df, capacity=5))


def test_ingest_numbers_go_on_and_survive_a_repeat(spark):
    df = spark.createDataFrame([(i * 10, f"c{i}") for i in range(20)], "us bigint, payload string")
    path = fresh_dir(spark, "ingest")
    store = sinks.ingest_sink(path, ["us"])
    store(df.filter("us < 50"), 0)
    store(df.limit(0), 1)
    store(df.filter("us >= 50"), 2)
    store(df.filter("us >= 50"), 2)
    assert [(r.seq, r.us) for r in spark.read.parquet(path).orderBy("seq").collect()] == [(i + 1, i * 10) for i in range(20)]


def test_multi_sink_stops_at_the_first_error(spark):
    seen = []

    def failing(batch, batch_id):
        raise RuntimeError("sink is down")

    sink = sinks.multi_sink([lambda b, i: seen.append(b.count()), failing, lambda b, i: seen.append("never")])
    with pytest.raises(RuntimeError):
        sink(spark.range(3), 0)
    assert seen == [3]


def test_delivery_is_tried_again(spark):
    tries = []

    def send(messages):
        tries.append([r.payload for r in messages.collect()])
        if len(tries) < 3:
            raise OSError("not now")

    sinks.alert_sink(F.col("id").cast("string"), send)(spark.range(2), 0)
    assert tries == [["0", "1"]] * 3
    with pytest.raises(OSError):
        sinks.alert_sink(F.col("id").cast("string"), lambda m: (_ for _ in ()).throw(OSError("never")))(spark.range(2), 0)


def test_old_partitions_go(spark, tmp_path):
    days = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3)], "day string, v int")
    days.write.mode("overwrite").option("path", str(tmp_path / "t")).partitionBy("day").saveAsTable("history")
    sinks.drop_partitions_before(spark, "history", "2024-01-02")
    assert sorted(r.v for r in spark.table("history").collect()) == [2, 3]
    spark.sql("DROP TABLE history")
    assert sorted(r.v for r in sinks.retained_partitions(spark, str(tmp_path / "t"), "2024-01-03").collect()) == [3]


SECOND = 1_000_000


def test_expired_spans_are_not_attached_and_leave_the_state(spark):
    r = random.Random(8)
    trace = lambda i: f"trace_id={i:032x}"
    ann = [(r.randint(1, 4), i * 40 * SECOND + r.randint(0, 9), i, trace(i)) for i in range(150)]
    ann += [(1, 3, 990, "no trace"), (None, 4, 991, trace(5)), (9, 5 * SECOND, 992, trace(77))]  # 9 is never heard of again
    frames = []
    for i in range(300):
        name = f"goroutine-{r.choice([1, 2, 3, 4, 9, 50])}" if r.random() < 0.9 else "main"
        frames.append((i, i * 20 * SECOND + 7, f"s{i}", "root", [name], name, 5))
    f = spark.createDataFrame(frames, "frame_id bigint, us bigint, snapshot_id string, root_name string, path array<string>, name string, value bigint")
    a = spark.createDataFrame(ann, "gid bigint, us bigint, event_id bigint, ann string")
    out = fresh_dir(spark, "children")
    children = joins.stream_trace_attach(feed(spark, f, "us", 6), feed(spark, a, "us", 6), "10 seconds")
    read, late, state_rows = joins.run_counted(spark, lambda: sinks.start_available(children, sinks.table_sink(out), fresh_dir(spark, "checkpoint")))
    want = {}
    for frame_id, us, *_, name, _ in frames:
        spans = [(t, i) for g, t, i, x in ann if name == f"goroutine-{g}" and x.startswith("trace") and 0 <= us - t <= 120 * SECOND]
        if spans and us < (300 * 20 - 300) * SECOND:
            want[frame_id] = f"{max(spans)[1]:032x}:" + "0" * 16
    got = {x.frame_id: (x.name, x.path[-1], x.value) for x in spark.read.parquet(out).filter(f"us < {(300 * 20 - 300) * SECOND}").collect()}
    assert got == {k: (v, "_trace", 0) for k, v in want.items()} and len(want) > 60
    assert read == 453 and late == 0 and len(state_rows) >= 6
    # a sixth of the rows arrive with each micro-batch; what is past its time has gone
    assert max(state_rows) < 300 and state_rows[-1] < max(state_rows) / 3


def test_notify_within(spark):
    rows = [("a", 100), ("b", 101), ("a", 105), ("a", 109), ("c", 160), ("d", 170), ("a", 220), ("b", 221), ("a", 222)]
    df = spark.createDataFrame([(x, t * SECOND) for x, t in rows], "rule string, us bigint").withColumn("ts", F.timestamp_micros("us"))
    got = run(spark, joins.stream_notify_within(feed(spark, df, "us", 9), ["rule"], "10 seconds"))
    assert sorted((r.rule, r.us // SECOND) for r in got.collect()) == [("a", 100), ("a", 220), ("b", 101), ("b", 221), ("c", 160), ("d", 170)]


def test_sampler_reads_each_row_once_over_restarts(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"i": list(range(1000)), "t": pa.array([None, "é"] * 500)}), tmp_path / "t.parquet", row_group_size=70)
    streams.register_streams(spark)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for until in (0, 130, 131, 700, 700, 1000):
        rows = spark.readStream.format(streams.SAMPLER).option("path", str(tmp_path / "t.parquet")).option("until", until).option("rows", 90).load()
        query = rows.writeStream.format(streams.EXPORTER).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    got = streams.read_export(spark, out, "i long, t string").orderBy("i").collect()
    assert [(r.i, r.t) for r in got] == [(i, [None, "é"][i % 2]) for i in range(1000)]
    reader = streams.SamplerReader({"path": str(tmp_path / "t.parquet"), "rows": "90"})
    assert [(p.first, p.end) for p in reader.partitions({"row": 100}, {"row": 300})] == [(100, 190), (190, 280), (280, 300)]
    assert reader.partitions({"row": 300}, {"row": 300}) == []


def test_only_committed_files_are_exported(spark, tmp_path):
    import os

    import pyarrow as pa

    writer = streams.ExporterWriter(str(tmp_path))
    batch = lambda *values: iter([pa.RecordBatch.from_pydict({"i": list(values)})])
    first, lost = writer.write(batch(1, 2)), writer.write(batch(1, 2))  # the task ran twice, the first attempt was lost
    writer.commit([lost, None], 0)
    given_up = writer.write(batch(9))
    writer.abort([given_up, None], 1)
    assert not os.path.exists(given_up.path) and os.path.exists(first.path)
    writer.commit([writer.write(batch(3))], 1)
    again = writer.write(batch(3))
    writer.commit([again], 1)  # the batch is repeated after a failure
    assert writer.write(iter([])) == streams.Written(None, 0)
    assert sorted(r.i for r in streams.read_export(spark, str(tmp_path), "i long").collect()) == [1, 2, 3]


def test_tail_does_not_open_what_was_replayed(spark, monkeypatch):
    path = fresh_dir(spark, "chunks")
    df = spark.range(40).selectExpr("id + 1 AS seq", "concat('c', id) AS payload")
    store = sinks.table_sink(path)
    for n in range(4):
        store(df.filter(f"seq > {n * 10} AND seq <= {n * 10 + 10}"), n)
    early, tail = sinks.replay_then_tail(spark, path, 25)
    assert sorted(r.seq for r in early.collect()) == list(range(1, 26))
    out = fresh_dir(spark, "out")
    sinks.run_available(tail, sinks.table_sink(out), fresh_dir(spark, "checkpoint"))
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == list(range(26, 41))
    reader = streams.TailReader({"path": path, "after": "1"})
    assert reader.initialOffset() == {"batch": 1} and reader.latestOffset() == {"batch": 3}
    opened = {p.path.split("batch=")[1].split("/")[0] for p in reader.partitions({"batch": 1}, {"batch": 3})}
    assert opened == {"2", "3"}
    assert {p.path.split("batch=")[1].split("/")[0] for p in reader.partitions({"batch": 2}, {"batch": 3})} == {"3"}
