from datetime import datetime, timezone

from pyspark.sql import functions as F

from emberframe.operators import counters, events
from emberframe.functions.scalars import clamp, event_wall_time, file_timestamp, ns_to_ms, tags_to_map


def trace(spark, rows):
    return spark.createDataFrame(rows, "ts bigint, g bigint, type int, val bigint").select(
        F.col("ts").cast("decimal(20,0)").alias("ts"), F.col("g").cast("decimal(20,0)").alias("g"), "type", "val"
    )


def test_time_range_is_half_open_and_may_be_open(spark):
    base = datetime(2024, 1, 1)
    ev = trace(spark, [(i * 1_000_000_000, 1, 1, i) for i in range(5)])
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    kept = lambda a, b, base=base: sorted(r.val for r in events.by_time_range(ev, base, a, b).collect())
    assert kept(at(1), at(3)) == [1, 2]
    assert kept(None, at(2)) == [0, 1]
    assert kept(at(3), None) == [3, 4]
    assert kept(None, None) == [0, 1, 2, 3, 4]
    assert kept(at(1), at(3), F.lit(int(base.replace(tzinfo=timezone.utc).timestamp()) * 10**9)) == [1, 2]


def test_goroutine_and_types(spark):
    ev = trace(spark, [(1, 1, 1, 10), (2, 2, 1000, 20), (3, 2, 4, 30)])
    assert events.by_goroutine(ev, 2).count() == 2
    assert events.by_goroutine(ev, 0).count() == 3
    assert events.by_event_types(ev, [1, 4]).count() == 2
    assert events.by_event_types(ev, []).count() == 3
    assert {(r.type, r.total) for r in events.sum_by_type(ev.union(ev)).collect()} == {(1, 20), (1000, 40), (4, 60)}


def test_downsample_takes_positions_0_n_2n(spark):
    ev = spark.createDataFrame([(i * 5, i) for i in range(7)], "at bigint, id bigint")
    ids = lambda n: sorted(r.id for r in events.downsample(ev.repartition(3), n, ["at", "id"]).collect())
    assert ids(3) == [0, 3, 6]
    assert ids(1) == ids(0) == list(range(7))


def test_rates_are_clamped():
    assert [events.effective_rate("goroutine", hz) for hz in (1, 50, 999)] == [10, 50, 200]
    assert [events.effective_rate("gc", hz) for hz in (0, 1, 5000)] == [10, 1, 1000]
    assert [events.effective_rate("heap", hz) for hz in (0, 2, 9)] == [1, 2, 4]
    assert [events.effective_rate("blocked", hz) for hz in (1, 100, 900)] == [5, 100, 500]


def test_rate_limit_keeps_the_first_reading_of_a_period(spark):
    readings = spark.createDataFrame([("a", t, t) for t in (0, 100_000, 260_000, 499_999, 500_000)], "process_id string, us bigint, v bigint")
    assert sorted(r.v for r in events.rate_limit(readings, "heap", 4).collect()) == [0, 260_000, 500_000]


def test_heap_delta(spark):
    rows = [("p", t, v) for t, v in enumerate([10, 30, 30, 5])] + [("q", 0, 7)]
    got = counters.heap_delta(spark.createDataFrame(rows, "process_id string, us bigint, heap_alloc bigint"))
    assert [(r.us, r.stack, r.weight) for r in got.orderBy("us").collect()] == [(1, ["(Heap)"], 20), (3, ["(Heap)"], -25)]


def gc(spark, counts, slots):
    rows = [("p", t, c, slots) for t, c in enumerate(counts)]
    df = spark.createDataFrame(rows, "process_id string, us bigint, num_gc bigint, pause_ns array<bigint>")
    return [(r.us, r.cycle, r.weight) for r in counters.gc_unroll(df).orderBy("us", "cycle").collect()]


def test_gc_unroll_reads_the_slots_between(spark):
    slots = [0] * 256
    slots[7], slots[8], slots[9] = 70, 80, 90
    assert gc(spark, [7, 9], slots) == [(1, 7, 70), (1, 8, 80)]
    assert gc(spark, [6, 6, 8], slots) == [(2, 7, 70)]


def test_gc_unroll_wraps_and_rereads(spark):
    slots = list(range(1000, 1256))
    top = 2**32
    assert gc(spark, [top - 1, 1], slots) == [(1, 0, 1000), (1, top - 1, 1255)]
    assert gc(spark, [10, 610], slots) == [(1, i, 1000 + i % 256) for i in range(10, 610)]


def test_gc_unroll_after_a_restart(spark):
    slots = list(range(1000, 1256))
    # a count that falls is that of a new process: its cycles from 0, not the way around the counter
    assert gc(spark, [100, 3, 4], slots) == [(1, 0, 1000), (1, 1, 1001), (1, 2, 1002), (2, 3, 1003)]


def test_blocked_estimate(spark):
    df = spark.createDataFrame([(1, 10, 4), (2, 4, 10), (3, 5, 5)], "us bigint, goroutines bigint, profiled bigint")
    assert [(r.us, r.stack, r.weight) for r in counters.blocked_estimate(df).collect()] == [(1, ["(Blocked)"], 6)]


def test_metric_rollup(spark):
    rows = [("p", 1, 5, 100, 7), ("p", 2, None, 90, 3), ("p", 3, 4, None, None)]
    df = spark.createDataFrame(rows, "process_id string, us bigint, blocked_goroutines bigint, heap_bytes bigint, gc_pause_ns bigint")
    assert tuple(counters.metric_rollup(df).first()) == ("p", 4, 90, 10, 3)


def test_subscribers_and_heartbeats(spark):
    df = spark.createDataFrame([("g", t, c) for t, c in enumerate([1, 1, -1, 1])], "gateway string, us bigint, change bigint")
    assert [r.subscribers for r in counters.subscriber_gauge(df).orderBy("us").collect()] == [1, 2, 1, 2]
    beats = spark.createDataFrame([("a", 1000, 1, 5, 50, 1030), ("a", 2000, 2, 6, 60, 2010)],
                                  "id string, ts_unix_ms bigint, event_id bigint, goroutines bigint, heap_bytes bigint, received_unix_ms bigint")
    assert tuple(counters.heartbeat_lag(beats).first()) == ("a", 2000, 6, 60, 10, 30)


def test_minimap_series(spark):
    rows = [(1, "heap", 5), (9, "heap", 7), (3, "gc", 2), (4, "gc", 3), (12, "blocked", 1)]
    got = counters.minimap_series(spark.createDataFrame(rows, "us bigint, metric string, value bigint"), 10)
    assert [tuple(r) for r in got.orderBy("us").collect()] == [(0, 7, None, 5), (10, None, 1, None)]


def test_scalars(spark):
    row = spark.range(1).select(
        F.unix_micros(event_wall_time(1_000_000, F.lit(2_500_999))).alias("wall"),
        ns_to_ms(F.lit(1_234_567)).alias("ms"),
        file_timestamp(F.lit(1_700_000_000_123_456)).alias("file"),
        tags_to_map(F.array(F.lit("a=1"), F.lit("b"), F.lit("a=2=3"))).alias("tags"),
        clamp(F.lit(9), 1, 4).alias("c"),
    ).first()
    assert tuple(row) == (1_002_500, 1.23, "20231114T221320.123", {"a": "2=3", "b": ""}, 4)
