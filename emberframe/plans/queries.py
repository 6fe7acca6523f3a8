"""Named queries: each operator over the tables of a data folder, every row of them."""

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from emberframe.functions import payloads, rules, scalars, spans as span_functions, stacks
from emberframe.operators import alerts, counters, events, flame, retention, spans, symbols, tree_json
from emberframe.sources import files, streams, tables
from emberframe.streaming import joins, sinks, state, windows
from emberframe.workspace import fresh_dir, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
RULES = {
    "busy": "click > 3",
    "ratio": "safe_div(error, view) >= 1 AND purchase < 5",
    "spread": "signup - 3",
    "unknown": "nothing_reported < 1",
    "both": "truth(click) AND NOT truth(error)",
    "several": "num(click > 1) + num(view > 1) + num(error > 0) >= 2",
    "quiet": "last_error < 1",
}
STREAM_RULES = [rules.Rule("large", "value > 20", DAY_US), rules.Rule("small", "NOT (value > 60)", 2 * DAY_US)]
RULE_TABLE = [
    ("busy", "click > 3", 7_200_000, ["chat", "pager"]),
    ("ratio", "safe_div(error, view) >= 1 AND purchase < 5", 10_800_000, ["issues"]),
    ("spread", "signup - 3", 3_600_000, []),
    ("unknown", "nothing_reported < 1", 0, ["chat"]),
]
EVENT_ORDER = ["us", "event_id"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(path: str = "path") -> Column:
    return F.array_join(path, ";").alias("path")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return flame.flame_build(tables.stack_samples(spark, sf))


def shown(df: DataFrame) -> DataFrame:
    """Frame rows with the path as text."""
    return df.select("snapshot_id", joined(), "name", "value")


def years(spark: SparkSession, sf: str, first: int, last: int) -> DataFrame:
    """Trees of some years; the range of days reaches the scan."""
    return flame.flame_build(tables.stack_samples(spark, sf, f"{first}-01-01", f"{last + 1}-01-01"))


def trace_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("ts").cast("long").alias("ts"),
        F.col("g").cast("long").alias("g"),
        F.col("p").cast("long").alias("p"),
        F.col("type").cast("long").alias("type"),
        "val",
    )


# ---- sources and sinks


@query
def read_trace_ndjson(spark, sf):
    path = fresh_dir(spark, "trace")
    tables.trace_events(spark, sf).drop("event_id").write.json(path)
    return trace_columns(files.read_trace_ndjson(spark, path))


def _file_rows(df: DataFrame) -> DataFrame:
    return shown(df.withColumn("snapshot_id", F.regexp_extract("snapshot_id", r"snapshot=[^/]*-([0-9]+)/", 1)))


@query
def read_snapshots(spark, sf):
    path = fresh_dir(spark, "snapshots")
    files.write_snapshots(frames(spark, sf), path, F.lit(0).cast("long"))
    return _file_rows(files.read_snapshots(spark, path))


@query
def write_snapshots(spark, sf):
    path = fresh_dir(spark, "snapshots")
    files.write_snapshots(frames(spark, sf), path, F.lit(0).cast("long"), compress=True)
    return _file_rows(files.read_snapshots(spark, path))


@query
def tree_explode(spark, sf):
    return shown(tree_json.tree_explode(tree_json.tree_to_json(frames(spark, sf))))


@query
def tree_to_json(spark, sf):
    return tree_json.tree_to_json(frames(spark, sf))


#: Rows of a file of a stream; a micro-batch of several times as many is several files.
FILE_ROWS = 25_000


def event_stream(spark: SparkSession, sf: str, batches: int = 4, file_rows: int = FILE_ROWS) -> DataFrame:
    """All events as a stream of ``batches`` micro-batches in time order, each of the same number of files."""
    events = tables.table(spark, sf, "events")
    path = fresh_dir(spark, "events")
    us = tables.micros("ts")
    cuts = events.agg(F.percentile_approx(us, [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    bounds = [None, *cuts, None]
    slices = []
    for low, high in zip(bounds, bounds[1:]):
        part = events if low is None else events.filter(us >= low)
        slices.append(part if high is None else part.filter(us < high))
    files = _files_of(slices, file_rows)
    for part in slices:
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn("us", us)


def _files_of(slices: list[DataFrame], file_rows: int) -> int:
    """How many files each slice is written to, so that none of them stays empty: rows are dealt in turn, and a slice with that
    many rows for each of its partitions has one at least that fills all files."""
    least = min(part.count() for part in slices)
    files = least // file_rows
    return files if files > 1 and least >= files * max(part.rdd.getNumPartitions() for part in slices) else 1


def chunk_stream(spark: SparkSession, sf: str) -> DataFrame:
    return event_stream(spark, sf).select("us", "event_id", F.col("props").alias("payload"))


@query
def ingest_stream(spark, sf):
    path = fresh_dir(spark, "ingest")
    sinks.run_available(chunk_stream(spark, sf), sinks.ingest_sink(path, EVENT_ORDER), fresh_dir(spark, "checkpoint"))
    return spark.read.parquet(path).select("seq", "us", "payload")


@query
def replay_then_tail(spark, sf):
    path, out = fresh_dir(spark, "chunks"), fresh_dir(spark, "delivered")
    chunks = stored(tables.snapshot_chunks(spark, sf), "all-chunks")
    cuts = [F.unix_micros(F.lit(day).cast("timestamp")) for day in ("2024-01-09", "2024-01-16", "2024-01-23")]
    batch = sum((F.when(F.col("us") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    store = lambda n, rows: sinks.table_sink(path)(rows, n)
    for n in (0, 1):
        store(n, chunks.filter(batch == n))
    seen = spark.read.parquet(path).agg(F.max("seq")).first()[0]
    early, tail = sinks.replay_then_tail(spark, path, seen)
    sinks.table_sink(out)(early, -1)
    # chunks of the first days arrive again with the new ones: the tail passes new ones only
    checkpoint = fresh_dir(spark, "checkpoint")
    for n in (2, 3):
        store(n, chunks.filter((batch == n) | (batch == 0)))
        # a query that starts again goes on behind the batch it read last
        sinks.run_available(tail, sinks.table_sink(out), checkpoint)
    return spark.read.parquet(out).select("seq", "us", "payload")


@query
def multi_sink(spark, sf):
    first, second = fresh_dir(spark, "first"), fresh_dir(spark, "second")
    both = sinks.multi_sink([sinks.table_sink(first), sinks.table_sink(second)])
    sinks.run_available(chunk_stream(spark, sf), both, fresh_dir(spark, "checkpoint"))
    read = lambda path, name: spark.read.parquet(path).select(F.lit(name).alias("sink"), "us", "payload")
    return read(first, "first").unionByName(read(second, "second"))


# ---- projections, filters, predicates


@query
def by_time_range(spark, sf):
    base_ns = tables.events(spark, sf).select(F.min("us") * 1000).scalar()
    return trace_columns(
        events.by_time_range(tables.trace_events(spark, sf), base_ns, datetime(2024, 1, 5), datetime(2024, 1, 20, 12))
    )


@query
def by_goroutine(spark, sf):
    return trace_columns(events.by_goroutine(tables.trace_events(spark, sf), 7))


@query
def by_event_types(spark, sf):
    return trace_columns(events.by_event_types(tables.trace_events(spark, sf), [4, 1000]))


@query
def event_wall_time(spark, sf):
    base = tables.events(spark, sf).select(F.min("us")).scalar()
    return tables.trace_events(spark, sf).select(
        "event_id", F.unix_micros(scalars.event_wall_time(base, F.col("ts"))).alias("wall_us")
    )


@query
def sample_admission(spark, sf):
    samples = tables.table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.filter(F.array("l_returnflag", "l_linestatus"), lambda x: ~x.isin("A", "F")).alias("stack"),
        (F.col("l_quantity") - 25).cast("long").alias("weight"),
    )
    return flame.sample_admission(samples).select("l_orderkey", joined("stack"), "weight")


def part_stacks(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf-first function names per part, with a gap and the wrapper frames."""
    return tables.table(spark, sf, "part").select(
        "p_partkey",
        F.array(
            F.concat(F.lit("example.com/parts/"), "p_brand", F.lit("."), "p_type"),
            F.lit(""),
            F.lit("net/http.Serve"),
            F.concat(F.lit("main."), F.replace("p_name", F.lit(" "), F.lit("_"))),
            F.lit("runtime.main"),
            F.lit("runtime.goexit"),
        ).alias("names"),
    )


@query
def normalise_stack(spark, sf):
    return part_stacks(spark, sf).select("p_partkey", F.array_join(stacks.normalise_stack(F.col("names")), ";").alias("path"))


@query
def trim_package(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", stacks.trim_package(F.col("url")).alias("name"))


@query
def exclude_packages(spark, sf):
    kept = stacks.exclude_packages(stacks.normalise_stack(F.col("names")), ["runtime", "net/http", "reflect"])
    return part_stacks(spark, sf).select("p_partkey", F.array_join(kept, ";").alias("path"))


@query
def flame_search(spark, sf):
    found = flame.flame_search(frames(spark, sf), "Nation_1")
    return found.select("snapshot_id", joined(), "name", "value", "matched")


@query
def ancestor_closure(spark, sf):
    leaves = frames(spark, sf).filter(F.size("path") == 4)
    return flame.ancestor_closure(leaves).select("snapshot_id", joined())


@query
def threshold_filter(spark, sf):
    return alerts.threshold_filter(tables.hourly_metrics(spark, sf), "error", ">=", 3).select("us", "error")


def with_last_error(metrics: DataFrame) -> DataFrame:
    """A BIGINT metric that is null in most hours."""
    return metrics.withColumn("last_error", F.when(F.col("error") > 1, F.col("hour")))


@query
def rule_eval(spark, sf):
    return alerts.rule_eval(with_last_error(tables.hourly_metrics(spark, sf)), RULES)


@query
def frame_band(spark, sf):
    name = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for x in ("purchase", "(Heap)", "error", "(Blocked)", "view", "(GC)")]), F.col("event_type")),
        F.col("event_type"),
    )
    named = tables.events(spark, sf).select("event_id", name.alias("name"), (tables.cents("value") - 2000).alias("value"))
    return named.select(
        "event_id",
        stacks.frame_band(F.col("name"), F.col("value")).alias("band"),
        F.signum("value").cast("long").alias("sign"),
    )


@query
def stable_hash_bucket(spark, sf):
    names = tables.table(spark, sf, "customer").select(F.col("c_name").alias("name")).union(
        tables.table(spark, sf, "pages").select("url")
    ).distinct()
    return names.select("name", stacks.fnv1a32(F.col("name")).alias("hash"), stacks.stable_hash_bucket(F.col("name")).alias("bucket"))


@query
def scalar_functions(spark, sf):
    return tables.events(spark, sf).select(
        "event_id",
        scalars.ns_to_ms(F.col("us") % 1_000_000_000).alias("ms"),
        scalars.file_timestamp(F.col("us")).alias("file_time"),
        scalars.clamp(tables.cents("value"), 500, 5000).alias("clamped"),
    )


@query
def child_key_union(spark, sf):
    """Union of the keys of two maps: the nations of customers and of suppliers per region."""
    nations = tables.table(spark, sf, "nation")
    count = lambda name, key: (
        tables.table(spark, sf, name)
        .join(nations, F.col(key) == F.col("n_nationkey"))
        .groupBy("n_regionkey", "n_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("n_regionkey")
        .agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n"))).alias(name))
    )
    both = count("customer", "c_nationkey").join(count("supplier", "s_nationkey"), "n_regionkey", "full_outer")
    empty = F.array().cast("array<string>")
    keys = F.array_union(F.coalesce(F.map_keys("customer"), empty), F.coalesce(F.map_keys("supplier"), empty))
    return both.select(F.col("n_regionkey").cast("long").alias("n_regionkey"), F.array_join(F.array_sort(keys), ";").alias("keys"))


# ---- joins


@query
def flame_diff(spark, sf):
    delta = flame.flame_diff(years(spark, sf, 1997, 1997), years(spark, sf, 1996, 1996))
    return delta.select(joined(), "name", "delta")


@query
def snapshot_diff(spark, sf):
    delta = flame.snapshot_diff(years(spark, sf, 1996, 1997), "1997", "1996")
    return delta.select(joined(), "name", "delta")


def two_files(spark: SparkSession, sf: str) -> str:
    """Snapshot files of two years; their folder."""
    path = fresh_dir(spark, "files")
    files.write_snapshots(years(spark, sf, 1996, 1997), path, F.lit(0), compress=True)
    return path


@query
def diff_files(spark, sf):
    """Two snapshot files to the JSON tree of their difference."""
    path = two_files(spark, sf)
    side = lambda year: files.read_snapshots(spark, f"{path}/snapshot=*-{year}")
    delta = flame.diff_frames(flame.flame_diff(side(1997), side(1996)))
    return tree_json.tree_explode(tree_json.tree_to_json(delta)).select(joined(), "name", "value")


@query
def replay_files(spark, sf):
    """Snapshot files flattened and summed up, one row per file."""
    summary = flame.replay_summary(flame.flame_flatten(files.read_snapshots(spark, two_files(spark, sf))))
    return summary.withColumn("snapshot_id", F.regexp_extract("snapshot_id", r"snapshot=[^/]*-([0-9]+)/", 1))


def goroutine_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Every event but sign-ups as a frame named after its user's goroutine."""
    name = F.concat(F.lit("goroutine-"), F.col("user_id").cast("string"))
    return (
        tables.events(spark, sf)
        .filter(F.col("event_type") != "signup")
        .select(
            F.col("event_id").alias("frame_id"),
            "us",
            F.col("event_id").cast("string").alias("snapshot_id"),
            F.array(name).alias("path"),
            name.alias("name"),
            tables.cents("value").alias("value"),
        )
    )


@query
def trace_attach(spark, sf):
    attached = spans.trace_attach(goroutine_frames(spark, sf), tables.annotations(spark, sf), ttl_us=DAY_US)
    return shown(attached)


@query
def symbolise(spark, sf):
    stacked = symbols.symbolise(tables.pc_samples(spark, sf), tables.symbols(spark, sf))
    return stacked.select("sample_id", joined("stack"))


@query
def trace_to_tree(spark, sf):
    """Trace files with address stacks to one tree per event type: read, symbolise, build."""
    path = fresh_dir(spark, "trace")
    parts = tables.table(spark, sf, "part").agg(F.count(F.lit(1))).scalar()
    # the function that an address belongs to, leaf first
    pcs = [((F.col("event_id") * 7 + 13 * j) % parts + 1) * 10 + j + 1 for j in range(3)]
    events_with_stacks = tables.trace_events(spark, sf).withColumn("stack", F.array(*[c.cast("decimal(20,0)") for c in pcs]))
    events_with_stacks.drop("event_id").write.json(path)
    samples = symbols.trace_samples(files.read_trace_ndjson(spark, path), tables.symbols(spark, sf), ["type"])
    trees = flame.flame_build(samples.withColumnRenamed("type", "snapshot_id"))
    return shown(trees.withColumn("snapshot_id", F.col("snapshot_id").cast("string")))


@query
def agent_enrich(spark, sf):
    facts = tables.events(spark, sf).select(F.col("user_id").alias("agent_id"), "event_id")
    enriched = spans.agent_enrich(facts, tables.agents(spark, sf), "agent_id")
    tags = scalars.tags_to_map(F.col("tags"))
    return enriched.select(
        "event_id",
        "hostname",
        "version",
        F.col("pid").cast("long").alias("pid"),
        F.try_element_at(tags, F.lit("segment")).alias("segment"),
        F.try_element_at(tags, F.lit("nation")).alias("nation"),
    )


# ---- aggregations


@query
def flame_build(spark, sf):
    return shown(frames(spark, sf))


@query
def flame_merge(spark, sf):
    every = stored(frames(spark, sf), "frames")
    merged = flame.flame_merge([every.filter(F.col("snapshot_id") == str(y)) for y in range(1995, 2002)])
    return merged.select(joined(), "name", "value")


@query
def flame_flatten(spark, sf):
    flat = flame.flame_flatten(frames(spark, sf))
    return flat.select(
        "snapshot_id", joined(), "name", F.col("depth").cast("long").alias("depth"), "self", "cumulative", "self_exclusive"
    )


@query
def replay_summary(spark, sf):
    return flame.replay_summary(flame.flame_flatten(frames(spark, sf)))


@query
def sum_by_type(spark, sf):
    return events.sum_by_type(tables.trace_events(spark, sf)).select(F.col("type").cast("long").alias("type"), "total")


@query
def metric_rollup(spark, sf):
    of = lambda kind, value: F.when(F.col("event_type") == kind, value)
    updates = tables.events(spark, sf).select(
        F.col("user_id").alias("process_id"),
        *EVENT_ORDER,
        of("error", F.col("event_id") % 100).alias("blocked_goroutines"),
        of("purchase", tables.cents("value")).alias("heap_bytes"),
        of("view", tables.cents("value")).alias("gc_pause_ns"),
    )
    rolled = counters.metric_rollup(updates, order=EVENT_ORDER)
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return rolled.select("process_id", none("blocked_goroutines"), none("heap_bytes"), "gc_pause_total_ns", "chunks_received_total")


# ---- ordered computations


@query
def heap_delta(spark, sf):
    deltas = counters.heap_delta(tables.heap_readings(spark, sf), EVENT_ORDER)
    return deltas.select("process_id", *EVENT_ORDER, joined("stack"), "weight")


@query
def gc_unroll(spark, sf):
    pauses = counters.gc_unroll(tables.runtime_snapshots(spark, sf), EVENT_ORDER)
    return pauses.select("process_id", *EVENT_ORDER, "cycle", "weight")


@query
def blocked_estimate(spark, sf):
    return counters.blocked_estimate(tables.runtime_snapshots(spark, sf)).select("process_id", *EVENT_ORDER, "weight")


@query
def downsample(spark, sf):
    trace = tables.trace_events(spark, sf).withColumn("at", F.col("ts").cast("long"))
    return trace_columns(events.downsample(trace, 7, ["at", "event_id"]))


@query
def rate_limit(spark, sf):
    """Hours taken as seconds, so that the slowest rate has something to drop."""
    readings = tables.events(spark, sf).select(
        F.col("event_type").alias("process_id"), F.floor(F.col("us") / 3600).cast("long").alias("us"), "event_id"
    )
    return events.rate_limit(readings, "heap", 1, order=EVENT_ORDER)


def fast_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks on a clock a thousand times as fast."""
    return stored(tables.snapshot_chunks(spark, sf), "chunks").withColumn("us", F.floor(F.col("us") / 1000).cast("long"))


@query
def retain_ring(spark, sf):
    return retention.retain_ring(fast_chunks(spark, sf), 900_000_000)


@query
def retain_list(spark, sf):
    return retention.retain_list(stored(tables.snapshot_chunks(spark, sf), "chunks"), 1_800_000_000)


@query
def timeline_seek(spark, sf):
    retained = stored(retention.retain_ring(fast_chunks(spark, sf), 900_000_000), "retained")
    at = retention.timeline_seek(retained, 17, capacity=100).withColumn("what", F.lit("index 17"))
    last = retention.timeline_seek(retained).withColumn("what", F.lit("last"))
    return at.unionByName(last)


@query
def seek_time(spark, sf):
    """The newest chunk at some moments."""
    retained = stored(tables.snapshot_chunks(spark, sf), "chunks")
    moments = {day: int(datetime(2024, 1, day, tzinfo=timezone.utc).timestamp()) * 1_000_000 for day in (1, 9, 20, 31)}
    found = [retention.seek_time(retained, us).withColumn("day", F.lit(day).cast("long")) for day, us in moments.items()]
    return reduce(DataFrame.unionByName, found)


@query
def alert_dedup_lru(spark, sf):
    return alerts.alert_dedup_lru(tables.firings(spark, sf).drop("msg"), EVENT_ORDER)


@query
def alert_hold(spark, sf):
    outcomes = alerts.rule_eval(with_last_error(tables.hourly_metrics(spark, sf)), RULES)
    return alerts.alert_hold(outcomes, 2 * HOUR_US)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULE_TABLE, "name string, predicate string, for_ms bigint, sinks array<string>")


@query
def rules_hold(spark, sf):
    """Rules from a table, each with its own hold time."""
    compiled = rules.read_rules(rule_table(spark))
    outcomes = alerts.rule_eval(tables.hourly_metrics(spark, sf), compiled)
    return alerts.alert_hold(outcomes, alerts.hold_of(compiled))


@query
def alert_route(spark, sf):
    return alerts.alert_route(rules_hold(spark, sf), rule_table(spark)).select("rule", "us", "sink")


@query
def subscriber_gauge(spark, sf):
    change = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", -1)
    changes = tables.events(spark, sf).select(F.col("user_id").alias("gateway"), *EVENT_ORDER, change.cast("long").alias("change"))
    return counters.subscriber_gauge(changes.filter("change IS NOT NULL"), order=EVENT_ORDER)


@query
def minimap_series(spark, sf):
    kind = F.create_map(*[F.lit(x) for x in ("purchase", "heap", "error", "blocked", "view", "gc")])
    metrics = tables.events(spark, sf).select(
        *EVENT_ORDER, F.try_element_at(kind, F.col("event_type")).alias("metric"), tables.cents("value").alias("value")
    )
    series = counters.minimap_series(metrics.filter("metric IS NOT NULL"), DAY_US, EVENT_ORDER)
    return series.select("us", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("heap", "blocked", "gc")]).orderBy("us")


@query
def heartbeat_lag(spark, sf):
    return counters.heartbeat_lag(tables.heartbeats(spark, sf))


# ---- order and limit


def merged_tree(spark: SparkSession, sf: str) -> DataFrame:
    """One tree over all years."""
    return flame.flame_build(tables.stack_samples(spark, sf), keys=[])


def placed(ordered: DataFrame) -> DataFrame:
    """Rows of a sorted table with their place in it, from the sizes of its sorted parts; no part is put in one task."""
    path = fresh_dir(ordered.sparkSession, "ordered")
    at = F.monotonically_increasing_id()
    ordered.select("*", F.shiftright(at, 33).alias("_part"), (at % (1 << 33)).alias("_row")).write.parquet(path)
    stored = ordered.sparkSession.read.parquet(path)
    sizes = stored.groupBy("_part").count()
    along = Window.partitionBy().orderBy("_part")
    before = sizes.select("_part", (F.sum("count").over(along) - F.col("count")).alias("_before"))  # a row per part
    return stored.join(before, "_part").withColumn("position", F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


@query
def flatten_order(spark, sf):
    flat = flame.flame_flatten(merged_tree(spark, sf), keys=[]).orderBy(flame.flatten_order())
    return placed(flat.select(joined(), F.col("depth").cast("long").alias("depth"), "cumulative"))


@query
def child_order(spark, sf):
    return placed(merged_tree(spark, sf).orderBy(flame.child_order()).select(joined(), "value"))


def ranked(top: DataFrame, order: list[Column]) -> DataFrame:
    """Rank of the rows that a limit has left."""
    return top.select(
        F.row_number().over(Window.partitionBy().orderBy(*order)).cast("long").alias("rank"), joined(), "cumulative"
    )


@query
def top_k(spark, sf):
    flat = flame.flame_flatten(merged_tree(spark, sf), keys=[])
    return ranked(flame.top_k(flat, 10), [flame.flatten_order()])


@query
def top_k_hottest(spark, sf):
    flat = flame.flame_flatten(merged_tree(spark, sf), keys=[])
    return ranked(flame.top_k(flat, 10, "hottest"), [F.col("cumulative").desc(), flame.flatten_order()])


@query
def chronological(spark, sf):
    return placed(retention.chronological(retention.retain_ring(fast_chunks(spark, sf), 900_000_000)))


# ---- functions of spans and alerts


@query
def span_annotations(spark, sf):
    return tables.annotations(spark, sf).select("event_id", "gid", span_functions.span_label(F.col("ann")).alias("label"))


@query
def alert_payload(spark, sf):
    seconds = F.floor(F.col("us") / 1_000_000).cast("long")
    return tables.firings(spark, sf).select(
        "event_id",
        payloads.webhook_payload(F.col("rule"), F.col("msg"), seconds).alias("webhook"),
        payloads.chat_payload(F.col("rule"), "watcher", ":fire:").alias("chat"),
        payloads.issue_payload(F.col("rule"), F.col("rule"), "OPS").alias("issue"),
    )


@query
def metric_lookup(spark, sf):
    """Metrics as a map, unknown names read as 0."""
    kinds = ["click", "error", "view"]
    as_map = tables.hourly_metrics(spark, sf).select("us", F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))]).alias("m"))
    m = F.col("m")
    return as_map.select(
        "us",
        (rules.metric(m, "click") + rules.metric(m, "missing")).cast("long").alias("sum_known"),
        (rules.safe_div(rules.metric(m, "click"), rules.metric(m, "missing"))).cast("long").alias("by_missing"),
    )


# ---- streaming


def line_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a stream of samples."""
    t = lambda name: tables.table(spark, sf, name)
    schema = t("lineitem").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    customers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(customers, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_returnflag").alias("process_id"),
        F.array("c_mktsegment", "o_orderpriority").alias("stack"),
        F.col("l_quantity").cast("long").alias("weight"),
    )


def window_rows(trees: DataFrame) -> DataFrame:
    """What a stream of trees per window has written."""
    spark, out = trees.sparkSession, fresh_dir(trees.sparkSession, "windows")
    sinks.run_available(trees, sinks.table_sink(out), fresh_dir(spark, "checkpoint"))
    edges = [F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us")]
    return spark.read.parquet(out).select(*edges, "process_id", joined(), "name", "value")


@query
def flame_window(spark, sf):
    return window_rows(windows.flame_window(line_samples(spark, sf), "7 days", "1 day")).drop("end_us")


@query
def flame_sliding(spark, sf):
    return window_rows(windows.flame_window(line_samples(spark, sf), "14 days", "1 day", slide="7 days"))


@query
def flame_session(spark, sf):
    return window_rows(windows.flame_session(line_samples(spark, sf), "36 hours", "1 day"))


@query
def stream_counters(spark, sf):
    readings = event_stream(spark, sf).select(
        F.col("user_id").alias("process_id"),
        *EVENT_ORDER,
        tables.cents("value").alias("heap_alloc"),
        F.floor(F.col("event_id") / 50).cast("long").alias("num_gc"),
    ).withColumn("pause_ns", tables.pause_slots("process_id"))
    out = fresh_dir(spark, "steps")
    count = state.stream_counters(fresh_dir(spark, "last-readings"), sinks.table_sink(out), EVENT_ORDER, packed=True)
    sinks.run_available(readings, count, fresh_dir(spark, "checkpoint"))
    # a path is made once per reading, not per sample
    path = lambda name: F.array_join(F.array(F.lit(name)), ";").alias("path")
    return counters.samples_of(spark.read.parquet(out), EVENT_ORDER, path).select("process_id", *EVENT_ORDER, "path", "weight")


@query
def span_state(spark, sf):
    annotated = event_stream(spark, sf).filter("event_type = 'signup'").select(
        F.col("user_id").alias("gid"),
        *EVENT_ORDER,
        F.concat(F.lit("trace_id="), F.md5(F.col("event_id").cast("string"))).alias("ann"),
    )
    kept, last = fresh_dir(spark, "spans"), []
    newest = state.span_state(kept, lambda batch, batch_id: last.append(batch_id), ttl_us=365 * DAY_US)
    sinks.run_available(annotated, newest, fresh_dir(spark, "checkpoint"))
    return state.remembered(spark, kept, last[-1]).select("gid", "us", "label")


@query
def stream_alerts(spark, sf):
    metrics = event_stream(spark, sf).select(F.col("user_id").alias("process_id"), *EVENT_ORDER, "value")
    out = fresh_dir(spark, "alerts")
    fire = state.stream_alerts(fresh_dir(spark, "open-runs"), sinks.table_sink(out), STREAM_RULES, order=EVENT_ORDER)
    sinks.run_available(metrics, fire, fresh_dir(spark, "checkpoint"))
    return spark.read.parquet(out).select("rule", "process_id", *EVENT_ORDER, "since_us")


@query
def stream_dedup_lru(spark, sf):
    firings = event_stream(spark, sf).select(
        F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("rule"), *EVENT_ORDER
    )
    out = fresh_dir(spark, "notified")
    notify = state.stream_dedup_lru(fresh_dir(spark, "last-rules"), sinks.table_sink(out), EVENT_ORDER)
    sinks.run_available(firings, notify, fresh_dir(spark, "checkpoint"))
    return spark.read.parquet(out).select("rule", *EVENT_ORDER)


@query
def stream_trace_attach(spark, sf):
    """Frames and annotations as two streams of four micro-batches. The last days are left out: their watermark has not come."""
    found = event_stream(spark, sf).filter("event_type <> 'signup'")
    name = F.concat(F.lit("goroutine-"), F.col("user_id").cast("string"))
    live = found.select(
        F.col("event_id").alias("frame_id"), "us", F.col("event_id").cast("string").alias("snapshot_id"), F.array(name).alias("path"),
        name.alias("name"), tables.cents("value").alias("value"),
    )
    annotated = event_stream(spark, sf).filter("event_type = 'signup'").select(F.col("user_id").alias("gid"), *EVENT_ORDER, tables.annotation("event_id"))
    out = fresh_dir(spark, "children")
    children = joins.stream_trace_attach(live, annotated, "1 day", ttl_us=DAY_US)
    sinks.run_available(children, sinks.table_sink(out), fresh_dir(spark, "checkpoint"))
    last = tables.events(spark, sf).select(F.max("us")).scalar()
    return shown(spark.read.parquet(out).filter(F.col("us") < last - 3 * DAY_US))


@query
def stream_notify_within(spark, sf):
    """One notification per rule and day."""
    firings = event_stream(spark, sf).select(
        F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("rule"),
        F.floor(F.col("us") / DAY_US).cast("long").alias("day"),
        F.timestamp_micros("us").alias("ts"),
    )
    out = fresh_dir(spark, "notified")
    sinks.run_available(joins.stream_notify_within(firings, ["rule", "day"], "1 day"), sinks.table_sink(out), fresh_dir(spark, "checkpoint"))
    return spark.read.parquet(out).select("rule", "day")


@query
def late_rows(spark, sf):
    """Every tenth event comes with the last of four micro-batches: how many are read, too late, and kept."""
    found = tables.table(spark, sf, "events")
    path = fresh_dir(spark, "events")
    day = lambda d: F.lit(f"2024-01-{d:02}").cast("timestamp_ntz")
    batch = F.when(F.col("event_id") % 10 == 0, 3).otherwise(sum((F.when(F.col("ts") >= day(d), 1).otherwise(0) for d in (9, 16, 23)), F.lit(0)))
    for n in range(4):
        found.filter(batch == n).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(path)
    once = joins.stream_notify_within(stream.select("event_id", F.timestamp_micros(tables.micros("ts")).alias("ts")), ["event_id"], "2 days")
    out = fresh_dir(spark, "once")
    start = lambda: sinks.start_available(once, sinks.table_sink(out), fresh_dir(spark, "checkpoint"))
    read, late, _ = joins.run_counted(spark, start)
    kept = spark.read.parquet(out).agg(F.count(F.lit(1)).alias("rows_kept"))
    return kept.select(F.lit(read).cast("long").alias("rows_read"), F.lit(late).cast("long").alias("rows_late"), "rows_kept")


@query
def sampler_to_exporter(spark, sf):
    """The events through the sampling source, in four runs that go on where the last one ended, and out by the exporter."""
    streams.register_streams(spark)
    rows = tables.table(spark, sf, "events").count()
    out, checkpoint = fresh_dir(spark, "export"), fresh_dir(spark, "checkpoint")
    for run in range(1, 5):
        sampled = spark.readStream.format(streams.SAMPLER).option("path", f"{sf}/events.parquet").option("until", rows * run // 4).option("rows", 20_000).load()
        written = sampled.writeStream.format(streams.EXPORTER).option("path", out).option("checkpointLocation", checkpoint)
        written.trigger(availableNow=True).start().awaitTermination()
    exported = streams.read_export(spark, out, tables.table(spark, sf, "events").schema)
    return exported.select("event_id", tables.micros("ts").alias("us"), "user_id", "event_type", F.col("props").alias("payload"))


@query
def stream_sinks(spark, sf):
    out = fresh_dir(spark, "sent")
    firings = event_stream(spark, sf)
    payload = payloads.webhook_payload(F.col("event_type"), F.col("props"), F.floor(F.col("us") / 1_000_000).cast("long"))
    send = lambda messages: messages.write.mode("append").parquet(out)
    sinks.run_available(firings, sinks.alert_sink(payload, send), fresh_dir(spark, "checkpoint"))
    return spark.read.parquet(out).select("payload")


@query
def stream_retention(spark, sf):
    out = fresh_dir(spark, "history")
    chunks = chunk_stream(spark, sf).withColumn("day", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd"))
    (
        chunks.writeStream.partitionBy("day")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", fresh_dir(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return sinks.retained_partitions(spark, out, "2024-01-16").select("event_id", "us", "payload")
