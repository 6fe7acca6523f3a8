"""Canonical tables derived from the star-schema and event tables of a data folder."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators.ordered import ordered_columns, with_position


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # the stored times carry no zone and mean UTC
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", micros("ts"))


def stack_samples(spark: SparkSession, sf_dir: str, first_day: str | None = None, end_day: str | None = None) -> DataFrame:
    """One sample per line item: region, nation, segment, priority; weight is the quantity."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders")
    if first_day:
        orders = orders.filter(F.col("o_orderdate") >= F.lit(first_day).cast("timestamp_ntz"))
    if end_day:
        orders = orders.filter(F.col("o_orderdate") < F.lit(end_day).cast("timestamp_ntz"))
    return (
        t("lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.year("o_orderdate").cast("string").alias("snapshot_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.array("r_name", "n_name", "c_mktsegment", "o_orderpriority").alias("stack"),
            F.col("l_quantity").cast("long").alias("weight"),
        )
    )


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trace records: ns since the first one, the user as goroutine."""
    ev = events(spark, sf_dir)
    start = ev.select(F.min("us")).scalar()
    kind = F.create_map(
        *[F.lit(x) for pair in {"click": 1, "signup": 2, "view": 3, "error": 4, "purchase": 1000}.items() for x in pair]
    )
    return ev.select(
        "event_id",
        ((F.col("us") - start) * 1000).cast("decimal(20,0)").alias("ts"),
        F.col("user_id").cast("decimal(20,0)").alias("g"),
        F.lit(-1).alias("p"),
        F.try_element_at(kind, F.col("event_type")).alias("type"),
        cents("value").alias("val"),
    )


def heap_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("user_id").alias("process_id"), "us", "event_id", cents("value").alias("heap_alloc")
    )


def pause_slots(process: str) -> Column:
    """256 pause slots, (7 process + 13 slot) mod 11 microseconds; some are 0.

    The slots repeat after 11, so each ring is a piece of one constant array: 13 * 9 is 7 modulo 11.
    """
    # literals, which Spark folds; an array of expressions over a sequence would be made for each row
    pattern = F.array(*[F.lit(i * 13 % 11 * 1000).cast("long") for i in range(256 + 10)])
    return F.slice(pattern, (F.col(process) * 9 % 11 + 1).cast("int"), F.lit(256))


def runtime_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtime counters per process: heap, goroutines, the share of them profiled, collections so far."""
    readings = heap_readings(spark, sf_dir)
    return ordered_columns(
        readings,
        ["process_id"],
        ["us", "event_id"],
        previous={"profiled": F.col("heap_alloc")},
        running={"num_gc": F.col("event_id") % 3},
    ).withColumn("goroutines", F.col("heap_alloc")).withColumn("pause_ns", pause_slots("process_id"))


def annotation(event_id: str) -> Column:
    """``ann`` of an event, every second one with a span id."""
    digest = F.md5(F.col(event_id).cast("string"))
    span = F.when(F.col(event_id) % 2 == 0, F.concat(F.lit(","), F.substring(digest, 1, 16))).otherwise(F.lit(""))
    return F.concat(F.lit("trace_id="), digest, span).alias("ann")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as span annotations of a goroutine."""
    signups = events(spark, sf_dir).filter(F.col("event_type") == "signup")
    return signups.select(F.col("user_id").alias("gid"), "us", "event_id", annotation("event_id"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions, each ten program counters wide."""
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") * 10).alias("start_pc"),
        (F.col("p_partkey") * 10 + 10).alias("end_pc"),
        F.concat(F.lit("a/b/"), "p_brand", F.lit("."), "p_type").alias("func"),
    )


def pc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stack of program counters per order, leaf first."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("sample_id"))
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
                lambda x: x["l_partkey"] * 10 + x["l_linenumber"],
            ).alias("pcs")
        )
    )


def hourly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per hour, one column per event type."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    return (
        events(spark, sf_dir)
        .groupBy(F.floor(F.col("us") / 3_600_000_000).cast("long").alias("hour"))
        .agg(*[F.count(F.when(F.col("event_type") == k, 1)).cast("double").alias(k) for k in kinds])
        .withColumn("us", F.col("hour") * 3_600_000_000)
    )


def firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as the firing of one rule per event type and user."""
    return events(spark, sf_dir).select(
        F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("rule"), "us", "event_id", F.col("props").alias("msg")
    )


def snapshot_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as written chunks, numbered 1, 2, 3, ... in order of arrival."""
    numbered = with_position(events(spark, sf_dir).select("us", "event_id", "props"), ["us", "event_id"], "seq")
    return numbered.select("seq", "us", F.col("props").alias("payload"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as agents."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.lower("c_name").alias("hostname"),
        (F.col("c_custkey") % 32768).cast("int").alias("pid"),
        F.concat(F.lit("v1."), (F.col("c_custkey") % 5).cast("string")).alias("version"),
        F.array(
            F.concat(F.lit("segment="), "c_mktsegment"), F.concat(F.lit("nation="), F.col("c_nationkey").cast("string"))
        ).alias("tags"),
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as heartbeats: sent when stamped, received ``value`` milliseconds later."""
    return events(spark, sf_dir).select(
        F.col("user_id").alias("id"),
        F.floor(F.col("us") / 1000).cast("long").alias("ts_unix_ms"),
        "event_id",
        (F.col("event_id") % 100).alias("goroutines"),
        cents("value").alias("heap_bytes"),
        (F.floor(F.col("us") / 1000) + F.round("value")).cast("long").alias("received_unix_ms"),
    )
