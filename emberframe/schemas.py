"""Canonical schemas. Unsigned 64-bit fields are DECIMAL(20,0); times inside tables are BIGINT
microseconds (``us``) or nanoseconds (``ts`` of trace events), so no column depends on a session zone."""

from pyspark.sql import types as T

U64 = T.DecimalType(20, 0)

STACK_SAMPLES = T.StructType([
    T.StructField("snapshot_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("stack", T.ArrayType(T.StringType())),
    T.StructField("weight", T.LongType()),
])

FLAME_FRAMES = T.StructType([
    T.StructField("snapshot_id", T.StringType()),
    T.StructField("root_name", T.StringType()),
    T.StructField("path", T.ArrayType(T.StringType())),
    T.StructField("name", T.StringType()),
    T.StructField("value", T.LongType()),
])

TRACE_EVENTS = T.StructType([
    T.StructField("ts", U64),
    T.StructField("g", U64),
    T.StructField("p", T.IntegerType()),
    T.StructField("type", T.IntegerType()),
    T.StructField("val", T.LongType()),
    T.StructField("stack", T.ArrayType(U64)),
])

# Numbers of the trace event types.
EVENT_TYPES = {
    "go_create": 1,
    "go_end": 2,
    "go_sched": 3,
    "go_blocked": 4,
    "gc_start": 5,
    "gc_end": 6,
    "heap_sample": 1000,
    "blocked_count": 1001,
}

SNAPSHOT_CHUNKS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("us", T.LongType()),
    T.StructField("payload", T.StringType()),
])
