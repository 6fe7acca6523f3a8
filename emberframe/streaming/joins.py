"""Joins and bounds in time on streams, by the state that the engine keeps behind a watermark."""

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from emberframe.functions.spans import TTL_US, goroutine_id, span_label
from emberframe.operators.ordered import ordinal
from emberframe.operators.spans import TRACE_CHILD


def stream_trace_attach(frames: DataFrame, annotations: DataFrame, delay: str = "10 seconds", ttl_us: int = TTL_US) -> DataFrame:
    """Children ``_trace`` for the frames of a stream, from a stream of annotations: for each frame named ``...-<id>`` the
    newest span of its goroutine at the frame's time, if it is no older than ``ttl_us``.

    An interval join of the two streams, then the newest span of each frame. Rows may come ``delay`` late, from either side; a
    frame's child is written once the watermark is past all spans it could have. Spans leave the state when the watermark is
    ``ttl_us`` past them, frames when it is past them, so the state holds the active goroutines and no more.

    ``frames`` has ``us`` and ``frame_id`` besides the frame columns; ``annotations`` has gid, us, event_id, ann. Columns:
    those of ``frames``.
    """
    stamp = lambda c: F.timestamp_micros(c)
    named = frames.withColumn("_gid", goroutine_id(F.col("name"))).filter("_gid IS NOT NULL")
    named = named.withColumn("_frame_ts", stamp("us")).withWatermark("_frame_ts", delay)
    spans = annotations.select(
        F.col("gid").cast("decimal(20,0)").alias("_span_gid"), F.col("us").alias("_span_us"), F.col("event_id").alias("_span_id"),
        span_label(F.col("ann")).alias("_label"), stamp("us").alias("_span_ts"),
    ).filter("_label IS NOT NULL").withWatermark("_span_ts", delay)
    within = f"_span_ts <= _frame_ts AND _span_ts >= _frame_ts - INTERVAL {ttl_us // 1_000_000} SECONDS - INTERVAL {ttl_us % 1_000_000} MICROSECONDS"
    joined = named.join(spans, F.expr(f"_gid = _span_gid AND {within}"))
    newest = joined.groupBy("_frame_ts", *frames.columns).agg(F.max_by("_label", ordinal(["_span_us", "_span_id"])).alias("_label"))
    own = {"path": F.array_append("path", TRACE_CHILD), "name": F.col("_label"), "value": F.lit(0).cast("long")}
    return newest.select(*[own.get(c, F.col(c)).alias(c) for c in frames.columns])


def stream_notify_within(firings: DataFrame, keys: list[str], within: str, time: str = "ts") -> DataFrame:
    """The first firing of each key; further ones are dropped if they come ``within`` that time of it. A key is forgotten at
    the end of the micro-batch in which the watermark, that much behind the newest firing, has passed it, and then notifies
    again."""
    return firings.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


class LateRows(StreamingQueryListener):
    """Counts, per query, the rows read and those that the watermark has shut out, from the queries' own progress.

    A row is late for an operator if it is not newer than the watermark at the start of its micro-batch. An aggregation counts
    what it is given, which is one row per key and task.
    """

    def __init__(self):
        self.read: dict[str, int] = {}
        self.late: dict[str, int] = {}
        self.state_rows: dict[str, list[int]] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _end(self, query_id: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(query_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        query = str(p.id)
        self.read[query] = self.read.get(query, 0) + max(0, p.numInputRows)
        self.late[query] = self.late.get(query, 0) + sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        self.state_rows.setdefault(query, []).append(sum(o.numRowsTotal for o in p.stateOperators))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.id)).set()

    def wait(self, query_id: str, seconds: float = 60) -> None:
        """Until the query's last progress has been counted."""
        if not self._end(query_id).wait(seconds):
            raise TimeoutError(f"no end of query {query_id} was reported")


def run_counted(spark: SparkSession, start) -> tuple[int, int, list[int]]:
    """Run a query that stops by itself, made by ``start()``: rows read, rows that came too late, rows of state per batch."""
    counts = LateRows()
    spark.streams.addListener(counts)
    try:
        query = start()
        query.awaitTermination()
        counts.wait(str(query.id))
    finally:
        spark.streams.removeListener(counts)
    query_id = str(query.id)
    return counts.read.get(query_id, 0), counts.late.get(query_id, 0), counts.state_rows.get(query_id, [])
