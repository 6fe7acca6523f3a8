"""Operators on trace events: ``ts`` is nanoseconds since the start of the trace."""

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.scalars import clamp
from emberframe.operators.ordered import ordinal, with_position

# Lowest and highest rate per kind of reading; what a rate below the lowest becomes.
RATE_LIMITS = {
    "goroutine": {"low": 10, "high": 200, "below": 10},
    "gc": {"low": 1, "high": 1000, "below": 10},
    "heap": {"low": 1, "high": 4, "below": 1},
    "blocked": {"low": 5, "high": 500, "below": 5},
}


def _epoch_ns(t: datetime) -> int:
    if t.tzinfo is None:
        t = t.replace(tzinfo=timezone.utc)
    whole = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return ((whole.days * 86_400 + whole.seconds) * 1_000_000 + whole.microseconds) * 1000


def by_time_range(events: DataFrame, base: datetime | Column, start: datetime | None, end: datetime | None) -> DataFrame:
    """Events with start <= base + ts < end; a bound left out is open. ``base`` is a time, or a Column in
    nanoseconds since 1970. The stored ``ts`` itself is compared, so that the filter can reach the scan."""
    origin = base if isinstance(base, Column) else F.lit(_epoch_ns(base))
    if start is not None:
        events = events.filter(F.col("ts") >= F.lit(_epoch_ns(start)) - origin)
    if end is not None:
        events = events.filter(F.col("ts") < F.lit(_epoch_ns(end)) - origin)
    return events


def by_goroutine(events: DataFrame, gid: int) -> DataFrame:
    return events if gid == 0 else events.filter(F.col("g") == F.lit(gid).cast("decimal(20,0)"))


def by_event_types(events: DataFrame, types: list[int]) -> DataFrame:
    return events.filter(F.col("type").isin(types)) if types else events


def sum_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.sum("val").alias("total"))


def downsample(events: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Every n-th row, the first included, along a total order."""
    if n <= 1:
        return events
    numbered = with_position(events, order, "_position")
    return numbered.filter((F.col("_position") - 1) % n == 0).drop("_position")


def effective_rate(kind: str, hz: int) -> int:
    limit = RATE_LIMITS[kind]
    return limit["below"] if hz < limit["low"] else clamp(hz, limit["low"], limit["high"])


def rate_limit(readings: DataFrame, kind: str, hz: int, keys: list[str] = ["process_id"], order: list[str] = ["us"]) -> DataFrame:
    """First reading of each process in each period of the clamped rate.

    Combined before the shuffle: only one candidate per period and map task travels.
    """
    period_us = 1_000_000 // effective_rate(kind, hz)
    return (
        readings.groupBy(*keys, F.floor(F.col(order[0]) / period_us).alias("_period"))
        .agg(*[F.min_by(c, ordinal(order)).alias(c) for c in readings.columns if c not in keys])
        .select(*readings.columns)
    )
