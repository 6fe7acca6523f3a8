"""Bounded history. ``seq`` numbers the writes 1, 2, 3, ... without gaps; ``us`` is the time of the write."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.operators.ordered import ordered_columns

# Ring slots per second, list head room, default writes per second.
SLOTS_PER_SECOND = 10
LIST_HEADROOM = 100
DEFAULT_WRITES_PER_SECOND = 10
MIN_RETENTION_US = 1_000_000


def ring_capacity(retention_us: int) -> int:
    return retention_us * SLOTS_PER_SECOND // 1_000_000 + 1


def list_capacity(retention_us: int, writes_per_second: int) -> int:
    rate = writes_per_second if writes_per_second > 0 else DEFAULT_WRITES_PER_SECOND
    return retention_us * rate // 1_000_000 + LIST_HEADROOM + 1


def retain_ring(chunks: DataFrame, retention_us: int) -> DataFrame:
    """What a ring of fixed size holds after the last write: the newest ``S`` chunks, and once it has been
    filled none older than the retention. Two scalars decide; both filters reach the scan."""
    retention_us = max(retention_us, MIN_RETENTION_US)
    slots = ring_capacity(retention_us)
    newest = chunks.agg(F.max("seq").alias("n"), F.max_by("us", "seq").alias("us"))
    n, last_us = newest.select("n").scalar(), newest.select("us").scalar()
    return chunks.filter((F.col("seq") > n - slots) & ((n < slots) | (F.col("us") >= last_us - retention_us)))


def retain_list(
    chunks: DataFrame, retention_us: int, as_of_us: int | None = None, writes_per_second: int = DEFAULT_WRITES_PER_SECOND
) -> DataFrame:
    """What a trimmed list with a life renewed by each write holds: the newest ``maxLen + 1`` chunks since the
    last pause of at least the retention, nothing if the list has run out by ``as_of_us``."""
    retention_us = max(retention_us, MIN_RETENTION_US)
    capacity = list_capacity(retention_us, writes_per_second)
    newest = chunks.agg(F.max("seq").alias("n"), F.max("us").alias("us"))
    kept = chunks.filter(F.col("seq") > newest.select("n").scalar() - capacity)
    if as_of_us is not None:
        kept = kept.filter(F.lit(as_of_us) - newest.select("us").scalar() < retention_us)
    # the number after the last pause, from numbers and times alone; payloads stay where they are
    stepped = ordered_columns(kept.select("seq", "us"), [], ["seq"], previous={"_before": F.col("us")})
    start = stepped.filter(F.col("us") - F.col("_before") >= retention_us).agg(F.coalesce(F.max("seq"), F.lit(0))).scalar()
    return kept.filter(F.col("seq") >= start)


def timeline_seek(retained: DataFrame, index: int | None = None, capacity: int = 1000) -> DataFrame:
    """The ``index``-th (from 0) of the newest ``capacity`` snapshots, oldest first, or the last one.

    Index counting starts at the oldest of the history, which holds ``capacity`` snapshots at most.
    """
    bounds = retained.agg(F.max("seq").alias("hi"), F.min("seq").alias("lo"))
    hi, lo = bounds.select("hi").scalar(), bounds.select("lo").scalar()
    if index is None:
        return retained.filter(F.col("seq") == hi)
    first = F.greatest(lo, hi - (capacity - 1))
    return retained.filter((F.col("seq") == first + index) & (F.col("seq") <= hi))


def seek_time(retained: DataFrame, us: int) -> DataFrame:
    """Newest snapshot not after ``us``."""
    seen = retained.filter(F.col("us") <= us)
    return seen.filter(F.col("seq") == seen.agg(F.max("seq")).scalar())


def chronological(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy("seq")
