"""Small column functions: times, units, tags, clamps."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_wall_time(base_us: Column | int, ts_ns: Column) -> Column:
    """Wall time of an event ``ts_ns`` nanoseconds after the base, as TIMESTAMP (whole microseconds)."""
    base = base_us if isinstance(base_us, Column) else F.lit(base_us)
    return F.timestamp_micros((base + F.floor(ts_ns / 1000)).cast("long"))


def ns_to_ms(ns: Column) -> Column:
    """Milliseconds with two decimals."""
    return F.round(ns / 1_000_000, 2)


def file_timestamp(us: Column) -> Column:
    """``yyyyMMddTHHmmss.SSS`` in UTC, whatever the session's zone."""
    day = F.date_format(F.date_from_unix_date(F.floor(us / 86_400_000_000).cast("int")), "yyyyMMdd")
    ms = F.floor(F.pmod(us, F.lit(86_400_000_000)) / 1000)
    two = lambda n: F.lpad(n.cast("long").cast("string"), 2, "0")
    clock = [two(ms / 3_600_000), two(ms / 60_000 % 60), two(ms / 1000 % 60)]
    return F.concat(day, F.lit("T"), *clock, F.lit("."), F.lpad((ms % 1000).cast("long").cast("string"), 3, "0"))


def tags_to_map(tags: Column) -> Column:
    """``k=v`` tags to a map; the last of equal keys wins, a tag without ``=`` gets an empty value."""
    keys = F.transform(tags, lambda t: F.substring_index(t, "=", 1))
    return F.map_from_entries(
        F.transform(
            F.filter(tags, lambda t, i: F.array_position(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), F.substring_index(t, "=", 1)) == 0),
            lambda t: F.struct(
                F.substring_index(t, "=", 1).alias("key"),
                F.when(F.contains(t, F.lit("=")), F.substring(t, F.instr(t, "=") + 1, F.length(t))).otherwise(F.lit("")).alias("value"),
            ),
        )
    )


def clamp(value: Column | int, low: int, high: int):
    if isinstance(value, Column):
        return F.greatest(F.least(value, F.lit(high)), F.lit(low))
    return max(min(value, high), low)
