"""Column functions for span annotations and goroutine names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Annotation key, length of the ids in hex digits, life of a mapping.
TRACE_KEY = "trace_id="
TRACE_DIGITS = 32
SPAN_DIGITS = 16
TTL_US = 120_000_000


def goroutine_id(name: Column) -> Column:
    """Unsigned 64-bit id after the last dash of a frame name, or null."""
    number = F.regexp_extract(name, r"-([0-9]+)\z", 1).try_cast("decimal(38,0)")
    return F.when(number < F.lit("18446744073709551616").cast("decimal(38,0)"), number.cast("decimal(20,0)"))


def trace_id(ann: Column) -> Column:
    """The 32 hex digits after the first ``trace_id=``, in lower case; null if there are none."""
    rest = _after_key(ann)
    return F.when(F.contains(ann, F.lit(TRACE_KEY)) & rest.rlike(f"^[0-9a-fA-F]{{{TRACE_DIGITS}}}"), F.lower(F.substring(rest, 1, TRACE_DIGITS)))


def span_id(ann: Column) -> Column:
    """The 16 hex digits after the first comma behind the trace id; zeros from the first bad pair on."""
    rest = _after_key(ann)
    tail = F.substring(rest, F.instr(rest, ",") + 1, F.length(rest))
    good = F.regexp_extract(F.substring(tail, 1, SPAN_DIGITS), "^((?:[0-9a-fA-F]{2})*)", 1)
    return F.rpad(
        F.when((F.instr(rest, ",") > 0) & (F.length(tail) >= SPAN_DIGITS), F.lower(good)).otherwise(F.lit("")),
        SPAN_DIGITS,
        "0",
    )


def _after_key(ann: Column) -> Column:
    return F.substring(ann, F.instr(ann, TRACE_KEY) + len(TRACE_KEY), F.length(ann))


def span_label(ann: Column) -> Column:
    """``trace:span``, null if the annotation carries no valid trace."""
    return F.concat(trace_id(ann), F.lit(":"), span_id(ann))
