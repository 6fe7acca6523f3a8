"""Previous row, running sum and last known value along an order, safe for hot groups.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Where a key holds more than ``max_rows`` rows, the rows are
instead dealt out by ranges of key and order, so that a range ends wherever it is full. What a key had in the ranges before comes
as one *carry row* in front of its rows. Spark finds the ranges from a sample of the rows, whatever the keys' sizes are.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.workspace import stored

MAX_ROWS = 2_000_000

PART, ROW = "_part", "_row"


def ordinal(order: list[str]) -> Column:
    """One DECIMAL(38,0) that sorts as one or two BIGINT columns do, for ``max_by`` and ``min_by``: their buffers then are
    numbers and the aggregation hashes, where a struct makes it sort its input."""
    if len(order) == 1:
        return F.col(order[0]).cast("decimal(38,0)")
    if len(order) > 2:
        return F.struct(*order)
    first, second = (F.col(c).cast("decimal(19,0)") for c in order)
    # the second column, moved to 0 and above, fills nineteen digits less than the step of the first
    return (first * F.lit("1" + "0" * 19).cast("decimal(20,0)")).cast("decimal(38,0)") + second


def has_hot_group(df: DataFrame, keys: list[str], max_rows: int = MAX_ROWS) -> bool:
    """Whether some key holds more than ``max_rows`` rows. Reads the keys only, counts are combined before the
    shuffle, one row comes to the driver."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).first()[0] if keys else counts.first()[0]
    return (largest or 0) > max_rows


def in_ranges(df: DataFrame, order: list[str], max_rows: int | None = None) -> DataFrame:
    """The rows in ranges of ``order``, with the number of the range (``_part``) and the place in it (``_row``, from 0). The
    result is stored, so every use of it finds the same ranges. ``max_rows`` is about the most that a range may hold."""
    if max_rows is None:
        ranged = df.repartitionByRange(*order)
    else:
        # ranges come from a sample and may be some way above the average
        ranged = df.repartitionByRange(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.count() // max_rows + 1), *order)
    at = F.monotonically_increasing_id()  # number of the range, then place in it
    places = [F.shiftright(at, 33).alias(PART), at.bitwiseAND(F.lit((1 << 33) - 1)).alias(ROW)]
    return stored(ranged.sortWithinPartitions(*order).select("*", *places), "ranges")


def _tie(df: DataFrame) -> Column:
    """A last key for rows that an order leaves equal, so that both plans put them in one order."""
    return F.xxhash64(*[f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def ordered_columns(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    previous: dict[str, Column] | None = None,
    running: dict[str, Column] | None = None,
    last_known: dict[str, Column] | None = None,
    max_rows: int = MAX_ROWS,
    hot: bool | None = None,
) -> DataFrame:
    """Add, per row along ``order`` within ``keys``:

    ``previous``   value of the expression on the row before (null on the first),
    ``running``    sum of the expression up to and with this row,
    ``last_known`` newest non-null value of the expression up to and with this row.

    Rows that ``order`` leaves equal follow each other by a hash of all their columns. ``hot`` tells whether a key may exceed
    ``max_rows``; it is measured if left out.
    """
    previous, running, last_known = previous or {}, running or {}, last_known or {}
    columns = df.columns
    if hot is None:
        hot = has_hot_group(df, keys, max_rows)
    rows = df.withColumn("_tie", _tie(df))
    for kind, wanted in (("p", previous), ("r", running), ("l", last_known)):
        for name, expression in wanted.items():
            rows = rows.withColumn(f"_{kind}_{name}", expression)

    if not hot:
        window = Window.partitionBy(*keys).orderBy(*order, "_tie")
    else:
        ranged = in_ranges(rows, [*keys, *order, "_tie"], max_rows)
        rows = ranged.withColumn("_own", F.lit(True)).unionByName(_carry_rows(ranged, keys, previous, running, last_known), allowMissingColumns=True)
        window = Window.partitionBy(*keys, PART).orderBy("_own", ROW)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.select(
        "*",
        *[F.lag(f"_p_{n}").over(window).alias(n) for n in previous],
        *[F.sum(f"_r_{n}").over(so_far).alias(n) for n in running],
        *[F.last(f"_l_{n}", ignorenulls=True).over(so_far).alias(n) for n in last_known],
    )
    if hot:
        out = out.filter("_own")
    return out.select(*columns, *previous, *running, *last_known)


def _carry_rows(ranged, keys, previous, running, last_known) -> DataFrame:
    """For each key and range but the key's first, what the ranges before amount to."""
    summary = ranged.groupBy(*keys, PART).agg(
        *[F.max_by(f"_p_{n}", ROW).alias(f"_p_{n}") for n in previous],
        *[F.sum(f"_r_{n}").alias(f"_r_{n}") for n in running],
        *[F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), F.col(ROW))).alias(f"_l_{n}") for n in last_known],
    )
    # as many rows per key as it has ranges, not as it has rows
    by_key = Window.partitionBy(*keys).orderBy(PART)
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(
        *keys,
        PART,
        F.lit(False).alias("_own"),
        F.lag(PART).over(by_key).alias("_earlier"),
        *[F.lag(f"_p_{n}").over(by_key).alias(f"_p_{n}") for n in previous],
        *[F.coalesce(F.sum(f"_r_{n}").over(before), F.lit(0)).alias(f"_r_{n}") for n in running],
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_l_{n}") for n in last_known],
    ).filter("_earlier IS NOT NULL").drop("_earlier")


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Number the rows 1, 2, 3, ... along a total order over the whole table.

    The sizes of the ranges, a row for each, tell how far the places in them move on; no task holds more than its range.
    """
    kept = in_ranges(df, order)
    before, total = [], 0
    for part, n in sorted(map(tuple, kept.groupBy(PART).count().collect())):
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, f"{PART} long, _before long")
    placed = kept.join(F.broadcast(offsets), PART).withColumn(name, F.col("_before") + F.col(ROW) + 1)
    return placed.select(*df.columns, name)
