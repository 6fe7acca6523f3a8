"""Alert rules: evaluation, hold time, de-duplication."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions.rules import Rule, compare, read_rules, register_rule_functions, truth, with_missing_metrics
from emberframe.operators.ordered import MAX_ROWS, has_hot_group, ordered_columns, with_position
from emberframe.workspace import stored

# Fixed value: rules the de-duplicating sink remembers.
REMEMBERED_RULES = 128

# firings looked at together, and units of the tree of slices that have one parent
SLICE_ROWS = 50_000
FAN = 16

AT = "_at"


def threshold_filter(metrics: DataFrame, metric: str, op: str, number: int) -> DataFrame:
    """Rows on which ``metric op number`` holds; a metric the table lacks is 0."""
    value = F.col(metric) if metric in metrics.columns else F.lit(0)
    return metrics.filter(compare(value, op, number))


def _rules(rules: dict[str, str] | list[Rule] | DataFrame) -> list[Rule]:
    if isinstance(rules, DataFrame):
        return read_rules(rules)
    return [Rule(n, p) for n, p in rules.items()] if isinstance(rules, dict) else rules


def rule_eval(metrics: DataFrame, rules: dict[str, str] | list[Rule] | DataFrame, keep: list[str] = ["us"]) -> DataFrame:
    """Every rule on every row in one pass: columns ``keep``, ``rule``, ``holds``.

    ``rules``: predicates by name, or a table ``name, predicate, for_ms, sinks``. See ``functions.rules`` for predicates.
    """
    register_rule_functions(metrics.sparkSession)
    rules = _rules(rules)
    full = with_missing_metrics(metrics, [r.predicate for r in rules])
    outcomes = F.array(*[F.struct(F.lit(r.name).alias("rule"), truth(full, r.predicate).alias("holds")) for r in rules])
    return full.select(*keep, outcomes.alias("_outcomes")).select(*keep, F.inline("_outcomes"))


def hold_of(rules: list[Rule] | DataFrame) -> Column:
    """The hold time of the rule in column ``rule``, for ``alert_hold``."""
    rules = _rules(rules)
    return F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.hold_us)]), F.col("rule")).cast("long")


def alert_route(firings: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """Firings once per sink of their rule, with the sink's name in ``sink``; a rule without sinks goes nowhere."""
    known = [x for r in _rules(rules) for x in (F.lit(r.name), F.array(*map(F.lit, r.sinks)).cast("array<string>"))]
    sinks = F.try_element_at(F.create_map(*known), F.col("rule")) if known else F.array().cast("array<string>")
    return firings.select("*", F.explode(sinks).alias("sink"))


def hold_runs(outcomes: DataFrame, keys: list[str], order: list[str], extra: list[str] = [], max_rows: int = MAX_ROWS) -> DataFrame:
    """Outcomes with ``since_us``, the first time of the unbroken run of ``holds`` a row is in or of the last one before,
    and what the row before was: ``_held``, ``_at``."""
    t = order[0]
    hot = has_hot_group(outcomes, keys, max_rows)
    rows = outcomes.select(*keys, *order, "holds", *extra)
    before = {"_held": F.col("holds"), "_at": F.col(t)}
    stepped = ordered_columns(rows, keys, order, previous=before, max_rows=max_rows, hot=hot)
    begins = F.col("holds") & ~F.coalesce("_held", F.lit(False))
    return ordered_columns(stepped, keys, order, last_known={"since_us": F.when(begins, F.col(t))}, max_rows=max_rows, hot=hot)


def fires(hold: int | Column, time: str) -> Column:
    """On rows of ``hold_runs``: the run has lasted for ``hold`` at this row and had not at the one before."""
    begins = F.col("holds") & ~F.coalesce("_held", F.lit(False))
    already = F.coalesce(F.col("_held") & (F.col("_at") - F.col("since_us") >= hold), F.lit(False)) & ~begins
    return F.col("holds") & (F.col(time) - F.col("since_us") >= hold) & ~already


def alert_hold(
    outcomes: DataFrame, hold: int | Column, keys: list[str] = ["rule"], order: list[str] = ["us"], max_rows: int = MAX_ROWS
) -> DataFrame:
    """Fire once per unbroken run of ``holds``, at its first row at least ``hold`` microseconds after its first one.

    Our own definition. ``hold`` is one time for all or, by ``hold_of``, each rule's own. Columns: keys, order, ``since_us``.
    """
    runs = hold_runs(outcomes, keys, order, max_rows=max_rows)
    return runs.filter(fires(hold, order[0])).select(*keys, *order, "since_us")


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place how many places before it hold a smaller value; of equal values the first counts as smaller.

    Places are taken in order of value. From halves of the whole down to single places, a place of a right half counts the
    places of its left half that came before it."""
    out = np.zeros(len(values), np.int64)
    order = np.argsort(values, kind="stable")
    for bit in range(len(values).bit_length() - 1, -1, -1):
        block = order >> bit + 1
        left = order >> bit & 1 == 0
        seen = np.cumsum(left)
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        seen -= np.repeat(seen[first] - left[first], np.diff(np.append(first, len(order))))
        out[order[~left]] += seen[~left]
        order = order[np.argsort(order >> bit, kind="stable")]
    return out


def _distinct_since(rules: np.ndarray) -> np.ndarray:
    """For each firing the number of other rules fired since its rule fired last; -1 where it never did.

    The firings up to the last one of the same rule all follow their own last one before it, so of the firings so far
    whose last one lies before that place, those after it are the first firings there, one per rule."""
    if len(rules) == 0:
        return rules
    by_rule = np.argsort(rules, kind="stable")
    last = np.full(len(rules), -1, np.int64)
    again = rules[by_rule[1:]] == rules[by_rule[:-1]]
    last[by_rule[1:][again]] = by_rule[:-1][again]
    return np.where(last < 0, -1, _smaller_before(last) - last - 1)


def _newest(fired: DataFrame, unit: str, capacity: int) -> DataFrame:
    """The ``capacity`` rules of each unit that fired last, with the place of their last firing."""
    last = fired.groupBy(unit, "rule").agg(F.max(AT).alias(AT))
    rank = F.row_number().over(Window.partitionBy(unit).orderBy(F.col(AT).desc()))
    return last.withColumn("_rank", rank).filter(F.col("_rank") <= capacity).drop("_rank")


def _memories(rows: DataFrame, slices: int, capacity: int, known: DataFrame | None) -> DataFrame | None:
    """The rules remembered at the start of each slice: ``_slice, rule`` and the place of the last firing.

    What a slice leaves behind are its newest rules; what FAN slices leave are the newest of theirs, and so on up a tree. Down
    the tree, a unit starts from what its parent started with and what the units before it below that parent left."""
    if slices <= 1:
        return None if known is None else known.select(F.lit(0).cast("long").alias("_slice"), "rule", AT)
    sizes, left = [slices], [stored(_newest(rows.select("_slice", "rule", AT).withColumnRenamed("_slice", "_unit"), "_unit", capacity), "left-rules")]
    while sizes[-1] > FAN:
        up = left[-1].withColumn("_unit", F.floor(F.col("_unit") / FAN).cast("long"))
        left.append(_newest(up, "_unit", capacity))
        sizes.append(-(-sizes[-1] // FAN))
    start = None if known is None else known.select(F.lit(0).cast("long").alias("_unit"), "rule", AT)
    for size, leaves in zip(reversed(sizes), reversed(left)):
        unit, end = F.col("_unit"), F.lit(size - 1).cast("long")
        last_sibling = F.least((F.floor(unit / FAN).cast("long") + 1) * FAN - 1, end)
        reach = leaves.filter(unit < last_sibling).select("rule", AT, F.explode(F.sequence(unit + 1, last_sibling)).alias("_unit"))
        if start is not None:
            children = F.sequence(unit * FAN, F.least(unit * FAN + (FAN - 1), end))
            reach = reach.unionByName(start.select("rule", AT, F.explode(children).alias("_unit")))
        start = _newest(reach, "_unit", capacity)
    return start.withColumnRenamed("_unit", "_slice")


def dedup_numbered(rows: DataFrame, capacity: int = REMEMBERED_RULES, max_rows: int = SLICE_ROWS, known: DataFrame | None = None) -> DataFrame:
    """``alert_dedup_lru`` for firings that bear their place (from 1) in a column ``_at``; ``known`` (rule, _at of 0 and below)
    are the rules remembered at the start."""
    fired = rows.agg(F.max(AT)).first()[0] or 0
    sliced = rows.withColumn("_slice", F.floor((F.col(AT) - 1) / max_rows).cast("long"))
    memory = _memories(sliced, -(-fired // max_rows), capacity, known)
    both = sliced.withColumn("_memory", F.lit(False))
    if memory is not None:
        both = both.unionByName(memory.withColumn("_memory", F.lit(True)), allowMissingColumns=True)

    names = rows.columns

    def notify(group: pa.Table) -> pa.Table:
        group = group.sort_by(AT)
        rules = group.column("rule").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        since = _distinct_since(rules.astype(np.int64))
        new = (since < 0) | (since >= capacity)
        return group.filter(pa.array(new & ~group.column("_memory").to_numpy())).select(names)

    return both.groupBy("_slice").applyInArrow(notify, rows.schema)


def last_fired(rows: DataFrame, capacity: int = REMEMBERED_RULES, known: DataFrame | None = None) -> DataFrame:
    """The rules remembered after numbered firings, for ``known`` of the next ones."""
    fired = rows.select("rule", AT) if known is None else rows.select("rule", AT).unionByName(known.select("rule", AT))
    end = rows.agg(F.coalesce(F.max(AT), F.lit(0).cast("long"))).scalar()
    newest = fired.groupBy("rule").agg(F.max(AT).alias(AT)).orderBy(F.col(AT).desc()).limit(capacity)
    return newest.select("rule", (F.col(AT) - end).alias(AT))


def alert_dedup_lru(firings: DataFrame, order: list[str] = ["us"], capacity: int = REMEMBERED_RULES, max_rows: int = SLICE_ROWS) -> DataFrame:
    """Firings that notify: those whose rule is not among the last ``capacity`` distinct rules fired.

    That is, ``capacity`` other rules or more have fired since the rule did, which is counted for all firings of a slice at
    once. Slices hold ``max_rows`` firings each along ``order``, a total order, and need no more of the past than the
    ``capacity`` rules that fired last, so they run side by side. Each delivery is taken to succeed before the next firing.
    """
    return dedup_numbered(with_position(firings, order, AT), capacity, max_rows).drop(AT)
