"""Alert rules as Spark SQL predicates over metric columns.

A rule text may use ``safe_div(a, b)``, 0 where ``b`` is 0; ``truth(x)``, true where a number is not 0, so that numbers
can stand in AND, OR and NOT; and ``num(b)``, 1 or 0, so that comparisons can be added up. A rule that is a number as a
whole is true where it is not 0.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a predicate that are no metrics.
WORDS = {"and", "or", "not", "true", "false", "null", "is", "in", "between", "case", "when", "then", "else", "end", "like"}


@dataclass(frozen=True)
class Rule:
    """A predicate, how long it must hold before it fires, and where its firings go."""

    name: str
    predicate: str
    hold_us: int = 0
    sinks: tuple[str, ...] = ()


def read_rules(rules: DataFrame) -> list[Rule]:
    """Rules from a table ``name, predicate, for_ms, sinks``. They become parts of the plan, so they come to the driver."""
    rows = rules.select("name", "predicate", "for_ms", "sinks").collect()
    return [Rule(r.name, r.predicate, (r.for_ms or 0) * 1000, tuple(r.sinks or ())) for r in rows]


def safe_div(a: Column, b: Column) -> Column:
    """Quotient, 0 where the divisor is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def register_rule_functions(spark: SparkSession) -> None:
    """Make ``safe_div``, ``truth`` and ``num`` known to rule texts."""
    for head, body in (
        ("safe_div(a DOUBLE, b DOUBLE) RETURNS DOUBLE", "coalesce(try_divide(a, b), 0D)"),
        ("truth(x DOUBLE) RETURNS BOOLEAN", "coalesce(x, 0D) != 0D"),
        ("num(b BOOLEAN) RETURNS DOUBLE", "IF(b, 1D, 0D)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def metric(metrics: Column, name: str) -> Column:
    """Metric of a MAP column, 0 where it is missing."""
    return F.coalesce(F.try_element_at(metrics, F.lit(name)), F.lit(0.0))


def metric_names(predicate: str) -> set[str]:
    """Names that a predicate reads, in lower case. A metric is a plain identifier; ``a.b`` is none and is refused."""
    bare = re.sub(r"'(?:[^'\\]|\\.)*'", "''", predicate)
    if dotted := re.search(r"[A-Za-z_]\w*\s*\.\s*\w+", bare):
        raise ValueError(f"not a metric: {dotted[0]!r} in {predicate!r}")
    names = re.findall(r"(?<![\w.])([A-Za-z_]\w*)(?!\w|\s*\()", bare)
    return {n.lower() for n in names} - WORDS


def with_missing_metrics(metrics: DataFrame, predicates: list[str]) -> DataFrame:
    """Metrics that the predicates name: nulls of any numeric type are 0, columns that the table lacks are 0.0."""
    named = set().union(*map(metric_names, predicates))
    is_metric = lambda f: f.name.lower() in named and isinstance(f.dataType, T.NumericType)
    have = {f.name.lower() for f in metrics.schema.fields}
    return metrics.select(
        *[F.coalesce(f.name, F.lit(0).cast(f.dataType)).alias(f.name) if is_metric(f) else F.col(f.name) for f in metrics.schema.fields],
        *[F.lit(0.0).alias(n) for n in sorted(named - have)],
    )


def truth(df: DataFrame, predicate: str) -> Column:
    """The predicate as BOOLEAN: a number is true where it is not 0."""
    expression = F.expr(predicate)
    is_boolean = isinstance(df.select(expression).schema.fields[0].dataType, T.BooleanType)
    return expression if is_boolean else expression != 0


def compare(value: Column, op: str, number: int) -> Column:
    """One of the six comparisons of a metric with an integer; a missing metric is 0."""
    value = F.coalesce(value, F.lit(0))
    comparisons = {
        ">": value > number,
        ">=": value >= number,
        "<": value < number,
        "<=": value <= number,
        "==": value == number,
        "!=": value != number,
    }
    if op not in comparisons:
        raise ValueError(f"unknown comparison {op!r}")
    return comparisons[op]
