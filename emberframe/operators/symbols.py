"""Program counters to function names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.functions.stacks import normalise_stack
from emberframe.operators.ordered import MAX_ROWS, ordered_columns


def symbolise(samples: DataFrame, symbols: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Leaf-first ``pcs`` to root-first ``stack``; a counter stands for the function that holds pc - 1.

    An ordered lookup: the distinct counters, of which there are no more than code has addresses, and the functions'
    starts are put in one order, and each counter takes the function that started last. It has none where that function
    ends before it. However functions lie, a counter is compared with one of them.
    """
    frames = samples.select("sample_id", F.posexplode("pcs").alias("pos", "pc")).filter(F.col("pc") != 0)
    starts = symbols.select(F.col("start_pc").alias("at"), F.lit(0).cast("long").alias("is_pc"), F.col("end_pc").alias("tie"), "end_pc", "func")
    asked = frames.select("pc").distinct().select((F.col("pc") - 1).alias("at"), F.lit(1).cast("long").alias("is_pc"), F.col("pc").alias("tie"), "pc")
    both = starts.unionByName(asked, allowMissingColumns=True)
    newest = F.when(F.col("is_pc") == 0, F.struct(F.col("end_pc").alias("end"), F.col("func").alias("name")))
    order = ["at", "is_pc", "tie"]
    found = ordered_columns(both, [], order, last_known={"_last": newest}, max_rows=max_rows)
    known = found.filter((F.col("is_pc") == 1) & (F.col("at") < F.col("_last.end"))).select("pc", F.col("_last.name").alias("func"))
    # a hot counter is split by the adaptive skew join; a group is one stack, as long as the profiler's depth limit at most
    return (
        frames.join(known, "pc")
        .groupBy("sample_id")
        .agg(normalise_stack(F.transform(F.sort_array(F.collect_list(F.struct("pos", "func"))), lambda f: f["func"])).alias("stack"))
        .filter(F.size("stack") > 0)
    )


def trace_samples(events: DataFrame, symbols: DataFrame, keys: list[str], weight: str = "val", max_rows: int = MAX_ROWS) -> DataFrame:
    """Samples ``keys, stack, weight`` for ``flame_build`` from trace events that carry the addresses of their stack. Each
    distinct stack is looked up once; events without a stack, or with one that names no function, give no sample."""
    stacked = events.filter(F.size("stack") > 0).select(*keys, F.col(weight).cast("long").alias("weight"), F.col("stack").cast("array<bigint>").alias("_pcs"))
    asked = stacked.select(F.col("_pcs").alias("sample_id")).distinct().withColumn("pcs", F.col("sample_id"))
    return stacked.join(symbolise(asked, symbols, max_rows), F.col("_pcs") == F.col("sample_id")).select(*keys, "stack", "weight")
