"""Flame graphs per time window of a stream of samples."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.operators.flame import empty_path, node_name


def _build(samples: DataFrame, period: Column, watermark: str, keys: list[str], root_name: str) -> DataFrame:
    admitted = (F.size("stack") > 0) & (F.col("weight") != 0)
    return (
        samples.withWatermark("ts", watermark)
        .select(
            period.alias("window"),
            *keys,
            F.when(admitted, F.col("stack")).otherwise(empty_path()).alias("stack"),
            F.when(admitted, F.col("weight")).otherwise(F.lit(0)).cast("long").alias("weight"),
        )
        .select("window", *keys, "stack", "weight", F.explode(F.sequence(F.lit(0), F.size("stack"))).alias("depth"))
        .groupBy("window", *keys, F.slice("stack", F.lit(1), F.col("depth")).alias("path"))
        .agg(F.sum(F.when(F.col("depth") > 0, F.col("weight")).otherwise(F.lit(0))).alias("value"))
        .select("window", *keys, F.lit(root_name).alias("root_name"), "path", node_name(F.lit(root_name)).alias("name"), "value")
    )


def flame_window(
    samples: DataFrame,
    period: str = "500 milliseconds",
    watermark: str = "1 second",
    keys: list[str] = ["process_id"],
    slide: str | None = None,
    root_name: str = "root",
) -> DataFrame:
    """One tree per period and process. State holds sums per open window only; each batch is combined before
    its shuffle. Windows are written once the watermark has passed them; later rows are dropped and counted
    in the query's progress. ``slide`` makes the windows overlap."""
    return _build(samples, F.window("ts", period, slide), watermark, keys, root_name)


def flame_session(
    samples: DataFrame, gap: str, watermark: str, keys: list[str] = ["process_id"], root_name: str = "root"
) -> DataFrame:
    """One tree per frame path and burst of activity, bursts being ``gap`` apart."""
    return _build(samples, F.session_window("ts", gap), watermark, keys, root_name)
