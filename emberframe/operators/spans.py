"""Frames joined with the newest span annotation of their goroutine."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.functions.spans import TTL_US, goroutine_id, span_label
from emberframe.operators.ordered import MAX_ROWS, ordered_columns

TRACE_CHILD = "_trace"


def trace_attach(frames: DataFrame, annotations: DataFrame, ttl_us: int = TTL_US, max_rows: int = MAX_ROWS) -> DataFrame:
    """Frames plus, for each named ``...-<id>``, a child ``_trace`` carrying ``trace:span``.

    ``frames`` has ``us`` and a BIGINT ``frame_id`` besides the frame columns; ``annotations`` has gid, us,
    event_id, ann. As-of lookup without a join: both sides are put in one order per goroutine and each frame
    takes the last annotation before it. A ``_trace`` child that a frame has already is replaced.
    """
    named = frames.withColumn("_gid", goroutine_id(F.col("name"))).filter(F.col("_gid").isNotNull())
    spans = annotations.select(
        F.col("gid").cast("decimal(20,0)").alias("_gid"), "us", F.col("event_id").alias("frame_id"), span_label(F.col("ann")).alias("_span")
    ).filter(F.col("_span").isNotNull())
    # at one instant annotations come first
    both = named.withColumn("_is_frame", F.lit(1).cast("long")).unionByName(
        spans.withColumn("_is_frame", F.lit(0).cast("long")), allowMissingColumns=True
    )
    newest = F.when(F.col("_is_frame") == 0, F.struct(F.col("us").alias("seen"), F.col("_span").alias("label")))
    children = (
        ordered_columns(both, ["_gid"], ["us", "_is_frame", "frame_id"], last_known={"_newest": newest}, max_rows=max_rows)
        .filter((F.col("_is_frame") == 1) & (F.col("us") - F.col("_newest.seen") <= ttl_us))
        .withColumn("path", F.array_append("path", TRACE_CHILD))
        .withColumn("name", F.col("_newest.label"))
        .withColumn("value", F.lit(0).cast("long"))
    )
    children = children.select(*frames.columns)
    # only rows of that name can be in the way
    is_trace = F.coalesce(F.try_element_at("path", F.lit(-1)) == TRACE_CHILD, F.lit(False))
    old = frames.filter(is_trace).join(children.select("snapshot_id", "path").distinct(), ["snapshot_id", "path"], "left_anti")
    return frames.filter(~is_trace).unionByName(old.select(*frames.columns)).unionByName(children)


def agent_enrich(facts: DataFrame, agents: DataFrame, key: str) -> DataFrame:
    """Snapshots or metrics with host, version and tags of their agent; unknown agents keep nulls."""
    return facts.join(agents.withColumnRenamed("id", key), key, "left")
