"""Flame-graph operators on frame tables: one row per node, ``path`` from the root, ``[]`` is the root.

Values are inclusive: a node has the weight of every sample that passes through it. The root keeps 0.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.operators.subtrees import null_safe, subtree_sums

# sorts after every other character, so a node can be placed behind its children
HIGHEST = chr(0x10FFFF)


def empty_path() -> Column:
    return F.array().cast("array<string>")


def sample_admission(samples: DataFrame) -> DataFrame:
    """Samples with a stack and a weight."""
    return samples.filter((F.size("stack") > 0) & (F.col("weight") != 0))


def _prefix(path: str | Column, length: Column) -> Column:
    return F.slice(path, F.lit(1), length)


def flame_build(samples: DataFrame, keys: list[str] = ["snapshot_id"], root_name: str = "root") -> DataFrame:
    """Roll stacks up to one row per prefix.

    Equal stacks are summed first (combined before the shuffle), so the prefixes of a stack are written out
    once per distinct stack and not once per sample. Rejected samples still give their snapshot a root.
    """
    admitted = (F.size("stack") > 0) & (F.col("weight") != 0)
    stacks = (
        samples.select(
            *keys,
            F.when(admitted, F.col("stack")).otherwise(empty_path()).alias("stack"),
            F.when(admitted, F.col("weight")).otherwise(F.lit(0)).cast("long").alias("weight"),
        )
        .groupBy(*keys, "stack")
        .agg(F.sum("weight").alias("weight"))
    )
    return (
        stacks.select(*keys, "stack", "weight", F.explode(F.sequence(F.lit(0), F.size("stack"))).alias("depth"))
        .groupBy(*keys, _prefix("stack", F.col("depth")).alias("path"))
        .agg(F.sum(F.when(F.col("depth") > 0, F.col("weight")).otherwise(F.lit(0))).alias("value"))
        .select(*keys, F.lit(root_name).alias("root_name"), "path", node_name(F.lit(root_name)).alias("name"), "value")
    )


def node_name(root_name: Column) -> Column:
    return F.coalesce(F.try_element_at("path", F.lit(-1)), root_name)


def ancestor_closure(frames: DataFrame, keys: list[str] = ["snapshot_id"]) -> DataFrame:
    """Every prefix of every path, root and the paths themselves included."""
    return subtree_sums(frames.select(*keys, "path", F.lit(None).cast("string").alias("name")), keys, []).select(*keys, "path")


def _renamed(frames: DataFrame, columns: list[str]) -> DataFrame:
    """The few nodes whose name is not their key in the path: roots, and children that were given another name.

    Sums of a tree are taken over numbers alone, which aggregates by hashing; with a name in its buffer an aggregation
    sorts its input first, here rows times depth. Names are the last key of the path, and these are joined back."""
    plain = F.try_element_at("path", F.lit(-1)).eqNullSafe(F.col("name"))
    return frames.filter(~plain).select(*columns, "path", F.col("name").alias("_name"))


def _named(df: DataFrame, renamed: DataFrame, on: list[str]) -> DataFrame:
    """``df`` with ``name``: that of ``renamed``, the lowest if there are several, where the node is there, else the last key
    of its path."""
    lowest = F.row_number().over(Window.partitionBy(*on).orderBy("_name"))
    one = renamed.withColumn("_nth", lowest).filter("_nth = 1").drop("_nth")
    joined = null_safe(df, one, on, "left")
    return joined.withColumn("name", F.coalesce("_name", F.try_element_at("path", F.lit(-1)))).drop("_name")


def _leading(nodes: DataFrame, keys: list[str], hit: Column, numbers: list[str]) -> DataFrame:
    """Nodes that are hit or lead to a hit: keys, path, ``_hit`` and the columns ``numbers``, null where a path is no node."""
    marked = nodes.select(*keys, "path", F.lit(None).cast("string").alias("name"), hit.cast("long").alias("_hit"), *numbers)
    found = subtree_sums(marked, keys, ["_hit", *numbers]).filter("sub__hit > 0")
    return found.select(*keys, "path", (F.coalesce("own__hit", F.lit(0)) > 0).alias("_hit"), *[F.col(f"own_{c}").alias(c) for c in numbers])


def flame_search(frames: DataFrame, text: str, keys: list[str] = ["snapshot_id"]) -> DataFrame:
    """Nodes whose name contains ``text`` in any case, with their ancestors; ``matched`` marks the former. Null keys are keys."""
    if not text:
        return frames.withColumn("matched", F.lit(False))
    hit = F.coalesce(F.contains(F.lower("name"), F.lower(F.lit(text))), F.lit(False))
    leading = _leading(frames, keys, hit, []).withColumnRenamed("_hit", "matched")
    return null_safe(frames, leading, [*keys, "path"]).select(*frames.columns, "matched")


def _diff(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of nodes with ``side`` 1 (head) and -1 (base). A node that the head has bears the head's name."""
    delta = sides.groupBy(*keys, "path").agg(F.sum(F.col("value") * F.col("side")).alias("delta"), F.max("side").alias("side"))
    kept = _leading(delta, keys, F.col("delta") != 0, ["delta", "side"])
    return _named(kept, _renamed(sides, [*keys, "side"]), [*keys, "path", "side"]).select(*keys, "path", "name", "delta")


def flame_diff(head: DataFrame, base: DataFrame, keys: list[str] = []) -> DataFrame:
    """Head minus base per path; subtrees in which nothing changed are left out, equal trees give no rows.

    Both sides go through one combined aggregation, not an outer join. ``keys`` are columns both sides share.
    """
    side = lambda df, sign: df.select(*keys, "path", "name", "value", F.lit(sign).alias("side"))
    return _diff(side(head, 1).unionByName(side(base, -1)), keys)


def snapshot_diff(frames: DataFrame, head_id: str, base_id: str) -> DataFrame:
    """Difference of two snapshots of one frame table, which is read once."""
    if head_id == base_id:
        return frames.select("path", "name", F.col("value").alias("delta")).limit(0)
    side = F.when(F.col("snapshot_id") == head_id, 1).otherwise(-1).alias("side")
    return _diff(frames.filter(F.col("snapshot_id").isin(head_id, base_id)).select("path", "name", "value", side), [])


def diff_frames(delta: DataFrame, snapshot_id: str = "diff", root_name: str = "root") -> DataFrame:
    """A difference as a frame table, for all that takes one: writing, searching, banding, flattening."""
    return delta.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(root_name).alias("root_name"), "path", "name", F.col("delta").alias("value"))


def flame_merge(trees: list[DataFrame], keys: list[str] = []) -> DataFrame:
    """Node-wise sum of trees, root included; a node keeps the name of the first tree that has it, the whole that of the first
    tree with a root. Where a tree gives a path several names, the lowest counts.

    ``keys`` says what stays apart: [] merges everything into one tree, ["snapshot_id"] per snapshot. A tree has a row for
    its root, which tells its root's name.
    """
    numbered = [t.select(*keys, "root_name", "path", "name", "value", F.lit(i).alias("source")) for i, t in enumerate(trees)]
    every = numbered[0]
    for t in numbered[1:]:
        every = every.unionByName(t)
    merged = every.groupBy(*keys, "path").agg(F.sum("value").alias("value"), F.min("source").alias("source"))
    named = _named(merged, _renamed(every, [*keys, "source"]), [*keys, "path", "source"])
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("source", "root_name"))
    roots = every.filter(F.size("path") == 0).select(*keys, "source", "root_name").distinct().withColumn("_nth", first).filter("_nth = 1")
    if keys:
        named = null_safe(named, roots.select(*keys, "root_name"), keys, "left")
    else:
        named = named.withColumn("root_name", roots.select("root_name").scalar())
    return named.select(*keys, "root_name", "path", "name", "value")


def flame_flatten(frames: DataFrame, keys: list[str] = ["snapshot_id"]) -> DataFrame:
    """Depth, ``self`` (the node's value), ``cumulative`` (sum of the values of the node and all below it)
    and ``self_exclusive`` (the value less those of the direct children). Rows of one path count as one node, which bears the
    lowest of their names; a prefix that is no row has neither name nor ``self``."""
    return subtree_sums(frames, keys, ["value"]).select(
        *keys,
        "path",
        "name",
        F.size("path").alias("depth"),
        F.col("own_value").alias("self"),
        F.col("sub_value").alias("cumulative"),
        (F.col("own_value") - F.col("kids_value")).alias("self_exclusive"),
    )


def flatten_order() -> Column:
    """Sort key of a flattened tree: root first, siblings in falling byte order, parents before children."""
    return F.array_append("path", F.lit(HIGHEST)).desc()


def child_order() -> Column:
    """Sort key of a written tree: parents before children, siblings in rising byte order."""
    return F.col("path").asc()


def top_k(flat: DataFrame, k: int = 10, order: str = "flatten", keys: list[str] = []) -> DataFrame:
    """First ``k`` rows of one flattened tree in flatten order, or the ``k`` of highest cumulative value."""
    if order == "flatten":
        return flat.orderBy(*keys, flatten_order()).limit(k)
    if order == "hottest":
        return flat.orderBy(F.col("cumulative").desc(), *keys, flatten_order()).limit(k)
    raise ValueError(f"order must be 'flatten' or 'hottest', not {order!r}")


def replay_summary(flat: DataFrame, keys: list[str] = ["snapshot_id"]) -> DataFrame:
    """Node count, cumulative value of the root and sum of ``self`` per snapshot."""
    return flat.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.max(F.when(F.col("depth") == 0, F.col("cumulative"))).alias("total_cumulative"),
        F.sum("self").alias("total_self"),
    )
