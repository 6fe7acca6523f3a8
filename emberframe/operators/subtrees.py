"""Sums over subtrees by one pass over the nodes in path order.

In path order a subtree is one stretch of rows, from a node to its last descendant. A task reads its range of the order with a
stack of the nodes that are open, the ancestors of the current row, and gets a node's sum as the difference of two running
sums. Nothing is written once per ancestor, and a task holds a batch and one path. Ranges cut trees anywhere: a node that is
open at either end of a range is written as a part, and these few parts, a path for each end, are added up afterwards.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.workspace import stored


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on equal columns, null being equal to null. The columns of ``on`` are those of ``left``."""
    renamed = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(renamed, same, how).drop(*[f"_on_{c}" for c in on])


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are, null being a value."""
    indices = column.dictionary_encode().indices
    return indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _shared(codes: np.ndarray, offsets: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Length of the path that each row shares with the row before it; -1 where the keys differ, and for the first row."""
    size = np.diff(offsets)
    out = np.where(alike, 0, -1)
    most = np.zeros(len(size), np.int64)
    most[1:] = np.minimum(size[1:], size[:-1])
    active, k = np.flatnonzero(alike & (most > 0)), 0
    while len(active):
        active = active[codes[offsets[active] + k] == codes[offsets[active - 1] + k]]
        k += 1
        out[active] = k
        active = active[most[active] > k]
    return out


class _Open:
    """A node that is still open at the end of a batch, with what it has so far: its own numbers, those of its subtree, of
    its children. ``part``: the range before may hold some of it. ``own`` tells whether the node itself was a row."""

    __slots__ = ("keys", "path", "name", "part", "own", "sums")

    def __init__(self, keys, path, name, part, own, sums):
        self.keys, self.path, self.name, self.part, self.own, self.sums = keys, path, name, part, own, sums


def _pass(batches: Iterator[pa.RecordBatch], n_keys: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows ``keys, path, name, numbers`` in order to rows ``keys, path, name, part, own, sums``."""
    opened: list[_Open] = []
    before: list | None = None  # the last path of the batch before
    first_row = True

    def written(nodes: list[_Open], part: bool) -> pa.RecordBatch:
        columns = [[n.keys[k] for n in nodes] for k in range(n_keys)]
        columns += [[n.path for n in nodes], [n.name for n in nodes], [part or n.part for n in nodes], [n.own for n in nodes]]
        sums = np.array([n.sums for n in nodes], np.int64).reshape(len(nodes), -1)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(sums[:, k]) for k in range(sums.shape[1])], schema=schema)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = batch.num_rows
        keys, paths, names = batch.columns[:n_keys], batch.column(n_keys), batch.column(n_keys + 1)
        numbers = np.stack([np.zeros(rows, np.int64)] + [c.to_numpy(zero_copy_only=False) for c in batch.columns[n_keys + 2 :]], 1)
        offsets = paths.offsets.to_numpy().astype(np.int64)
        depth = np.diff(offsets)
        alike = np.concatenate([[False], np.ones(rows - 1, bool)])
        for k in keys:
            codes = _codes(k)
            alike[1:] &= codes[1:] == codes[:-1]
        shared = _shared(_codes(paths.values), offsets, alike)
        first_keys = tuple(k[0].as_py() for k in keys)
        if before is not None and opened and opened[0].keys == first_keys:
            path = paths[0].as_py()
            shared[0] = next((k for k, (a, b) in enumerate(zip(path, before)) if a != b), min(len(path), len(before)))

        # nodes of this batch: those that are open from before, then new ones
        held = len(opened)
        node_row, node_depth, node_part, node_own = [-1] * held, [len(n.path) for n in opened], [n.part for n in opened], [n.own for n in opened]
        parent, since, until = list(range(-1, held - 1)), [0] * held, [rows] * held
        stack = list(range(held))
        of_row = []
        for row, (common, deep) in enumerate(zip(shared.tolist(), depth.tolist())):
            while stack and node_depth[stack[-1]] > common:
                until[stack.pop()] = row
            if not (stack and node_depth[stack[-1]] == deep):
                # prefixes without a row of their own, then the node
                for d in range(node_depth[stack[-1]] + 1 if stack else 0, deep + 1):
                    parent.append(stack[-1] if stack else -1)
                    stack.append(len(node_row))
                    node_row.append(row)
                    node_depth.append(d)
                    # what lies before this range may belong to the prefixes of its first row
                    node_part.append(first_row and d < deep)
                    node_own.append(d == deep)
                    since.append(row)
                    until.append(rows)
            first_row = False
            of_row.append(stack[-1])

        of_row, parent = np.array(of_row), np.array(parent)
        since, until = np.array(since), np.array(until)
        running = np.concatenate([np.zeros((1, numbers.shape[1]), np.int64), np.cumsum(numbers, 0)])
        below = running[until] - running[since]
        own = np.zeros_like(below)
        np.add.at(own, of_row, numbers)
        children = np.zeros_like(below)
        inner = parent[of_row] >= 0
        np.add.at(children, parent[of_row][inner], numbers[inner])
        sums = np.stack([own, below, children], 2)[:, 1:].reshape(len(below), -1)
        if held:
            sums[:held] += np.array([n.sums for n in opened], np.int64).reshape(held, -1)

        still = set(stack)
        done_before = [n for n in range(held) if n not in still]
        for n in range(held):
            opened[n].sums = sums[n].tolist()
        if done_before:
            yield written([opened[n] for n in done_before], False)
        node_row, node_depth = np.array(node_row), np.array(node_depth)
        done = np.ones(len(node_row), bool)
        done[:held] = False
        done[stack] = False
        done = np.flatnonzero(done)
        if len(done):
            row, deep = pa.array(node_row[done]), node_depth[done]
            ends = np.cumsum(deep)
            places = np.arange(ends[-1]) - np.repeat(ends - deep, deep) + np.repeat(offsets[node_row[done]], deep)
            path = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), paths.values.take(pa.array(places)))
            has = pa.array(np.array(node_own)[done])
            name = pa.compute.if_else(has, names.take(row), pa.scalar(None, names.type))
            columns = [k.take(row) for k in keys] + [path, name, pa.array(np.array(node_part)[done]), has]
            arrays = [c.cast(f.type) for c, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(sums[done, k]) for k in range(sums.shape[1])], schema=schema)
        kept = []
        for n in stack:
            if n < held:
                kept.append(opened[n])
            else:
                r = int(node_row[n])
                name = names[r].as_py() if node_own[n] else None
                path = paths.values.slice(int(offsets[r]), int(node_depth[n])).to_pylist()
                kept.append(_Open(tuple(k[r].as_py() for k in keys), path, name, node_part[n], node_own[n], sums[n].tolist()))
        opened = kept
        before = paths[rows - 1].as_py()
    if opened:
        yield written(opened, True)


def subtree_sums(nodes: DataFrame, keys: list[str], numbers: list[str]) -> DataFrame:
    """One row per path and prefix of a path: ``keys, path, name`` and for each BIGINT column c of ``numbers`` (null counts as
    0) ``own_c`` (sum over the rows of the path), ``sub_c`` (over the path and all below) and ``kids_c`` (over its children).

    ``name`` is the lowest one of the path's rows; a prefix that is no row itself has null as ``name`` and ``own_c``. Rows
    without a path are left out. The rows are shuffled once, by ranges of the path order, so a tree may be of any size and
    depth; the result of the pass is stored, as what follows reads it twice and must find the same ranges.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = nodes.filter(F.col("path").isNotNull()).select(
        *keys, "path", "name", *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in numbers]
    )
    ordered = rows.repartitionByRange(*keys, "path").sortWithinPartitions(*keys, "path", "name")
    sums = [f"{kind}_{c}" for c in numbers for kind in ("own", "sub", "kids")]
    flags = [T.StructField("_part", T.BooleanType()), T.StructField("_own", T.BooleanType())]
    fields = rows.schema.fields[: len(keys) + 2] + flags + [T.StructField(s, T.LongType()) for s in sums]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    arrow, n_keys = to_arrow_schema(schema), len(keys)
    passed = stored(ordered.mapInArrow(lambda batches: _pass(batches, n_keys, arrow), schema), "subtrees")
    parts = passed.filter("_part")
    added = parts.groupBy(*keys, "path").agg(F.max(F.col("_own").cast("int")).cast("boolean").alias("_own"), *[F.sum(s).alias(s) for s in sums])
    names = parts.filter("_own").select(*keys, "path", "name")  # a row per path: its rows lie in one range
    whole = passed.filter("NOT _part").drop("_part").unionByName(null_safe(added, names, [*keys, "path"], "left"))
    own = lambda s: F.when(F.col("_own"), F.col(s)).alias(s) if s.startswith("own_") else F.col(s)
    return whole.select(*keys, "path", "name", *[own(s) for s in sums])
