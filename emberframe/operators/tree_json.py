"""Frame tables to nested JSON trees and back."""

import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.operators.json_nodes import Piece, tree_nodes
from emberframe.operators.ordered import in_ranges
from emberframe.schemas import FLAME_FRAMES
from emberframe.workspace import stored

GZIP_MAGIC = b"\x1f\x8b"
#: Keys of the paths in a batch, and a few for each row.
KEYS_PER_BATCH = 1_000_000

# Characters written as a \u escape: & < > and the two Unicode line ends.
ESCAPED_CODES = [0x26, 0x3C, 0x3E, 0x2028, 0x2029]


def json_string(text: Column) -> Column:
    """JSON string literal, with ``<``, ``>``, ``&`` and the two Unicode line ends escaped as well."""
    whole = F.to_json(F.struct(text.alias("s")))
    literal = F.substring(whole, 6, F.length(whole) - 6)
    for code in ESCAPED_CODES:
        literal = F.replace(literal, F.lit(chr(code)), F.lit("%su%04x" % (chr(92), code)))
    return literal


def tree_lines(frames: DataFrame, keys: list[str] = ["snapshot_id"]) -> DataFrame:
    """The text of nested JSON trees, ``name``, ``value``, ``children`` by name in byte order, a line per node: ``keys, _part,
    _row, line``. The lines of a snapshot in order of ``_part`` and ``_row`` are its text; line ends stand between fields.

    In path order each node directly follows its parent or a finished sibling subtree, so what a node adds to the text depends
    on its own depth and that of its neighbours only. Nodes are dealt out by ranges of the path order, whatever tree they
    belong to, and a range gets the row before it and the one after it: no task holds a tree.
    """
    depth = F.size("path")
    own = F.when(depth == 0, F.lit("")).otherwise(F.concat(json_string(F.element_at("path", -1)), F.lit(":")))
    body = F.concat(own, F.lit('{"name":'), json_string(F.col("name")), F.lit(',"value":'), F.col("value").cast("string"))
    bodies = frames.filter(depth >= 0).select(*keys, "path", depth.alias("_depth"), body.alias("_body"))
    kept = in_ranges(bodies, [*keys, "path"]).drop("path")
    sizes = sorted(map(tuple, kept.groupBy("_part").count().collect()))  # a row per range
    edges = []
    for (part, n), (following, _) in zip(sizes, sizes[1:]):
        edges += [(part, n - 1, following, -1), (following, 0, part, n)]
    borders = frames.sparkSession.createDataFrame(edges, "_part long, _row long, _to long, _at long")
    lent = kept.join(F.broadcast(borders), ["_part", "_row"]).select(*keys, "_depth", "_body", F.col("_to").alias("_part"), F.col("_at").alias("_row"))
    rows = kept.withColumn("_lent", F.lit(False)).unionByName(lent.withColumn("_lent", F.lit(True)))
    along = Window.partitionBy("_part").orderBy("_row")
    tree = F.struct(*keys, F.lit(0))
    before = F.when(F.lag(tree).over(along).eqNullSafe(tree), F.lag("_depth").over(along))
    after = F.when(F.lead(tree).over(along).eqNullSafe(tree), F.lead("_depth").over(along))
    rows = rows.select("*", F.coalesce(before, F.lit(-1)).alias("_before"), F.coalesce(after, F.lit(0)).alias("_after")).filter("NOT _lent")
    comma = F.when(F.col("_before") < F.col("_depth"), F.lit("")).otherwise(F.lit(","))
    end = F.when(F.col("_after") > F.col("_depth"), F.lit(',"children":{')).otherwise(
        F.concat(F.lit("}"), F.repeat(F.lit("}}"), F.col("_depth") - F.col("_after")))
    )
    return rows.select(*keys, "_part", "_row", F.concat(comma, "_body", end).alias("line"))


def tree_to_json(frames: DataFrame, keys: list[str] = ["snapshot_id"]) -> DataFrame:
    """One nested JSON text per snapshot: ``name``, ``value``, ``children`` by name in byte order.

    The lines of a range are joined first, then the few texts of a snapshot's ranges. The text is one value, which Spark holds
    up to 2 GB; ``write_snapshots`` has no such limit."""
    joined = lambda c, place: F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(place, c))), lambda x: x[c]))
    texts = tree_lines(frames, keys).groupBy(*keys, "_part").agg(joined("line", "_row").alias("text"))
    return texts.groupBy(*keys).agg(joined("text", "_part").alias("payload"))


def tree_rows(snapshot_id: str, tree: dict) -> Iterator[tuple]:
    """Rows of one decoded tree. The key of a child is its path element; its name may differ."""
    pending = [([], tree)]
    while pending:
        path, node = pending.pop()
        yield snapshot_id, tree.get("name", ""), path, node.get("name", ""), node.get("value", 0)
        for key, child in (node.get("children") or {}).items():
            if child is not None:
                pending.append((path + [key], child))


def _nodes(snapshot_id: str, text: bytes | str) -> Iterator[tuple]:
    """Rows of one text: by the fast decoder, which has a limit of depth, or by the one that has none."""
    try:
        tree = json.loads(text)
    except RecursionError:
        for row in tree_nodes(text.decode() if isinstance(text, bytes) else text):
            yield snapshot_id, *row
    else:
        yield from tree_rows(snapshot_id, tree)


def _batched(rows: Iterator[tuple], schema: pa.Schema, path_at: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches, bounded by their number and by the lengths of their paths."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[path_at]) + 20
        if size >= KEYS_PER_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _frame_batches(documents: Iterator[tuple[str, bytes | str]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    return _batched((row for snapshot_id, text in documents for row in _nodes(snapshot_id, text)), schema, 2)


ARROW_FRAMES = pa.schema([
    ("snapshot_id", pa.string()),
    ("root_name", pa.string()),
    ("path", pa.list_(pa.string())),
    ("name", pa.string()),
    ("value", pa.int64()),
])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of two columns, one document in memory at a time besides the batch."""
    for batch in batches:
        for key, document in zip(batch.column(0), batch.column(1)):
            yield key.as_py(), document.as_py()


def tree_explode(snapshots: DataFrame, id_column: str = "snapshot_id", payload: str = "payload") -> DataFrame:
    """Nested JSON trees to one row per node. Trees may be of any depth, which no fixed Spark type can hold, so a task decodes
    them document by document; nothing is shuffled. Every row holds its whole path, so a chain of n nodes has n * n / 2 keys."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _frame_batches(_pairs(batches), ARROW_FRAMES)

    return snapshots.select(F.col(id_column).cast("string"), payload).mapInArrow(decode, FLAME_FRAMES)


def _unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == GZIP_MAGIC else content


def decode_files(files: DataFrame) -> DataFrame:
    """Rows of ``binaryFile`` to frame rows; gzip is known by its first bytes, not by the file name."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _frame_batches(((name, _unpacked(content)) for name, content in _pairs(batches)), ARROW_FRAMES)

    return files.select("path", "content").mapInArrow(decode, FLAME_FRAMES)


ARROW_PIECES = pa.schema([
    ("file", pa.string()),
    ("ended", pa.bool_()),
    ("up", pa.int64()),
    ("keys", pa.list_(pa.string())),
    ("name", pa.string()),
    ("value", pa.int64()),
])


def decode_parts(files: DataFrame, snapshot: Column, part: Column) -> DataFrame:
    """Rows of ``binaryFile``, each a part of a snapshot's text that begins with a node, to frame rows.

    ``snapshot`` and ``part`` tell from ``path`` which text a file belongs to and its place there, parts being numbered in
    order. Each part is decoded by itself, its paths as far as it knows them; what a part leaves open, one row, is handed on to
    the next, and so the parts of a snapshot are never in one place.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for name, content in _pairs(batches):
                text = _unpacked(content).decode()
                piece = Piece(text, text.lstrip().startswith("{"))
                for up, keys, own, value in piece.nodes():
                    yield name, False, up, keys, own, value
                yield name, True, piece.up, piece.keys, None, None

        return _batched(rows(), ARROW_PIECES, 3)

    pieces = files.select("path", "content").mapInArrow(decode, "file string, ended boolean, up long, keys array<string>, name string, value long")
    read = pieces.withColumn("path", F.col("file")).select("*", snapshot.alias("snapshot_id"), part.cast("long").alias("_part")).drop("path")
    read = stored(read, "tree-pieces")

    def follow(key, left):
        # a row per part of a snapshot: how each finds the path that is open
        opened, starts = [], []
        for row in left.sort_by("_part").to_pylist():
            starts.append((row["snapshot_id"], row["_part"], opened))
            opened = opened[: len(opened) - row["up"]] + row["keys"]
        names, numbers, paths = zip(*starts)
        return pa.table([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(paths, pa.list_(pa.string()))], ["snapshot_id", "_part", "_start"])

    ends = read.filter("ended").select("snapshot_id", "_part", "up", "keys")
    starts = ends.groupBy("snapshot_id").applyInArrow(follow, "snapshot_id string, _part long, _start array<string>")
    nodes = read.filter("NOT ended").join(starts, ["snapshot_id", "_part"])
    whole = F.concat(F.slice("_start", F.lit(1), (F.size("_start") - F.col("up")).cast("int")), F.col("keys"))
    nodes = nodes.withColumn("path", whole)
    roots = nodes.filter(F.size("path") == 1).select("snapshot_id", F.col("name").alias("root_name"))  # a row per snapshot
    return nodes.join(roots, "snapshot_id").select("snapshot_id", "root_name", F.slice("path", F.lit(2), F.size("path")).alias("path"), "name", "value")
