"""Periodic runs of words: stretches that repeat themselves with a fixed period, again and again.

The suffixes of each text are sorted by prefix doubling, a chunk of texts at a time; only suffixes that share their first words
with another one of their text are looked at again. Then neighbours in suffix order are united by falling length of their
common prefix, as Kruskal's algorithm takes edges. A class keeps its positions in order. When two classes meet at a common
prefix of ``lcp`` words, every pair of positions i < j that become neighbours has exactly this common prefix, so the text
has period j - i from i to j + lcp. Neighbours have no class member between them, so no smaller period fits, and a run's first
position meets the one a period later at the run's full length: each run shows up there once.
"""

from bisect import bisect_left
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import table, texts_of

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: Words sorted together: a chunk ends after the text that reaches this.
CHUNK_WORDS = 200_000

RUNS = "array<struct<start:long,length:long,period:long>>"
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _classes(codes: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For h = 1, 2, 4, ... the class of each position by its first h words, numbered in order; and the number in full order.

    ``codes`` differ between texts, ``end`` is where a position's text ends. A class is numbered by the positions before it.
    """
    order = np.argsort(codes, kind="stable")
    rank = np.empty(len(codes), np.int32)
    slot = np.arange(len(codes), dtype=np.int32)
    levels, h = [], 1
    value = codes[order]
    first = np.concatenate([[True], value[1:] != value[:-1]])
    while True:
        starts = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        rank[order] = slot[starts]
        alone = first & np.append(first[1:], True)
        order, slot = order[~alone], slot[~alone]
        if len(order) == 0:
            return levels, rank
        levels.append(rank.copy())
        after = order + h
        inside = after < end[order]
        value = np.where(inside, rank[np.where(inside, after, 0)], -1)
        by = np.lexsort((value, rank[order]))
        # places in the whole order stay with the class, so they are still rising
        order, value = order[by], value[by]
        own = rank[order]
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])])
        h *= 2


def _neighbours(levels: list[np.ndarray], rank: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of positions next to each other in suffix order, with common prefixes of ``least`` words or more."""
    none = np.zeros(0, np.int64)
    step = least.bit_length() - 1
    if step >= len(levels):
        return none, none, none
    level = levels[step]
    _, which, sizes = np.unique(level, return_inverse=True, return_counts=True)
    at = np.flatnonzero(sizes[which] > 1)
    at = at[np.argsort(rank[at], kind="stable")]
    same = np.flatnonzero(level[at[:-1]] == level[at[1:]])
    i, j = at[same].astype(np.int64), at[same + 1].astype(np.int64)
    lcp = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + lcp, j + lcp
        inside = (a < end[i]) & (b < end[j])
        equal = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
        # classes reach over the end of a text only where a single position has this end
        lcp += equal << k
    enough = lcp >= least
    return i[enough], j[enough], lcp[enough]


def _seeds(i: np.ndarray, j: np.ndarray, lcp: np.ndarray, times: int) -> Iterator[tuple[int, int, int]]:
    """(position, period, common prefix) of positions that become neighbours, and whose stretch has ``times`` periods."""
    falling = np.argsort(-lcp, kind="stable")
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x] = x
            members[x] = [x]
            return x
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b, common in zip(i[falling].tolist(), j[falling].tolist(), lcp[falling].tolist()):
        a, b = root(a), root(b)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members.pop(b)
        parent[b] = a
        most = common // (times - 1)  # longer periods do not fit often enough
        low = -1
        for n, x in enumerate(small):
            at = bisect_left(large, x)
            if at and (before := large[at - 1]) != low and x - before <= most:
                yield before, x - before, common
            if at < len(large) and (after := large[at]) - x <= most and (n + 1 == len(small) or small[n + 1] > after):
                yield x, after - x, common
            large.insert(at, x)
            low = x


def runs_of(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period. Equal words have equal numbers."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if begin[-1] == 0:
        return out
    words = np.concatenate(texts).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    end = begin[owner + 1]
    levels, rank = _classes(owner * (int(words.max()) + 1) + words, end)
    # a run of n words and period p shares n - p of them with itself, p words on
    shared = -(-least * (times - 1) // times)
    for at, period, common in _seeds(*_neighbours(levels, rank, end, shared), times):
        text = int(owner[at])
        first = int(begin[text])
        if period + common >= least and (at == first or words[at - 1] != words[at - 1 + period]):
            out[text].append((at - first, period + common, period))
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(keep)])


def periodic_runs(
    docs: DataFrame, least: int = LEAST, times: int = TIMES, change: Callable | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row: the maximal stretches of at least ``least`` words that hold their
    smallest period ``times`` (2 or more) times, as (start, length, period) in words, and the text with one period left of each.

    Words lie between spaces, tabs and line ends. ``change(doc_id, words)`` may give other words to look at. A null or blank
    text has no words and no runs; null ids and repeated rows stay; other columns are not looked at; an empty table gives no
    rows. Rows are independent, nothing is shuffled; a task holds one Arrow batch, and sorts CHUNK_WORDS words and one text.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[list[bytes]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            known: dict[bytes, int] = {}
            codes = [np.array([known.setdefault(w, len(known)) for w in words], np.int64) for words in held]
            found = runs_of(codes, least, times)
            named = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()),
                "n_words": pa.array([len(w) for w in held], pa.int64()),
                "runs": pa.array(named, ARROW_RUNS),
                "collapsed": pa.array([collapsed(w, r).decode() for w, r in zip(held, found)], pa.string()),
            })

        for part in parts:
            for i, t in zip(part.column(0).to_pylist(), part.column(1)):
                words = t.as_py().encode().split()  # parts at ASCII white space
                if change is not None:
                    words = change(i, words)
                ids.append(i)
                held.append(words)
                size += len(words)
                if size >= CHUNK_WORDS or len(ids) >= 8192:
                    yield rows()
                    ids, held, size = [], [], 0
        if ids:
            yield rows()

    return texts_of(docs, doc_id, text).mapInArrow(batches, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, which for a tenth of the ids go round in a circle from some word on."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or n == 0:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark, sf_dir):
    """Runs of every document, the longest by its number of periods, and digests of all runs and of the collapsed text."""
    found = periodic_runs(table(spark, sf_dir, "documents"), change=repeated)
    more = F.array_sort(
        "runs",
        lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], -1)
        .when(a["length"] * b["period"] < b["length"] * a["period"], 1)
        .when(a["start"] < b["start"], -1)
        .when(a["start"] > b["start"], 1)
        .otherwise(F.signum(a["period"] - b["period"]).cast("int")),
    )
    best = F.try_element_at(more, F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
