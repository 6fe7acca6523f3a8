"""Repeated passages by a sparse suffix array over words.

1. Of every window of SPAN words the position with the smallest hash of the next GRAM words is retained (its minimiser).
   It depends on the window alone, so copies of a passage retain the same positions.
2. The retained suffixes are sorted by their first GRAM words, then by their block, all windows that retain them. Equal
   neighbours from two documents repeat the whole block.
3. Neighbours that share the first words but not the block agree on a part only. Their matches are extended to the left
   and the right window by window: the windows are hashed, sorted and compared with their neighbours again.
4. Windows that repeat are merged to spans.

Sorted runs are read as streams, so a passage in a third of all documents needs no memory; a batch of texts that holds it
more than once sends it on once.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import stored, table, texts_of
from emberframe.llm.words import _BACK, _BASE, Words, chunks, mixed, powers, words_of

#: Words of a passage that counts, and words that a retained suffix is first sorted by.
SPAN, GRAM = 50, 20
#: Ids that are sent to all tasks rather than joined by a shuffle, 8 bytes each.
SENT = 500_000

PLACE = np.dtype([("at", "<i4"), ("low", "<i4"), ("high", "<i4"), ("start", "<i4"), ("end", "<i4")])


class Codes:
    """Hashes of word ranges of one text."""

    def __init__(self, code: np.ndarray):
        self.n = len(code)
        self.total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(code * powers(_BASE, self.n), out=self.total[1:])
        self.back = powers(_BACK, self.n + 1)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mixed((self.total[high] - self.total[low]) * self.back[low] + (high - low).astype(np.uint64))


def retained(codes: Codes, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that are smallest among the first ``span - gram + 1`` of some window of ``span`` words, ascending, and
    where the windows begin and end that each is smallest in. A window's position follows from its words alone; windows
    of one position are next to each other. None in a text below ``span`` words."""
    if codes.n < span:
        return (np.zeros(0, np.int64),) * 3
    starts = np.arange(codes.n - gram + 1)
    view = sliding_window_view(codes.of(starts, starts + gram), span - gram + 1)
    at, low = np.unique(view.argmin(axis=1) + np.arange(len(view)), return_index=True)
    return at, low, np.append(low[1:], len(view)) - 1 + span


def _texts(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Id, word codes, and starts and ends of the words in code points."""
    for ids, raw in chunks(part.column("doc_id").to_pylist(), [t.encode() for t in part.column("text").to_pylist()]):
        words: Words = words_of(raw)
        for i, text, a, b in zip(ids, raw, words.first[:-1].tolist(), words.first[1:].tolist()):
            start, end = words.start[a:b], words.end[a:b]
            if not text.isascii():
                inner = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)])
                start, end = start - inner[start], end - inner[end]
            yield i, words.code[a:b], start, end


KEYED = "deal long, code long, sub long, doc_id long, sure boolean, shown boolean, places binary"


def _keyed(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of ``KEYED`` from (id, codes, subs, places) of the texts of a batch. One row per text and key, with all its places.

    A key that two texts of the batch share is sure to repeat. Its rows need not meet any others, so they are dealt out
    evenly, and one row that is only shown to others goes where the key's rows meet."""
    ids = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) for r in rows])
    text = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    code, sub, place = (np.concatenate([*(r[k] for r in rows), np.zeros(0, kind)]) for k, kind in ((1, np.uint64), (2, np.uint64), (3, PLACE)))
    order = np.lexsort((text, sub, code))
    ids, text, code, sub, place = ids[order], text[order], code[order], sub[order], place[order]
    new_key = np.ones(len(code), bool)
    new_key[1:] = (code[1:] != code[:-1]) | (sub[1:] != sub[:-1])
    new_row = new_key.copy()
    new_row[1:] |= text[1:] != text[:-1]
    row = np.flatnonzero(new_row)
    key_of_row = (np.cumsum(new_key) - 1)[row]
    sure = np.bincount(key_of_row, minlength=1)[key_of_row] > 1 if len(row) else np.zeros(0, bool)
    shown = sure & new_key[row]  # once more, for others to see
    ends = np.append(row[1:], len(code)) if len(row) else row
    raw = place.tobytes()
    size = PLACE.itemsize
    places = [raw[a * size : b * size] for a, b in zip(row.tolist(), ends.tolist())]
    both = np.concatenate([np.arange(len(row)), np.flatnonzero(shown)])
    is_shown = np.arange(len(both)) >= len(row)
    picked = row[both]
    deal = np.where(sure[both] & ~is_shown, mixed(sub[picked] + np.arange(len(both), dtype=np.uint64)), code[picked])
    as_long = lambda x: pa.array(x.astype(np.int64), pa.int64())
    columns = [as_long(deal), as_long(code[picked]), as_long(sub[picked]), as_long(ids[picked]), pa.array(sure[both]), pa.array(is_shown)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([places[i] for i in both.tolist()], pa.binary())], [c.split()[0] for c in KEYED.split(", ")])


def suffixes(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """The retained suffixes of all texts: ``code`` the first words, ``sub`` the block."""

    def batches(parts):
        for part in parts:
            rows = []
            for i, code, start, end in _texts(part):
                codes = Codes(code)
                at, low, high = retained(codes, span, gram)
                place = np.empty(len(at), PLACE)
                place["at"], place["low"], place["high"], place["start"], place["end"] = at, low, high, start[low], end[high - 1]
                rows.append((i, codes.of(at, at + gram), codes.of(low, high), place))
            yield _keyed(rows)

    return docs.mapInArrow(batches, KEYED)


def windows(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """All windows of the blocks at the positions ``at`` of each text; code and sub are the window."""

    def batches(parts):
        for part in parts:
            rows, wanted = [], part.column("at").to_pylist()
            for (i, code, start, end), compare in zip(_texts(part), wanted):
                codes = Codes(code)
                at, low, high = retained(codes, span, gram)
                keep = np.isin(at, np.array(compare))
                begins = [np.arange(a, b - span + 1) for a, b in zip(low[keep], high[keep])]
                begin = np.concatenate([*begins, np.zeros(0, np.int64)])
                place = np.empty(len(begin), PLACE)
                place["at"], place["low"], place["high"], place["start"], place["end"] = begin, begin, begin + span, start[begin], end[begin + span - 1]
                key = codes.of(begin, begin + span)
                rows.append((i, key, key, place))
            yield _keyed(rows)

    return docs.mapInArrow(batches, KEYED)


FOUND = "doc_id long, compare boolean, at int, low int, high int, start int, end int"


def neighbours(rows: DataFrame) -> DataFrame:
    """Places of rows whose key repeats (``compare`` false), and of those beside a row with the same ``code`` and another
    ``sub`` (``compare`` true). Rows come sorted; each is compared with the one before and the one after."""

    def found(columns: list[np.ndarray], places: list[bytes], last: bool, first_known: bool) -> pa.RecordBatch:
        code, sub, doc, sure, shown = columns
        alike = code[1:] == code[:-1]
        equal = alike & (sub[1:] == sub[:-1])
        part = alike & ~equal
        at = np.zeros(1, bool)
        repeat = sure | np.concatenate([at, equal]) | np.concatenate([equal, at])
        beside = np.concatenate([at, part]) | np.concatenate([part, at])
        own = np.ones(len(code), bool)
        own[0] = not first_known  # its own turn was in the last round
        own[-1] &= last
        out = []
        for mask, compare in ((repeat & ~shown & own, False), (beside & own, True)):
            picked = np.flatnonzero(mask)
            raw = np.frombuffer(b"".join([places[i] for i in picked.tolist()]), PLACE)
            times = np.fromiter((len(places[i]) // PLACE.itemsize for i in picked.tolist()), np.int64, len(picked))
            out.append((np.repeat(doc[picked], times), np.full(len(raw), compare), raw))
        raw = np.concatenate([o[2] for o in out])
        arrays = [pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)] + [pa.array(np.ascontiguousarray(raw[n])) for n in PLACE.names]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in FOUND.split(", ")])

    def batches(parts):
        # the last two rows wait: one for its neighbour, the other is that one's neighbour
        held, held_places = None, []
        for part in parts:
            if not part.num_rows:
                continue
            columns = [part.column(n).to_numpy(zero_copy_only=False) for n in ("code", "sub", "doc_id", "sure", "shown")]
            places = part.column("places").to_pylist()
            known = held is not None and len(held_places) > 1
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
                places = held_places + places
            if len(places) > 1:
                yield found(columns, places, False, known)
            held, held_places = [c[-2:] for c in columns], places[-2:]
        if held is not None:
            yield found(held, held_places, True, len(held_places) > 1)

    dealt = rows.repartition("deal").sortWithinPartitions("code", "sub")
    return dealt.select("code", "sub", "doc_id", "sure", "shown", "places").mapInArrow(batches, FOUND)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``doc_id, first_word, n_words, start, end``: the parts of each document that windows of ``span`` words cover which
    stand in another row as well. Words are lower-cased runs of non-space; ``start, end`` are code points, end exclusive.

    Matches are all of those and no others, up to hash collisions. Repeats within one row alone are not reported. A null or
    short text has none. A repeated row is a copy of the other; rows that share an id are reported under it, overlapping
    parts merged. Rows without an id take no part. Other columns are not looked at; an empty table gives no rows.
    """
    docs = texts_of(docs, doc_id, text).filter("doc_id IS NOT NULL")
    first = stored(neighbours(suffixes(docs, span, gram)), "suffix-neighbours")
    compare = first.filter("compare").groupBy("doc_id").agg(F.collect_set("at").alias("at"))
    few = compare.count() <= SENT
    packed = stored(compare, "suffix-compare")
    ids = packed.select("doc_id")
    asked = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").join(packed, "doc_id")
    second = neighbours(windows(asked, span, gram))
    spans = first.filter("NOT compare").unionByName(second.filter("NOT compare")).select("doc_id", "low", "high", "start", "end").distinct()
    along = Window.partitionBy("doc_id").orderBy("low", "high")
    reach = F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    grouped = spans.withColumn("new", F.coalesce((F.col("low") > reach).cast("int"), F.lit(1))).withColumn("nth", F.sum("new").over(along))
    merged = grouped.groupBy("doc_id", "nth").agg(F.min("low").alias("first_word"), F.max("high").alias("high"), F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select("doc_id", "first_word", (F.col("high") - F.col("first_word")).alias("n_words"), "start", "end")


def op1_suffix_dedup(spark, sf_dir):
    """Passages of fifty words and more that stand in more than one document."""
    return repeated_spans(table(spark, sf_dir, "documents"))
