"""Packing of token sequences: cutting stock by column generation.

1. Each document becomes full sequences of LENGTH ids, cut from its front, and one rest. Only the rest needs packing.
2. Rests are counted by length class. A linear program chooses how often to use each pattern of classes that fits into a
   sequence; new patterns are priced by a knapsack over the classes, until none lowers the number of sequences.
3. The patterns' numbers are rounded down, what is left is filled first-fit by length. Everything here depends on the
   number of classes, not on the number of documents.
4. Documents are ranked within their class; rank, pattern numbers and counts tell each one its sequence by arithmetic.
"""

import json
import re
import struct
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.byte_bpe import LETTERS
from emberframe.llm.common import per_text, stored, table, texts_of

LENGTH = 4096
#: Ids in one unit of length: a rest counts as its length rounded up to units, so there are LENGTH / UNIT classes.
UNIT = 8
#: Documents ranked together; a class with more is ranked in parts that are counted first.
RANKED = 50_000
#: Chunks of text kept with their ids, per worker; when full, the memory starts anew.
REMEMBERED = 500_000


# ---- tokens

CONTROLS = re.compile(r"[\x1c-\x1f]")
CHUNKS = re.compile(r"[^ \t-\r]+")
BEYOND = re.compile(r"[^\x00-\xff]")
SIGNS = ".,;:!?"
PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
PRINTABLE = re.compile(r"[!-~\xa1-\xac\xae-\xff]+")


class WordCoder:
    """Ids of a text, chunk by chunk of white space, for a tokenizer that drops white space and never joins across it.

    A chunk of printable Latin-1 goes to the tokenizer's merges directly, after the steps that its file names: lower case,
    its own pattern, bytes as letters. Normalising such a chunk in general costs many times its merges. Any other chunk, or
    one of a tokenizer with other steps, is encoded as a whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        # a text that may hold an added token's string is left to the tokenizer as a whole
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else lambda text: None
        steps = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", [])]
        split = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.direct = normal == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in split] == ["Split", "ByteLevel"]
        if self.direct:
            self.pieces = regex.compile(split[0]["pattern"]["Regex"]).findall
            self.merge = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.known_pieces: dict[str, bytes] = {}

    def merged(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(LETTERS)
        ids = [t.id for t in self.merge(letters)]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, word: str) -> bytes:
        if not (self.direct and PRINTABLE.fullmatch(word)):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        out = []
        for piece in self.pieces(word.lower()):
            if (got := self.known_pieces.get(piece)) is None:
                self.known_pieces[piece] = got = self.merged(piece)
            out.append(got)
        return b"".join(out)

    def learn(self, word: str, low: bool) -> bytes:
        """A chunk's ids. ``low``: it is lower-case Latin-1. A word is one piece then, and with a sign behind it two."""
        if not low:
            return self.chunk(word)
        if word.isalpha():
            return self.merged(word)
        base, sign = word[:-1], word[-1]
        if sign not in SIGNS or not base.isalpha():
            return self.chunk(word)
        known = self.known
        for part in (base, sign):
            if part not in known:
                known[part] = self.merged(part)
        return known[base] + known[sign]

    def encode(self, text: str) -> bytes:
        if self.added(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        low = self.direct and not BEYOND.search(text)
        if low:
            text = text.lower()  # one entry for all spellings of a word
        # these four control characters are white space to Python alone
        words = text.split() if not CONTROLS.search(text) else CHUNKS.findall(text)
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
                self.known_pieces.clear()
            for w in set(words).difference(known):
                known[w] = self.learn(w, low)
            return b"".join([known[w] for w in words])


@lru_cache(maxsize=4)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def pieces_of(docs: DataFrame, encoder, end_id: int, length: int = LENGTH) -> DataFrame:
    """``row_id, doc_id, start, length, ids_crc32, doc_tokens``: the full pieces of each row and its rest, if any.

    ``encoder()`` gives, on a worker, a function from text to ids as little-endian unsigned 32-bit bytes; ``end_id`` is
    appended. ``row_id`` tells rows apart whose ids repeat or are null."""
    tail = struct.pack("<I", end_id)

    def rows(ids, texts):
        encode = encoder()
        out = [[], [], [], [], []]
        for d, t in zip(ids, texts):
            coded = encode(t) + tail
            n = len(coded) // 4
            for at in range(0, n, length):
                piece = coded[4 * at : 4 * (at + length)]
                for column, value in zip(out, (d, at, len(piece) // 4, zlib.crc32(piece), n)):
                    column.append(value)
        return {k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), out)}

    return per_text(docs, rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


# ---- the linear program


def knapsack(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes (class c takes c + 1 units) in ``room`` units, by dynamic programming."""
    best = np.zeros(room + 1)
    took = np.full(room + 1, -1)
    for r in range(1, room + 1):
        reach = best[r - 1 :: -1][: len(value)] + value[: min(r, len(value))]
        c = int(np.argmax(reach))
        best[r], took[r] = (reach[c], c) if reach[c] > best[r - 1] + 1e-12 else (best[r - 1], -1)
    pattern = np.zeros(len(value), np.int64)
    r = room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            pattern[took[r]] += 1
            r -= took[r] + 1
    return float(best[room]), pattern


def patterns(counts: np.ndarray, room: int, most_rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns of classes and how many sequences use each; together they hold exactly ``counts``.

    The revised simplex method over the classes that occur. It starts from patterns of one class each; every round prices
    one pattern by the knapsack and exchanges it for the one that runs out first. ``most_rounds`` ends a run of
    degenerate exchanges early: the result is then a little less tight, never wrong.
    """
    held = np.flatnonzero(counts)
    if not len(held):
        return []
    demand = counts[held].astype(float)
    basis = [np.zeros(len(counts), np.int64) for _ in held]
    for b, c in zip(basis, held):
        b[c] = room // (c + 1)
    inverse = np.diag([1 / b[c] for b, c in zip(basis, held)])
    x = inverse @ demand
    for _ in range(most_rounds):
        price = np.zeros(len(counts))
        price[held] = np.maximum(0, inverse.sum(axis=0))
        gain, new = knapsack(price, room)
        if gain <= 1 + 1e-7:
            break
        column = inverse @ new[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(column > 1e-9, x / column, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[out] = new
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
        x = np.maximum(0, inverse @ demand)
    left = counts.astype(np.int64).copy()
    chosen = []
    for pattern, times in zip(basis, np.floor(x + 1e-6).astype(int)):
        fits = min([int(left[c] // pattern[c]) for c in np.flatnonzero(pattern)], default=0)
        times = min(int(times), fits)
        if times > 0:
            chosen.append((pattern, times))
            left -= times * pattern
    return chosen + first_fit(left, room)


def first_fit(left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """What rounding left over, longest first, each sequence filled with the largest classes that still fit."""
    left = left.copy()
    chosen = []
    while left.any():
        pattern, free = np.zeros(len(left), np.int64), room
        for c in np.flatnonzero(left)[::-1]:
            n = min(int(left[c]), free // (c + 1))
            pattern[c] += n
            free -= n * (c + 1)
        times = min(int(left[c] // pattern[c]) for c in np.flatnonzero(pattern))
        chosen.append((pattern, times))
        left -= times * pattern
    return chosen


# ---- ranks and sequences


def ranked(rests: DataFrame, rows: int) -> DataFrame:
    """Rests with ``place``, 0, 1, 2, ... within their class. A class is ranked in parts of about RANKED rows; the parts
    are counted, and the counts of earlier parts added, so no class has to fit into one task."""
    parts = max(1, rows // RANKED + 1)
    split = rests.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts)))
    sizes = split.groupBy("class", "part").count()
    before = sizes.select("class", "part", (F.sum("count").over(Window.partitionBy("class").orderBy("part")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    return split.withColumn("within", within).join(F.broadcast(before) if parts == 1 else before, ["class", "part"]).withColumn(
        "place", F.col("before") + F.col("within")
    )


def assigned(rests: DataFrame, chosen: list[tuple[np.ndarray, int]], first: int) -> DataFrame:
    """Adds ``sequence_id`` (from ``first``) and ``slot``: where a rest of a class and place stands among the patterns."""
    starts: dict[int, list[int]] = {}
    uses: dict[int, list[tuple[int, int]]] = {}
    base = first
    for pattern, times in chosen:
        for c in np.flatnonzero(pattern).tolist():
            at = starts.setdefault(c, [0])
            uses.setdefault(c, []).append((base, int(pattern[c])))
            at.append(at[-1] + times * int(pattern[c]))
        base += times

    def batches(parts):
        for part in parts:
            sequence, slot = [], []
            for c, place in zip(part.column("class").to_pylist(), part.column("place").to_pylist()):
                i = bisect_right(starts[c], place) - 1
                begin, each = uses[c][i]
                of, rest = divmod(place - starts[c][i], each)
                sequence.append(begin + of)
                slot.append(rest)
            columns = [part.column(n) for n in KEPT] + [part.column("class"), pa.array(slot, pa.int64()), pa.array(sequence, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*KEPT, "class", "slot", "sequence_id"])

    schema = ", ".join(f"{n} long" for n in [*KEPT, "class", "slot", "sequence_id"])
    return rests.select(*KEPT, "class", "place").mapInArrow(batches, schema)


KEPT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def packed(docs: DataFrame, encoder, end_id: int, length: int = LENGTH, unit: int = UNIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for each piece of each row.

    Pieces of a sequence are gapless from offset 0 and hold at most ``length`` ids. A null or empty text is its end id
    alone. A row with a null id is packed like any other, as are repeated rows; other columns are not looked at; an empty
    table gives no pieces. Ranks go by id, start and digest, so equal rows are exchangeable. Full pieces get numbers after
    the packed ones.
    """
    pieces = stored(pieces_of(texts_of(docs, doc_id, text), encoder, end_id, length), "packing-pieces")
    room = length // unit
    rests = pieces.filter(F.col("length") < length).withColumn("class", F.ceil(F.col("length") / unit).cast("long") - 1)
    histogram = rests.groupBy("class").count().collect()  # at most ``length / unit`` rows
    counts = np.zeros(room, np.int64)
    for c, n in histogram:
        counts[c] = n
    chosen = patterns(counts, room)
    sequences = sum(times for _, times in chosen)
    placed = assigned(ranked(rests, int(counts.sum())), chosen, 0)
    along = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "slot")
    placed = placed.select(*KEPT, "sequence_id", (F.sum("length").over(along) - F.col("length")).alias("offset"))
    full = ranked(pieces.filter(F.col("length") == length).withColumn("class", F.lit(0).cast("long")), int(pieces.filter(F.col("length") == length).count()))
    return placed.unionByName(full.select(*KEPT, (F.col("place") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def word_encoder(path: str):
    return lambda: word_coder(path).encode


def op6_packing(spark, sf_dir):
    """All documents, tokenised and packed into sequences of 4096."""
    import public_tokenizers as vocabularies

    return packed(table(spark, sf_dir, "documents"), word_encoder(vocabularies.path("word_bpe_49k.json")), 2)
