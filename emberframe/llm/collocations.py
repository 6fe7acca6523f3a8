"""Phrase collocations by counting quotient filters.

Texts become chunks of word numbers of one language. A phrase that occurs ``least`` times is made of words and of shorter
phrases that do, so words below it get no number, and phrases of n words are counted only where the bits of a map of fixed
size say that both their parts of n - 1 words may be frequent; a wrong yes costs work, never a count. Each task keeps its counts
in quotient filters and writes them in blocks by leading bits of the permuted phrase; blocks of a range meet and merge.
"""

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm import quotient_filter as qf
from emberframe.llm.common import stored, table
from emberframe.llm.words import mixed

LEAST, LONGEST, MOST = 100, 5, 2000
#: Words of a chunk: it ends after the piece of text that reaches this.
CHUNK_WORDS = 2_000_000
#: Entries of a task's filter before it is written; entries of a range, at most, when all shards have met.
SHARD, RANGE = 1_000_000, 1_000_000
#: Bits of the map of frequent phrases: 4 MB.
MAP_BITS = 25
#: Numbers of words are dealt out by this many counters for each language.
COUNTERS = 64

#: Characters that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
_LINES = bytes.maketrans(ENDS, b"\n" * len(ENDS))


def squeezed(ids: np.ndarray) -> bytes:
    """Numbers from -1 on as compressed planes of bytes, those of zeros left out."""
    import zstandard

    planes = (ids + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T
    n = max((k + 1 for k in range(4) if planes[k].any()), default=0)
    return bytes([n]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:n]).tobytes())


def spread(data: bytes) -> np.ndarray:
    import zstandard

    if data[0] == 0:  # nothing but -1, which says nothing
        return np.zeros(0, np.int32)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u4").astype(np.int32) - 1


def _chunk_rows(batches: Iterator[pa.RecordBatch], chunk_words: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33
    open_chunks: dict[str, tuple[dict, list]] = {}

    def row(lang: str) -> pa.RecordBatch:
        nonlocal number
        words, ids = open_chunks.pop(lang)
        number += 1
        ids = np.array(ids, np.int32)
        counts = np.bincount(ids[ids >= 0], minlength=len(words))
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([number], pa.int64()),
            "lang": pa.array([lang], pa.string()),
            "words": pa.array([[w.decode() for w in words]], pa.list_(pa.string())),
            "counts": pa.array([counts], pa.list_(pa.int64())),
            "ids": pa.array([squeezed(ids)], pa.binary()),
        })

    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for piece in text.as_py().encode().lower().translate(_LINES).split(b"\n"):
                if not (found := piece.split()):
                    continue
                if lang not in open_chunks:
                    open_chunks[lang] = {}, []
                words, ids = open_chunks[lang]
                ids += [words.setdefault(w, len(words)) for w in found]
                ids.append(-1)
                held += len(found)
                if len(ids) >= chunk_words:
                    held -= len(ids)
                    yield row(lang)
                elif held >= 4 * chunk_words:  # many languages, none of them with a full chunk
                    for other in list(open_chunks):
                        yield row(other)
                    held = 0
    for lang in list(open_chunks):
        yield row(lang)


def chunked(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Rows ``chunk, lang, words, counts, ids``: the words of a chunk, how often each occurs, and the text as places in
    ``words``, -1 at the end of a piece."""
    # bytes.lower changes A-Z alone, bytes.split parts at ASCII white space, of which space and tab are left
    return docs.mapInArrow(lambda batches: _chunk_rows(batches, chunk_words), "chunk long, lang string, words array<string>, counts array<long>, ids binary")


def numbered_words(chunks: DataFrame, least: int) -> DataFrame:
    """``lang, word, f, id`` of the words that occur ``least`` times in a language; numbers begin at 0 and are nearly dense."""
    words = chunks.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    words = words.withColumn("_counter", F.pmod(F.xxhash64("word"), F.lit(COUNTERS)))
    row = F.row_number().over(Window.partitionBy("lang", "_counter").orderBy("word")) - 1
    return words.withColumn("id", (row * COUNTERS + F.col("_counter")).cast("int")).drop("_counter")


def _without_gaps(ids: np.ndarray) -> np.ndarray:
    """Numbers with one -1 between words that are not neighbours; words without a neighbour left out."""
    known = np.concatenate([[False], ids >= 0, [False]])
    ids = np.where(known[1:-1] & (known[:-2] | known[2:]), ids, -1)
    return ids[(ids >= 0) | np.concatenate([[True], ids[:-1] >= 0])]


def _renumbered(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, ids`` of chunks, with the numbers of the frequent words; -1 between words that no phrase can join."""
    name = F.concat_ws("\0", "lang", "word")
    frequent = chunks.sparkSession.sparkContext.broadcast(_map_of(words.select((F.crc32(name) % (1 << MAP_BITS)).alias("slot"))))  # 4 MB

    def places(batches):
        for batch in batches:
            for chunk, lang, found in zip(*(batch.column(k) for k in range(3))):
                found = found.values
                names = [f"{lang}\0{w}".encode() for w in found.to_pylist()]
                slot = np.fromiter(map(crc32, names), np.int64, len(names)) % (1 << MAP_BITS)
                at = np.flatnonzero(np.frombuffer(frequent.value, np.uint8)[slot >> 3] >> (slot & 7) & 1)
                for k in range(0, len(at), 10_000):
                    part = pa.array(at[k : k + 10_000], pa.int32())
                    same = [pa.array([x.as_py()] * len(part), x.type) for x in (chunk, lang)]
                    yield pa.RecordBatch.from_arrays([*same, part, found.take(part)], ["chunk", "lang", "at", "word"])

    candidates = chunks.select("chunk", "lang", "words").mapInArrow(places, "chunk long, lang string, at int, word string")
    found = candidates.join(words.select("lang", "word", "id"), ["lang", "word"])
    known = found.groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id"))
    both = chunks.select("chunk", "lang", F.size("words").alias("n"), "ids").join(known.hint("merge"), "chunk")

    def renumber(batches):
        for batch in batches:
            out = []
            for n, ids, at, number in zip(*(batch.column(k) for k in range(1, 5))):
                to = np.full(n.as_py() + 1, -1, np.int32)
                to[at.values.to_numpy()] = number.values.to_numpy()
                out.append(squeezed(_without_gaps(to[spread(ids.as_py())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["lang", "ids"])

    return both.select("lang", "n", "ids", "at", "id").mapInArrow(renumber, "lang string, ids binary")


def _slots(lang: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits of the map for phrases of a language, by their packed integers."""
    code = mixed(right + np.uint64(crc32(lang.encode())))
    return (mixed(code ^ left) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _windows(ids: np.ndarray, n: int, bits: int, lang: str, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Packed phrases of ``n`` frequent words that the map lets through."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ok = ids >= 0
    whole = ok[:m].copy()
    for k in range(1, n):
        whole &= ok[k : k + m]
    if frequent is not None:
        at = np.flatnonzero(whole)
        for shift in (0, 1):
            slot = _slots(lang, *qf.packed([ids[at + shift + k] for k in range(n - 1)], bits))
            at = at[frequent[slot >> 3] >> (slot & 7) & 1 == 1]
    else:
        at = np.flatnonzero(whole)
    return qf.packed([ids[at + k] for k in range(n)], bits)


def _counted(texts: DataFrame, n: int, bits: int, range_bits: int, least: int, frequent) -> DataFrame:
    """``lang, ids, f, slot`` of phrases of ``n`` words that occur ``least`` times."""
    half = qf.half_bits(n, bits)
    range_bits = min(range_bits, half)

    def shards(batches):
        held: dict[str, list[qf.Filter]] = {}

        def rows(lang):
            whole = qf.merged(held.pop(lang))
            for number, data in qf.blocks(whole, range_bits):
                yield lang, number, data

        def written(langs):
            for lang in langs:
                found = list(rows(lang))
                for at in range(0, len(found), 1024):
                    names, numbers, data = zip(*found[at : at + 1024])
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(data, pa.binary())], ["lang", "part", "data"])

        for batch in batches:
            for lang, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = spread(ids.as_py())
                left, right = _windows(ids, n, bits, lang, None if frequent is None else np.frombuffer(frequent.value, np.uint8))
                if len(left) == 0:
                    continue
                held.setdefault(lang, []).append(qf.filter_of(*qf.permuted(left, right, half), half))
                if sum(map(len, held[lang])) >= SHARD:
                    held[lang] = [qf.merged(held[lang])]
                    if len(held[lang][0]) >= SHARD // 2:
                        yield from written([lang])
                elif sum(len(f) for fs in held.values() for f in fs) >= 4 * SHARD:
                    yield from written(list(held))
        yield from written(list(held))

    def meet(key, rows):
        lang, number = key[0].as_py(), key[1].as_py()
        whole = qf.merged([qf.read_block(number, d.as_py(), half, range_bits) for d in rows.column("data")])
        often = whole.count >= least
        left, right = qf.restored(whole.left[often], whole.right[often], half)
        ids = qf.unpacked(left, right, n, bits)
        return pa.table({
            "lang": pa.array([lang] * len(ids), pa.string()),
            "ids": pa.array(list(ids.astype(np.int32)), pa.list_(pa.int32())),
            "f": pa.array(whole.count[often], pa.int64()),
            "slot": pa.array(_slots(lang, left, right), pa.int64()),
        })

    blocks = texts.mapInArrow(shards, "lang string, part long, data binary")
    return blocks.groupBy("lang", "part").applyInArrow(meet, "lang string, ids array<int>, f long, slot long")


def _map_of(counted: DataFrame) -> bytes:
    """The bits named in ``slot``. At most 2 ** MAP_BITS bits come to the driver, in parts of 4 KB."""
    x = F.col("slot") + 1
    parts = counted.groupBy(F.bitmap_bucket_number(x).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits"))
    out = bytearray(1 << MAP_BITS - 3)
    for part, bits in parts.collect():
        at = (part - 1) * len(bits)
        out[at : at + len(bits)] = bits
    return bytes(out)


def frequent_phrases(texts: DataFrame, words: DataFrame, n_words: int, least: int, longest: int) -> DataFrame:
    """``lang, ids, f`` of all phrases of 2 to ``longest`` words that occur ``least`` times; one pass over the numbered texts
    for each length."""
    spark = texts.sparkSession
    bits = max(1, int(words.agg(F.max("id")).first()[0] or 0).bit_length())
    range_bits = max(4, (n_words // RANGE).bit_length())
    out, frequent = None, None
    for n in range(2, longest + 1):
        found = stored(_counted(texts, n, bits, range_bits, least, frequent), f"phrases-{n}")
        out = found if out is None else out.unionByName(found)
        if n < longest:
            frequent = spark.sparkContext.broadcast(_map_of(found))  # 4 MB whatever the input
    return out.select("lang", "ids", "f")


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, ids, a, l, r, n, score`` of phrases by their weakest cut, those inside an equally frequent longer one left out."""
    every = phrases.unionByName(words.select("lang", F.array("id").alias("ids"), "f"))
    size = F.size("ids")
    cuts = phrases.select("lang", "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    side = lambda name, count: every.select("lang", F.col("ids").alias(name), F.col("f").alias(count))
    cuts = (
        cuts.withColumn("first", F.slice("ids", F.lit(1), F.col("k")))
        .withColumn("rest", F.slice("ids", F.col("k") + 1, size - F.col("k")))
        .join(side("first", "l"), ["lang", "first"])
        .join(side("rest", "r"), ["lang", "rest"])
        .join(F.broadcast(totals), "lang")  # a row per language
    )
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    cuts = cuts.withColumn("score", F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    weakest = cuts.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = phrases.filter(size > 2).select("lang", "f", "ids", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inside = longer.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("m") + 1), lambda i: F.slice("ids", i, F.col("m")))).alias("ids"))
    inside = inside.groupBy("lang", "ids").agg(F.max("f").alias("_f"))
    kept = weakest.join(inside, ["lang", "ids"], "left").filter("_f IS NULL OR _f < a")
    return kept.select("lang", "ids", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``most`` strongest phrases of 2 to ``longest`` words that
    occur ``least`` times.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the weakest cut, ``n`` all words of the language; the score is
    1000 * a * n / (l * r), rounded down. A-Z count as a-z, pieces end at ``.,;:!?`` and line ends, words at space and tab. A
    null language is ``und``; null, empty and blank texts have no words; every repeated row counts; other columns are not
    looked at; an empty table gives no rows. Ties go to the more frequent phrase, then to the lower one in byte order.
    Holds up to 2 ** (128 // longest) words of ``least`` occurrences or more in a language (33 million at five), and fails
    beyond them. A piece of text without an end mark lies in one chunk.
    """
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chunks = stored(chunked(docs), "phrase-chunks")
    words = stored(numbered_words(chunks, least), "phrase-words")
    totals = chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    totals = stored(totals, "phrase-totals")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    texts = stored(_renumbered(chunks, words), "phrase-texts")
    phrases = stored(frequent_phrases(texts, words, n_words, least, longest), "phrases")
    kept = stored(scored(phrases, words, totals), "phrase-scores")
    named = kept.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    named = named.groupBy("lang", "ids", "a", "l", "r", "n", "score").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir):
    """The phrases of every language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))
