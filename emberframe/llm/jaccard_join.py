"""N-gram Jaccard join: documents whose sets of word shingles are alike, by T-occurrence search (DivideSkip).

1. Each document becomes its set of shingle hashes; documents with one set are one class from here on.
2. Prefix filter: two sets that reach the threshold share one of the first tokens of each in any common order. The
   order puts frequent tokens last, by a sketch of fixed size. Sets that are near enough in size meet on a prefix token that
   few have; their pairs stay whose number of shared prefix tokens allows a link.
3. Each component of these pairs is searched: inverted lists of its sets, each set in turn the query. Short lists are merged,
   the long ones are probed, sets that reach the required overlap are links. A task returns links that connect what it has
   found connected, not every pair. In a component too large for one task each set is searched among its partners.
   Sets on a token that many have meet again on signatures: hashes of all their tokens in one part of the token space, so many
   parts that sets that link agree in some. Where many share a signature too they are chained to crowds, which are dealt out in
   blocks, each with the crowd's first set; only sets that are not in the crowd's largest component then are compared with those
   of other blocks.
4. Components of the links are the classes of near copies.
"""

from functools import cache
from itertools import chain
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import GATHERED, components, stored, table, texts_of
from emberframe.llm.words import chunks, mixed, shingles, words_of

WIDTH = 5
#: Threshold as a fraction, so that it is exact.
LIKE, OF = 80, 100
#: Shingles in a search block, and documents; a component or crowd beyond either is taken apart.
BLOCK_TOKENS, BLOCK_DOCS = 1 << 19, 512
#: A token this often in one batch of texts is reported. The reports are added up in so many cells, a byte each, whatever
#: the size of the corpus; tokens come in the order of their cell's logarithm. The order changes the work, never the links.
OFTEN, CELLS = 3, 1 << 20
#: Tokens of texts looked at together for that, 8 bytes each.
HELD = 1 << 22
#: Documents to be searched that are told to all tasks rather than joined by a shuffle of the texts, 32 bytes each.
SENT = 500_000
#: Sets on one prefix token that meet in pairs; where more have it they are a crowd.
CROWD = 64
#: Ways to cut the token space into parts; the next is taken where a set leaves too many parts of one empty.
WAYS = 3
#: How costly a probe is against a merge step; the value that the method's authors give.
MU = 0.0085
#: Long lists probed together.
PROBED = 64


def needed(n: int, like: int, of: int) -> int:
    """Overlap that a set of ``n`` needs with any partner: the threshold's share of the larger set."""
    return -(-like * n // of)


def divide_skip(query: np.ndarray, tokens: np.ndarray, first: np.ndarray, docs: np.ndarray, keys: np.ndarray, n_docs: int, least: int):
    """Documents that share at least ``least`` tokens with ``query``, and how many.

    ``docs[first[i]:first[i + 1]]`` is the ascending list of ``tokens[i]``, ``keys`` are i * n_docs + doc in the same order.
    The longest lists are set aside, the others merged; documents that could still reach ``least`` are looked up in the
    long lists by bisection, some lists at a time, and given up when they cannot reach it any more.
    """
    none = np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(tokens, query), len(tokens) - 1)
    at = at[tokens[at] == query]
    if len(at) < least:
        return none, none
    sizes = first[at + 1] - first[at]
    n_long = min(least - 1, int(least / (MU * log2(max(2, sizes.max())) + 1)))
    order = np.argsort(sizes, kind="stable")
    short, long = at[order[: len(at) - n_long]], at[order[len(at) - n_long :]]
    lengths = first[short + 1] - first[short]
    spread = np.arange(lengths.sum()) + np.repeat(first[short] - (np.cumsum(lengths) - lengths), lengths)
    seen = np.bincount(docs[spread], minlength=n_docs)
    found = np.flatnonzero(seen >= max(1, least - n_long))
    seen = seen[found]
    for begin in range(0, n_long, PROBED):
        if not len(found):
            break
        some = long[begin : begin + PROBED]
        wanted = some[:, None] * n_docs + found[None, :]
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        seen = seen + (keys[place] == wanted).sum(axis=0)
        hope = seen + max(0, n_long - begin - PROBED) >= least
        found, seen = found[hope], seen[hope]
    return found, seen


def links_within(sets: list[np.ndarray], side: np.ndarray, like: int = LIKE, of: int = OF) -> list[tuple[int, int]]:
    """Links that connect all sets connected by pairs reaching the threshold, found by searching for each set.

    ``side``: block of each set. With two blocks only pairs across them are looked for."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    across = side.min() != side.max()
    indexed = np.flatnonzero(side == side.max()) if across else np.arange(n)
    flat = np.concatenate([sets[i] for i in indexed])
    owner = np.repeat(indexed, sizes[indexed])
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    tokens, first = flat[first], np.append(first, len(flat))
    keys = np.repeat(np.arange(len(tokens)), np.diff(first)) * n + owner
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links = []
    for q in np.flatnonzero(side == side.min()) if across else range(n):
        found, shared = divide_skip(sets[q], tokens, first, owner, keys, n, needed(int(sizes[q]), like, of))
        alike = (of * shared >= like * (sizes[q] + sizes[found] - shared)) & (found != q)
        for d in found[alike].tolist():
            a, b = root(int(q)), root(d)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(q), d))
    return links


def _sets(ids: list, texts: list[str], width: int):
    """(id, ascending distinct shingles) of each text."""
    for some, raw in chunks(ids, [t.encode() for t in texts]):
        yield from zip(some, shingles(words_of(raw), width))


def _print(tokens: np.ndarray) -> tuple[int, int]:
    """The sum and the exclusive or of a set's hashes, which are spread evenly: together they tell one set from another."""
    return int(tokens.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(tokens).astype(np.int64))


def _long(values) -> pa.Array:
    return pa.array(values, pa.int64())


def shingle_prints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document (doc_id, text, row) (``kind`` 0: key its row's number, ``one`` and ``two`` its set's prints, ``n``
    its size; ``kind`` 2 in place of 0 where it has no id) and one per token and some texts that have it often (``kind`` 1: key the token, ``n`` how often), from a single pass over the texts."""

    def reported(held: list[tuple]) -> pa.RecordBatch:
        every, times = np.unique(np.concatenate([*(s for *_, s in held), np.zeros(0, np.uint64)]), return_counts=True)
        every, times = every[times >= OFTEN], times[times >= OFTEN]
        prints = [_print(s) for *_, s in held]
        zero = [0] * len(every)
        return pa.RecordBatch.from_arrays(
            [
                _long([2 if d is None else 0 for d, *_ in held] + [1] * len(every)),
                _long([row for _, row, _ in held] + every.astype(np.int64).tolist()),
                _long([p[0] for p in prints] + zero),
                _long([p[1] for p in prints] + zero),
                _long([len(s) for *_, s in held] + times.tolist()),
            ],
            ["kind", "key", "one", "two", "n"],
        )

    def batches(parts):
        for part in parts:
            held, size = [], 0
            known = list(zip(part.column(0).to_pylist(), part.column(2).to_pylist()))
            for (d, row), s in _sets(known, part.column(1).to_pylist(), width):
                held.append((d, row, s))
                size += len(s)
                if size >= HELD:
                    yield reported(held)
                    held, size = [], 0
            if held:
                yield reported(held)

    return docs.mapInArrow(batches, "kind long, key long, one long, two long, n long")


def frequencies(reports: DataFrame) -> np.ndarray:
    """The logarithm of how often the tokens of each cell were reported, from rows ``key, n``."""
    cell = F.pmod("key", F.lit(CELLS)).cast("int")
    level = (F.floor(F.log2(F.sum("n"))) + 1).cast("int")
    rows = reports.groupBy(cell.alias("cell")).agg(level.alias("level")).toPandas()  # CELLS rows at most
    levels = np.zeros(CELLS, np.uint8)
    levels[rows["cell"].to_numpy(np.int64)] = rows["level"].to_numpy(np.uint8)
    return levels


def prefix_tokens(docs: DataFrame, levels: np.ndarray, width: int, like: int, of: int) -> DataFrame:
    """``token, set_id, n``: the first tokens of each set in the common order, rare ones first; a set once per batch."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def batches(parts):
        for part in parts:
            rows, known = [], set()
            for _, s in _sets(part.column(0).to_pylist(), part.column(1).to_pylist(), width):
                if not len(s):
                    continue
                one = _print(s)[0]
                if one in known:
                    continue
                known.add(one)
                take = len(s) - needed(len(s), like, of) + 1
                level = sent.value[s & np.uint64(CELLS - 1)]
                rows.append((s[np.argsort(level, kind="stable")[:take]], one, len(s)))
            counts = [len(r[0]) for r in rows]
            tokens = np.concatenate([*(r[0] for r in rows), np.zeros(0, np.uint64)]).astype(np.int64)
            spread = lambda k: np.repeat(np.array([r[k] for r in rows], np.int64), counts)
            yield pa.RecordBatch.from_arrays([_long(tokens), _long(spread(1)), _long(spread(2))], ["token", "set_id", "n"])

    return docs.mapInArrow(batches, "token long, set_id long, n long")


@cache
def _classes(least: int, like: int, of: int) -> tuple[int, ...]:
    """Smallest sizes of the size classes, up to the first above ``least``: sets that link are in one class or in neighbouring ones."""
    firsts = [1, 1 * of // like + 1]
    while firsts[-1] <= least:
        firsts.append(firsts[-1] * of // like + 1)
    return tuple(firsts)


def signatures(tokens: np.ndarray, levels: np.ndarray, like: int, of: int) -> np.ndarray:
    """Hashes of which sets that link share one, from a set's tokens; ``levels`` puts rare ones first.

    Sets that link, the smaller of ``n`` tokens, differ in ``n * (of - like) / like`` tokens at most. With the token space in
    that many parts, ``most``, and more, they agree in all parts but ``most``. A signature is a hash of the tokens of a part that
    has some. Of those a set needs the rarest only, ``most + 1``: each has so few beyond them that the rarest one they share is not
    among these. A set with too many empty parts gives all it has, and those of another way to cut; a pair that no part with
    tokens brings together is made of two such sets. After the last way empty parts count too. A set takes the number of
    parts of its own size class, for partners in it or the next, and that of the class before.
    """
    firsts = _classes(1 << (len(tokens) - 1).bit_length(), like, of)
    own = int(np.searchsorted(firsts, len(tokens), side="right")) - 1
    level = levels[tokens & np.uint64(CELLS - 1)]
    out = []
    for size_class in (own, own - 1):
        most = (firsts[size_class + 1] - 1) * (of - like) // like if size_class >= 0 else 0
        if not most:  # only equal sets would link
            continue
        parts = most + most // 4 + 4
        for way in range(WAYS):
            salt = np.uint64(size_class * WAYS + way + 1)
            h = mixed(tokens ^ mixed(np.array([salt])))
            part = (h >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
            full = part[order][first]
            sign = mixed(np.add.reduceat(mixed(h[order]), first) ^ mixed(full * np.uint64(256) + salt))
            rank = np.minimum.reduceat(level[order], first)
            out.append(sign[np.lexsort((sign, rank))[: most + 1]])
            if len(full) > most:
                break
        else:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), full)
            out.append(mixed(empty * np.uint64(256) + salt))
    return np.concatenate([*out, tokens[:0]])


def set_signatures(docs: DataFrame, levels: np.ndarray, width: int, like: int, of: int) -> DataFrame:
    """``token, set_id, n``: in place of tokens the signatures of sets, from rows (set_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def batches(parts):
        for part in parts:
            found = [
                (signatures(s, sent.value, like, of), one, len(s))
                for one, s in _sets(part.column(0).to_pylist(), part.column(1).to_pylist(), width)
                if len(s) and _print(s)[0] == one  # not another text whose row has the same number
            ]
            counts = [len(f[0]) for f in found]
            signed = np.concatenate([*(f[0] for f in found), np.zeros(0, np.uint64)]).astype(np.int64)
            spread = lambda k: np.repeat(np.array([f[k] for f in found], np.int64), counts)
            yield pa.RecordBatch.from_arrays([_long(signed), _long(spread(1)), _long(spread(2))], ["token", "set_id", "n"])

    return docs.select("set_id", "text").mapInArrow(batches, "token long, set_id long, n long")


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, like: int = LIKE, of: int = OF
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    Words are lower-cased runs of non-space; a set holds the distinct runs of ``width`` words, all words as one where
    there are fewer. Sets link when ``of * intersection >= like * union``; component_id is the smallest doc_id reachable.
    A null, empty or blank text has no set and links with nothing. Copies and repeated rows are one set. A row without id
    counts as a member but names no component; a component of such rows has none. Rows that share an id keep their own
    sets. Other columns are not looked at; an empty table gives no rows.
    """
    # a row's number: its id, or a hash of its text where it has none
    docs = texts_of(docs, doc_id, text).withColumn("row", F.coalesce("doc_id", F.xxhash64("text")))
    seen = stored(shingle_prints(docs, width), "shingle-prints")
    prints = seen.filter("kind != 1").select(F.expr("IF(kind = 0, key, NULL)").alias("doc_id"), F.col("key").alias("row"), F.col("one").alias("set_id"), "two", "n")
    levels = frequencies(seen.filter("kind = 1"))

    # one row of each set
    sets = stored(prints.filter("n > 0").groupBy("set_id").agg(F.min("row").alias("row"), F.max("n").alias("n")), "jaccard-sets")
    rows = sets.select("set_id", "row")

    def signed(some: DataFrame) -> DataFrame:
        some = stored(some.join(rows, "set_id"), "jaccard-signed")
        texts = docs.select("row", "text").join(F.broadcast(some) if some.count() <= SENT else some, "row")
        return set_signatures(texts, levels, width, like, of)

    pieces, crowds, tokens = _searches(prefix_tokens(docs, levels, width, like, of), sets, like, of, signed)

    # searches within one task are put together by chance, pairs of blocks are groups of their own
    buckets = tokens // BLOCK_TOKENS + 1
    bucket = F.pmod(F.xxhash64("component"), F.lit(buckets))
    group = F.when(F.col("high") <= 0, bucket).otherwise(F.xxhash64("component", "low", "high"))

    def links_of(roles: DataFrame) -> DataFrame:
        roles = stored(roles.join(rows, "set_id"), "jaccard-roles")
        held = roles.groupBy("row", "set_id", group.alias("group")).agg(F.collect_list(F.struct(*PLACE)).alias("roles"))
        # the texts travel, not their sets: they are shorter, and Spark compresses them
        sent = docs.select("row", "text").join(F.broadcast(held) if roles.count() <= SENT else held, "row")
        return sent.select("group", "set_id", "roles", "text").groupBy("group").applyInArrow(_searched(width, like, of), "a long, b long")

    roots = components(links_of(pieces.unionByName(_dealt(crowds))), "jaccard-first", GATHERED)
    if not crowds.isEmpty():
        more = links_of(_rest_dealt(crowds, roots))
        roots = components(roots.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "jaccard-links", GATHERED)

    # the smallest document of each component
    least = prints.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    linked = roots.join(least, F.col("node") == F.col("set_id")).select("set_id", "component", "least")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(named, "component").select("set_id", F.col("component_id").alias("by_link"))
    alone = least.withColumnRenamed("least", "by_set")
    return (
        prints.join(alone.join(linked, "set_id", "left"), "set_id", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("by_link", "by_set")).alias("component_id"),
        )
    )


#: Where a set takes part in a search: the search, the pair of blocks, and the set's own block.
PLACE = ["component", "low", "high", "block"]


def _blocks(members: DataFrame) -> DataFrame:
    """``component, blocks``: how many blocks the sets (component, n) of each component make."""
    size = F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_TOKENS)
    return members.groupBy("component").agg(F.ceil(size).cast("int").alias("blocks"))


def met(rows: DataFrame, like: int, of: int, crowd: int | None = None) -> DataFrame:
    """``kind, a, b`` from the sets (token, set_id, n) of each token, read as one sorted stream. Kind 0: two sets on a token that
    ``crowd`` sets (CROWD, if left out) at most have; kind 1: neighbours in size on one that more have; kind 2: a set (twice) on
    such a token. Sizes allow a link. No more than ``crowd`` sets of a token are held."""
    crowd = crowd or CROWD

    def found(t, s, n, many, new):
        out = [(2, s[many & new], s[many & new])]
        for k in range(1, crowd):
            same = t[k:] == t[:-k]
            if not same.any():
                break
            near = same & (of * n[:-k] >= like * n[k:])
            out.append((0, s[:-k][near & ~many[k:]], s[k:][near & ~many[k:]]))
            if k == 1:
                out.append((1, s[:-1][near & many[1:]], s[1:][near & many[1:]]))
        kinds = np.repeat([o[0] for o in out], [len(o[1]) for o in out])
        x, y = (np.concatenate([o[i] for o in out]) for i in (1, 2))
        return pa.RecordBatch.from_arrays([_long(kinds), _long(np.minimum(x, y)), _long(np.maximum(x, y))], ["kind", "a", "b"])

    def batches(parts):
        # rows of the last token so far; whether it has had more than crowd, of which only the last is here, and is told
        held, crowded = np.zeros((3, 0), np.int64), False
        for part in chain(parts, [None]):
            if part is not None:
                held = np.concatenate([held, np.array([part.column(i).to_numpy() for i in range(3)])], axis=1)
            if not held.shape[1]:
                continue
            held = held[:, np.concatenate([[True], (held[:2, 1:] != held[:2, :-1]).any(axis=0)])]
            t = held[0]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            sizes = np.diff(np.append(first, len(t)))
            large = sizes + np.where(np.arange(len(sizes)) == 0, crowd * crowded, 0) > crowd
            new = np.ones(len(t), bool)
            new[0] = not crowded
            done = len(t) if part is None or large[-1] else first[-1]
            if done:
                yield found(*held[:, :done], np.repeat(large, sizes)[:done], new[:done])
            crowded = bool(part is not None and large[-1])
            held = held[:, -1:] if crowded else held[:, done:]

    dealt = rows.repartition("token").sortWithinPartitions("token", "n", "set_id")
    return dealt.mapInArrow(batches, "kind long, a long, b long")


def _may_link(like: int, of: int) -> str:
    """SQL: whether sets of ``n_a`` and ``n_b`` tokens may link that share ``shared`` tokens of their prefixes, and at most the
    lesser of ``many_a`` and ``many_b`` beside these.

    Of the two prefixes let A's end first in the common order. A token of both sets that is in A's prefix is in B's too; the
    others are in the rest of A, and that is one less than the overlap A needs."""
    # needed(n) - 1, where needed is the quotient rounded up
    rest = f"greatest(({like} * n_a - 1) div {of}, ({like} * n_b - 1) div {of})"
    return f"(shared + least(many_a, many_b) + {rest}) * ({like} + {of}) >= {like} * (n_a + n_b)"


def _searches(prefixes: DataFrame, sets: DataFrame, like: int, of: int, signed) -> tuple[DataFrame, DataFrame, int]:
    """``set_id`` and PLACE for the searches that pairs on rare tokens and signatures need, the crowds (``set_id, component, n``),
    and how many tokens the first have. ``prefixes``: token, set_id, n; ``sets``: row, set_id, n; ``signed`` makes the signatures
    of sets (set_id)."""
    counts = stored(met(prefixes, like, of).groupBy("kind", "a", "b").agg(F.count("*").alias("shared")), "jaccard-met")
    many = counts.filter("kind = 2").select(F.col("a").alias("set_id"), F.col("shared").alias("many"))
    sets = sets.select("set_id", "n").join(many, "set_id", "left").select("set_id", "n", F.coalesce("many", F.lit(0)).alias("many"))
    side = lambda x: sets.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("many").alias(f"many_{x}"))
    pairs = counts.filter("kind = 0").join(side("a"), "a").join(side("b"), "b").filter(_may_link(like, of))
    chains, pairs = counts.filter("kind = 1").select("a", "b"), pairs.select("a", "b")
    # below three quarters sets that link may differ in more tokens than one of them has parts
    if 4 * like >= 3 * of and not chains.isEmpty():
        # sets on a signature are mostly near copies, whose pairs grow with the square of their number: they are a crowd sooner
        again = stored(met(signed(many.select("set_id")), like, of, max(2, CROWD // 2)).select("kind", "a", "b").distinct(), "jaccard-met-signed")
        chains = again.filter("kind = 1").select("a", "b")
        pairs = pairs.unionByName(again.filter("kind = 0").select("a", "b")).distinct()
    pairs = stored(pairs, "jaccard-pairs")
    # what is left is mostly groups of near copies, each searched in one piece
    groups = components(pairs, "jaccard-groups", GATHERED).withColumnRenamed("node", "set_id").join(sets.select("set_id", "n"), "set_id")
    groups = stored(groups.join(_blocks(groups), "component"), "jaccard-groups")
    place = lambda low, own: [F.lit(low).alias("low"), F.lit(low).alias("high"), F.lit(own).alias("block")]
    pieces = groups.filter("blocks = 1").select("set_id", "component", *place(0, 0))
    # in those that are still large a search of its own for each set with partners: the set is block 0, they are block 1; its
    # number is below 0
    still = pairs.join(groups.filter("blocks > 1").select(F.col("set_id").alias("a")), "a", "left_semi")
    stars = still.select(F.col("b").alias("set_id"), F.col("a").alias("component"), *place(-1, 1)).unionByName(
        still.select(F.col("a").alias("set_id"), F.col("a").alias("component")).distinct().select("*", *place(-1, 0))
    )
    crowds = components(chains, "jaccard-crowds", GATHERED).select(F.col("node").alias("set_id"), "component")
    tokens = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return pieces.unionByName(stars), stored(crowds.join(sets.select("set_id", "n"), "set_id"), "jaccard-crowded"), tokens


def _dealt(crowds: DataFrame) -> DataFrame:
    """``set_id`` and PLACE that have each block of a crowd (set_id, component, n) searched by itself, the crowd's first set
    with each. Blocks are numbered from 1, as 0 is a component in one piece."""
    blocks = _blocks(crowds)
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks").cast("long")).cast("int") + 1
    rows = crowds.join(blocks, "component").select("set_id", "component", own.alias("block"))
    first = crowds.groupBy("component").agg(F.min("set_id").alias("set_id")).join(blocks, "component")
    rows = rows.unionByName(first.select("set_id", "component", F.explode(F.sequence(F.lit(1), "blocks")).alias("block")))
    return rows.distinct().select("set_id", "component", F.col("block").alias("low"), F.col("block").alias("high"), "block")


def _rest_dealt(crowds: DataFrame, roots: DataFrame) -> DataFrame:
    """``set_id`` and PLACE for what is left to compare in crowds after the first searches: ``roots`` (node, component) are the
    components of their links. The sets of a crowd's largest component need no comparing with each other. The others make
    blocks that come first; pairs of blocks, of which one at least is theirs, are searched."""
    named = crowds.join(roots.select(F.col("node").alias("set_id"), F.col("component").alias("root")), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    largest = named.groupBy("component", "root").count().groupBy("component").agg(F.max(F.struct("count", "root")).alias("top"))
    split = named.join(largest, "component").select("set_id", "component", "n", (F.col("root") != F.col("top.root")).alias("apart"))
    size = lambda apart: F.ceil(F.greatest(F.count_if(apart) / BLOCK_DOCS, F.sum(F.when(apart, F.col("n")).otherwise(0)) / BLOCK_TOKENS)).cast("int")
    counts = split.groupBy("component").agg(size(F.col("apart")).alias("ours"), size(~F.col("apart")).alias("theirs")).filter("ours > 0")
    hashed = lambda n: F.pmod(F.xxhash64("set_id"), F.col(n).cast("long")).cast("int")
    own = F.when(F.col("apart"), hashed("ours")).otherwise(F.col("ours") + hashed("theirs"))
    rows = split.join(counts, "component").withColumn("block", own)
    others = F.when(F.col("apart"), F.col("ours") + F.col("theirs")).otherwise(F.col("ours"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return rows.select("set_id", "component", *[(f("block", "other") + 1).alias(n) for f, n in ((F.least, "low"), (F.greatest, "high"))], (F.col("block") + 1).alias("block"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` (doc_id, text, ...) of each component: that of the smallest doc_id, one without id where no row has
    one. Rows are told apart by id and text: where an id repeats, unlike texts stay and true copies go."""
    row = F.xxhash64(F.col("doc_id").cast("long").isNull(), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row"))
    found = jaccard_components(rows, "row").select(F.col("doc_id").alias("row"), "component_id")
    named = found.join(rows.select("row", "doc_id"), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    kept = docs.withColumn("__row", row).join(first.select(F.col("first.row").alias("__row")), "__row", "left_semi")
    return kept.dropDuplicates(["__row"]).select(*docs.columns)


def _searched(width: int, like: int, of: int):
    def search(group: pa.Table) -> pa.Table:
        # a text is here once, however many searches of the group it takes part in
        wanted, texts = group["set_id"].to_pylist(), group["text"].to_pylist()
        sets: dict[int, np.ndarray] = {}
        for at, s in _sets(range(len(texts)), texts, width):
            # a row whose set is another one, where a row's number repeats, is left out
            if len(s) and _print(s)[0] == wanted[at]:
                sets[wanted[at]] = s
        rows: dict[tuple, dict[int, int]] = {}
        for set_id, roles in zip(wanted, group["roles"].to_pylist()):
            if set_id in sets:
                for r in roles:
                    rows.setdefault((r["component"], r["low"], r["high"]), {})[set_id] = r["block"]
        a, b = [], []
        for held in rows.values():
            names = sorted(held)
            for i, j in links_within([sets[x] for x in names], np.array([held[x] for x in names]), like, of):
                a.append(names[i])
                b.append(names[j])
        return pa.table({"a": _long(a), "b": _long(b)})

    return search


def op8_ngram_jaccard(spark, sf_dir):
    """Near copies among all documents: five-word shingles, similarity 0.8 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"))
