"""Line deduplication: equal lines and lines within some edits, by a segment-partition join. SQL expressions only.

1. Lines with one hash are one line. What follows looks at distinct lines.
2. A line is split into segments, threshold plus one. One of them is as it was, with as many edits before it, at most, as
   there are segments before it, and the rest of the edits behind; so what stands before and what stands behind can be
   split again. The line's length and hashes of such segments are index keys, and a line of that length or up to threshold
   more probes them with what it has in these places, and in those that the edits can have moved them to.
   For one edit that is all parts but one: what stands before the part left out and what stands behind it.
3. Lines that share a key are verified: for one edit the part left out by a banded bit-parallel edit automaton, for more
   whole lines by their edit distance up to the threshold, those of a key with its first line, and what is not near to that
   with all. (The automaton is interpreted step by step, which takes too long for whole lines.)
4. A key that very many lines share is not joined: its lines are split into more parts until few share a key. So are, for
   more than one edit, those of a key on which some lines stand that are unlike: a passage is common to them, but no more.
   These lines are split only in the ways by which they have such keys.
5. Components of the links are the classes; the first line of a class, by document and number, stays.
"""

import json
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import components, stored, table, texts_of

#: The threshold of op10_line_dedup, which its SQL sets, and that of the pipeline.
EDITS, PIPELINE_EDITS = 1, 3
#: Shorter lines, in code points, are compared for equality only: an edit is much to them.
LEAST = 20
#: Lines that may share a key before they are split further, and powers of two of the parts tried one after the other.
SHARED, SPLITS = 64, (2, 5, 8)
#: For more than one edit, how often a line is split into segments, one after the other, and lines of a key that meet in pairs
#: before they are split further, if not all are near the key's first one.
DEPTHS, PAIRED = (1, 2, 3), 8
#: A line that is more than this share of all lines is signed once instead of at each place; there can be no more than so many.
OFTEN = 10_000
#: Ids that are sent to all tasks rather than joined by a shuffle, 8 bytes each.
SENT = 500_000


def within_edits(a: str, b: str, edits: int) -> str:
    """SQL that is true where two strings are at most ``edits`` insertions, deletions and substitutions apart.

    A bit per diagonal of the band (2 * edits + 1 of them) and a word per number of edits: bit d of word e is set while the
    first j + d - edits characters of ``a`` can become the first j of ``b`` by e edits. A character of ``b`` moves all
    diagonals at once; a set bit at the end of ``a`` after the last one is a match."""
    bits = range(2 * edits + 1)
    mask = (1 << (2 * edits + 1)) - 1
    match = " | ".join(f"IF(get(p.x, j + {d - edits}) = get(p.y, j), {1 << d}, 0)" for d in bits)
    words, new = [f"r.w{e}" for e in range(edits + 1)], []
    start = 1 << edits
    starts = [start]
    for e in range(1, edits + 1):
        starts.append((starts[-1] | starts[-1] << 1) & mask)
    for e in range(edits + 1):
        same = f"({words[e]} & ({match}))"
        new.append(same if e == 0 else f"(({same} | {words[e - 1]} | shiftright({words[e - 1]}, 1) | shiftleft({new[e - 1]}, 1)) & {mask})")
    struct = lambda values: "named_struct(" + ", ".join(f"'w{e}', {v}" for e, v in enumerate(values)) + ")"
    last = f"(r.w{edits} & shiftleft(1, size(p.x) - size(p.y) + {edits})) != 0"
    # a step for each character of b; none where it is empty
    steps = "slice(sequence(0, size(p.y)), 1, size(p.y))"
    walk = f"aggregate({steps}, {struct(starts)}, (r, j) -> {struct(new)}, r -> {last})"
    chars = lambda s: f"filter(split({s}, ''), c -> c != '')"
    return f"(abs(length({a}) - length({b})) <= {edits} AND element_at(transform(array(named_struct('x', {chars(a)}, 'y', {chars(b)})), p -> {walk}), 1))"


def lines_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, line_no, line, line_id`` for each line, and more columns of its row; a blank line has no id."""
    split = docs.select("doc_id", *more, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.withColumn("line_id", F.when(F.trim("line") != "", F.xxhash64("line")))


def _row(key: str, size: str, part: str, indexed: bool) -> str:
    """A signature: its key, and what else is needed of it in one number."""
    return f"named_struct('key', {key}, 'about', {size} * 2048L + {part} * 2 + {int(indexed)})"


def segments(edits: int, depth: int, start: int = 0, end: int = 0, low=Fraction(0), high=Fraction(1), path: tuple = ()) -> list[tuple]:
    """(path, choices, segments that are kept) for each way in which ``edits`` edits at most can leave segments of ``low`` to
    ``high`` (shares of the index's line) as they are, when these bounds lie ``start`` and ``end`` places further on in the
    other line. A segment is (low, high, places it is moved by). Ways of one path keep the same segments of the index's line.
    Choices are (i, places moved by, those before, those behind), cut off at ``depth``.

    Of edits + 1 segments take the first, i, such that those up to it have no more than i edits: it has none, those before
    it have i, and those behind it the rest."""
    if abs(end - start) > edits:
        return []
    if edits == 0:
        return [(path, (), [(low, high, start)])]
    if depth == 0:
        return [(path, (), [])]
    found = []
    for i in range(edits + 1):
        a, b = (low + (high - low) * Fraction(i + k, edits + 1) for k in (0, 1))
        for moved in range(start - i, start + i + 1):
            for before, first, left in segments(i, depth - 1, start, moved, low, a, (*path, i)):
                for way, then, right in segments(edits - i, depth - 1, moved, end, b, high, (*before, -1)):
                    found.append((way, (i, moved, first, then), [*left, (a, b, moved), *right]))
    return found


def _cut(choices: tuple, depth: int) -> tuple:
    return (*choices[:2], *(_cut(c, depth - 1) for c in choices[2:])) if depth and choices else ()


def ways(edits: int, depth: int) -> list[dict]:
    """The ways of ``segments`` for partners of the same length and up to ``edits`` shorter. ``of``: the number, among those
    of one depth less, of the way that this one splits further. Where two lines have a key in common by a way, some way that
    splits it is one by which near lines have a key in common, too."""
    number, rows, above = {}, [], {}
    for shorter in range(edits + 1):
        for _, choices, _ in segments(edits, depth - 1, 0, shorter):
            above[shorter, choices] = len(above)
    for shorter in range(edits + 1):
        for path, choices, kept in segments(edits, depth, 0, shorter):
            still = shorter == 0 and all(moved == 0 for *_, moved in kept)
            part = number.setdefault(path, len(number))
            kept = [{"a": a.numerator, "b": a.denominator, "c": b.numerator, "d": b.denominator, "moved": moved} for a, b, moved in kept if a < b]
            rows.append({"way": len(rows), "of": above[shorter, _cut(choices, depth - 1)], "shorter": shorter, "part": part, "indexed": int(still), "kept": kept})
    return rows


def _signed_by_segments(lines: DataFrame, depth: int, edits: int) -> DataFrame:
    """``signed`` for several edits: the segments that are kept. ``about``: the way's number and whether it is the index's side."""
    rows = ways(edits, depth)
    sized = lines.withColumn("n", F.length("line")).filter(F.col("n") >= LEAST)
    if depth > 1:
        # many ways: a table of them, by the way they split further, rather than an expression for each
        kind = "array<array<struct<way: int, shorter: int, part: int, indexed: int, kept: array<struct<a: long, b: long, c: long, d: long, moved: int>>>>>"
        table = [[{k: v for k, v in w.items() if k != "of"} for w in rows if w["of"] == of] for of in range(1 + max(w["of"] for w in rows))]
        piece = "substring(line, CAST((n - w.shorter) * k.a div k.b + k.moved + 1 AS INT), CAST((n - w.shorter) * k.c div k.d - (n - w.shorter) * k.a div k.b AS INT))"
        row = f"named_struct('key', xxhash64(n - w.shorter, w.part, transform(w.kept, k -> {piece})), 'about', w.way * 2L + w.indexed)"
        every = f"transform(flatten(transform(ways, v -> get(from_json('{json.dumps(table)}', '{kind}'), v))), w -> {row})"
    else:
        at = lambda size, up, down: f"CAST({size} * {up} div {down} AS INT)"
        made = []
        for w in rows:
            size = f"(n - {w['shorter']})"
            pieces = [f"substring(line, {at(size, k['a'], k['b'])} + {k['moved'] + 1}, {at(size, k['c'], k['d'])} - {at(size, k['a'], k['b'])})" for k in w["kept"]]
            made.append(f"named_struct('key', xxhash64({', '.join([size, str(w['part']), *pieces])}), 'about', {w['way'] * 2 + w['indexed']}L)")
        every = f"array({', '.join(made)})"
    return sized.select("line_id", F.explode(F.expr(every)).alias("s")).select("s.key", "line_id", "s.about")


def signed(lines: DataFrame, power: int, edits: int = EDITS) -> DataFrame:
    """``key, line_id, about`` for lines (line_id, line): each part left out, for partners of the same length and for those
    up to ``edits`` shorter. ``about`` holds the partner's length, the part (below 1024) and whether it is the index's side.
    ``power``: for one edit, that of two that is the number of parts; for more, how often a line is split: beyond once, by
    those ways alone that split further one of the column ``ways``, numbers of ways of one split less."""
    if edits > 1:
        return _signed_by_segments(lines, power, edits)
    parts = 1 << power
    sized = lines.withColumn("n", F.length("line")).filter(F.col("n") >= LEAST)
    if parts > 4:
        at = lambda n, size: f"CAST(floor({n} * {size} / {parts}) AS INT)"

        def key(size: str) -> str:
            before, behind = at("p", size), f"({size} - {at('(p + 1)', size)})"
            return f"xxhash64({size}, p, substring(line, 1, {before}), IF({behind} = 0, '', right(line, {behind})))"

        rows = [_row(key(size), size, "p", indexed) for size, indexed in (("n", True), ("(n - 1)", False))]
        every = f"flatten(transform(sequence(0, {parts - 1}), p -> array({', '.join(rows)})))"
    else:
        # each part is hashed once, where it stands, and once more one later, for what follows an insertion
        hashed, rows = {}, []
        for size, indexed in (("n", True), ("(n - 1)", False)):
            bound = [f"CAST(floor({i} * {size} / {parts}) AS INT)" for i in range(parts + 1)]
            name = lambda i, late: f"{'i' if indexed else 'p'}{i}{'_late' if late else ''}"
            for i in range(parts):
                for late in {False, not indexed}:
                    hashed[name(i, late)] = F.expr(f"xxhash64(substring(line, {bound[i]} + {1 + late}, {bound[i + 1]} - {bound[i]}))")
            for p in range(parts):
                others = [name(i, i > p and not indexed) for i in range(parts) if i != p]
                rows.append(_row(f"xxhash64({size}, {p}, {', '.join(others)})", size, str(p), indexed))
        sized = sized.withColumns(hashed)
        every = f"array({', '.join(rows)})"
    return sized.select("line_id", F.explode(F.expr(every)).alias("s")).select("s.key", "line_id", "s.about")


def candidates(lines: DataFrame, power: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """For one edit: pairs of ids with where their lines may differ, and the ids on keys that too many share."""
    keys = signed(lines, power).repartition("key")
    many = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("line_id").alias("low"), F.max("line_id").alias("high"))
    many = many.filter("low != high").select("key", "n")
    # few keys are shared: they are the side that is kept in a hash table, and nothing is sorted
    shared = stored(keys.join(many.hint("shuffle_hash"), "key").distinct(), "line-shared")
    joined = shared if last else shared.filter(F.col("n") <= SHARED)
    joined = joined.select("key", "line_id", F.expr("about % 2 = 1").alias("indexed"), F.expr("about div 2 % 1024").alias("part"), F.expr("about div 2048").alias("size"))
    a, b = joined.filter("indexed").alias("a"), joined.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.line_id") != F.col("b.line_id")) & (~F.col("b.indexed") | (F.col("a.line_id") < F.col("b.line_id"))))
    pairs = met.select(
        F.col("a.line_id").alias("a"),
        F.col("b.line_id").alias("b"),
        F.expr(f"CAST(floor(a.part * a.size / {1 << power}) AS INT)").alias("before"),
        F.expr(f"CAST(a.size - floor((a.part + 1) * a.size / {1 << power}) AS INT)").alias("behind"),
    )
    return pairs, shared.filter(F.col("n") > SHARED).select("line_id").distinct()


def _chosen(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (line_id, line) for each of the ids. Few ids are sent to the lines, many are joined by a shuffle."""
    ids = stored(ids, "line-ids")
    few = ids.count() <= SENT
    return lines.select("line_id", "line").join(F.broadcast(ids) if few else ids, "line_id", "left_semi").dropDuplicates(["line_id"])


def shared_keys(lines: DataFrame, depth: int, edits: int) -> DataFrame:
    """``key, line_id, indexed, way, n`` for several edits: the keys that two lines or more have, of ``n`` signatures. ``lines``
    holds each line once.

    The many keys are shuffled alone, eight bytes each, to find the few that are shared; then the lines are signed again and
    what has such a key stays. Lines that are alike but for a few places share the keys of very many ways; keys with the same
    lines become one, as the same lines need no comparing on each. Keys without a line on the index's side go."""
    often = signed(lines, depth, edits).select("key").repartition("key").groupBy("key").agg(F.count("*").alias("n"))
    often = stored(often.filter("n > 1"), "line-keys")
    few = often.count() <= SENT
    rows = signed(lines, depth, edits).join(F.broadcast(often) if few else often, "key")
    rows = stored(rows.select("key", "line_id", F.expr("about % 2 = 1").alias("indexed"), F.expr("about div 2").alias("way"), "n"), "line-shared")
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "line_id", "indexed")).alias(f"mark{seed}") for seed in (0, 1)]
    sets = rows.select("key", "line_id", "indexed", "n").distinct().groupBy("key", "n").agg(F.count("*").alias("lines"), *marks, F.bool_or("indexed").alias("any"))
    sets = stored(sets.filter("any AND lines > 1").drop("any"), "line-sets")
    alike = ["lines", "mark0", "mark1"]
    least = sets.groupBy(*alike).agg(F.min(F.struct("n", "key")).alias("least"))
    named = sets.select("key", *alike).join(least, alike).select("key", "least")
    return stored(rows.drop("n").join(named, "key").select("least.key", "line_id", "indexed", "way", "least.n"), "line-shared")


def _verified(lines: DataFrame, pairs: DataFrame, near: str) -> DataFrame:
    """The pairs ``a, b, before, behind`` whose lines are near between these numbers of characters at either end."""
    pairs = stored(pairs, "line-pairs")
    texts = stored(_chosen(lines, pairs.select(F.col("a").alias("line_id")).union(pairs.select("b")).distinct()), "line-texts")
    both = pairs.join(texts.select(F.col("line_id").alias("a"), F.col("line").alias("left")), "a")
    both = both.join(texts.select(F.col("line_id").alias("b"), F.col("line").alias("right")), "b")
    middle = lambda line: f"substring({line}, before + 1, length({line}) - before - behind)"
    both = both.select("a", "b", F.expr(middle("left")).alias("x"), F.expr(middle("right")).alias("y"))
    return stored(both.filter(near).select("a", "b").distinct(), "line-links")


def _whole_pairs(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(0).alias("before"), F.lit(0).alias("behind")]


def links_by_representatives(lines: DataFrame, rows: DataFrame, near: str, most: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Links that connect all lines which pairs on one key connect, of which one at least is on the index's side. A key's first
    such line is compared with all others on it; those it is near to need no comparing with each other. Only the others are
    compared with the rest, so the copies of a line take as many links as there are copies. Where there are others on a key of
    more than ``most`` signatures, they are not: its ``rows`` come second, to be split further, links among them included. So
    on such a key a few lines are compared with the first before the rest are."""
    once = rows.select("key", "line_id", "indexed", "n").distinct()
    pair = _whole_pairs(F.col("first"), F.col("line_id"))
    near_first = (F.least("first", "line_id") == F.col("a")) & (F.greatest("first", "line_id") == F.col("b"))
    by_hash = F.xxhash64("line_id")
    first = once.groupBy("key").agg(
        F.min(F.when(F.col("indexed"), F.col("line_id"))).alias("first"),
        F.array_distinct(F.array(F.max("line_id"), F.min_by("line_id", by_hash), F.max_by("line_id", by_hash))).alias("some"),
        F.max("n").alias("n"),
    )
    first = stored(first.filter("first IS NOT NULL"), "line-first")
    links, split = [], None
    if most is not None:
        some = first.filter(F.col("n") > most).select("key", "first", F.explode("some").alias("line_id")).filter("line_id != first")
        links.append(_verified(lines, some.select(*pair).distinct(), near))
        split = stored(some.join(links[0], near_first, "left_anti").select("key").distinct(), "line-unlike")
        once = once.join(split, "key", "left_anti")
    spokes = stored(once.join(first.select("key", "first"), "key").filter("line_id != first"), "line-spokes")
    stars = _verified(lines, spokes.select(*pair).distinct(), near)
    apart = stored(spokes.join(stars, near_first, "left_anti"), "line-apart")
    wide = F.lit(False) if most is None else F.col("n") > most
    u, x = apart.filter(~wide).alias("u"), spokes.alias("x")
    met = u.join(x, (F.col("u.key") == F.col("x.key")) & (F.col("u.line_id") != F.col("x.line_id")) & (F.col("u.indexed") | F.col("x.indexed")))
    links += [stars, _verified(lines, met.select(*_whole_pairs(F.col("u.line_id"), F.col("x.line_id"))).distinct(), near)]
    unlike = apart.filter(wide).select("key").distinct()
    return links, rows.join(unlike if split is None else unlike.union(split), "key", "left_semi")


def line_links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """``a, b``: ids of lines within ``edits`` edits, such that lines connected by such links are connected by these."""
    if edits > 1:
        return _links_of_several_edits(lines, edits)
    counts = lines.filter("line_id IS NOT NULL").groupBy("line_id").count()
    total = lines.count()
    often = counts.filter(F.col("count") > max(1, total // OFTEN)).select("line_id")
    often = stored(often, "line-often")
    rare = lines.filter("line_id IS NOT NULL").join(F.broadcast(often), "line_id", "left_anti").select("line_id", "line")
    to_sign = rare.unionByName(_chosen(lines, often))
    links = []
    for power in SPLITS:
        last = power == SPLITS[-1]
        pairs, crowded = candidates(to_sign, power, last)
        links.append(_verified(lines, pairs, within_edits("x", "y", 1)))
        if last:
            break
        crowded = stored(crowded, "line-crowded")
        if crowded.isEmpty():
            break
        to_sign = stored(_chosen(lines, crowded), "line-crowd")
    return reduce(DataFrame.unionByName, links)


def _links_of_several_edits(lines: DataFrame, edits: int) -> DataFrame:
    to_sign = stored(lines.filter("line_id IS NOT NULL").filter(F.length("line") >= LEAST).select("line_id", "line").dropDuplicates(["line_id"]), "line-distinct")
    links, texts, near = [], to_sign, f"levenshtein(x, y, {edits}) >= 0"
    for depth in DEPTHS:
        last = depth == DEPTHS[-1]
        shared = shared_keys(to_sign, depth, edits)
        # what many share at first is mostly a passage; later it is mostly copies, which their first one sorts out
        crowd = F.col("n") > SHARED if depth == DEPTHS[0] else F.lit(False)
        found, unlike = links_by_representatives(texts, shared.filter(~crowd), near, None if last else min(PAIRED, SHARED))
        links += found
        if last:
            break
        crowded = shared.filter(crowd).unionByName(unlike).groupBy("line_id").agg(F.collect_set("way").alias("ways"))
        crowded = stored(crowded, "line-crowded")
        if crowded.isEmpty():
            break
        # few lines with very many ways each: dealt out, as a task signs few of them
        tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chosen = _chosen(texts, crowded.select("line_id"))
        to_sign = stored(chosen.join(crowded, "line_id").repartition(tasks, "line_id"), "line-crowd")
    return reduce(DataFrame.unionByName, links)


def line_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """``doc_id, line_no, first_doc_id, first_line_no, kept`` for each line of each row of ``docs``.

    Lines are what newlines part, numbered from 0. Equal lines are in one class, and so are lines of LEAST or more code
    points that a chain of lines connects, each within ``edits`` edits (1 or more) of the next. ``first_*``: the class's first line by doc_id (nulls first), then number;
    ``kept``: this is it. Blank lines are in no class and kept. A null or empty text is one blank line. Repeated rows have
    the same lines in the same places, so they are kept or not alike. Other columns are not looked at; an empty table
    gives no rows.
    """
    own = F.struct("doc_id", "line_no")
    return (
        _first_places(lines_of(texts_of(docs, doc_id, text)), ["doc_id", "line_no"], edits)
        .select("doc_id", "line_no", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), F.col("first").eqNullSafe(own).alias("kept"))
    )


def _first_places(lines: DataFrame, place: list[str], edits: int) -> DataFrame:
    """The columns ``place``, which order the lines and tell them apart, and ``first``, those of the first line of the class."""
    roots = components(line_links(lines, edits), "line-classes")
    first = lines.filter("line_id IS NOT NULL").groupBy("line_id").agg(F.min(F.struct(*place)).alias("first"))
    linked = first.join(roots, F.col("line_id") == F.col("node")).select("line_id", "component", "first")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    linked = linked.join(least, "component").select("line_id", "least")
    named = first.join(linked, "line_id", "left").select("line_id", F.coalesce("least", "first").alias("first"))
    return lines.select(*place, "line_id").join(named, "line_id", "left").select(*place, F.coalesce("first", F.struct(*place)).alias("first"))


def without_repeated_lines(docs: DataFrame, edits: int = PIPELINE_EDITS) -> DataFrame:
    """``docs`` (doc_id, text, ...) without lines that are not kept, within ``edits`` edits; ``n_chars``, if there, counted anew. A row that held
    lines and has none left goes: every line of it is elsewhere. Rows are told apart by id and text, so rows without id and
    those that share one lose their own lines only; repeated rows lose the same."""
    texts = texts_of(docs)
    row = F.xxhash64("text").alias("row")
    # the number before the row: where an id repeats, the order of lines is that of line_classes
    place = ["doc_id", "line_no", "row"]
    lines = lines_of(texts.select("doc_id", "text", row), "row")
    lost = _first_places(lines, place, edits).filter(~F.col("first").eqNullSafe(F.struct(*place)))
    lost = lost.groupBy(F.col("doc_id").alias("__doc_id"), F.col("row").alias("__row")).agg(F.collect_set("line_no").alias("__lost"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id"))
    same &= F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("__row")
    joined = docs.join(lost, same, "left")
    left = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains(__lost, i)), '\\n')")
    text = F.when(F.col("__lost").isNull(), F.col("text")).otherwise(left)
    joined = joined.withColumn("__text", text).filter(F.col("__lost").isNull() | (F.trim("__text") != ""))
    size = F.when(F.col("__lost").isNull(), F.col("n_chars")).otherwise(F.length("__text").cast("long")) if "n_chars" in docs.columns else None
    of = {"text": F.col("__text"), "n_chars": size}
    return joined.select(*[of.get(n, F.col(n)).alias(n) if n in of else F.col(n) for n in docs.columns])


def op10_line_dedup(spark, sf_dir):
    """The class of every line of every document, and whether it is the one that stays."""
    return line_classes(table(spark, sf_dir, "documents"))
