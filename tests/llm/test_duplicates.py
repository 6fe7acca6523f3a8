"""Duplicate detection: Jaccard join, line dedup and suffix dedup against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import common, jaccard_join, line_dedup, suffix_dedup
from emberframe.llm.common import components
from emberframe.llm.words import shingles, words_of
from odd_rows import ODD


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^ \t-\r]+", lower(text))


def test_words():
    r = random.Random(2)
    texts = ["", " ", "a", "A a\x1cb\x0bc É é", "x " * 40] + ["".join(r.choices("ab  \n\téß.", k=r.randint(0, 60))) for _ in range(200)]
    got = shingles(words_of([t.encode() for t in texts]), 3)
    for t, s in zip(texts, got):
        w = words(t)
        want = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
        assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(0, i) for i in range(500, 600)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()}
    assert got == {x: root(x) for x in parent if root(x) != x or any(root(y) == x and y != x for y in parent)}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "test").count() == 0


def jaccard_model(docs):
    sets = []
    for i, t in docs:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def near_copies(r, n):
    voc = [f"w{i}" for i in range(80)]
    bases = [r.choices(voc, k=r.randint(3, 60)) for _ in range(12)]
    docs = []
    for i in range(n):
        t = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            t[r.randrange(len(t))] = r.choice(voc)
        docs.append((i, " ".join(t).title() if i % 7 == 0 else " ".join(t)))
    return docs


@pytest.mark.parametrize("limit, crowd", [(512, 64), (6, 64), (6, 3)])
def test_jaccard(rows, monkeypatch, limit, crowd):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", limit)
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    docs = near_copies(random.Random(limit + crowd), 160) + ODD
    got = jaccard_join.jaccard_components(rows(docs)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == jaccard_model(docs)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_sets_that_meet_on_a_token(spark, monkeypatch, batch):
    monkeypatch.setattr(jaccard_join, "CROWD", 5)
    r = random.Random(batch)
    sizes = {s: r.randint(10, 14) for s in range(40)}
    tokens = {t: sorted(r.sample(range(40), r.choice([1, 2, 4, 5, 6, 30]))) for t in range(60)}
    table = [(t, s, sizes[s]) for t, have in tokens.items() for s in have for _ in range(r.choice([1, 1, 2]))]
    want = collections.Counter()
    for have in tokens.values():
        have = sorted(have, key=lambda s: (sizes[s], s))
        if len(have) > 5:
            want.update((2, s, s) for s in have)
        for i, a in enumerate(have):
            for b in have[i + 1 : i + 2 if len(have) > 5 else None]:
                if 100 * sizes[a] >= 80 * sizes[b]:
                    want[(int(len(have) > 5), min(a, b), max(a, b))] += 1
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, batch)
    try:
        got = jaccard_join.met(spark.createDataFrame(table, "token long, set_id long, n long"), 80, 100).collect()
    finally:
        spark.conf.unset(key)
    assert collections.Counter(map(tuple, got)) == want


def test_pairs_that_may_link(spark):
    """No pair that reaches the threshold is left out, whichever tokens of the prefixes are counted as crowded."""
    r = random.Random(8)
    table = []
    for _ in range(3000):
        n, common = r.randint(1, 40), r.sample(range(200), 40)
        a = sorted(common[:n])
        b = sorted({*a[r.randint(0, 4) :], *r.sample(range(200), r.randint(0, 5))})
        if not b:
            continue
        shared = len({*a} & {*b})
        prefix = lambda x: {*x[: len(x) - jaccard_join.needed(len(x), 80, 100) + 1]}
        many = {t for t in range(200) if r.random() < 0.2}
        x, y = prefix(a), prefix(b)
        links = 100 * shared >= 80 * (len(a) + len(b) - shared)
        table.append((len(a), len(b), len((x & y) - many), len(x & many), len(y & many), links))
    rows = spark.createDataFrame(table, "n_a int, n_b int, shared int, many_a int, many_b int, links boolean")
    kept = rows.select("links", F.expr(jaccard_join._may_link(80, 100)).alias("kept")).groupBy("links", "kept").count().collect()
    found = {(x.links, x.kept): x["count"] for x in kept}
    assert (True, False) not in found and found[True, True] > 100 and found[False, False] > 100


def test_jaccard_crowds(rows, monkeypatch):
    """One large group of near copies and some texts that share its passage but are unlike, in many blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 6)
    monkeypatch.setattr(jaccard_join, "CROWD", 3)
    r = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for i in range(90):
        t = list(base)
        for _ in range(r.choice([1, 1, 2, 3]) if i < 70 else 0):
            t[r.randrange(60)] = f"x{r.randrange(9)}"
        docs.append((i, " ".join(t if i < 70 else t[: r.randint(20, 40)] + [f"y{i % 6}{k}" for k in range(r.randint(10, 12))])))
    got = jaccard_join.jaccard_components(rows(docs)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == jaccard_model(docs)


@pytest.mark.parametrize("like", [80, 75, 90])
def test_sets_that_link_share_a_signature(like):
    r = np.random.default_rng(like)
    levels = r.integers(0, 9, jaccard_join.CELLS).astype(np.uint8)
    token = lambda n: r.integers(0, 1 << 63, n, dtype=np.uint64)
    found = collections.Counter()
    for _ in range(3000):
        a = np.unique(token(r.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40, 90])))
        b = np.unique(np.concatenate([r.permutation(a)[r.integers(0, len(a) // 4 + 1) :], token(r.integers(0, len(a) // 4 + 1))]))
        shared, both = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        meet = len(np.intersect1d(*(jaccard_join.signatures(s, levels, like, 100) for s in (a, b)))) > 0
        if shared < both:  # equal sets are one
            found[100 * shared >= like * both, meet] += 1
    assert found[True, False] == 0 and found[True, True] > 100


def test_unlike_sets_on_a_common_passage_are_not_all_compared(rows, monkeypatch):
    """Texts of one size that share a passage, and are unlike, with the passage among the first tokens of all."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 6)
    monkeypatch.setattr(jaccard_join, "CROWD", 16)
    monkeypatch.setattr(jaccard_join, "OFTEN", 1000)
    placed = []
    monkeypatch.setattr(jaccard_join, "stored", lambda df, label, f=common.stored: (out := f(df, label), label == "jaccard-roles" and placed.append(out.count()))[0])
    docs = [(i, " ".join([f"w{i}x{k}" for k in range(90)] + [f"p{k}" for k in range(16)])) for i in range(60)]
    got = jaccard_join.jaccard_components(rows(docs)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(60)]
    # ten blocks against each other would be 600
    assert sum(placed) < 300, placed


@pytest.mark.parametrize("limit", [512, 2])
def test_jaccard_links_through_rows_without_id(rows, monkeypatch, limit):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", limit)
    text = lambda low, high: " ".join(f"w{i}" for i in range(low, high))
    # 1 and 2 are alike to the row between them only
    docs = [(1, text(0, 100)), (None, text(10, 110)), (2, text(20, 120)), (None, text(500, 600)), (3, text(505, 605)), (None, text(800, 900)), (None, text(801, 901))]
    got = jaccard_join.jaccard_components(rows(docs)).collect()
    have = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)
    assert have == jaccard_model(docs) and (2, 96, 1) in have and (None, 96, 3) in have


def test_jaccard_keeps_one_of_each_group(rows):
    docs = near_copies(random.Random(9), 60)
    table = rows([*docs, docs[5], (None, "alone here")])
    kept = jaccard_join.without_near_copies(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({c for _, _, c in jaccard_model(docs)} | {None}, key=repr)
    assert jaccard_join.jaccard_components(rows([])).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_edit_distance(spark, edits):
    r = random.Random(edits)
    text = lambda n: "".join(r.choices("abé", k=n))
    pairs = [(text(r.randint(0, 9)), text(r.randint(0, 9))) for _ in range(400)]
    for _ in range(200):
        a = text(12)
        i, j = sorted((r.randint(0, 12), r.randint(0, 12)))
        pairs.append((a, a[:i] + "x" * r.randint(0, 2) + a[j:]))
    got = spark.createDataFrame(pairs, "a string, b string").select(
        F.expr(line_dedup.within_edits("a", "b", edits)).alias("got"), (F.levenshtein("a", "b") <= edits).alias("want")
    )
    assert got.filter("NOT (got <=> want)").count() == 0


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def line_model(docs):
    places = [(d, i, line) for d, t in docs for i, line in enumerate((t or "").split("\n"))]
    lines = sorted({x for *_, x in places if x.strip(" ")})
    parent = {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in lines:
        for b in lines:
            if a < b and min(len(a), len(b)) >= line_dedup.LEAST and one_edit(a, b):
                parent[root(a)] = root(b)
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    first = {}
    for d, i, x in places:
        if x.strip(" "):
            first[root(x)] = min(first.get(root(x), (d, i)), (d, i), key=order)
    return sorted(((d, i, *(first[root(x)] if x.strip(" ") else (d, i))) for d, i, x in places), key=repr)


def lined(r):
    text = lambda n: "".join(r.choices("abcdefgh ", k=n)).strip() or "a"
    base = [text(r.randint(20, 60)) for _ in range(20)]

    def turned(x):
        i = r.randrange(len(x))
        return r.choice([x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[:i] + "é" + x[i + 1 :]])

    docs = []
    for d in range(80):
        some = [r.choice([r.choice(base), turned(r.choice(base)), turned(turned(r.choice(base))), "", "short", "shart"]) for _ in range(r.randint(0, 6))]
        docs.append((d, "\n".join([*some, f"a line that is common with a number {r.randint(0, 99):02d} in it"])))
    return docs


@pytest.mark.parametrize("shared", [64, 4])
def test_lines(rows, monkeypatch, shared):
    monkeypatch.setattr(line_dedup, "SHARED", shared)
    docs = lined(random.Random(shared)) + ODD
    got = line_dedup.line_classes(rows(docs)).collect()
    have = sorted(((r.doc_id, r.line_no, r.first_doc_id, r.first_line_no) for r in got), key=repr)
    assert have == line_model(docs)
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.first_doc_id, r.first_line_no)) for r in got)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits, shared", [(2, 64), (2, 2), (3, 64), (3, 2)])
def test_lines_within_several_edits(rows, monkeypatch, edits, shared):
    monkeypatch.setattr(line_dedup, "SHARED", shared)
    r = random.Random(10 * edits + shared)
    text = lambda n: "".join(r.choices("abcdé ", k=n)).strip() or "a"

    def turned(x, times):
        for _ in range(times):
            i = r.randint(0, len(x))
            x = r.choice([x[:i] + x[i + 1 :], x[:i] + r.choice("azé") + x[i:], x[:i] + "z" + x[i + 1 :]])
        return x

    base = [text(r.randint(20, 45)) for _ in range(25)]
    docs = [(d, "\n".join(turned(r.choice(base), r.randint(0, 5)) for _ in range(4))) for d in range(50)]
    lines = sorted({x for _, t in docs for x in t.split("\n") if x.strip(" ") and len(x) >= line_dedup.LEAST})
    want = {(a, b) for a in lines for b in lines if a < b and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits}
    of = line_dedup.lines_of(rows(docs).select("doc_id", "text"))
    name = {x.line_id: x.line for x in of.collect()}
    got = {tuple(sorted((name[x.a], name[x.b]))) for x in line_dedup.line_links(of, edits).collect()}
    assert got <= want and joined(lines, got) == joined(lines, want) and len({p for p in want if distance(*p) == edits}) > 20


def joined(lines, links):
    """The class of each line by its first member."""
    root = {x: x for x in lines}
    for _ in lines:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


def test_near_copies_of_a_line_take_links_in_proportion(rows):
    r = random.Random(1)
    base = "a line that very many other lines are near to, by a letter"
    near = {base} | {base[:i] + c + base[i + 1 :] for i in r.sample(range(len(base)), 40) for c in "xyzw"}
    docs = rows([(i, x) for i, x in enumerate(sorted(near))])
    of = line_dedup.lines_of(docs.select("doc_id", "text"))
    # a few keys each, against 12,561 pairs
    links = line_dedup.line_links(of, 3).distinct().count()
    assert len(near) - 1 <= links <= 6 * len(near)
    assert line_dedup.line_classes(docs, edits=3).select("first_doc_id").distinct().count() == 1


def test_a_long_line(rows):
    line = "".join(f"word{i} " for i in range(400))
    got = line_dedup.line_classes(rows([(1, line + "end"), (2, line + "and"), (3, line * 2)]), edits=3).collect()
    assert sorted((x.doc_id, x.first_doc_id) for x in got) == [(1, 1), (2, 1), (3, 3)]


def test_the_pipeline_takes_out_lines_within_three_edits(rows):
    line = "Read the terms of use before you go on to the next page."
    out = line_dedup.without_repeated_lines(rows([(1, line), (2, line.replace("terms", "form") + "\nown"), (3, line.replace("terms", "guides"))]))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, line), (2, "own"), (3, line.replace("terms", "guides"))]


def test_texts_without_repeated_lines(rows):
    docs = rows([(1, "the same line in both of them\nown"), (2, "other\nthe same line in both of them"), (3, "the same line in both of thum"), (4, None), (5, "")])
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.filter("text IS NOT NULL").collect()) == [(1, "the same line in both of them\nown", 33), (2, "other", 5), (5, "", 0)]
    assert {r.doc_id for r in out.collect()} == {1, 2, 4, 5}
    assert line_dedup.line_classes(rows([])).count() == 0


def test_rows_that_share_an_id_or_have_none_lose_their_own_lines_only(rows):
    a, b, c, d = (f"{x} is what this line begins with {x * 9}" for x in ("one", "two", "three", "four"))
    docs = [(None, f"{a}\n{b}"), (None, f"{c}\n{a}"), (7, f"{d}\nq"), (7, f"w\n{d}"), (8, f"{c}\nz"), (8, f"y\n{c}"), (9, "own"), (9, "own")]
    out = line_dedup.without_repeated_lines(rows(docs))
    want = [(None, f"{a}\n{b}"), (None, c), (7, f"{d}\nq"), (7, "w"), (8, "z"), (8, "y"), (9, "own"), (9, "own")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_rows_that_share_an_id_or_have_none_are_near_copies_by_their_texts(rows):
    text = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    docs = [(7, text("a")), (7, text("b")), (7, text("b")), (8, text("b", 41)), (None, text("b", 42)), (None, text("c")), (None, text("c", 41)), (None, text("d")), (6, text("a", 41)), (9, ""), (10, None)]
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.without_near_copies(rows(docs)).collect()), key=repr)
    assert len(kept) == 6 and kept[0] == (10, None) and kept[1:3] == [(6, text("a", 41)), (7, text("b"))] and (9, "") in kept
    assert [t for i, t in kept if i is None][1] == text("d") and [t for i, t in kept if i is None][0] in (text("c"), text("c", 41))


def span_model(docs, span):
    seen, every = collections.defaultdict(set), []
    for k, (d, t) in enumerate(docs):
        w = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", lower(t))]
        every.append(w)
        if d is not None:
            for i in range(len(w) - span + 1):
                seen[tuple(x[0] for x in w[i : i + span])].add(k)
    covered, out = collections.defaultdict(set), set()
    for (d, _), w in zip(docs, every):
        for i in range(len(w) - span + 1):
            if d is not None and len(seen[tuple(x[0] for x in w[i : i + span])]) > 1:
                covered[d].add((i, i + span, w[i][1], w[i + span - 1][2]))
    for d, found in covered.items():
        now = None
        for low, high, start, end in [*sorted(found), (1 << 30, 0, 0, 0)]:
            if now and low <= now[1]:
                now = (now[0], max(high, now[1]), now[2], max(end, now[3]))
            else:
                out |= {(d, now[0], now[1] - now[0], now[2], now[3])} if now else set()
                now = (low, high, start, end)
    return out


@pytest.mark.parametrize("span, gram, batch", [(12, 5, 10_000), (10, 10, 7), (5, 1, 10_000)])
def test_repeated_spans(spark, rows, span, gram, batch):
    r = random.Random(span)
    some = lambda n: r.choices([f"w{i}" for i in range(200)] + ["É", "Ä1"], k=n)
    passages = [some(r.randint(6, 40)) for _ in range(8)]
    docs = []
    for d in range(100):
        t = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            t += some(r.randint(0, 12)) + (p[r.randint(0, 4) : len(p) - r.randint(0, 4)] if r.random() < 0.6 else [])
        docs.append((d, " ".join(t)))
    docs += [*ODD, (200, "a " * 50), (None, docs[5][1]), docs[6]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {tuple(x) for x in suffix_dedup.repeated_spans(rows(docs), span=span, gram=gram).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == span_model(docs, span) and len(got) > 20
    assert suffix_dedup.repeated_spans(rows([])).count() == 0


def test_lines_with_a_common_passage_are_not_compared_in_pairs(rows, monkeypatch):
    r = random.Random(2)
    passage, text = "a passage that stands in many lines, unlike otherwise, ", lambda: "".join(r.choices("abcdefgh", k=70))
    lines = [passage + text() for _ in range(40)]
    lines += [x[:80] + "z" + x[81:] for x in lines[:5]] + [x[:60] + "zz" + x[61:] for x in lines[:5]]
    verified, compared = line_dedup._verified, []
    monkeypatch.setattr(line_dedup, "_verified", lambda all_lines, pairs, near: (compared.append(pairs.count()), verified(all_lines, pairs, near))[1])
    of = line_dedup.lines_of(rows(list(enumerate(lines))).select("doc_id", "text"))
    name = {x.line_id: x.line for x in of.collect()}
    got = {tuple(sorted((name[x.a], name[x.b]))) for x in line_dedup.line_links(of, 3).collect()}
    want = {(a, b) for a in lines for b in lines if a < b and distance(a, b) <= 3}
    assert got <= want and joined(lines, got) == joined(lines, want) and len(want) == 15
    # of 1,225 pairs
    assert sum(compared) < 400


def test_few_edges_are_united_at_once(spark, monkeypatch):
    r = random.Random(3)
    edges = spark.createDataFrame([(r.randint(0, 300), r.randint(-50, 300)) for _ in range(200)], "a bigint, b bigint")
    slow = {tuple(x) for x in components(edges, "test").collect()}
    monkeypatch.setattr(common, "_checksum", lambda e, f=common._checksum, seen=[]: (seen.append(1), f(e))[1] if len(seen) < 1 else pytest.fail("a second round"))
    assert {tuple(x) for x in components(edges, "test", 200).collect()} == slow and len(slow) > 200


def test_edges_that_become_few_are_not_left_in_part(spark):
    """A chain of groups whose pairs are all edges: the first round leaves fewer than the bound, far from done."""
    edges = [(20 * g + i, 20 * g + j) for g in range(12) for i in range(12) for j in range(i)] + [(20 * g + 11, 20 * g + 20) for g in range(11)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), "test", 300).collect()
    assert len(edges) > 300 and sorted(map(tuple, got)) == sorted((20 * g + i, 0) for g in range(12) for i in range(12))


def test_lines_are_compared_once_where_keys_have_the_same_lines(rows):
    r = random.Random(4)
    base = ["".join(r.choices("abcdefgh", k=6)) for _ in range(20)]
    lines = [" ".join("".join(r.choices("stuvwxyz", k=r.randint(6, 7))) if i == k else w for i, w in enumerate(base)) for k in range(20) for _ in range(2)]
    of = line_dedup.lines_of(rows(list(enumerate(lines))).select("doc_id", "text")).select("line_id", "line")
    on = collections.defaultdict(set)
    for x in line_dedup.shared_keys(of, 1, 3).collect():
        on[x.key].add((x.line_id, x.indexed))
    assert on and len({frozenset(x) for x in on.values()}) == len(on)
    assert all(len(x) > 1 and any(indexed for _, indexed in x) for x in on.values())


def test_lines_are_split_further_by_the_ways_that_many_share(rows):
    of = line_dedup.lines_of(rows([(1, "a line that is long enough to be split into segments")]).select("doc_id", "text")).select("line_id", "line")
    above, below = line_dedup.ways(3, 1), line_dedup.ways(3, 2)
    assert {w["of"] for w in below} == {w["way"] for w in above} and all(w["kept"] for w in above)
    chosen = {0, 9}
    got = line_dedup.signed(of.withColumn("ways", F.array(*map(F.lit, chosen))), 2, 3)
    assert sorted(x.about // 2 for x in got.collect()) == [w["way"] for w in below if w["of"] in chosen]
    # what a way keeps, those that split it further keep too
    pieces = lambda w: {tuple(sorted(k.items())) for k in w["kept"]}
    assert all(pieces(above[w["of"]]) <= pieces(w) for w in below)
