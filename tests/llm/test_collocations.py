"""Counting quotient filters and phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import collocations, quotient_filter as qf
from odd_rows import ODD


@pytest.mark.parametrize("n,bits", [(2, 6), (3, 11), (5, 15), (5, 25), (4, 32), (2, 1)])
def test_packing_and_permutation_can_be_undone(n, bits):
    r = np.random.default_rng(n * bits)
    ids = r.integers(0, 1 << bits, (500, n))
    half = qf.half_bits(n, bits)
    left, right = qf.packed(list(ids.T), bits)
    assert (qf.unpacked(left, right, n, bits) == ids).all()
    a, b = qf.permuted(left, right, half)
    assert int(a.max()) < 1 << half and int(b.max()) < 1 << half
    back = qf.restored(a, b, half)
    assert (back[0] == left).all() and (back[1] == right).all()


@pytest.mark.parametrize("n,bits,range_bits", [(2, 6, 3), (3, 11, 0), (5, 15, 6), (5, 25, 9)])
def test_filters_count_and_merge_without_loss(n, bits, range_bits):
    r = np.random.default_rng(1)
    half = qf.half_bits(n, bits)
    shards = [r.integers(0, 12, (m, n)) for m in (4000, 1, 900)]
    shards.append(np.repeat(shards[1], 700, 0))  # a counter above one byte
    filters = [qf.filter_of(*qf.permuted(*qf.packed(list(s.T), bits), half), half) for s in shards]
    read = []
    for f in filters:
        parts = [qf.read_block(k, data, half, range_bits) for k, data in qf.blocks(f, range_bits)]
        assert sum(map(len, parts)) == len(f)
        read += parts
    whole = qf.merged(read)
    ids = qf.unpacked(*qf.restored(whole.left, whole.right, half), n, bits)
    assert Counter(dict(zip(map(tuple, ids.tolist()), whole.count.tolist()))) == Counter(map(tuple, np.concatenate(shards).tolist()))


def test_keys_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        qf.half_bits(5, 26)


def model(rows, least, longest, most):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^ \x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    cand = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = []
    for (lang, *words), a in cand.items():
        cuts = [(1000 * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = any(
            g[0] == lang and len(g) > len(words) + 1 and b >= a and any(list(g[i : i + len(words)]) == words for i in range(1, len(g) - len(words) + 1))
            for g, b in cand.items()
        )
        if not inside:
            out.append((lang, -score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])], n[lang]))
    ranked = []
    for lang in {o[0] for o in out}:
        for rank, (_, s, a, p, l, r, total) in enumerate(sorted(o for o in out if o[0] == lang)[:most], 1):
            ranked.append((lang, rank, p.decode(), -a, l, r, total, -s))
    return sorted(ranked)


def corpus(seed, size=120):
    r = random.Random(seed)
    words = ["a", "b", "B", "é", "É", "c\x1cd", " ", "x-y", " "]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r"]
    rows = []
    for _ in range(size):
        text = "".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(0, 60)))
        rows.append((r.choice(["en", "de", None]), text + "to be or not to be " * r.randint(0, 2)))
    return rows + [("en", None), ("fr", ""), ("fr", " \t\n"), ("en", "same words here " * 3), ("en", "same words here " * 3)]


@pytest.fixture(scope="module")
def table(spark):
    # columns with the names the operator uses
    schema = "lang string, text string, word string, ids string, chunk string, a string, f string, at string"
    return lambda rows: spark.createDataFrame([(x, t, *["z"] * 6) for x, t in rows], schema)


def result(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("least,longest,most", [(6, 5, 2000), (3, 3, 7), (2, 2, 5)])
def test_collocations_are_those_of_plain_counting(table, least, longest, most):
    rows = corpus(least)
    want = model(rows, least, longest, most)
    assert len(want) > 10
    assert result(collocations.collocations(table(rows).repartition(5), least, longest, most)) == want


def test_small_chunks_shards_and_a_full_map_change_nothing(table, monkeypatch):
    rows = corpus(9)
    want = model(rows, 4, 5, 2000)
    # a map of eight bits stops nothing; chunks of a few words, filters written often
    real = collocations.chunked
    monkeypatch.setattr(collocations, "chunked", lambda docs: real(docs, 40))
    monkeypatch.setattr(collocations, "_map_of", lambda counted: b"\xff" * (1 << collocations.MAP_BITS - 3))
    assert result(collocations.collocations(table(rows), 4)) == want


def test_odd_rows(table):
    assert collocations.collocations(table([]), 1).count() == 0
    assert collocations.collocations(table([("en", t) for _, t in ODD]), 50).count() == 0
    got = result(collocations.collocations(table([(None, "a b")] * 2), 2))
    assert got == [("und", 1, "a b", 2, 2, 2, 4, 2000)]


def test_very_long_text_and_long_words(table):
    text = "one two " * 60_000 + "w" * 300_000
    got = result(collocations.collocations(table([("en", text)]), 100))
    assert got == model([("en", text)], 100, 5, 2000) and len(got) == 4


def test_scores_are_exact_beyond_64_bits(spark):
    a, n = 4_000_000_000_123, 9_000_000_000_000_007
    words = spark.createDataFrame([("x", "p", a + 5, 0), ("x", "q", a + 11, 1)], "lang string, word string, f long, id int")
    phrases = spark.createDataFrame([("x", [0, 1], a)], "lang string, ids array<int>, f long")
    totals = spark.createDataFrame([("x", n)], "lang string, n long")
    assert collocations.scored(phrases, words, totals).first()["score"] == 1000 * a * n // ((a + 5) * (a + 11))
