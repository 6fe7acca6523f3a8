"""Periodic runs against an enumeration of all periods."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from emberframe.llm import periodic_runs as pr
from odd_rows import ODD


def model(words, least, times):
    """Every maximal stretch for every period, those whose period is not their smallest left out."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.append((i, j + q - i, q))
            i = j
    smallest = lambda s, m: next(q for q in range(1, m + 1) if all(words[k] == words[k + q] for k in range(s, s + m - q)))
    return sorted((r for r in found if smallest(r[0], r[1]) == r[2]), key=lambda r: (r[0], r[2]))


def text(r):
    kind = r.randrange(5)
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randint(0, 70))]
    if kind == 1:
        unit = [r.choice("abc") for _ in range(r.randint(1, 9))]
        return [r.choice("abcd") for _ in range(r.randint(0, 6))] + unit * r.randint(2, 9) + [r.choice("abcd") for _ in range(r.randint(0, 6))]
    if kind == 2:
        return ["a"] * r.randint(0, 60)
    if kind == 3:  # Fibonacci words have many runs
        a, b = ["a"], ["a", "b"]
        while len(b) < 80:
            a, b = b, b + a
        return b[r.randint(0, 5) :]
    unit = [r.choice("ab") for _ in range(3)] * 4
    return (unit + ["c"]) * r.randint(1, 6)


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (4, 2), (2, 2), (12, 4)])
def test_runs_are_those_of_the_enumeration(least, times):
    r = random.Random(least * times)
    texts = [text(r) for _ in range(250)]
    got = pr.runs_of([np.array(["abcd".index(w) for w in t], np.int64) for t in texts], least, times)
    assert got == [model(t, least, times) for t in texts]
    assert sum(map(len, got)) > 20


def test_nested_and_overlapping_runs():
    words = list(("ab" * 15 + "c") * 3)
    got = pr.runs_of([np.array([ord(w) for w in words])])[0]
    assert got == model(words, 24, 3) and {p for _, _, p in got} == {2, 31}


def test_rows_and_digests(rows, spark, tmp_path):
    r = random.Random(3)
    made = [(i, " ".join(text(r)).replace(" ", r.choice([" ", "\t", "\n", " \x0b "]))) for i in range(60)]
    made += [(77, "é x ö " * 30), (78, "a \x1c " * 30), (1001, "word " * 400), *ODD]
    rows(made).write.parquet(str(tmp_path / "documents.parquet"))
    got = pr.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(made)
    from zlib import crc32

    def expected(i, t):
        words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", t or "")]
        if i is not None and crc32(str(i).encode()) % 10 == 0 and words:
            n, g = len(words), crc32(str(i).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = model(words, 24, 3)
        keep = [w for k, w in enumerate(words) if not any(s + p <= k < s + m for s, m, p in runs)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        milli = 1000 * best[1] // best[2] if runs else None
        return (i, len(runs), *best, milli, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(keep)))

    assert sorted(map(tuple, got), key=repr) == sorted((expected(i, t) for i, t in made), key=repr)
    assert any(x.n_runs > 0 for x in got)


def test_empty_table_and_clashing_columns(rows):
    assert pr.periodic_runs(rows([])).count() == 0
    docs = rows([(1, "a b " * 20)]).selectExpr("*", "1 AS runs", "2 AS collapsed", "3 AS best")
    got = pr.periodic_runs(docs).first()
    assert got.collapsed == "a b" and [tuple(x) for x in got.runs] == [(0, 40, 2)] and got.n_words == 40


def test_very_long_text():
    n = 300_000
    assert pr.runs_of([np.zeros(n, np.int64)]) == [[(0, n, 1)]]
    unit = np.random.default_rng(0).integers(0, 1000, 50_000)
    assert pr.runs_of([np.tile(unit, 4), np.arange(10)]) == [[(0, 200_000, 50_000)], []]
