"""The recurrent network's slopes against differences, its reading against a plain one, its accuracy on held-out rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import language_id as li
from odd_rows import ODD


def test_slopes_are_those_of_small_differences():
    random = np.random.default_rng(0)
    net = li.Network.fresh(3, 4, random)
    for name in ("byte", "state", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    windows, sizes = li.both_ways([b"abcab", b"zz", b"hello w"], 7)
    labels = np.array([0, 2, 1])
    _, slopes = li.gradients(net, windows, sizes, labels)
    for part, slope in zip(net.parts(), slopes):
        places = [tuple(random.integers(0, s) for s in part.shape) for _ in range(25)]
        if part is net.byte:
            places = [(g, d, ord(c), k) for g in range(3) for d in (0, 1) for c in "az" for k in range(4)]
        for at in places:
            h = 1e-3
            was = part[at]
            part[at] = was + h
            up = li.gradients(net, windows, sizes, labels)[0]
            part[at] = was - h
            down = li.gradients(net, windows, sizes, labels)[0]
            part[at] = was
            assert abs((up - down) / (2 * h) - slope[at]) < 2e-3 * max(1, abs(slope[at]))


def plain(net, text):
    """One byte after the other, window by window."""
    size = net.state.shape[2]
    total = np.zeros(len(net.bias))
    for at in range(0, len(text), li.READ):
        window = text[at : at + li.READ]
        sides = []
        for d, data in enumerate((window, window[::-1])):
            h, out = np.zeros(size), []
            for b in data:
                z, r = (np.clip(net.byte[k, d, b] + h @ net.state[k, d], 0, 1) for k in (0, 1))
                n = net.byte[2, d, b] + r * (h @ net.state[2, d])
                n = n / (1 + abs(n))
                h = (1 - z) * n + z * h
                out.append(h @ net.out[d])
            sides.append(out)
        for t in range(len(window)):
            total += li.softmax(sides[0][t] + sides[1][len(window) - 1 - t] + net.bias)
    return total / len(text)


def test_whole_texts_are_read(monkeypatch):
    monkeypatch.setattr(li, "READ", 16)
    monkeypatch.setattr(li, "ROWS", 5)
    net = li.Network.fresh(4, 6, np.random.default_rng(1))
    r = random.Random(2)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 15, 16, 17, 200, 0, 33)]
    got = li.pooled(net, texts)
    for text, p in zip(texts, got):
        assert np.allclose(p, plain(net, text) if text else 0, atol=1e-4)
    # the last byte of a long text counts as the first
    assert not np.allclose(got[4], li.pooled(net, [texts[4][:-1] + b"\xff"])[0], atol=1e-7)


WORDS = {"en": "the and of to in that with which", "de": "der und die zu den mit welche nicht", "fr": "le et les des que dans une était"}


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    made = []
    for i in range(600):
        lang = r.choice(list(WORDS))
        own = WORDS[lang].split()
        made.append((i, " ".join(r.choice(own) if r.random() < 0.7 else "".join(r.choices("aeioutrnsl", k=5)) for _ in range(r.randint(5, 60))), lang))
    return made


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "c", 0.5) for i, t, x in rows], "doc_id long, text string, lang string, score string, lang_pred double")


def test_held_out_accuracy_and_rows(spark, docs):
    rows = docs + [(1000 + k, t, "en") for k, t in enumerate(t for _, t in ODD)] + [(None, None, "en"), (7, "123 ... 456", None), (8, "the and of the", None)]
    got = li.languages(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    truth = {i: x for i, _, x in docs}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id not in (7, 8)]
    assert len(held) > 150 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.lang_pred in (*WORDS, "und") for r in got)
    assert [(r.lang_pred, r.score) for r in got if r.doc_id == 1000] == [("und", 0.0)]
    again = {(r.doc_id, r.lang_pred) for r in li.languages(frame(spark, rows[::-1])).collect()}
    assert again == {(r.doc_id, r.lang_pred) for r in got}


def test_held_out_labels_are_not_learnt_from(spark, docs):
    out = frame(spark, docs)
    wrong = out.withColumn("lang", F.when(li.is_held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    a, b = ({(r.doc_id, r.lang_pred, r.score) for r in li.languages(d).collect()} for d in (out, wrong))
    assert a == b


def test_nothing_to_learn_from(spark):
    assert [tuple(r)[2:] for r in li.languages(frame(spark, [(1, "abc", None), (None, "def", "en")])).collect()] == [("und", 0.0)] * 2
    assert li.languages(frame(spark, [])).count() == 0


def test_very_long_text(spark, docs):
    text = "der und die zu " * 20_000
    got = {r.doc_id: r for r in li.languages(frame(spark, docs + [(9999, text, None)])).collect()}
    assert got[9999].lang_pred == "de"
