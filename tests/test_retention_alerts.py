import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.operators import alerts, retention

SECOND = 1_000_000


def ring_model(times, retention_us):
    """A ring step by step: fixed slots, old ones cleared once it has wrapped."""
    slots = retention_us * 10 // SECOND + 1
    ring, at, filled = [None] * slots, 0, False
    for seq, now in enumerate(times, 1):
        ring[at] = (seq, now)
        at = (at + 1) % slots
        filled = filled or at == 0
        if filled:
            ring = [x if x and x[1] >= now - retention_us else None for x in ring]
    return {x[0] for x in ring if x}


def list_model(times, retention_us, rate, as_of):
    kept, last = [], None
    for seq, now in enumerate(times, 1):
        if last is not None and now - last >= retention_us:
            kept = []
        kept = ([seq] + kept)[: retention_us * rate // SECOND + 100 + 1]
        last = now
    return set() if as_of is not None and as_of - last >= retention_us else set(kept)


def history(seed, n, step):
    r, t, out = random.Random(seed), 0, []
    for _ in range(n):
        t += r.choice([0, step // 3, step, step * 2]) if r.random() > 0.02 else 3 * SECOND
        out.append(t)
    return out


def chunks(spark, times):
    return spark.createDataFrame([(i, t, f"c{i}") for i, t in enumerate(times, 1)], "seq bigint, us bigint, payload string")


@pytest.mark.parametrize("seed, n, step", [(1, 5, 100_000), (2, 11, 100_000), (3, 40, 90_000), (4, 60, 20_000), (5, 21, 400_000)])
def test_ring(spark, seed, n, step):
    times = history(seed, n, step)
    got = retention.retain_ring(chunks(spark, times), SECOND)
    assert {r.seq for r in got.collect()} == ring_model(times, SECOND)
    assert retention.retain_ring(chunks(spark, times), 5).count() == got.count()


@pytest.mark.parametrize("seed, n, step", [(1, 30, 300_000), (2, 300, 10_000), (3, 80, 600_000)])
def test_list(spark, seed, n, step):
    times = history(seed, n, step)
    for as_of in (None, times[-1] + SECOND - 1, times[-1] + SECOND):
        got = retention.retain_list(chunks(spark, times), SECOND, as_of, 10)
        assert {r.seq for r in got.collect()} == list_model(times, SECOND, 10, as_of)


def test_seek(spark):
    df = chunks(spark, [10, 20, 30, 40])
    at = lambda *a, **k: [r.seq for r in retention.timeline_seek(df, *a, **k).collect()]
    assert at() == [4] and at(0) == [1] and at(0, capacity=2) == [3] and at(1, capacity=2) == [4] and at(9) == []
    assert [r.seq for r in retention.seek_time(df, 35).collect()] == [3]
    assert [r.seq for r in retention.chronological(df.orderBy(F.rand(1))).collect()] == [1, 2, 3, 4]


def lru_model(rules, capacity):
    recent, out = OrderedDict(), []
    for i, rule in enumerate(rules):
        if rule not in recent:
            out.append(i)
        recent[rule] = None
        recent.move_to_end(rule)
        if len(recent) > capacity:
            recent.popitem(last=False)
    return set(out)


@pytest.mark.parametrize("capacity, max_rows", [(128, 10_000), (5, 10_000), (5, 37), (5, 300), (40, 20)])
def test_dedup(spark, capacity, max_rows):
    r = random.Random(capacity * max_rows)
    rules = [f"r{min(r.randint(0, 60), r.randint(0, 60))}" if r.random() > 0.33 else "busy" for _ in range(700)]
    df = spark.createDataFrame([(x, i * 3, i) for i, x in enumerate(rules)], "rule string, us bigint, id bigint")
    got = alerts.alert_dedup_lru(df, ["us", "id"], capacity, max_rows)
    assert {x.id for x in got.collect()} == lru_model(rules, capacity)
    assert got.count() == len(lru_model(rules, capacity))


def test_rules_fired_in_between_are_counted():
    r = random.Random(3)
    for n in (0, 1, 2, 7, 64, 65, 300):
        rules = [r.randint(0, 20) for _ in range(n)]
        want = []
        for i, rule in enumerate(rules):
            last = max((j for j in range(i) if rules[j] == rule), default=None)
            want.append(-1 if last is None else len(set(rules[last + 1 : i])))
        assert alerts._distinct_since(np.array(rules, np.int64)).tolist() == want


@pytest.mark.parametrize("fan, known", [(2, False), (3, True), (16, False)])
def test_memory_at_the_start_of_each_slice(spark, monkeypatch, fan, known):
    monkeypatch.setattr(alerts, "FAN", fan)
    r = random.Random(9)
    rules = [f"r{r.randint(0, 30)}" for _ in range(400)]
    rows = spark.createDataFrame([(x, i + 1, i // 10) for i, x in enumerate(rules)], "rule string, _at bigint, _slice bigint")
    before = [f"k{i}" for i in range(5)] if known else []
    start = spark.createDataFrame([(x, i - 9) for i, x in enumerate(before)], "rule string, _at bigint") if known else None
    got = {}
    for x in alerts._memories(rows, 40, 5, start).collect():
        got.setdefault(x["_slice"], set()).add(x["rule"])
    for number in range(40):
        recent = list(dict.fromkeys(reversed(before + rules[: number * 10])))[:5]
        assert got.get(number, set()) == set(recent)


def test_dedup_of_null_rules_and_nothing(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3), ("b", 4), ("c", 5), (None, 6)], "rule string, us bigint")
    assert sorted(x.us for x in alerts.alert_dedup_lru(df, capacity=2).collect()) == [1, 2, 4, 5, 6]
    assert alerts.alert_dedup_lru(df.limit(0)).count() == 0


def hold_model(rows, hold_us):
    since, fired, out = None, False, []
    for us, holds in rows:
        if not holds:
            since, fired = None, False
            continue
        since = us if since is None else since
        if not fired and us - since >= hold_us:
            fired = True
            out.append((us, since))
    return out


@pytest.mark.parametrize("max_rows", [10_000, 25])
def test_hold(spark, max_rows):
    r = random.Random(3)
    rows, t = [], 0
    for _ in range(200):
        t += r.randint(1, 5)
        rows.append((t, r.random() < 0.85))
    df = spark.createDataFrame([("x", *row) for row in rows], "rule string, us bigint, holds boolean")
    got = alerts.alert_hold(df, 10, max_rows=max_rows)
    assert [(x.us, x.since_us) for x in got.orderBy("us").collect()] == hold_model(rows, 10)


def test_rules(spark):
    df = spark.createDataFrame([(1, 4.0, 0.0), (2, None, 2.0)], "us bigint, x double, y double")
    rules = {"ratio": "safe_div(x, y) > 1", "unknown": "missing < 1", "number": "x - 4", "both": "x > 3 AND NOT y > 1"}
    got = {(r.us, r.rule): r.holds for r in alerts.rule_eval(df, rules).collect()}
    assert got == {
        (1, "ratio"): False, (2, "ratio"): False, (1, "unknown"): True, (2, "unknown"): True,
        (1, "number"): False, (2, "number"): True, (1, "both"): True, (2, "both"): False,
    }


def test_rules_of_numbers(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 3, 1.5), (3, None, 2.0)], "us bigint, n bigint, x double")
    rules = {"null": "n < 1", "and": "truth(n) AND truth(x)", "not": "NOT truth(x)", "sum": "num(n > 1) + num(x > 1) >= 2", "text": "'a.b' = 'a.b'"}
    got = {(r.us, r.rule): r.holds for r in alerts.rule_eval(df, rules).collect()}
    want = {"null": [True, False, True], "and": [False, True, False], "not": [True, False, False], "sum": [False, True, False], "text": [True] * 3}
    assert got == {(i + 1, rule): v for rule, values in want.items() for i, v in enumerate(values)}
    with pytest.raises(ValueError, match="not a metric"):
        alerts.rule_eval(df, {"dotted": "a.b > 1"})


def test_routes(spark):
    rules = spark.createDataFrame([("r", "x > 1", 1000, ["a", "b"]), ("s", "x > 1", None, None)], "name string, predicate string, for_ms bigint, sinks array<string>")
    fired = spark.createDataFrame([("r", 1), ("s", 2), ("t", 3)], "rule string, us bigint")
    assert sorted((r.rule, r.sink) for r in alerts.alert_route(fired, rules).collect()) == [("r", "a"), ("r", "b")]


@pytest.mark.parametrize("op, kept", [(">", [3]), (">=", [2, 3]), ("<", [1, 4]), ("<=", [1, 2, 4]), ("==", [2]), ("!=", [1, 3, 4])])
def test_thresholds(spark, op, kept):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, None)], "id int, blocked bigint")
    assert sorted(r.id for r in alerts.threshold_filter(df, "blocked", op, 2).collect()) == kept
    assert alerts.threshold_filter(df, "unknown", "<", 1).count() == 4
