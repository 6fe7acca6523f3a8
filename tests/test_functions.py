import json

import pytest
from pyspark.sql import functions as F

from emberframe.functions import payloads, rules, spans, stacks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_stack_normalisation(spark):
    names = F.array(*[F.lit(n) for n in ["github.com/u/p/q.Leaf", "", "net/http.serve", "runtime.main", "runtime.goexit"]], F.lit(None))
    assert one(spark, stacks.normalise_stack(names)) == ["http.serve", "q.Leaf"]
    kept = stacks.exclude_packages(F.array(F.lit("http.serve"), F.lit("q.Leaf"), F.lit("runtime.x")), ["net/http", "runtime"])
    assert one(spark, kept) == ["q.Leaf"]
    assert one(spark, stacks.trim_package(F.lit("plain"))) == "plain"


@pytest.mark.parametrize("text, hashed", [("", 2166136261), ("a", 3826002220), ("foobar", 3214735720)])
def test_published_hash_vectors(spark, text, hashed):
    assert one(spark, stacks.fnv1a32(F.lit(text))) == hashed
    assert one(spark, stacks.stable_hash_bucket(F.lit(text))) == hashed % 360


def test_hash_of_text_beyond_ascii(spark):
    h = 2166136261
    for b in "ключ→é".encode():
        h = (h ^ b) * 16777619 % 2**32
    assert one(spark, stacks.fnv1a32(F.lit("ключ→é"))) == h


@pytest.mark.parametrize(
    "name, value, band",
    [("(GC)", -1, "gc"), ("(Heap)", 1, "heap"), ("(Blocked)", 0, "blocked"), ("x", -1, "shrinking"), ("x", 5, "other")],
)
def test_bands(spark, name, value, band):
    assert one(spark, stacks.frame_band(F.lit(name), F.lit(value))) == band


@pytest.mark.parametrize(
    "name, gid",
    [("goroutine-12", 12), ("a-b-7", 7), ("x-", None), ("plain", None), ("x-1a", None), ("x-5\n", None),
     ("x-18446744073709551615", 2**64 - 1), ("x-18446744073709551616", None), ("x-" + "9" * 50, None), ("x-007", 7)],
)
def test_goroutine_ids(spark, name, gid):
    assert one(spark, spans.goroutine_id(F.lit(name))) == gid


T, S = "0af7651916cd43dd8448eb211c80319c", "b7ad6b7169203331"


@pytest.mark.parametrize(
    "ann, label",
    [
        (f"trace_id={T}", f"{T}:{'0' * 16}"),
        (f"trace_id={T},{S}", f"{T}:{S}"),
        (f"user=1 trace_id={T.upper()},{S.upper()} more", f"{T}:{S}"),
        (f"trace_id={T},short", f"{T}:{'0' * 16}"),
        (f"trace_id={T},b7adXX7169203331", f"{T}:b7ad{'0' * 12}"),
        (f"trace_id={T}junk,{S}", f"{T}:{S}"),
        (f"trace_id={T[:31]},{S}", None),
        (f"trace_id={T[:20]}", None),
        (f"trace_id=zz{T}", None),
        ("nothing", None),
    ],
)
def test_annotations(spark, ann, label):
    assert one(spark, spans.span_label(F.lit(ann))) == label


def test_payloads(spark):
    hook = one(spark, payloads.webhook_payload(F.lit("r"), F.lit('say "hi"'), F.lit(7)))
    assert hook == '{"msg":"say \\"hi\\"","rule":"r","ts":7}'
    chat = json.loads(one(spark, payloads.chat_payload(F.lit("m"), "bot", ":x:")))
    assert chat == {"icon_emoji": ":x:", "text": "*alert* — m", "username": "bot"} and list(chat) == sorted(chat)
    issue = json.loads(one(spark, payloads.issue_payload(F.lit("r"), F.lit("m"), "OPS")))["fields"]
    assert issue == {"description": "m", "issuetype": {"name": "Task"}, "project": {"key": "OPS"}, "summary": "alert – r"}


def test_rule_functions(spark):
    assert one(spark, rules.safe_div(F.lit(3.0), F.lit(0.0))) == 0.0
    m = F.create_map(F.lit("a"), F.lit(2.0))
    assert one(spark, rules.metric(m, "a")) == 2.0 and one(spark, rules.metric(m, "b")) == 0.0
    with pytest.raises(ValueError):
        rules.compare(F.lit(1), "~", 1)
