"""Packing, the pipeline, and the queries against their SQL."""

import random
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers as vocabularies
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, rows_of
from emberframe.llm import packing
from emberframe.llm.queries import ORACLE, QUERIES
from odd_rows import ODD

SF = "/root/testdata/sf0.001"
VOCABULARY = vocabularies.path("word_bpe_49k.json")


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(VOCABULARY)
    coder = packing.WordCoder(VOCABULARY)
    r = random.Random(3)
    letters = [chr(c) for c in [*range(0x250), 0x85, 0xA0, 0x2028, 0x3000, 0x1F600, 0x301, 0xAC00, 0x3A3, 0x3C3, 0x130]]
    texts = ["", " ", "it's 's DON'T", "a <|endoftext|> b", "<|startoftext|>x<|EndOfText|> é", "<|endoftext|>" * 9, "ΑΣ ΑΣ Β", "x" * 3000] + ["".join(r.choices(letters, k=r.randint(1, 14))) for _ in range(3000)]
    for t in texts:
        assert coder.encode(t) == (lambda ids: struct.pack(f"<{len(ids)}I", *ids))(model.encode(t, add_special_tokens=False).ids), t


def test_knapsack():
    r = np.random.default_rng(1)
    for _ in range(30):
        value = r.random(6) * (r.random(6) > 0.3)
        best = np.zeros(14)
        for room in range(1, 14):
            best[room] = max([best[room - 1]] + [best[room - c - 1] + value[c] for c in range(6) if c < room])
        got, pattern = packing.knapsack(value, 13)
        assert got == pytest.approx(best[13]) and (pattern * (np.arange(6) + 1)).sum() <= 13 and pattern @ value == pytest.approx(got)


@pytest.mark.parametrize("seed", range(6))
def test_patterns(seed):
    r = np.random.default_rng(seed)
    counts = r.integers(0, 60, 32) * (r.random(32) > 0.4)
    chosen = packing.patterns(counts, 32)
    assert (sum([p * n for p, n in chosen], np.zeros(32, np.int64)) == counts).all()
    assert all((p * np.arange(1, 33)).sum() <= 32 for p, _ in chosen)
    used, area = sum(n for _, n in chosen), (counts * np.arange(1, 33)).sum() / 32
    assert area <= used <= sum(n for _, n in packing.first_fit(counts, 32))


def test_patterns_of_short_pieces_fill_their_sequences():
    counts = np.array([300, 210, 180, 240, 90, 120, 150, 60] + [0] * 24)
    used = sum(n for _, n in packing.patterns(counts, 32))
    assert used <= 1.01 * (counts * np.arange(1, 33)).sum() / 32 + 1


def check_pieces(got, ids, length):
    by_doc, by_sequence = {}, {}
    for x in got:
        piece = ids[x.doc_id][x.start : x.start + x.length]
        assert len(piece) == x.length and zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)) == x.ids_crc32 and x.doc_tokens == len(ids[x.doc_id])
        by_doc.setdefault(x.doc_id, []).append((x.start, x.length))
        by_sequence.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for pieces, most in [(p, None) for p in by_doc.values()] + [(p, length) for p in by_sequence.values()]:
        at = 0
        for begin, n in sorted(pieces):
            assert begin == at
            at += n
        assert most is None or at <= most
    assert set(by_doc) == set(ids)
    return len(by_sequence)


def test_packed(rows):
    r = random.Random(7)
    docs = [(i, " ".join(r.choices("abc", k=r.choice([0, 1, 5, 30, 63, 64, 200, r.randint(0, 300)])))) for i in range(150)] + [(500, None)]
    encoder = lambda: lambda text: struct.pack(f"<{len(text.split())}I", *[ord(c) for c in text.split()])
    got = packing.packed(rows(docs), encoder, 2, length=64, unit=4).collect()
    ids = {i: [ord(c) for c in (t or "").split()] + [2] for i, t in docs}
    sequences = check_pieces(got, ids, 64)
    assert sum(map(len, ids.values())) >= 0.9 * 64 * sequences


def test_packed_odd_rows(rows):
    one = lambda: lambda text: struct.pack(f"<{len(text.split())}I", *[7] * len(text.split()))
    got = packing.packed(rows(ODD), one, 2, length=64, unit=4).collect()
    assert sorted((x.doc_id for x in got), key=repr) == sorted((i for i, _ in ODD), key=repr)
    assert sorted((x.offset, x.length) for x in got)[0][0] == 0 and len({x.sequence_id for x in got}) == 1
    assert packing.packed(rows([]), one, 2).count() == 0


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.count() >= (1 if name.startswith(("op1_", "op2_")) else documents)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < docs.count() <= before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "secret_scan", "packing"]


def test_pipeline_on_odd_tables(spark, rows, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (rows([]), rows(ODD)):
        docs = docs.drop("spans", "score", "component_id")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            schema = docs.schema
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
