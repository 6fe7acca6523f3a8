"""Byte-level BPE by a sentencepiece model that is written straight from a rank file."""

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from emberframe.llm.common import per_text, table, texts_of

#: Pre-tokens kept with their ids, per worker; when full, the memory starts anew.
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_letters() -> list[str]:
    """A visible character for each byte: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


LETTERS = dict(enumerate(byte_letters()))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is unknown, the others are the tokens in order of rank, byte by byte as
    letters, scored by the negative rank, so that the lowest rank merges first. The normaliser is the identity."""
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind))
    tokens = sorted(ranks, key=ranks.__getitem__)
    pieces = [piece("<unk>", 0.0, 2)] + [piece(t.decode("latin-1").translate(LETTERS), float(-ranks[t]), 1) for t in tokens]
    trainer = b"".join(_field(*f) for f in ((3, 2), (4, len(pieces)), (40, 0), (41, -1), (42, -1), (43, -1)))
    normaliser = b"".join(_field(*f) for f in ((1, b"identity"), (3, 0), (4, 0), (5, 0)))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Coder:
    """Encodes texts to ids (little-endian unsigned 32-bit) and ids to bytes."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.ids = sorted(self.ranks.values())
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        raw = [(w, w.encode()) for w in words]
        merged = []
        for w, b in raw:
            # a pre-token that is a token needs no merges
            if (rank := self.ranks.get(b)) is not None:
                self.known[w] = struct.pack("<I", rank)
            else:
                merged.append((w, b))
        pieces = self.model.encode([b.decode("latin-1").translate(LETTERS) for _, b in merged], num_threads=1)
        for (w, _), got in zip(merged, pieces):
            self.known[w] = struct.pack(f"<{len(got)}I", *[self.ids[i - 1] for i in got])

    def encode(self, text: str) -> bytes:
        words = self.split(text)
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            self._learn(set(words).difference(known))
            return b"".join([known[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes
        return b"".join([of[i] for i in memoryview(ids).cast("I")]) if ids else b""


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """One coder per worker and vocabulary."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) for each row. ``path``: a rank file that every executor has.

    Each match of ``pattern`` is encoded by itself. A null or empty text has no ids; null ids and repeated rows stay;
    other columns are not looked at; an empty table gives no rows. Rows are independent, so nothing is shuffled.
    """

    def rows(ids, texts):
        c = coder(path, pattern)
        return {
            "doc_id": pa.array(ids, pa.int64()),
            "ids": pa.array([list(memoryview(b).cast("I")) if (b := c.encode(t)) else [] for t in texts], pa.list_(pa.int32())),
        }

    return per_text(texts_of(docs, doc_id, text), rows, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, bytes`` for each row of ids; a null array has no bytes."""

    def batches(parts):
        for part in parts:
            c = coder(path, pattern)
            out = [c.decode(struct.pack(f"<{len(x)}I", *x)) if x else b"" for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.selectExpr(f"CAST(`{doc_id}` AS LONG) AS doc_id", f"`{ids}` AS ids").mapInArrow(batches, "doc_id long, bytes binary")


def code_digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row: encoded and decoded again in one pass, so that
    the ids of a long text never leave the worker. Nulls, empty texts and repeated rows as in ``encode_texts``."""

    def rows(ids, texts):
        c = coder(path, pattern)
        coded = [c.encode(t) for t in texts]
        sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
        return {
            "doc_id": pa.array(ids, pa.int64()),
            "n_tokens": pa.array([len(b) // 4 for b in coded], pa.int64()),
            "ids_sha256": sha(coded),
            "decoded_sha256": sha(map(c.decode, coded)),
        }

    return per_text(texts_of(docs, doc_id, text), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark, sf_dir):
    """Every document encoded with the multilingual byte vocabulary and decoded again."""
    import public_tokenizers as vocabularies

    path = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    return code_digests(table(spark, sf_dir, "documents"), path, vocabularies.PATTERN)
