"""Toxicity by compression distance: windows that a dictionary of toxic text shortens more than one of ordinary text.

Two zstandard dictionaries are made from labelled text. The ordinary one holds the commonest ordinary words. The toxic one
holds the same words and then those of toxic texts that contain tell-tale letter sequences, nearest to the data, where they
are cheapest to refer to. A window is a word in a frame that both dictionaries end with: the frame costs the same in both,
and gives the compressor enough to work on. Bytes saved by the toxic dictionary are the window's evidence; the threshold
for a window and the weights of a document's evidence are calibrated on labelled texts that made no dictionary.
"""

from collections import Counter
from math import exp, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import per_text, table, texts_of

#: Labelled texts learnt from, at most, by class: those whose ids hash lowest. Half make the dictionaries, half calibrate.
TOXIC, ORDINARY = 3000, 6000
#: Letters in a tell-tale sequence; how many times commoner it must be in toxic texts, the share and number of them it must be in.
LETTERS, LIFT, SHARE, TEXTS = 6, 15.0, 0.02, 3
#: Bytes of the dictionaries' common and toxic parts.
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 8_192
#: A byte string that prose does not hold.
FRAME = "<q7#Zr!v0Kp%Xw3^Lj&>"
THRESHOLDS = range(2, 9)
#: Words whose saving a worker remembers; when full, the memory starts anew.
REMEMBERED = 300_000


def windows(text: str) -> list[str]:
    return text.lower().split()


def sequences(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + LETTERS] for i in range(max(1, len(padded) - LETTERS + 1))]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary."""
    bare = lambda text: (w.strip(".,;:!?\"'()") for w in windows(text))
    held = [Counter(), Counter()]
    for side, texts in enumerate((ordinary, toxic)):
        for text in texts:
            held[side].update({s for w in set(bare(text)) for s in sequences(w)})
    n0, n1 = len(ordinary), len(toxic)

    lift = lambda s: (held[1][s] + 0.5) / n1 / ((held[0][s] + 0.5) / n0)
    marks = {s for s, n in held[1].items() if n >= max(TEXTS, SHARE * n1) and lift(s) >= LIFT}
    told = Counter(w for text in toxic for w in bare(text) if any(s in marks for s in sequences(w)))
    common = Counter(w for text in ordinary for w in windows(text))
    # rarest first, so that what a cut at the front loses is rare
    lined = lambda words, most: (" " + " ".join(sorted(words, key=lambda w: (words[w], w))) + " ").encode()[-most:] if words else b""
    frame = f" {FRAME} ".encode()
    shared = lined(dict(common.most_common(6000)), ORDINARY_BYTES)
    return shared + frame, shared + lined(told, TOXIC_BYTES) + frame


class Meter:
    """Bytes that the toxic dictionary saves for a word, against the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        def compressor(content: bytes):
            parameters = z.ZstdCompressionParameters(
                window_log=16, hash_log=15, chain_log=14, search_log=4, min_match=3, target_length=32, strategy=z.STRATEGY_LAZY,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            held = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            return z.ZstdCompressor(compression_params=parameters, dict_data=held).compress

        self.plain, self.other = compressor(ordinary), compressor(toxic)
        self.known: dict[str, int] = {}

    def saved(self, word: str) -> int:
        framed = f"{FRAME} {word} {FRAME}".encode()
        return len(self.plain(framed)) - len(self.other(framed))

    def savings(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for w in words:
            if (s := known.get(w)) is None:
                s = self.saved(w)
                if len(w) < 64:
                    known[w] = s
            out.append(s)
        return out


def evidence(savings: list[int], threshold: int) -> list[float]:
    over = sum(s >= threshold for s in savings)
    return [1.0, (over / max(1, len(savings))) ** 0.5, log1p(over), min(8, max(savings, default=0)) / 8]


def calibrated(rows: list[tuple[list[int], int]]) -> tuple[int, list[float]]:
    """The window threshold that parts the classes best, and the weights of a logistic curve over the evidence."""
    y = np.array([t for _, t in rows], float)
    best = (-1.0, 0, np.zeros(4))
    for threshold in THRESHOLDS:
        x = np.array([evidence(s, threshold) for s, _ in rows])
        w = np.zeros(4)
        for _ in range(40):  # Newton's method with a slight pull to 0
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (p - y) + 0.1 * w
            w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(4), slope)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
        fit = float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        if best[1] == 0 or fit > best[0]:
            best = fit, threshold, w
    return best[1], best[2].tolist()


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY):
    """The model from rows of ``labels`` (doc_id, toxic) whose crc32 of the id, modulo 5, is not 0; None where a class is
    missing. An id that is labelled twice counts as toxic if it ever is; null labels say nothing."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(~is_held_out("doc_id"))
    chosen = None
    for side, most in ((1, toxic), (0, ordinary)):
        part = known.filter(F.col("toxic") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.join(F.broadcast(chosen), "doc_id")  # at most ``toxic + ordinary`` ids
    rows = texts.groupBy("doc_id", "toxic").agg(F.first("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    halves = [rows.iloc[k::2] for k in (0, 1)]
    if any(set(h["toxic"]) != {0, 1} for h in halves):
        return None
    first, second = halves
    made = dictionaries(first["text"][first["toxic"] == 1].tolist(), first["text"][first["toxic"] == 0].tolist())
    meter = Meter(*made)
    threshold, weights = calibrated([(meter.savings(windows(t)), y) for t, y in zip(second["text"], second["toxic"].tolist())])
    return made, threshold, weights


def is_held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


_meters: dict[tuple[bytes, bytes], Meter] = {}


def _scores(model, texts) -> list[float]:
    if model is None:
        return [0.0] * len(texts)
    made, threshold, weights = model
    meter = _meters.get(made) or _meters.setdefault(made, Meter(*made))
    scores = []
    for t in texts:
        x = sum(w * e for w, e in zip(weights, evidence(meter.savings(windows(t or "")), threshold)))
        scores.append(1 / (1 + exp(-min(30.0, max(-30.0, x)))))
    return scores


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; the score comes from the whole text alone.

    ``held_out``: the row was kept out of learning (crc32 of its id as text is divisible by 5; null ids are out, too). What
    is learnt from is bounded by TOXIC and ORDINARY, everything is scored. A null or empty text scores as one without
    evidence. Without labels of both classes every score is 0. Repeated rows repeat their score; other columns are not
    looked at; an empty table gives no rows. Scoring shuffles nothing.
    """
    docs = texts_of(docs, doc_id, text)
    model = fit(docs, labels)
    rows = lambda ids, texts: {"doc_id": pa.array(ids, pa.int64()), "score": pa.array(_scores(model, texts), pa.float64())}
    scored = per_text(docs, rows, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(is_held_out("doc_id"), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that score below one half, all columns as they are. See ``toxicity``."""
    model = fit(texts_of(docs), labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores(model, texts))

    return docs.filter(score(F.col("text")) < 0.5)


def op3_toxicity(spark, sf_dir):
    """The toxicity of every document, learnt from the labelled ones that are not held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
