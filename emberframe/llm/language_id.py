"""Language of texts by a bidirectional gated recurrent network over bytes, trained in numpy.

Two gated recurrent layers read a window of bytes, one forwards and one backwards. At every byte both states together give a
probability for each language. A document's probabilities are the means over all its bytes. Training is back-propagation through
time on windows of a bounded sample of labelled documents; a network is a few hundred kilobytes and goes to the tasks as such.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import table

#: Learnt from, at most: documents of a language (those whose ids hash lowest), windows of a document, characters of a window.
DOCUMENTS, WINDOWS, LETTERS = 300, 4, 80
#: Size of a state, bytes of a training window, windows of a training step, steps.
STATE, SPAN, BATCH, STEPS = 12, 64, 64, 300
RATE, SEED = 0.01, 7
#: A text is read in windows of this many bytes, so many at a time.
READ, ROWS = 256, 1024
UNKNOWN = "und"
#: Parts of a language whose first documents are found side by side.
PARTS = 64


class Network:
    """What a byte adds to both gates and to the candidate, per direction (``byte``: 3, 2, 256, state), what the state adds
    (``state``: 3, 2, state, state), and what the states add up to for the languages (``out``, ``bias``).

    The gates are clipped lines, the candidate is x / (1 + |x|): as curves they do as well as the usual ones, at a fraction of
    their cost."""

    def __init__(self, byte, state, out, bias):
        self.byte, self.state, self.out, self.bias = byte, state, out, bias

    @classmethod
    def fresh(cls, languages: int, size: int, random: np.random.Generator) -> "Network":
        normal = lambda scale, *shape: (random.standard_normal(shape) * scale).astype(np.float32)
        byte, state = normal(0.3, 3, 2, 256, size), normal(size**-0.5, 3, 2, size, size)
        byte[:2] = 0.5 + 0.3 * byte[:2]
        state[:2] *= 0.3
        return cls(byte, state, normal(size**-0.5, 2, size, languages), np.zeros(languages, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.byte, self.state, self.out, self.bias]

    def steps(self, windows: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """The states (2, windows, size) after each byte of ``windows`` (bytes, 2, windows): forwards and backwards. What is
        yielded is overwritten by the next step, unless ``keep`` gathers what the way back needs."""
        shape = (2, windows.shape[2], self.state.shape[2])
        kind = self.state.dtype
        h, gates, x = np.zeros(shape, kind), np.empty((2, *shape), kind), np.empty((3, *shape), kind)
        n, scale = np.empty(shape, kind), np.empty(shape, kind)
        for row in windows:
            for k in range(3):
                for d in (0, 1):
                    self.byte[k, d].take(row[d], 0, out=x[k, d], mode="clip")
            np.matmul(h, self.state[:2], out=gates)
            gates += x[:2]
            np.clip(gates, 0, 1, out=gates)
            z, r = gates
            np.matmul(h, self.state[2], out=n)
            recalled = n.copy() if keep is not None else None
            n *= r
            n += x[2]
            np.abs(n, out=scale)
            scale += 1
            n /= scale
            if keep is not None:
                keep.append((h.copy(), z.copy(), r.copy(), n.copy(), recalled, scale.copy()))
            h -= n
            h *= z
            h += n
            yield h

    def logits(self, windows: np.ndarray, sizes: np.ndarray, states: list[np.ndarray] | None = None, keep=None) -> np.ndarray:
        """Scores (bytes, windows, languages); ``sizes`` are the windows' lengths, places beyond them hold anything."""
        length, count = len(windows), windows.shape[2]
        each = np.empty((2, length, count, len(self.bias)), self.out.dtype)
        for t, h in enumerate(self.steps(windows, keep)):
            if states is not None:
                states.append(h.copy())
            np.matmul(h, self.out, out=each[:, t])
        ahead, back = each
        if sizes.min() == length:
            ahead += back[::-1]
        else:
            ahead += np.take_along_axis(back, _mirror(sizes, length)[..., None], 0)
        ahead += self.bias
        return ahead


def _mirror(sizes: np.ndarray, length: int) -> np.ndarray:
    """(bytes, windows): the step of the backward reader at which it has read the byte."""
    return np.maximum(sizes[None, :] - 1 - np.arange(length)[:, None], 0)


def both_ways(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows as they are and reversed (bytes, 2, windows), filled up with zeros; their sizes."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    out = np.zeros((2, len(pieces), length), np.uint8)
    inside = np.arange(length) < sizes[:, None]
    out[0][inside] = np.frombuffer(b"".join(pieces), np.uint8)
    out[1][inside] = np.frombuffer(b"".join(p[::-1] for p in pieces), np.uint8)
    return np.ascontiguousarray(out.transpose(2, 0, 1)).astype(np.int64), sizes


def softmax(x: np.ndarray) -> np.ndarray:
    """Along the last axis, which is short: its columns are taken one by one."""
    columns = [x[..., k] for k in range(x.shape[-1])]
    most = columns[0].copy()
    for c in columns[1:]:
        np.maximum(most, c, out=most)
    out = np.exp(x - most[..., None])
    total = out[..., 0].copy()
    for k in range(1, len(columns)):
        total += out[..., k]
    out /= total[..., None]
    return out


def gradients(net: Network, windows: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all bytes and its slope for each part of the network, by back-propagation through time."""
    states: list[np.ndarray] = []
    keep: list[tuple] = []
    p = softmax(net.logits(windows, sizes, states, keep))
    length, count, size = len(states), len(sizes), net.state.shape[2]
    inside = np.arange(length)[:, None] < sizes[None, :]
    total = inside.sum()
    hit = p[np.arange(length)[:, None], np.arange(count)[None, :], labels[None, :]]
    loss = -float(np.log(np.maximum(hit, 1e-9))[inside].sum() / total)
    p[np.arange(length)[:, None], np.arange(count)[None, :], labels[None, :]] -= 1
    slope = p * inside[..., None] / total
    # the backward reader's steps, each at the byte it read
    turned = np.take_along_axis(slope, _mirror(sizes, length)[..., None], 0) * inside[..., None]
    slopes = np.stack([slope, turned], 1)
    h = np.stack(states)
    flat = lambda x: x.reshape(-1, x.shape[-1])
    d_out = np.stack([flat(h[:, d]).T @ flat(slopes[:, d]) for d in (0, 1)])
    d_state = np.zeros_like(net.state)
    d_byte = np.empty((length, 3, 2, count, size), net.byte.dtype)
    down = np.zeros_like(h[0])
    turn = lambda x: x.swapaxes(-1, -2)
    for t in range(length - 1, -1, -1):
        before, z, r, n, recalled, scale = keep[t]
        down = down + slopes[t] @ turn(net.out)
        into = d_byte[t]
        into[2] = down * (1 - z) / (scale * scale)
        into[0] = down * (before - n) * ((z > 0) & (z < 1))
        into[1] = into[2] * recalled * ((r > 0) & (r < 1))
        from_state = np.stack([into[0], into[1], into[2] * r])
        d_state += turn(before) @ from_state
        down = down * z + (from_state @ turn(net.state)).sum(0)
    letters = np.arange(256)[:, None]
    each = [(letters == windows[:, d].reshape(-1)).astype(net.byte.dtype) for d in (0, 1)]
    return loss, [np.stack([[each[d] @ flat(d_byte[:, k, d]) for d in (0, 1)] for k in range(3)]), d_state, d_out, flat(slope).sum(0)]


def trained(pieces: list[bytes], labels: np.ndarray, languages: int, steps: int = STEPS, size: int = STATE) -> Network:
    """A network learnt from windows and the numbers of their languages, all languages alike often."""
    random = np.random.default_rng(SEED)
    net = Network.fresh(languages, size, random)
    windows, sizes = both_ways([p[:SPAN] for p in pieces], SPAN)
    of = [np.flatnonzero(labels == k) for k in range(languages)]
    first = [np.zeros_like(p) for p in net.parts()]
    second = [np.zeros_like(p) for p in net.parts()]
    for step in range(1, steps + 1):
        chosen = np.array([random.choice(of[k]) for k in random.integers(0, languages, BATCH)])
        _, slopes = gradients(net, windows[:, :, chosen], sizes[chosen], labels[chosen])
        norm = np.sqrt(sum(float((g * g).sum()) for g in slopes))
        rate = RATE * min(1.0, 2 - 2 * step / (steps + 1))
        for p, g, m, v in zip(net.parts(), slopes, first, second):  # Adam
            g = g * min(1.0, 1 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (texts, languages) over all bytes of each text; an empty text has none (zeros)."""
    pieces = [(len(t[at : at + READ]), i, at) for i, t in enumerate(texts) for at in range(0, len(t), READ)]
    pieces.sort()  # windows of about one length together
    sums = np.zeros((len(texts), len(net.bias)))
    for at in range(0, len(pieces), ROWS):
        part = pieces[at : at + ROWS]
        windows, sizes = both_ways([texts[i][begin : begin + READ] for _, i, begin in part], part[-1][0])
        p = softmax(net.logits(windows, sizes))
        if sizes.min() < len(p):
            p *= (np.arange(len(p))[:, None] < sizes[None, :])[..., None]
        np.add.at(sums, [i for _, i, _ in part], p.sum(0))
    return sums / np.maximum([[len(t)] for t in texts], 1) if texts else sums


def is_held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, documents: int = DOCUMENTS) -> tuple[list[str], Network] | None:
    """Languages and network learnt from ``doc_id, lang, text`` rows that are not held out; None where there are none.

    At most ``documents`` rows of a language and WINDOWS windows of a row come to the driver, however long the texts.
    """
    known = docs.filter(~is_held_out("doc_id") & F.col("lang").isNotNull() & (F.length("text") > 0))
    last = F.greatest(F.length("text") - LETTERS, F.lit(0))
    places = [F.substring("text", (last * k / max(1, WINDOWS - 1)).cast("int") + 1, F.lit(LETTERS)) for k in range(WINDOWS)]
    known = known.select("lang", F.xxhash64("doc_id").alias("_hash"), "doc_id", F.xxhash64("text").alias("_text"), F.array_distinct(F.array(*places)).alias("windows"))
    lowest = lambda rows, *by: rows.withColumn("_row", F.row_number().over(Window.partitionBy("lang", *by).orderBy("_hash", "doc_id", "_text"))).filter(F.col("_row") <= documents)
    # first within parts of a language, so that no task is given what all tasks have kept of it
    parts = known.withColumn("_part", F.pmod(F.xxhash64("_hash", "_text"), F.lit(PARTS)))
    chosen = lowest(lowest(parts, "_part"))
    rows = chosen.select("lang", F.explode("windows").alias("text")).orderBy("lang", "text").collect()
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    labels = np.array([languages.index(r.lang) for r in rows])
    return languages, trained([r.text.encode() for r in rows], labels, len(languages))


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row; the prediction comes from the whole text alone.

    ``held_out``: crc32 of the id as text leaves 1 when divided by 3, or the id is null; such rows and those without language
    are not learnt from. What is learnt from is bounded by DOCUMENTS, everything is predicted. A null text, or one without a
    letter, is ``und`` with score 0, and so is everything if there is nothing to learn from. Ties go to the lower language.
    Repeated rows repeat their prediction; other columns are not looked at; an empty table gives no rows. Predicting shuffles
    nothing; long texts are read in windows, so a task holds one Arrow batch and a few megabytes.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    model = fit(docs)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 512):
                piece = part.slice(at, 512)
                texts = piece.column(1).to_pylist()
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if model is not None:
                    told = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
                    means = pooled(model[1], [texts[i].encode() for i in told])
                    for i, p in zip(told, means):
                        names[i], scores[i] = model[0][int(p.argmax())], min(1.0, float(p.max()))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    read = docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, lang_pred string, score double")
    return read.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_language_id(spark, sf_dir):
    """The language of every document, learnt from those that are not held out."""
    return languages(table(spark, sf_dir, "documents"))
