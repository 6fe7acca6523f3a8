"""Words and word shingles of whole batches of texts, hashed with numpy straight from the bytes.

A word is a run of bytes other than space, tab and the four control characters after tab; A-Z count as a-z. Bytes of
characters beyond ASCII are never separators, so words come out as they would from the decoded text.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes hashed at a time: a chunk ends after the text that reaches it.
CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser known from splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


@dataclass
class Words:
    """Words of some texts: ``first[i]:first[i + 1]`` are those of text ``i``."""

    first: np.ndarray
    start: np.ndarray  # byte within the text
    end: np.ndarray
    code: np.ndarray  # hash of the word

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words_of(texts: list[bytes]) -> Words:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_GAP[data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[begin] = True
    after = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~after | edge))
    ends = np.flatnonzero(after & (~inside | edge))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * powers(_BASE, n), out=total[1:])
    code = mixed((total[ends] - total[starts]) * powers(_BACK, n + 1)[starts])
    first = np.searchsorted(starts, begin)
    base = np.repeat(begin[:-1], np.diff(first))
    return Words(first, starts - base, ends - base, code)


def rolled(code: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words, by its first word; shorter by ``width - 1``."""
    out = np.zeros(max(0, len(code) - width + 1), np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + code[k : k + len(out)]
    return mixed(out + np.uint64(width))


def shingles(words: Words, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending. A text with fewer words has one shingle, all its words."""
    every = rolled(words.code, width)
    out = []
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if end - begin >= width:
            hashes = np.sort(every[begin : end - width + 1])
            out.append(hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])])
        else:
            out.append(rolled(words.code[begin:end], end - begin) if end > begin else every[:0])
    return out


def chunks(ids: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    """Pieces of a batch, each ended by the text that brings it to CHUNK bytes."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield ids[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield ids[at:], texts[at:]
