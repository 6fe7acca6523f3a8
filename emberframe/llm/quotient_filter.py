"""Counting quotient filters of packed word numbers, as sorted numpy arrays.

A phrase of ``n`` words, ``bits`` bits each, is one integer of ``2 * half`` bits. A Feistel network permutes these integers: it
spreads them evenly and can be undone, so the permuted integer stands for the phrase without loss. Its leading bits, the
quotient, say where in the filter it lies and are not written; the rest, the remainder, is written whole, with a counter.
Sorted filters of several shards merge into one whose counters are the sums.
"""

from dataclasses import dataclass

import numpy as np

from emberframe.llm.words import mixed

_ROUNDS = [np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1) for k in range(1, 5)]
#: Counters below this take one byte, greater ones are listed behind.
_WIDE = 255


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def half_bits(n: int, bits: int) -> int:
    """Bits of either half of the packed integer."""
    if n * bits > 128:
        raise ValueError(f"{n} words of {bits} bits do not fit a key of 128 bits")
    return max(1, (n * bits + 1) // 2)


def packed(columns: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower half of the integer that the word numbers make, first word highest."""
    high = np.zeros(len(columns[0]), np.uint64)
    low = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        high = high << np.uint64(bits) | low >> np.uint64(64 - bits)
        low = low << np.uint64(bits) | c.astype(np.uint64)
    half = half_bits(len(columns), bits)
    if half == 64:
        return high, low
    upper = low >> np.uint64(half)
    if 2 * half > 64:
        upper |= high << np.uint64(64 - half)
    return upper & _mask(half), low & _mask(half)


def unpacked(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The word numbers, a row per phrase."""
    half = half_bits(n, bits)
    if half == 64:
        high, low = left, right
    else:
        low = right | left << np.uint64(half)
        high = left >> np.uint64(64 - half)
    out = np.empty((len(left), n), np.int64)
    for k in range(n - 1, -1, -1):
        out[:, k] = (low & _mask(bits)).astype(np.int64)
        low = low >> np.uint64(bits) | high << np.uint64(64 - bits)
        high = high >> np.uint64(bits)
    return out


def permuted(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for c in _ROUNDS:
        left, right = right, left ^ mixed(right + c) & _mask(half)
    return left, right


def restored(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for c in reversed(_ROUNDS):
        left, right = right ^ mixed(left + c) & _mask(half), left
    return left, right


@dataclass
class Filter:
    """Permuted keys in rising order, each once, with their counters."""

    half: int
    left: np.ndarray
    right: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.left)


def filter_of(left: np.ndarray, right: np.ndarray, half: int, count: np.ndarray | None = None) -> Filter:
    """The filter of permuted keys in any order; equal keys add up."""
    if 2 * half <= 64:
        key = left << np.uint64(half) | right
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
    else:
        order = np.lexsort((right, left))
        a, b = left[order], right[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(first)
    if count is None:
        sums = np.diff(np.append(at, len(order)))
    else:
        sums = np.add.reduceat(count[order], at) if len(at) else np.zeros(0, np.int64)
    return Filter(half, left[order][at], right[order][at], sums.astype(np.int64))


def merged(filters: list[Filter]) -> Filter:
    join = lambda name: np.concatenate([getattr(f, name) for f in filters])
    return filter_of(join("left"), join("right"), filters[0].half, join("count"))


def _bytes(values: np.ndarray, bits: int) -> bytes:
    width = (bits + 7) // 8
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _values(data: memoryview, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    width = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    return out.reshape(-1).view("<u8").astype(np.uint64), at + n * width


def blocks(f: Filter, range_bits: int):
    """The filter cut by the leading ``range_bits`` of its keys: pairs of range number and bytes, empty ranges left out."""
    number = (f.left >> np.uint64(f.half - range_bits)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(f) else np.zeros(0, np.int64)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(f)]):
        rest = f.half - range_bits
        left, count = f.left[a:b] & _mask(rest), f.count[a:b]
        quotient = min(rest, int(b - a).bit_length())
        runs = np.bincount((left >> np.uint64(rest - quotient)).astype(np.int64), minlength=1 << quotient)
        head = np.array([b - a, quotient, 1 if runs.max() < 256 else 4, int((count >= _WIDE).sum())], "<i8")
        yield int(number[a]), b"".join([
            head.tobytes(),
            runs.astype("<u1" if head[2] == 1 else "<u4").tobytes(),
            _bytes(left & _mask(rest - quotient), rest - quotient),
            _bytes(f.right[a:b], f.half),
            np.minimum(count, _WIDE).astype("<u1").tobytes(),
            count[count >= _WIDE].astype("<i8").tobytes(),
        ])


def read_block(number: int, data: bytes, half: int, range_bits: int) -> Filter:
    """A block of ``blocks`` as a filter."""
    n, quotient, width, n_wide = np.frombuffer(data, "<i8", 4).tolist()
    at = 32
    runs = np.frombuffer(data, "<u1" if width == 1 else "<u4", 1 << quotient, at).astype(np.int64)
    at += width << quotient
    rest = half - range_bits
    left, at = _values(data, at, n, rest - quotient)
    left |= np.repeat(np.arange(1 << quotient, dtype=np.uint64), runs) << np.uint64(rest - quotient)
    if range_bits:
        left |= np.uint64(number) << np.uint64(rest)
    right, at = _values(data, at, n, half)
    count = np.frombuffer(data, "<u1", n, at).astype(np.int64)
    count[count == _WIDE] = np.frombuffer(data, "<i8", n_wide, at + n)
    return Filter(half, left, right, count)
