"""Vectorised helpers over Arrow text batches: byte views, words, hashes.

Everything works on a flat UTF-8 buffer of a bounded slice of a batch, so a task's memory does not depend on
the length of the batch. A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 equals
the same run over code points.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has at most rows rows, and at most limit bytes in column or one row."""
    for batch in batches:
        _, offsets = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string or binary column, and row offsets (one more than rows) into them."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits: spreads every bit of h over all bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_K1, _K2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
LONG_SPAN = 256  # bytes above which a span is hashed by the library


def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One hash of two, in order; nested, a hash of sequences without the algebra of polynomials modulo 2**64."""
    return mix(x * _K1 + y * _K2)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one integer, zeros beyond the end; one more place than bytes."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded.data, strides=(1,))


FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)  # masks of the first k bytes


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for each pair: eight bytes at a time, all spans at once."""
    size = ends - starts
    h = mix(size.astype(U) * _K2 + U(seed))
    if not len(h):
        return h
    at8 = eights(buf)
    live, k = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(live):
        block = at8[starts[live] + k] & FIRST[np.minimum(size[live] - k, 8)]
        h[live] = combine(h[live], block)
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return h


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, in log k steps; none if there are fewer."""
    if len(values) < k:
        return np.zeros(0, U)
    h, span = values, 1
    while span * 2 <= k:
        h, span = combine(h[:-span], h[span:]), span * 2
    return h if span == k else combine(h[: len(h) - (k - span)], h[k - span :])


def run_hashes(grams: np.ndarray, k: int, starts: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """Hashes of spans of k to longest values from the hashes of their k-grams."""
    h = mix((ends - starts).astype(U) + _K1)
    for j in range(-(-longest // k)):
        h = combine(h, grams[np.minimum(starts + j * k, ends - k)])
    return h


P61 = U((1 << 61) - 1)
_LOW31, _LOW30, _LOW32 = U((1 << 31) - 1), U((1 << 30) - 1), U((1 << 32) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & P61) + (x >> U(61))
    return np.where(x >= P61, x - P61, x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo 2**61 - 1, both below it."""
    x1, x0, y1, y0 = x >> U(31), x & _LOW31, y >> U(31), y & _LOW31
    middle = x1 * y0 + x0 * y1
    return _reduced(U(2) * (x1 * y1) + (middle >> U(30)) + ((middle & _LOW30) << U(31)) + x0 * y0)


_BASE = secrets.randbelow((1 << 61) - (1 << 33)) + (1 << 32)
_POWERS = [np.ones(1, U), np.ones(1, U)]  # of the base and its inverse, kept and doubled as needed


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    for k, b in enumerate((_BASE, pow(_BASE, -1, int(P61)))):
        while len(_POWERS[k]) < n:
            have = _POWERS[k]
            _POWERS[k] = np.concatenate([have, times(have, U([pow(b, len(have), int(P61))]))])
    return _POWERS[0][:n], _POWERS[1][:n]


class PrefixHash:
    """Polynomial hashes modulo 2**61 - 1, to a base drawn at random in each process, of any span of bytes."""

    def __init__(self, buf: np.ndarray):
        up, self.down = powers(len(buf) + 1)
        term = times(buf.astype(U) + U(1), up[:-1])
        low, high = np.cumsum(term & _LOW32, dtype=U), np.cumsum(term >> U(32), dtype=U)
        self.sums = np.zeros(len(buf) + 1, U)
        self.sums[1:] = _reduced(times(_reduced(high), U([1 << 32])) + _reduced(low))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of buf[start:end] for each pair; equal spans anywhere have equal hashes."""
        return times(_reduced(self.sums[ends] + (P61 - self.sums[starts])), self.down[starts])


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and word offsets by row (one more than rows); no word crosses a row."""
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    return runs(~SPACE[buf], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_bounds for any set of bytes: maximal runs of inside within rows."""
    n = len(inside)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A mixed 64-bit hash of each word's bytes."""
    return span_hashes(buf, starts, ends, seed)


def windows(word_offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window of length words inside one row, and its row."""
    counts = np.maximum(np.diff(word_offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return word_offsets[row] + within, row


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    out = buf.copy()
    upper = (out >= 65) & (out <= 90)
    out[upper] |= 32
    return out


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in some [start, start + length)."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, n), -1)
    return np.cumsum(change[:-1]) > 0
