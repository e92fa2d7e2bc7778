"""Periodic runs of words by heavy/light lag counting.

For every lag of a text, the number of places whose word comes again that many words later is counted exactly: the
autocorrelation of each frequent word's places by FFT, and the differences of pairs of places for all other words.
A run of period q and least(q) words or more holds `need(q)` such places at lag q, so only lags with that many are
scanned for islands of consecutive matches. An island of lag q plus q words is a stretch with period q that no
neighbour extends.

Lags are taken in octaves, from small ones up. A run found at lag p also matches at p's multiples; these matches are
taken off the counts before the next octave, since an island of a multiple that is not the run itself shares none of
them, and a stretch that comes up again is left out. Inside one octave no lag is a multiple of another, so the first
lag that finds a stretch is its smallest period.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import _text as T
from orrery.llm._spark import id_text

CELLS = 1 << 21  # of islands scanned, and of spectra, held at a time


def word_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word; equal numbers are equal words, byte by byte."""
    data, size = buf[~T.SPACE[buf]], np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    at = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - at, sizes)


class LagCounts:
    """counts[first[r] + q]: places of row r whose word comes again q words later, for q of at most a third of its words."""

    def __init__(self, codes: np.ndarray, off: np.ndarray):
        size = np.diff(off)
        self.limit = size // 3
        self.first = np.concatenate([[0], np.cumsum(self.limit + 1)])
        self.counts = np.zeros(int(self.first[-1]), np.int64)
        row = np.repeat(np.arange(len(size)), size)
        order = np.argsort(row * (int(codes.max(initial=0)) + 1) + codes, kind="stable")
        r, c = row[order], codes[order]
        new = np.ones(len(order), bool)
        new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin, len(order))[1:]
        # a pair costs a few operations, a place of the spectrum log n of them
        most = np.maximum(16, np.sqrt(size * np.log2(np.maximum(size, 2))) / 2)
        heavy = end - begin > most[r[begin]]
        self._light(order, r, np.repeat(end, end - begin), np.repeat(~heavy, end - begin))
        self._heavy(order, r, begin[heavy], end[heavy], off)

    def _light(self, order: np.ndarray, r: np.ndarray, end: np.ndarray, light: np.ndarray) -> None:
        live, step = np.flatnonzero(light), 1
        while True:
            live = live[live + step < end[live]]
            lag = order[live + step] - order[live]
            near = lag <= self.limit[r[live]]  # the next pairs of a place are further apart still
            live, lag = live[near], lag[near]
            if not len(live):
                return
            np.add.at(self.counts, self.first[r[live]] + lag, 1)
            step += 1

    def _heavy(self, order: np.ndarray, r: np.ndarray, begin: np.ndarray, end: np.ndarray, off: np.ndarray) -> None:
        of = r[begin]
        for k in np.unique(of).tolist():
            n, lags = int(off[k + 1] - off[k]), int(self.limit[k])
            width = 1 << int(n + lags).bit_length()
            power, mine = np.zeros(width // 2 + 1), np.flatnonzero(of == k)
            for part in np.array_split(mine, -(-len(mine) * width // CELLS)):
                grid = np.zeros((len(part), width))
                for j, g in enumerate(part.tolist()):
                    grid[j, order[begin[g] : end[g]] - off[k]] = 1
                power += (np.abs(np.fft.rfft(grid, axis=1)) ** 2).sum(axis=0)
            # sums of at most n ones: far from the next half in double precision
            self.counts[self.first[k] : self.first[k + 1]] += np.rint(np.fft.irfft(power, width)[: lags + 1]).astype(np.int64)


def find(codes: np.ndarray, off: np.ndarray, words: int = 24, times: int = 3) -> tuple[np.ndarray, ...]:
    """row, start (in its row), length and period of every run, in order of row, start and period.

    A run has at least `words` words and at least `times` (3 or more) periods.
    """
    if times < 3:
        raise ValueError("runs of under three periods can overlap their multiples")
    n = len(off) - 1
    found: list[tuple[np.ndarray, ...]] = []
    lags = LagCounts(codes, off)
    row = np.repeat(np.arange(n), lags.limit + 1)
    lag = np.arange(len(row)) - lags.first[row]
    need = np.maximum(words - lag, (times - 1) * lag)
    fits = (lag > 0) & (np.maximum(words, times * lag) <= np.diff(off)[row])
    least = np.zeros(n, np.int64)  # smaller lags of a row are done
    seen: set[tuple[int, int, int]] = set()  # stretches found; their multiples may come up again
    while True:
        some = np.flatnonzero(fits & (lags.counts >= need) & (lag >= least[row]))
        if not len(some):
            break
        q0 = np.full(n, 1 << 62)
        np.minimum.at(q0, row[some], lag[some])
        now = some[lag[some] < 2 * q0[row[some]]]
        size = np.diff(off)[row[now]] - lag[now]
        for part in np.split(now, np.searchsorted(np.cumsum(size), np.arange(CELLS, int(size.sum()), CELLS))):
            got = _islands(codes, off, row[part], lag[part], need[part])
            new = np.array([x not in seen for x in zip(*(x.tolist() for x in got[:3]), strict=True)], bool)
            found.append(tuple(x[new] for x in got))
            for k, start, length, q in zip(*(x.tolist() for x in found[-1]), strict=True):
                seen.add((k, start, length))
                many = np.arange(2 * q, min(length, int(lags.limit[k])) + 1, q)
                lags.counts[lags.first[k] + many] -= length - many
        least = np.where(q0 < 1 << 62, 2 * q0, least)
    r, s, length, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
    order = np.lexsort((q, s, r))
    return r[order], s[order], length[order], q[order]


def _islands(codes: np.ndarray, off: np.ndarray, row: np.ndarray, lag: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the given lags of rows."""
    size = off[row + 1] - off[row] - lag
    at = ragged(off[row], size)
    bound = np.concatenate([[0], np.cumsum(size)])
    start, end, first = T.runs(codes[at] == codes[at + np.repeat(lag, size)], bound)
    of = np.repeat(np.arange(len(row)), np.diff(first))
    long = end - start >= need[of]
    start, end, of = start[long], end[long], of[long]
    return row[of], start - bound[of], end - start + lag[of], lag[of]


def reordered(docs: DataFrame, order: Callable[[np.ndarray, np.ndarray], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text per row, with words taken in another order and joined by one space.

    order(ids, sizes) gives, for all words of all rows one after the other, the number of the word (in its row) that
    stands there; ids is -1 for null.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            buf, off = T.flat(part.column("text"))
            starts, ends, word_off = T.word_bounds(buf, off)
            ids = part.column("doc_id").fill_null(-1).to_numpy()
            at = order(ids, np.diff(word_off)) + np.repeat(word_off[:-1], np.diff(word_off))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "text": joined(buf, starts[at], ends[at], word_off)})

    return id_text(docs, id_col, text_col).mapInArrow(take, "doc_id long, text string")


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, off: np.ndarray) -> pa.Array:
    """The words of each row joined by one space."""
    at = ragged(starts, ends - starts + 1)
    stop = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    data = np.append(buf, np.uint8(32))[at]
    data[stop[1:] - 1] = 32
    last = np.zeros(len(data), bool)
    last[stop[off[1:][np.diff(off) > 0]] - 1] = True
    size = np.concatenate([[0], np.cumsum(np.diff(stop[off]) - (np.diff(off) > 0))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(size), pa.py_buffer(data[~last])]).cast(pa.string())


SHAPE = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string"


def collapse(docs: DataFrame, words: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), kept_text per row.

    kept_text has the words that no run contains after its first period, joined by one space. Null and empty texts
    have no words, no runs and an empty kept_text. Texts are judged one by one, whole, so repeated rows, ids and
    further columns make no difference; an empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            buf, off = T.flat(part.column("text"))
            starts, ends, word_off = T.word_bounds(buf, off)
            row, start, length, period = find(word_codes(buf, starts, ends), word_off, words, times)
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, word_off[row] + start + period, 1)
            np.add.at(change, word_off[row] + start + length, -1)
            left = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"]))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_words": pa.array(np.diff(word_off)), "runs": lists, "kept_text": joined(buf, starts[left], ends[left], np.searchsorted(left, word_off))})

    return id_text(docs, id_col, text_col).mapInArrow(cut, SHAPE)


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(found: DataFrame) -> DataFrame:
    """DIGEST of what collapse returns: the run of greatest length / period (ties: smallest start, then period), and checksums."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for runs, kept in zip(b.column("runs").to_pylist(), b.column("kept_text").to_pylist(), strict=True):
                lines = "".join(f"{x['start']},{x['length']},{x['period']}\n" for x in runs)
                top = max(runs, key=lambda x: (Fraction(x["length"], x["period"]), -x["start"], -x["period"]), default=None)
                best = (top["start"], top["length"], top["period"], 1000 * top["length"] // top["period"]) if top else (None,) * 4
                out.append((len(runs), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.record_batch({"doc_id": b.column("doc_id")} | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return found.select("doc_id", "runs", F.col("kept_text")).mapInArrow(shorten, DIGEST)
