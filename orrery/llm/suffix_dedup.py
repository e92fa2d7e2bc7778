"""Suffix-array deduplication of byte strings.

Every byte covered by a `length`-byte string that also starts in a document with a smaller id is removed. _repeats.py
finds the stretches of text around anchors that may be in several places, equal ones counted together. For each anchor
its distinct stretches are sorted as suffixes, from the anchor to the right and, reversed, from the anchor to the left: a mergesort whose
comparisons find the common extension of two suffixes by binary search over prefix polynomial hashes, so that a
comparison takes logarithmically many steps. Common extensions of neighbours in the sorted orders are verified byte
by byte against hash collisions. Two stretches share a window with l bytes left of the anchor if they lie in one run
of common extensions of length - l to the right and in one of l to the left; the least document id of all that do
is the window's first document, and documents after it lose these bytes.

An anchor with more than `most` distinct stretches does not fit one task. Its windows, as bytes, are dealt by their
content instead and grouped by it exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import _repeats as R
from orrery.llm import _text as T
from orrery.llm._spark import Scratch, partitions

GROUP = 4096  # distinct stretches sorted at a time, about


class Suffixes:
    """Suffixes of one flat buffer, compared by hashes: buf[start:end] for each start and end."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.buf, self.start, self.size = np.append(buf, np.uint8(0)), start, end - start
        self.hashes = T.PrefixHash(buf)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common start of suffixes x and y, by binary search over prefix hashes."""
        a, b = self.start[x], self.start[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hashes.spans(a, a + mid) == self.hashes.spans(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray, strict: np.ndarray) -> np.ndarray:
        """x < y, or x <= y where not strict."""
        n = self.common(x, y)
        end_x, end_y = n == self.size[x], n == self.size[y]
        byte = self.buf[np.minimum(self.start[x] + n, len(self.buf) - 1)] < self.buf[np.minimum(self.start[y] + n, len(self.buf) - 1)]
        return np.where(end_x & end_y, ~strict, np.where(end_x, True, np.where(end_y, False, byte)))

    def verified(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """common(x, y), cut where the bytes differ although the hashes agree."""
        n = self.common(x, y)
        of = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        differ = self.buf[self.start[x][of] + k] != self.buf[self.start[y][of] + k]
        out = n.copy()
        np.minimum.at(out, of[differ], k[differ])
        return out


def merge_sort(s: Suffixes, groups: np.ndarray) -> np.ndarray:
    """Suffix numbers in order within each group; groups are the first places of runs of suffixes, and the end.

    Bottom up: each suffix finds its place in the neighbouring run by binary search, all suffixes at once.
    """
    n = groups[-1]
    order, size = np.arange(n), np.diff(groups)
    first, many = np.repeat(groups[:-1], size), np.repeat(size, size)
    place = np.arange(n) - first
    run = 1
    while run < size.max(initial=0):
        live = np.flatnonzero(many > run)
        block = place[live] // run
        low = np.minimum((block ^ 1) * run, many[live])
        from_, high = low.copy(), np.minimum(low + run, many[live])
        left = block & 1 == 0
        me = order[live]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            other = order[first[live[open_]] + mid]
            # of the left run: others that are less; of the right run: others that are not greater
            less = s.before(other, me[open_], left[open_])
            low[open_], high[open_] = np.where(less, mid + 1, low[open_]), np.where(less, high[open_], mid)
        to = (block >> 1) * 2 * run + place[live] - block * run + low - from_
        order[first[live] + to] = me
        run *= 2
    return order


def neighbours(s: Suffixes, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and how much each has in common with the one before; -1 for the first of a group."""
    order = merge_sort(s, groups)
    common = np.full(len(order), -1)
    inner = np.ones(len(order), bool)
    inner[groups[:-1]] = False
    k = np.flatnonzero(inner)
    common[k] = s.verified(order[k - 1], order[k])
    return order, common


def first_documents(buf: np.ndarray, off: np.ndarray, anchor: np.ndarray, groups: np.ndarray, least: np.ndarray, length: int, k: int) -> np.ndarray:
    """Strings x places left of the anchor: the least id of all strings of the group that hold the window which
    begins so many bytes before the anchor; NO_ID where the string has no such window.

    buf, off: the strings; anchor: place of the anchor in each, of k bytes; groups: first strings of groups, and the end.
    """
    n, size, at = len(anchor), np.diff(off), off[:-1] + anchor
    out = np.full((n, length - k + 1), R.NO_ID)
    to_right = np.arange(len(buf)) >= np.repeat(at, size)
    end = np.cumsum(size - anchor)
    right, after = neighbours(Suffixes(buf[to_right], end - (size - anchor), end), groups)
    end = np.cumsum(anchor)
    left, before = neighbours(Suffixes(buf[~to_right][::-1], end[-1] - end, end[-1] - end + anchor), groups)
    run_right, run_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(length - k + 1):
        sel = np.flatnonzero((anchor >= l) & (size - anchor >= length - l))
        if not len(sel):
            continue
        run_right[right], run_left[left] = np.cumsum(after < length - l), np.cumsum(before < l)
        run = run_right[sel] * (n + 1) + run_left[sel]
        order = np.argsort(run, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(run[order]) != 0]))
        out[sel[order], l] = np.repeat(np.minimum.reduceat(least[sel[order]], first), np.diff(np.append(first, len(sel))))
    return out


KNOWN = 'a long, s long, from int, to int, first long'


def _windows_after_first(anchor: np.ndarray, first: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """String, first and last window (places in the string) and first document, for windows that are also in a later one."""
    n, width = first.shape
    flat = first[:, ::-1].ravel()  # windows in ascending place
    some = flat < np.repeat(most, width)
    begins = np.ones(n * width, bool)
    begins[1:] = ~some[:-1] | (flat[1:] != flat[:-1])
    begins[::width] = True
    ends = np.append(begins[1:], True) | ~np.append(some[1:], False)
    a, b = np.flatnonzero(some & begins), np.flatnonzero(some & ends)
    of = a // width
    place = lambda x: anchor[of] - (width - 1 - x % width)
    return of, place(a), place(b), flat[a]


def _shared(batch: pa.RecordBatch, length: int, k: int) -> pa.RecordBatch:
    """KNOWN windows of the stretches of whole anchor groups, sorted by anchor."""
    a, least, most = (batch.column(c).to_numpy() for c in ("a", "least", "most"))
    anchor = batch.column("anchor").to_numpy().astype(np.int64)
    buf, off = T.flat(batch.column("bytes"))
    groups = np.append(np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])), len(a))
    of, low, high, first = _windows_after_first(anchor, first_documents(buf, off, anchor, groups, least, length, k), most)
    o = pa.array(of)
    return pa.record_batch({"a": batch.column("a").take(o), "s": batch.column("s").take(o), "from": pa.array(low, pa.int32()), "to": pa.array(high, pa.int32()), "first": pa.array(first)})


def whole_groups(batches: Iterator[pa.RecordBatch], by: str, size: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows again, cut between values of by into batches of about size rows."""
    held = None
    for b in batches:
        for i in range(0, b.num_rows, size):
            part = pa.Table.from_batches([b.slice(i, size)])
            held = part if held is None else pa.concat_tables([held, part])
            x = held.column(by).to_numpy()
            edges = np.flatnonzero(x[1:] != x[:-1]) + 1
            if len(x) >= size and len(edges):  # the last group may go on in the next batch
                yield held.slice(0, int(edges[-1])).combine_chunks().to_batches()[0]
                held = held.slice(int(edges[-1]))
    if held is not None and held.num_rows:
        yield held.combine_chunks().to_batches()[0]


def repeated_bytes(docs: DataFrame, length: int = 50, k: int = 24, most: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans: byte spans (start << 32 | end) that also start in a document with a smaller id, null where there are none."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "suffix")
    rows = R.keyed(docs, id_col, text_col)
    number = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = R.Places(rows, tmp, R.byte_grams, length, k, number)
    # an anchor in one document only has nothing to remove, and one with a single stretch nothing to sort
    per = found.one.groupBy("a").agg(F.min("doc_id").alias("low"), F.max("most").alias("high"), F.count("*").alias("n"), F.min("s").alias("s"), F.min("w").alias("w"))
    anchors = tmp.table(per.filter("low < high"))
    last = (F.shiftright("w", 8).bitwiseAND(F.lit(255)) - length).cast("int")
    single = anchors.filter("n = 1").select("a", "s", F.lit(0).alias("from"), last.alias("to"), F.col("low").alias("first"))
    several = anchors.filter("n > 1").select("a", (F.col("n") > most).alias("hot"))
    # few stretches need their bytes; the others go before the texts travel
    chosen = tmp.table(found.one.join(several, "a").select(*R.KEY, "a", "s", "w", "most", "hot"))
    tmp.drop(found.one)
    stretches = found.texts(chosen)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            buf, off = T.flat(part.column("text"))
            data, lists = buf.tobytes(), part.column("held")
            row, held = lists.value_parent_indices().to_numpy(), lists.flatten()
            at, size, anchor = R.unpacked(held.field("w").to_numpy())
            start = off[row] + at
            strings = [data[x:y] for x, y in zip(start.tolist(), (start + size).tolist(), strict=True)]
            yield pa.record_batch({"a": held.field("a"), "s": held.field("s"), "least": part.column("doc_id").take(pa.array(row)), "most": held.field("most"), "hot": held.field("hot"), "anchor": pa.array(anchor, pa.int32()), "bytes": pa.array(strings, pa.binary())})

    strings = tmp.table(stretches.mapInArrow(cut, "a long, s long, least long, most long, hot boolean, anchor int, bytes binary"))
    tmp.drop(chosen)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, "a", GROUP):
            yield _shared(b, length, k)

    known = strings.filter("NOT hot").drop("hot").repartition(partitions(spark), "a").sortWithinPartitions("a").mapInArrow(share, KNOWN)
    at = F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length))
    windows = strings.filter("hot").select("a", "s", "least", "most", "bytes", at.alias("from")).withColumn("bytes", F.substring("bytes", F.col("from") + 1, F.lit(length)))
    first = tmp.table(windows.groupBy("a", "bytes").agg(F.min("least").alias("first")))
    dealt = windows.join(first, ["a", "bytes"]).filter("first < most").select("a", "s", "from", F.col("from").alias("to"), "first")
    return R.with_spans(rows, found.spans(known.unionByName(dealt).unionByName(single)))


def remove(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", most: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) per row.

    Strings are judged on the input and never cross documents. Null text is empty. Rows with the same id remove
    nothing from each other. A null id is no smaller than any id and has none smaller. kept may end inside a UTF-8
    character, so it is binary. An empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            buf, off = T.flat(part.column("text"))
            n = part.num_rows
            row, start, end = R.removed(part, off)
            gone = np.bincount(row, weights=end - start, minlength=n).astype(np.int64)
            left = buf[~R.inside(len(buf), start, end)].tobytes()
            place = np.concatenate([[0], np.cumsum(np.diff(off) - gone)])
            kept = [left[a:b] for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(gone), "n_spans": pa.array(np.bincount(row, minlength=n)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]), "kept": pa.array(kept, pa.binary())})

    marked = repeated_bytes(docs, length, most=most, id_col=id_col, text_col=text_col)
    return marked.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
