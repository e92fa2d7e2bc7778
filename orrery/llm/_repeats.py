"""Exact search for windows of L elements (bytes or words) that occur in several places of a corpus.

All windows would be too many to shuffle. Every window has an anchor, the k-gram with the least hash in it (of equal
ones the leftmost), so equal windows have equal anchors at equal places. Consecutive windows with the same anchor
place form a stretch of at most 2 L - k elements, about one per (L - k) / 2 elements of text. So:

1. sent twice: each partition keeps a table of anchors that it has sent. The first two places of an anchor go to the
   segment that owns the anchor's hash; later ones are repeated for sure and go to any segment, as they are. The table
   holds whole anchors, so none is taken for another; one that another displaces is sent twice again. So a segment
   gets few places of an anchor from each partition, however common it is, and two at least of each that passes as
   repeated without its word.
2. prefilter: a segment merges what partitions counted, in a count-min sketch of two rows, and passes the places on
   whose anchor it estimates at two or more. Sketches never underestimate, and a window occurs at most as often as
   its anchor, so no repeated window is lost. The number of segments grows with the corpus; their size does not.
3. exact part: places go back to their texts, which name each stretch by two hashes (a, s) of what stands there. The
   caller decides over the distinct stretches, `Places.one`.

Nothing is broadcast. Texts are long or many; a text of over LONG elements is looked at in overlapping pieces.
Steps 1 and 2 name a row by one 64-bit hash k; if two rows share it, places of one are looked up in the other too, and
what really stands there counts. That changes no least id; where places are counted, such a row's windows may count
twice, a chance of n^2 / 2^65 for n rows. Decisions find rows by id and two 64-bit hashes of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import _text as T
from orrery.llm._spark import Scratch

NO_ID = (1 << 63) - 1  # stands for a null id, which is smaller than none
SLICE = 1 << 19  # bytes of text whose anchors are found at a time
LONG = 1 << 19  # elements of one piece of a text
OWN_BITS = 21  # anchors that a partition's table holds
SEGMENT = 1 << 17  # anchors of a segment, about
FLUSH = 1 << 19  # places that a task holds before it sends them
CELLS_BITS = 20  # cells of each row of a segment's sketch
KEY = ["doc_id", "k1", "k2"]
PLACE_BITS = 10  # low bits of a gram's value, for its place
PLACE = np.uint64((1 << PLACE_BITS) - 1)

Grams = Callable[[np.ndarray, np.ndarray, int, int], Iterator[tuple[np.ndarray, np.ndarray, int]]]


def _pieces(n: int, rows: int, length: int) -> list[int]:
    return list(range(0, max(n - length + 1, 1), LONG)) if rows == 1 and n > LONG else [0]


def byte_grams(buf: np.ndarray, off: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes of k bytes from each place, row offsets, and the first place of the piece; k is a multiple of 8."""
    starts = _pieces(len(buf), len(off) - 1, length)
    for p in starts:
        piece = buf[p : p + LONG + length - 1] if len(starts) > 1 else buf
        n = len(piece) - k + 1
        grams = np.zeros(0, T.U)
        if n > 0:
            at8 = T.eights(piece)
            grams = T.mix(at8[:n])
            for j in range(8, k, 8):
                grams = T.combine(grams, at8[j : j + n])
        yield grams, np.array([0, len(piece)]) if len(starts) > 1 else off, p


def word_grams(buf: np.ndarray, off: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The same over words."""
    first, last, word_off = T.word_bounds(buf, off)
    starts = _pieces(len(first), len(off) - 1, length)
    for p in starts:
        cut = slice(p, p + LONG + length - 1) if len(starts) > 1 else slice(None)
        grams = T.gram_hashes(T.word_hashes(buf, first[cut], last[cut]), k)
        yield grams, np.array([0, len(first[cut])]) if len(starts) > 1 else word_off, p


def _least(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h, span = np.minimum(h[:-span], h[span:]), span * 2
    return h if span == width else np.minimum(h[: len(h) - (width - span)], h[width - span :])


class Stretches:
    """The stretches of a flat sequence of rows: a, s, row, start (in the flat sequence), size, anchor (its place)."""

    def __init__(self, grams: np.ndarray, off: np.ndarray, length: int, k: int):
        first, row = T.windows(off, length)
        empty = np.zeros(0, np.int64)
        self.row = self.start = self.size = self.anchor = empty
        self.a = self.s = np.zeros(0, T.U)
        if not len(first):
            return
        # the value's low bits tell places apart, in ascending order inside a window: of equal grams the leftmost wins
        width, turn = length - k + 1, 1 << PLACE_BITS
        clear = grams & ~PLACE
        v = _least(clear | (np.arange(len(grams), dtype=T.U) & PLACE), width)[first]
        base = first.astype(T.U)
        late = np.flatnonzero((first & (turn - 1)) + width > turn)  # windows in which the low bits start anew
        if len(late):
            base[late] += T.U(turn // 2)
            at = first[late][:, None] + np.arange(width)
            v[late] = (clear[at] | ((at.astype(T.U) + T.U(turn // 2)) & PLACE)).min(axis=1)
        anchor = first + ((v - base) & PLACE).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        self.start, self.row, self.anchor = first[begins], row[begins], anchor[begins]
        self.size = first[np.append(begins[1:], len(first)) - 1] + length - self.start
        self.a = T.mix(v[begins] >> T.U(PLACE_BITS))
        self.s = T.run_hashes(grams, k, self.start, self.start + self.size, 2 * length - k)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class CountMin:
    """Two rows of counts that saturate at 2; estimates are never too low."""

    def __init__(self, bits: int):
        self.bits, self.rows = bits, np.zeros((2, 1 << bits), np.uint8)

    def cells(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = T.mix(a * T.U(0xA24BAED4963EE407) + T.U(1))
        low = T.U((1 << self.bits) - 1)
        return (h & low).astype(np.int64), (h >> T.U(64 - self.bits)).astype(np.int64)

    def estimate(self, a: np.ndarray) -> np.ndarray:
        x, y = self.cells(a)
        return np.minimum(self.rows[0, x], self.rows[1, y])

    def add(self, a: np.ndarray) -> None:
        for row, c in zip(self.rows, self.cells(a), strict=True):
            row[c[row[c] == 1]] = 2
            c = np.sort(c)
            new = c[row[c] == 0]
            row[new] = 1
            row[new[1:][new[1:] == new[:-1]]] = 2


class Sent:
    """How often anchors were sent, 2 at most, in a table with one place for each hash; never more than they were."""

    def __init__(self, bits: int):
        self.shift, self.held, self.count = T.U(64 - bits), np.zeros(1 << bits, T.U), np.zeros(1 << bits, np.uint8)

    def known(self, a: np.ndarray) -> np.ndarray:
        """Which of these places come after two of the same anchor; the others count as sent."""
        at = (T.mix(a) >> self.shift).astype(np.int64)
        so_far = np.where(self.held[at] == a, self.count[at], 0) + nth(a)
        self.held[at] = a
        stays = self.held[at] == a  # of several anchors for one place, one
        self.count[at[stays]] = 1
        self.count[at[stays & (so_far >= 1)]] = 2
        return so_far >= 2


def nth(a: np.ndarray) -> np.ndarray:
    """How many equal values come before each one."""
    order = np.argsort(a, kind="stable")
    new = np.concatenate([[True], a[order[1:]] != a[order[:-1]]]) if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    out = np.empty(len(a), np.int64)
    out[order] = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    return out


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id (null: NO_ID), text (null: empty), k1 and k2, two hashes of the text, and carried columns as one struct.

    Decisions find their rows by KEY. Rows of equal KEY have equal texts and equal ids, and so equal results.
    """
    text, number = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(number.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), *([F.struct(*carry).alias("carried")] if carry else []))


#: A place on its way to its segment. size and anchor: elements of the stretch, and of it before the anchor.
RECORD = np.dtype([("a", "<u8"), ("k", "<i8"), ("at", "<u4"), ("size", "u1"), ("anchor", "u1"), ("known", "?")])


def packed(at: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return at.astype(np.int64) << 16 | size.astype(np.int64) << 8 | anchor


def unpacked(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First element in the row, number of elements, and place of the anchor in the stretch."""
    return w >> 16, w >> 8 & 255, w & 255


def places(rows: DataFrame, grams: Grams, length: int, k: int, number: int) -> DataFrame:
    """k, w: the stretches whose anchors are estimated at two places or more. number: elements in all, about."""
    if 2 * length - k > 255:
        raise ValueError(f"windows of {length} with anchors of {k} have stretches of more than 255 elements")
    segments = max(1, -(-2 * number // (length - k + 2) // SEGMENT))

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """One row for each segment, with its places as bytes."""
        owner, records = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        off = (np.append(first, len(owner)) * RECORD.itemsize).astype(np.int32)
        blobs = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(off), pa.py_buffer(records[order].tobytes())])
        return pa.record_batch({"p": pa.array(owner[first].astype(np.int32)), "places": blobs})

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, n = Sent(OWN_BITS), [], 0
        for part in T.slices(batches, limit=SLICE):
            key = part.column("k").to_numpy()
            for g, off, base in grams(*T.flat(part.column("text")), length, k):
                x = Stretches(g, off, length, k)
                known = own.known(x.a)
                to = np.where(known, T.mix(x.s + x.start.astype(T.U)), x.a)
                records = np.empty(len(x.a), RECORD)
                records["a"], records["k"], records["known"] = x.a, key[x.row], known
                records["at"], records["size"], records["anchor"] = x.start - off[x.row] + base, x.size, x.anchor - x.start
                held, n = [*held, (((to >> T.U(32)) * T.U(segments)) >> T.U(32), records)], n + len(records)
                if n >= FLUSH:
                    yield sent(held)
                    held, n = [], 0
        if n:
            yield sent(held)

    def merged(table: pa.Table) -> pa.Table:
        x = T.flat(table.column("places").combine_chunks())[0].view(RECORD)
        sketch = CountMin(CELLS_BITS)
        sketch.add(x["a"][~x["known"]])
        x = x[x["known"] | (sketch.estimate(x["a"]) >= 2)]
        return pa.table({"k": pa.array(x["k"]), "w": pa.array(packed(x["at"], x["size"], x["anchor"]))})

    found = rows.select(F.xxhash64("doc_id", "k1").alias("k"), "text").mapInArrow(sketched, "p int, places binary")
    return found.groupBy("p").applyInArrow(merged, "k long, w long")


class Places:
    """Places of stretches that may repeat, as a table, and their distinct stretches (a, s, least, most, n and one place)."""

    def __init__(self, rows: DataFrame, tmp: Scratch, grams: Grams, length: int, k: int, number: int):
        self.rows, self.tmp, self.length = rows, tmp, length
        near = tmp.table(places(rows, grams, length, k, number))

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in T.slices(batches, limit=SLICE):
                lists = part.column("held")
                row, held = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy()
                at, size, anchor = unpacked(held)
                for g, off, base in grams(*T.flat(part.column("text")), length, k):
                    sel = np.flatnonzero((at >= base) & (at < base + LONG) | (len(off) > 2))
                    sel = sel[at[sel] - base + size[sel] <= off[row[sel] + 1] - off[row[sel]]]
                    start, r = off[row[sel]] + at[sel] - base, pa.array(row[sel])
                    a = T.mix(g[start + anchor[sel]] >> T.U(PLACE_BITS)) if len(sel) else np.zeros(0, T.U)
                    s = T.run_hashes(g, k, start, start + size[sel], 2 * length - k) if len(sel) else a
                    yield pa.record_batch({"a": as_long(a), "s": as_long(s), **{c: part.column(c).take(r) for c in KEY}, "w": pa.array(held[sel])})

        lists = near.groupBy("k").agg(F.collect_set("w").alias("held"))
        texts = rows.select(*KEY, "text", F.xxhash64("doc_id", "k1").alias("k")).filter("text <> ''").join(lists, "k").select(*KEY, "text", "held")
        self.found = tmp.table(texts.mapInArrow(named, "a long, s long, doc_id long, k1 long, k2 long, w long"))
        tmp.drop(near)
        first = F.min(F.struct("doc_id", "k1", "k2", "w")).alias("place")
        self.one = tmp.table(self.found.groupBy("a", "s").agg(first, F.max("doc_id").alias("most"), F.count("*").alias("n")).select("a", "s", "place.*", "most", "n"))

    def texts(self, stretches: DataFrame) -> DataFrame:
        """Texts of the rows that hold the given stretches of `one`, each with the list of them."""
        per = stretches.groupBy(*KEY).agg(F.collect_list(F.struct(*[c for c in stretches.columns if c not in KEY])).alias("held"))
        return self.rows.select(*KEY, "text").filter("text <> ''").dropDuplicates(KEY).join(per, KEY)

    def spans(self, known: DataFrame) -> DataFrame:
        """KEY, spans (start << 32 | end, in elements): known (a, s, from, to, first) says that windows from .. to of
        the stretch are repeated at documents after first."""
        # a table on either side, so that Spark can split the places of a common stretch
        known = self.tmp.table(known)
        self.tmp.keep(self.found, known)
        at = F.shiftright("w", 16)
        span = F.shiftleft(at + F.col("from"), 32).bitwiseOR(at + F.col("to") + F.lit(self.length)).alias("span")
        hit = self.found.join(known, ["a", "s"]).filter("first < doc_id").select(*KEY, span)
        out = self.tmp.table(hit.groupBy(*KEY).agg(F.collect_set("span").alias("spans")))
        self.tmp.keep(out)
        return out


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Keyed documents with their spans (null: none); one shuffle of the texts."""
    return rows.join(spans, KEY, "left").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", "spans", *(["carried"] if "carried" in rows.columns else []))


def removed(part: pa.RecordBatch, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (in the flat sequence with row offsets off) of the maximal runs that spans cover."""
    lists = part.column("spans")
    size = np.diff(lists.offsets.to_numpy())
    if lists.null_count:
        size = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, size)
    span = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    start, end = off[row] + (span >> 32), off[row] + (span & 0xFFFFFFFF)
    order = np.argsort(start, kind="stable")
    row, start, reach = row[order], start[order], np.maximum.accumulate(end[order]) if len(order) else end
    new = np.ones(len(row), bool)
    new[1:] = (start[1:] > reach[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], start[first], reach[np.append(first[1:], len(row)) - 1] if len(first) else reach


def inside(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in the given runs, none of which overlap."""
    change = np.zeros(n + 1, np.int8)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1], dtype=np.int8) > 0
