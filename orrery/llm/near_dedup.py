"""MinHash near-deduplication with HyperMinHash registers.

A document's distinct word shingles give SIGNATURE registers: hashes fall into buckets, and a bucket keeps of its
least hash the count of leading zeros and MANTISSA bits after the first one, 16 bits in all. Small sets are hashed
several times into fewer buckets, so that a register stands for four shingles or more whatever the size. ROWS
registers make a band. Documents that agree in a band and whose sizes allow the similarity go to the least one of
the band. Linked by that, documents form families: any two documents similar enough share a band, except with a
chance of about 1e-13 at 0.85 and 2e-9 at 0.8, and so a family.

Links inside a family are found in blocks of about BLOCK documents or SHINGLES shingles, each pair of blocks in one
task. First registers alone are compared: the Jaccard index estimated from them, corrected for chance collisions,
leaves out pairs six deviations below the threshold. Texts go only to pairs of blocks in which they have a possible
partner; there links are confirmed on the full shingle sets, as products of incidence matrices. A task returns a
spanning forest of its links, never all pairs, and connected components of all forests give the result. Documents
with equal shingle sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import _text as T
from orrery.llm._components import components
from orrery.llm._repeats import NO_ID, as_long
from orrery.llm._spark import Scratch
from orrery.llm.mixing import WORD

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA = 10
EMPTY = 0xFFFF
SIGNATURE, ROWS = 256, 5
BANDS = SIGNATURE // ROWS
BLOCK = 512
SHINGLES = 1 << 19
ROWS_MOST = 1 << 12  # rows of a slice


def shingles(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each of at most ROWS_MOST rows, ascending, and row offsets.

    Words are lower-cased in A-Z. A row with fewer words than size has one shingle of all of them; without words, none.
    """
    low = T.lower_ascii(buf)
    starts, ends, word_off = T.word_bounds(low, off)
    n = len(off) - 1
    word = T.word_hashes(low, starts, ends)
    at, row = T.windows(word_off, size)
    words = np.diff(word_off)
    few = np.flatnonzero((words > 0) & (words < size))
    short = T.mix(words[few].astype(T.U))
    for j in range(size - 1):
        more = words[few] > j
        short[more] = T.combine(short[more], word[word_off[few[more]] + j])
    h, row = np.concatenate([T.gram_hashes(word, size)[at], short]), np.concatenate([row, few])
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(n + 1))


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit minima; EMPTY for the largest value, which stands for none."""
    length = np.frexp(least.astype(float))[1].astype(np.int64)
    zeros = np.clip(64 - length, 0, 62)
    top = least << zeros.astype(T.U)  # the first set bit is now the highest
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | ((top >> T.U(63 - MANTISSA)) & T.U((1 << MANTISSA) - 1)).astype(np.uint16)
    return np.where(least == np.iinfo(np.uint64).max, np.uint16(EMPTY), out)


def registers(h: np.ndarray, off: np.ndarray, buckets: int, times: int = 1) -> np.ndarray:
    """Rows x (times * buckets) registers; each of `times` hashings deals the shingles into the buckets anew."""
    n, bits = len(off) - 1, buckets.bit_length() - 1
    least = np.full((n, times, buckets), np.iinfo(np.uint64).max, T.U)
    row = np.repeat(np.arange(n), np.diff(off))
    for t in range(times):
        x = T.mix(h ^ T.mix(T.U([t + 1]))[0])
        bucket = (x >> T.U(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)
        np.minimum.at(least.reshape(-1), (row * times + t) * buckets + bucket, x << T.U(bits))
    return compressed(least).reshape(n, times * buckets)


def band_keys(h: np.ndarray, off: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every band. Sizes are cut into steps of the threshold; a row has keys for its step and the one
    below, so that any two rows whose sizes allow a link share a step. Sets too small to link with another have none.
    """
    size = np.diff(off)
    step = np.floor(np.log(np.maximum(size, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)
    able = size * (100 - percent) >= percent  # so many common shingles that one more in the union still links
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, T.U)]
    for level in np.unique(np.concatenate([step[able], step[able] - 1])).tolist():
        sel = np.flatnonzero(able & ((step == level) | (step - 1 == level)))
        lowest = (100 / percent) ** max(level, 0)
        times = int(min(SIGNATURE, max(1, 2 ** int(np.ceil(np.log2(4 * SIGNATURE / lowest))))))
        for i in range(0, len(sel), 1024):
            part = sel[i : i + 1024]
            count = size[part]
            sub = np.concatenate([[0], np.cumsum(count)])
            at = np.repeat(off[part] - sub[:-1], count) + np.arange(sub[-1])
            r = registers(h[at], sub, SIGNATURE // times, times)[:, : BANDS * ROWS].reshape(len(part), BANDS, ROWS).astype(T.U)
            k = T.mix(r[..., 0] | r[..., 1] << T.U(16) | r[..., 2] << T.U(32) | r[..., 3] << T.U(48))
            k = T.mix(k ^ (r[..., 4] | np.arange(BANDS, dtype=T.U)[None, :] << T.U(16) | T.U(max(level + 1, 0)) << T.U(32)))
            rows.append(np.repeat(part, BANDS))
            keys.append(k.ravel())
    return np.concatenate(rows), np.concatenate(keys)


def may_link(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that sizes and the estimated Jaccard index leave possible."""
    out = 100 * np.minimum(size_x[:, None], size_y[None, :]) >= percent * np.maximum(size_x[:, None], size_y[None, :])
    chance = 2.0**-MANTISSA / 3  # of equal registers from different hashes: equal zeros (1/3), equal mantissa
    for i in range(0, len(x), 64):
        equal = x[i : i + 64, None, :] == y[None, :, :]
        both = equal & (x[i : i + 64, None, :] == EMPTY)
        filled = REGISTERS - both.sum(axis=2)
        estimate = ((equal.sum(axis=2) - both.sum(axis=2)) / np.maximum(filled, 1) - chance) / (1 - chance)
        t = percent / 100
        out[i : i + 64] &= estimate >= t - 6 * np.sqrt(t * (1 - t) / np.maximum(filled, 1))
    return out


def overlaps(h: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray, width: int = 4096) -> np.ndarray:
    """Intersection sizes of the sets of rows x with those of rows y, over hashes that several rows have."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [c, c + width])
        m = np.zeros((len(off) - 1, width), np.float32)
        m[row[a:b], column[a:b] - c] = 1
        out += m[x] @ m[y].T
    return out.astype(np.int64)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that links u-v connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_candidates(table: pa.Table) -> pa.Table:
    """The rows of one pair of blocks that have a possible partner in the other block (or in the one block)."""
    node, side, sizes = (table.column(c).to_numpy() for c in ("node", "side", "n_shingles"))
    regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    sides, percent = np.unique(side), table.column("percent")[0].as_py()
    x, y = np.flatnonzero(side == sides[0]), np.flatnonzero(side == sides[-1])
    possible = may_link(regs[x], regs[y], sizes[x], sizes[y], percent) & (node[x][:, None] != node[y][None, :])
    keep = np.unique(np.concatenate([x[possible.any(axis=1)], y[possible.any(axis=0)]]))
    return table.select(["root", "i", "j", "node", "side"]).take(pa.array(keep))


def block_links(table: pa.Table, size: int, percent: int) -> pa.Table:
    """u, v: links between the two blocks of one table (or inside the one block), as a spanning forest."""
    node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
    parts, counts = [], []
    for part in T.slices(iter(table.select(["text"]).combine_chunks().to_batches()), rows=ROWS_MOST):
        h, o = shingles(*T.flat(part.column("text")), size)
        parts.append(h)
        counts.append(np.diff(o))
    h, sizes = np.concatenate(parts), np.concatenate(counts)
    off = np.concatenate([[0], np.cumsum(sizes)])
    regs, sides = registers(h, off, REGISTERS), np.unique(side)
    x, y = np.flatnonzero(side == sides[0]), np.flatnonzero(side == sides[-1])
    possible = may_link(regs[x], regs[y], sizes[x], sizes[y], percent) & (node[x][:, None] != node[y][None, :])
    px, py = possible.any(axis=1), possible.any(axis=0)
    empty = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    if not px.any():
        return empty
    both = overlaps(h, off, x[px], y[py])
    union = sizes[x[px]][:, None] + sizes[y[py]][None, :] - both
    u, v = np.nonzero((100 * both >= percent * union) & possible[np.ix_(px, py)])
    root = forest(len(node), x[px][u], y[py][v])
    moved = np.flatnonzero(root != np.arange(len(node)))
    return pa.table({"u": pa.array(node[moved]), "v": pa.array(node[root[moved]])}) if len(moved) else empty


def last_id(docs: DataFrame, id_col: str) -> int:
    """The largest id; 0 if there is none above it."""
    return min(max(docs.agg(F.max(F.col(id_col).cast("long"))).first()[0] or 0, 0), NO_ID - 1)


def row_key(id: Column, text: Column, last: int) -> Column:
    """A long that names a document: its id, or above the last id one of its text."""
    return F.coalesce(id.cast("long"), F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(NO_ID - last)) + F.lit(last + 1))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose documents group() keeps. Of rows without an id, one of each text with words stays."""
    last = last_id(docs, id_col)
    kept = _grouped(docs, size, percent, id_col, text_col, last).filter("kept").select(F.col("key").alias("near_key")).distinct()
    keyed = docs.select(*docs.columns, row_key(F.col(id_col), F.col(text_col), last).alias("near_key"))
    copies = F.col(id_col).isNull() & F.coalesce(F.col(text_col), F.lit("")).rlike(WORD)
    return keyed.filter(~copies).union(keyed.filter(copies).dropDuplicates(["near_key", text_col])).join(kept, "near_key", "left_semi").select(*docs.columns)


def group(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row.

    Documents link if 100 * intersection >= percent * union of their sets of shingles of `size` words. component_id
    is the least doc_id reachable, kept whether it is the document's own. Documents without words have no shingles
    and link with nothing. Rows that share an id are one document, and so are rows without an id that share a text. A
    null id counts as larger than all others; a component of null ids alone has component_id null, and the document
    whose text has the least hash is kept. An empty table gives no rows.
    """
    last = last_id(docs, id_col)
    real = lambda c: F.when(F.col(c) <= last, F.col(c)).alias(c)
    return _grouped(docs, size, percent, id_col, text_col, last).withColumnRenamed("key", "doc_id").select(real("doc_id"), "n_shingles", real("component_id"), "kept")


def _grouped(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, last: int) -> DataFrame:
    """key, n_shingles, component_id, kept per row, by row_key."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "near")
    rows = docs.select(row_key(F.col(id_col), F.col(text_col), last).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, rows=ROWS_MOST):
            h, off = shingles(*T.flat(part.column("text")), size)
            sums = []
            for seed in (1, 2):  # 128 bits that name the set
                total = np.concatenate([[T.U(0)], np.cumsum(T.mix(h ^ T.mix(T.U([seed]))), dtype=T.U)])
                sums.append(as_long(total[off[1:]] - total[off[:-1]]))
            row, key = band_keys(h, off, percent)
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), as_long(key[order]))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_shingles": pa.array(np.diff(off)), "s1": sums[0], "s2": sums[1], "bands": lists, "registers": pa.array([x.tobytes() for x in registers(h, off, REGISTERS)], pa.binary())})

    signed = tmp.table(rows.mapInArrow(sign, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, registers binary"))
    full = signed.filter("n_shingles > 0")
    nodes = tmp.table(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")))
    first = full.alias("d").join(nodes.alias("n"), (F.col("d.s1") == F.col("n.s1")) & (F.col("d.s2") == F.col("n.s2")) & (F.col("d.doc_id") == F.col("n.node")), "left_semi")
    banded = tmp.table(first.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band")))
    hubs = tmp.table(banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("band", "hub"))
    near = banded.join(hubs, "band").filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    families = components(near, tmp)
    families = tmp.table(families.union(families.select(F.col("root").alias("node"), "root").distinct()))
    tmp.keep(signed, nodes, families)
    member = tmp.table(signed.select(F.col("doc_id").alias("node"), "n_shingles", "registers").join(families, "node"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / SHINGLES)).cast("int")
    sized = tmp.table(member.groupBy("root").agg(blocks.alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = member.join(sized, "root").select("*", block.alias("side"), other.alias("other"), F.lit(percent).alias("percent"))
    dealt = dealt.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "blocks")
    pairs = tmp.table(dealt.groupBy("root", "i", "j").applyInArrow(block_candidates, "root long, i int, j int, node long, side int"))
    # merged at every size: pairs have no bound, and a plan that changes with size can't be projected
    texts = pairs.hint("merge").join(rows.withColumnRenamed("doc_id", "node"), "node")
    links = tmp.table(texts.groupBy("root", "i", "j").applyInArrow(lambda t: block_links(t, size, percent), "u long, v long"))
    tmp.drop(member, sized, pairs)
    found = components(links, tmp)
    named = nodes.select("s1", "s2", "node").join(found, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("component"))
    joined = signed.join(named, ["s1", "s2"], "left").withColumn("component", F.coalesce("component", "doc_id"))
    return joined.select(F.col("doc_id").alias("key"), "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
