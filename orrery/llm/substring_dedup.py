"""Substring deduplication: words inside windows of words that occur anywhere else are removed.

A count-min prefilter decides which windows are grouped exactly. Each partition sketches the anchors of its windows;
sketches merged per segment overestimate how often an anchor, and so any window on it, occurs. The second pass groups
only windows on anchors estimated repeated, exactly, so none is lost. _repeats.py has the prefilter.

Equal stretches of windows at several places are repeated as a whole. Where an anchor has several distinct stretches,
mostly at edges of copied passages, one of each is looked at window by window. Windows are equal if their words' hashes
are, 64 bits of the window and 54 of its anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from orrery.llm import _repeats as R
from orrery.llm import _text as T
from orrery.llm._spark import Scratch


def repeated_words(docs: DataFrame, window: int = 35, k: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, spans: spans of words (start << 32 | end) inside repeated windows, null where there are none; carried columns."""
    tmp = Scratch(docs.sparkSession, "substring")
    rows = R.keyed(docs, id_col, text_col, carry)
    # words are at least two bytes with their space; an estimate is enough to size the sketch
    number = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5
    found = R.Places(rows, tmp, R.word_grams, window, k, number)
    several = tmp.table(found.one.groupBy("a").agg(F.count("*").alias("m")).filter("m > 1").select("a"))
    mixed = found.texts(found.one.join(several, "a").select(*R.KEY, "a", "s", "w"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, limit=R.SLICE):
            buf, off = T.flat(part.column("text"))
            first, last, word_off = T.word_bounds(buf, off)
            grams = T.gram_hashes(T.word_hashes(buf, first, last), k)
            lists = part.column("held")
            row, held = lists.value_parent_indices().to_numpy(), lists.flatten()
            at, size, _ = R.unpacked(held.field("w").to_numpy())
            count = size - window + 1
            of = np.repeat(np.arange(len(count)), count)
            rel = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            start = word_off[row[of]] + at[of] + rel
            o = pa.array(of)
            yield pa.record_batch({"a": held.field("a").take(o), "s": held.field("s").take(o), "rel": pa.array(rel, pa.int32()), "h": R.as_long(T.run_hashes(grams, k, start, start + window, window))})

    every = tmp.table(mixed.mapInArrow(explode, "a long, s long, rel int, h long"))
    twice = tmp.table(every.groupBy("a", "h").agg(F.count("*").alias("n")).filter("n > 1").select("a", "h"))
    whole = found.one.filter("n > 1").select("a", "s", F.lit(0).alias("from"), (F.shiftright("w", 8).bitwiseAND(F.lit(255)) - window).cast("int").alias("to"))
    single = every.join(twice, ["a", "h"]).select("a", "s", F.col("rel").alias("from"), F.col("rel").alias("to"))
    known = whole.unionByName(single).withColumn("first", F.lit(-(1 << 63)).cast("long"))
    return R.with_spans(rows, found.spans(known))


def remove(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text per row; kept words are joined by one space.

    carry: input columns to return as well, in one struct `carried`, whatever their names are.

    Windows are judged on the input. Null text has no words. Texts shorter than a window keep all words. Repeated
    rows are places of their own, so all their windows are repeated. An empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            buf, off = T.flat(part.column("text"))
            starts, ends, word_off = T.word_bounds(buf, off)
            row, low, high = R.removed(part, word_off)
            gone = np.bincount(row, weights=high - low, minlength=part.num_rows).astype(np.int64)
            left = np.flatnonzero(~R.inside(len(starts), low, high))
            # kept words, and one byte after each but the last of its row, which becomes the space
            count = np.diff(word_off) - gone
            inner = np.ones(len(left), bool)
            inner[np.cumsum(count)[count > 0] - 1] = False
            out = buf.copy()
            out[ends[left[inner]]] = 32
            data = out[R.inside(len(buf), starts[left], ends[left] + inner)].tobytes()
            size = np.concatenate([[0], np.cumsum(ends[left] + inner - starts[left])])
            place = size[np.concatenate([[0], np.cumsum(count)])]
            kept = [data[a:b] for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_words": pa.array(np.diff(word_off)), "n_removed": pa.array(gone), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]), "kept_text": pa.array([x.decode() for x in kept], pa.string())} | ({"carried": part.column("carried")} if carry else {}))

    marked = repeated_words(docs, window, id_col=id_col, text_col=text_col, carry=carry)
    shape = T_.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    if carry:
        shape.add(marked.schema["carried"])
    return marked.mapInArrow(cut, shape)
