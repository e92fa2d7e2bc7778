"""Token ids in Arrow stream files with fixed-size-list batches.

One file holds the ids of a run of documents in ascending id order, cut into sequences of equal length; only the
last sequence of a file is filled up, and its mask is 0 there. A record batch has `rows` sequences (the last one
may have fewer), so the place of any sequence is known from its number, and a memory-mapped file gives ids and
masks without copying. Beside each `*.tokens.arrow` lies `*.index.arrow`: doc_id, start and n_tokens in the file.

The writer range-partitions documents by id; each partition becomes one file, in order. A task that runs again
writes under a new name, and only names reported by finished tasks are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm import _text as T
from orrery.llm._spark import Scratch, id_text, new_path, partitions
from orrery.llm._tokens import encoder, with_end

SLICE = 1 << 20  # bytes of text tokenised at a time
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(length: int, vocabulary: int) -> pa.Schema:
    """Ids as 16-bit integers where the vocabulary allows it, masks as bits."""
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"sequence_length": str(length)})


class SequenceWriter:
    """Gathers ids and writes batches of `rows` sequences of `length` ids."""

    def __init__(self, sink, length: int, rows: int, vocabulary: int):
        self.length, self.rows, self.schema = length, rows, sequence_schema(length, vocabulary)
        self.out, self.held, self.n = pa.ipc.new_stream(sink, self.schema), [], 0

    def _batch(self, ids: np.ndarray, mask: np.ndarray) -> None:
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x, f.type.value_type), type=f.type) for x, f in zip((ids, mask), self.schema, strict=True)]
        self.out.write_batch(pa.record_batch(arrays, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        most = self.length * self.rows
        if self.n >= most:
            everything = np.concatenate(self.held)
            full = len(everything) // most * most
            for i in range(0, full, most):
                self._batch(everything[i : i + most], np.ones(most, bool))
            self.held, self.n = [everything[full:]], len(everything) - full

    def close(self) -> None:
        if self.n:
            rest = np.concatenate(self.held)
            ids = np.zeros(-(-len(rest) // self.length) * self.length, rest.dtype)
            ids[: len(rest)] = rest
            self._batch(ids, np.arange(len(ids)) < len(rest))
        self.out.close()


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)


class SequenceFile:
    """Random access to one file: views of ids and masks, copied only where a span crosses batches.

    A local file is memory-mapped, and all its batches are views of the map. Any other is read batch by batch, and the
    last two are kept, so that spans in ascending order read the file once; a span further back opens it again.
    """

    def __init__(self, path: str):
        self.path, self.held = path, {}
        self._open()
        self.length = int(self.reader.schema.metadata[b"sequence_length"])
        first = self._batch(0)
        self.rows = first.num_rows if first is not None else 1

    def _open(self) -> None:
        self.source = _open(self.path)
        self.mapped = isinstance(self.source, pa.MemoryMappedFile)
        self.reader, self.next = pa.ipc.open_stream(self.source), 0

    def _batch(self, number: int) -> pa.RecordBatch | None:
        if number in self.held:
            return self.held[number]
        if number < self.next:
            self._open()
        while self.next <= number:
            try:
                batch = self.reader.read_next_batch()
            except StopIteration:
                return None
            if not self.mapped:
                self.held.pop(self.next - 2, None)
            self.held[self.next] = batch
            self.next += 1
        return self.held[number]

    def _flat(self, batch: int) -> np.ndarray:
        return self._batch(batch).column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one sequence, neither copied."""
        b, r = divmod(number, self.rows)
        return self._flat(b)[r * self.length : (r + 1) * self.length], self._batch(b).column("mask")[r].values

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the file."""
        per = self.length * self.rows
        first, last = start // per, max(start, start + n - 1) // per
        if n == 0 or first == last:
            return self._flat(first)[start - first * per : start - first * per + n] if n else np.zeros(0, np.uint16)
        parts = [self._flat(b)[max(start - b * per, 0) : start + n - b * per] for b in range(first, last + 1)]
        return np.concatenate(parts)


def write(docs: DataFrame, tokenizer: str, end: int = 2, length: int = 2048, rows: int = 64, kind: str = "spaced", path: str | None = None) -> DataFrame:
    """Writes the files below path (default: the shared folder) and returns their list.

    Columns: part (files in order), first_id, path (without .tokens.arrow), n_tokens, n_docs, and start, the ids in all files before.
    Null text is empty and gives the end id alone; repeated ids keep their rows, ordered by text. No documents
    give no files.
    """
    spark = docs.sparkSession
    root = path or new_path(spark, "tokens")
    # the beginning of the text parts rows that share an id, or have none
    ranged = id_text(docs).repartitionByRange(partitions(spark), F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        name, first, n, n_docs, out, index = f"part-{uuid.uuid4().hex}", None, 0, 0, None, None
        for part in T.slices(batches, limit=SLICE):
            use = encoder(tokenizer, kind)
            if out is None:
                fs.create_dir(base, recursive=True)
                sinks = [fs.open_output_stream(f"{base}/{name}.{x}.arrow") for x in ("tokens", "index")]
                out, index = SequenceWriter(sinks[0], length, rows, use.tokenizer.get_vocab_size()), pa.ipc.new_stream(sinks[1], INDEX)
                first = part.column("doc_id")[0].as_py()
            ids, off = with_end(*use.encode(*T.flat(part.column("text"))), end)
            out.add(ids)
            index.write_batch(pa.record_batch([part.column("doc_id"), pa.array(n + off[:-1]), pa.array(np.diff(off))], schema=INDEX))
            n, n_docs = n + len(ids), n_docs + part.num_rows
        if out is not None:
            out.close()
            index.close()
            for s in sinks:
                s.close()
            yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first_id": pa.array([first], pa.int64()), "path": [f"{root}/{name}"], "n_tokens": [n], "n_docs": [n_docs]})

    files = Scratch(spark, "manifest").table(ranged.mapInArrow(put, "part int, first_id long, path string, n_tokens long, n_docs long"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # one row per file


def _each_document(files: DataFrame, column: str, kind: pa.DataType, of: Callable[[bytes], object]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and a column of its ids as little-endian uint32."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                tokens = SequenceFile(f"{name}.tokens.arrow")
                for rows in pa.ipc.open_stream(_open(f"{name}.index.arrow")):
                    start, n = rows.column("start").to_numpy(), rows.column("n_tokens").to_numpy()
                    for i in range(0, len(start), 256):
                        values = [of(tokens.span(a, b).astype("<u4").tobytes()) for a, b in zip(start[i : i + 256].tolist(), n[i : i + 256].tolist(), strict=True)]
                        yield pa.record_batch({"doc_id": rows.column("doc_id")[i : i + 256], "start": pa.array(start[i : i + 256] + base), "n_tokens": pa.array(n[i : i + 256]), column: pa.array(values, kind)})

    schema = f"doc_id long, start long, n_tokens long, {column} {'binary' if kind == pa.binary() else 'long'}"
    return files.repartition(partitions(files.sparkSession), "path").mapInArrow(get, schema)


def read_documents(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian uint32)."""
    return _each_document(files, "ids", pa.binary(), bytes)


def read_checksums(files: DataFrame) -> DataFrame:
    """As read_documents, with the unsigned crc32 of the ids as ids_crc32 (long) in their place, so that no ids leave the reader."""
    return _each_document(files, "ids_crc32", pa.int64(), zlib.crc32)
