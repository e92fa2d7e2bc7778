"""Tables in versions: files of blocks, and a log of which files are current. Applying a batch again changes nothing.

A row's block is a hash of its key. A batch rewrites the blocks it touches into files of their own; then one log entry,
which names the batch and the current files of all blocks, is put in place at once, or fails if another writer was
first. A writer that dies before leaves files that nobody reads; its batch is applied by whoever tries again.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = "_block"


class Conflict(RuntimeError):
    """Another writer took the version and some of the same blocks."""


class Snapshots:
    """One table below a folder that driver and executors share. schema: of its rows; blocks: fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: Iterable[str], blocks: int = 64, by: Column | None = None):
        self.spark, self.path, self.blocks = spark, path.rstrip("/"), blocks
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.key = tuple(key)
        self.block = by if by is not None else F.pmod(F.xxhash64(*self.key), F.lit(blocks)).cast("int")

    def on(self, spark: SparkSession) -> Snapshots:
        """The same table for another session."""
        return Snapshots(spark, self.path, self.schema, self.key, self.blocks, self.block)

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log")
        return jvm, at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version; 0 if nothing was ever applied."""
        _, at, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n[:20]) for n in names if n.endswith(".json")), default=0)

    def entry(self, version: int | None = None) -> dict:
        """The log entry of a version: batch, and for each block that has rows the folder of its files."""
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "batch": None, "files": {}}
        return json.loads(self.spark.read.text(f"{self.path}/_log/{v:020d}.json", wholetext=True).first().value)

    def applied(self, batch: str) -> bool:
        return bool(self.version()) and not self.spark.read.schema("batch string").json(f"{self.path}/_log/*.json").filter(F.col("batch") == batch).isEmpty()

    def read(self, version: int | None = None, blocks: Iterable[int] | None = None, entry: dict | None = None) -> DataFrame:
        """Rows of a version (the last one), or of some of its blocks only: no other files are listed."""
        files = (entry or self.entry(version))["files"]
        wanted = files if blocks is None else [str(b) for b in blocks if str(b) in files]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{files[b]}" for b in wanted])

    def apply(self, batch: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], order: Iterable[str] = (), tries: int = 5) -> bool:
        """Puts merge(rows of the touched blocks, changes) in their place; False if the batch was applied before.

        merge gets both with the column BLOCK and returns rows with it. One that has dealt its rows by BLOCK itself
        says so by an attribute `dealt`, and they are not dealt again. A writer that lost a race for other blocks only takes the next version;
        for the same blocks it starts again from the new rows.
        """
        for _ in range(tries):
            now = self.entry()
            if self.applied(batch):
                return False
            touched = sorted(r[0] for r in changes.select(self.block.alias("b")).distinct().collect())  # at most `blocks`
            token = uuid.uuid4().hex
            columns = [*self.schema.names, self.block.alias(BLOCK)]
            put = merge(self.read(blocks=touched, entry=now).select(columns), changes.select(columns)).select(*self.schema.names, BLOCK)
            if not getattr(merge, "dealt", False):
                put = put.repartition(max(1, len(touched)), BLOCK)
            with shuffle_files_go(self.spark):
                put.sortWithinPartitions(BLOCK, *order).write.partitionBy(BLOCK).option("compression", "zstd").option("parquet.block.size", 1 << 20).parquet(f"{self.path}/data/{token}")
            try:
                self._commit(batch, now, {str(b): f"data/{token}/{BLOCK}={b}" for b in touched})
                return True
            except Conflict:
                continue
        raise Conflict(f"{batch}: other writers were first {tries} times")

    def _commit(self, batch: str, since: dict, put: dict[str, str]) -> None:
        jvm, at, fs = self._fs()
        path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}")
        written = {b: p for b, p in put.items() if fs.exists(path(p))}  # a block may have lost its last row
        base = since
        while True:
            files = {**{b: p for b, p in base["files"].items() if b not in put}, **written}
            entry = {"version": base["version"] + 1, "batch": batch, "files": files}
            draft, name = path(f"_drafts/{uuid.uuid4().hex}"), path(f"_log/{entry['version']:020d}.json")
            out = fs.create(draft, True)
            out.write(bytearray(json.dumps(entry).encode()))
            out.close()
            fs.mkdirs(at)
            options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            try:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, name, options)
                return
            except Exception as error:
                fs.delete(draft, True)
                if not fs.exists(name):
                    raise
                base = self.entry()
                if base["batch"] == batch or any(base["files"].get(b) != since["files"].get(b) for b in put):
                    raise Conflict(batch) from error

    def clean(self, keep: int = 1) -> int:
        """Deletes files that none of the last `keep` versions names; how many folders went. No writer may be at work."""
        jvm, _, fs = self._fs()
        last = self.version()
        named = {p.split("/")[1] for v in range(max(1, last - keep + 1), last + 1) for p in self.entry(v)["files"].values()}
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in named] if fs.exists(data) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)

    def drop(self) -> None:
        """Deletes the table."""
        jvm, _, fs = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(self.path), True)


@contextlib.contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes inside go when the write ends, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def latest(key: Iterable[str], *order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps, of each key, the row of greatest order; a change wins over an equal one that was there.

    Rows are dealt by block once; grouping by block and key keeps that.
    """
    names = tuple(key)

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in old.columns if c not in (*names, BLOCK)]
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rank = F.struct(*[F.col(c) for c in order], "_new", F.xxhash64(*rest) if rest else F.lit(0))
        one = both.repartition(parts, BLOCK).groupBy(BLOCK, *names).agg(F.max_by(F.struct(*(rest or names)), rank).alias("_row"))
        return one.select(BLOCK, *names, *[F.col(f"_row.{c}") for c in rest])

    merge.dealt = True
    return merge


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:  # noqa: ARG001 - a merge takes both
    """A merge that puts the changes in place of all rows of their blocks; they are dealt by block already."""
    return new


replaced.dealt = True


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """A merge that keeps all rows."""
    return old.unionByName(new)
