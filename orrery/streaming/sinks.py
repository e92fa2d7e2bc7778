"""Streams into versioned tables: a micro-batch is applied under its number, so a restart repeats none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from orrery.sources.snapshots import Snapshots, added

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def upsert_sink(stream: DataFrame, table: Snapshots, merge: Merge, name: str, checkpoint: str, valid: Column | None = None, dead: Snapshots | None = None) -> DataStreamWriter:
    """A writer that merges each micro-batch into a table, and rows that are not valid into `dead` as (raw string, batch long).

    The batch's number comes from the checkpoint, and both tables remember the batches they took. A run that died after
    it wrote one table or both, and before the checkpoint knew, is given the same batch again and adds only what is
    missing. name tells apart the streams that write to one table.
    """

    def put(rows: DataFrame, number: int) -> None:
        batch, ok = f"{name} {number}", F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
        rows.persist()
        try:
            table.on(rows.sparkSession).apply(batch, rows.filter(ok), merge)
            if dead is not None:
                dead.on(rows.sparkSession).apply(batch, rows.filter(~ok).select(F.to_json(F.struct("*")).alias("raw"), F.lit(number).cast("long").alias("batch")), added)
        finally:
            rows.unpersist()

    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(put)
