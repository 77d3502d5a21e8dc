"""Correction memory kept up to date from a stream of feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.memory import corrections, merge


def update(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch of feedback into a new version of the memory under ``path``.

    Version n + 1 is written from version n and batch n, so a batch that runs
    again after a failure writes the same version and counts nothing twice.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        fresh = corrections(batch)
        if epoch > 0:
            fresh = merge(batch.sparkSession.read.parquet(f"{path}/v={epoch - 1}"), fresh)
        fresh.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
