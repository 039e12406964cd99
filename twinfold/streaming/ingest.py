"""Incremental ingest: mentions arrive as a stream and are added to stored representations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.operators.represent import represent, with_reps


def ingest(mentions: DataFrame, groups: dict[str, list[str]], out: str, checkpoint: str):
    """Start a query that writes each batch's representations under its own number.

    Frequencies add up over batches (``current``), and a batch that is run again
    overwrites its own folder, so each mention counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        represent(with_reps(batch, groups)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return mentions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, out: str) -> DataFrame:
    """Representations over all batches so far."""
    return spark.read.parquet(out).groupBy("rep_id", "features").agg(F.sum("freq").alias("freq"), F.first("n").alias("n"))
