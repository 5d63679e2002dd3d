"""Continuous ingestion and sessions over streams: extensions of the batch operators.

Samples arrive as a stream; late ones are taken until the watermark has passed. Upserts go through
``foreachBatch``: a micro-batch is merged into the months that it reaches, and merging it again after a
failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators.wear import VALID_BPM
from ..store import Store


def valid_samples(stream: DataFrame) -> DataFrame:
    """The row-by-row part of the valid-sample filter, with the event time that watermarks need."""
    ok = stream.where(F.col("context").isin("background", "workout") & F.col("bpm").between(*VALID_BPM))
    return ok.withColumn("at", F.timestamp_seconds("ts"))


def wear_sessions(stream: DataFrame, keys: tuple[str, ...] = ("device_id",), gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Worn sessions: samples no further apart than the gap, closed once the watermark has passed."""
    windowed = valid_samples(stream).withWatermark("at", late).groupBy(*keys, F.session_window("at", gap).alias("w"))
    return windowed.agg(F.count(F.lit(1)).alias("samples"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")).drop("w")


def minute_means(stream: DataFrame, keys: tuple[str, ...] = ("device_id",), late: str = "1 hour") -> DataFrame:
    """Mean heart rate per minute."""
    windowed = valid_samples(stream).withWatermark("at", late).groupBy(*keys, F.window("at", "1 minute").alias("w"))
    return windowed.agg(F.avg("bpm").alias("bpm"), F.count(F.lit(1)).alias("samples")).select(*keys, F.col("w.start").alias("minute"), "bpm", "samples")


def ingest_points(stream: DataFrame, store: Store, table: str, checkpoint: str) -> StreamingQuery:
    """Upsert a stream of canonical point rows into a table; runs until what is there has been read."""
    if schema.TABLES[table].strategy != "point":
        raise ValueError(f"{table} has no points")

    def merge(batch: DataFrame, _: int) -> None:
        store.merge(table, batch)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
