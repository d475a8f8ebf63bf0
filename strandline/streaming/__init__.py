"""Streams through the same operators: an app over micro-batches, and windowed counts of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.apps import App
from ..sources import store


def apply_app(stream: DataFrame, app: App, path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch through the app into a result store; a batch that comes again is written again under its number."""

    def write(batch: DataFrame, number: int) -> None:
        store.write_results(app(batch), f"{path}/batch={number}", "overwrite")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feature_counts(stream: DataFrame, time: str = "ts", biotype: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, stop, biotype, n) by tumbling windows; rows later than the watermark are left out."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window), biotype).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), F.col(biotype).alias("biotype"), "n")
