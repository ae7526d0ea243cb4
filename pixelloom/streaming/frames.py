"""Images that arrive over time: statistics by event-time windows, and catalogues of each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def light_curves(readings: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean, extremes and number of values by source and tumbling window of `ts`; on a stream, state goes once the watermark has passed."""
    rows = readings.withWatermark("ts", late) if readings.isStreaming else readings
    return rows.groupBy(F.window("ts", window).alias("w"), "source").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")).select(F.col("w.start").alias("start"), "source", "n", "mean", "min", "max")


def each_batch(pixels: DataFrame, measure: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Writes measure(batch) of a stream of pixels to a Parquet folder, batch by batch, under the batch's number: a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        measure(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pixels.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
