"""Streams of events: each event once, counts by window with late ones, running state by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def each_once(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Events by key once within the watermark; state older than that is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Events per window and by; a window is given out when the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("events"))


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, into Parquet. In the mode complete each batch's result replaces the one before."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "complete":
        q = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    else:
        q = w.format("parquet").option("path", out).start()
    q.awaitTermination()
