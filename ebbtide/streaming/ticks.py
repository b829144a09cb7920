"""Ticks to bars, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BARS
from ..sources.readers import path_exists
from .steps import with_state


def to_bars(ticks: DataFrame, width: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """One bar per symbol and window; partial bars are made before the shuffle.

    With `lateness` (streams) a bar is final once the watermark passes its end,
    and later ticks are dropped.
    """
    rows = ticks.withWatermark("ts", lateness) if lateness else ticks
    order = F.struct("ts", "event_id")
    bars = rows.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").cast("double").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def bar_stream(ticks: DataFrame, out: str, checkpoint: str, width: str = "1 hour", lateness: str = "1 hour",
               every: str | None = None):
    """Write final bars as they close; ticks later than the watermark are dropped."""
    writer = (to_bars(ticks, width, lateness).writeStream.outputMode("append").format("parquet")
              .option("path", out).option("checkpointLocation", checkpoint))
    return with_state(ticks.sparkSession, (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start)


def open_bars(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Bars of the windows that an ended `bar_stream` still held, from its own state.

    Closes a bounded run: together with the written bars every window is there
    once, and no tick is read again. A stream that will be resumed writes them
    itself later.
    """
    if not path_exists(spark, f"{checkpoint}/state/0/_metadata"):
        return spark.createDataFrame([], BARS).drop("interval")
    # In the order of the sums of to_bars, whose own names repeat; a first and a last price come with the place they were found at.
    place = "struct<ts: timestamp, event_id: bigint>"
    held = F.col("value").cast(f"struct<open: double, first: {place}, high: double, low: double, close: double, last: {place}, size: bigint>")
    state = spark.read.format("statestore").load(checkpoint).select("key.symbol", F.col("key.window.start").alias("ts"), held.alias("v"))
    return state.select("symbol", "ts", "v.open", "v.high", "v.low", "v.close", F.col("v.size").cast("double").alias("volume"))
