"""The alert memory as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructType, TimestampType

from ..operators.alerts import alert_memory
from .steps import read_before, run_batches, write_version

MEMORY = StructType().add("symbol", StringType()).add("signature", StringType()).add("ts", TimestampType())
SENT = (StructType().add("symbol", StringType()).add("ts", TimestampType()).add("alert_id", LongType())
        .add("signature", StringType()))
SEED = -1


def memory_step(batch: DataFrame, memory: DataFrame, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(sent, memory after) of one micro-batch.

    What is remembered enters as the signal each symbol sent last; then the batch
    operator decides. Faded entries are dropped: a later signal of theirs is sent
    anyway. A row that comes late, at or before its symbol's last sent signal and
    with the same signature, is not sent again.
    """
    sent_at = memory.select("symbol", "signature", F.col("ts").alias("_sent_at"))
    batch = (batch.join(sent_at, ["symbol", "signature"], "left")
             .where("_sent_at is null or ts > _sent_at").drop("_sent_at"))
    seeds = memory.select("symbol", "ts", F.lit(SEED).cast("long").alias("alert_id"), "signature")
    events = batch.select("symbol", "ts", "alert_id", "signature").unionByName(seeds)
    sent = alert_memory(events, hours)
    last = sent.groupBy("symbol").agg(
        F.max_by(F.struct("signature", "ts"), F.struct("ts", "alert_id")).alias("m")).select("symbol", "m.*")
    now = events.agg(F.max("ts")).scalar()
    kept = last.where(F.unix_seconds(now) - F.unix_seconds("ts") <= hours * 3600)
    return sent.where(F.col("alert_id") != SEED).select(*SENT.names), kept.select(*MEMORY.names)


def alert_stream(events: DataFrame, out: str, memory: str, checkpoint: str, hours: int = 24,
                 every: str | None = None) -> StreamingQuery:
    """Send new or changed signals. Sent rows go to `out`, one version per batch.

    Put the contract gate before this: a symbol without a contract must not be
    remembered.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sent, kept = memory_step(batch, read_before(spark, memory, number, MEMORY), hours)
        write_version(sent, out, number)
        write_version(kept, memory, number)

    return run_batches(events, step, checkpoint, every)


def keyed_alert_stream(events: DataFrame, hours: int = 24, lateness: str = "0 seconds") -> DataFrame:
    """The same memory as keyed state with an event-time timeout, for a live scan.

    Each scan yields one row per symbol, so a group of one micro-batch holds a row
    per scan in it; bulk history belongs in `alert_stream`.
    """
    gap = pd.Timedelta(hours=hours)

    def remember(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        signature, since = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "alert_id"], ignore_index=True)
        sent = []
        for row in rows.itertuples(index=False):
            if signature != row.signature or row.ts - pd.Timestamp(since) > gap:
                signature, since = row.signature, row.ts
                sent.append(row)
        state.update((signature, pd.Timestamp(since).to_pydatetime()))
        fades = int(pd.Timestamp(since).timestamp() * 1000) + int(gap.total_seconds() * 1000) + 1
        state.setTimeoutTimestamp(max(fades, state.getCurrentWatermarkMs() + 1))
        if sent:
            yield pd.DataFrame(sent)[SENT.names]

    return (events.select(*SENT.names).withWatermark("ts", lateness).groupBy("symbol").applyInPandasWithState(
        remember, SENT, StructType().add("signature", StringType()).add("since", TimestampType()),
        "append", GroupStateTimeout.EventTimeTimeout))
