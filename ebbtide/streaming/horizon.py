"""Horizon checks settled while bars come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.performance import PRICE_SESSIONS, fold, is_due, merge_folds, settle
from ..operators.sessions import with_session
from ..params import PerformanceParams
from ..sources.readers import newest_delivery
from .scan import HISTORY
from .steps import read_before, read_version, run_batches, write_version

CLOCK = "now timestamp"
SUMMARY = "horizon_h int, n bigint, wins bigint, sum_alpha double"


def horizon_stream(bars: DataFrame, checks: DataFrame, prices: str, out: str, pending: str, checkpoint: str,
                   params: PerformanceParams = PerformanceParams(), every: str | None = None) -> StreamingQuery:
    """Close what is due at the time of the newest bar; the rest stays pending.

    Closed checks go to `out`, one version per batch; `checks` is where pending
    ones start from. Bars come in order of time from batch to batch; a later
    check can be priced only by the last sessions, so a batch leaves those bars
    in `prices` for the next and nothing older is read again. The newest time is
    carried as one number. Only bars of symbols with open checks and of the benchmark are kept,
    and only checks that are due are judged. Beside the pending checks lies their summary so far:
    each batch adds its own to the one before.
    """
    columns, beside = checks.columns, pending.rstrip("/")

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = read_before(spark, f"{beside}-clock", number, spark.createDataFrame([], CLOCK).schema)
        clock = batch.agg(F.max("ts").alias("now")).unionByName(before).agg(F.max("now").alias("now"))
        write_version(clock, f"{beside}-clock", number)
        now = read_version(spark, f"{beside}-clock", number).select(F.date_format("now", "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        if number == 0:
            write_version(checks, f"{beside}-start", number)
        open_ = read_version(spark, f"{beside}-start", number) if number == 0 else read_before(spark, pending, number, checks.schema)
        # Only prices of symbols that still have a check, and of the benchmark, are looked at by this and later batches.
        index = spark.createDataFrame([(params.benchmark,)], "symbol string")
        write_version(open_.select("symbol").union(index).distinct(), f"{beside}-asked", number)
        late = read_before(spark, prices, number, HISTORY).withColumn("batch", F.lit(0))
        came = batch.select(*HISTORY.names).withColumn("batch", F.lit(1)).unionByName(late).join(read_version(spark, f"{beside}-asked", number), "symbol", "left_semi")
        write_version(newest_delivery(came, "batch"), f"{beside}-bars", number)
        known = read_version(spark, f"{beside}-bars", number)
        # Written once; all results are read from it. Checks that are not due yet are not judged.
        due = is_due(now, params)
        waiting = open_.where(~due).select(*columns)
        write_version(settle(open_.where(due), known, now, params, stored=True), f"{beside}-judged", number)
        judged = read_version(spark, f"{beside}-judged", number)
        write_version(judged.where("status <> 'pending'"), out, number)
        write_version(judged.where("status = 'pending'").select(*columns).unionByName(waiting), pending, number)
        had = read_before(spark, f"{beside}-summary", number, spark.createDataFrame([], SUMMARY).schema)
        write_version(merge_folds(had, fold(judged)), f"{beside}-summary", number)
        last = with_session(spark.createDataFrame([(now,)], "now string"), "now").first()["_session"]
        write_version(with_session(known, "ts").where(F.col("_session") > F.lit(last) - PRICE_SESSIONS).drop("_session"), prices, number)

    return run_batches(bars, step, checkpoint, every)
