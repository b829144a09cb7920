"""The continuous scan: new bars in, signals out, with the hot lane beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructType

from ..functions.dates import is_trading_day, scan_paused
from ..operators import alerts, signals
from ..operators.patterns import features_of, marked_tail
from ..params import ScanParams, SessionParams
from ..schemas import BARS
from .steps import read_before, read_newest, read_version, run_batches, write_version
from .tails import as_bars, as_tails, stored_tails, symbol_tails

HOT = StructType().add("symbol", StringType())
HISTORY = StructType([f for f in BARS.fields if f.name != "interval"])
ROWS = ("symbol", "bar_ts", "price", "score", "signature", "matched", "reasons")


def in_session(ts: Column, session: SessionParams, at: str | None = None) -> Column:
    """Whether the market is scanned: at the time `at` of the scan, or as of each bar in a replay.

    A daily bar is stamped at midnight of its exchange date; in a replay that date decides.
    """
    if at is not None:
        ts = F.lit(at).cast("timestamp")
    elif session.daily_bars:
        return is_trading_day(F.to_date(ts)) if session.pause_weekends_and_holidays else F.lit(True)
    return ~scan_paused(ts, session.pause_weekends_and_holidays, session.regular_hours_only)


def score_tails(tails: DataFrame, scan: ScanParams) -> DataFrame:
    """Every liquid symbol with its score, from tails with positions and RSI."""
    frame = tails.withColumn("ts", F.timestamp_micros("us"))
    return signals.score(features_of(marked_tail(frame, scan), scan), scan).where("liquid")


def with_best(found: DataFrame, best: DataFrame | None) -> DataFrame:
    return found if best is None else alerts.with_contract(found, best)


def looked_at(batch: DataFrame, session: SessionParams, at: str | None = None) -> DataFrame:
    return batch.where(F.col("opened") if at is None else in_session(F.lit(None), session, at))


def scan_step(batch: DataFrame, session: SessionParams, scan: ScanParams, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, symbols looked at) from the tails of a micro-batch.

    Looked at are symbols with a bar in an open session; with the time `at` of the
    scan, all or none of them.
    """
    now = looked_at(batch, session, at)
    return score_tails(now, scan), now.select("symbol").distinct()


def scan_stream(bars: DataFrame, out: str, hot: str, checkpoint: str, session: SessionParams = SessionParams(), scan: ScanParams = ScanParams(),
                best: DataFrame | None = None, every: str | None = None, clock: Callable[[], str] | None = None) -> StreamingQuery:
    """Take the bars of each micro-batch into the state, score the symbols they touch, write signals and hot list.

    A batch reads its own bars and the states of their symbols, never the history.
    While the market is paused bars are remembered, nothing is scored and the hot
    list stays as it is. With `best` a signal needs a contract. A live scan passes a
    `clock`, which tells the time of each scan.
    """
    scored_at = f"{hot.rstrip('/')}-scored"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # the state is advanced once
        at = clock() if clock else None
        scored, touched = scan_step(as_tails(batch), session, scan, at)[0], looked_at(batch, session, at).select("symbol")
        # Written once; signals and hot list are read from it.
        write_version(scored.select(*ROWS), scored_at, number)
        scored = read_version(spark, scored_at, number)
        write_version(with_best(signals.signals(scored, scan), best).select(*ROWS), out, number)
        hot_now = signals.hot_symbols(scored, scan)
        before = read_before(spark, hot, number, HOT).join(touched, "symbol", "left_anti")
        write_version(before.unionByName(hot_now).distinct(), hot, number)
        batch.unpersist()

    return run_batches(symbol_tails(bars, in_session(F.col("ts"), session), scan), step, checkpoint, every)


def hot_lane_stream(bars: DataFrame, state: str, hot: str, out: str, checkpoint: str, session: SessionParams = SessionParams(), scan: ScanParams = ScanParams(),
                    best: DataFrame | None = None, every: str | None = "120 seconds", clock: Callable[[], str] | None = None) -> StreamingQuery:
    """Score near-signals again on a short trigger; its signals are marked hot.

    `state` is the checkpoint of the scan stream, whose state is read as a table,
    and `hot` the folder of its hot list. Each trigger looks at what they hold by
    then, and at its own bars, which the scan may have seen or not. It takes the
    whole list: a cut by name would leave out the same symbols every time.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        only = read_newest(spark, hot, HOT)
        new = as_bars(batch, in_session(F.col("ts"), session))
        came = only.join(new.select("symbol").distinct(), "symbol", "left_semi")
        scored, _ = scan_step(stored_tails(spark, state, came, new, scan), session, scan, clock() if clock else None)
        found = with_best(signals.signals(scored, scan), best)
        write_version(found.select(*ROWS).withColumn("is_hot", F.lit(True)), out, number)

    return run_batches(bars, step, checkpoint, every)
