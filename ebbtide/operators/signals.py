"""The scan: liquidity gate, filter registry, score, signature, statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions.strings import plain_number, price_text
from ..functions.numeric import nan_as_null
from ..params import ScanParams, SeriesParams
from . import series as S
from .patterns import scan_features


@dataclass(frozen=True)
class ScanFilter:
    """A named test on the feature row; `matched` and `reason` are columns."""

    label: str
    matched: Callable[[ScanParams], Column]
    reason: Callable[[ScanParams], Column]


def _enough(bars: int) -> Column:
    return F.col("n_bars") >= bars


def _bollinger(p: ScanParams) -> Column:
    return (_enough(p.bb_period + 1)
            & ((F.col("price") <= F.col("bb_lower") * (1.0 + p.bb_tolerance))
               | (F.col("last_low") <= F.col("bb_lower"))))


def _bollinger_reason(p: ScanParams) -> Column:
    usable = _enough(p.bb_period + 1) & F.col("bb_lower").isNotNull()
    return F.when(usable, F.concat(F.lit(T.LOWER_BAND), price_text(F.col("bb_lower")))).otherwise(T.TOO_FEW_BARS)


def _rsi(p: ScanParams) -> Column:
    return _enough(p.rsi_period + 1) & (F.col("rsi") < p.rsi_oversold)


def _rsi_reason(p: ScanParams) -> Column:
    usable = _enough(p.rsi_period + 1) & F.col("rsi").isNotNull()
    return F.when(usable, F.concat(F.lit("RSI="), plain_number(F.col("rsi"), 1))).otherwise(T.TOO_FEW_BARS)


def _support_reason(p: ScanParams) -> Column:
    return (F.when(F.size("support_lows") < p.support_touches, T.SUPPORT_FEW_LOWS)
            .when(F.col("support_level").isNull(), T.SUPPORT_FAR)
            .otherwise(F.concat(F.lit(T.SUPPORT_AT), price_text(F.col("support_level")))))


def _wedge_reason(p: ScanParams) -> Column:
    lines = F.create_map(*[F.lit(x) for pair in T.WEDGE_REASONS.items() for x in pair])
    return lines[F.col("wedge_state")]


FILTERS: dict[str, ScanFilter] = {
    "bollinger": ScanFilter(T.FILTER_LABELS["bollinger"], _bollinger, _bollinger_reason),
    "rsi": ScanFilter(T.FILTER_LABELS["rsi"], _rsi, _rsi_reason),
    "support": ScanFilter(T.FILTER_LABELS["support"],
                          lambda p: F.col("support_level").isNotNull(), _support_reason),
    "wedge": ScanFilter(T.FILTER_LABELS["wedge"], lambda p: F.col("wedge_state") == "wedge", _wedge_reason),
}


def with_python_filter(features: DataFrame, bars: DataFrame, key: str,
                       test: Callable[[pd.DataFrame], tuple[bool, str]], lookback: int,
                       series: SeriesParams = SeriesParams()) -> tuple[DataFrame, ScanFilter]:
    """Attach a user's own test on the last `lookback` bars of each symbol.

    A test that raises counts as not matched. Returns the widened features and
    the registry entry to add under `key`.
    """
    history = S.tail(S.with_positions(bars, series), lookback)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            ok, detail = test(frame.sort_values("pos", ignore_index=True))
        except Exception:
            ok, detail = False, T.FILTER_FAILED
        return pd.DataFrame({"symbol": frame["symbol"].iloc[:1].to_list(),
                             f"{key}_ok": [bool(ok)], f"{key}_reason": [str(detail)]})

    answers = history.groupBy("symbol").applyInPandas(
        run, f"symbol string, {key}_ok boolean, {key}_reason string")
    entry = ScanFilter(key, lambda p: F.col(f"{key}_ok"), lambda p: F.col(f"{key}_reason"))
    return features.join(answers, "symbol", "left"), entry


def liquidity(bars: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """Last close and mean of the last volumes per symbol, with the gate's answer.

    The row-number limit is applied before the shuffle, so a task sends at most
    `volume_bars` rows per symbol however many it holds.
    """
    from pyspark.sql import Window

    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    recent = (bars.select("symbol", "ts", "close", nan_as_null("volume").alias("volume"))
              .withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= params.volume_bars))
    sums = recent.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_close"),
                                        F.avg("volume").alias("avg_volume"))
    return sums.withColumn("liquid", is_liquid("last_close", params))


def is_liquid(price: str, params: ScanParams) -> Column:
    return F.coalesce((F.col(price) >= params.min_price)
                      & (F.col("avg_volume") >= params.min_avg_volume), F.lit(False))


def score(features: DataFrame, params: ScanParams = ScanParams(),
          filters: dict[str, ScanFilter] | None = None) -> DataFrame:
    """Matched keys, score, signature and reasons per symbol; no threshold yet."""
    filters = FILTERS if filters is None else filters
    hits = F.array_compact(F.array(*[
        F.when(F.coalesce(f.matched(params), F.lit(False)), F.lit(k)) for k, f in filters.items()]))
    reasons = F.map_from_arrays(
        F.array(*[F.lit(k) for k in filters]),
        F.array(*[F.coalesce(f.reason(params), F.lit(T.FILTER_FAILED)) for f in filters.values()]))
    return (features.withColumn("matched", hits).withColumn("reasons", reasons)
            .withColumn("score", F.size("matched"))
            .withColumn("signature", F.array_join(F.array_sort("matched"), ","))
            .withColumn("liquid", is_liquid("price", params)))


def scan(bars: DataFrame, params: ScanParams = ScanParams(), series: SeriesParams = SeriesParams(),
         filters: dict[str, ScanFilter] | None = None) -> DataFrame:
    """Every liquid symbol with its score."""
    return score(scan_features(bars, params, series), params, filters).where("liquid")


def signals(scored: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    return scored.where(F.col("score") >= params.signal_score).orderBy(F.desc("score"), "symbol")


def hot_symbols(scored: DataFrame, params: ScanParams = ScanParams(),
                previous: DataFrame | None = None) -> DataFrame:
    """Near-signals; joined with the previous list while the market is paused."""
    hot = scored.where(F.col("score") >= params.hot_score).select("symbol")
    return (hot.union(previous.select("symbol")) if previous is not None else hot).distinct()


def hot_lane(hot: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """The first of the list by name, to look at; the stream's lane (`hot_lane_stream`) scores all of it."""
    return hot.orderBy("symbol").limit(params.hot_cap)


def scan_stats(universe: DataFrame, features_scored: DataFrame, params: ScanParams = ScanParams(),
               failed: DataFrame | None = None) -> DataFrame:
    """One row of counters over the requested symbols."""
    seen = features_scored.select("symbol", "liquid", "score", F.lit(True).alias("_data"))
    rows = universe.select("symbol").distinct().join(seen, "symbol", "left")
    if failed is not None:
        rows = rows.join(failed.select("symbol", F.lit(True).alias("_failed")).distinct(), "symbol", "left")
    else:
        rows = rows.withColumn("_failed", F.lit(None).cast("boolean"))
    liquid = F.coalesce(F.col("liquid"), F.lit(False))
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count("_data").alias("with_data"),
        F.count_if(liquid).alias("liquid"), F.count("_failed").alias("errors"),
        F.count_if(liquid & (F.col("score") >= params.signal_score)).alias("matched"),
        F.count_if(liquid & (F.col("score") >= params.hot_score)).alias("hot"))
    return counts.withColumn("data_ratio", F.coalesce(
        F.try_divide(F.col("with_data").cast("double"), F.col("total")), F.lit(1.0)))
