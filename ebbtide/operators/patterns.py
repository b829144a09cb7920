"""Per-symbol features of the last bar: levels, trend lines, bands, RSI.

All of them come from one pass: positions and RSI over the whole history, then
the tail of each symbol (at most `tail_bars` rows) windowed and folded to a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan_as_null
from ..params import ScanParams, SeriesParams
from . import indicators as I
from . import series as S


def cluster_levels(sorted_prices: Column, tolerance: float, touches: int) -> Column:
    """Mean of each cluster with enough touches, ascending.

    A price joins the open cluster while within `tolerance` of its first price,
    so clusters depend on order; the array holds at most one lookback of lows.
    """
    cluster = "array<struct<s:double,n:int>>"
    start = F.struct(F.array().cast(cluster).alias("done"), F.lit(None).cast("double").alias("anchor"),
                     F.lit(0.0).alias("s"), F.lit(0).alias("n"))

    def push(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["n"].alias("n"))))

    def step(acc: Column, price: Column) -> Column:
        joins = price <= acc["anchor"] * (1.0 + tolerance)
        grown = F.struct(acc["done"].alias("done"), acc["anchor"].alias("anchor"),
                         (acc["s"] + price).alias("s"), (acc["n"] + 1).alias("n"))
        fresh = F.struct(F.when(acc["n"] > 0, push(acc)).otherwise(acc["done"]).alias("done"),
                         price.alias("anchor"), price.alias("s"), F.lit(1).alias("n"))
        return F.when(F.coalesce(joins, F.lit(False)), grown).otherwise(fresh)

    done = F.aggregate(sorted_prices, start, step,
                       lambda acc: F.when(acc["n"] > 0, push(acc)).otherwise(acc["done"]))
    return F.transform(F.filter(done, lambda c: c["n"] >= touches), lambda c: c["s"] / c["n"])


def lowest_level_in_reach(levels: Column, close: Column, above: float, below: float) -> Column:
    def in_reach(level: Column) -> Column:
        return (((close - level) / level).between(0.0, above)
                | ((level - close) / level).between(0.0, below))
    return F.get(F.filter(levels, in_reach), F.lit(0))


def tail_frame(bars: DataFrame, params: ScanParams = ScanParams(),
               series: SeriesParams = SeriesParams()) -> DataFrame:
    """The last rows of every symbol with bands, RSI and pivot marks."""
    return marked_tail(S.tail(S.with_positions(bars, series, rsi_period=params.rsi_period), params.tail_bars), params)


def marked_tail(tail: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """Bands and pivot marks for tails that have positions and RSI."""
    w = I.symbol_window()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def start(lookback: int) -> Column:
        return F.greatest(F.col("n_bars") - lookback, F.lit(0))

    marked = tail.withColumns({
        **I.bollinger(w, params.bb_period, params.bb_std),
        "pivot_low": I.pivot(w, "low", params.pivot_order),
        "pivot_high": I.pivot(w, "high", params.pivot_order, highs=True),
        "x": F.col("pos") - start(params.wedge_lookback),
        "in_support": F.col("pos") >= start(params.support_lookback) + params.pivot_order,
    })
    in_wedge = F.col("x") >= params.pivot_order
    sides = ("low", "high")  # both sides in one pass over the window
    marked = marked.withColumns({f"_{side}": (F.col(f"pivot_{side}") & in_wedge).cast("int") for side in sides})
    newer = {side: F.sum(f"_{side}").over(whole) - F.sum(f"_{side}").over(upto) for side in sides}
    marked = marked.withColumns({f"line_{side}": (F.col(f"_{side}") == 1) & (newer[side] < params.wedge_pivots) for side in sides})
    return marked.drop("_low", "_high")


def scan_features(bars: DataFrame, params: ScanParams = ScanParams(),
                  series: SeriesParams = SeriesParams()) -> DataFrame:
    """One row per symbol: everything the filters look at."""
    return features_of(tail_frame(bars, params, series), params)


def features_of(frame: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """The same from a marked tail."""
    recent = F.col("pos") >= F.col("n_bars") - params.volume_bars
    aggregates = [
        F.max("n_bars").alias("n_bars"),
        F.max_by(F.struct("ts", "close", "low", "rsi", "bb_lower"), "pos").alias("_last"),
        F.avg(F.when(recent, nan_as_null("volume"))).alias("avg_volume"),
        F.array_sort(F.collect_list(F.when(F.col("pivot_low") & F.col("in_support"), F.col("low"))))
         .alias("support_lows"),
    ]
    for side in ("high", "low"):
        used = F.col(f"line_{side}")
        y, x = F.when(used, F.col(side)), F.when(used, F.col("x")).cast("double")
        aggregates += [F.count(y).alias(f"{side}_pivots"), F.min(x).alias(f"{side}_from"),
                       F.regr_slope(y, x).alias(f"{side}_slope"),
                       F.regr_intercept(y, x).alias(f"{side}_intercept")]
    per_symbol = frame.groupBy("symbol").agg(*aggregates)
    per_symbol = per_symbol.select(
        "symbol", F.col("_last.ts").alias("bar_ts"), F.col("_last.close").alias("price"),
        F.col("_last.low").alias("last_low"), F.col("_last.rsi").alias("rsi"),
        F.col("_last.bb_lower").alias("bb_lower"),
        *[c for c in per_symbol.columns if c not in ("symbol", "_last")])
    return per_symbol.withColumns({
        "support_level": support_level(params), "wedge_state": wedge_state(params)})


def support_level(params: ScanParams) -> Column:
    levels = cluster_levels(F.col("support_lows"), params.support_cluster, params.support_touches)
    return F.when(F.size("support_lows") >= params.support_touches, lowest_level_in_reach(
        levels, F.col("price"), params.support_above, params.support_below))


def wedge_state(params: ScanParams) -> Column:
    """`wedge`, or the first condition that rules it out."""
    end = F.least(F.col("n_bars"), F.lit(params.wedge_lookback)) - 1
    hs, hi, ls, li = (F.col(c) for c in ("high_slope", "high_intercept", "low_slope", "low_intercept"))
    margin = params.wedge_margin * F.col("price")
    apex = F.when(hs < ls, (li - hi) / (hs - ls))
    inside = F.col("price").between(ls * end + li - margin, hs * end + hi + margin)
    return (F.when((F.col("high_pivots") < 2) | (F.col("low_pivots") < 2), "no_pivots")
            .when(end - F.least("high_from", "low_from") < params.wedge_min_bars, "too_short")
            .when(~((hs < 0) & (ls < 0) & (hs < ls)), "not_falling")
            .when(apex <= end, "crossed")
            .when(~inside, "outside").otherwise("wedge"))
