"""Rolling indicators as columns over an ordered window of `pos`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import ReboundParams, ScanParams, SeriesParams
from . import series as S


def once_there_are(rows: int, value: Column) -> Column:
    """`value` from the bar on that completes `rows` of them."""
    return F.when(F.col("pos") + 1 >= rows, value)


def bollinger(w, period: int = 20, width: float = 2.0, close: str = "close") -> dict[str, Column]:
    frame = w.rowsBetween(-(period - 1), 0)
    mid, dev = F.avg(close).over(frame), F.stddev_pop(close).over(frame)
    return {name: once_there_are(period, col) for name, col in
            (("bb_lower", mid - width * dev), ("bb_mid", mid), ("bb_upper", mid + width * dev))}


def gain_loss(w, close: str = "close") -> dict[str, Column]:
    delta = F.col(close) - F.lag(close).over(w)
    return {"delta": delta,
            "gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
            "loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))}


def rolling_extremes(w, bars: int = 252, needed: int = 60, close: str = "close") -> dict[str, Column]:
    frame = w.rowsBetween(-(bars - 1), 0)
    return {"roll_low": once_there_are(needed, F.min(close).over(frame)),
            "roll_high": once_there_are(needed, F.max(close).over(frame))}


def moving_average(w, bars: int = 50, close: str = "close") -> Column:
    return once_there_are(bars, F.avg(close).over(w.rowsBetween(-(bars - 1), 0)))


def change_over(w, bars: int = 20, close: str = "close") -> Column:
    return F.try_divide(F.col(close), F.lag(close, bars).over(w)) - 1.0


def best_ahead(w, bars: int = 30, close: str = "close") -> Column:
    """Highest close of the next `bars` rows, null unless all of them exist."""
    return F.when(F.col("pos") + bars < F.col("n_bars"),
                  F.max(close).over(w.rowsBetween(1, bars)))


def pivot(w, column: str, order: int = 3, highs: bool = False) -> Column:
    """Strict extreme of the centred frame of 2*order+1 rows, whole frame required."""
    before, after = w.rowsBetween(-order, -1), w.rowsBetween(1, order)
    whole = ((F.count(column).over(before) == order) & (F.count(column).over(after) == order))
    if highs:
        extreme = ((F.col(column) > F.max(column).over(before))
                   & (F.col(column) > F.max(column).over(after)))
    else:
        extreme = ((F.col(column) < F.min(column).over(before))
                   & (F.col(column) < F.min(column).over(after)))
    return F.coalesce(whole & extreme, F.lit(False))


def indicator_series(bars: DataFrame, scan: ScanParams = ScanParams(),
                     rebound: ReboundParams = ReboundParams(),
                     series: SeriesParams = SeriesParams(),
                     only: tuple[str, ...] | None = None) -> DataFrame:
    """Every indicator on every bar. `only` limits the columns computed."""
    w = S.block_window()
    makers = {
        "bollinger": (scan.bb_period - 1, 0, lambda: bollinger(w, scan.bb_period, scan.bb_std)),
        "gain_loss": (1, 0, lambda: gain_loss(w)),
        "extremes": (rebound.low_window - 1, 0,
                     lambda: rolling_extremes(w, rebound.low_window, rebound.low_min_bars)),
        "sma": (rebound.sma_bars - 1, 0, lambda: {"sma50": moving_average(w, rebound.sma_bars)}),
        "change": (rebound.change_bars, 0,
                   lambda: {"change_20": change_over(w, rebound.change_bars)}),
        "ahead": (0, rebound.horizon, lambda: {"best_ahead": best_ahead(w, rebound.horizon)}),
        "pivots": (scan.pivot_order, scan.pivot_order,
                   lambda: {"pivot_low": pivot(w, "low", scan.pivot_order),
                            "pivot_high": pivot(w, "high", scan.pivot_order, highs=True)}),
    }
    wanted = [k for k in makers if only is None or k in only]
    rsi = scan.rsi_period if only is None or "rsi" in only else None
    positioned = S.with_positions(bars, series, rsi_period=rsi)
    if not wanted:
        return positioned
    back = max(makers[k][0] for k in wanted)
    ahead = max(makers[k][1] for k in wanted)
    columns: dict[str, Column] = {}
    for key in wanted:
        columns.update(makers[key][2]())
    framed = S.in_blocks(positioned, back, ahead, series)
    return framed.withColumns(columns).where("is_core").drop(S.BLOCK, "is_core")


def symbol_window():
    """For tails only: the rows of a symbol are bounded by the tail length."""
    return Window.partitionBy("symbol").orderBy("pos")
