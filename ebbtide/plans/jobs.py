"""The searches a user runs, composed from operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import performance as P
from ..operators import picks, reports, signals
from ..operators.joins import lookup, restrict
from ..operators.rebound import best_rebounds, rebound_stats
from ..params import (SCREEN_PRESETS, ContractParams, PerformanceParams, ReboundParams, ScanParams,
                      ScreenParams, SeriesParams)
from ..session import written


def reversal_scan(bars: DataFrame, chain: DataFrame | None = None, symbols: DataFrame | None = None,
                  scan: ScanParams = ScanParams(), contracts: ContractParams = ContractParams(),
                  series: SeriesParams = SeriesParams()) -> DataFrame:
    """Signals by score; with a chain, only those with a best call, attached."""
    bars = restrict(bars, symbols) if symbols is not None else bars
    found = signals.signals(signals.scan(bars, scan, series), scan)
    if chain is None:
        return found
    best = picks.best_calls(picks.near_calls(chain, contracts), contracts)
    return A.with_contract(found, best).orderBy(F.desc("score"), "symbol")


def check_symbol(bars: DataFrame, chain: DataFrame, symbol: str, scan: ScanParams = ScanParams(),
                 contracts: ContractParams = ContractParams()) -> DataFrame:
    """One symbol whatever its score and liquidity, with its best call if any.

    The filter on the symbol reaches the scans of both tables.
    """
    mine = F.col("symbol") == symbol.strip().upper()
    scored = signals.score(signals.scan_features(bars.where(mine), scan), scan)
    best = picks.best_calls(picks.near_calls(chain.where(mine), contracts), contracts)
    return scored.join(best, "symbol", "left")


def symbol_chart(bars: DataFrame, symbol: str, scan: ScanParams = ScanParams()) -> DataFrame:
    """The chart table that goes with the check of one symbol."""
    return reports.chart_table(bars.where(F.col("symbol") == symbol.strip().upper()), scan)


def cheap_contracts(bars: DataFrame, chain: DataFrame, max_contract_price: float | None = None,
                    qualified: DataFrame | None = None, scan: ScanParams = ScanParams(),
                    contracts: ContractParams = ContractParams()) -> DataFrame:
    """Calls at or under a contract price on liquid symbols, at most top-n each.

    The liquid symbols are written, so that Spark knows their size and need not
    move the chain, which is read twice, to meet them.
    """
    bars = restrict(bars, qualified) if qualified is not None else bars
    liquid = written(signals.liquidity(bars, scan).where("liquid").select("symbol"), "liquid")
    mine = chain.join(liquid, "symbol", "left_semi")
    return picks.cheap_calls(picks.near_calls(mine, contracts), max_contract_price, contracts)


def bottom_rebounds(bars: DataFrame, chain: DataFrame, qualified: DataFrame | None = None,
                    contracts: ContractParams = ContractParams(), rebound: ReboundParams = ReboundParams(),
                    series: SeriesParams = SeriesParams()) -> DataFrame:
    """Best dip-and-rebound symbols with their qualifying calls, one row per contract."""
    bars = restrict(bars, qualified) if qualified is not None else bars
    best = best_rebounds(rebound_stats(bars, rebound, series), contracts.bottom_symbols)
    mine = lookup(chain, best.select("symbol"), ["symbol"], "contract_symbol", "left_semi")
    calls = picks.bottom_calls(picks.near_calls(mine, contracts, bottom=True), contracts)
    return best.join(calls, "symbol")


def performance(alerts: DataFrame, bars: DataFrame, now: str,
                params: PerformanceParams = PerformanceParams()) -> DataFrame:
    """Win rate and mean alpha per horizon at `now`."""
    checks = P.horizon_checks(P.track(alerts, bars, params), params)
    return P.report(P.fold(P.settle(checks, bars, now, params)))


def options_screener(chain: DataFrame, params: ScreenParams | str = "cli", symbols: DataFrame | None = None,
                     sort_by: str = "volume", top: int | None = 25) -> DataFrame:
    """Contracts passing every threshold, sorted; all of them without a `top`."""
    params = SCREEN_PRESETS[params] if isinstance(params, str) else params
    rows = restrict(chain, symbols, "contract_symbol") if symbols is not None else chain
    passed = picks.screen(rows, params)
    return passed if top is None else picks.top_contracts(passed, sort_by, top)


def active_signals(bars: DataFrame, chain: DataFrame, memory: DataFrame, scan: ScanParams = ScanParams(),
                   contracts: ContractParams = ContractParams()) -> DataFrame:
    """Remembered symbols that still qualify, for a reader who joins late.

    Unlike a scan this does not look at liquidity again.
    """
    mine = restrict(bars, memory)
    still = signals.signals(signals.score(signals.scan_features(mine, scan), scan), scan)
    best = picks.best_calls(picks.near_calls(
        lookup(chain, memory.select("symbol").distinct(), ["symbol"], "contract_symbol", "left_semi"), contracts), contracts)
    return A.with_contract(still, best).orderBy("symbol")
