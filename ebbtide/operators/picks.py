"""Choosing contracts: provider fallback, expiry sample, best and top calls, screener."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import ContractParams, ScreenParams
from ..session import written
from . import quotes as Q

PROVIDERS = ("primary", "secondary")
# The secondary source lists calls and puts in one answer, of which calls are read.
CALLS_ONLY = ("secondary",)


def listings(chain: DataFrame) -> DataFrame:
    """Which expiries each provider lists per symbol; bounded by the calendar.

    The small table every later choice is made from: written, so that the chain
    itself is read twice only, once for this and once for the rows finally wanted.
    """
    return written(chain.groupBy("symbol", "provider", "dte").agg(F.bool_or(Q.of_types(("call",))).alias("has_call")), "listings")


def provider_outcomes(listed: DataFrame, window_days: int, order: tuple[str, ...] = PROVIDERS,
                      failed: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Per symbol: which provider answers, or why none does.

    The first provider in order with a contract inside the window wins. Without
    one: `failed` if every provider failed, `no_near_term` if any lists contracts,
    else `none_listed`.
    """
    counts = Q.in_window(window_days) & (~F.col("provider").isin(*CALLS_ONLY) | F.col("has_call"))
    flags = listed.groupBy("symbol", "provider").agg(
        F.bool_or(F.coalesce(counts, F.lit(False))).alias("near"), F.lit(True).alias("listed"))
    asked = (symbols if symbols is not None else listed).select("symbol").distinct().select(
        "symbol", F.posexplode(F.array(*[F.lit(p) for p in order])).alias("priority", "provider"))
    answers = asked.join(flags, ["symbol", "provider"], "left")
    if failed is not None:
        answers = answers.join(failed.select("symbol", "provider", F.lit(True).alias("down")).distinct(),
                               ["symbol", "provider"], "left")
    else:
        answers = answers.withColumn("down", F.lit(False))
    up = ~F.coalesce(F.col("down"), F.lit(False))
    near, any_listed = (up & F.coalesce(F.col(c), F.lit(False)) for c in ("near", "listed"))
    per_symbol = answers.groupBy("symbol").agg(
        F.min_by("provider", F.when(near, F.col("priority"))).alias("provider"),
        F.bool_or(any_listed).alias("any_listed"), F.bool_and(~up).alias("all_down"))
    return per_symbol.select("symbol", "provider", F.when(F.col("provider").isNotNull(), "has_contracts")
                             .when(F.col("all_down"), "failed").when(F.col("any_listed"), "no_near_term")
                             .otherwise("none_listed").alias("outcome"))


def sampled_expiries(listed: DataFrame, most: int, providers: tuple[str, ...] = PROVIDERS[:1]) -> DataFrame:
    """At most `most` expiries per symbol of the given providers, evenly spread; all of the others."""
    if most < 2:
        raise ValueError("an even sample needs at least two expiries")
    w = Window.partitionBy("symbol", "provider")
    ranked = listed.withColumn("_i", F.row_number().over(w.orderBy("dte")) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(w))
    step = (F.col("_n") - 1) / F.lit(float(most - 1))
    spots = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * step).cast("int"))
    kept = ranked.where(~F.col("provider").isin(*providers) | (F.col("_n") <= most)
                        | F.array_contains(spots, F.col("_i")))
    return kept.select("symbol", "provider", "dte")


def near_calls(chain: DataFrame, params: ContractParams = ContractParams(), symbols: DataFrame | None = None,
               failed: DataFrame | None = None, bottom: bool = False) -> DataFrame:
    """Normalised in-window calls of the provider chosen for each symbol.

    Over the near window, or over the year-long window read secondary first. The
    expiries kept are nearly as many as all listed, so they are not repeated for a
    salt: a key is one expiry of one symbol, and Spark splits one that is large.
    """
    days = params.bottom_max_dte if bottom else params.window_days
    most = params.bottom_max_expiries if bottom else params.max_expiries
    order = tuple(reversed(PROVIDERS)) if bottom else PROVIDERS
    listed = listings(chain)
    chosen = provider_outcomes(listed, days, order, failed, symbols).where("outcome = 'has_contracts'")
    mine = listed.where(Q.in_window(days)).join(chosen.select("symbol", "provider"), ["symbol", "provider"], "left_semi")
    calls = chain.where(Q.in_window(days) & Q.of_types(("call",)))
    kept = calls.join(sampled_expiries(mine, most), ["symbol", "provider", "dte"], "left_semi")
    return Q.call_greeks(Q.normalize_quotes(kept, params), params)


def _ranked(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    """Top rows per symbol; the limit also applies before the shuffle."""
    w = Window.partitionBy("symbol").orderBy(*order, F.desc("open_interest"), "ask", "contract_symbol")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def best_calls(rows: DataFrame, params: ContractParams = ContractParams()) -> DataFrame:
    """The one best call per symbol; the relaxed tier counts only without a strict one.

    Strict rows are a subset of relaxed ones, so ordering by tier is the fallback.
    """
    strict, relaxed = Q.tier_passes(params.strict), Q.tier_passes(params.relaxed)
    tiered = rows.withColumn("relaxed", ~strict).where(strict | relaxed)
    return _ranked(tiered, 1, F.col("relaxed")).drop("rank")


def cheap_calls(rows: DataFrame, contract_price: float | None = None,
                params: ContractParams = ContractParams()) -> DataFrame:
    cap = params.cheap_contract_price if contract_price is None else contract_price
    return _ranked(rows.where(Q.cheap_call(cap)), params.top_n)


def bottom_calls(rows: DataFrame, params: ContractParams = ContractParams()) -> DataFrame:
    picked = _ranked(rows.where(Q.bottom_call(params)), params.bottom_per_symbol)
    return picked.withColumn("moneyness", Q.moneyness(params.bottom_atm))


SORT_KEYS: dict[str, Callable[[], Column]] = {
    "bid": lambda: F.col("bid"), "ask": lambda: F.col("ask"), "volume": lambda: F.col("volume"),
    "open_interest": lambda: F.col("open_interest"), "iv": lambda: F.col("iv"),
    "delta": lambda: F.abs("delta"), "theta": lambda: F.abs("theta"),
    "spread_pct": lambda: F.coalesce("spread_pct", F.lit(0.0)),
}


def screen(chain: DataFrame, params: ScreenParams = ScreenParams()) -> DataFrame:
    """All contracts passing every threshold. No shuffle: rows are judged alone.

    Stored columns are cut first, so those conditions reach the scan, and Greeks
    are computed only for rows that pass the quote conditions.
    """
    stored = chain.where(Q.of_types(params.option_types) & F.col("dte").between(params.min_dte, params.max_dte)
                         & (F.col("spot") > 0))
    quoted = Q.screener_numbers(stored).where(Q.screener_quote_part(params))
    return Q.screener_greeks(quoted, params).where(Q.screener_greek_part(params))


def top_contracts(screened: DataFrame, sort_by: str = "volume", top: int = 25) -> DataFrame:
    return screened.orderBy(SORT_KEYS[sort_by]().desc(), "contract_symbol").limit(top)
