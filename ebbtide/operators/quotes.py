"""Contract rows: quote normalisation, names, windows, predicates, derived numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import missing_as_zero, nan_as_null, round_cents, with_greeks
from ..params import CallTier, ContractParams, ScreenParams

# Fixed value: contract names are SYMBOL + yymmdd + C or P + strike in thousandths.
OCC_TAIL = r"^(\d{6})([CP])(\d{8})$"


def parse_contract_names(options: DataFrame, name: str = "option") -> DataFrame:
    """Split contract names into expiry, type and strike.

    Rows whose name does not start with their symbol, or whose date does not
    exist, are skipped.
    """
    symbol = F.upper("symbol")
    tail = F.substr(F.col(name), F.length(symbol) + 1)
    fits = F.startswith(F.col(name), symbol) & tail.rlike(OCC_TAIL)
    part = lambda i: F.regexp_extract(tail, OCC_TAIL, i)
    return (options.where(fits)
            .withColumn("expiry", F.try_to_timestamp(F.concat(F.lit("20"), part(1)), F.lit("yyyyMMdd")).cast("date"))
            .withColumn("option_type", F.when(part(2) == "C", "call").otherwise("put"))
            .withColumn("strike", part(3).cast("double") / 1000.0)
            .where("expiry is not null"))


def with_days(chain: DataFrame, as_of: Column) -> DataFrame:
    return chain.withColumn("dte", F.datediff("expiry", as_of))


def in_window(days: int) -> Column:
    return F.col("dte").between(0, days)


def expiry_window(chain: DataFrame, as_of: str, days: int) -> DataFrame:
    """Cut on the stored column, so that the predicate reaches the files."""
    first = F.lit(as_of).cast("date")
    return chain.where(F.col("expiry").between(first, F.date_add(first, days)))


def of_types(types: tuple[str, ...]) -> Column:
    return F.col("option_type").isin(*types)


def normalize_quotes(chain: DataFrame, params: ContractParams = ContractParams()) -> DataFrame:
    """Usable quotes only: the mid when there is a live quote, else the last price.

    Rows with too little activity or no price at all are dropped; a row priced
    from its last trade is marked `estimated` and has no spread.
    """
    clean = chain.withColumns({
        "open_interest": missing_as_zero("open_interest").cast("long"),
        "volume": missing_as_zero("volume").cast("long"),
        "bid": missing_as_zero("bid"), "ask": missing_as_zero("ask"),
        "last": missing_as_zero("last"), "iv": nan_as_null("iv")})
    clean = clean.where(F.col("open_interest") + F.col("volume") >= params.min_activity)
    live = (F.col("bid") > 0) & (F.col("ask") >= F.col("bid"))
    priced = clean.withColumn("estimated", ~live).where(~F.col("estimated") | (F.col("last") > 0))
    mid = (F.col("bid") + F.col("ask")) / 2.0
    quoted = priced.withColumns({
        "premium": round_cents(F.when(F.col("estimated"), F.col("last")).otherwise(mid)),
        "spread_pct": F.when(~F.col("estimated"), (F.col("ask") - F.col("bid")) / mid),
        "bid": F.when(F.col("estimated"), F.col("last")).otherwise(F.col("bid")),
        "ask": F.when(F.col("estimated"), F.col("last")).otherwise(F.col("ask"))})
    return quoted.withColumns({
        "breakeven": F.when(F.col("ask") > 0, round_cents(F.col("strike") + F.col("ask"))),
        "contract_cost": F.col("premium") * 100.0})


def call_greeks(candidates: DataFrame, params: ContractParams = ContractParams()) -> DataFrame:
    """Best-call form: no dividend, null when days or volatility are missing."""
    return with_greeks(candidates, F.col("dte") / 365.0, F.col("iv"), params.rate)


def tier_passes(tier: CallTier) -> Column:
    """All conditions of one tier; any missing number rejects. Upper caps are strict."""
    return F.coalesce(
        F.abs("delta").between(tier.delta_min, tier.delta_max)
        & F.col("dte").between(tier.dte_min, tier.dte_max)
        & (F.col("volume") >= tier.volume_min) & (F.col("open_interest") >= tier.oi_min)
        & (F.col("iv") < tier.iv_below) & (F.col("spread_pct") < tier.spread_below), F.lit(False))


def bottom_call(params: ContractParams = ContractParams()) -> Column:
    return (F.col("dte").between(params.bottom_min_dte, params.bottom_max_dte)
            & (F.col("premium") <= params.bottom_max_premium)
            & (F.col("strike") <= F.col("spot") * (1.0 + params.bottom_atm)))


def cheap_call(contract_price: float) -> Column:
    return F.col("premium") <= contract_price / 100.0


def moneyness(tolerance: float) -> Column:
    return F.when(F.col("strike") <= F.col("spot") * (1.0 - tolerance), "ITM").otherwise("ATM")


def screener_numbers(chain: DataFrame) -> DataFrame:
    """Missing numbers as 0, then mid and relative spread (null without a mid)."""
    clean = chain.withColumns({
        "bid": missing_as_zero("bid"), "ask": missing_as_zero("ask"), "iv": missing_as_zero("iv"),
        "strike": missing_as_zero("strike"), "volume": missing_as_zero("volume").cast("long"),
        "open_interest": missing_as_zero("open_interest").cast("long")})
    mid = (F.col("bid") + F.col("ask")) / 2.0
    return clean.withColumn("mid", mid).withColumn(
        "spread_pct", F.when(F.col("mid") > 0, (F.col("ask") - F.col("bid")) / F.col("mid")))


def screener_greeks(chain: DataFrame, params: ScreenParams = ScreenParams()) -> DataFrame:
    """Screener form: at least one day to expiry, zeros for unusable inputs."""
    years = F.greatest(F.col("dte"), F.lit(1)) / 365.0
    greeks = with_greeks(chain, years, F.col("iv"), params.rate, params.dividend_yield, invalid=0.0)
    return greeks.withColumn("theta_pct", F.when(F.col("mid") > 0, F.abs("theta") / F.col("mid")))


def screener_quote_part(p: ScreenParams) -> Column:
    """The conditions that need no Greeks; tested first."""
    bid_ok = F.col("bid") > 0 if p.positive_bid else F.lit(True)
    return (bid_ok & F.col("dte").between(p.min_dte, p.max_dte) & (F.col("volume") >= p.min_volume)
            & (F.col("open_interest") >= p.min_open_interest)
            & F.coalesce(F.col("spread_pct") <= p.max_spread_pct, F.lit(False))
            & F.col("iv").between(p.iv_min, p.iv_max))


def screener_greek_part(p: ScreenParams) -> Column:
    delta_ok = F.abs("delta").between(p.delta_min, p.delta_max)
    if p.max_theta_pct is None:
        return delta_ok
    return delta_ok & F.coalesce(F.col("theta_pct") <= p.max_theta_pct, F.lit(False))
