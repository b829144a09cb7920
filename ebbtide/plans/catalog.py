"""Every registered query: operator by operator, then the composite searches.

Each reads whole tables of the folder it is given. Doubles that come out of
exp, log, sqrt, averages or sums are rounded to six places; products and plain
differences are left as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.numeric import norm_cdf, norm_pdf
from ..functions.strings import clip_words, none_as_null, normal_symbol, price_text
from ..operators import alerts as A
from ..operators import performance as P
from ..operators import picks, quotes, reports, series, signals, universe
from ..operators.indicators import indicator_series
from ..operators.joins import asof, lookup, restrict
from ..operators.patterns import cluster_levels, scan_features
from ..operators.rebound import best_rebounds, dip_frame, rebound_stats
from ..params import (SCREEN_PRESETS, ContractParams, DigestParams, PerformanceParams, ScanParams, ScreenParams)
from ..session import scratch_path
from ..sources import proxies as X
from ..sources import readers, sinks
from . import jobs

NOW = "2001-07-31 00:00:00"
NOW_EPOCH = 1_005_000_000
PERF = PerformanceParams(benchmark="S0")
SCAN, CONTRACTS = ScanParams(), ContractParams()
TWO_OF_FOUR = ScanParams(signal_score=2)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        return fn
    return add


def day() -> Column:
    return F.col("ts").cast("date").alias("day")


def six(*names: str) -> list[Column]:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def ten(*names: str) -> list[Column]:
    """Means of short decimals: six places could fall on a half."""
    return [F.round(F.col(n), 10).alias(n) for n in names]


def long(value: Column | str, name: str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long").alias(name)


# ---- sources and sinks --------------------------------------------------------

@query("S1_S2_bars")
def _(spark, d):
    return readers.clean_bars(X.bars_daily(spark, d)).select(
        "symbol", day(), "open", "high", "low", "close", "volume")


@query("S1_read_bars")
def _(spark, d):
    """Two intervals in one folder, delivered twice; the second delivery corrects the first."""
    path, bars = scratch_path(spark, "bar-files"), X.bars(spark, d)
    daily = bars.withColumn("interval", F.lit("1d"))
    hourly = bars.select(*[c for c in bars.columns if c != "ts"], F.lit("1h").alias("interval"), (F.col("ts") + F.expr("interval 15 hours")).alias("ts"))
    daily.withColumn("close", F.col("close") + 1).unionByName(hourly).write.parquet(path)
    daily.write.mode("append").parquet(path)
    return readers.read_bars(spark, path, "1d", since="1995-01-01").select("symbol", day(), "open", "high", "low", "close", "volume")


@query("S3_latest_close")
def _(spark, d):
    return P.latest_prices(X.bars(spark, d))


def _directory_files(spark: SparkSession, d: str) -> DataFrame:
    """Write both exchange files in their pipe-delimited form, then read them back."""
    listed = X.directory(spark, d)
    frames = []
    for source, header in (("nasdaq", "Symbol"), ("other", "ACT Symbol")):
        path = scratch_path(spark, f"directory-{source}")
        listed.where(F.col("source") == source).select(
            F.col("symbol").alias(header), F.col("test_issue").alias("Test Issue"), F.col("etf").alias("ETF")
        ).write.option("header", True).option("sep", "|").csv(path)
        footer = spark.range(1).select(F.lit("File Creation Time: 1105200121:30||").alias("value"))
        footer.coalesce(1).write.mode("append").text(path)
        frames.append(readers.read_directory(spark, path, source))
    return frames[0].unionByName(frames[1])


@query("S4_S5_directory_files")
def _(spark, d):
    return _directory_files(spark, d)


@query("P1_U1_common_stocks")
def _(spark, d):
    """Two exchange lists that overlap, some symbols of which have a suffix."""
    listed = X.directory(spark, d).withColumn("symbol", F.when(
        F.endswith("symbol", F.lit("B")), F.concat("symbol", F.lit(".W"))).otherwise(F.col("symbol")))
    nasdaq = listed.where("source = 'nasdaq'")
    other = listed.where("source = 'other' or symbol like '%C'")
    return universe.union_distinct(universe.common_stocks(nasdaq), universe.common_stocks(other))


@query("P2_S5_all_listed")
def _(spark, d):
    listed = X.directory(spark, d).withColumn("symbol", F.when(
        F.col("etf") == "Y", F.concat("symbol", F.lit(".W"))).otherwise(F.col("symbol")))
    return universe.all_listed(listed)


def _constituents(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "supplier").selectExpr("concat('K', s_suppkey, '.', s_nationkey) as symbol")


@query("S6_index_members")
def _(spark, d):
    return universe.index_members(_constituents(spark, d))


def _ticker_file(spark: SparkSession, d: str) -> str:
    lines = X.table(spark, d, "supplier").selectExpr(
        "case when s_nationkey % 4 = 0 then concat('# s', s_suppkey) when s_nationkey % 4 = 1 then concat('  s', s_suppkey, ' ') "
        "when s_nationkey % 4 = 2 then concat(' #s', s_suppkey) else '   ' end as value")
    path = scratch_path(spark, "tickers")
    lines.write.text(path)
    return path


@query("S7_ticker_lines")
def _(spark, d):
    return readers.ticker_file(spark, _ticker_file(spark, d))


@query("S8_universe_forms")
def _(spark, d):
    """Each form in which a universe is asked for, on the same tables."""
    forms = {"index": "SP500", "all": " all ", "list": " s1, S3 ,s5,,S7", "file": _ticker_file(spark, d), "single": " s9 "}
    out = None
    for form, spec in forms.items():
        one = universe.resolve(spark, spec, _constituents(spark, d), X.directory(spark, d)).select(F.lit(form).alias("form"), "symbol")
        out = one if out is None else out.unionByName(one)
    return out


@query("S8_J1_universe_bars")
def _(spark, d):
    picked = universe.resolve(spark, " s1, S3 ,s5,,S7")
    kept = restrict(X.bars(spark, d), picked)
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("close").alias("top"))


@query("S9_U2_chain")
def _(spark, d):
    return X.chain(spark, d)


@query("S9_F5_read_chain")
def _(spark, d):
    """The chain as files, read back with an expiry window that reaches the scan."""
    path = scratch_path(spark, "chain-files")
    X.contracts(spark, d).select(
        "symbol", "contract_symbol", "option_type", "expiry", "strike", "bid", "ask", "last", F.col("volume").cast("double").alias("volume"),
        F.col("open_interest").cast("double").alias("open_interest"), "iv", "provider", F.lit(X.AS_OF).cast("timestamp").alias("as_of")
    ).write.parquet(path)
    return readers.read_chain(spark, path, X.AS_OF, 60).select(
        "symbol", "contract_symbol", "option_type", "expiry", "dte", "strike", "bid", "ask", "last", "volume", "open_interest", "iv", "provider")


def _nested_documents(spark: SparkSession, d: str) -> DataFrame:
    """One chain document per order and symbol, at most seven contracts each."""
    c = X.contracts(spark, d)
    name = F.concat(F.upper("symbol"), F.date_format("expiry", "yyMMdd"),
                    F.when(F.col("option_type") == "call", "C").otherwise("P"),
                    F.lpad(F.round(F.col("strike") * 1000).cast("long").cast("string"), 8, "0"))
    option = F.struct(name.alias("option"), "bid", "ask", F.col("last").alias("last_trade_price"),
                      F.col("open_interest").cast("double").alias("open_interest"),
                      F.col("volume").cast("double").alias("volume"), "iv")
    order = F.split_part("contract_symbol", F.lit("-"), F.lit(2))
    docs = c.groupBy("symbol", order.alias("order")).agg(F.collect_list(option).alias("options"))
    return docs.select("symbol", F.struct("options").alias("data"))


@query("S10_P5_nested_chain")
def _(spark, d):
    path = scratch_path(spark, "nested-chain")
    _nested_documents(spark, d).write.option("compression", "gzip").json(path)
    rows = readers.read_nested_chain(spark, path)
    return rows.groupBy("symbol", "expiry", "option_type", "strike").agg(
        F.count(F.lit(1)).alias("n"), long(F.sum("open_interest"), "oi"), long(F.sum("volume"), "volume"))


@query("S11_F14_headlines")
def _(spark, d):
    """News documents in both shapes, written as JSON and read back."""
    talk = X.table(spark, d, "conversations").where("role = 'assistant'")
    title = F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(" of "), F.col("conv_id").cast("string"))
    publisher = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("Desk "), (F.col("conv_id") % 5).cast("string")))
    nested = F.when(F.col("turn") % 4 == 1, F.struct(
        F.when(F.col("conv_id") % 7 != 0, title).alias("title"), F.struct(publisher.alias("displayName")).alias("provider")))
    item = F.struct(title.alias("title"), publisher.alias("publisher"), nested.alias("content"))
    docs = talk.select(F.concat(F.lit("S"), F.col("conv_id").cast("string")).alias("symbol"), F.array(item).alias("items"))
    path = scratch_path(spark, "news")
    docs.write.json(path)
    return readers.read_news(spark, path).where("body is not null").select("symbol", "kind", "body")


@query("S11_social_messages")
def _(spark, d):
    """Message documents with all items of a symbol, written as JSON and read back."""
    said = X.feed(spark, d).where("kind = 'social'")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "body")))
    docs = said.groupBy("symbol").agg(ordered.alias("said")).select(
        "symbol", F.transform("said", lambda m: F.struct(m["body"].alias("body"))).alias("messages"))
    path = scratch_path(spark, "social")
    docs.write.json(path)
    return readers.read_social(spark, path).select("symbol", "kind", "rank", F.md5("body").alias("body"))


@query("S12_csv_export")
def _(spark, d):
    path = scratch_path(spark, "matches")
    sinks.write_csv(picks.screen(X.contracts(spark, d), SCREEN_PRESETS["cli"]), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("ticker", "contract_symbol", "option_type", F.col("expiry").cast("date").alias("expiry"),
                       F.col("dte").cast("int").alias("dte"),
                       *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("strike", "spot", "spread_pct", "iv", "delta", "theta")],
                       *[F.round(F.col(c).cast("double"), 10).alias(c) for c in ("bid", "ask", "mid")],
                       F.col("volume").cast("long").alias("volume"), F.col("open_interest").cast("long").alias("open_interest"))


@query("S13_S14_F9_snapshots")
def _(spark, d):
    """Two versions of the qualified list; the newest is read, then judged for freshness."""
    liquid = signals.liquidity(X.bars(spark, d)).where("liquid").select("symbol")
    path = scratch_path(spark, "qualified")
    earlier = signals.liquidity(X.bars(spark, d).where("ts < '2001-06-01'")).where("liquid").select("symbol")
    sinks.write_snapshot(earlier, path, "2001-06-01 10:00:00")
    sinks.write_snapshot(liquid, path, "2001-11-02 21:00:00")
    newest = sinks.read_snapshot(spark, path)
    how, rows = universe.cached_universe(newest, lambda: liquid, "2001-11-03 12:00:00")
    fresh = universe.fresh_qualified(newest, "2001-11-05 20:00:00").agg(F.count(F.lit(1)).alias("k"))
    return rows.select("symbol", F.lit(how).alias("origin"), (fresh.scalar() > 0).alias("fresh_on_monday"))


def _qualified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stored list of liquid symbols, and every symbol there is."""
    path = scratch_path(spark, "qualified")
    sinks.write_snapshot(signals.liquidity(X.bars(spark, d)).where("liquid").select("symbol"), path, "2001-11-02 21:00:00")
    return sinks.read_snapshot(spark, path), X.bars(spark, d).select("symbol").distinct()


@query("S14_universe_branches")
def _(spark, d):
    """A young list is used, an old one rebuilt; where that fails the old one stays."""
    def fails():
        raise OSError("no directory")

    stored, everyone = _qualified(spark, d)
    out = None
    for rebuild, now in ((fails, "2001-11-03 12:00:00"), (lambda: everyone, "2001-11-04 12:00:00"), (fails, "2001-11-04 12:00:00")):
        origin, rows = universe.cached_universe(stored, rebuild, now)
        one = rows.select("symbol", F.lit(origin).alias("origin"))
        out = one if out is None else out.unionByName(one)
    return out


@query("T7_scan_list")
def _(spark, d):
    """Passes before and after a rebuild deadline: the stored list, then everything."""
    stored, everyone = _qualified(spark, d)
    out = None
    for label, now in (("before", "2001-11-02 21:20:00"), ("after", "2001-11-03 12:00:00")):
        full, rows = universe.scan_list(spark, stored, everyone, now)
        one = rows.select("symbol", F.lit(label).alias("pass"), F.lit(full).alias("is_full"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- windows over the daily bars ----------------------------------------------

def _indicator(name: str, only: tuple[str, ...], columns: Callable[[], list]):
    @query(name)
    def _(spark, d):
        return indicator_series(X.bars(spark, d), only=only).select("symbol", day(), *columns())


_indicator("W1_bollinger", ("bollinger",), lambda: six("bb_lower", "bb_mid", "bb_upper"))
_indicator("W2_gain_loss", ("gain_loss",), lambda: [(F.col(c) + 0.0).alias(c) for c in ("delta", "gain", "loss")])
_indicator("W3_rsi", ("rsi",), lambda: six("rsi"))
_indicator("W4_rolling_extremes", ("extremes",), lambda: ["roll_low", "roll_high"])
_indicator("W5_sma50", ("sma",), lambda: six("sma50"))
_indicator("W6_change20", ("change",), lambda: six("change_20"))
_indicator("W7_best_ahead", ("ahead",), lambda: ["best_ahead"])
_indicator("W8_pivots", ("pivots",), lambda: ["pivot_low", "pivot_high"])
_indicator("W10_positions", (), lambda: [long("pos", "pos"), long("n_bars", "n_bars")])


@query("W9_last_bars")
def _(spark, d):
    return series.tail(series.with_positions(X.bars(spark, d)), SCAN.wedge_lookback).select(
        "symbol", day(), long("pos", "pos"))


@query("W11_chart_table")
def _(spark, d):
    return reports.chart_table(X.bars(spark, d)).select(
        "symbol", day(), "open", "high", "low", "close", "rsi_ref",
        *six("bb_lower", "bb_mid", "bb_upper", "rsi"), *ten("support_level"))


# ---- scan ----------------------------------------------------------------------

@query("A1_P3_liquidity")
def _(spark, d):
    return signals.liquidity(X.bars(spark, d)).select("symbol", "last_close", *six("avg_volume"), "liquid")


@query("A3_support_levels")
def _(spark, d):
    f = scan_features(X.bars(spark, d))
    levels = F.explode(cluster_levels(F.col("support_lows"), SCAN.support_cluster, SCAN.support_touches))
    return f.select("symbol", levels.alias("level")).select("symbol", *ten("level"))


@query("A4_trend_lines")
def _(spark, d):
    return scan_features(X.bars(spark, d)).select(
        "symbol", long("high_pivots", "hn"), long("low_pivots", "ln"),
        *[F.round(F.col(c), 6).alias(a) for c, a in (("high_slope", "hs"), ("high_intercept", "hi"),
                                                     ("low_slope", "ls"), ("low_intercept", "li"))])


@query("P13_P14_P15_P16_filters")
def _(spark, d):
    s = signals.score(scan_features(X.bars(spark, d)))
    return s.select("symbol", *[F.array_contains("matched", k).alias("rsi_hit" if k == "rsi" else k) for k in signals.FILTERS],
                    "wedge_state", *six("rsi", "bb_lower"), *ten("support_level"))


@query("P17_scores")
def _(spark, d):
    s = signals.score(scan_features(X.bars(spark, d)))
    return s.select("symbol", F.col("bar_ts").cast("date").alias("day"), "price", "score", "signature", "liquid")


@query("X1_filter_reasons")
def _(spark, d):
    s = signals.score(scan_features(X.bars(spark, d)))
    return s.select("symbol", *[F.col("reasons")[k].alias(k) for k in signals.FILTERS])


@query("X1_python_filter")
def _(spark, d):
    """A reader's own filter: the last close is under the mean of the last 30; odd lengths raise."""
    def below_mean(frame):
        if len(frame) < 30 or int(frame["n_bars"].iloc[-1]) % 2:
            raise ValueError("odd")
        return frame["close"].iloc[-1] * 30 < frame["close"].sum(), "below"

    bars = X.bars(spark, d)
    wide, entry = signals.with_python_filter(scan_features(bars), bars, "mean30", below_mean, 30)
    s = signals.score(wide, SCAN, {**signals.FILTERS, "mean30": entry})
    return s.select("symbol", "score", F.array_contains("matched", "mean30").alias("mean30"),
                    F.col("reasons")["mean30"].alias("reason"))


@query("K1_signals_by_score")
def _(spark, d):
    return signals.signals(signals.scan(X.bars(spark, d)), TWO_OF_FOUR).select(
        "symbol", "price", "score", "signature")


@query("A2_scan_stats")
def _(spark, d):
    bars = X.bars(spark, d)
    asked = X.table(spark, d, "supplier").selectExpr("concat('S', s_suppkey) as symbol").unionByName(
        X.table(spark, d, "nation").selectExpr("concat('N', n_nationkey) as symbol"))
    failed = X.table(spark, d, "nation").where("n_regionkey = 1").selectExpr("concat('N', n_nationkey) as symbol")
    stats = signals.scan_stats(asked, signals.score(scan_features(bars)), SCAN, failed)
    return stats.withColumn("data_ratio", F.round("data_ratio", 6))


@query("U3_K7_hot_list")
def _(spark, d):
    bars = X.bars(spark, d)
    scored = signals.scan(bars)
    before = X.table(spark, d, "supplier").where("s_nationkey = 3").selectExpr("concat('S', s_suppkey) as symbol")
    return signals.hot_lane(signals.hot_symbols(scored, SCAN, before), SCAN)


# ---- rebound --------------------------------------------------------------------

@query("P18_dip_zone")
def _(spark, d):
    return dip_frame(X.bars(spark, d)).select("symbol", day(), "dip", *six("gain"))


@query("A5_A6_P19_rebound_stats")
def _(spark, d):
    return rebound_stats(X.bars(spark, d)).select(
        "symbol", "price", long("n_bars", "n_bars"), "dip", long("episodes", "episodes"),
        long("rebounds", "rebounds"), "declining_now", "qualifies",
        *six("change_20d", "rsi14", "above_52w_low", "off_52w_high", "avg_gain", "rebound_rate", "score"))


@query("K5_best_rebounds")
def _(spark, d):
    return best_rebounds(rebound_stats(X.bars(spark, d)), CONTRACTS.bottom_symbols).select("symbol", *six("score"))


# ---- contracts --------------------------------------------------------------------

@query("P4_F4_quotes")
def _(spark, d):
    return quotes.normalize_quotes(X.contracts(spark, d)).select(
        "contract_symbol", "estimated", "bid", "ask", "premium", *six("spread_pct"), "breakeven", "contract_cost")


@query("P6_P8_F5_window")
def _(spark, d):
    c = X.contracts(spark, d).drop("dte")
    near = quotes.with_days(quotes.expiry_window(c, X.AS_OF, CONTRACTS.window_days), F.lit(X.AS_OF).cast("date"))
    return near.where(quotes.of_types(("put",))).groupBy("symbol", "dte").agg(F.count(F.lit(1)).alias("n"))


@query("J2_chain_with_spot")
def _(spark, d):
    bars = X.bars(spark, d)
    bare = X.contracts(spark, d).drop("spot")
    return lookup(bare, X.spot(bars), ["symbol"], "contract_symbol").where("spot > 0").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.max("spot").alias("spot"), F.count_if(F.col("strike") < F.col("spot")).alias("itm"))


@query("F1_screener_greeks")
def _(spark, d):
    g = quotes.screener_greeks(quotes.screener_numbers(X.contracts(spark, d)))
    return g.select("contract_symbol", *six("delta", "theta", "theta_pct"))


@query("F1_greeks_with_dividend")
def _(spark, d):
    g = quotes.screener_greeks(quotes.screener_numbers(X.contracts(spark, d)), ScreenParams(dividend_yield=0.02))
    return g.select("contract_symbol", *six("delta", "theta"))


@query("F2_call_greeks")
def _(spark, d):
    return quotes.call_greeks(quotes.normalize_quotes(X.contracts(spark, d))).select("contract_symbol", *six("delta", "theta"))


@query("F3_normal_law")
def _(spark, d):
    x = (F.col("l_extendedprice") - 50000.0) / 6000.0
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")).select(
        "l_orderkey", "l_linenumber", F.round(norm_cdf(F.col("x")), 9).alias("cdf"), F.round(norm_pdf(F.col("x")), 9).alias("pdf"))


@query("F17_missing_numbers")
def _(spark, d):
    c = X.contracts(spark, d).withColumn("iv", F.when(F.col("dte") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("iv")))
    return quotes.screener_numbers(c).select("contract_symbol", "iv", "volume", "open_interest", *six("mid", "spread_pct"))


def _screen(name: str, preset: str):
    @query(name)
    def _(spark, d):
        return picks.screen(X.contracts(spark, d), SCREEN_PRESETS[preset]).select(
            "symbol", "contract_symbol", "dte", "strike", "bid", "ask", *six("delta", "theta"))


_screen("P7_screen_library", "library")
_screen("P7_screen_cli", "cli")


@query("P7_screen_no_theta_calls")
def _(spark, d):
    params = ScreenParams(option_types=("call",), max_theta_pct=None, positive_bid=False)
    return picks.screen(X.contracts(spark, d), params).select("contract_symbol", *six("delta"))


@query("K6_X2_top_contracts")
def _(spark, d):
    """The top list under each sort key."""
    passed = picks.screen(X.contracts(spark, d), SCREEN_PRESETS["library"])
    out = None
    for key in picks.SORT_KEYS:
        one = picks.top_contracts(passed, key, 25).select(F.lit(key).alias("sort_key"), "contract_symbol")
        out = one if out is None else out.unionByName(one)
    return out


@query("K9_S8_capped_universe")
def _(spark, d):
    names = X.bars(spark, d).select(normal_symbol("symbol").alias("symbol")).distinct()
    few = universe.capped(names, 7)
    return restrict(X.contracts(spark, d), few, "contract_symbol").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("P9_call_tiers")
def _(spark, d):
    calls = X.contracts(spark, d).where(quotes.of_types(("call",)))
    q = quotes.call_greeks(quotes.normalize_quotes(calls))
    flagged = q.select("contract_symbol", quotes.tier_passes(CONTRACTS.strict).alias("is_strict"),
                       quotes.tier_passes(CONTRACTS.relaxed).alias("is_relaxed"))
    return flagged


@query("P10_P11_P12_call_predicates")
def _(spark, d):
    q = quotes.normalize_quotes(X.contracts(spark, d).where(quotes.of_types(("call",))))
    return q.select("contract_symbol", quotes.bottom_call().alias("bottom"), quotes.cheap_call(50.0).alias("cheap"),
                    quotes.moneyness(CONTRACTS.bottom_atm).alias("moneyness"))


@query("J5_provider_outcomes")
def _(spark, d):
    """Choice and outcome per symbol for a tight and the usual window, with some providers down."""
    listed = picks.listings(X.contracts(spark, d))
    down = X.table(spark, d, "supplier").selectExpr(
        "concat('S', s_suppkey) as symbol",
        "explode(case when s_acctbal < 0 then array('primary', 'secondary') when s_acctbal < 2000 then array('primary') "
        "else cast(array() as array<string>) end) as provider")
    tight = picks.provider_outcomes(listed, 1, ("secondary", "primary"), down).withColumn("window", F.lit(1))
    usual = picks.provider_outcomes(listed, 91, failed=down).withColumn("window", F.lit(91))
    return tight.unionByName(usual)


@query("K8_sampled_expiries")
def _(spark, d):
    near = picks.listings(X.contracts(spark, d)).where(quotes.in_window(CONTRACTS.window_days))
    return picks.sampled_expiries(near, CONTRACTS.max_expiries).select("symbol", "provider", "dte")


@query("K2_best_call_any_source")
def _(spark, d):
    q = quotes.call_greeks(quotes.normalize_quotes(X.contracts(spark, d).where(quotes.of_types(("call",)))))
    return picks.best_calls(q).select("symbol", "contract_symbol", "relaxed", "premium", *six("delta"))


@query("K2_best_call")
def _(spark, d):
    return picks.best_calls(picks.near_calls(X.contracts(spark, d))).select(
        "symbol", "contract_symbol", "provider", "relaxed", "premium", "breakeven", *six("delta", "theta"))


@query("K3_cheap_calls")
def _(spark, d):
    return jobs.cheap_contracts(X.bars(spark, d), X.contracts(spark, d)).select("symbol", "contract_symbol", "rank", "premium")


@query("K4_bottom_calls")
def _(spark, d):
    return picks.bottom_calls(picks.near_calls(X.contracts(spark, d), bottom=True)).select(
        "symbol", "contract_symbol", "rank", "premium", "moneyness")


# ---- calendar -----------------------------------------------------------------------

@query("F6_calendar")
def _(spark, d):
    shifts = F.explode(F.array(F.lit(0), F.lit(9131))).alias("shift")
    dates = X.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), shifts)
    days = dates.select(F.date_add("day", F.col("shift")).alias("day")).distinct()
    return days.select("day", D.is_weekend(F.col("day")).alias("is_weekend"), D.holiday(F.col("day")).alias("holiday"),
                       D.is_trading_day(F.col("day")).alias("is_trading_day"))


def _moments(spark: SparkSession, d: str) -> DataFrame:
    """Points in time through the year: order dates shifted by a time of day, and event times."""
    orders = X.table(spark, d, "orders").select(F.timestamp_seconds(
        F.unix_seconds("o_orderdate") + (F.col("o_orderkey") * 37) % 86400).alias("ts"))
    return orders.unionByName(X.table(spark, d, "events").select("ts"))


@query("F7_F8_T6_session")
def _(spark, d):
    m = _moments(spark, d)
    local = D.exchange_time(F.col("ts"))
    flags = m.select(F.to_date(local).alias("day"), D.regular_session(F.col("ts")).alias("r"),
                     D.market_open_status(F.col("ts")).alias("o"), D.scan_paused(F.col("ts")).alias("p"),
                     D.scan_paused(F.col("ts"), regular_only=False).alias("q"))
    return flags.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if("r").alias("regular"),
                                    F.count_if("o").alias("status_open"), F.count_if("p").alias("paused"),
                                    F.count_if("q").alias("paused_days_only"))


@query("F9_rebuild_deadline")
def _(spark, d):
    m = _moments(spark, d).select("ts", D.last_deadline(F.col("ts")).alias("deadline"))
    return m.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"),
                    F.date_format("deadline", "yyyy-MM-dd HH:mm:ss").alias("deadline")).distinct()


# ---- alerts, subscribers ---------------------------------------------------------------

def _events(spark: SparkSession, d: str) -> DataFrame:
    return X.alerts(spark, d).withColumnRenamed("alert_ts", "ts")


@query("T2_alert_memory")
def _(spark, d):
    return A.alert_memory(_events(spark, d)).select("symbol", day(), "alert_id", "signature", "changed")


@query("J4_fresh_against_memory")
def _(spark, d):
    memory = A.memory_after(A.alert_memory(_events(spark, d).where(F.col("ts") <= NOW)), NOW, 48)
    later = _events(spark, d).where(F.col("ts") > NOW)
    return A.fresh_against(later, memory).select("symbol", "alert_id", "signature")


def _people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = X.table(spark, d, "customer")
    subscribers = c.selectExpr("c_custkey as chat_id")
    accepted = c.where("c_nationkey % 4 <> 0").selectExpr("c_custkey as chat_id")
    approved = c.where("c_mktsegment <> 'BUILDING'").selectExpr(
        "c_custkey as chat_id",
        "case when c_mktsegment = 'MACHINERY' then 0L else cast(1000000000 + floor(c_acctbal) * 1000 as bigint) end as expiry")
    return subscribers, accepted, approved


@query("P20_A10_eligible")
def _(spark, d):
    subscribers, accepted, approved = _people(spark, d)
    return A.eligible(subscribers, accepted, approved, NOW_EPOCH, admin=7)


@query("A10_subscription_list")
def _(spark, d):
    _, accepted, approved = _people(spark, d)
    return A.subscription_list(approved, accepted, NOW_EPOCH)


@query("T8_lapsed_subscriptions")
def _(spark, d):
    subscribers, _, approved = _people(spark, d)
    remaining, notices = A.lapsed(subscribers, approved, NOW_EPOCH)
    return remaining.select("chat_id", F.lit("stays").alias("state")).unionByName(
        notices.select("chat_id", F.lit("notified").alias("state")))


@query("J8_delivery_counts")
def _(spark, d):
    subscribers, accepted, approved = _people(spark, d)
    readers_ = A.eligible(subscribers, accepted, approved, NOW_EPOCH)
    return A.delivery_counts(A.alert_memory(_events(spark, d)).select("alert_id"), readers_)


@query("A11_status")
def _(spark, d):
    bars = X.bars(spark, d)
    subscribers, _, _ = _people(spark, d)
    return reports.status(signals.liquidity(bars).where("liquid"), signals.hot_symbols(signals.scan(bars)),
                          A.memory_after(A.alert_memory(_events(spark, d)), "2001-08-01 00:00:00"), subscribers)


# ---- performance ------------------------------------------------------------------------

def _settled(spark: SparkSession, d: str) -> DataFrame:
    bars = X.bars(spark, d)
    tracked = P.track(X.alerts(spark, d), bars, PERF)
    return P.settle(P.horizon_checks(tracked, PERF), bars, NOW, PERF)


@query("J6_alert_benchmark_price")
def _(spark, d):
    bench = X.bars(spark, d).where("symbol = 'S0'").select(F.lit("S0").alias("bench"), "ts", "close")
    rows = asof(X.alerts(spark, d).withColumn("bench", F.lit("S0")), bench, "close", "bench_price", "alert_ts", keys=("bench",))
    return rows.select("alert_id", "bench_price")


@query("F16_check_map")
def _(spark, d):
    bars = X.bars(spark, d)
    checks = P.horizon_checks(P.track(X.alerts(spark, d), bars, PERF), PERF)
    stamp = lambda h: F.date_format(F.col("checks")[h]["due_ts"], "yyyy-MM-dd HH:mm")
    return P.check_map(checks).select("alert_id", stamp("24").alias("due_24"), stamp("72").alias("due_72"))


@query("J7_T5_settled_checks")
def _(spark, d):
    return _settled(spark, d).select("alert_id", "symbol", "horizon_h", "status", "attempts", "alert_price",
                                     "bench_price", "price_now", "bench_now", *six("alpha"))


@query("A7_performance_fold")
def _(spark, d):
    return P.fold(_settled(spark, d)).select("horizon_h", "n", "wins", *six("sum_alpha"))


@query("A8_Q5_performance_report")
def _(spark, d):
    return jobs.performance(X.alerts(spark, d), X.bars(spark, d), NOW, PERF).select(
        "horizon_h", "n", "wins", *six("win_rate", "mean_alpha"), "line")


@query("A8_report_text")
def _(spark, d):
    return P.report_text(_settled(spark, d))


@query("A8_compact_line")
def _(spark, d):
    return P.compact_line(P.fold(_settled(spark, d)), PERF)


# ---- texts --------------------------------------------------------------------------------

@query("F10_price_text")
def _(spark, d):
    scale = F.pow(F.lit(10.0), F.col("l_linenumber") - 1.0)
    c = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / scale).alias("p"))
    return c.select("l_orderkey", "l_linenumber", price_text(F.col("p")).alias("text"))


@query("F11_alert_texts")
def _(spark, d):
    s = signals.score(scan_features(X.bars(spark, d)))
    return s.select("symbol", reports.alert_text(reports.match_text(), "2001-11-05 15:05:00").alias("text"))


@query("F11_best_call_text")
def _(spark, d):
    best = picks.best_calls(picks.near_calls(X.contracts(spark, d)))
    return best.select("symbol", reports.best_call_text().alias("text"))


@query("F11_cheap_blocks")
def _(spark, d):
    return reports.cheap_blocks(jobs.cheap_contracts(X.bars(spark, d), X.contracts(spark, d)))


@query("F11_bottom_blocks")
def _(spark, d):
    return reports.bottom_blocks(jobs.bottom_rebounds(X.bars(spark, d), X.contracts(spark, d))).select("symbol", "text")


@query("F13_clipped_summaries")
def _(spark, d):
    texts = X.table(spark, d, "documents").select("doc_id", F.when(
        F.col("doc_id") % 50 == 0, F.lit("  none\n")).otherwise(F.col("text")).alias("text"))
    return texts.select("doc_id", F.md5(clip_words(none_as_null(F.col("text")), 500)).alias("digest"))


@query("K10_first_items")
def _(spark, d):
    few = DigestParams(headlines=2, messages=3)
    return reports.first_items(X.feed(spark, d), few).select("symbol", "kind", "rank")


@query("F15_source_digest")
def _(spark, d):
    g = reports.source_digest(X.feed(spark, d))
    return g.select("symbol", F.md5("headlines").alias("headlines"), F.md5("social").alias("social"))


# ---- composite searches ----------------------------------------------------------------------

@query("Q1_reversal_scan")
def _(spark, d):
    bars = X.bars(spark, d)
    found = jobs.reversal_scan(bars, X.contracts(spark, d), scan=ScanParams(signal_score=1))
    return found.select("symbol", "price", "score", "signature", "contract_symbol", "relaxed")


@query("Q2_check_symbol")
def _(spark, d):
    bars = X.bars(spark, d)
    return jobs.check_symbol(bars, X.contracts(spark, d), " s7 ").select(
        "symbol", "price", "score", "signature", "liquid", "contract_symbol", "premium")


@query("Q2_W11_symbol_chart")
def _(spark, d):
    return jobs.symbol_chart(X.bars(spark, d), " s7 ").select("symbol", day(), "close", "rsi_ref", *six("bb_lower", "rsi"), *ten("support_level"))


@query("Q4_J9_bottom_rebounds")
def _(spark, d):
    bars = X.bars(spark, d)
    return jobs.bottom_rebounds(bars, X.contracts(spark, d)).select(
        "symbol", "price", long("episodes", "episodes"), long("rebounds", "rebounds"), *six("score"), "contract_symbol", "rank", "premium", "moneyness")


@query("Q6_options_screener")
def _(spark, d):
    return jobs.options_screener(X.contracts(spark, d), "cli", sort_by="open_interest").select(
        "symbol", "contract_symbol", "open_interest", *six("delta", "theta"))


@query("Q7_J10_active_signals")
def _(spark, d):
    bars = X.bars(spark, d)
    memory = X.table(spark, d, "supplier").where("s_nationkey % 2 = 0").selectExpr("concat('S', s_suppkey) as symbol")
    return jobs.active_signals(bars, X.contracts(spark, d), memory, ScanParams(signal_score=1)).select(
        "symbol", "score", "signature", "contract_symbol")


@query("T10_hourly_bars")
def _(spark, d):
    from ..streaming.ticks import to_bars

    return to_bars(X.ticks(spark, d)).select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("hour"), "open", "high", "low", "close", "volume")


# ---- streams over the same tables, run to their end ----------------------------------------------

def _stream(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    table = X.stored(spark, d, name, make)
    return spark.readStream.schema(table.schema).parquet(X.stored_path(spark, d, name))


def _in_batches(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The same in micro-batches in order of time: each takes the files of one slice."""
    path = X.stored_slices(spark, d, name, make)
    return spark.readStream.schema(spark.read.parquet(f"{path}/*").schema).option("maxFilesPerTrigger", X.SLICE_FILES).parquet(f"{path}/*")


@query("T10_bar_stream")
def _(spark, d):
    """Bars as they close, and at the end of the run those still open, from the state."""
    from ..streaming.ticks import bar_stream, open_bars

    out, state = scratch_path(spark, "bar-stream"), scratch_path(spark, "ckpt")
    bar_stream(_in_batches(spark, d, "ticks", lambda: X.stored(spark, d, "ticks", lambda: X.ticks(spark, d))), out, state).awaitTermination()
    return spark.read.parquet(out).unionByName(open_bars(spark, state)).select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("hour"), "open", "high", "low", "close", "volume")


@query("T2_T3_alert_stream")
def _(spark, d):
    """Signals of symbols without a best call are held back before the memory."""
    from ..streaming.alerts import alert_stream

    gated = lambda: A.with_contract(
        _events(spark, d), picks.best_calls(picks.near_calls(X.contracts(spark, d))).select("symbol"))
    out = scratch_path(spark, "alert-stream")
    alert_stream(_in_batches(spark, d, "gated_alerts", lambda: X.stored(spark, d, "gated_alerts", gated)), out, scratch_path(spark, "memory"),
                 scratch_path(spark, "ckpt")).awaitTermination()
    return spark.read.parquet(out).select("symbol", day(), "alert_id", "signature")


@query("T1_T6_scan_stream")
def _(spark, d):
    """The newest scan of every symbol, after all micro-batches."""
    from ..params import SessionParams
    from ..streaming.scan import scan_stream

    out, bars = scratch_path(spark, "scan-stream"), X.bars(spark, d)
    scan_stream(_in_batches(spark, d, "bars", lambda: bars), out, scratch_path(spark, "hot"), scratch_path(spark, "ckpt"),
                SessionParams(regular_hours_only=False), ScanParams(signal_score=1)).awaitTermination()
    last = bars.groupBy("symbol").agg(F.max("ts").alias("bar_ts"))
    return spark.read.parquet(out).join(last, ["symbol", "bar_ts"]).select("symbol", F.col("bar_ts").cast("date").alias("day"), "price", "score", "signature")


@query("T4_hot_lane")
def _(spark, d):
    """New bars beside the state of a scan that ended in 1996; only symbols of the newest hot list are scored again."""
    from ..params import SessionParams
    from ..streaming.scan import hot_lane_stream, scan_stream
    from ..streaming.steps import write_version

    bars, params = X.bars(spark, d), ScanParams(signal_score=1, hot_score=1)
    session = SessionParams(daily_bars=True, pause_weekends_and_holidays=False)
    state, hot, seen, out = (scratch_path(spark, name) for name in ("scan-state", "hot", "seen", "hot-signals"))
    scan_stream(_in_batches(spark, d, "bars-before-1997", lambda: bars.where("ts < '1997-01-01'")), seen, hot, state, session, params).awaitTermination()
    even = X.table(spark, d, "supplier").where("s_nationkey % 2 = 0").selectExpr("concat('S', s_suppkey) as symbol")
    write_version(signals.hot_symbols(signals.scan(bars, params), params).join(even, "symbol", "left_semi"), hot, 1_000_000)
    hot_lane_stream(_stream(spark, d, "bars-from-1997", lambda: bars.where("ts >= '1997-01-01'")), state, hot, out, scratch_path(spark, "ckpt"),
                    session, params, every=None).awaitTermination()
    return spark.read.parquet(out).select("symbol", F.col("bar_ts").cast("date").alias("day"), "score", "signature", "is_hot")


@query("T5_horizon_stream")
def _(spark, d):
    from ..streaming.horizon import horizon_stream

    bars = X.bars(spark, d)
    checks = P.horizon_checks(P.track(X.alerts(spark, d), bars, PERF), PERF)
    out = scratch_path(spark, "horizon-stream")
    horizon_stream(_in_batches(spark, d, "bars", lambda: bars), checks, scratch_path(spark, "prices"), out,
                   scratch_path(spark, "pending"), scratch_path(spark, "ckpt"), PERF).awaitTermination()
    return spark.read.parquet(out).select("alert_id", "horizon_h", "status", "attempts", *six("alpha"))
