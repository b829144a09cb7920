"""Texts as columns: alerts, contract lines, search results, source digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions.strings import clip_words, none_as_null, percent_text, plain_number, price_text
from ..params import ContractParams, DigestParams, ReboundParams, ScanParams
from .signals import FILTERS, ScanFilter


def _money(value: Column) -> Column:
    return F.concat(plain_number(value, 2), F.lit("$"))


def _optional(*parts: Column) -> Column:
    """Concatenation that is empty as soon as one part is null."""
    return F.coalesce(F.concat(*parts), F.lit(""))


def greek_suffix() -> Column:
    bits = F.array_compact(F.array(
        F.concat(F.lit("IV="), plain_number(F.col("iv") * 100.0, 0), F.lit("%")),
        F.concat(F.lit(T.DELTA), plain_number(F.col("delta"), 2)),
        F.concat(F.lit(T.THETA), plain_number(F.col("theta"), 3), F.lit(T.THETA_UNIT))))
    return F.when(F.size(bits) > 0, F.concat(F.lit(" • "), F.array_join(bits, " • "))).otherwise("")


def contract_body() -> Column:
    """Strike, expiry, days, premium and cost of one contract, with its Greeks."""
    about = F.when(F.col("estimated"), "≈").otherwise("")
    return F.concat(
        F.lit(T.STRIKE), _money(F.col("strike")), F.lit(T.EXPIRES), F.date_format("expiry", "yyyy-MM-dd"),
        F.lit(" ("), F.col("dte").cast("string"), F.lit(T.DAYS + ")"), F.lit(T.PREMIUM), about,
        _money(F.col("premium")), F.lit(" = "), about, plain_number(F.col("premium") * 100.0, 0),
        F.lit(T.PER_CONTRACT), greek_suffix())


def best_call_text() -> Column:
    return F.array_join(F.array_compact(F.array(
        F.lit(T.BEST_CALL_TITLE), F.concat(F.lit("    "), contract_body()),
        F.concat(F.lit(T.BREAKEVEN_LINE), _money(F.col("breakeven"))),
        F.when(F.col("estimated"), T.ESTIMATED_NOTE), F.when(F.col("relaxed"), T.RELAXED_NOTE))), "\n")


def listing_line(tag: Column | None = None) -> Column:
    lead = F.lit("    ") if tag is None else F.concat(F.lit("    🟢 CALL "), tag, F.lit(" • "))
    return F.concat(lead, contract_body(), _optional(F.lit(T.BREAKEVEN_TAIL), _money(F.col("breakeven"))))


def cheap_blocks(picks: DataFrame) -> DataFrame:
    """One block per symbol: its price, then its contracts in rank order (at most top-n)."""
    lines = picks.select("symbol", "spot", "rank", listing_line().alias("line"))
    per = lines.groupBy("symbol").agg(F.max("spot").alias("spot"), _in_rank_order("line").alias("lines"))
    head = F.concat(F.lit("*"), F.col("symbol"), F.lit("* — "), price_text(F.col("spot")))
    return per.select("symbol", F.array_join(F.concat(F.array(head), F.col("lines")), "\n").alias("text"))


def _in_rank_order(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", column))), lambda e: e[column])


def bottom_blocks(stats_with_picks: DataFrame, rebound: ReboundParams = ReboundParams()) -> DataFrame:
    """One block per symbol: dip, history, contracts. Input: one row per picked contract."""
    trend = F.when(F.col("change_20d") < 0, F.concat(
        F.lit(T.DECLINE), percent_text(F.abs("change_20d"), 1), F.lit(T.IN_SESSIONS))).otherwise(T.BELOW_AVERAGE)
    head = F.array(
        F.concat(F.lit("*"), F.col("symbol"), F.lit("* — "), price_text(F.col("price")), F.lit(" 📉")),
        F.concat(F.lit("    "), trend, F.lit(" • RSI="), plain_number(F.col("rsi14"), 0), F.lit(T.ABOVE_LOW),
                 percent_text(F.col("above_52w_low"), 1), F.lit(T.BELOW_HIGH), percent_text(F.col("off_52w_high"), 1)),
        F.concat(F.lit(f"{T.HISTORY}{rebound.min_gain:.0%}{T.WITHIN}{rebound.horizon}{T.SESSIONS_IN}"),
                 F.col("rebounds").cast("string"), F.lit(T.OUT_OF), F.col("episodes").cast("string"),
                 F.lit(T.SIMILAR), percent_text(F.col("avg_gain"), 1, signed=True), F.lit(")")))
    lines = stats_with_picks.select("symbol", "rank", "score", head.alias("head"),
                                    listing_line(F.col("moneyness")).alias("line"))
    per = lines.groupBy("symbol").agg(F.max("score").alias("score"), F.any_value("head").alias("head"),
                                      _in_rank_order("line").alias("lines"))
    return per.select("symbol", "score", F.array_join(F.concat("head", "lines"), "\n").alias("text"))


def match_text(filters: dict[str, ScanFilter] | None = None) -> Column:
    """Headline and one line per filter, then whatever texts are attached."""
    filters = FILTERS if filters is None else filters
    head = F.concat(F.lit("*"), F.col("symbol"), F.lit("* — "), F.col("score").cast("string"),
                    F.lit(f"/{len(filters)} — "), price_text(F.col("price")))
    lines = [F.concat(F.lit("  "), F.when(F.array_contains("matched", k), T.MATCHED_MARK).otherwise(T.MISSED_MARK),
                      F.lit(f" {f.label}: "), F.coalesce(F.col("reasons")[k], F.lit("-")))
             for k, f in filters.items()]
    return F.array_join(F.array(head, *lines), "\n")


def alert_text(body: Column, now: str, hot: bool = False) -> Column:
    from ..functions.dates import exchange_time

    clock = F.date_format(exchange_time(F.lit(now).cast("timestamp")), "HH:mm")
    lead = ("🔥 " if hot else "") + T.ALERT_HEADER
    return F.concat(F.lit(f"{lead} — "), clock, F.lit(" ET\n\n"), body, F.lit(f"\n\n{T.ALERT_FOOTER}"))


def first_items(feed: DataFrame, params: DigestParams = DigestParams()) -> DataFrame:
    """The first headlines and messages per symbol by feed position, empties dropped after."""
    w = Window.partitionBy("symbol", "kind").orderBy("rank")
    limit = F.when(F.col("kind") == "news", params.headlines).otherwise(params.messages)
    most = max(params.headlines, params.messages)
    ranked = feed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    return ranked.where((F.col("_rn") <= limit) & (F.coalesce(F.col("body"), F.lit("")) != "")).drop("_rn")


def source_digest(feed: DataFrame, params: DigestParams = DigestParams()) -> DataFrame:
    """Per symbol the two bullet lists a summary would be made from."""
    items = first_items(feed, params).withColumn("line", F.concat(F.lit("- "), F.col("body")))

    def bullets(kind: str) -> Column:
        picked = F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "line")))
        text = F.array_join(F.transform(F.array_sort(picked), lambda e: e["line"]), "\n")
        return F.when(text != "", text).otherwise(T.EMPTY_SOURCE)

    return items.groupBy("symbol").agg(bullets("news").alias("headlines"), bullets("social").alias("social"))


def clean_summary(text: Column, params: DigestParams = DigestParams()) -> Column:
    return clip_words(none_as_null(text), params.max_chars)


def chart_table(bars: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """The last bars with bands, RSI, the reference line and the support level."""
    from .patterns import features_of, tail_frame

    tail = tail_frame(bars, params)
    frame = tail.where((F.col("n_bars") >= params.chart_min_bars) & (F.col("pos") >= F.col("n_bars") - params.chart_bars))
    levels = features_of(tail, params).select("symbol", "support_level")
    return frame.select("symbol", "ts", "open", "high", "low", "close", "bb_lower", "bb_mid", "bb_upper", "rsi",
                        F.lit(params.rsi_oversold).alias("rsi_ref")).join(levels, "symbol")


def status(qualified: DataFrame, hot: DataFrame, memory: DataFrame, subscribers: DataFrame) -> DataFrame:
    """One row of sizes; each list is counted where it lies."""
    parts = [("qualified", qualified), ("hot", hot), ("memory", memory), ("subscribers", subscribers)]
    sizes = None
    for name, rows in parts:
        one = rows.agg(F.count(F.lit(1)).alias("size")).withColumn("name", F.lit(name))
        sizes = one if sizes is None else sizes.unionByName(one)
    return sizes.agg(*[F.max(F.when(F.col("name") == n, F.col("size"))).alias(n) for n, _ in parts])
