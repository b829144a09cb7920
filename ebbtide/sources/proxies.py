"""Market tables derived from the given data, which holds no market data.

Prices walk with discounts, contracts hang on order lines, ticks on events.
The sums that drive prices are integers, so every engine gets the same bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import computed_once
from ..operators import series as S
from ..session import scratch_path, tune

AS_OF = "2001-11-05"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = tune(spark).read.parquet(f"{folder}/{name}.parquet")
    zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def bars_daily(spark: SparkSession, folder: str) -> DataFrame:
    """One bar per supplier and ship date; at most one row per calendar day each."""
    lines = table(spark, folder, "lineitem")
    daily = (lines.groupBy(F.col("l_suppkey").alias("sk"), F.col("l_shipdate").alias("ts"))
             .agg(F.expr("sum(cast(round(l_discount * 100) as bigint) - 5)").alias("bp"),
                  F.expr("sum(l_quantity) * 2000").alias("volume"), F.max("l_tax").alias("tx")))
    w = Window.partitionBy("sk").orderBy("ts")
    priced = daily.withColumn("walk", F.sum("bp").over(w)).selectExpr(
        "sk", "ts", "volume", "tx", "round(20 * exp(walk / cast(100 as double)), 4) as close")
    opened = priced.withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(20.0)))
    return opened.selectExpr(
        "concat('S', sk) as symbol", "ts", "open", "greatest(open, close) * (1 + tx / 4) as high",
        "least(open, close) * (1 - tx / 4) as low", "close", "volume")


def spot(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("spot"))


def chain(spark: SparkSession, folder: str) -> DataFrame:
    """One contract per order line, priced around the last close of its symbol.

    Lines are spread over tasks while they are narrow: names and prices are made after that.
    """
    prices = stored(tune(spark), folder, "spot", lambda: spot(bars(spark, folder)))
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag").repartition("l_orderkey", "l_linenumber")
    raw = lines.selectExpr("concat('S', l_suppkey) as symbol", "*").join(prices, "symbol").selectExpr(
        "symbol",
        "concat('S', l_suppkey, '-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', "
        "cast(l_quantity as int)) as contract_symbol",
        "case when l_returnflag = 'N' then 'put' else 'call' end as option_type",
        "cast(1 + l_orderkey % 120 as int) as dte", "0.15 + l_discount * 5 as iv0",
        "l_tax", "l_quantity", "l_linenumber", "l_partkey", "spot")
    priced = (raw.selectExpr(
                  "*", "floor(spot * (70 + 0.6 * (l_partkey % 100))) / cast(100 as double) as strike")
              .selectExpr("*", "round(greatest(case when option_type = 'call' then spot - strike "
                          "else strike - spot end, 0) + spot * iv0 * sqrt(dte / cast(365 as double)) "
                          "* 0.4, 4) as mid0"))
    written = computed_once(priced, {c: F.col(c) for c in ("strike", "mid0")})
    return written.selectExpr(
        "symbol", "contract_symbol", "option_type", "dte", f"date_add(date'{AS_OF}', dte) as expiry",
        "strike", "spot",
        "case when l_linenumber = 7 then cast(0 as double) else mid0 * (1 - 1.5 * l_tax) end as bid",
        "case when l_linenumber = 7 then cast(0 as double) else mid0 * (1 + 1.5 * l_tax) end as ask",
        "mid0 as last", "cast(l_quantity * 10 as bigint) as volume",
        "cast((l_partkey * 7) % 3000 as bigint) as open_interest",
        "case when l_linenumber = 6 and l_quantity < 5 then null else round(iv0, 4) end as iv",
        "case when l_partkey % 3 = 0 then 'secondary' else 'primary' end as provider")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per session to the shared folder and read back.

    In use the market tables are stored ones. Written out, they are not derived
    again by every query, filters and columns are cut in their scans, and Spark
    knows their sizes when it picks a join.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        make().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def stored_path(spark: SparkSession, folder: str, name: str) -> str:
    return _STORED[(spark.sparkContext.applicationId, folder, name)]


SLICES, SLICE_FILES = 4, 8


def stored_slices(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], ts: str = "ts") -> str:
    """Path of a table stored in slices of time, written one after the other, for streams of several micro-batches."""
    key = (spark.sparkContext.applicationId, folder, f"{name} in slices")
    if key not in _STORED:
        path, rows = scratch_path(spark, "slices"), make()
        seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
        first, last = rows.agg(F.min(seconds), F.max(seconds)).first()
        slice_ = F.least(F.floor((seconds - first) * SLICES / (last - first + 1)), F.lit(SLICES - 1)) if first is not None else F.lit(0)
        for k in range(SLICES):
            rows.where(slice_ == k).repartition(SLICE_FILES).write.parquet(f"{path}/slice={k}")
        _STORED[key] = path
    return _STORED[key]


def bars(spark: SparkSession, folder: str) -> DataFrame:
    return stored(tune(spark), folder, "bars", lambda: bars_daily(spark, folder))


def contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored as the chain spreads it, so that readers find it spread however its source files were."""
    return stored(tune(spark), folder, "contracts", lambda: chain(spark, folder))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Few symbols hold all events, so the price walk is summed in two levels."""
    events = table(spark, folder, "events").selectExpr(
        "concat('U', user_id % 10) as symbol", "ts", "event_id",
        "cast(round(value) as bigint) - 50 as step")
    walked = S.running_sum(S.add_parts(events, seconds=60), "step", "walk", ["ts", "event_id"])
    return walked.selectExpr(
        "symbol", "ts", "event_id", "round(50 * exp(walk / cast(5000 as double)), 4) as price",
        "20000 + (event_id % 50) * 1000 as size")


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey as alert_id", "concat('S', o_custkey % 10) as symbol",
        "o_orderdate as alert_ts", "o_orderpriority as signature")


def directory(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr(
        "translate(concat('', s_suppkey), '0123456789', 'ABCDEFGHIJ') as symbol",
        "case when s_acctbal < 0 then 'Y' else 'N' end as test_issue",
        "case when s_nationkey % 5 = 0 then 'Y' else 'N' end as etf",
        "case when s_suppkey % 2 = 0 then 'nasdaq' else 'other' end as source")


def feed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").where(
        F.col("role").isin("assistant", "user")).selectExpr(
        "concat('S', conv_id) as symbol", "turn as rank",
        "case when role = 'assistant' then 'news' else 'social' end as kind", "text as body")
