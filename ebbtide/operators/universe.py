"""Which symbols to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import snapshot_is_fresh
from ..functions.strings import normal_symbol


def common_stocks(directory: DataFrame) -> DataFrame:
    """Plain alphabetic tickers of up to five letters, no ETFs, no test issues."""
    cleaned = directory.where("test_issue = 'N' and etf = 'N'").select(normal_symbol("symbol").alias("symbol"))
    return cleaned.where(F.col("symbol").rlike(r"^\p{L}{1,5}$")).distinct()


def all_listed(directory: DataFrame) -> DataFrame:
    """Everything listed but test issues and symbols with a suffix; ETFs stay."""
    symbol = F.trim("symbol")
    kept = directory.where(F.coalesce(F.col("test_issue") != "Y", F.lit(True))).select(symbol.alias("symbol"))
    plain = (F.col("symbol") != "") & ~F.contains("symbol", F.lit("$")) & ~F.contains("symbol", F.lit("."))
    return kept.where(plain).distinct()


def index_members(constituents: DataFrame) -> DataFrame:
    return constituents.select(F.translate("symbol", ".", "-").alias("symbol"))


def union_distinct(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("symbol")
    for more in lists[1:]:
        out = out.unionByName(more.select("symbol"))
    return out.distinct()


def capped(symbols: DataFrame, most: int | None) -> DataFrame:
    return symbols.orderBy("symbol").limit(most) if most else symbols


def resolve(spark: SparkSession, spec: str, constituents: DataFrame | None = None,
            directory: DataFrame | None = None) -> DataFrame:
    """`sp500`, `all`, a comma list, a readable file, or one ticker."""
    from ..sources.readers import path_exists, ticker_file

    key = spec.strip().lower()
    if key in ("sp500", "all"):
        source = constituents if key == "sp500" else directory
        if source is None:
            raise ValueError(f"universe '{key}' needs its table")
        return index_members(source) if key == "sp500" else all_listed(source)
    if "," not in spec and path_exists(spark, spec):
        return ticker_file(spark, spec)
    one = spark.range(1).select(F.explode(F.split(F.lit(spec), ",")).alias("symbol"))
    return one.select(normal_symbol("symbol").alias("symbol")).where("symbol <> ''")


def fresh_qualified(snapshot: DataFrame, now: str) -> DataFrame:
    """Symbols of a qualified-list snapshot built after the last rebuild deadline."""
    return snapshot.where(snapshot_is_fresh(F.col("built_at"), F.lit(now).cast("timestamp"))).select("symbol")


def scan_list(spark: SparkSession, qualified: DataFrame | None, universe: DataFrame, now: str) -> tuple[bool, DataFrame]:
    """(full pass?, symbols). The driver only learns whether a fresh list exists."""
    if qualified is not None:
        fresh = fresh_qualified(qualified, now)
        if not fresh.isEmpty():
            return False, fresh
    return True, universe


def cached_universe(snapshot: DataFrame | None, rebuild, now: str, max_age_hours: int = 24) -> tuple[str, DataFrame]:
    """A young snapshot, else a rebuilt list, else the stale snapshot."""
    at = F.lit(now).cast("timestamp")
    if snapshot is not None:
        age = F.unix_timestamp(at) - F.unix_timestamp("built_at")
        young = snapshot.where(age < max_age_hours * 3600)
        if not young.isEmpty():
            return "snapshot", young.select("symbol")
    try:
        rebuilt = rebuild()
        if rebuilt.isEmpty():
            raise ValueError("empty universe")
        return "rebuilt", rebuilt
    except Exception:
        if snapshot is None or snapshot.isEmpty():
            raise RuntimeError("no universe available") from None
        return "stale", snapshot.select("symbol")
