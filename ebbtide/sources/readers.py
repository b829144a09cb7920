"""Readers: bars, chains, directories, lists and feeds, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import nan_as_null
from ..schemas import BARS, CHAIN, NESTED_CHAIN, NEWS, PRICE_COLUMNS, SOCIAL

FOOTER = "File Creation"


def clean_bars(raw: DataFrame, *more: str) -> DataFrame:
    """Rows with a close, missing numbers as null, one row per symbol and time."""
    numbers = {c: nan_as_null(F.col(c).cast("double")) for c in PRICE_COLUMNS}
    keys = [c for c in ("symbol", "interval", "ts") if c in raw.columns]
    rows = raw.select(*keys, *PRICE_COLUMNS, *more).withColumns(numbers)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).where("close is not null")


def read_bars(spark: SparkSession, path: str, interval: str, fmt: str = "parquet",
              since: str | None = None, unique: bool = True) -> DataFrame:
    """Bars of one interval; the interval and the start date are cut in the scan.

    With `unique`, of repeated (symbol, ts) rows, which re-delivered files may
    hold, the one of the newest file counts.
    """
    reader = spark.read.schema(BARS)
    raw = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    raw = raw.where(F.col("interval") == interval)
    if since:
        raw = raw.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if not unique:
        return clean_bars(raw).drop("interval")
    written = raw.withColumn("_delivery", F.struct("_metadata.file_modification_time", "_metadata.file_path"))
    return newest_delivery(clean_bars(written, "_delivery").drop("interval"), "_delivery")


def newest_delivery(bars: DataFrame, delivery: str) -> DataFrame:
    """One bar per symbol and time: the last by `delivery`, then the one of greatest values."""
    last = bars.groupBy("symbol", "ts").agg(F.max(F.struct(delivery, *PRICE_COLUMNS)).alias("_bar"))
    return last.select("symbol", "ts", *[F.col("_bar")[c].alias(c) for c in PRICE_COLUMNS])


def long_from_wide(wide: DataFrame, ts: str = "ts", separator: str = "|") -> DataFrame:
    """Columns named `SYMBOL|field` to one row per symbol and time.

    Symbols lacking one of the five fields are dropped, as are rows without close.
    """
    fields: dict[str, set[str]] = {}
    for name in wide.columns:
        symbol, _, field = name.partition(separator)
        if field:
            fields.setdefault(symbol, set()).add(field.lower())
    whole = [s for s, have in fields.items() if have.issuperset(PRICE_COLUMNS)]
    names = {c.partition(separator)[0] + separator + c.partition(separator)[2].lower(): c for c in wide.columns}
    rows = F.array(*[F.struct(F.lit(s).alias("symbol"), *[
        F.col(f"`{names[s + separator + f]}`").cast("double").alias(f) for f in PRICE_COLUMNS]) for s in whole])
    return clean_bars(wide.select(ts, F.explode(rows).alias("r")).select(F.col(ts).alias("ts"), "r.*"))


def read_chain(spark: SparkSession, path: str, as_of: str | None = None, days: int | None = None) -> DataFrame:
    """Flat chain, calls and puts in one table; the expiry window reaches the files."""
    from ..operators.quotes import expiry_window, with_days

    chain = spark.read.schema(CHAIN).parquet(path)
    if as_of is None:
        return chain
    chain = expiry_window(chain, as_of, days) if days is not None else chain
    return with_days(chain, F.lit(as_of).cast("date"))


def explode_chain(docs: DataFrame) -> DataFrame:
    """Nested chain documents to one row per contract, names parsed."""
    from ..operators.quotes import parse_contract_names

    options = docs.select("symbol", F.explode("data.options").alias("o")).select("symbol", "o.*")
    return parse_contract_names(options).withColumnsRenamed(
        {"option": "contract_symbol", "last_trade_price": "last"})


def read_nested_chain(spark: SparkSession, path: str) -> DataFrame:
    return explode_chain(spark.read.schema(NESTED_CHAIN).json(path))


def read_directory(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Pipe-delimited directory with a header and a closing footer line.

    The symbol column is `Symbol`, or `ACT Symbol` where there is none. Columns
    are named by the header line alone; no type is inferred.
    """
    raw = spark.read.option("header", True).option("sep", "|").option("mode", "PERMISSIVE").csv(path)
    first = raw.columns[0]
    body = raw.where(F.col(f"`{first}`").isNotNull() & ~F.startswith(F.col(f"`{first}`"), F.lit(FOOTER)))
    symbols = [F.col(f"`{c}`") for c in ("Symbol", "ACT Symbol") if c in raw.columns]

    def optional(name: str):
        return F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")

    return body.select(F.coalesce(*symbols).alias("symbol"), optional("Test Issue").alias("test_issue"),
                       optional("ETF").alias("etf"), F.lit(source).alias("source"))


def read_constituents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.col("Symbol").alias("symbol"))


def parse_ticker_lines(lines: DataFrame) -> DataFrame:
    """Lines that start with # and blank lines are skipped; the rest trimmed, upper case."""
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    return lines.where((text != "") & ~F.startswith("value", F.lit("#"))).select(F.upper(text).alias("symbol"))


def ticker_file(spark: SparkSession, path: str) -> DataFrame:
    return parse_ticker_lines(spark.read.text(path))


def headline_rows(docs: DataFrame) -> DataFrame:
    """News documents, nested or flat, to (symbol, rank, kind, body)."""
    item = docs.select("symbol", F.posexplode("items").alias("rank", "i"))
    nested = F.col("i.content").isNotNull()
    title = F.when(nested, F.col("i.content.title")).otherwise(F.col("i.title"))
    publisher = F.coalesce(F.when(nested, F.nullif(F.col("i.content.provider.displayName"), F.lit(""))),
                           F.col("i.publisher"))
    body = F.when(F.coalesce(publisher, F.lit("")) != "", F.concat(title, F.lit(" ("), publisher, F.lit(")"))).otherwise(title)
    return item.select("symbol", F.col("rank").cast("long").alias("rank"), F.lit("news").alias("kind"),
                       F.when(title != "", body).alias("body"))


def message_rows(docs: DataFrame) -> DataFrame:
    return docs.select("symbol", F.posexplode("messages").alias("rank", "m")).select(
        "symbol", F.col("rank").cast("long").alias("rank"), F.lit("social").alias("kind"), F.col("m.body").alias("body"))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    return headline_rows(spark.read.schema(NEWS).json(path))


def read_social(spark: SparkSession, path: str) -> DataFrame:
    return message_rows(spark.read.schema(SOCIAL).json(path))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether `path` can be read as text, on whatever file system it names."""
    if not path.strip() or any(c in path for c in "*?[]{}"):
        return False
    try:
        spark.read.schema(T.StructType([T.StructField("value", T.StringType())])).text(path).limit(0).count()
        return True
    except Exception:
        return False
