"""Writers: the screener's CSV and versioned snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The column order of the exported file.
CSV_COLUMNS = ("ticker", "contract_symbol", "option_type", "expiry", "dte", "strike", "spot", "bid",
               "ask", "mid", "spread_pct", "volume", "open_interest", "iv", "delta", "theta")


def csv_rows(screened: DataFrame) -> DataFrame:
    named = screened.withColumnRenamed("symbol", "ticker") if "ticker" not in screened.columns else screened
    return named.select(*CSV_COLUMNS)


def write_csv(screened: DataFrame, path: str) -> None:
    """All matches, one file per task; nothing is gathered to write them."""
    csv_rows(screened).write.option("header", True).mode("errorifexists").csv(path)


def write_snapshot(rows: DataFrame, path: str, built_at: str) -> None:
    """A new version beside the old ones, so that the table read is never overwritten."""
    stamp = F.lit(built_at).cast("timestamp")
    version = built_at.replace(" ", "T").replace(":", "-")
    rows.withColumn("built_at", stamp).write.mode("overwrite").parquet(f"{path}/version={version}")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a snapshot table."""
    everything = spark.read.option("recursiveFileLookup", False).parquet(path)
    newest = everything.agg(F.max("version").alias("v"))
    return everything.where(F.col("version") == newest.scalar()).drop("version")
