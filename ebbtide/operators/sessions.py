"""Trading days as numbers: how many sessions lie between two days is a difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import is_trading_day
from ..session import scratch_path

FIRST_DAY, LAST_DAY = "1970-01-01", "2100-12-31"

_WRITTEN: dict[str, str] = {}


def trading_sessions(spark: SparkSession) -> DataFrame:
    """day, session: the number of trading days up to each calendar day, which a day without trading shares with the one before.

    The calendar has one row per day whatever the data; it is written once per application.
    """
    key = spark.sparkContext.applicationId
    if key not in _WRITTEN:
        years = spark.sql(f"select explode(sequence(date'{FIRST_DAY}', date'{LAST_DAY}')) as day").withColumn("_year", F.year("day"))
        marked = years.withColumn("_open", F.when(is_trading_day(F.col("day")), 1).otherwise(0))
        before = Window.orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)  # one row per year
        offsets = marked.groupBy("_year").agg(F.sum("_open").alias("_n")).select("_year", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        inside = F.sum("_open").over(Window.partitionBy("_year").orderBy("day"))
        numbered = marked.withColumn("_in", inside).join(offsets, "_year").select("day", (F.col("_base") + F.col("_in")).cast("int").alias("session"))
        path = scratch_path(spark, "calendar")
        numbered.coalesce(1).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def with_session(rows: DataFrame, ts: str, out: str = "_session") -> DataFrame:
    """Rows with the session of the UTC date of `ts`; null outside of the calendar."""
    calendar = trading_sessions(rows.sparkSession).select(F.col("day").alias("_day"), F.col("session").alias(out))
    return rows.withColumn("_day", F.to_date(F.col(ts).cast("timestamp"))).join(calendar, "_day", "left").drop("_day")
