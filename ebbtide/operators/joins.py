"""Joins whose hot keys are spread, and the as-of lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import series as S
from .sessions import with_session

SALTS = 16
SPAN = 256  # sessions that are looked at together


def lookup(rows: DataFrame, small: DataFrame, on: Sequence[str], spread_by: str,
           how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join `rows` with a table of one row per key, whatever the key skew.

    The key is salted by a hash of `spread_by`, so a hot key is shared by `salts`
    tasks; the small side is repeated once per salt. Spark still turns this into
    a broadcast by itself when the small side is measured to be small enough.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def restrict(rows: DataFrame, symbols: DataFrame, spread_by: str = "ts") -> DataFrame:
    """Keep the rows whose symbol is listed (semi-join)."""
    return lookup(rows, symbols.select("symbol").distinct(), ["symbol"], spread_by, "left_semi")


def asof(rows: DataFrame, facts: DataFrame, value: str, out: str, rows_ts: str,
         facts_ts: str = "ts", keys: Sequence[str] = S.KEYS, part_rows: int = 100_000) -> DataFrame:
    """Latest `value` of `facts` at or before each row's time, null if none.

    Rows and facts are merged by time inside chunks of each key, of about
    `part_rows` rows; the last fact of earlier chunks is carried in. No key is ever
    sorted whole.
    """
    left = rows.select(*keys, F.col(rows_ts).cast("timestamp").alias("_t"), F.lit(1).alias("_side"),
                       F.struct(*rows.columns).alias("_row"),
                       F.lit(None).cast(facts.schema[value].dataType).alias("_fact"))
    right = facts.select(*keys, F.col(facts_ts).cast("timestamp").alias("_t"),
                         F.lit(0).alias("_side"),
                         F.lit(None).cast(left.schema["_row"].dataType).alias("_row"),
                         F.col(value).alias("_fact"))
    merged = S.add_parts(left.unionByName(right), "_t", keys, part_rows)
    known = S.last_known(merged, F.col("_fact"), out, ["_t", "_side"], keys, including_self=True)
    return known.where("_side = 1").select("_row.*", out)


def boards(facts: DataFrame, value: str, sessions: int, facts_ts: str = "ts", keys: Sequence[str] = S.KEYS) -> DataFrame:
    """What each key shows in each session: the facts of that session in order, and the last one of the sessions before.

    A fact is on the boards of its own session and of the `sessions - 1` after it.
    A day of facts looks at the day before it and the day after inside spans of
    SPAN sessions, whose border days are copied to the neighbour; it is written
    again only for the sessions that have no facts of their own.
    """
    stamped = with_session(facts.select(*keys, F.col(facts_ts).cast("timestamp").alias("_t"), F.col(value).alias("_v")), "_t").where("_session is not null")
    daily = stamped.groupBy(*keys, "_session").agg(F.array_sort(F.collect_list(F.struct("_t", "_v"))).alias("_today"))
    home, within = F.floor(F.col("_session") / F.lit(SPAN)), F.pmod("_session", F.lit(SPAN))
    spans = F.array_compact(F.array(home, F.when(within >= SPAN - sessions, home + 1), F.when(within < sessions, home - 1)))
    w = Window.partitionBy(*keys, "_span").orderBy("_session")
    last = F.element_at("_today", -1)
    near = daily.withColumn("_span", F.explode(spans)).withColumns({
        "_before": F.when(F.col("_session") - F.lag("_session").over(w) < sessions, F.lag(last).over(w)),
        "_empty": F.least(F.lead("_session").over(w) - F.col("_session"), F.lit(sessions)) - 1})
    own = near.where(F.col("_span") == home).withColumn("_k", F.explode(F.sequence(F.lit(0), "_empty")))
    return own.select(*keys, (F.col("_session") + F.col("_k")).alias("_session"), F.when(F.col("_k") == 0, F.col("_before")).otherwise(last).alias("_before"),
                      F.when(F.col("_k") == 0, F.col("_today")).alias("_today"))


def recent(rows: DataFrame, shown: DataFrame, out: str, rows_ts: str, keys: Sequence[str] = S.KEYS, spread_by: str | None = None) -> DataFrame:
    """Latest value at or before each row's time, from boards; null if it is of no session that the boards keep.

    Rows look up a single board by key and session; nothing is ordered over rows
    and the join neither multiplies rows nor meets a whole key in one task. Few
    boards for many rows are repeated, with the rows of a session spread by `spread_by`.
    """
    at = F.col(rows_ts).cast("timestamp")
    stamped, on = with_session(rows, rows_ts), [*keys, "_session"]
    met = lookup(stamped, shown, on, spread_by, "left") if spread_by else stamped.join(shown, on, "left")
    passed = F.filter("_today", lambda e: e["_t"] <= at)
    fact = F.coalesce(F.get(passed, F.size(passed) - 1), F.col("_before"))
    return met.withColumn(out, fact["_v"]).drop("_session", "_before", "_today")
