"""Dip-and-rebound statistics: is a symbol in a dip, and did it recover before?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import ReboundParams, ScanParams, SeriesParams
from .indicators import indicator_series


def dip_frame(bars: DataFrame, params: ReboundParams = ReboundParams(),
              series: SeriesParams = SeriesParams()) -> DataFrame:
    """Every bar with its dip flag and the best gain of the bars after it."""
    frame = indicator_series(bars, ScanParams(rsi_period=params.rsi_period), params, series,
                             only=("rsi", "extremes", "sma", "change", "ahead"))
    oversold = F.coalesce(F.col("rsi") < params.dip_rsi, F.lit(False))
    near_low = F.coalesce(F.col("close") <= F.col("roll_low") * (1.0 + params.near_low), F.lit(False))
    return frame.withColumns({
        "dip": oversold | near_low,
        "gain": F.when(F.col("close") > 0, F.col("best_ahead") / F.col("close") - 1.0)})


def _part_outcomes(dips: Column, start: Column, rows: int, params: ReboundParams) -> Column:
    """For each possible entry into a part, what its episodes add up to.

    Episodes are picked greedily with a minimum gap, so all that an earlier part
    can change is how many rows at the start of this one are still blocked: one
    of `gap` values. The first part has a single entry.
    """
    def run(entry: Column) -> Column:
        zero = F.struct((start + entry).alias("nxt"), F.lit(0).alias("n"), F.lit(0).alias("r"),
                        F.lit(0.0).alias("t"))

        def step(a: Column, d: Column) -> Column:
            hit = F.struct((d["pos"] + params.gap).alias("nxt"), (a["n"] + 1).alias("n"),
                           (a["r"] + F.when(d["gain"] >= params.min_gain, 1).otherwise(0)).alias("r"),
                           (a["t"] + d["gain"]).alias("t"))
            return F.when(d["pos"] >= a["nxt"], hit).otherwise(a)

        return F.aggregate(dips, zero, step, lambda a: F.struct(
            F.greatest(a["nxt"] - start - rows, F.lit(0)).cast("int").alias("exit"),
            a["n"].alias("n"), a["r"].alias("r"), a["t"].alias("t")))

    last = F.when(start == 0, 0).otherwise(params.gap - 1)
    return F.transform(F.sequence(F.lit(0), last), run)


def episodes(frame: DataFrame, params: ReboundParams = ReboundParams(),
             series: SeriesParams = SeriesParams()) -> DataFrame:
    """Greedy episode counts per symbol, with its last bar.

    A part holds at most `block_rows` bars; parts are then chained in order.
    """
    rows = series.block_rows
    usable = (F.col("dip") & (F.col("pos") >= params.first_bar)
              & (F.col("pos") < F.col("n_bars") - params.horizon))
    part = F.floor(F.col("pos") / rows).cast("long")
    last = F.struct("pos", "n_bars", "ts", "close", "rsi", "change_20", "sma50", "roll_low", "roll_high", "dip")
    parts = (frame.withColumn("part", part).groupBy("symbol", "part").agg(
        F.array_sort(F.collect_list(F.when(usable, F.struct("pos", "gain")))).alias("dips"),
        F.max_by(last, "pos").alias("last")))
    parts = parts.withColumn("outs", _part_outcomes(F.col("dips"), F.col("part") * rows, rows, params))
    chained = parts.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("part", "outs"))).alias("parts"),
        F.max_by("last", "part").alias("last"))
    zero = F.struct(F.lit(0).alias("e"), F.lit(0).alias("n"), F.lit(0).alias("r"), F.lit(0.0).alias("t"))

    def follow(a: Column, p: Column) -> Column:
        out = F.get(p["outs"], a["e"])
        return F.struct(out["exit"].alias("e"), (a["n"] + out["n"]).alias("n"),
                        (a["r"] + out["r"]).alias("r"), (a["t"] + out["t"]).alias("t"))

    return (chained.withColumn("sum", F.aggregate("parts", zero, follow))
            .select("symbol", "last.*", F.col("sum.n").alias("episodes"), F.col("sum.r").alias("rebounds"),
                    F.col("sum.t").alias("total_gain")))


def _position(price: Column, level: Column, below: bool) -> Column:
    ratio = 1.0 - price / level if below else price / level - 1.0
    return F.when(level > 0, ratio).otherwise(0.0)


def rebound_stats(bars: DataFrame, params: ReboundParams = ReboundParams(),
                  series: SeriesParams = SeriesParams()) -> DataFrame:
    """Every symbol with its statistics and whether it passes both conditions."""
    folded = episodes(dip_frame(bars, params, series), params, series)
    price = F.col("close")
    enough = (F.col("n_bars") >= params.history_bars) & (price > 0) & F.col("rsi").isNotNull()
    falling = (F.col("change_20") < 0) | (price < F.col("sma50"))
    stats = folded.select(
        "symbol", price.alias("price"), F.col("n_bars"), F.col("change_20").alias("change_20d"), F.col("rsi").alias("rsi14"),
        "sma50", "dip", "episodes", "rebounds",
        _position(price, F.col("roll_low"), below=False).alias("above_52w_low"),
        _position(price, F.col("roll_high"), below=True).alias("off_52w_high"),
        F.try_divide(F.col("total_gain"), F.col("episodes")).alias("avg_gain"),
        F.coalesce(F.try_divide(F.col("rebounds").cast("double"), F.col("episodes")), F.lit(0.0)).alias("rebound_rate"),
        F.coalesce(enough & falling & F.col("dip"), F.lit(False)).alias("declining_now"))
    passes = (F.col("declining_now") & (F.col("episodes") >= params.min_episodes)
              & (F.col("rebound_rate") >= params.min_rate))
    return stats.withColumn("score", F.col("rebound_rate") * F.greatest("avg_gain", F.lit(0.0))).withColumn(
        "qualifies", passes)


def best_rebounds(stats: DataFrame, most: int = 40) -> DataFrame:
    return stats.where("qualifies").orderBy(F.desc("score"), "symbol").limit(most)
