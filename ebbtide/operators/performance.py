"""Returns of alerts against a benchmark over fixed horizons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions.strings import plain_number
from ..params import PerformanceParams
from ..session import written
from .joins import boards, recent

PRICE_SESSIONS = 5  # prices are read from the last five trading days


def latest_prices(bars: DataFrame) -> DataFrame:
    """Last non-null close per symbol."""
    valid = bars.where("close is not null and not isnan(close)")
    return valid.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_close"))


def price_boards(bars: DataFrame, symbols: DataFrame, benchmark: str) -> tuple[DataFrame, DataFrame]:
    """Boards of the `symbols` asked for and of the benchmark alone, over PRICE_SESSIONS trading days.

    Both are written, so that Spark knows how small they are.
    """
    closes = bars.where("close is not null and not isnan(close)").select("symbol", "ts", "close")
    asked = closes.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    index = boards(closes.where(F.col("symbol") == benchmark), "close", PRICE_SESSIONS)
    return written(boards(asked, "close", PRICE_SESSIONS), "boards"), written(index.drop("symbol"), "index-boards")


def with_prices(rows: DataFrame, shown: tuple[DataFrame, DataFrame], at: str, price: str, bench: str) -> DataFrame:
    """Both prices as of `at`: the symbol's and the benchmark's.

    A price from before the last five trading days counts as missing. The
    benchmark has one board a session, whatever the symbols.
    """
    own, index = shown
    return recent(recent(rows, own, price, at), index, bench, at, keys=(), spread_by="alert_id")


def track(alerts: DataFrame, bars: DataFrame, params: PerformanceParams) -> DataFrame:
    """Stamp alerts with both prices; without a benchmark price they are not tracked.

    The `price` an alert was sent with is its price; the bars answer where it has none.
    """
    priced = with_prices(alerts, price_boards(bars, alerts, params.benchmark), "alert_ts", "alert_price", "bench_price")
    if "price" in alerts.columns:
        priced = priced.withColumn("alert_price", F.coalesce("price", "alert_price"))
    return priced.where("alert_price is not null and bench_price is not null")


def horizon_checks(tracked: DataFrame, params: PerformanceParams) -> DataFrame:
    """One row per alert and horizon with its due time."""
    rows = tracked.withColumn("horizon_h", F.explode(F.array(*[F.lit(h) for h in params.horizons_hours])))
    return rows.withColumn("due_ts", F.timestamp_seconds(
        F.unix_seconds("alert_ts") + F.col("horizon_h") * 3600))


def check_map(checks: DataFrame) -> DataFrame:
    """Nested export form: horizon -> (due, attempts)."""
    entry = F.struct(F.col("horizon_h").cast("string"), F.struct("due_ts", F.lit(0).alias("attempts")))
    return checks.groupBy("alert_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("checks"))


def first_run(params: PerformanceParams) -> Column:
    """Second of the first run at or after the due time."""
    return F.ceil(F.unix_seconds("due_ts") / F.lit(params.check_seconds)) * params.check_seconds


def is_due(now: str, params: PerformanceParams) -> Column:
    """Whether a check has been tried by `now`; one without a due time never is."""
    return F.coalesce(F.timestamp_seconds(first_run(params)) <= F.lit(now).cast("timestamp"), F.lit(False))


def settle(checks: DataFrame, bars: DataFrame, now: str, params: PerformanceParams, stored: bool = False) -> DataFrame:
    """State of every check at `now`; `stored` tells that the checks are a written table.

    A check is tried on the first run at or after its due time and on the runs
    after it, up to the limit of attempts, until both prices are there. It ends
    as `settled`, `gave_up` (not counted) or `pending`.
    """
    step, first = params.check_seconds, first_run(params)
    in_time = F.col("run_ts") <= F.lit(now).cast("timestamp")
    good = F.col("price").isNotNull() & F.col("bench").isNotNull()

    def runs(of: DataFrame, attempts: Column) -> DataFrame:
        return of.withColumn("attempt", attempts).withColumn("run_ts", F.timestamp_seconds(first + F.col("attempt") * step))

    # Checks whose first run lies ahead wait as they are. Nearly all others find their prices in it and end there, in their own row; the rest is tried again.
    if not stored:
        checks = written(checks, "checks")
    due = is_due(now, params)
    none = F.lit(None).cast("struct<attempt: int, run_ts: timestamp, price: double, bench: double>")
    waiting = checks.where(~due).withColumns({"hit": none, "tried": F.lit(0)})
    shown = price_boards(bars, checks, params.benchmark)
    once = with_prices(runs(checks.where(due), F.lit(0)), shown, "run_ts", "price", "bench")
    hit = F.when(good, F.struct("attempt", "run_ts", "price", "bench"))
    once = written(once.withColumns({"hit": hit, "tried": F.lit(1)}).drop("attempt", "run_ts", "price", "bench"), "first-run")
    missed = F.col("hit").isNull()
    ended = once.where(~missed).unionByName(waiting) if params.max_attempts > 1 else once.unionByName(waiting)
    if params.max_attempts > 1:
        key = ["alert_id", "symbol", "horizon_h"]
        again = runs(once.where(missed).select(*key, "due_ts"), F.explode(F.sequence(F.lit(1), F.lit(params.max_attempts - 1)))).where(in_time)
        done = with_prices(again, shown, "run_ts", "price", "bench").groupBy(*key).agg(
            F.min_by(F.struct("attempt", "run_ts", "price", "bench"), F.when(good, F.col("attempt"))).alias("hit"),
            (F.max("attempt") + 1).alias("tried"))
        later = once.where(missed).drop("hit", "tried").join(done, key, "left").withColumn("tried", F.coalesce("tried", F.lit(1)))
        ended = ended.unionByName(later)
    hit = F.col("hit").isNotNull()
    alpha = ((F.col("hit.price") / F.col("alert_price") - 1.0)
             - (F.col("hit.bench") / F.col("bench_price") - 1.0))
    return ended.withColumns({
        "status": F.when(hit, "settled").when(F.col("tried") >= params.max_attempts, "gave_up").otherwise("pending"),
        "attempts": F.when(hit, F.col("hit.attempt")).otherwise(F.col("tried")).cast("int"),
        "settled_ts": F.col("hit.run_ts"), "price_now": F.col("hit.price"), "bench_now": F.col("hit.bench"),
        "alpha": F.when(hit, alpha)}).drop("hit", "tried")


def fold(settled: DataFrame) -> DataFrame:
    """Count, wins and summed alpha per horizon."""
    done = settled.where("status = 'settled'")
    return done.groupBy("horizon_h").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("alpha") > 0).alias("wins"),
        F.sum("alpha").alias("sum_alpha"))


def merge_folds(earlier: DataFrame, newer: DataFrame) -> DataFrame:
    return earlier.unionByName(newer).groupBy("horizon_h").agg(
        F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.sum("sum_alpha").alias("sum_alpha"))


def pending_alerts(settled: DataFrame) -> DataFrame:
    return settled.where("status = 'pending'").agg(F.count_distinct("alert_id").alias("pending"))


def report(summary: DataFrame) -> DataFrame:
    """Win rate and mean alpha in percent per horizon, with the report line."""
    rows = summary.where("n > 0").withColumns({
        "win_rate": F.col("wins") / F.col("n") * 100.0,
        "mean_alpha": F.col("sum_alpha") / F.col("n") * 100.0})
    sign = F.when(F.col("mean_alpha") >= 0, "+").otherwise("")
    line = F.concat(F.lit(T.REPORT_AFTER), F.col("horizon_h").cast("string"), F.lit(T.REPORT_SIGNALS),
                    F.col("n").cast("string"), F.lit(T.REPORT_WON), plain_number(F.col("win_rate"), 0),
                    F.lit(T.REPORT_MEAN), sign, plain_number(F.col("mean_alpha"), 2), F.lit("%"))
    return rows.withColumn("line", line)


def report_text(settled: DataFrame) -> DataFrame:
    """The whole report as one row: a title, a line per horizon, the pending count."""
    lines = report(fold(settled)).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("horizon_h", "line"))), lambda e: e["line"]).alias("lines"))
    both = lines.select("lines", F.lit(None).cast("long").alias("pending")).unionByName(
        pending_alerts(settled).select(F.lit(None).cast("array<string>").alias("lines"), "pending"))
    one = both.agg(F.max_by("lines", F.size("lines")).alias("lines"), F.max("pending").alias("pending"))
    waiting = F.when(F.col("pending") > 0, F.array(F.concat(
        F.lit(T.REPORT_PENDING_HEAD), F.col("pending").cast("string"), F.lit(T.REPORT_PENDING_TAIL))))
    body = F.when(F.size("lines") > 0, F.concat(F.array(F.lit(T.REPORT_TITLE)), F.col("lines"))).otherwise(
        F.array(F.lit(T.REPORT_NONE)))
    return one.select(F.array_join(F.concat(body, F.coalesce(waiting, F.array().cast("array<string>"))), "\n").alias("text"))


def compact_line(summary: DataFrame, params: PerformanceParams = PerformanceParams()) -> DataFrame:
    """The smallest horizon with a large enough sample, as one line (no row without one)."""
    enough = summary.where(F.col("n") >= params.min_sample)
    best = enough.agg(F.min_by(F.struct("horizon_h", "n", "wins"), "horizon_h").alias("b")).where("b is not null")
    line = F.concat(F.lit(T.COMPACT_HEAD), plain_number(F.col("b.wins") / F.col("b.n") * 100.0, 0),
                    F.lit(T.COMPACT_LAST), F.col("b.n").cast("string"), F.lit(T.COMPACT_AFTER),
                    F.col("b.horizon_h").cast("string"), F.lit(T.COMPACT_HOURS))
    return best.select(F.col("b.horizon_h").alias("horizon_h"), line.alias("line"))
