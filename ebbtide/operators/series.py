"""Cutting long per-symbol series into bounded pieces.

A window partitioned by symbol alone puts one symbol's whole history in one
task. Everything that needs order over a whole history goes through two steps
here instead, so that a task only ever sorts a bounded piece:

* chunk: a fixed calendar span of one symbol. A small table with one row per
  (symbol, chunk) carries totals and last values from chunk to chunk.
* block: a fixed number of rows of one symbol, known once positions are. Rows
  near a border are also sent to the neighbour, so that bounded frames are whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import SeriesParams

KEYS = ("symbol",)
CHUNK = "_chunk"
BLOCK = "_block"
PART_ROWS = 4096  # weights of RSI grow by 14/13 a row and would overflow past about 9,500
DAY = 86_400


def add_chunk(df: DataFrame, ts: str = "ts", days: float = 1024) -> DataFrame:
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    return df.withColumn(CHUNK, F.floor(seconds / F.lit(int(days * DAY))).cast("long"))


def add_parts(df: DataFrame, ts: str = "ts", keys: Sequence[str] = KEYS, rows: int = 100_000, seconds: int = 3600) -> DataFrame:
    """Chunks in time order of about `rows` rows each, however dense a key is.

    Rows are counted per key and fine span of time; the spans of a key are then
    laid into chunks by their running count. A chunk holds `rows` and at most one span more,
    so a key with many rows gets as many chunks as it needs.
    """
    span = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(seconds)).cast("long")
    spanned = df.withColumn("_span", span)
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spanned.groupBy(*keys, "_span").agg(F.count(F.lit(1)).alias("_n"))
    ids = sizes.select(*keys, "_span", F.floor(F.coalesce(F.sum("_n").over(earlier), F.lit(0)) / F.lit(rows)).cast("long").alias(CHUNK))
    return spanned.join(ids, [*keys, "_span"]).drop("_span")


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def join_chunks(rows: DataFrame, chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach what is carried into each chunk.

    The rows are already spread and sorted by these keys, so a merge join moves
    only the small table; a broadcast could pick either side by size and would
    give that layout up.
    """
    return rows.join(chunks.hint("merge"), [*keys, CHUNK])


def running_sum(df: DataFrame, value: str, out: str, order: Sequence[str],
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Cumulative sum of `value` in `order`; `df` must carry a chunk column."""
    totals = df.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_t"))
    base = totals.select(*keys, CHUNK,
                         F.coalesce(F.sum("_t").over(_before(keys)), F.lit(0)).alias("_base"))
    w = (Window.partitionBy(*keys, CHUNK).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0))
    local = df.withColumn("_cum", F.sum(value).over(w))
    return (join_chunks(local, base, keys)
            .withColumn(out, F.col("_base") + F.col("_cum")).drop("_base", "_cum"))


def last_known(df: DataFrame, value: Column, out: str, order: Sequence[str],
               keys: Sequence[str] = KEYS, including_self: bool = False) -> DataFrame:
    """Latest non-null `value` before each row (or at it) in `order`.

    Serves both the lag over a whole history and the as-of lookup. `df` must
    carry a chunk column.
    """
    df = df.withColumn("_v", value)
    rank = F.when(F.col("_v").isNotNull(), F.struct(*order))
    ends = df.groupBy(*keys, CHUNK).agg(F.max_by("_v", rank).alias("_e"))
    carried = ends.select(*keys, CHUNK,
                          F.last("_e", ignorenulls=True).over(_before(keys)).alias("_in"))
    w = (Window.partitionBy(*keys, CHUNK).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0 if including_self else -1))
    local = df.withColumn("_l", F.last("_v", ignorenulls=True).over(w))
    return (join_chunks(local, carried, keys)
            .withColumn(out, F.coalesce("_l", "_in")).drop("_v", "_l", "_in"))


def bounded_days(bars: DataFrame, days: float, rows: int = PART_ROWS, keys: Sequence[str] = KEYS) -> float:
    """A span of at most `days` for chunks of at most `rows` bars, found by counting symbols and times alone.

    Daily bars need one count. Denser ones are cut finer until the fullest chunk fits; a second is not split.
    """
    while True:
        fullest = add_chunk(bars.select(*keys, "ts"), days=days).groupBy(*keys, CHUNK).count().agg(F.max("count")).first()[0] or 0
        if fullest <= rows or days * DAY <= 1:
            return days
        days = max(1, int(days * DAY * rows / fullest / 1.5)) / DAY


def with_positions(bars: DataFrame, series: SeriesParams = SeriesParams(),
                   rsi_period: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add `pos` (0-based bar position), `n_bars`, and optionally `rsi`.

    RSI is the ratio of two exponentially decayed sums over the whole history.
    They are cumulative sums of weighted gains and losses inside a chunk, whose
    rows are bounded as the weights grow with the row; what earlier chunks
    contribute is carried in as one decayed number per side.
    """
    days = bounded_days(bars, series.chunk_days, keys=keys) if rsi_period else series.chunk_days
    df = add_chunk(bars, days=days)
    w = Window.partitionBy(*keys, CHUNK).orderBy("ts")
    df = df.withColumn("_row", F.row_number().over(w) - 1)
    totals = [F.count(F.lit(1)).alias("_len")]
    carried = ["_start", "n_bars"]
    if rsi_period:
        q = 1.0 - 1.0 / rsi_period
        move = F.col("close") - F.lag("close").over(w)
        df = df.withColumn("_d", move * F.pow(F.lit(1.0 / q), F.col("_row") + 1))
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        up, down = F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0), F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)
        df = df.withColumns({"_gcum": F.sum(up).over(upto), "_lcum": F.sum(down).over(upto)})
        totals += [F.min_by("close", "_row").alias("_first"), F.max_by("close", "_row").alias("_last"),
                   F.max("_gcum").alias("_gs"), F.max("_lcum").alias("_ls")]
    chunks = df.groupBy(*keys, CHUNK).agg(*totals)
    chunks = (chunks.withColumn("_start", F.coalesce(F.sum("_len").over(_before(keys)), F.lit(0)))
                    .withColumn("n_bars", F.sum("_len").over(Window.partitionBy(*keys))))
    if rsi_period:
        chunks = _carry_decayed(chunks, q, keys)
        carried += ["_gin", "_lin"]
    out = join_chunks(df, chunks.select(*keys, CHUNK, *carried), keys).withColumn("pos", F.col("_start") + F.col("_row"))
    if rsi_period:
        out = out.withColumn("_gain", F.col("_gin") + F.col("_gcum")).withColumn("_loss", F.col("_lin") + F.col("_lcum"))
        out = out.withColumn("rsi", F.when(F.col("pos") < rsi_period, F.lit(None))
                             .when(F.col("_loss") == 0, F.lit(100.0))
                             .otherwise(100.0 - 100.0 / (1.0 + F.col("_gain") / F.col("_loss"))))
        out = out.drop("_d", "_gcum", "_lcum", "_gain", "_loss", "_gin", "_lin")
    return out.drop(CHUNK, "_row", "_start")


def _carry_decayed(chunks: DataFrame, q: float, keys: Sequence[str], width: int = 64) -> DataFrame:
    """Per chunk: decayed gain and loss at its entry, the first delta included.

    A chunk maps a decayed sum x to (x + own) * shrink. Such maps compose to one of the
    same form, so they are scanned in two levels: inside runs of `width` chunks,
    then over the composed maps of whole runs. No chunk looks at all earlier ones.
    """
    ordered = Window.partitionBy(*keys).orderBy(CHUNK)
    step = F.coalesce(F.col("_first") - F.lag("_last").over(ordered), F.lit(0.0))
    shrink = F.pow(F.lit(q), F.col("_len"))
    up, down = F.greatest(F.col("_step"), F.lit(0.0)) / q, F.greatest(-F.col("_step"), F.lit(0.0)) / q
    chunks = chunks.withColumns({"_step": step, "_run": F.floor((F.row_number().over(ordered) - 1) / F.lit(width))})
    chunks = chunks.withColumns({"_gstep": up, "_lstep": down, "_map": F.struct(
        shrink.alias("s"), ((F.col("_gs") + up) * shrink).alias("g"), ((F.col("_ls") + down) * shrink).alias("l"))})
    same = F.struct(F.lit(1.0).alias("s"), F.lit(0.0).alias("g"), F.lit(0.0).alias("l"))

    def then(a: Column, e: Column) -> Column:
        return F.struct((a["s"] * e["s"]).alias("s"), (e["g"] + a["g"] * e["s"]).alias("g"), (e["l"] + a["l"] * e["s"]).alias("l"))

    earlier = lambda keys_, by: Window.partitionBy(*keys_).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_in", F.aggregate(F.collect_list("_map").over(earlier([*keys, "_run"], CHUNK)), same, then))
    runs = chunks.groupBy(*keys, "_run").agg(F.max_by(then(F.col("_in"), F.col("_map")), CHUNK).alias("_whole"))
    runs = runs.select(*keys, "_run", F.aggregate(F.collect_list("_whole").over(earlier(keys, "_run")), same, then).alias("_base"))
    joined = chunks.join(runs, [*keys, "_run"])
    into = then(F.col("_base"), F.col("_in"))
    return joined.withColumn("_gin", into["g"] + F.col("_gstep")).withColumn("_lin", into["l"] + F.col("_lstep"))


def in_blocks(positioned: DataFrame, back: int, ahead: int = 0,
              series: SeriesParams = SeriesParams()) -> DataFrame:
    """Assign rows to blocks, copying border rows to the neighbours that look at them.

    Adds the block column and `is_core`; drop copies with `is_core` after windows.
    """
    rows = series.block_rows
    if rows < max(back, ahead):
        raise ValueError("block_rows must cover the widest frame")
    own = F.floor(F.col("pos") / F.lit(rows)).cast("long")
    within = F.col("pos") - own * rows

    def target(number: Column, core: bool) -> Column:
        return F.struct(number.alias("b"), F.lit(core).alias("core"))

    places = F.array_compact(F.array(
        target(own, True),
        F.when((within >= rows - back) & ((own + 1) * rows < F.col("n_bars")), target(own + 1, False)),
        F.when((within < ahead) & (own > 0), target(own - 1, False))))
    return (positioned.withColumn("_p", F.explode(places))
            .withColumn(BLOCK, F.col("_p.b")).withColumn("is_core", F.col("_p.core")).drop("_p"))


def block_window(keys: Sequence[str] = KEYS):
    return Window.partitionBy(*keys, BLOCK).orderBy("pos")


def tail(positioned: DataFrame, bars: int) -> DataFrame:
    """The last `bars` rows of every symbol."""
    return positioned.where(F.col("pos") >= F.col("n_bars") - bars)
