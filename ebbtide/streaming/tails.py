"""What a scan must remember of each symbol, as keyed state on disk.

The state of a symbol is bounded: the last bars of its history, and for all bars
before them their number, the last close and the decayed sums of gains and
losses. A new bar costs one step of the sums, whatever the length of the
history, and nothing older is ever read again. The state lives in RocksDB; the
`statestore` source reads it as a table, so that other jobs can score symbols
without the scan.

A call to the state and a batch of its answers cost more than the step of a
symbol, so symbols share BUCKETS keys by hash: a micro-batch makes two calls for
each key at most, however many symbols there are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..params import ScanParams
from ..schemas import PRICE_COLUMNS
from ..sources.readers import path_exists

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

VALUES = tuple(PRICE_COLUMNS)
BUNDLE_ROWS = 250_000
SHOWN = 256  # symbols whose tails go out in one batch
BUCKETS = 4096  # keys of the state: one or two symbols each for a whole market, 90 for 360,000 symbols (1.3 MB)
ROW = np.dtype([("us", "<i8"), *((c, "<f8") for c in VALUES)])  # a bar in the state; a missing value is NaN
TAIL_STATE = "symbol string, n bigint, last double, gain double, loss double, through bigint, bars binary"
STATE = f"tails array<struct<{TAIL_STATE}>>"
FOUND = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("first", T.LongType()), T.StructField("opened", T.BooleanType()),
                      T.StructField("us", T.ArrayType(T.LongType())), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in (*VALUES, "rsi"))])
TAIL = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("us", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in VALUES),
                     T.StructField("pos", T.LongType()), T.StructField("n_bars", T.LongType()), T.StructField("rsi", T.DoubleType()), T.StructField("opened", T.BooleanType())])


class Base(NamedTuple):
    """All bars before the tail: their number, last close, decayed gains and losses, time of the last in microseconds."""

    n: int = 0
    last: float | None = None
    gain: float = 0.0
    loss: float = 0.0
    through: int | None = None


def merged(base: Base, known: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Bars in order of time after some more came.

    A bar of a known time replaces the one before; among those that came together the one of greatest values stays.
    Bars from before the tail come too late: their weight in an RSI is below 1e-7.
    """
    if base.through is not None:
        new = new[new["us"] > base.through]
    if not len(new):
        return known
    new = new[np.lexsort([new[c] for c in reversed(ROW.names)])]
    new = new[np.append(new["us"][1:] != new["us"][:-1], True)]
    if not len(known) or known["us"][-1] < new["us"][0]:
        return np.concatenate([known, new])
    both = np.concatenate([known[~np.isin(known["us"], new["us"])], new])
    return both[np.argsort(both["us"])]


def folded(base: Base, bars: np.ndarray, most: int, period: int) -> tuple[Base, np.ndarray, np.ndarray | list[float | None]]:
    """The base after the oldest bars beyond `most`, the other bars, and the RSI at each of them."""
    if not len(bars):
        return base, bars, []
    old, keep, closes = max(0, len(bars) - most), 1 - 1 / period, bars["close"]
    moves = np.diff(closes, prepend=closes[0] if base.last is None else base.last)
    if base.last is None:
        moves[0] = 0.0
    gain, loss, gains, losses = base.gain, base.loss, [], []
    for up, down in zip(np.maximum(moves, 0.0).tolist(), np.maximum(-moves, 0.0).tolist()):
        gain, loss = gain * keep + up, loss * keep + down
        gains.append(gain)
        losses.append(loss)
    up, down = np.array(gains[old:]), np.array(losses[old:])
    with np.errstate(all="ignore"):
        rsi = np.where(down == 0, 100.0, 100.0 - 100.0 / (1.0 + up / down))
    early = min(max(0, period - base.n - old), len(rsi))  # too few bars before them
    now = Base(base.n + old, float(closes[old - 1]), gains[old - 1], losses[old - 1], int(bars["us"][old - 1])) if old else base
    return now, bars[old:], [*[None] * early, *rsi[early:].tolist()] if early else rsi


def advanced(state: tuple | None, came: np.ndarray, most: int, period: int) -> tuple[tuple, Base, np.ndarray, np.ndarray | list[float | None]]:
    """State, base, tail and RSI of a symbol after some bars came."""
    base = Base(*state[:5]) if state else Base()
    known = np.frombuffer(state[5] if state else b"", dtype=ROW)
    base, bars, rsi = folded(base, merged(base, known, came), most, period)
    return (*base, bars.tobytes()), base, bars, rsi


def shown(symbol: str, base: Base, bars: np.ndarray, rsi: np.ndarray | list[float | None], opened: bool) -> Row:
    """The tail of a symbol as FOUND: a row of arrays; missing values are null again."""
    columns = {c: np.ascontiguousarray(bars[c]) for c in VALUES}
    values = {c: [None if x != x else x for x in v.tolist()] if np.isnan(v).any() else v for c, v in columns.items()}
    return Row(symbol=symbol, first=base.n, opened=opened, us=np.ascontiguousarray(bars["us"]), **values, rsi=rsi)


def as_tails(found: DataFrame) -> DataFrame:
    """One row per bar, as TAIL."""
    bars = F.posexplode(F.arrays_zip("us", *VALUES, "rsi")).alias("at", "bar")
    rows = found.select("symbol", "first", F.size("us").alias("n"), "opened", bars)
    return rows.select("symbol", "bar.us", *(f"bar.{c}" for c in VALUES), (F.col("first") + F.col("at")).alias("pos"), (F.col("first") + F.col("n")).alias("n_bars"),
                       "bar.rsi", "opened")


class SymbolTail(StatefulProcessor):
    """Keeps base and tail of the symbols of a bucket as one value; gives the tail of each symbol that got bars.

    A value costs one call to read and one to write, whatever its length: a tail is not moved bar by bar.
    """

    def __init__(self, bars: int, period: int):
        self.most, self.period = bars, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tails", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came: dict[str, tuple[list[bytes], list[bool]]] = {}
        for symbol, bundle, opened, *_ in rows:
            bundles, some = came.setdefault(symbol, ([], []))
            bundles.append(bundle)
            some.append(opened)
        state = self.state.get()
        tails, found = {symbol: (*base, bytes(bars)) for symbol, *base, bars in state[0]} if state else {}, []
        for symbol, (bundles, some) in came.items():
            tails[symbol], base, bars, rsi = advanced(tails.get(symbol), np.frombuffer(b"".join(bundles), dtype=ROW), self.most, self.period)
            found.append(shown(symbol, base, bars, rsi, any(some)))
        self.state.update(([(symbol, *tail) for symbol, tail in tails.items()],))
        yield from found

    def close(self) -> None:
        pass


def as_bars(rows: DataFrame, opened) -> DataFrame:
    """Bars as the state takes them; those without a close count for nothing."""
    return rows.where("symbol is not null and ts is not null and close is not null").select(
        "symbol", F.unix_micros("ts").alias("us"), *(F.col(c).cast("double").alias(c) for c in VALUES), F.coalesce(opened, F.lit(False)).alias("opened"))


def bundled(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The bars of each symbol as one binary of ROWs."""
    table = pa.Table.from_batches(batches).combine_chunks()
    names = table.column("symbol").chunk(0).dictionary_encode()
    number, rows = names.indices.to_numpy(), np.empty(table.num_rows, dtype=ROW)
    for c in ROW.names:
        rows[c] = table.column(c).to_numpy()
    n = len(names.dictionary)
    ends = np.cumsum(np.bincount(number, minlength=n)) * ROW.itemsize
    data = rows[np.argsort(number, kind="stable")].tobytes()
    bars = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, ends).astype("<i4").tobytes()), pa.py_buffer(data)])
    opened = np.bincount(number, weights=table.column("opened").to_numpy(), minlength=n) > 0
    return pa.RecordBatch.from_arrays([names.dictionary, bars, pa.array(opened)], names=["symbol", "bars", "opened"])


def in_bundles(bars: DataFrame, most: int = BUNDLE_ROWS) -> DataFrame:
    """Bars (of `as_bars`) of a micro-batch, those of a symbol together: a row that goes to the state one by one is dear.

    A task looks at `most` bars at a time; a symbol has a bundle for each such portion.
    """
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting, n = [*waiting, batch], n + batch.num_rows
            if n >= most:
                yield bundled(waiting)
                waiting, n = [], 0
        if n:
            yield bundled(waiting)

    return bars.repartition("symbol").mapInArrow(bundle, "symbol string, bars binary, opened boolean")


def symbol_tails(bars: DataFrame, opened, scan: ScanParams = ScanParams()) -> DataFrame:
    """Stream of tails: for each symbol with bars in a micro-batch its last bars as FOUND, which `as_tails` spreads."""
    bundles = in_bundles(as_bars(bars, opened)).withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)))
    return bundles.groupBy("bucket").transformWithState(
        SymbolTail(scan.tail_bars, scan.rsi_period), FOUND, outputMode="Update", timeMode="None")


def stored_tails(spark: SparkSession, checkpoint: str, symbols: DataFrame, new: DataFrame, scan: ScanParams = ScanParams()) -> DataFrame:
    """Tails of some symbols from the state behind a checkpoint, with new bars (of `as_bars`) that it may not know yet.

    However many symbols there are, a task unfolds the tails of SHOWN of them at a time.
    """
    old = spark.createDataFrame([], TAIL_STATE)
    if path_exists(spark, f"{checkpoint}/state/0/_metadata"):
        old = spark.read.format("statestore").option("stateVarName", "tails").load(checkpoint).select(F.explode("value.tails").alias("tail")).select("tail.*")
    some, most, period = symbols.select("symbol").distinct(), scan.tail_bars, scan.rsi_period
    known = old.join(some, "symbol", "left_semi").select("symbol", F.struct(*old.columns[1:]).alias("state"))
    came = in_bundles(new.join(some, "symbol", "left_semi")).groupBy("symbol").agg(F.collect_list("bars").alias("came"), F.max("opened").alias("opened"))

    def refold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, SHOWN) for batch in batches for at in range(0, batch.num_rows, SHOWN)):
            rows = []
            for row in part.to_pylist():
                bundles = np.frombuffer(b"".join(row["came"] or []), dtype=ROW)
                _, base, bars, rsi = advanced(tuple(row["state"].values()) if row["state"] else None, bundles, most, period)
                rows.append(shown(row["symbol"], base, bars, rsi, bool(row["opened"])).asDict())
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(FOUND))

    return as_tails(known.join(came, "symbol", "full").mapInArrow(refold, FOUND))
