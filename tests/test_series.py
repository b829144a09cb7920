import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import series as S
from ebbtide.operators.indicators import indicator_series
from ebbtide.operators.joins import boards, asof, lookup, recent, restrict
from ebbtide.params import SeriesParams

from .helpers import bars, daily, slow_pivots, slow_rsi, walk

SMALL = SeriesParams(chunk_days=40, block_rows=256)


@pytest.fixture(scope="module")
def frames():
    # One symbol holds most rows, one is short, one flat, one has a long pause.
    paused = pd.concat([daily("GAP", walk(3, 40)), daily("GAP", walk(4, 60), start="2025-06-02")])
    return [daily("HOT", walk(1, 1500), start="2018-01-02"), daily("SHORT", walk(2, 12)),
            daily("FLAT", np.full(300, 7.0)), paused]


@pytest.fixture(scope="module")
def cut(spark, frames):
    """All indicators with many chunks and several blocks per symbol."""
    got = indicator_series(bars(spark, *frames), series=SMALL).toPandas().sort_values(["symbol", "pos"])
    return {s: g.reset_index(drop=True) for s, g in got.groupby("symbol")}


def test_every_bar_comes_back_once(cut, frames):
    for f in frames:
        g = cut[f["symbol"].iloc[0]]
        assert g["pos"].tolist() == list(range(len(f))) and set(g["n_bars"]) == {len(f)}


def test_rsi_equals_the_exponential_means(cut, frames):
    for f in frames:
        close = f["close"].reset_index(drop=True)
        np.testing.assert_allclose(cut[f["symbol"].iloc[0]]["rsi"].astype(float), slow_rsi(close), rtol=1e-9, equal_nan=True)


def test_flat_series_has_rsi_100(cut):
    assert cut["FLAT"]["rsi"].iloc[-1] == 100.0


def test_frames_equal_pandas_rolling(cut, frames):
    for f in frames:
        g, close = cut[f["symbol"].iloc[0]], f["close"].reset_index(drop=True)
        mid, dev = close.rolling(20).mean(), close.rolling(20).std(ddof=0)
        want = {"bb_lower": mid - 2 * dev, "bb_upper": mid + 2 * dev, "sma50": close.rolling(50).mean(),
                "roll_low": close.rolling(252, min_periods=60).min(), "roll_high": close.rolling(252, min_periods=60).max(),
                "change_20": close / close.shift(20) - 1,
                "best_ahead": close[::-1].rolling(30).max()[::-1].shift(-1)}
        for name, series in want.items():
            np.testing.assert_allclose(g[name].astype(float), series, rtol=1e-9, atol=1e-7, equal_nan=True, err_msg=name)


def test_pivots_equal_the_definition(cut, frames):
    for f in frames:
        g = cut[f["symbol"].iloc[0]]
        assert g.index[g["pivot_low"]].tolist() == slow_pivots(f["low"], 3, False)
        assert g.index[g["pivot_high"]].tolist() == slow_pivots(f["high"], 3, True)


def test_cutting_does_not_change_results(spark, frames, cut):
    whole = indicator_series(bars(spark, *frames), series=SeriesParams(chunk_days=100_000, block_rows=100_000))
    whole = whole.toPandas().sort_values(["symbol", "pos"])
    for s, g in whole.groupby("symbol"):
        pd.testing.assert_frame_equal(g.reset_index(drop=True), cut[s], check_exact=False, rtol=1e-9)


@pytest.mark.parametrize(("n", "freq"), [(26_280, "h"), (10_000, "min")])
def test_long_chunks_of_hours_and_minutes(spark, n, freq):
    """Three years of round-the-clock hours and a week of minutes with the default cut; a long flat stretch keeps its ratio."""
    close = walk(8, n)
    close[5000:9000] = close[4999]
    one = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=n, freq=freq), "close": close, "volume": 1.0})
    for c in ("open", "high", "low"):
        one[c] = close
    got = indicator_series(bars(spark, one[["symbol", "ts", "open", "high", "low", "close", "volume"]]), only=("rsi",))
    got = got.toPandas().sort_values("pos")["rsi"].to_numpy(dtype=float)
    gain = loss = 0.0
    for i, move in enumerate(np.diff(close), 1):
        gain, loss = gain * 13 / 14 + max(move, 0), loss * 13 / 14 + max(-move, 0)
        if i >= 14:
            assert got[i] == pytest.approx(100 * gain / (gain + loss), rel=1e-9), i


def test_block_must_cover_the_frame(spark, frames):
    with pytest.raises(ValueError):
        indicator_series(bars(spark, *frames), series=SeriesParams(block_rows=100))


def test_running_sum_and_last_known(spark):
    rng = np.random.default_rng(5)
    n = 400
    raw = pd.DataFrame({"symbol": np.where(rng.random(n) < 0.7, "HOT", "B"), "id": np.arange(n),
                        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 3000, n), unit="h"),
                        "v": rng.integers(-5, 6, n)})
    raw["tag"] = np.where(rng.random(n) < 0.2, raw["id"].astype(str), None)
    df = S.add_chunk(spark.createDataFrame(raw), days=7)
    got = S.running_sum(df, "v", "total", ["ts", "id"])
    got = S.last_known(got, F.col("tag"), "seen", ["ts", "id"]).toPandas().sort_values(["symbol", "ts", "id"])
    want = raw.sort_values(["symbol", "ts", "id"])
    assert got["total"].tolist() == want.groupby("symbol")["v"].cumsum().tolist()
    seen = want.groupby("symbol")["tag"].transform(lambda s: s.ffill().shift(1).ffill())
    assert [x or None for x in got["seen"]] == [None if pd.isna(x) else x for x in seen]


def test_asof_and_recent_against_pandas(spark):
    rng = np.random.default_rng(9)
    facts = pd.DataFrame({"symbol": rng.choice(["HOT", "B"], 80, p=[0.8, 0.2]), "value": rng.random(80),
                          "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.choice(4000, 80, replace=False), unit="h")})
    rows = pd.DataFrame({"symbol": rng.choice(["HOT", "B", "NONE"], 300), "id": np.arange(300),
                         "at": pd.Timestamp("2023-12-25") + pd.to_timedelta(rng.integers(0, 4500, 300), unit="h")})
    r, f = spark.createDataFrame(rows), spark.createDataFrame(facts)
    closed = pd.to_datetime(["2023-12-25", "2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04"])
    calendar = pd.date_range("2023-12-01", "2024-08-01")
    session = pd.Series(((calendar.dayofweek < 5) & ~calendar.isin(closed)).cumsum(), index=calendar)
    age = lambda at, ts: session[at.normalize()] - session[ts.normalize()]
    for days, got in ((None, asof(r, f, "value", "v", "at", part_rows=7)), (5, recent(r, boards(f, "value", 5), "v", "at"))):
        want = {}
        for row in rows.itertuples():
            past = facts[(facts.symbol == row.symbol) & (facts.ts <= row.at)]
            if days:
                past = past[[age(row.at, t) < days for t in past.ts]]
            want[row.id] = past.sort_values("ts")["value"].iloc[-1] if len(past) else None
        have = {x.id: x.v for x in got.collect()}
        assert have == want


def test_lookup_and_restrict_keep_every_row(spark):
    rows = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 'HOT' else concat('S', id % 7) end as symbol")
    small = spark.createDataFrame([("HOT", 1.0), ("S1", 2.0)], "symbol string, price double")
    joined = lookup(rows, small, ["symbol"], "id")
    assert joined.count() == rows.join(small, "symbol").count()
    assert lookup(rows, small, ["symbol"], "id", "left").count() == 1000
    assert restrict(rows, small, "id").select("id").distinct().count() == joined.count()


def test_carry_over_many_chunks_and_dense_keys(spark):
    """One bar in most chunks, hundreds in others: more chunks than a run of composed maps has, and chunks cut finer."""
    rng = np.random.default_rng(3)
    n = 900
    close = np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), 2)
    days = np.concatenate([np.arange(300) * 3, 900 + np.arange(600) / 1000])
    frame = pd.DataFrame({"symbol": "A", "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(days, unit="D"), "open": close, "high": close, "low": close, "close": close, "volume": 1.0})
    df = bars(spark, frame)
    got = S.with_positions(df, SeriesParams(chunk_days=3), rsi_period=14).toPandas().sort_values("pos")
    assert got["rsi"].to_numpy()[14:] == pytest.approx(slow_rsi(close)[14:], rel=1e-9)
    assert S.bounded_days(df, 1024, rows=100) < 1 and S.bounded_days(df, 1024, rows=1000) == 1024 and S.bounded_days(df.limit(0), 7) == 7
