import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import signals
from ebbtide.operators.patterns import cluster_levels, scan_features
from ebbtide.operators.rebound import best_rebounds, rebound_stats
from ebbtide.params import ReboundParams, ScanParams, SeriesParams

from .helpers import DIPS_AND_REBOUNDS, bars, daily, path, slow_pivots, slow_rsi, walk

SMALL = SeriesParams(chunk_days=60, block_rows=256)


def slow_support(low, close):
    low = low[-250:]
    prices = sorted(low[i] for i in slow_pivots(low, 3, False))
    if len(prices) < 2:
        return None
    groups = []
    for p in prices:
        if groups and p <= groups[-1][0] * 1.01:
            groups[-1].append(p)
        else:
            groups.append([p])
    for g in groups:
        level = sum(g) / len(g)
        if len(g) >= 2 and (0 <= (close - level) / level <= 0.015 or 0 <= (level - close) / level <= 0.005):
            return level
    return None


def slow_wedge(high, low, close):
    high, low = high[-120:], low[-120:]
    n = len(high)
    hp, lp = slow_pivots(high, 3, True)[-4:], slow_pivots(low, 3, False)[-4:]
    if min(len(hp), len(lp)) < 2:
        return "no_pivots"
    (hs, hi), (ls, li) = np.polyfit(hp, high[hp], 1), np.polyfit(lp, low[lp], 1)
    if n - 1 - min(hp[0], lp[0]) < 20:
        return "too_short"
    if not (hs < 0 and ls < 0 and hs < ls):
        return "not_falling"
    if (li - hi) / (hs - ls) <= n - 1:
        return "crossed"
    inside = ls * (n - 1) + li - 0.005 * close <= close <= hs * (n - 1) + hi + 0.005 * close
    return "wedge" if inside else "outside"


@pytest.fixture(scope="module")
def random_walks():
    rng = np.random.default_rng(11)
    out = []
    for k in range(60):
        n = int(rng.integers(5, 600))
        f = daily(f"R{k}", walk(100 + k, n, 20.0))
        f["low"] = (f["close"] * (1 - rng.random(n) * 0.02)).round(3)
        f["high"] = (f["close"] * (1 + rng.random(n) * 0.02)).round(3)
        out.append(f)
    # A narrowing fall that the wedge test must accept.
    x = np.arange(130)
    upper, lower = 60 - 0.20 * x, 45 - 0.08 * x
    closes = np.where((x // 5) % 2 == 0, upper - 0.3, lower + 0.3) + 0.01 * (x % 5)
    out.append(daily("WEDGE", closes, low=1.0, high=1.0))
    return out


def test_features_equal_plain_computation(spark, random_walks):
    got = {r["symbol"]: r for r in scan_features(bars(spark, *random_walks), series=SMALL).collect()}
    states = set()
    for f in random_walks:
        r, close = got[f["symbol"].iloc[0]], f["close"].iloc[-1]
        want = slow_support(f["low"].to_numpy(), close)
        assert (r.support_level is None) == (want is None)
        if want is not None:
            assert r.support_level == pytest.approx(want, rel=1e-12)
        assert r.wedge_state == slow_wedge(f["high"].to_numpy(), f["low"].to_numpy(), close)
        states.add(r.wedge_state)
        rsi = slow_rsi(f["close"]).iloc[-1]
        assert (r.rsi is None) if np.isnan(rsi) else r.rsi == pytest.approx(rsi, rel=1e-9)
    assert {"no_pivots", "not_falling", "crossed", "outside", "wedge"} <= states


def test_cluster_anchor_is_the_first_price(spark):
    # 100.9 joins 100, 101.5 does not although it is within 1 % of 100.9.
    df = spark.createDataFrame([([100.0, 100.9, 101.5, 102.0, 200.0],)], "lows array<double>")
    levels = df.select(cluster_levels(F.col("lows"), 0.01, 2).alias("v")).first().v
    assert levels == pytest.approx([100.45, 101.75])


def test_score_signature_and_thresholds(spark):
    falling = np.concatenate([np.full(30, 50.0), 50 - np.cumsum(np.linspace(0.2, 1.5, 20))])
    scored = signals.score(scan_features(bars(spark, daily("DOWN", falling), daily("UP", np.linspace(30, 60, 50)))))
    rows = {r["symbol"]: r for r in scored.collect()}
    assert rows["DOWN"].signature == "bollinger,rsi" and rows["DOWN"].score == 2
    assert rows["UP"].score == 0 and rows["UP"].signature == ""
    assert [r["symbol"] for r in signals.signals(scored, ScanParams(signal_score=2)).collect()] == ["DOWN"]
    assert signals.signals(scored).count() == 0
    assert [r["symbol"] for r in signals.hot_symbols(scored).collect()] == ["DOWN"]
    assert "RSI=" in rows["DOWN"].reasons["rsi"]


def test_liquidity_gate_skips_missing_volume(spark):
    a, b, c = daily("A", np.full(25, 5.0)), daily("B", np.full(25, 1.9)), daily("C", np.full(25, 5.0))
    a.loc[5:, "volume"] = np.nan
    a.loc[24, "volume"] = 30_000.0
    c["volume"] = 29_999.0
    got = {r["symbol"]: r.liquid for r in signals.liquidity(bars(spark, a, b, c)).collect()}
    assert got == {"A": True, "B": False, "C": False}


def test_stats_of_nothing_requested(spark):
    scored = signals.score(scan_features(bars(spark, daily("A", walk(1, 30)))))
    r = signals.scan_stats(spark.createDataFrame([], "symbol string"), scored).first()
    assert (r.total, r.with_data, r.data_ratio) == (0, 0, 1.0)


def test_user_filter_that_raises_does_not_match(spark):
    b = bars(spark, daily("A", walk(1, 40)), daily("B", walk(2, 40)))

    def picky(frame: pd.DataFrame):
        if frame["symbol"].iloc[0] == "B":
            raise RuntimeError("no")
        return len(frame) == 10, f"{len(frame)} bars"

    wide, entry = signals.with_python_filter(scan_features(b), b, "ten", picky, 10)
    rows = {r["symbol"]: r for r in signals.score(wide, filters={"ten": entry}).collect()}
    assert rows["A"].score == 1 and rows["A"].reasons["ten"] == "10 bars" and rows["B"].score == 0


def slow_rebound(close, p=ReboundParams()):
    """Hops from one dip to the first dip at least `gap` bars on."""
    prices, rsi = np.asarray(close, dtype=float), slow_rsi(close)
    dips = np.array([i for i in range(p.first_bar, len(prices) - p.horizon)
                     if rsi[i] < p.dip_rsi or prices[i] <= (1 + p.near_low) * prices[max(0, i + 1 - p.low_window):i + 1].min()], dtype=int)
    gains, at = [], 0
    while at < len(dips):
        here = dips[at]
        gains.append(prices[here + 1:here + 1 + p.horizon].max() / prices[here] - 1)
        at = np.searchsorted(dips, here + p.gap)
    return len(gains), sum(g >= p.min_gain for g in gains), sum(gains)


@pytest.mark.parametrize("rows", [256, 4096])
def test_rebound_cases(spark, rows):
    series = {"FAKE": path(*DIPS_AND_REBOUNDS), "UPUP": path((10, 30, 600)), "DOWN": path((40, 8, 600)),
              "NEW": path((12, 8, 100)), "LONG": walk(77, 1400, 30.0), "LONG2": walk(78, 1300, 30.0)}
    stats = rebound_stats(bars(spark, *[daily(s, c, start="2018-01-02") for s, c in series.items()]),
                          series=SeriesParams(chunk_days=90, block_rows=rows)).cache()
    got = {r["symbol"]: r for r in stats.collect()}
    for s, c in series.items():
        eps, wins, total = slow_rebound(c)
        assert (got[s].episodes, got[s].rebounds) == (eps, wins), s
        if eps:
            assert got[s].avg_gain == pytest.approx(total / eps)
    fake = got["FAKE"]
    assert fake.qualifies and fake.change_20d < 0 and fake.episodes >= 3 and fake.rebound_rate >= 0.6
    assert fake.avg_gain >= 0.08 and fake.score > 0
    assert not got["UPUP"].qualifies and not got["DOWN"].qualifies and not got["NEW"].qualifies
    assert got["DOWN"].declining_now
    assert "FAKE" in [r["symbol"] for r in best_rebounds(stats).collect()]
