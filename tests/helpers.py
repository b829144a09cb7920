"""Small frames and slow, plain answers to compare with."""

import numpy as np
import pandas as pd

BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def daily(symbol, closes, start="2024-01-02", low=0.99, high=1.01):
    ts = pd.bdate_range(start, periods=len(closes))
    closes = np.asarray(closes, dtype=float)
    return pd.DataFrame({"symbol": symbol, "ts": ts, "open": closes, "high": closes * high, "low": closes * low,
                         "close": closes, "volume": 1_000_000.0})


def bars(spark, *frames):
    return spark.createDataFrame(pd.concat(frames, ignore_index=True), BARS)


def walk(seed, n, start=50.0):
    rng = np.random.default_rng(seed)
    return np.round(start * np.exp(np.cumsum(rng.normal(0, 0.02, n))), 2)


def slow_rsi(close, period=14):
    """By the definition: all moves so far, each weighted by a power of 13/14."""
    prices, keep = np.asarray(close, dtype=float), 1 - 1 / period
    out = np.full(len(prices), np.nan)
    for i in range(period, len(prices)):
        moves, weight = np.diff(prices[:i + 1]), keep ** np.arange(i - 1, -1, -1)
        rises, falls = (weight * np.maximum(moves, 0)).sum(), (weight * np.maximum(-moves, 0)).sum()
        out[i] = 100 * rises / (rises + falls) if falls else 100.0
    return pd.Series(out)


def slow_pivots(values, order, highs):
    sign = -1.0 if highs else 1.0
    v = sign * np.asarray(values)
    return [i for i in range(order, len(v) - order)
            if all(v[i] < v[j] for j in range(i - order, i + order + 1) if j != i)]


def path(*stretches):
    """Prices from (first, last, bars) lines and (middle, swing, bars, "swing") stretches that alternate around a middle."""
    pieces = []
    for a, b, n, *kind in stretches:
        pieces.append([a + (b if k % 2 == 0 else -b) for k in range(n)] if kind else [a + (b - a) * k / (n - 1) for k in range(n)])
    return np.array([x for piece in pieces for x in piece])


# The shapes of the rebound cases.
FALL, RISE, CALM = (12.5, 8.0, 10), (8.0, 12.5, 15), (12.5, 0.15, 60, "swing")
DIPS_AND_REBOUNDS = [FALL, RISE, CALM] * 7 + [(12.5, 8.4, 8)]
