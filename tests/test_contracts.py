import math
import random

import pytest
from pyspark.sql import functions as F

from ebbtide.functions.numeric import norm_cdf, round_cents, with_greeks
from ebbtide.operators import picks, quotes
from ebbtide.params import SCREEN_PRESETS, ContractParams, ScreenParams
from ebbtide.sources import readers
from ebbtide.schemas import NESTED_CHAIN

BASE = dict(symbol="TEST", contract_symbol="C", option_type="call", dte=21, strike=100.0, spot=100.0, bid=1.00, ask=1.05,
            last=1.0, volume=500, open_interest=1000, iv=0.30, delta=0.45, theta=-0.03, provider="primary")
KIND = ("symbol string, contract_symbol string, option_type string, dte int, strike double, spot double, bid double, ask double, "
        "last double, volume double, open_interest double, iv double, delta double, theta double, provider string")
ORDER = [c.split()[0] for c in KIND.split(", ")]


def chain(spark, *rows):
    full = [{**BASE, "contract_symbol": f"C{i:03d}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(float(r[c]) if c in ("volume", "open_interest") and r[c] is not None else r[c]
                                        for c in ORDER) for r in full], KIND)


# Each row changes one thing on a contract that passes.
SCREEN_CASES = [
    ({}, True), ({"volume": 5}, False), ({"open_interest": 10}, False), ({"ask": 1.60}, False), ({"iv": 0.05}, False),
    ({"iv": 1.50}, False), ({"delta": 0.05}, False), ({"delta": 0.95}, False), ({"option_type": "put", "delta": -0.45}, True),
    ({"dte": 1}, False), ({"dte": 100}, False), ({"bid": 0.0}, False), ({"theta": -0.20}, False), ({"ask": 1.50}, True)]


def test_screener_predicate_one_threshold_at_a_time(spark):
    rows = quotes.screener_numbers(chain(spark, *[c for c, _ in SCREEN_CASES])).withColumn(
        "theta_pct", F.abs("theta") / F.col("mid"))
    p = ScreenParams()
    got = rows.select("contract_symbol", (quotes.screener_quote_part(p) & quotes.screener_greek_part(p)).alias("ok")).orderBy("contract_symbol")
    assert [r.ok for r in got.collect()] == [ok for _, ok in SCREEN_CASES]
    free = ScreenParams(max_theta_pct=None)
    burning = rows.where(F.col("theta") == -0.20).select(quotes.screener_greek_part(free).alias("ok"))
    assert burning.first().ok


def test_presets_differ():
    assert SCREEN_PRESETS["cli"].max_spread_pct == 0.10 and SCREEN_PRESETS["library"].max_spread_pct == 0.40


def slow_greeks(s, k, t, r, v, kind, q=0.0):
    n = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    d1 = (math.log(s / k) + (r - q + v * v / 2) * t) / (v * math.sqrt(t))
    d2 = d1 - v * math.sqrt(t)
    decay = -s * math.exp(-q * t) * math.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) * v / (2 * math.sqrt(t))
    if kind == "call":
        return math.exp(-q * t) * n(d1), (decay - r * k * math.exp(-r * t) * n(d2) + q * s * math.exp(-q * t) * n(d1)) / 365
    return math.exp(-q * t) * (n(d1) - 1), (decay + r * k * math.exp(-r * t) * n(-d2) - q * s * math.exp(-q * t) * n(-d1)) / 365


def test_greeks_against_the_error_function(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["call", "put"]), rng.uniform(5, 200), rng.uniform(5, 200), rng.uniform(0.003, 2), rng.uniform(0.05, 1.5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "option_type string, spot double, strike double, t double, iv double")
    for q in (0.0, 0.03):
        for r in with_greeks(df, F.col("t"), F.col("iv"), 0.045, q).collect():
            delta, theta = slow_greeks(r.spot, r.strike, r.t, 0.045, r.iv, r.option_type, q)
            assert r.delta == pytest.approx(delta, abs=1e-13) and r.theta == pytest.approx(theta, abs=1e-12)


def test_greeks_ranges_and_invalid_input(spark):
    rows = [("call", 100.0, 30 / 365), ("put", 100.0, 30 / 365), ("call", 150.0, 30 / 365), ("put", 150.0, 30 / 365), ("call", 100.0, 0.0)]
    df = spark.createDataFrame([(k, s, 100.0, t) for k, s, t in rows], "option_type string, spot double, strike double, t double")
    zero = with_greeks(df, F.col("t"), F.lit(0.25), 0.045, invalid=0.0).collect()
    assert 0.45 < zero[0].delta < 0.65 and zero[0].theta < 0 and -0.65 < zero[1].delta < -0.35
    assert zero[2].delta > 0.9 and zero[3].delta > -0.1 and (zero[4].delta, zero[4].theta) == (0.0, 0.0)
    assert with_greeks(df, F.col("t"), F.lit(0.25), 0.045).collect()[4].delta is None


def test_normal_law_in_the_tails(spark):
    xs = [i / 7 for i in range(-280, 281)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", norm_cdf(F.col("x")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=3e-16)


def test_cents_round_like_exact_half_even(spark):
    rng = random.Random(1)
    xs = [1.005, 1.025, 1.035, 2.675, 0.125, 0.375, 1e6 + 0.005] + [rng.randint(0, 10**7) / 1000 for _ in range(3000)]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", round_cents(F.col("x")).alias("y")).collect():
        assert r.y == round(r.x, 2)


def test_quote_normalisation_edges(spark):
    nan = float("nan")
    c = chain(spark, {}, {"bid": 0.0, "ask": 0.0, "last": 2.345}, {"bid": 0.0, "ask": 0.0, "last": 0.0}, {"volume": 5, "open_interest": 14},
              {"bid": 2.0, "ask": 1.0, "last": 1.5}, {"bid": nan, "ask": None, "last": 1.25}, {"volume": nan, "open_interest": 20},
              {"iv": nan})
    got = {r.contract_symbol: r for r in quotes.call_greeks(quotes.normalize_quotes(c.drop("delta", "theta"))).collect()}
    assert set(got) == {"C000", "C001", "C004", "C005", "C006", "C007"}
    assert (got["C000"].premium, got["C000"].estimated, got["C000"].breakeven) == (1.02, False, 101.05)
    assert got["C000"].spread_pct == pytest.approx(0.05 / 1.025)
    for name, last in (("C001", 2.345), ("C004", 1.5), ("C005", 1.25)):
        r = got[name]
        assert r.estimated and r.spread_pct is None and r.bid == r.ask == last
    assert got["C006"].volume == 0 and got["C007"].delta is None


BOTTOM = [({}, True), ({"strike": 10.15}, True), ({"strike": 10.5}, False), ({"premium": 3.05}, False), ({"dte": 29}, False),
          ({"dte": 366}, False), ({"dte": 30}, True), ({"dte": 365}, True)]


def test_bottom_call_boundaries_and_labels(spark):
    base = {"strike": 9.0, "dte": 90, "premium": 2.5, "spot": 10.0}
    rows = [{**base, **c, "k": i} for i, (c, _) in enumerate(BOTTOM)]
    df = spark.createDataFrame([(r["k"], r["strike"], r["dte"], r["premium"], r["spot"]) for r in rows],
                               "k int, strike double, dte int, premium double, spot double")
    assert [r.ok for r in df.select("k", quotes.bottom_call().alias("ok")).orderBy("k").collect()] == [ok for _, ok in BOTTOM]
    labels = spark.createDataFrame([(9.0, 10.0), (9.9, 10.0), (10.1, 10.0)], "strike double, spot double")
    assert [r.m for r in labels.select(quotes.moneyness(0.02).alias("m")).collect()] == ["ITM", "ATM", "ATM"]


def test_relaxed_tier_only_without_a_strict_call(spark):
    good = {"delta": 0.7, "iv": 0.3, "ask": 1.05}
    c = chain(spark, {**good, "symbol": "A", "open_interest": 600}, {**good, "symbol": "A", "open_interest": 9000, "iv": 0.45},
              {**good, "symbol": "B", "iv": 0.45, "open_interest": 700}, {**good, "symbol": "B", "volume": 60, "open_interest": 700, "ask": 1.04},
              {**good, "symbol": "D", "iv": 0.50}, {**good, "symbol": "E", "ask": 1.2}).withColumn("spread_pct", (F.col("ask") - 1) / ((F.col("ask") + 1) / 2))
    got = {r["symbol"]: (r.contract_symbol, r.relaxed) for r in picks.best_calls(c).collect()}
    assert got == {"A": ("C000", False), "B": ("C003", True)}


def test_contract_names(spark):
    names = ["ABC261218C00005000", "abc261218C00005000", "ABC261318C00005000", "ABC261218P00012500", "ABCD261218C00005000",
             "ABC261218X00005000", "ABC26121C00005000"]
    docs = spark.createDataFrame([("abc", ([(n, 1.0, 1.1, 1.0, 10.0, 10.0, 0.3) for n in names],))], NESTED_CHAIN)
    rows = readers.explode_chain(docs).select("contract_symbol", "option_type", "strike", F.col("expiry").cast("string").alias("e")).collect()
    assert [(r.contract_symbol, r.option_type, r.strike, r.e) for r in rows] == [
        ("ABC261218C00005000", "call", 5.0, "2026-12-18"), ("ABC261218P00012500", "put", 12.5, "2026-12-18")]


def test_provider_outcomes(spark):
    c = chain(spark, {"symbol": "P"}, {"symbol": "S", "provider": "secondary"}, {"symbol": "PUT", "provider": "secondary", "option_type": "put"},
              {"symbol": "FAR", "dte": 200}, {"symbol": "DOWN"}, {"symbol": "BOTH"}, {"symbol": "BOTH", "provider": "secondary"})
    asked = spark.createDataFrame([(s,) for s in ("P", "S", "PUT", "FAR", "DOWN", "BOTH", "NONE", "DEAD")], "symbol string")
    down = spark.createDataFrame([("DOWN", "primary"), ("BOTH", "primary"), ("DEAD", "primary"), ("DEAD", "secondary")], "symbol string, provider string")
    got = {r["symbol"]: (r.outcome, r.provider) for r in picks.provider_outcomes(picks.listings(c), 91, failed=down, symbols=asked).collect()}
    assert got == {"P": ("has_contracts", "primary"), "S": ("has_contracts", "secondary"), "PUT": ("no_near_term", None),
                   "FAR": ("no_near_term", None), "DOWN": ("none_listed", None), "BOTH": ("has_contracts", "secondary"),
                   "NONE": ("none_listed", None), "DEAD": ("failed", None)}


@pytest.mark.parametrize("n", [1, 5, 6, 7, 12, 30, 91])
def test_even_expiry_sample(spark, n):
    days = [3 * i + 1 for i in range(n)]
    listed = spark.createDataFrame([("A", "primary", d, True) for d in days] + [("A", "secondary", d, True) for d in days],
                                   "symbol string, provider string, dte int, has_call boolean")
    rows = picks.sampled_expiries(listed, 6).collect()
    step = (n - 1) / 5
    want = days if n <= 6 else [days[round(i * step)] for i in range(6)]
    assert sorted(r.dte for r in rows if r.provider == "primary") == sorted(set(want))
    assert sorted(r.dte for r in rows if r.provider == "secondary") == days


def test_top_calls_and_sort_keys(spark):
    c = chain(spark, *[{"open_interest": oi, "ask": a, "bid": 0.4} for oi, a in ((10, 0.5), (30, 0.6), (30, 0.5), (20, 0.5))])
    rows = c.withColumn("premium", F.lit(0.45))
    assert [r.contract_symbol for r in picks.cheap_calls(rows, 50.0).orderBy("rank").collect()] == ["C002", "C001", "C003"]
    assert picks.cheap_calls(rows, 44.0).count() == 0
    screened = c.withColumn("spread_pct", F.lit(None).cast("double"))
    for key in picks.SORT_KEYS:
        assert picks.top_contracts(screened, key, 2).count() == 2


def test_cap_of_the_window_and_params(spark):
    assert ContractParams().window_days == 13 * 7
    c = chain(spark, {"dte": 0}, {"dte": 91}, {"dte": 92}, {"dte": -1})
    assert c.where(quotes.in_window(91)).count() == 2
