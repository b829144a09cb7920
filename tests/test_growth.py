"""What must not grow with the whole tables: rows kept, moved or looked at once more."""

import datetime
import os

import numpy as np
import pandas as pd
import pytest
from dateutil.easter import easter as easter_day
from pyspark.sql import Row
from pyspark.sql import functions as F

from ebbtide.functions.dates import holiday
from ebbtide.operators import joins, picks
from ebbtide.operators import performance as P
from ebbtide.operators.sessions import with_session
from ebbtide.params import PerformanceParams
from ebbtide.plans import jobs
from ebbtide.sources import proxies
from ebbtide.streaming import tails
from ebbtide.streaming.horizon import horizon_stream
from tests.helpers import bars, daily, slow_rsi, walk

PERF = PerformanceParams(benchmark="SPY")


def test_boards_are_of_the_symbols_asked_for(spark):
    b = bars(spark, *[daily(s, [10.0, 11.0, 12.0]) for s in ("SPY", "A", "B", "C")])
    asked = spark.createDataFrame([(1, "A"), (2, "A")], "alert_id long, symbol string")
    own, index = P.price_boards(b, asked, "SPY")
    assert {r.symbol for r in own.select("symbol").distinct().collect()} == {"A"}
    assert index.count() == own.count() == 7  # three days, and four sessions more that show the last


def test_boards_over_gaps_and_borders_of_spans(spark):
    """One row for each session that has a fact or follows one closely, whatever the cut."""
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2019-01-01", periods=900)
    rows = pd.concat([pd.DataFrame({"symbol": s, "ts": np.sort(rng.choice(days, n, replace=False)) + pd.to_timedelta(rng.integers(0, 86400, n), unit="s"),
                                    "v": rng.random(n)}) for s, n in (("A", 850), ("B", 90), ("C", 12))])
    facts = spark.createDataFrame(rows, "symbol string, ts timestamp, v double")
    got = {(r.symbol, r["_session"]): (r["_before"] and r["_before"]["_v"], r["_today"] and r["_today"][-1]["_v"])
           for r in joins.boards(facts, "v", 5).collect()}
    have = {(r.symbol, r["_session"]): r.v for r in with_session(facts, "ts").groupBy("symbol", "_session").agg(F.max_by("v", "ts").alias("v")).collect()}
    want = {}
    for symbol, session in {(s, n + k) for s, n in have for k in range(5)}:
        before = [have[symbol, session - k] for k in range(1, 5) if (symbol, session - k) in have]
        want[symbol, session] = (before[0] if before else None, have.get((symbol, session)))
    assert got == want


def test_settled_rows_are_not_joined_again(spark):
    """Only checks without a price in their first run meet a join after it."""
    b = bars(spark, daily("SPY", [100.0] * 9), daily("A", [10.0] * 9))
    a = spark.sql("select id as alert_id, 'A' as symbol, timestamp'2024-01-03' as alert_ts from range(3)")
    settled = P.settle(P.horizon_checks(P.track(a, b, PERF), PERF), b, "2024-01-12 00:00:00", PERF)
    plan = settled._jdf.queryExecution().optimizedPlan().toString()
    ended, later = plan.split("\n+- ", 1)
    assert plan.startswith("Union") and "Join" not in ended and "Join" in later
    assert settled.where("status = 'settled'").count() == 6


def test_the_chain_is_not_moved_whole(spark):
    """Listed expiries are nearly as many as contracts: they are written once and not repeated for a salt."""
    chain = spark.sql("select 'A' as symbol, concat('c', id) as contract_symbol, 'call' as option_type, cast(30 + id % 3 as int) as dte, 100d as strike, 99d as spot, "
                      "0.3d as bid, 0.32d as ask, 0.31d as last, 100L as volume, 900L as open_interest, 0.3d as iv, 'primary' as provider from range(6)")
    b = bars(spark, daily("A", [10.0] * 30))
    for found in (picks.near_calls(chain), jobs.cheap_contracts(b, chain)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode" not in plan.split("Join LeftSemi")[-1] and "_salt" not in plan and "bool_or" not in plan.split("Join LeftSemi")[0]
    assert picks.near_calls(chain).count() == 6 and jobs.cheap_contracts(b, chain).count() == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_contracts_are_spread_while_lines_are_narrow(spark):
    plan = proxies.chain(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RepartitionByExpression"):]
    assert "AS contract_symbol" in plan and "AS contract_symbol" not in moved and "_salt" not in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_nested_documents_are_stored_compressed(spark):
    from ebbtide.plans.catalog import QUERIES

    files = QUERIES["S10_P5_nested_chain"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all(f.endswith(".json.gz") for f in files)


def test_bars_reach_the_state_in_bundles(spark):
    """A symbol hands the state a bundle for each portion of a task, not a row for each bar; nothing is lost on the way."""
    b = tails.as_bars(bars(spark, *[daily(s, np.arange(1.0, 91.0)) for s in ("A", "B", "C")]).withColumn(
        "volume", F.when(F.dayofmonth("ts") > 3, F.col("volume"))), F.col("symbol") == "B")
    whole = tails.in_bundles(b).collect()
    assert len(whole) == 3 and {r.symbol: r.opened for r in whole} == {"A": False, "B": True, "C": False}
    cut = tails.in_bundles(b.repartition(7), most=1).collect()
    for found in (whole, cut):
        rows = sorted((r.symbol, *(None if x != x else x for x in bar)) for r in found for bar in np.frombuffer(r.bars, dtype=tails.ROW).tolist())
        assert rows == sorted(tuple(r) for r in b.drop("opened").collect())


def test_a_tail_is_one_value_of_the_state():
    """A step of the state reads and writes one value, however long the tail."""
    class Value:
        calls, value = 0, None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    step = tails.SymbolTail(250, 14)
    step.state = Value()
    day, closes = 86_400_000_000, walk(3, 400)
    for lo, hi in ((0, 300), (290, 400), (100, 120)):  # ten bars come twice, twenty come too late
        came = np.array([(k * day, c, c, c, c, 1.0) for k, c in enumerate(closes)][lo:hi], dtype=tails.ROW)[::-1]
        row = next(step.handleInputRows(("A",), iter([Row(symbol="A", bars=came.tobytes(), opened=True)]), None))
    assert step.state.calls == 6 and row["first"] == 150 and list(row["us"]) == [k * day for k in range(150, 400)]
    assert list(row["close"]) == list(closes[150:]) and row["rsi"] == pytest.approx(list(slow_rsi(closes)[150:]), rel=1e-9)


def test_holidays_look_only_at_rules_of_their_month(spark):
    """Each rule stands behind a test of the month, which finds the same days."""
    days = spark.sql("select explode(sequence(date'1990-01-01', date'2035-12-31')) as day")
    got = {r.day: r.h for r in days.select("day", holiday(F.col("day")).alias("h")).where("h is not null").collect()}
    fridays = {easter_day(y) - datetime.timedelta(days=2) for y in range(1990, 2036)}
    assert {d for d, h in got.items() if h == "good_friday"} == fridays
    assert sum(h == "juneteenth" for h in got.values()) == 14 and sum(h == "thanksgiving" for h in got.values()) == 46
    assert str(holiday(F.col("day"))).count("month(") >= 10


def test_horizon_batches_judge_due_checks_and_keep_prices_asked_for(spark, tmp_path):
    """A check far from its due time meets no price and no join; bars of symbols without checks are not kept."""
    b = bars(spark, *[daily(s, [10.0] * 40) for s in ("SPY", "A", "B")])
    a = spark.sql("select id as alert_id, 'A' as symbol, timestamp'2024-01-03' + make_interval(0, 0, 0, cast(id * 20 as int)) as alert_ts from range(2)")
    checks = P.horizon_checks(P.track(a, b, PERF), PERF)
    source, pending = str(tmp_path / "in"), str(tmp_path / "pending")
    b.where("ts < '2024-01-12'").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(b.schema).parquet(source)
    horizon_stream(stream, checks, str(tmp_path / "prices"), str(tmp_path / "out"), pending, str(tmp_path / "ckpt"), PERF).awaitTermination()
    read = lambda path: spark.read.parquet(str(path))
    assert sorted(r.alert_id for r in read(f"{pending}-judged/batch=0").collect()) == [0, 0]
    assert sorted(r.alert_id for r in read(f"{pending}/batch=0").collect()) == [1, 1]
    assert {r.symbol for r in read(tmp_path / "prices" / "batch=0").collect()} == {"SPY", "A"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_the_contract_gate_runs_once_for_all_slices(spark):
    from ebbtide.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    QUERIES["T2_T3_alert_stream"](spark, folder)
    gated, cut = (spark.read.parquet(proxies.stored_path(spark, folder, name) + more) for name, more in (("gated_alerts", ""), ("gated_alerts in slices", "/*")))
    assert cut.exceptAll(gated).isEmpty() and gated.exceptAll(cut).isEmpty() and not gated.isEmpty()


def test_symbols_of_a_bucket_share_the_calls_of_the_state():
    """Ten symbols cost as many calls as one; what each gives is what it gives alone, also when only some get bars."""
    class Value:
        calls, value = 0, None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    def came(symbol, lo, hi):
        closes = walk(symbol, 40)
        return np.array([(k, c, c, c, c, float("nan")) for k, c in enumerate(closes)][lo:hi], dtype=tails.ROW).tobytes()

    def run(symbols):
        step = tails.SymbolTail(20, 14)
        step.state = Value()
        out = []
        for lo, hi, chosen in ((0, 10, symbols), (10, 30, symbols[::2]), (30, 40, symbols)):
            rows = [Row(symbol=f"S{s}", bars=came(s, *part), opened=part[0] == lo, bucket=1) for s in chosen for part in ((lo, hi - 3), (hi - 3, hi))]
            out += [{k: list(v) if hasattr(v, "__len__") and not isinstance(v, str) else v for k, v in r.asDict().items()} for r in step.handleInputRows((1,), iter(rows), None)]
        return step.state.calls, out

    calls, together = run(list(range(10)))
    assert calls == 6 and len(together) == 25 and all(r["opened"] for r in together)
    for s in (0, 2, 8):
        alone = run([s])
        assert alone[0] == 6 and alone[1] == [r for r in together if r["symbol"] == f"S{s}"]
    assert [r["first"] for r in together if r["symbol"] == "S2"] == [0, 10, 20] and [r["first"] for r in together if r["symbol"] == "S3"] == [0, 0]
    last = [r for r in together if r["symbol"] == "S2"][-1]
    assert last["rsi"] == pytest.approx(list(slow_rsi(walk(2, 40))[20:]), rel=1e-9) and last["volume"] == [None] * 20
    first = next(r for r in together if r["symbol"] == "S2")
    assert first["rsi"] == [None] * 10
