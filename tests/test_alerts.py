import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import alerts as A
from ebbtide.operators import performance as P
from ebbtide.operators.series import CHUNK, add_parts
from ebbtide.params import PerformanceParams, ScanParams, SeriesParams, SessionParams
from ebbtide.schemas import ALERT_EVENTS
from ebbtide.streaming.alerts import MEMORY, alert_stream, keyed_alert_stream, memory_step
from ebbtide.streaming.horizon import horizon_stream
from ebbtide.streaming.scan import HISTORY, HOT, hot_lane_stream, in_session, scan_step, scan_stream
from ebbtide.streaming.tails import TAIL, as_bars, stored_tails
from ebbtide.streaming.steps import finished, read_newest, write_version
from ebbtide.streaming.ticks import bar_stream, open_bars, to_bars

from .helpers import BARS, bars, daily, walk


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(21)
    n = 500
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 24 * 120, n)), unit="h")
    return pd.DataFrame({"symbol": rng.choice(["HOT", "B", "C"], n, p=[0.6, 0.3, 0.1]), "ts": ts, "alert_id": np.arange(n),
                         "signature": rng.choice(["bollinger,rsi,support", "rsi,support,wedge"], n, p=[0.9, 0.1])})


def slow_memory(events, hours=24):
    memory, sent = {}, []
    for e in events.sort_values(["ts", "alert_id"]).itertuples():
        known = memory.get(e.symbol)
        if known is None or known[0] != e.signature or e.ts - known[1] > pd.Timedelta(hours=hours):
            memory[e.symbol] = (e.signature, e.ts)
            sent.append(e.alert_id)
    return sorted(sent)


def test_memory_equals_the_plain_loop(spark, events):
    got = A.alert_memory(spark.createDataFrame(events))
    assert sorted(r.alert_id for r in got.collect()) == slow_memory(events)
    assert got.where("not changed").count() > 0


def test_unchanged_signal_returns_only_after_the_gap(spark):
    rows = [("A", f"2024-01-0{d} {h}", i, "x") for i, (d, h) in enumerate(
        [(1, "10:00:00"), (1, "10:00:00"), (2, "10:00:00"), (2, "10:00:01"), (3, "09:00:00"), (3, "10:00:02")])]
    df = spark.createDataFrame(rows, "symbol string, ts string, alert_id long, signature string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.alert_id for r in A.alert_memory(df).collect()) == [0, 3, 5]


def _write(spark, frame, folder, name, schema):
    spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


@pytest.mark.parametrize("parts", [1, 4])
def test_alert_stream_replays_like_the_batch(spark, events, tmp_path, parts):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    step = -(-len(events) // parts)
    for k in range(parts):
        _write(spark, events.iloc[k * step:(k + 1) * step], source, f"part={k}", ALERT_EVENTS)
        stream = spark.readStream.schema(ALERT_EVENTS).parquet(f"{source}/*")
        alert_stream(stream, out, str(tmp_path / "memory"), str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(r.alert_id for r in spark.read.parquet(out).collect()) == slow_memory(events)


def test_keyed_alert_stream_replays_like_the_batch(spark, events, tmp_path):
    source = str(tmp_path / "in")
    name = f"keyed_{tmp_path.name.replace('-', '_')}"
    for k in range(2):
        _write(spark, events.iloc[k * 250:(k + 1) * 250], source, f"part={k}", ALERT_EVENTS)
    stream = spark.readStream.schema(ALERT_EVENTS).option("maxFilesPerTrigger", 10).parquet(f"{source}/*")
    q = (keyed_alert_stream(stream).writeStream.outputMode("append").format("memory").queryName(name)
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.alert_id for r in spark.table(name).collect()) == slow_memory(events)


@pytest.mark.parametrize("parts", [1, 3])
def test_scan_stream_ends_like_the_batch_scan(spark, tmp_path, parts):
    """Over several micro-batches, each redelivering the last bar of the one before with other values."""
    frame = pd.concat([daily(f"R{k}", walk(500 + k, 400)) for k in range(6)]).sort_values("ts")
    cuts = np.array_split(np.sort(frame["ts"].unique()), parts)
    source, out, state, params = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), ScanParams(signal_score=1)
    anytime = SessionParams(pause_weekends_and_holidays=False)
    for k, days in enumerate(cuts):
        rows = frame[frame["ts"].isin(days)]
        if k + 1 < parts:
            early = frame[frame["ts"] == cuts[k + 1][0]].assign(close=1.0, low=1.0)
            rows = pd.concat([rows, early])
        _write(spark, rows, source, f"part={k}", BARS)
        stream = spark.readStream.schema(HISTORY).parquet(f"{source}/*")
        scan_stream(stream, out, str(tmp_path / "hot"), state, anytime, params).awaitTermination()
    from ebbtide.operators import signals
    want = signals.signals(signals.scan(bars(spark, frame), params, SeriesParams(chunk_days=30, block_rows=256)), params)
    last = spark.read.parquet(f"{out}/batch={parts - 1}")
    key = lambda df: sorted((r["symbol"], r.signature, r.bar_ts, r.reasons["rsi"]) for r in df.collect())
    assert key(last) == key(want) and key(want)
    # The state as a table gives the same tails, with or without the last bars delivered again.
    again = frame[frame["ts"] == frame["ts"].max()]
    tails = stored_tails(spark, state, spark.createDataFrame([("R1",), ("R2",)], "symbol string"), as_bars(spark.createDataFrame(again, BARS), F.lit(True)), params)
    assert tails.columns == TAIL.names and tails.count() == 2 * params.tail_bars and tails.agg(F.max("n_bars")).first()[0] == 400


def test_scan_step_is_gated_and_hot_lane_looks_at_hot_symbols_only(spark, tmp_path):
    falling = np.concatenate([np.full(30, 50.0), 50 - np.cumsum(np.linspace(0.2, 1.5, 20))])
    history = bars(spark, daily("A", falling), daily("B", falling))
    newest = history.orderBy(F.desc("ts")).limit(2)
    params, anytime = ScanParams(signal_score=2), SessionParams(pause_weekends_and_holidays=False)
    both = spark.createDataFrame([("A",), ("B",)], "symbol string")
    tails = lambda session: stored_tails(spark, str(tmp_path / "none"), both, as_bars(history, in_session(F.col("ts"), session)), params)
    scored, touched = scan_step(tails(SessionParams()), SessionParams(), params)  # midnight UTC is outside the session
    assert touched.count() == 0 and scored.count() == 0
    scored, touched = scan_step(tails(SessionParams()), SessionParams(), params, at="2024-03-04 15:00:00")
    assert touched.count() == 2 and scored.where("score >= 2").count() == 2
    scored, touched = scan_step(tails(anytime), anytime, params)
    assert touched.count() == 2 and scored.where("score >= 2").count() == 2
    source, early, state, hot_list = (str(tmp_path / x) for x in ("in", "early", "state", "hot"))
    newest.coalesce(1).write.parquet(source)
    history.join(newest, ["symbol", "ts"], "left_anti").coalesce(1).write.parquet(early)
    scan_stream(spark.readStream.schema(HISTORY).parquet(early), str(tmp_path / "seen"), hot_list, state, anytime, params).awaitTermination()
    only = both.where("symbol = 'B'")
    write_version(both, hot_list, 1)
    write_version(only, hot_list, 2)
    stream = spark.readStream.schema(HISTORY).parquet(source)
    hot_lane_stream(stream, state, hot_list, str(tmp_path / "out"), str(tmp_path / "ckpt"), anytime, params, every=None).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["symbol"], r.is_hot) for r in rows] == [("B", True)] and rows[0].bar_ts == newest.first().ts
    write_version(only.limit(0), hot_list, 3)
    assert read_newest(spark, hot_list, HOT).isEmpty() and read_newest(spark, str(tmp_path / "none"), HOT).isEmpty()


def test_hot_lane_takes_the_whole_list(spark, tmp_path):
    """More symbols than a list of the first 300 and than a task unfolds at a time; one without state, one with gaps."""
    from ebbtide.operators import signals
    from ebbtide.streaming.tails import SHOWN
    falling = np.concatenate([np.full(30, 50.0), 50 - np.cumsum(np.linspace(0.2, 1.5, 20))])
    names, params = [f"H{k:03d}" for k in range(SHOWN + 60)], ScanParams(signal_score=2)
    anytime = SessionParams(pause_weekends_and_holidays=False)
    gap = (F.col("symbol") == "H007") & F.col("close").between(45, 49)
    frame = bars(spark, *(daily(name, falling) for name in names)).withColumn("volume", F.when(~gap, F.col("volume")))
    is_new = (F.col("ts") >= "2024-03-01") | (F.col("symbol") == "H010")
    source, early, state, hot_list, out = (str(tmp_path / x) for x in ("in", "early", "state", "hot", "out"))
    frame.where(is_new).coalesce(1).write.parquet(source)
    frame.where(~is_new).coalesce(1).write.parquet(early)
    scan_stream(spark.readStream.schema(HISTORY).parquet(early), str(tmp_path / "seen"), hot_list, state, anytime, params).awaitTermination()
    write_version(spark.createDataFrame([(name,) for name in names], "symbol string"), hot_list, 9)
    hot_lane_stream(spark.readStream.schema(HISTORY).parquet(source), state, hot_list, out, str(tmp_path / "ckpt"), anytime, params, every=None).awaitTermination()
    key = lambda df: sorted((r["symbol"], r.signature, r.bar_ts, r.reasons["rsi"]) for r in df.collect())
    want = key(signals.signals(signals.scan(frame, params), params))
    assert len(want) == len(names) and key(spark.read.parquet(out)) == want


def test_half_written_version_does_not_count(spark, tmp_path):
    path, a = str(tmp_path / "hot"), spark.createDataFrame([("A",)], "symbol string")
    write_version(a, path, 0)
    write_version(a.union(a), path, 1)
    (tmp_path / "hot" / "batch=1" / "_SUCCESS").unlink()  # as while its write goes on
    assert read_newest(spark, path, HOT).count() == 1 and finished(spark, path) == [0]


def test_gate_looks_at_scan_time_and_at_dates_of_daily_bars(spark):
    day = lambda d: spark.sql(f"select timestamp'{d}' as ts")
    monday, saturday = day("2024-03-04"), day("2024-03-02")
    is_open = lambda df, session, at=None: df.select(in_session(F.col("ts"), session, at)).first()[0]
    dates = SessionParams(daily_bars=True)
    assert is_open(monday, dates) and not is_open(saturday, dates)
    assert is_open(saturday, SessionParams(), "2024-03-04 15:00:00")
    assert not is_open(monday, SessionParams(), "2024-03-02 15:00:00")


def test_small_parts_and_dense_keys_change_nothing(spark):
    rng = np.random.default_rng(8)
    n = 400
    events = spark.createDataFrame(pd.DataFrame({"symbol": "HOT", "ts": pd.Timestamp("2024-03-01") + pd.to_timedelta(rng.integers(0, 9 * 86400, n), unit="s"),
                                                 "alert_id": np.arange(n), "signature": rng.choice(["a", "b"], n, p=[0.97, 0.03])}))
    key = lambda df: sorted(tuple(r) for r in df.select("symbol", "ts", "alert_id", "signature", "changed").collect())
    assert key(A.alert_memory(events, part_rows=20)) == key(A.alert_memory(events))
    sizes = [r["count"] for r in add_parts(events, rows=20).groupBy(CHUNK).count().collect()]
    assert len(sizes) > 10 and sum(sizes) == n


def test_bar_stream_over_several_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    ticks = pd.DataFrame({"symbol": rng.choice(["A", "B"], 300), "ts": pd.Timestamp("2024-03-01") + pd.to_timedelta(np.sort(rng.integers(0, 86400, 300)), unit="s"),
                          "event_id": np.arange(300), "price": rng.random(300), "size": 10})
    kind = "symbol string, ts timestamp, event_id long, price double, size long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        _write(spark, ticks.iloc[k * 100:(k + 1) * 100], source, f"part={k}", kind)
        bar_stream(spark.readStream.schema(kind).parquet(f"{source}/*"), out, str(tmp_path / "ckpt")).awaitTermination()
    want = to_bars(spark.createDataFrame(ticks, kind)).where(F.col("ts") < F.lit(ticks["ts"].max() - pd.Timedelta(hours=2)))
    key = lambda df: sorted(tuple(r) for r in df.select("symbol", "ts", "open", "high", "low", "close", "volume").collect())
    have = [r for r in key(spark.read.parquet(out)) if r[1] < ticks["ts"].max() - pd.Timedelta(hours=2)]
    assert have == key(want)
    # Together with the windows in the state, every window is there once.
    whole = spark.read.parquet(out).select("symbol", "ts", "open", "high", "low", "close", "volume").unionByName(open_bars(spark, str(tmp_path / "ckpt")))
    assert key(whole) == key(to_bars(spark.createDataFrame(ticks, kind)))


PERF = PerformanceParams(benchmark="SPY")


def _checks(spark):
    def at(symbol, *points):
        return pd.DataFrame([{"symbol": symbol, "ts": pd.Timestamp(t), "open": p, "high": p, "low": p, "close": p, "volume": 1.0} for t, p in points])

    b = bars(spark, at("SPY", *[(f"2024-01-{d:02d}", 100.0 + d) for d in range(1, 25)]),
             at("A", ("2024-01-01", 10.0), ("2024-01-02", 11.0), ("2024-01-04", 9.0)),
             at("GONE", ("2023-12-28", 5.0)), at("LATE", ("2024-01-01", 5.0), ("2024-01-09 01:10:00", 6.0)))
    a = spark.createDataFrame([(1, "A", "2024-01-01 00:00:00", "x"), (2, "GONE", "2024-01-04 12:00:00", "x"), (3, "A", "2024-01-05 00:00:00", "x"),
                               (4, "LATE", "2024-01-05 23:30:00", "x")],
                              "alert_id long, symbol string, alert_ts string, signature string").withColumn("alert_ts", F.to_timestamp("alert_ts"))
    return b, P.horizon_checks(P.track(a, b, PERF), PERF)


def test_checks_settle_give_up_or_wait(spark):
    b, checks = _checks(spark)
    got = {(r.alert_id, r.horizon_h): r for r in P.settle(checks, b, "2024-01-05 13:00:00", PERF).collect()}
    assert (got[1, 24].status, got[1, 24].attempts) == ("settled", 0)
    assert got[1, 24].alpha == pytest.approx((11 / 10 - 1) - (102 / 101 - 1))
    assert got[1, 72].alpha == pytest.approx((9 / 10 - 1) - (104 / 101 - 1))
    assert (got[2, 24].status, got[2, 24].attempts) == ("pending", 3)  # runs at 12:00, 12:30, 13:00; the price is of the sixth session back
    assert got[3, 72].status == "pending" and got[3, 72].attempts == 0
    later = {(r.alert_id, r.horizon_h): r for r in P.settle(checks, b, "2024-01-12 00:00:00", PERF).collect()}
    assert (later[2, 24].status, later[2, 24].attempts, later[2, 24].alpha) == ("gave_up", 8, None)
    # Due 23:30, price back at 01:10 of the next day: found at the fifth run.
    assert (later[4, 72].status, later[4, 72].attempts) == ("settled", 4)
    fold = {r.horizon_h: r.n for r in P.fold(P.settle(checks, b, "2024-01-12 00:00:00", PERF)).collect()}
    assert fold == {24: 3, 72: 3}  # 2024-01-01 is a holiday, so its bar is of the session before, and five sessions old on Saturday the 6th
    text = P.report_text(P.settle(checks, b, "2024-01-06 13:00:00", PERF)).first().text
    assert text.count("\n") == 3
    assert P.compact_line(P.fold(P.settle(checks, b, "2024-01-12 00:00:00", PERF))).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_horizon_stream_closes_what_the_batch_closes(spark, tmp_path, parts):
    b, checks = _checks(spark)
    frame = b.toPandas().sort_values("ts")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, days in enumerate(np.array_split(np.sort(frame["ts"].unique()), parts)):
        _write(spark, frame[frame["ts"].isin(days)], source, f"part={k}", BARS)
        horizon_stream(spark.readStream.schema(HISTORY).parquet(f"{source}/*"), checks, str(tmp_path / "history"), out,
                       str(tmp_path / "pending"), str(tmp_path / "ckpt"), PERF).awaitTermination()
    key = lambda df: sorted((r.alert_id, r.horizon_h, r.status, r.attempts, r.alpha) for r in df.collect())
    closed = P.settle(checks, b, "2024-01-24 00:00:00", PERF)
    assert key(spark.read.parquet(out)) == key(closed.where("status <> 'pending'"))
    summary = lambda df: {r.horizon_h: (r.n, r.wins, round(r.sum_alpha, 9)) for r in df.collect()}
    assert summary(spark.read.parquet(str(tmp_path / "pending-summary") + f"/batch={parts - 1}")) == summary(P.fold(closed))
    if parts > 1:  # five sessions of prices are left, not the history
        assert spark.read.parquet(str(tmp_path / "history") + f"/batch={parts - 1}").agg(F.min("ts")).first()[0] > pd.Timestamp("2024-01-16")


def test_alert_keeps_the_price_it_was_sent_with(spark):
    b = spark.sql("select * from values ('A', timestamp'2024-01-02', 10d), ('SPY', timestamp'2024-01-02', 400d) t(symbol, ts, close)")
    a = spark.sql("select * from values (1L, 'A', timestamp'2024-01-03', 11d), (2L, 'A', timestamp'2024-01-03', null), "
                  "(3L, 'NEW', timestamp'2024-01-03', 7d) t(alert_id, symbol, alert_ts, price)")
    tracked = P.track(a, b, PerformanceParams(benchmark="SPY"))
    assert sorted((r.alert_id, r.alert_price, r.bench_price) for r in tracked.collect()) == [(1, 11.0, 400.0), (2, 10.0, 400.0), (3, 7.0, 400.0)]


def test_subscribers(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "chat_id long")
    approved = spark.createDataFrame([(2, 0), (3, 50), (4, 150), (5, 150)], "chat_id long, expiry long")
    got = {r.chat_id: r.is_eligible for r in A.eligible(ids(1, 2, 3, 4, 5, 6), ids(2, 3, 4, 6), approved, 100, admin=1).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False}
    remaining, notices = A.lapsed(ids(2, 3, 4), approved, 100)
    assert sorted(r.chat_id for r in remaining.collect()) == [2, 4] and [r.chat_id for r in notices.collect()] == [3]


def test_late_rows_are_not_sent_again(spark):
    """A row of an unchanged signal that comes in a later micro-batch, at or before the sent one, stays quiet."""
    kind = "symbol string, ts timestamp, alert_id bigint, signature string"
    at = lambda h: (pd.Timestamp("2025-03-03") + pd.Timedelta(hours=h)).to_pydatetime()
    memory = spark.createDataFrame([], MEMORY)
    sent = []
    for rows in ([("A", at(10), 1, "x"), ("B", at(10), 2, "x")], [("A", at(9), 3, "x"), ("A", at(10), 4, "x"), ("B", at(11), 5, "y")],
                 [("A", at(35), 6, "x")]):
        now, memory = memory_step(spark.createDataFrame(rows, kind), memory)
        sent += [sorted(r.alert_id for r in now.collect())]
    assert sent == [[1, 2], [5], [6]]
