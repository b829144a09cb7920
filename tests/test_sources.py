import datetime as dt
import zoneinfo

import pandas as pd
import pytest
from dateutil.easter import easter
from pyspark.sql import functions as F

from ebbtide.functions import dates as D
from ebbtide.functions.strings import clip_words, none_as_null, price_text
from ebbtide.operators import reports, universe
from ebbtide.params import DigestParams
from ebbtide.schemas import NEWS, SOCIAL
from ebbtide.sources import readers, sinks


def test_bars_are_cleaned_and_unique(spark, tmp_path):
    raw = spark.createDataFrame([("A", "1h", "2024-01-01", 1.0, None), ("A", "1h", "2024-01-01", 1.0, None), ("A", "1d", "2024-01-01", 2.0, 1.0),
                                 ("A", "1h", "2023-01-01", 3.0, 1.0), ("B", "1h", "2024-01-01", float("nan"), 1.0), ("C", "1h", "2024-01-02", None, 1.0)],
                                "symbol string, interval string, t string, close double, volume double")
    full = raw.select("symbol", "interval", F.to_timestamp("t").alias("ts"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], "volume")
    full.write.parquet(str(tmp_path / "p"))
    rows = readers.read_bars(spark, str(tmp_path / "p"), "1h", since="2023-06-01").collect()
    assert [(r["symbol"], r.close, r.volume) for r in rows] == [("A", 1.0, None)]
    plan = readers.read_bars(spark, str(tmp_path / "p"), "1h")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(interval,1h)" in plan


def test_wide_table_to_long(spark):
    wide = spark.createDataFrame([("2024-01-01", 1.0, 2.0, 0.5, 1.5, 10.0, 7.0), ("2024-01-02", 1.0, 2.0, 0.5, None, 10.0, 7.0)],
                                 "ts string, `A|Open` double, `A|High` double, `A|Low` double, `A|Close` double, `A|Volume` double, `B|Close` double")
    rows = readers.long_from_wide(wide.withColumn("ts", F.to_timestamp("ts"))).collect()
    assert [(r["symbol"], r.open, r.close, r.volume) for r in rows] == [("A", 1.0, 1.5, 10.0)]


def test_directories_and_universes(spark, tmp_path):
    nasdaq, other = tmp_path / "n.txt", tmp_path / "o.txt"
    nasdaq.write_text("Symbol|Test Issue|ETF\nAAPL|N|N\nQQQ|N|Y\nZTEST|Y|N\nABCDEF|N|N\nNA$P|N|N\nFile Creation Time: 1\n")
    other.write_text("ACT Symbol|ETF|Test Issue\n ibm |N|N\nBRK.B|N|N\nSHORT\nFile Creation Time: 1||\n")
    both = readers.read_directory(spark, str(nasdaq), "nasdaq").unionByName(readers.read_directory(spark, str(other), "other"))
    names = lambda df: sorted(r["symbol"] for r in df.collect())
    assert names(universe.common_stocks(both)) == ["AAPL", "IBM"]
    assert names(universe.all_listed(both)) == ["AAPL", "ABCDEF", "QQQ", "SHORT", "ibm"]
    listing = tmp_path / "mine.txt"
    listing.write_text(" aapl \n#no\n #yes\n\n   \nmsft")
    assert names(universe.resolve(spark, str(listing))) == ["#YES", "AAPL", "MSFT"]
    assert names(universe.resolve(spark, "a, b,,c ")) == ["A", "B", "C"] and names(universe.resolve(spark, " spy ")) == ["SPY"]
    members = tmp_path / "members.csv"
    members.write_text("Symbol,Name\nBRK.B,x\nA,y\n")
    assert names(universe.resolve(spark, "SP500", constituents=readers.read_constituents(spark, str(members)))) == ["A", "BRK-B"]
    assert names(universe.resolve(spark, "all", directory=both)) == names(universe.all_listed(both))
    assert names(universe.capped(universe.union_distinct(both.select("symbol"), both.select("symbol")), 2)) == [" ibm ", "AAPL"]


def test_snapshots_and_freshness(spark, tmp_path):
    path = str(tmp_path / "q")
    sinks.write_snapshot(spark.createDataFrame([("A",)], "symbol string"), path, "2024-01-08 21:00:00")
    sinks.write_snapshot(spark.createDataFrame([("B",)], "symbol string"), path, "2024-01-09 22:00:00")
    newest = sinks.read_snapshot(spark, path)
    assert [r["symbol"] for r in newest.collect()] == ["B"]
    everyone = spark.createDataFrame([("A",), ("B",)], "symbol string")
    # 16:30 and 19:30 in New York are 21:30 and 00:30 UTC in January.
    assert universe.scan_list(spark, newest, everyone, "2024-01-10 00:29:00")[0] is False
    full, rows = universe.scan_list(spark, newest, everyone, "2024-01-10 00:30:00")
    assert full is True and rows.count() == 2
    boom = lambda: (_ for _ in ()).throw(OSError())
    assert universe.cached_universe(newest, boom, "2024-01-10 21:00:00")[0] == "snapshot"
    assert universe.cached_universe(newest, boom, "2024-01-10 22:00:00")[0] == "stale"
    assert universe.cached_universe(newest, lambda: everyone, "2024-01-10 22:00:00")[0] == "rebuilt"
    with pytest.raises(RuntimeError):
        universe.cached_universe(None, boom, "2024-01-10 22:00:00")


def test_calendar_against_plain_rules(spark):
    def slow(year):
        def shift(d):
            return d + dt.timedelta({5: -1, 6: 1}.get(d.weekday(), 0))
        days = lambda m: [dt.date(year, m, 1) + dt.timedelta(k) for k in range(31) if (dt.date(year, m, 1) + dt.timedelta(k)).month == m]
        on = lambda m, w: [d for d in days(m) if d.weekday() == w]
        out = {shift(dt.date(year, 1, 1)), on(1, 0)[2], on(2, 0)[2], easter(year) - dt.timedelta(2), on(5, 0)[-1], shift(dt.date(year, 7, 4)),
               on(9, 0)[0], on(11, 3)[3], shift(dt.date(year, 12, 25))}
        return {d for d in out | ({shift(dt.date(year, 6, 19))} if year >= 2022 else set()) if d.year == year}

    days = spark.sql("select explode(sequence(date'1995-01-01', date'2032-12-31')) as day")
    got = {r.day for r in days.where(D.holiday(F.col("day")).isNotNull()).collect()}
    assert got == set().union(*[slow(y) for y in range(1995, 2033)])
    assert dt.date(2021, 12, 31) not in got and dt.date(2021, 6, 18) not in got


def test_session_bounds(spark):
    zone = zoneinfo.ZoneInfo("America/New_York")
    local = ["2024-07-05 09:29:59", "2024-07-05 09:30:00", "2024-07-05 16:00:00", "2024-07-05 16:00:01", "2024-07-05 16:10:00", "2024-07-05 16:10:01",
             "2024-07-04 12:00:00", "2024-07-06 12:00:00", "2024-12-03 09:30:00"]
    utc = [dt.datetime.fromisoformat(x).replace(tzinfo=zone).astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S") for x in local]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(utc)], "i int, t string").withColumn("ts", F.to_timestamp("t"))
    ts = F.col("ts")
    rows = df.select("i", D.regular_session(ts).alias("r"), D.market_open_status(ts).alias("o"), D.scan_paused(ts).alias("p"),
                     D.scan_paused(ts, regular_only=False).alias("d"), D.scan_paused(ts, pause_days=False).alias("n")).orderBy("i").collect()
    assert [r.r for r in rows] == [False, True, True, False, False, False, True, False, True]
    assert [r.o for r in rows] == [False, True, True, True, True, False, True, False, True]
    assert [r.p for r in rows] == [True, False, False, True, True, True, True, True, False]
    assert [r.d for r in rows] == [False] * 6 + [True, True, False] and not any(r.n for r in rows)


def test_texts(spark):
    prices = [1234.5, 1.0, 0.999999, 0.5, 0.000012, 61250.0, 0.0]
    want = ["1,234.50$", "1.00$", "0.999999$", "0.5$", "0.000012$", "61,250.00$", "0$"]
    df = spark.createDataFrame(list(enumerate(prices)), "i int, p double")
    assert [r.t for r in df.select("i", price_text(F.col("p")).alias("t")).orderBy("i").collect()] == want
    texts = spark.createDataFrame([("aaa bbb ccc",), ("short",), (" None ",), ("x" * 20,), ("aaa bbb\nccc ddd",)], "t string")
    assert [r.t for r in texts.select(clip_words(none_as_null(F.col("t")), 9).alias("t")).collect()] == [
        "aaa bbb…", "short", None, "xxxxxxxxx…", "aaa…"]


def test_feeds_and_digest(spark, tmp_path):
    news, social = tmp_path / "n.json", tmp_path / "s.json"
    news.write_text('{"symbol":"A","items":[{"content":{"title":"T1","provider":{"displayName":"P"}}},{"title":"T2","publisher":"Q"},'
                    '{"title":"T3"},{"content":{"provider":{}},"publisher":"R"}]}\n{"symbol":"C","items":[]}\n')
    social.write_text('{"symbol":"A","messages":[{"body":"m1"},{"body":""},{"body":"m3"}]}\n{"symbol":"B","messages":[{"body":"only"}]}\n')
    feed = readers.read_news(spark, str(news)).unionByName(readers.read_social(spark, str(social)))
    rows = {r["symbol"]: r for r in reports.source_digest(feed, DigestParams(headlines=5, messages=2)).collect()}
    assert set(rows) == {"A", "B"}
    assert rows["A"].headlines == "- T1 (P)\n- T2 (Q)\n- T3" and rows["A"].social == "- m1"
    assert rows["B"].headlines == "(لا توجد)"
    assert NEWS.fieldNames() == ["symbol", "items"] and SOCIAL.fieldNames() == ["symbol", "messages"]


def test_csv_export(spark, tmp_path):
    row = {c: 1.0 for c in sinks.CSV_COLUMNS if c != "ticker"} | {"symbol": "A"}
    sinks.write_csv(spark.createDataFrame(pd.DataFrame([row])), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == list(sinks.CSV_COLUMNS)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from ebbtide.session import scratch_root

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default), sparkContext=SimpleNamespace(master=master))
    assert scratch_root(session("yarn", "hdfs:///shared")) == "hdfs:///shared" and scratch_root(session("local[4]"))
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch_root(session(master))
