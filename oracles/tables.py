"""Named SQL views the oracles are put together from, with what each needs."""

AS_OF = "DATE '2001-11-05'"

# Coefficients of the normal tail, highest power first (Hart 1968, West 2005).
NUM = ("0.0352624965998911", "0.700383064443688", "6.37396220353165", "33.912866078383",
       "112.079291497871", "221.213596169931", "220.206867912376")
DEN = ("0.0883883476483184", "1.75566716318264", "16.064177579207", "86.7807322029461",
       "296.564248779674", "637.333633378831", "793.826512519948", "440.413735824752")


def _horner(coefs: tuple[str, ...], z: str) -> str:
    out = f"CAST({coefs[0]} AS DOUBLE)"
    for c in coefs[1:]:
        out = f"({out} * {z} + CAST({c} AS DOUBLE))"
    return out


def cdf(x: str) -> str:
    z, e = f"abs({x})", f"exp(-({x}) * ({x}) / 2.0)"
    far = f"{e} / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) / CAST(2.506628274631 AS DOUBLE)"
    tail = (f"(CASE WHEN {z} > 37 THEN 0 WHEN {z} < 7.07106781186547 "
            f"THEN {e} * {_horner(NUM, z)} / {_horner(DEN, z)} ELSE {far} END)")
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def cents(x: str) -> str:
    return f"CAST(printf('%.2f', {x}) AS DOUBLE)"


def price(x: str) -> str:
    return (f"(CASE WHEN {x} >= 1 THEN format('{{:,.2f}}', {x}) "
            f"ELSE rtrim(rtrim(printf('%.6f', {x}), '0'), '.') END || '$')")


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (tuple(needs.split()), sql)


def query(needs: str, body: str) -> str:
    """`body` preceded by the views it needs, in order of dependence."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for n in VIEWS[name][0]:
            visit(n)
        done.append(name)

    for n in needs.split():
        visit(n)
    parts = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in done)
    if body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return f"WITH RECURSIVE {parts}\n{body}"


view("bars", "", """
  WITH g AS (SELECT l_suppkey AS sk, l_shipdate AS ts,
                    SUM(CAST(ROUND(l_discount * 100) AS BIGINT) - 5) AS bp,
                    SUM(l_quantity) * 2000 AS volume, MAX(l_tax) AS tx
             FROM lineitem GROUP BY l_suppkey, l_shipdate),
  p AS (SELECT sk, ts, volume, tx,
               ROUND(20 * EXP(SUM(bp) OVER (PARTITION BY sk ORDER BY ts) / CAST(100 AS DOUBLE)), 4) AS close FROM g),
  q AS (SELECT *, COALESCE(LAG(close) OVER (PARTITION BY sk ORDER BY ts), CAST(20 AS DOUBLE)) AS open FROM p)
  SELECT CONCAT('S', sk) AS symbol, ts, open, GREATEST(open, close) * (1 + tx / 4) AS high,
         LEAST(open, close) * (1 - tx / 4) AS low, close, volume FROM q""")

view("spot", "bars", "SELECT symbol, MAX_BY(close, ts) AS spot FROM bars GROUP BY symbol")

view("chain", "spot", f"""
  WITH r AS (SELECT CONCAT('S', l_suppkey) AS symbol,
               CONCAT('S', l_suppkey, '-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', CAST(l_quantity AS INT)) AS contract_symbol,
               CASE WHEN l_returnflag = 'N' THEN 'put' ELSE 'call' END AS option_type,
               CAST(1 + l_orderkey % 120 AS INT) AS dte, 0.15 + l_discount * 5 AS iv0,
               l_tax, l_quantity, l_linenumber, l_partkey FROM lineitem),
  m AS (SELECT r.*, s.spot, FLOOR(s.spot * (70 + 0.6 * (l_partkey % 100))) / CAST(100 AS DOUBLE) AS strike
        FROM r JOIN spot s ON r.symbol = s.symbol),
  n AS (SELECT m.*, ROUND(GREATEST(CASE WHEN option_type = 'call' THEN spot - strike ELSE strike - spot END, 0)
                    + spot * iv0 * SQRT(dte / CAST(365 AS DOUBLE)) * 0.4, 4) AS mid0 FROM m)
  SELECT symbol, contract_symbol, option_type, dte, CAST({AS_OF} + dte AS DATE) AS expiry, strike, spot,
         CASE WHEN l_linenumber = 7 THEN CAST(0 AS DOUBLE) ELSE mid0 * (1 - 1.5 * l_tax) END AS bid,
         CASE WHEN l_linenumber = 7 THEN CAST(0 AS DOUBLE) ELSE mid0 * (1 + 1.5 * l_tax) END AS ask,
         mid0 AS last, CAST(l_quantity * 10 AS BIGINT) AS volume,
         CAST((l_partkey * 7) % 3000 AS BIGINT) AS open_interest,
         CASE WHEN l_linenumber = 6 AND l_quantity < 5 THEN NULL ELSE ROUND(iv0, 4) END AS iv,
         CASE WHEN l_partkey % 3 = 0 THEN 'secondary' ELSE 'primary' END AS provider FROM n""")

view("ticks", "", """
  SELECT CONCAT('U', user_id % 10) AS symbol, ts, event_id,
         ROUND(50 * EXP(SUM(CAST(ROUND(value) AS BIGINT) - 50)
               OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) / CAST(5000 AS DOUBLE)), 4) AS price,
         20000 + (event_id % 50) * 1000 AS size FROM events""")

view("alerts", "", """
  SELECT o_orderkey AS alert_id, CONCAT('S', o_custkey % 10) AS symbol,
         o_orderdate AS alert_ts, o_orderpriority AS signature FROM orders""")

view("directory", "", """
  SELECT TRANSLATE(CONCAT('', s_suppkey), '0123456789', 'ABCDEFGHIJ') AS symbol,
         CASE WHEN s_acctbal < 0 THEN 'Y' ELSE 'N' END AS test_issue,
         CASE WHEN s_nationkey % 5 = 0 THEN 'Y' ELSE 'N' END AS etf,
         CASE WHEN s_suppkey % 2 = 0 THEN 'nasdaq' ELSE 'other' END AS source FROM supplier""")

view("feed", "", """
  SELECT CONCAT('S', conv_id) AS symbol, turn AS rank,
         CASE WHEN role = 'assistant' THEN 'news' ELSE 'social' END AS kind, text AS body
  FROM conversations WHERE role IN ('assistant', 'user')""")

# ---- indicators -------------------------------------------------------------

view("pos", "bars", """
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos,
         count(*) OVER (PARTITION BY symbol) AS n_bars FROM bars""")

view("rsi", "pos", """
  WITH d AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS delta FROM pos),
  s AS (SELECT *, sum(CASE WHEN delta > 0 THEN delta ELSE 0 END * pow(CAST(14 AS DOUBLE) / 13, pos)) OVER w AS g,
               sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END * pow(CAST(14 AS DOUBLE) / 13, pos)) OVER w AS l
        FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts))
  SELECT *, CASE WHEN pos < 14 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM s""")

view("ind", "rsi", """
  SELECT *,
    CASE WHEN count(*) OVER b = 20 THEN avg(close) OVER b END AS bb_mid,
    CASE WHEN count(*) OVER b = 20 THEN avg(close) OVER b - 2 * stddev_pop(close) OVER b END AS bb_lower,
    CASE WHEN count(*) OVER b = 20 THEN avg(close) OVER b + 2 * stddev_pop(close) OVER b END AS bb_upper,
    CASE WHEN count(*) OVER y >= 60 THEN min(close) OVER y END AS roll_low,
    CASE WHEN count(*) OVER y >= 60 THEN max(close) OVER y END AS roll_high,
    CASE WHEN count(*) OVER m = 50 THEN avg(close) OVER m END AS sma50,
    close / lag(close, 20) OVER w - 1 AS change_20,
    CASE WHEN pos + 30 < n_bars THEN max(close) OVER f END AS best_ahead
  FROM rsi WINDOW w AS (PARTITION BY symbol ORDER BY ts),
    b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    y AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW),
    m AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)""")


def pivots(source: str) -> str:
    return f"""
  SELECT *, (low < min(low) OVER b AND low < min(low) OVER a
             AND count(*) OVER b = 3 AND count(*) OVER a = 3) IS TRUE AS pivot_low,
         (high > max(high) OVER b AND high > max(high) OVER a
             AND count(*) OVER b = 3 AND count(*) OVER a = 3) IS TRUE AS pivot_high
  FROM {source} WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
                       a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"""


view("piv_all", "pos", pivots("pos"))
view("slice250", "pos", "SELECT * FROM pos WHERE pos >= n_bars - 250")
view("slice120", "pos", "SELECT *, pos - greatest(n_bars - 120, 0) AS x FROM pos WHERE pos >= n_bars - 120")
view("piv250", "slice250", pivots("slice250"))
view("piv120", "slice120", pivots("slice120"))
view("last_bar", "ind", "SELECT * FROM ind WHERE pos = n_bars - 1")

view("lows", "piv250", """
  SELECT symbol, low, row_number() OVER (PARTITION BY symbol ORDER BY low) AS r FROM piv250 WHERE pivot_low""")
view("clusters", "lows", """
  SELECT symbol, r, low, low AS anchor, 1 AS cid FROM lows WHERE r = 1
  UNION ALL
  SELECT p.symbol, p.r, p.low, CASE WHEN p.low <= c.anchor * 1.01 THEN c.anchor ELSE p.low END,
         CASE WHEN p.low <= c.anchor * 1.01 THEN c.cid ELSE c.cid + 1 END
  FROM clusters c JOIN lows p ON p.symbol = c.symbol AND p.r = c.r + 1""")
view("levels", "clusters", """
  SELECT symbol, cid, avg(low) AS level, count(*) AS touches FROM clusters GROUP BY symbol, cid HAVING count(*) >= 2""")
view("support", "levels last_bar", """
  SELECT b.symbol, min(l.level) AS support_level FROM last_bar b JOIN levels l ON l.symbol = b.symbol
  WHERE (b.close - l.level) / l.level BETWEEN 0 AND 0.015 OR (l.level - b.close) / l.level BETWEEN 0 AND 0.005
  GROUP BY b.symbol""")
view("n_lows", "lows", "SELECT symbol, count(*) AS n_lows FROM lows GROUP BY symbol")

view("lines", "piv120", """
  WITH h AS (SELECT symbol, x, high, row_number() OVER (PARTITION BY symbol ORDER BY x DESC) AS k FROM piv120 WHERE pivot_high),
  l AS (SELECT symbol, x, low, row_number() OVER (PARTITION BY symbol ORDER BY x DESC) AS k FROM piv120 WHERE pivot_low),
  hh AS (SELECT symbol, count(*) AS hn, min(x) AS h0, regr_slope(high, x) AS hs, regr_intercept(high, x) AS hi
         FROM h WHERE k <= 4 GROUP BY symbol),
  ll AS (SELECT symbol, count(*) AS ln, min(x) AS l0, regr_slope(low, x) AS ls, regr_intercept(low, x) AS li
         FROM l WHERE k <= 4 GROUP BY symbol)
  SELECT s.symbol, COALESCE(hn, 0) AS hn, COALESCE(ln, 0) AS ln, h0, l0, hs, hi, ls, li
  FROM (SELECT DISTINCT symbol FROM pos) s LEFT JOIN hh ON hh.symbol = s.symbol LEFT JOIN ll ON ll.symbol = s.symbol""")
view("wedge", "lines last_bar", """
  SELECT b.symbol, CASE
    WHEN hn < 2 OR ln < 2 THEN 'no_pivots'
    WHEN least(n_bars, 120) - 1 - least(h0, l0) < 20 THEN 'too_short'
    WHEN NOT (hs < 0 AND ls < 0 AND hs < ls) THEN 'not_falling'
    WHEN (li - hi) / (hs - ls) <= least(n_bars, 120) - 1 THEN 'crossed'
    WHEN close < ls * (least(n_bars, 120) - 1) + li - 0.005 * close
      OR close > hs * (least(n_bars, 120) - 1) + hi + 0.005 * close THEN 'outside'
    ELSE 'wedge' END AS wedge_state
  FROM last_bar b JOIN lines l ON l.symbol = b.symbol""")

view("gate", "pos", """
  SELECT symbol, max(CASE WHEN pos = n_bars - 1 THEN close END) AS last_close, avg(volume) AS avg_volume
  FROM pos WHERE pos >= n_bars - 20 GROUP BY symbol""")
view("scored", "last_bar support wedge gate n_lows", """
  WITH f AS (SELECT b.symbol, b.ts AS bar_ts, b.close AS price, b.rsi, b.bb_lower, s.support_level, w.wedge_state,
                    b.n_bars, COALESCE(n.n_lows, 0) AS n_lows,
                    (g.last_close >= 2 AND g.avg_volume >= 30000) AS liquid,
                    (b.n_bars >= 21 AND (b.close <= b.bb_lower * 1.005 OR b.low <= b.bb_lower)) IS TRUE AS f_boll,
                    (b.n_bars >= 15 AND b.rsi < 30) IS TRUE AS f_rsi,
                    s.support_level IS NOT NULL AS f_supp, w.wedge_state = 'wedge' AS f_wedge
             FROM last_bar b JOIN wedge w ON w.symbol = b.symbol JOIN gate g ON g.symbol = b.symbol
             LEFT JOIN support s ON s.symbol = b.symbol LEFT JOIN n_lows n ON n.symbol = b.symbol)
  SELECT *, CAST(f_boll AS INT) + CAST(f_rsi AS INT) + CAST(f_supp AS INT) + CAST(f_wedge AS INT) AS score,
         concat_ws(',', CASE WHEN f_boll THEN 'bollinger' END, CASE WHEN f_rsi THEN 'rsi' END,
                   CASE WHEN f_supp THEN 'support' END, CASE WHEN f_wedge THEN 'wedge' END) AS signature FROM f""")

# ---- rebound ----------------------------------------------------------------

view("dips", "ind", """
  SELECT *, (COALESCE(rsi < 35, FALSE) OR COALESCE(close <= roll_low * 1.1, FALSE)) AS dip,
         best_ahead / close - 1 AS gain FROM ind""")
view("cand", "dips", "SELECT symbol, pos, gain FROM dips WHERE dip AND pos >= 60 AND pos < n_bars - 30")
view("hops", "cand", """
  SELECT a.symbol, a.pos, a.gain, min(b.pos) AS nxt FROM cand a
  LEFT JOIN cand b ON b.symbol = a.symbol AND b.pos >= a.pos + 10 GROUP BY a.symbol, a.pos, a.gain""")
view("walk", "hops", """
  SELECT h.* FROM hops h JOIN (SELECT symbol, min(pos) AS p FROM cand GROUP BY symbol) f ON f.symbol = h.symbol AND f.p = h.pos
  UNION ALL SELECT h.* FROM walk w JOIN hops h ON h.symbol = w.symbol AND h.pos = w.nxt""")
view("rebound", "walk dips", """
  WITH e AS (SELECT symbol, count(*) AS episodes, count(*) FILTER (WHERE gain >= 0.08) AS rebounds, sum(gain) AS tot
             FROM walk GROUP BY symbol),
  s AS (SELECT d.symbol, d.close AS price, d.n_bars, d.change_20 AS change_20d, d.rsi AS rsi14, d.dip,
               COALESCE(e.episodes, 0) AS episodes, COALESCE(e.rebounds, 0) AS rebounds,
               CASE WHEN roll_low > 0 THEN close / roll_low - 1 ELSE 0 END AS above_52w_low,
               CASE WHEN roll_high > 0 THEN 1 - close / roll_high ELSE 0 END AS off_52w_high,
               e.tot / e.episodes AS avg_gain, COALESCE(e.rebounds / CAST(e.episodes AS DOUBLE), 0) AS rebound_rate,
               (n_bars >= 252 AND close > 0 AND rsi IS NOT NULL AND (change_20 < 0 OR close < sma50) AND dip) IS TRUE AS declining_now
        FROM dips d LEFT JOIN e ON e.symbol = d.symbol WHERE d.pos = d.n_bars - 1)
  SELECT *, rebound_rate * greatest(avg_gain, 0) AS score,
         declining_now AND episodes >= 3 AND rebound_rate >= 0.6 AS qualifies FROM s""")

# ---- contracts --------------------------------------------------------------

view("quotes", "chain", f"""
  WITH a AS (SELECT *, (ask >= bid AND bid > 0) AS live FROM chain WHERE open_interest + volume >= 20),
  b AS (SELECT * REPLACE (CASE WHEN live THEN bid ELSE last END AS bid, CASE WHEN live THEN ask ELSE last END AS ask),
               NOT live AS estimated FROM a WHERE live OR last > 0)
  SELECT *, {cents('CASE WHEN estimated THEN last ELSE (bid + ask) / 2 END')} AS premium,
         CASE WHEN NOT estimated THEN (ask - bid) / ((bid + ask) / 2) END AS spread_pct,
         CASE WHEN ask > 0 THEN {cents('strike + ask')} END AS breakeven FROM b""")


def greeks(source: str, years: str, q: str = "0") -> str:
    """Columns delta and theta for every row with usable inputs, else null."""
    return f"""
  WITH t AS (SELECT *, CASE WHEN spot > 0 AND strike > 0 AND iv > 0 THEN {years} END AS yr FROM {source}),
  d AS (SELECT *, (ln(spot / strike) + (0.045 - {q} + 0.5 * iv * iv) * yr) / (iv * sqrt(yr)) AS d1 FROM t),
  n AS (SELECT *, {cdf('d1')} AS n1, {cdf('(d1 - iv * sqrt(yr))')} AS n2,
               exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS phi FROM d)
  SELECT * EXCLUDE (yr, d1, n1, n2, phi),
    CASE WHEN option_type = 'call' THEN n1 ELSE n1 - 1 END AS delta,
    (-(spot * phi * iv) / (2 * sqrt(yr)) + CASE WHEN option_type = 'call'
        THEN -0.045 * strike * exp(-0.045 * yr) * n2 ELSE 0.045 * strike * exp(-0.045 * yr) * (1 - n2) END) / 365 AS theta
  FROM n"""


view("priced", "quotes", greeks("quotes", "CASE WHEN dte > 0 THEN dte / CAST(365 AS DOUBLE) END"))


def tier(volume: int, iv: str) -> str:
    return (f"(abs(delta) BETWEEN 0.6 AND 0.8 AND dte BETWEEN 1 AND 90 AND volume >= {volume} "
            f"AND open_interest >= 500 AND iv < {iv} AND spread_pct < 0.1) IS TRUE")


view("screen_in", "chain", """
  SELECT * REPLACE (COALESCE(iv, 0) AS iv), (bid + ask) / 2 AS mid,
         CASE WHEN (bid + ask) / 2 > 0 THEN (ask - bid) / ((bid + ask) / 2) END AS spread_pct FROM chain""")
view("screen_greeks", "screen_in", f"""
  WITH g AS ({greeks('screen_in', 'greatest(dte, 1) / CAST(365 AS DOUBLE)')})
  SELECT * REPLACE (COALESCE(delta, 0) AS delta, COALESCE(theta, 0) AS theta),
         CASE WHEN mid > 0 THEN abs(COALESCE(theta, 0)) / mid END AS theta_pct FROM g""")


def screen(dte: str, volume: int, oi: int, spread: str, iv: str, delta: str, theta: str = "0.05") -> str:
    return (f"SELECT * FROM screen_greeks WHERE bid > 0 AND dte BETWEEN {dte} AND volume >= {volume} "
            f"AND open_interest >= {oi} AND spread_pct <= {spread} AND iv BETWEEN {iv} "
            f"AND abs(delta) BETWEEN {delta} AND theta_pct <= {theta}")


view("lib", "screen_greeks", screen("7 AND 45", 30, 200, "0.4", "0.15 AND 0.6", "0.3 AND 0.9"))
view("cli", "screen_greeks", screen("1 AND 45", 100, 500, "0.1", "0.15 AND 1.0", "0.3 AND 0.7"))

view("down", "", """
  SELECT CONCAT('S', s_suppkey) AS symbol, 'primary' AS provider FROM supplier WHERE s_acctbal < 2000
  UNION ALL SELECT CONCAT('S', s_suppkey), 'secondary' FROM supplier WHERE s_acctbal < 0""")


def outcomes(days: int, first: str, second: str, down: bool = False) -> str:
    """Provider choice per symbol: the first in order with an in-window contract."""
    alive = "d.symbol IS NULL" if down else "TRUE"
    fails = "LEFT JOIN down d ON d.symbol = s.symbol AND d.provider = p.provider" if down else ""
    return f"""
  WITH p(provider, pr) AS (VALUES ('{first}', 0), ('{second}', 1)),
  s AS (SELECT DISTINCT symbol FROM chain),
  l AS (SELECT symbol, provider, bool_or(dte BETWEEN 0 AND {days} AND (provider = 'primary' OR option_type = 'call')) AS near
        FROM chain GROUP BY symbol, provider),
  j AS (SELECT s.symbol, p.provider, p.pr, ({alive}) AS alive, COALESCE(l.near, FALSE) AND ({alive}) AS near,
               l.symbol IS NOT NULL AND ({alive}) AS listed
        FROM s CROSS JOIN p LEFT JOIN l ON l.symbol = s.symbol AND l.provider = p.provider {fails})
  SELECT symbol, arg_min(provider, pr) FILTER (WHERE near) AS provider,
         CASE WHEN bool_or(near) THEN 'has_contracts' WHEN bool_and(NOT alive) THEN 'failed'
              WHEN bool_or(listed) THEN 'no_near_term' ELSE 'none_listed' END AS outcome
  FROM j GROUP BY symbol"""


def sampled(days: int, most: int, chosen: str) -> str:
    """Expiries kept per symbol of the chosen provider."""
    return f"""
  WITH e AS (SELECT DISTINCT c.symbol, c.provider, c.dte FROM chain c
             JOIN {chosen} o ON o.symbol = c.symbol AND o.provider = c.provider WHERE c.dte BETWEEN 0 AND {days}),
  r AS (SELECT *, row_number() OVER (PARTITION BY symbol, provider ORDER BY dte) - 1 AS i,
               count(*) OVER (PARTITION BY symbol, provider) AS n FROM e)
  SELECT symbol, provider, dte FROM r WHERE provider = 'secondary' OR n <= {most} OR i IN (
    SELECT CAST(round_even(k.k * ((n - 1) / CAST({most - 1} AS DOUBLE)), 0) AS BIGINT) FROM range({most}) k(k))"""


view("near_choice", "chain", outcomes(91, "primary", "secondary"))
view("far_choice", "chain", outcomes(365, "secondary", "primary"))
view("near_dates", "near_choice", sampled(91, 6, "near_choice"))
view("far_dates", "far_choice", sampled(365, 12, "far_choice"))
for _side in ("near", "far"):
    view(f"{_side}_calls", f"priced {_side}_dates", f"""
  SELECT q.* FROM priced q JOIN {_side}_dates k ON k.symbol = q.symbol AND k.provider = q.provider AND k.dte = q.dte
  WHERE q.option_type = 'call'""")


def ranked(source: str, where: str, first: str = "") -> str:
    lead = first + ", " if first else ""
    return f"""
  SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY {lead}open_interest DESC, ask, contract_symbol) AS INT) AS rank
  FROM {source} WHERE {where}"""


STRICT, RELAXED = tier(100, "0.4"), tier(50, "0.5")
view("best", "near_calls", f"""
  SELECT *, NOT {STRICT} AS relaxed FROM ({ranked('near_calls', f'{STRICT} OR {RELAXED}', f'NOT {STRICT}')}) WHERE rank = 1""")
view("cheap", "near_calls gate", f"""
  SELECT * FROM ({ranked('near_calls', 'premium <= 0.5 AND symbol IN (SELECT symbol FROM gate WHERE last_close >= 2 AND avg_volume >= 30000)')})
  WHERE rank <= 3""")
view("bottom", "far_calls", f"""
  SELECT *, CASE WHEN strike <= spot * 0.98 THEN 'ITM' ELSE 'ATM' END AS moneyness
  FROM ({ranked('far_calls', 'dte BETWEEN 30 AND 365 AND premium <= 3 AND strike <= spot * 1.02')}) WHERE rank <= 3""")

# ---- calendar ---------------------------------------------------------------

view("easter", "", """
  WITH y AS (SELECT range AS y FROM range(1970, 2101)),
  a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
  h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a),
  l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h),
  m AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM l)
  SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM m""")
view("holidays", "easter", """
  WITH days AS (SELECT CAST(range AS DATE) AS d FROM range(TIMESTAMP '1990-01-01', TIMESTAMP '2031-01-01', INTERVAL 1 DAY)),
  x AS (SELECT d, year(d) AS y, month(d) AS m, day(d) AS dd, isodow(d) AS w FROM days),
  fixed AS (SELECT d, CASE WHEN m = 1 AND dd = 1 THEN 'new_year' WHEN m = 7 AND dd = 4 THEN 'independence_day'
                   WHEN m = 12 AND dd = 25 THEN 'christmas' WHEN m = 6 AND dd = 19 AND y >= 2022 THEN 'juneteenth' END AS holiday, w, y FROM x),
  moved AS (SELECT CAST(d + CASE w WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END AS DATE) AS day, holiday, y FROM fixed WHERE holiday IS NOT NULL)
  SELECT day, holiday FROM moved WHERE year(day) = y
  UNION ALL SELECT d, CASE WHEN m = 1 THEN 'mlk_day' WHEN m = 2 THEN 'washington' ELSE 'labor_day' END FROM x
            WHERE w = 1 AND ((m IN (1, 2) AND dd BETWEEN 15 AND 21) OR (m = 9 AND dd <= 7))
  UNION ALL SELECT d, 'memorial_day' FROM x WHERE w = 1 AND m = 5 AND dd >= 25
  UNION ALL SELECT d, 'thanksgiving' FROM x WHERE w = 4 AND m = 11 AND dd BETWEEN 22 AND 28
  UNION ALL SELECT CAST(easter - 2 AS DATE), 'good_friday' FROM easter""")


def new_york(ts: str) -> str:
    """UTC to New York clock time by the daylight-saving rules of both eras."""
    y = f"year({ts})"

    def sunday(month: int, first: int) -> str:
        base = f"make_date({y}, {month}, {first})"
        return f"({base} + CAST((7 - isodow({base})) AS INTEGER))"

    start = f"CASE WHEN {y} >= 2007 THEN {sunday(3, 8)} ELSE {sunday(4, 1)} END"
    end = f"CASE WHEN {y} >= 2007 THEN {sunday(11, 1)} ELSE {sunday(10, 25)} END"
    return (f"({ts} - CASE WHEN {ts} >= CAST({start} AS TIMESTAMP) + INTERVAL 7 HOUR "
            f"AND {ts} < CAST({end} AS TIMESTAMP) + INTERVAL 6 HOUR THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END)")


# ---- performance and alerts ---------------------------------------------------

NOW = "TIMESTAMP '2001-07-31 00:00:00'"
view("bench", "bars", "SELECT ts, close FROM bars WHERE symbol = 'S0'")
view("sessions", "holidays", """
  SELECT day, count(*) FILTER (WHERE isodow(day) < 6 AND holiday IS NULL) OVER (ORDER BY day) AS session
  FROM (SELECT CAST(range AS DATE) AS day FROM range(TIMESTAMP '1990-01-01', TIMESTAMP '2031-01-01', INTERVAL 1 DAY)) d
  LEFT JOIN (SELECT DISTINCT * FROM holidays) h USING (day)""")
view("tracked", "alerts bars bench sessions", """
  WITH a AS (SELECT a.*, b.close AS alert_price, b.ts AS pts FROM alerts a ASOF LEFT JOIN bars b ON b.symbol = a.symbol AND b.ts <= a.alert_ts),
  c AS (SELECT a.*, s.close AS bench_price, s.ts AS bts FROM a ASOF LEFT JOIN bench s ON s.ts <= a.alert_ts)
  SELECT c.* FROM c JOIN sessions x ON x.day = CAST(alert_ts AS DATE) JOIN sessions p ON p.day = CAST(pts AS DATE)
  JOIN sessions b ON b.day = CAST(bts AS DATE) WHERE x.session - p.session < 5 AND x.session - b.session < 5""")
view("checks", "tracked", """
  SELECT t.*, CAST(h AS INT) AS horizon_h, alert_ts + to_hours(CAST(h AS INT)) AS due_ts FROM tracked t, (VALUES (24), (72)) v(h)""")
view("settled", "checks bars bench sessions", f"""
  WITH r AS (SELECT c.*, k.k AS attempt,
               make_timestamp(CAST(ceil(epoch(due_ts) / 1800) AS BIGINT) * 1800000000 + k.k * 1800000000) AS run_ts
             FROM checks c, range(8) k(k)),
  p AS (SELECT r.*, b.close AS price, b.ts AS b_ts FROM (SELECT * FROM r WHERE run_ts <= {NOW}) r
        ASOF LEFT JOIN bars b ON b.symbol = r.symbol AND b.ts <= r.run_ts),
  q AS (SELECT p.*, s.close AS bench, s.ts AS s_ts FROM p ASOF LEFT JOIN bench s ON s.ts <= p.run_ts),
  g AS (SELECT q.*, (x.session - u.session < 5 AND x.session - v.session < 5) IS TRUE AS good FROM q
        LEFT JOIN sessions x ON x.day = CAST(run_ts AS DATE) LEFT JOIN sessions u ON u.day = CAST(b_ts AS DATE)
        LEFT JOIN sessions v ON v.day = CAST(s_ts AS DATE)),
  a AS (SELECT alert_id, horizon_h, count(*) AS tried, bool_or(good) AS any_good, min(attempt) FILTER (WHERE good) AS att,
               arg_min(run_ts, attempt) FILTER (WHERE good) AS settled_ts, arg_min(price, attempt) FILTER (WHERE good) AS price_now,
               arg_min(bench, attempt) FILTER (WHERE good) AS bench_now FROM g GROUP BY alert_id, horizon_h)
  SELECT c.alert_id, c.symbol, c.horizon_h, c.due_ts, c.alert_price, c.bench_price,
         CASE WHEN a.any_good THEN 'settled' WHEN a.tried >= 8 THEN 'gave_up' ELSE 'pending' END AS status,
         CAST(CASE WHEN a.any_good THEN a.att ELSE COALESCE(a.tried, 0) END AS INT) AS attempts,
         a.settled_ts, a.price_now, a.bench_now,
         (a.price_now / c.alert_price - 1) - (a.bench_now / c.bench_price - 1) AS alpha
  FROM checks c LEFT JOIN a ON a.alert_id = c.alert_id AND a.horizon_h = c.horizon_h""")
view("perf", "settled", """
  SELECT horizon_h, count(*) AS n, count(*) FILTER (WHERE alpha > 0) AS wins, sum(alpha) AS sum_alpha
  FROM settled WHERE status = 'settled' GROUP BY horizon_h""")

view("events_seq", "alerts", """
  SELECT symbol, alert_ts AS ts, alert_id, signature,
         row_number() OVER (PARTITION BY symbol ORDER BY alert_ts, alert_id) AS seq FROM alerts""")
view("next_sent", "events_seq", """
  SELECT a.symbol, a.ts, a.alert_id, a.signature, a.seq,
         (SELECT min(b.seq) FROM events_seq b WHERE b.symbol = a.symbol AND b.seq > a.seq
            AND (b.signature <> a.signature OR b.ts > a.ts + INTERVAL 24 HOUR)) AS nxt FROM events_seq a""")
view("sent", "next_sent", """
  SELECT *, TRUE AS changed FROM next_sent WHERE seq = 1
  UNION ALL SELECT n.*, n.signature <> s.signature FROM sent s JOIN next_sent n ON n.symbol = s.symbol AND n.seq = s.nxt""")

view("people", "", """
  SELECT c_custkey AS chat_id, c_nationkey % 4 <> 0 AS accepted,
         CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN CAST(0 AS BIGINT)
              ELSE CAST(1000000000 + floor(c_acctbal) * 1000 AS BIGINT) END AS expiry FROM customer""")
