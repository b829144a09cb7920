"""One SQL text per registered query."""

from __future__ import annotations

from ebbtide.functions import texts as T

from .tables import NOW, RELAXED, STRICT, VIEWS, cdf, cents, greeks, new_york, outcomes, price, query, ranked, view

DAY = "CAST(ts AS DATE) AS day"


def six(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0 AS {n}" for n in names)


def ten(*names: str) -> str:
    return ", ".join(f"round({n}, 10) + 0 AS {n}" for n in names)


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {x})"


view("tight_choice", "chain down", outcomes(1, "secondary", "primary", down=True))
view("down_choice", "chain down", outcomes(91, "primary", "secondary", down=True))
view("dividend", "screen_in", """
  WITH t AS (SELECT *, CASE WHEN spot > 0 AND strike > 0 AND iv > 0 THEN greatest(dte, 1) / CAST(365 AS DOUBLE) END AS yr FROM screen_in),
  d AS (SELECT *, (ln(spot / strike) + (0.045 - 0.02 + 0.5 * iv * iv) * yr) / (iv * sqrt(yr)) AS d1 FROM t),
  n AS (SELECT *, """ + cdf("d1") + " AS n1, " + cdf("(d1 - iv * sqrt(yr))") + """ AS n2,
        exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS phi, exp(-0.02 * yr) AS keep, exp(-0.045 * yr) AS disc FROM d)
  SELECT contract_symbol,
    COALESCE(CASE WHEN option_type = 'call' THEN keep * n1 ELSE keep * (n1 - 1) END, 0) AS delta,
    COALESCE((-(spot * keep * phi * iv) / (2 * sqrt(yr)) + CASE WHEN option_type = 'call'
        THEN -0.045 * strike * disc * n2 + 0.02 * spot * keep * n1
        ELSE 0.045 * strike * disc * (1 - n2) - 0.02 * spot * keep * (1 - n1) END) / 365, 0) AS theta FROM n""")
view("moments", "", """
  SELECT o_orderdate + to_seconds((o_orderkey * 37) % 86400) AS ts FROM orders UNION ALL SELECT ts FROM events""")
view("local", "moments holidays", f"""
  SELECT m.*, CAST(nyt AS DATE) AS day, isodow(nyt) >= 6 AS weekend, h.holiday IS NOT NULL AS is_holiday,
         CAST(nyt AS TIME) AS clock FROM (SELECT ts, {new_york('ts')} AS nyt FROM moments) m
  LEFT JOIN holidays h ON h.day = CAST(m.nyt AS DATE)""")
view("settled_last", "checks bars bench sessions", VIEWS["settled"][1].replace(NOW, "(SELECT max(ts) FROM bars)"))
view("signals1", "scored", "SELECT * FROM scored WHERE liquid AND score >= 1")

GREEK_TAIL = (f"COALESCE(' • IV=' || {fixed('iv * 100', 0)} || '%', '') || COALESCE(' • {T.DELTA}' || {fixed('delta', 2)}, '') "
              f"|| COALESCE(' • {T.THETA}' || {fixed('theta', 3)} || '{T.THETA_UNIT}', '')")
ABOUT = "CASE WHEN estimated THEN '≈' ELSE '' END"
CONTRACT = (f"'{T.STRIKE}' || {fixed('strike', 2)} || '${T.EXPIRES}' || strftime(expiry, '%Y-%m-%d') || ' (' || dte || '{T.DAYS}){T.PREMIUM}' "
            f"|| {ABOUT} || {fixed('premium', 2)} || '$ = ' || {ABOUT} || {fixed('premium * 100', 0)} || '{T.PER_CONTRACT}' || {GREEK_TAIL}")
BREAKEVEN = f"COALESCE('{T.BREAKEVEN_TAIL}' || {fixed('breakeven', 2)} || '$', '')"


def percent(x: str, digits: int) -> str:
    return f"{fixed(f'({x}) * 100', digits)} || '%'"


def reasons() -> str:
    wedge = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.WEDGE_REASONS.items())
    return f"""
  SELECT symbol, price, score, f_boll, f_rsi, f_supp, f_wedge,
    CASE WHEN n_bars >= 21 AND bb_lower IS NOT NULL THEN '{T.LOWER_BAND}' || {price('bb_lower')} ELSE '{T.TOO_FEW_BARS}' END AS bollinger,
    CASE WHEN n_bars >= 15 AND rsi IS NOT NULL THEN 'RSI=' || {fixed('rsi', 1)} ELSE '{T.TOO_FEW_BARS}' END AS rsi,
    CASE WHEN n_lows < 2 THEN '{T.SUPPORT_FEW_LOWS}' WHEN support_level IS NULL THEN '{T.SUPPORT_FAR}'
         ELSE '{T.SUPPORT_AT}' || {price('support_level')} END AS support,
    CASE wedge_state {wedge} END AS wedge FROM scored"""


view("reasons", "scored", reasons())


def alert_text() -> str:
    lines = " || ".join(
        f"chr(10) || '  ' || CASE WHEN {flag} THEN '{T.MATCHED_MARK}' ELSE '{T.MISSED_MARK}' END || ' {T.FILTER_LABELS[k]}: ' || {k}"
        for k, flag in (("bollinger", "f_boll"), ("rsi", "f_rsi"), ("support", "f_supp"), ("wedge", "f_wedge")))
    return (f"SELECT symbol, '{T.ALERT_HEADER} — 10:05 ET' || chr(10) || chr(10) || '*' || symbol || '* — ' || score || '/4 — ' || {price('price')} "
            f"|| {lines} || chr(10) || chr(10) || '{T.ALERT_FOOTER}' AS text FROM reasons")


def best_text() -> str:
    return (f"SELECT symbol, '{T.BEST_CALL_TITLE}' || chr(10) || '    ' || {CONTRACT} "
            f"|| COALESCE(chr(10) || '{T.BREAKEVEN_LINE}' || {fixed('breakeven', 2)} || '$', '') "
            f"|| CASE WHEN estimated THEN chr(10) || '{T.ESTIMATED_NOTE}' ELSE '' END "
            f"|| CASE WHEN relaxed THEN chr(10) || '{T.RELAXED_NOTE}' ELSE '' END AS text FROM best")


def bottom_text() -> str:
    trend = (f"CASE WHEN change_20d < 0 THEN '{T.DECLINE}' || {percent('abs(change_20d)', 1)} || '{T.IN_SESSIONS}' "
             f"ELSE '{T.BELOW_AVERAGE}' END")
    head = (f"'*' || symbol || '* — ' || {price('price')} || ' 📉' || chr(10) || '    ' || {trend} || ' • RSI=' || {fixed('rsi14', 0)} "
            f"|| '{T.ABOVE_LOW}' || {percent('above_52w_low', 1)} || '{T.BELOW_HIGH}' || {percent('off_52w_high', 1)} || chr(10) "
            f"|| '{T.HISTORY}8%{T.WITHIN}30{T.SESSIONS_IN}' || rebounds || '{T.OUT_OF}' || episodes || '{T.SIMILAR}' "
            f"|| CASE WHEN avg_gain >= 0 THEN '+' ELSE '' END || {percent('avg_gain', 1)} || ')'")
    line = f"'    🟢 CALL ' || moneyness || ' • ' || {CONTRACT} || {BREAKEVEN}"
    return (f"SELECT symbol, any_value(head) || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS text FROM ("
            f"SELECT symbol, rank, {head} AS head, {line} AS line FROM "
            f"(SELECT * FROM top_rebounds JOIN bottom USING (symbol))) GROUP BY symbol")


view("top_rebounds", "rebound", "SELECT * FROM rebound WHERE qualifies ORDER BY score DESC, symbol LIMIT 40")

SORTS = {"bid": "bid", "ask": "ask", "volume": "volume", "open_interest": "open_interest", "iv": "iv",
         "delta": "abs(delta)", "theta": "abs(theta)", "spread_pct": "COALESCE(spread_pct, 0)"}
REPORT_LINE = (f"'{T.REPORT_AFTER}' || horizon_h || '{T.REPORT_SIGNALS}' || n || '{T.REPORT_WON}' || {fixed('wins / n * 100', 0)} "
               f"|| '{T.REPORT_MEAN}' || CASE WHEN sum_alpha >= 0 THEN '+' ELSE '' END || {fixed('sum_alpha / n * 100', 2)} || '%'")


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}

    def add(name: str, needs: str, body: str) -> None:
        out[name] = query(needs, body)

    add("S1_S2_bars", "bars", f"SELECT symbol, {DAY}, open, high, low, close, volume FROM bars WHERE close IS NOT NULL")
    add("S1_read_bars", "bars", f"""
      SELECT symbol, {DAY}, open, high, low, close, volume FROM bars WHERE ts >= TIMESTAMP '1995-01-01 00:00:00'""")
    add("S3_latest_close", "bars", "SELECT symbol, arg_max(close, ts) AS last_close FROM bars GROUP BY symbol")
    add("S4_S5_directory_files", "directory", "SELECT symbol, test_issue, etf, source FROM directory")
    add("P1_U1_common_stocks", "directory", """
      SELECT DISTINCT symbol FROM directory WHERE test_issue = 'N' AND etf = 'N' AND length(symbol) <= 5 AND symbol NOT LIKE '%B'""")
    add("P2_S5_all_listed", "directory", "SELECT DISTINCT symbol FROM directory WHERE test_issue <> 'Y' AND etf <> 'Y'")
    out["S6_index_members"] = "SELECT concat('K', s_suppkey, '-', s_nationkey) AS symbol FROM supplier"
    out["S7_ticker_lines"] = """
      SELECT CASE s_nationkey % 4 WHEN 1 THEN concat('S', s_suppkey) ELSE concat('#S', s_suppkey) END AS symbol
      FROM supplier WHERE s_nationkey % 4 IN (1, 2)"""
    add("S8_universe_forms", "directory", """
      SELECT 'index' AS form, concat('K', s_suppkey, '-', s_nationkey) AS symbol FROM supplier
      UNION ALL SELECT DISTINCT 'all', symbol FROM directory WHERE test_issue <> 'Y'
      UNION ALL SELECT 'list', concat('S', i) FROM (VALUES (1), (3), (5), (7)) v(i)
      UNION ALL SELECT 'file', CASE s_nationkey % 4 WHEN 1 THEN concat('S', s_suppkey) ELSE concat('#S', s_suppkey) END
                FROM supplier WHERE s_nationkey % 4 IN (1, 2)
      UNION ALL SELECT 'single', 'S9'""")
    add("S8_J1_universe_bars", "bars", """
      SELECT symbol, count(*) AS n, max(close) AS top FROM bars WHERE symbol IN ('S1', 'S3', 'S5', 'S7') GROUP BY symbol""")
    add("S9_U2_chain", "chain", "SELECT * FROM chain")
    add("S9_F5_read_chain", "chain", """
      SELECT symbol, contract_symbol, option_type, expiry, dte, strike, bid, ask, last, CAST(volume AS DOUBLE) AS volume,
             CAST(open_interest AS DOUBLE) AS open_interest, iv, provider FROM chain WHERE dte <= 60""")
    add("S10_P5_nested_chain", "chain", """
      SELECT symbol, expiry, option_type, CAST(floor(strike * 1000 + 0.5) AS BIGINT) / CAST(1000 AS DOUBLE) AS strike, count(*) AS n,
             CAST(sum(open_interest) AS BIGINT) AS oi, CAST(sum(volume) AS BIGINT) AS volume
      FROM chain GROUP BY ALL""")
    out["S11_F14_headlines"] = """
      WITH t AS (SELECT *, 'Turn ' || turn || ' of ' || conv_id AS title,
                        CASE WHEN conv_id % 3 <> 0 THEN 'Desk ' || (conv_id % 5) END AS publisher
                 FROM conversations WHERE role = 'assistant')
      SELECT 'S' || conv_id AS symbol, 'news' AS kind,
             title || CASE WHEN publisher IS NULL THEN '' ELSE ' (' || publisher || ')' END AS body
      FROM t WHERE NOT (turn % 4 = 1 AND conv_id % 7 = 0)"""
    add("S11_social_messages", "feed", """
      SELECT symbol, kind, row_number() OVER (PARTITION BY symbol ORDER BY rank, body) - 1 AS rank, md5(body) AS body
      FROM feed WHERE kind = 'social'""")
    add("S12_csv_export", "cli", f"""
      SELECT symbol AS ticker, contract_symbol, option_type, expiry, dte, {six('strike', 'spot', 'spread_pct', 'iv', 'delta', 'theta')},
             round(bid, 10) AS bid, round(ask, 10) AS ask, round(mid, 10) AS mid,
             volume, open_interest FROM cli""")
    add("S13_S14_F9_snapshots", "gate", """
      SELECT symbol, 'snapshot' AS origin, FALSE AS fresh_on_monday FROM gate WHERE last_close >= 2 AND avg_volume >= 30000""")

    add("S14_universe_branches", "gate bars", """
      WITH q AS (SELECT symbol FROM gate WHERE last_close >= 2 AND avg_volume >= 30000)
      SELECT symbol, 'snapshot' AS origin FROM q UNION ALL SELECT symbol, 'stale' FROM q
      UNION ALL SELECT DISTINCT symbol, 'rebuilt' FROM bars""")
    add("T7_scan_list", "gate bars", """
      SELECT symbol, 'before' AS "pass", FALSE AS is_full FROM gate WHERE last_close >= 2 AND avg_volume >= 30000
      UNION ALL SELECT DISTINCT symbol, 'after', TRUE FROM bars""")

    add("W1_bollinger", "ind", f"SELECT symbol, {DAY}, {six('bb_lower', 'bb_mid', 'bb_upper')} FROM ind")
    add("W2_gain_loss", "rsi", f"""
      SELECT symbol, {DAY}, delta + 0.0 AS delta, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) + 0.0 END AS gain,
             CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0) + 0.0 END AS loss FROM rsi""")
    add("W3_rsi", "rsi", f"SELECT symbol, {DAY}, {six('rsi')} FROM rsi")
    add("W4_rolling_extremes", "ind", f"SELECT symbol, {DAY}, roll_low, roll_high FROM ind")
    add("W5_sma50", "ind", f"SELECT symbol, {DAY}, {six('sma50')} FROM ind")
    add("W6_change20", "ind", f"SELECT symbol, {DAY}, {six('change_20')} FROM ind")
    add("W7_best_ahead", "ind", f"SELECT symbol, {DAY}, best_ahead FROM ind")
    add("W8_pivots", "piv_all", f"SELECT symbol, {DAY}, pivot_low, pivot_high FROM piv_all")
    add("W9_last_bars", "pos", f"SELECT symbol, {DAY}, pos FROM pos WHERE pos >= n_bars - 120")
    add("W10_positions", "pos", f"SELECT symbol, {DAY}, pos, n_bars FROM pos")
    add("W11_chart_table", "ind support", f"""
      SELECT i.symbol, {DAY}, open, high, low, close, CAST(30 AS DOUBLE) AS rsi_ref,
             {six('bb_lower', 'bb_mid', 'bb_upper', 'rsi')}, {ten('support_level')}
      FROM ind i LEFT JOIN support s ON s.symbol = i.symbol WHERE pos >= n_bars - 80 AND n_bars >= 25""")

    add("A1_P3_liquidity", "gate", f"""
      SELECT symbol, last_close, {six('avg_volume')}, last_close >= 2 AND avg_volume >= 30000 AS liquid FROM gate""")
    add("A3_support_levels", "levels", f"SELECT symbol, {ten('level')} FROM levels")
    add("A4_trend_lines", "lines", f"SELECT symbol, hn, ln, {six('hs', 'hi', 'ls', 'li')} FROM lines")
    add("P13_P14_P15_P16_filters", "scored", f"""
      SELECT symbol, f_boll AS bollinger, f_rsi AS rsi_hit, f_supp AS support, f_wedge AS wedge, wedge_state,
             {six('rsi', 'bb_lower')}, {ten('support_level')} FROM scored""")
    add("P17_scores", "scored", "SELECT symbol, CAST(bar_ts AS DATE) AS day, price, score, signature, liquid FROM scored")
    add("X1_filter_reasons", "reasons", "SELECT symbol, bollinger, rsi, support, wedge FROM reasons")
    add("X1_python_filter", "scored pos", f"""
      WITH m AS (SELECT symbol, n_bars, max(CASE WHEN pos = n_bars - 1 THEN close END) * 30 < sum(close) AS hit FROM pos
                 WHERE pos >= n_bars - 30 GROUP BY symbol, n_bars)
      SELECT s.symbol, s.score + CAST((m.n_bars % 2 = 0 AND m.n_bars >= 30 AND m.hit) AS INT) AS score,
             (m.n_bars % 2 = 0 AND m.n_bars >= 30 AND m.hit) AS mean30,
             CASE WHEN m.n_bars % 2 = 0 AND m.n_bars >= 30 THEN 'below' ELSE '{T.FILTER_FAILED}' END AS reason
      FROM scored s JOIN m ON m.symbol = s.symbol""")
    add("K1_signals_by_score", "scored", "SELECT symbol, price, score, signature FROM scored WHERE liquid AND score >= 2")
    add("A2_scan_stats", "scored", """
      WITH u AS (SELECT concat('S', s_suppkey) AS symbol, FALSE AS down FROM supplier
                 UNION ALL SELECT concat('N', n_nationkey), n_regionkey = 1 FROM nation)
      SELECT count(*) AS total, count(s.symbol) AS with_data, count(*) FILTER (WHERE s.liquid) AS liquid,
             count(*) FILTER (WHERE u.down) AS errors, count(*) FILTER (WHERE s.liquid AND score >= 3) AS matched,
             count(*) FILTER (WHERE s.liquid AND score >= 2) AS hot, round(count(s.symbol) / CAST(count(*) AS DOUBLE), 6) AS data_ratio
      FROM u LEFT JOIN scored s ON s.symbol = u.symbol""")
    add("U3_K7_hot_list", "scored", """
      SELECT symbol FROM (SELECT symbol FROM scored WHERE liquid AND score >= 2
        UNION SELECT concat('S', s_suppkey) FROM supplier WHERE s_nationkey = 3) ORDER BY symbol LIMIT 300""")

    add("P18_dip_zone", "dips", f"SELECT symbol, {DAY}, dip, {six('gain')} FROM dips")
    add("A5_A6_P19_rebound_stats", "rebound", f"""
      SELECT symbol, price, n_bars, dip, episodes, rebounds, declining_now, qualifies,
             {six('change_20d', 'rsi14', 'above_52w_low', 'off_52w_high', 'avg_gain', 'rebound_rate', 'score')} FROM rebound""")
    add("K5_best_rebounds", "top_rebounds", f"SELECT symbol, {six('score')} FROM top_rebounds")

    add("P4_F4_quotes", "quotes", f"""
      SELECT contract_symbol, estimated, bid, ask, premium, {six('spread_pct')}, breakeven, premium * 100 AS contract_cost FROM quotes""")
    add("P6_P8_F5_window", "chain", """
      SELECT symbol, CAST(expiry - DATE '2001-11-05' AS INT) AS dte, count(*) AS n FROM chain
      WHERE option_type = 'put' AND expiry BETWEEN DATE '2001-11-05' AND DATE '2002-02-04' GROUP BY ALL""")
    add("J2_chain_with_spot", "chain", """
      SELECT symbol, count(*) AS n, max(spot) AS spot, count(*) FILTER (WHERE strike < spot) AS itm FROM chain
      WHERE spot > 0 GROUP BY symbol""")
    add("F1_screener_greeks", "screen_greeks", f"SELECT contract_symbol, {six('delta', 'theta', 'theta_pct')} FROM screen_greeks")
    add("F1_greeks_with_dividend", "dividend", f"SELECT contract_symbol, {six('delta', 'theta')} FROM dividend")
    add("F2_call_greeks", "priced", f"SELECT contract_symbol, {six('delta', 'theta')} FROM priced")
    out["F3_normal_law"] = f"""
      WITH t AS (SELECT l_orderkey, l_linenumber, (l_extendedprice - 50000) / 6000 AS x FROM lineitem)
      SELECT l_orderkey, l_linenumber, round({cdf('x')}, 9) AS cdf, round(exp(-x * x / 2) / sqrt(2 * pi()), 9) AS pdf FROM t"""
    add("F17_missing_numbers", "chain", """
      SELECT contract_symbol, CASE WHEN dte % 9 = 0 THEN 0 ELSE COALESCE(iv, 0) END AS iv, volume, open_interest,
             round((bid + ask) / 2, 6) AS mid,
             round(CASE WHEN (bid + ask) / 2 > 0 THEN (ask - bid) / ((bid + ask) / 2) END, 6) AS spread_pct FROM chain""")
    for name, source in (("library", "lib"), ("cli", "cli")):
        add(f"P7_screen_{name}", source, f"""
          SELECT symbol, contract_symbol, dte, strike, bid, ask, {six('delta', 'theta')} FROM {source}""")
    add("P7_screen_no_theta_calls", "screen_greeks", f"""
      SELECT contract_symbol, {six('delta')} FROM screen_greeks WHERE option_type = 'call' AND dte BETWEEN 7 AND 45
      AND volume >= 30 AND open_interest >= 200 AND spread_pct <= 0.4 AND iv BETWEEN 0.15 AND 0.6 AND abs(delta) BETWEEN 0.3 AND 0.9""")
    add("K6_X2_top_contracts", "lib", " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{k}' AS sort_key, contract_symbol FROM lib ORDER BY {e} DESC, contract_symbol LIMIT 25)"
        for k, e in SORTS.items()))
    add("K9_S8_capped_universe", "chain bars", """
      SELECT symbol, count(*) AS n FROM chain WHERE symbol IN (SELECT DISTINCT symbol FROM bars ORDER BY symbol LIMIT 7) GROUP BY symbol""")
    add("P9_call_tiers", "priced", f"""
      SELECT contract_symbol, {STRICT} AS is_strict, {RELAXED} AS is_relaxed FROM priced WHERE option_type = 'call'""")
    add("P10_P11_P12_call_predicates", "quotes", """
      SELECT contract_symbol, dte BETWEEN 30 AND 365 AND premium <= 3 AND strike <= spot * 1.02 AS bottom, premium <= 0.5 AS cheap,
             CASE WHEN strike <= spot * 0.98 THEN 'ITM' ELSE 'ATM' END AS moneyness FROM quotes WHERE option_type = 'call'""")
    add("J5_provider_outcomes", "tight_choice down_choice", """
      SELECT symbol, provider, outcome, 1 AS "window" FROM tight_choice
      UNION ALL SELECT symbol, provider, outcome, 91 FROM down_choice""")
    add("K8_sampled_expiries", "chain", """
      SELECT symbol, provider, dte FROM (
        SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol, provider) AS n
        FROM (SELECT DISTINCT symbol, provider, dte FROM chain WHERE dte <= 91) WINDOW w AS (PARTITION BY symbol, provider ORDER BY dte))
      WHERE provider = 'secondary' OR n <= 6 OR i IN (SELECT CAST(round_even(k.k * ((n - 1) / CAST(5 AS DOUBLE)), 0) AS BIGINT) FROM range(6) k(k))""")
    add("K2_best_call_any_source", "priced", f"""
      SELECT symbol, contract_symbol, NOT {STRICT} AS relaxed, premium, {six('delta')} FROM (
        {ranked('priced', f"option_type = 'call' AND ({STRICT} OR {RELAXED})", f'NOT {STRICT}')}) WHERE rank = 1""")
    add("K2_best_call", "best", f"""
      SELECT symbol, contract_symbol, provider, relaxed, premium, breakeven, {six('delta', 'theta')} FROM best""")
    add("K3_cheap_calls", "cheap", "SELECT symbol, contract_symbol, rank, premium FROM cheap")
    add("K4_bottom_calls", "bottom", "SELECT symbol, contract_symbol, rank, premium, moneyness FROM bottom")

    add("F6_calendar", "holidays", """
      WITH d AS (SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) + k.k AS DATE) AS day FROM orders, (VALUES (0), (9131)) k(k))
      SELECT d.day, isodow(d.day) >= 6 AS is_weekend, h.holiday, isodow(d.day) < 6 AND h.holiday IS NULL AS is_trading_day
      FROM d LEFT JOIN holidays h ON h.day = d.day""")
    regular = "NOT weekend AND clock BETWEEN TIME '09:30:00' AND TIME '16:00:00'"
    add("F7_F8_T6_session", "local", f"""
      SELECT day, count(*) AS n, count(*) FILTER (WHERE {regular}) AS regular,
             count(*) FILTER (WHERE NOT weekend AND clock BETWEEN TIME '09:30:00' AND TIME '16:10:00') AS status_open,
             count(*) FILTER (WHERE weekend OR is_holiday OR NOT ({regular})) AS paused,
             count(*) FILTER (WHERE weekend OR is_holiday) AS paused_days_only FROM local GROUP BY day""")
    add("F9_rebuild_deadline", "local", f"""
      WITH s AS (SELECT DISTINCT ts, nyt, CAST(day AS TIMESTAMP) AS d0 FROM local),
      l AS (SELECT ts, CASE WHEN nyt >= d0 + INTERVAL '19:30' HOUR TO MINUTE THEN d0 + INTERVAL '19:30' HOUR TO MINUTE
                            WHEN nyt >= d0 + INTERVAL '16:30' HOUR TO MINUTE THEN d0 + INTERVAL '16:30' HOUR TO MINUTE
                            ELSE d0 - INTERVAL '4:30' HOUR TO MINUTE END AS x FROM s),
      u AS (SELECT ts, x, x + INTERVAL 4 HOUR AS e FROM l)
      SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at,
             strftime(CASE WHEN {new_york('e')} = x THEN e ELSE e + INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS deadline FROM u
      """.replace("INTERVAL '19:30' HOUR TO MINUTE", "INTERVAL 1170 MINUTE").replace(
        "INTERVAL '16:30' HOUR TO MINUTE", "INTERVAL 990 MINUTE").replace("INTERVAL '4:30' HOUR TO MINUTE", "INTERVAL 270 MINUTE"))

    add("T2_alert_memory", "sent", f"SELECT symbol, {DAY}, alert_id, signature, changed FROM sent")
    add("J4_fresh_against_memory", "sent alerts", f"""
      WITH m AS (SELECT symbol, arg_max(signature, seq) AS signature, max(ts) AS ts FROM sent WHERE ts <= {NOW} GROUP BY symbol)
      SELECT a.symbol, a.alert_id, a.signature FROM alerts a WHERE alert_ts > {NOW} AND NOT EXISTS (
        SELECT 1 FROM m WHERE m.symbol = a.symbol AND m.signature = a.signature AND m.ts >= {NOW} - INTERVAL 48 HOUR)""")
    ok = "(accepted AND (expiry = 0 OR expiry > 1005000000)) IS TRUE"
    add("P20_A10_eligible", "people", f"SELECT chat_id, accepted, expiry, {ok} OR chat_id = 7 AS is_eligible FROM people")
    add("A10_subscription_list", "people", f"SELECT chat_id, accepted, expiry, {ok} AS is_eligible FROM people WHERE expiry IS NOT NULL")
    add("T8_lapsed_subscriptions", "people", """
      SELECT chat_id, CASE WHEN expiry > 0 AND expiry <= 1005000000 THEN 'notified' ELSE 'stays' END AS state FROM people""")
    add("J8_delivery_counts", "sent people", f"""
      SELECT alert_id, (SELECT count(*) FROM people WHERE {ok}) AS recipients FROM sent""")
    add("A11_status", "scored gate sent people", """
      SELECT (SELECT count(*) FROM gate WHERE last_close >= 2 AND avg_volume >= 30000) AS qualified,
             (SELECT count(*) FROM scored WHERE liquid AND score >= 2) AS hot,
             (SELECT count(*) FROM (SELECT symbol, max(ts) AS t FROM sent GROUP BY symbol) WHERE t >= TIMESTAMP '2001-07-31 00:00:00') AS memory,
             (SELECT count(*) FROM people) AS subscribers""")

    add("J6_alert_benchmark_price", "alerts bench", """
      SELECT alert_id, b.close AS bench_price FROM alerts a ASOF LEFT JOIN bench b ON b.ts <= a.alert_ts""")
    add("F16_check_map", "tracked", """
      SELECT alert_id, strftime(alert_ts + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M') AS due_24,
             strftime(alert_ts + INTERVAL 72 HOUR, '%Y-%m-%d %H:%M') AS due_72 FROM tracked""")
    add("J7_T5_settled_checks", "settled", f"""
      SELECT alert_id, symbol, horizon_h, status, attempts, alert_price, bench_price, price_now, bench_now, {six('alpha')} FROM settled""")
    add("A7_performance_fold", "perf", f"SELECT horizon_h, n, wins, {six('sum_alpha')} FROM perf")
    add("A8_Q5_performance_report", "perf", f"""
      SELECT horizon_h, n, wins, round(wins / n * 100, 6) AS win_rate, round(sum_alpha / n * 100, 6) AS mean_alpha, {REPORT_LINE} AS line FROM perf""")
    add("A8_report_text", "perf settled", f"""
      SELECT '{T.REPORT_TITLE}' || chr(10) || (SELECT string_agg({REPORT_LINE}, chr(10) ORDER BY horizon_h) FROM perf)
        || CASE WHEN p > 0 THEN chr(10) || '{T.REPORT_PENDING_HEAD}' || p || '{T.REPORT_PENDING_TAIL}' ELSE '' END AS text
      FROM (SELECT count(DISTINCT alert_id) AS p FROM settled WHERE status = 'pending')""")
    add("A8_compact_line", "perf", f"""
      SELECT horizon_h, '{T.COMPACT_HEAD}' || {fixed('wins / n * 100', 0)} || '{T.COMPACT_LAST}' || n || '{T.COMPACT_AFTER}'
             || horizon_h || '{T.COMPACT_HOURS}' AS line FROM perf WHERE n >= 5 ORDER BY horizon_h LIMIT 1""")

    out["F10_price_text"] = f"""
      WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice / pow(CAST(10 AS DOUBLE), l_linenumber - 1) AS p FROM lineitem)
      SELECT l_orderkey, l_linenumber, {price('p')} AS text FROM t"""
    add("F11_alert_texts", "reasons", alert_text())
    add("F11_best_call_text", "best", best_text())
    add("F11_cheap_blocks", "cheap", f"""
      SELECT symbol, '*' || symbol || '* — ' || {price('max(spot)')} || chr(10)
             || string_agg('    ' || {CONTRACT} || {BREAKEVEN}, chr(10) ORDER BY rank) AS text FROM cheap GROUP BY symbol""")
    add("F11_bottom_blocks", "top_rebounds bottom", bottom_text())
    out["F13_clipped_summaries"] = r"""
      WITH t AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE text END AS text FROM documents)
      SELECT doc_id, md5(CASE WHEN upper(regexp_replace(text, '^\s+|\s+$', '', 'g')) = 'NONE' THEN NULL
                              WHEN length(text) > 500 THEN regexp_replace(substring(text, 1, 500), ' [^ ]*$', '') || '…'
                              ELSE text END) AS digest FROM t"""
    add("K10_first_items", "feed", """
      SELECT symbol, kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY rank) AS rn FROM feed)
      WHERE rn <= CASE kind WHEN 'news' THEN 2 ELSE 3 END AND body <> ''""")
    add("F15_source_digest", "feed", f"""
      WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY rank) AS rn FROM feed)
                 WHERE rn <= CASE kind WHEN 'news' THEN 5 ELSE 20 END AND body <> '')
      SELECT symbol,
        md5(COALESCE(string_agg('- ' || body, chr(10) ORDER BY rank) FILTER (WHERE kind = 'news'), '{T.EMPTY_SOURCE}')) AS headlines,
        md5(COALESCE(string_agg('- ' || body, chr(10) ORDER BY rank) FILTER (WHERE kind = 'social'), '{T.EMPTY_SOURCE}')) AS social
      FROM f GROUP BY symbol""")

    add("Q1_reversal_scan", "signals1 best", """
      SELECT s.symbol, s.price, s.score, s.signature, b.contract_symbol, b.relaxed FROM signals1 s JOIN best b ON b.symbol = s.symbol""")
    add("Q2_check_symbol", "scored best", """
      SELECT s.symbol, s.price, s.score, s.signature, s.liquid, b.contract_symbol, b.premium
      FROM scored s LEFT JOIN best b ON b.symbol = s.symbol WHERE s.symbol = 'S7'""")
    add("Q2_W11_symbol_chart", "ind support", f"""
      SELECT i.symbol, {DAY}, close, CAST(30 AS DOUBLE) AS rsi_ref, {six('bb_lower', 'rsi')}, {ten('support_level')}
      FROM ind i LEFT JOIN support s ON s.symbol = i.symbol WHERE i.symbol = 'S7' AND pos >= n_bars - 80 AND n_bars >= 25""")
    add("Q4_J9_bottom_rebounds", "top_rebounds bottom", """
      SELECT t.symbol, t.price, t.episodes, t.rebounds, round(t.score, 6) AS score, b.contract_symbol, b.rank, b.premium, b.moneyness
      FROM top_rebounds t JOIN bottom b ON b.symbol = t.symbol""")
    add("Q6_options_screener", "cli", f"""
      SELECT symbol, contract_symbol, open_interest, {six('delta', 'theta')} FROM cli
      ORDER BY open_interest DESC, contract_symbol LIMIT 25""")
    add("Q7_J10_active_signals", "scored best", """
      SELECT s.symbol, s.score, s.signature, b.contract_symbol FROM scored s JOIN best b ON b.symbol = s.symbol
      WHERE s.score >= 1 AND s.symbol IN (SELECT concat('S', s_suppkey) FROM supplier WHERE s_nationkey % 2 = 0)""")
    add("T10_hourly_bars", "ticks", """
      SELECT symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, arg_min(price, (ts, event_id)) AS open, max(price) AS high,
             min(price) AS low, arg_max(price, (ts, event_id)) AS close, CAST(sum(size) AS DOUBLE) AS volume
      FROM ticks GROUP BY symbol, date_trunc('hour', ts)""")
    add("T10_bar_stream", "ticks", """
      SELECT symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, arg_min(price, (ts, event_id)) AS open, max(price) AS high,
             min(price) AS low, arg_max(price, (ts, event_id)) AS close, CAST(sum(size) AS DOUBLE) AS volume
      FROM ticks GROUP BY symbol, date_trunc('hour', ts)""")
    add("T2_T3_alert_stream", "sent best", f"""
      SELECT symbol, {DAY}, alert_id, signature FROM sent WHERE symbol IN (SELECT symbol FROM best)""")
    add("T1_T6_scan_stream", "signals1", "SELECT symbol, CAST(bar_ts AS DATE) AS day, price, score, signature FROM signals1")
    add("T4_hot_lane", "signals1", """
      SELECT symbol, CAST(bar_ts AS DATE) AS day, score, signature, TRUE AS is_hot FROM signals1 WHERE symbol IN (
        SELECT symbol FROM signals1 WHERE symbol IN (SELECT concat('S', s_suppkey) FROM supplier WHERE s_nationkey % 2 = 0)
        ORDER BY symbol LIMIT 300)""")
    add("T5_horizon_stream", "settled_last", f"""
      SELECT alert_id, horizon_h, status, attempts, {six('alpha')} FROM settled_last WHERE status <> 'pending'""")
    return out
