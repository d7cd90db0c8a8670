"""DuckDB SQL for the market queries, written apart from the operators."""

from __future__ import annotations

from .queries import CIK_JSON, DIGITS, LIMITS, PAGE_TYPE, WANTED, WEIGHTS


def _bars(name: str, ticker: str) -> str:
    key = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
    qty = "CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE)"
    return f"""{name} AS (
        SELECT {ticker} AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
               arg_min(l_extendedprice / l_quantity, {key}) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / {qty} AS close,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) / {qty} AS adjusted_close
        FROM lineitem GROUP BY 1, 2)"""


BARS = _bars("bars", "'T' || (l_suppkey % 5)")
ADJUSTED_BARS = _bars("all_bars", "'T' || (l_suppkey % 5)") + ", bars AS (SELECT * REPLACE (adjusted_close AS close) FROM all_bars)"
YEAR_BARS = _bars("all_bars", "'T' || (l_suppkey % 5)") + ", bars AS (SELECT * REPLACE (adjusted_close AS close) FROM all_bars WHERE date >= (SELECT max(date) FROM all_bars) - INTERVAL 365 DAY)"
COMPANY_BARS = _bars("bars", "'S' || l_suppkey")
RECENT_BARS = _bars("all_bars", "'S' || l_suppkey") + ", bars AS (SELECT * FROM all_bars WHERE date >= (SELECT max(date) FROM all_bars) - INTERVAL 6 MONTH)"


def _out(select: str, doubles: str = "", ctes: str = "") -> str:
    """The select, its doubles rounded, behind its CTEs."""
    replace = ", ".join(f"round({c}, /*digits*/) + 0.0 AS {c}" for c in doubles.split())
    star = f"* REPLACE ({replace})" if replace else "*"
    return f"{'WITH RECURSIVE ' + ctes if ctes else ''} SELECT {star} FROM ({select}) q"


_W = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _roll(f: str, c: str, n: int) -> str:
    w = _W.format(n - 1)
    return f"CASE WHEN count({c}) OVER {w} = {n} THEN {f}({c}) OVER {w} END"


RSI = f"""moved AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) AS dx FROM bars),
    gl AS (SELECT *, {_roll('avg', 'greatest(dx, 0)', 14)} AS g, {_roll('avg', 'greatest(-dx, 0)', 14)} AS l FROM moved),
    rsi AS (SELECT ticker, date, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN l = 0 AND g > 0 THEN 100.0 END AS rsi FROM gl)"""
EMA = """num AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars),
    ema AS (SELECT ticker, n, date, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS sig FROM num WHERE n = 1
            UNION ALL
            SELECT num.ticker, num.n, num.date, e12 + (close - e12) * 2 / 13, e26 + (close - e26) * 2 / 27,
                   sig + ((e12 + (close - e12) * 2 / 13) - (e26 + (close - e26) * 2 / 27) - sig) * 2 / 10
            FROM ema JOIN num ON num.ticker = ema.ticker AND num.n = ema.n + 1)"""
INDICATORS = f"""{RSI}, {EMA},
    ind AS (SELECT b.ticker, b.date, open, high, low, close, volume, r.rsi, e12 - e26 AS macd, sig AS macd_signal, (e12 - e26) - sig AS macd_histogram,
            {_roll('avg', 'close', 20)} AS sma_20, {_roll('avg', 'close', 50)} AS sma_50, {_roll('avg', 'close', 200)} AS sma_200,
            {_roll('avg', 'close', 20)} + 2 * {_roll('stddev_samp', 'close', 20)} AS bb_upper, {_roll('avg', 'close', 20)} - 2 * {_roll('stddev_samp', 'close', 20)} AS bb_lower,
            {_roll('avg', 'volume', 20)} AS volume_sma, coalesce(volume / ({_roll('avg', 'volume', 20)}), 1.0) AS volume_ratio,
            {_roll('max', 'high', 20)} AS resistance, {_roll('min', 'low', 20)} AS support,
            (close / lag(close, 1) OVER w - 1) * 100 AS price_change_1d, (close / lag(close, 5) OVER w - 1) * 100 AS price_change_5d, (close / lag(close, 21) OVER w - 1) * 100 AS price_change_1mo,
            count(*) OVER (PARTITION BY b.ticker) AS n_bars, row_number() OVER (PARTITION BY b.ticker ORDER BY b.date DESC) AS back
            FROM bars b JOIN (SELECT ticker AS rt, date AS rd, rsi FROM rsi) r ON b.ticker = r.rt AND b.date = r.rd
            JOIN (SELECT ticker AS et, date AS ed, e12, e26, sig FROM ema) e ON b.ticker = e.et AND b.date = e.ed
            WINDOW w AS (PARTITION BY ticker ORDER BY date)),
    last AS (SELECT * FROM ind WHERE back = 1 AND n_bars >= 22),
    sig0 AS (SELECT *, list_filter([CASE WHEN close > sma_20 THEN 'Price above 20-day MA (bullish)' ELSE 'Price below 20-day MA (bearish)' END,
            CASE WHEN sma_20 > sma_50 AND sma_50 > sma_200 THEN 'All MAs in bullish alignment' END,
            CASE WHEN rsi > 70 THEN 'RSI > 70 (overbought)' WHEN rsi < 30 THEN 'RSI < 30 (oversold)' ELSE 'RSI neutral' END,
            CASE WHEN macd > macd_signal THEN 'MACD bullish' ELSE 'MACD bearish' END,
            CASE WHEN volume_ratio > 1.5 THEN 'High volume (significant move)' END,
            CASE WHEN close > resistance * 0.98 THEN 'Near resistance level' WHEN close < support * 1.02 THEN 'Near support level' END], lambda x: x IS NOT NULL) AS s FROM last),
    sig1 AS (SELECT *, len(list_filter(s, lambda x: contains(lower(x), 'bullish'))) AS up, len(list_filter(s, lambda x: contains(lower(x), 'bearish'))) AS down FROM sig0),
    tech AS (SELECT * EXCLUDE (s), list_append(s, 'Overall bias: ' || CASE WHEN up > down THEN 'Bullish' WHEN down > up THEN 'Bearish' ELSE 'Neutral' END) AS signals FROM sig1)"""
RETURNS = """grid AS (SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM bars) t, (SELECT DISTINCT date FROM bars) d),
    pad AS (SELECT g.ticker, g.date, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS p
            FROM grid g LEFT JOIN bars b ON g.ticker = b.ticker AND g.date = b.date),
    ret AS (SELECT ticker, date, p / lag(p) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM pad),
    al AS (SELECT * FROM ret WHERE date IN (SELECT date FROM ret GROUP BY date HAVING count(ret) = (SELECT count(DISTINCT ticker) FROM bars)))"""
MOMENTS = RETURNS + """,
    mu AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS j, avg(ret) AS m FROM al GROUP BY ticker),
    sg AS (SELECT a.ticker AS ticker_i, b.ticker AS ticker_j, covar_samp(a.ret, b.ret) AS cov FROM al a JOIN al b ON a.date = b.date GROUP BY 1, 2)"""


def _measure(weights: str) -> str:
    """CTEs: weights w (pid, ticker, w) measured as m (portfolio_id, expected_return, volatility, sharpe_ratio)."""
    return f"""{weights},
    er AS (SELECT pid, sum(w.w * mu.m) * 252 AS r FROM w JOIN mu ON w.ticker = mu.ticker GROUP BY pid),
    vo AS (SELECT a.pid, sqrt(sum(a.w * b.w * sg.cov) * 252) AS v, sqrt(sum(a.w * b.w * sg.cov)) AS v0 FROM w a JOIN w b ON a.pid = b.pid JOIN sg ON sg.ticker_i = a.ticker AND sg.ticker_j = b.ticker GROUP BY a.pid),
    m AS (SELECT er.pid AS portfolio_id, r AS expected_return, v AS volatility, CASE WHEN v > 0 THEN (r - 0.04) / v ELSE 0.0 END AS sharpe_ratio FROM er JOIN vo ON er.pid = vo.pid)"""


CLOUD = MOMENTS + "," + _measure("""raw AS (SELECT p.pid, mu.ticker, ('0x' || substr(md5(p.pid || ':' || mu.j), 1, 8))::BIGINT + 1 AS x FROM (SELECT range AS pid FROM range(10000)) p, mu),
    w AS (SELECT pid, ticker, x / sum(x) OVER (PARTITION BY pid) AS w FROM raw)""") + """,
    bs AS (SELECT portfolio_id FROM m ORDER BY sharpe_ratio DESC, portfolio_id LIMIT 1), bv AS (SELECT portfolio_id FROM m ORDER BY volatility, portfolio_id LIMIT 1)"""
_LO, _HI = LIMITS
LIMITED = f"""raw AS (SELECT p.pid, mu.ticker, ('0x' || substr(md5(p.pid || ':' || mu.j), 1, 8))::BIGINT + 1 AS x FROM (SELECT range AS pid FROM range(10000)) p, mu),
    w AS (SELECT pid, ticker, x / sum(x) OVER (PARTITION BY pid) AS w FROM raw),
    pt AS (SELECT pid, w - {_HI} AS bp FROM w UNION SELECT pid, w - {_LO} FROM w ),
    fv AS (SELECT pt.pid, bp, sum(greatest({_LO}, least({_HI}, v.w - bp))) AS f FROM pt JOIN (SELECT * FROM w ) v ON v.pid = pt.pid GROUP BY 1, 2),
    st AS (SELECT *, lead(bp) OVER (PARTITION BY pid ORDER BY bp) AS nat, lead(f) OVER (PARTITION BY pid ORDER BY bp) AS nf FROM fv),
    sh AS (SELECT pid, min(CASE WHEN f > nf THEN bp + greatest(f - 1, 0) * (nat - bp) / (f - nf) ELSE bp END) AS shift FROM st WHERE f >= 1 - 1e-12 AND nf <= 1 + 1e-12 GROUP BY pid),
    lw AS (SELECT v.pid, ticker, v.w, greatest({_LO}, least({_HI}, v.w - shift)) AS limited_w FROM (SELECT * FROM w ) v JOIN sh ON sh.pid = v.pid)"""
METRICS_MANY = """SELECT pid AS portfolio_id, total_return, annual_return, annual_volatility, CASE WHEN annual_volatility > 0 THEN (annual_return - 0.04) / annual_volatility ELSE 0.0 END AS sharpe_ratio,
            CASE WHEN downside > 0 THEN (annual_return - 0.04) / downside ELSE 0.0 END AS sortino_ratio, CASE WHEN max_drawdown <> 0 THEN annual_return / abs(max_drawdown) ELSE 0.0 END AS calmar_ratio, max_drawdown, win_rate, avg_win, avg_loss,
            CASE WHEN lost <> 0 THEN abs(won / lost) ELSE 0.0 END AS profit_factor
        FROM (SELECT *, total_return * 252 / n AS annual_return FROM (SELECT pid, count(*) AS n, product(1 + ret) - 1 AS total_return, stddev_samp(ret) * sqrt(252) AS annual_volatility, min((cumulative - peak) / peak) AS max_drawdown,
            coalesce(sqrt(avg(ret * ret) FILTER (ret < 0)) * sqrt(252), 0.0) AS downside, (count(*) FILTER (ret > 0)) / count(*) AS win_rate, coalesce(avg(ret) FILTER (ret > 0), 0.0) AS avg_win, coalesce(avg(ret) FILTER (ret < 0), 0.0) AS avg_loss,
            coalesce(sum(ret) FILTER (ret > 0), 0.0) AS won, coalesce(sum(ret) FILTER (ret < 0), 0.0) AS lost
        FROM (SELECT *, max(cumulative) OVER (PARTITION BY pid ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak
              FROM (SELECT pid, date, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY pid ORDER BY date)) AS cumulative
                    FROM (SELECT w.pid, al.date, sum(al.ret * w.w) AS ret FROM al JOIN w ON al.ticker = w.ticker GROUP BY 1, 2))) GROUP BY pid))"""
_GIVEN = ", ".join(f"('{t}', {w})" for t, w in WEIGHTS.items())
SERIES = RETURNS + f""", gw AS (SELECT * FROM (VALUES {_GIVEN}) v(ticker, w)),
    s AS (SELECT date, sum(ret * w) AS ret FROM al JOIN gw ON al.ticker = gw.ticker GROUP BY date),
    cu AS (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS cumulative FROM s),
    dd AS (SELECT *, max(cumulative) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM cu)"""
COMPANIES = """co AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS ticker, s_name, n_name, r_name, r, 1000000.0::DOUBLE AS shares, 20.0::DOUBLE + (s_suppkey % 10) * 10 AS price,
        r * ((s_suppkey % 9) - 2) / 20 AS ni, r * ((s_suppkey % 6) - 1) / 4 AS eq, r * ((s_suppkey % 8) - 2) / 20 AS ocf, -r * (s_suppkey % 3) / 40 AS capex
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        JOIN (SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS r FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""
ITEMS = """it AS (SELECT ticker, statement, item, value FROM (
        SELECT ticker, 'income' AS statement, CASE WHEN k % 4 = 0 THEN 'Revenue' ELSE 'Total Revenue' END AS item, r AS value FROM co UNION ALL
        SELECT ticker, 'balance', CASE WHEN k % 2 = 1 THEN 'Total Current Assets' ELSE 'Current Assets' END, r * (0.5 + (k % 7) * 0.4) FROM co UNION ALL
        SELECT ticker, 'balance', CASE WHEN k % 2 = 1 THEN 'Total Current Liabilities' ELSE 'Current Liabilities' END, r FROM co UNION ALL
        SELECT ticker, 'balance', 'Total Liabilities', r * (k % 5) / 8 FROM co UNION ALL
        SELECT ticker, 'balance', 'Total Assets', r * 2 FROM co UNION ALL
        SELECT ticker, 'balance', CASE WHEN k % 3 = 0 THEN 'Stockholders'' Equity' ELSE 'Total Equity' END, eq FROM co UNION ALL
        SELECT ticker, 'income', 'Net Income', ni FROM co UNION ALL
        SELECT ticker, 'income', 'Operating Income', r * ((k % 9) - 1) / 15 FROM co UNION ALL
        SELECT ticker, 'income', 'Interest Expense', -r * (k % 4) / 50 FROM co UNION ALL
        SELECT ticker, 'cashflow', CASE WHEN k % 5 = 4 THEN 'Cash Flow From Continuing Operating Activities' ELSE 'Operating Cash Flow' END, ocf FROM co UNION ALL
        SELECT ticker, 'cashflow', CASE WHEN k % 2 = 0 THEN 'Capital Expenditures' ELSE 'Capital Expenditure' END, capex FROM co UNION ALL
        SELECT ticker, 'cashflow', 'Free Cash Flow', ocf - abs(capex) FROM co WHERE k % 10 <> 9))"""
INFO = """inf AS (SELECT ticker, k, CASE WHEN k % 8 <> 7 THEN s_name END AS long_name, CASE WHEN k % 8 <> 7 THEN r_name END AS sector, CASE WHEN k % 8 <> 7 THEN n_name END AS industry, n_name AS country,
        price * shares AS cap, shares, price, CASE WHEN ni > 0 THEN price / (ni / shares) END AS pe, CASE WHEN eq > 0 THEN price / (eq / shares) END AS pb, price / (r / shares) AS ps,
        CASE WHEN k % 7 <> 6 THEN 5.0 + k % 13 END AS ev, ni / shares AS eps, eq / shares AS bv, r / shares AS sps, CASE WHEN k % 5 <> 0 THEN ((k % 7) - 1) * 0.05 END AS eg,
        (k % 10) / 20 AS gm, ((k % 6) - 2) * 0.04 AS rg FROM co)"""
# the fixtures report every item, so an item's column is its value (0 counts as missing, which is 0 again)
RATIOS = COMPANIES + "," + INFO + """,
    f AS (SELECT ticker, 2 * r AS total_assets, r * (0.5 + (k % 7) * 0.4) AS current_assets, r AS current_liabilities, r * (k % 5) / 8 AS total_liabilities, eq AS total_equity, r AS revenue, ni AS net_income,
          r * ((k % 9) - 1) / 15 AS operating_income, abs(-r * (k % 4) / 50) AS interest_expense, ocf AS operating_cash_flow, abs(capex) AS capex FROM co),
    ra AS (SELECT f.*, inf.long_name, inf.rg, CASE WHEN current_liabilities > 0 THEN current_assets / current_liabilities END AS current_ratio,
           CASE WHEN total_equity > 0 THEN total_liabilities / total_equity END AS debt_to_equity,
           CASE WHEN total_equity > 0 THEN CASE WHEN total_assets > 0 THEN total_liabilities / total_assets ELSE 0 END END AS debt_to_assets,
           CASE WHEN revenue > 0 THEN coalesce(gm, 0) END AS gross_margin, CASE WHEN revenue > 0 THEN operating_income / revenue END AS operating_margin, CASE WHEN revenue > 0 THEN net_income / revenue END AS net_margin,
           CASE WHEN total_equity > 0 THEN net_income / total_equity END AS return_on_equity, CASE WHEN total_assets > 0 THEN net_income / total_assets END AS return_on_assets,
           CASE WHEN interest_expense > 0 THEN operating_income / interest_expense END AS interest_coverage, CASE WHEN capex > 0 THEN operating_cash_flow / capex END AS capex_coverage,
           operating_cash_flow - capex AS free_cash_flow, CASE WHEN revenue > 0 THEN (operating_cash_flow - capex) / revenue ELSE 0 END AS fcf_margin
           FROM f JOIN inf ON f.ticker = inf.ticker)"""
RATIO_NAMES = "current_ratio debt_to_equity debt_to_assets gross_margin operating_margin net_margin return_on_equity return_on_assets interest_coverage capex_coverage free_cash_flow fcf_margin"


def _score(roe: bool) -> str:
    bench = "('current_ratio', 1, 1.5, 2.0), ('debt_to_equity', -1, 0.5, 0.3), ('interest_coverage', 1, 3.0, 5.0), ('net_margin', 1, 0.10, 0.15)" + (", ('return_on_equity', 1, 0.15, 0.20)" if roe else "")
    names = ", ".join(RATIO_NAMES.split())
    return f"""un AS (UNPIVOT (SELECT ticker, {names} FROM ra) ON {names} INTO NAME ratio_name VALUE v),
    hs0 AS (SELECT ticker, sum(CASE WHEN v * sgn >= good * sgn THEN 1.0 WHEN v * sgn >= bound * sgn THEN 0.5 ELSE 0.0 END) / count(*) AS s FROM un JOIN (VALUES {bench}) b(ratio_name, sgn, bound, good) USING (ratio_name) GROUP BY ticker),
    hs AS (SELECT ra.*, coalesce(s, 0.0)::DOUBLE AS health_score, CASE WHEN s >= 0.8 THEN 'Excellent' WHEN s >= 0.6 THEN 'Good' WHEN s >= 0.4 THEN 'Fair' ELSE 'Poor' END AS health_status FROM ra LEFT JOIN hs0 ON ra.ticker = hs0.ticker)"""


HEALTH = RATIOS + "," + _score(False) + """,
    he AS (SELECT *, list_filter([CASE WHEN coalesce(current_ratio, 0) < 1 THEN 'High liquidity risk (current ratio < 1.0)' WHEN current_ratio < 1.5 THEN 'Moderate liquidity risk (current ratio < 1.5)' END,
        CASE WHEN debt_to_equity > 1 THEN 'High leverage risk (debt/equity > 1.0)' WHEN debt_to_equity > 0.5 THEN 'Moderate leverage risk (debt/equity > 0.5)' END,
        CASE WHEN coalesce(net_margin, 0) < 0.05 THEN 'Low profitability (net margin < 5%)' END, CASE WHEN free_cash_flow < 0 THEN 'Negative free cash flow' END, CASE WHEN rg < 0 THEN 'Declining revenue' END], lambda x: x IS NOT NULL) AS risks,
        list_filter([CASE WHEN health_score < 0.4 THEN 'Avoid - poor financial health' WHEN health_score < 0.6 THEN 'Caution - monitor closely' END,
        CASE WHEN coalesce(current_ratio, 0) < 1.5 THEN 'Improve working capital management' END, CASE WHEN debt_to_equity > 0.5 THEN 'Reduce debt levels' END, CASE WHEN free_cash_flow > 0 THEN 'Strong cash flow generation' END], lambda x: x IS NOT NULL) AS advice FROM hs)"""
VALUES = COMPANIES + "," + ITEMS + "," + INFO + """,
    fc AS (SELECT a.ticker, a.value AS fcf FROM it a WHERE a.item = 'Free Cash Flow' AND a.value > 0 AND EXISTS (SELECT 1 FROM it b WHERE b.ticker = a.ticker AND b.item = 'Operating Cash Flow')),
    yr AS (SELECT ticker, CAST(y.range AS INTEGER) AS year, fc.fcf * pow(1.05, y.range) AS fcf FROM fc, range(1, 6) y),
    dcf0 AS (SELECT ticker, sum(fcf / pow(1.08, year)) + max(CASE WHEN year = 5 THEN fcf END) * 1.025 / 0.055 / pow(1.08, 5) AS total FROM yr GROUP BY ticker),
    dcf AS (SELECT inf.ticker, price AS current_price, total / shares AS fair_value, (total / shares - price) / price * 100 AS upside, fc.fcf, 0.05::DOUBLE AS growth_rate, 0.08::DOUBLE AS discount_rate, total / shares > price AS is_undervalued FROM dcf0 JOIN fc USING (ticker) JOIN inf USING (ticker)),
    pa AS (SELECT coalesce(sector, 'Unknown') AS grp, count(*) AS peer_count, avg(nullif(pe, 0)) AS avg_pe, avg(nullif(pb, 0)) AS avg_pb, avg(nullif(ps, 0)) AS avg_ps FROM inf WHERE pe IS NOT NULL AND pb IS NOT NULL AND ps IS NOT NULL AND ev IS NOT NULL GROUP BY 1),
    gr AS (SELECT ticker, price AS current_price, sqrt(22.5 * eps * bv) AS graham_number, least(coalesce(eg, 0.05), 0.15)::DOUBLE AS growth_assumption, eps, bv AS book_value, eps * (8.5 + 2 * least(coalesce(eg, 0.05), 0.15)) AS intrinsic_value FROM inf WHERE eps > 0 AND bv > 0)"""


def _comps(averages: str, on: str) -> str:
    return f"""cm AS (SELECT inf.ticker, price AS current_price, eps * avg_pe AS implied_pe_price, bv * avg_pb AS implied_pb_price, sps * avg_ps AS implied_ps_price, peer_count, avg_pe, avg_pb, avg_ps FROM inf JOIN {averages} ON {on}),
    cp0 AS (SELECT *, coalesce(list_avg(list_filter([implied_pe_price, implied_pb_price, implied_ps_price], lambda x: x > 0)), 0.0) AS implied_price FROM cm),
    cp AS (SELECT *, (implied_price - current_price) / current_price * 100 AS upside FROM cp0)"""


SECTOR = VALUES + "," + _comps("pa", "coalesce(inf.sector, 'Unknown') = pa.grp")
SUMMARY = SECTOR + """,
    iv AS (SELECT ticker, 'DCF' AS method, fair_value AS value, upside, 1 AS o, current_price FROM dcf WHERE fair_value > 0 UNION ALL
           SELECT ticker, 'Comparables', implied_price, upside, 2, current_price FROM cp WHERE implied_price > 0 UNION ALL
           SELECT ticker, 'Graham', intrinsic_value, (intrinsic_value * 0.75 - current_price) / current_price * 100, 3, current_price FROM gr WHERE intrinsic_value > 0),
    sm AS (SELECT ticker, any_value(current_price) AS current_price, avg(value) AS average_fair_value, avg(upside) AS average_upside, avg(value) > any_value(current_price) AS is_undervalued, min(value) AS range_min, max(value) AS range_max FROM iv GROUP BY ticker)"""
REPORT = RECENT_BARS + "," + INDICATORS + "," + HEALTH + "," + SUMMARY.replace(COMPANIES + "," + ITEMS + "," + INFO, ITEMS) + """,
    re0 AS (SELECT inf.ticker, sm.current_price, sm.average_fair_value, sm.average_upside, coalesce(sm.is_undervalued, false) AS uv, he.health_score, he.health_status, coalesce(he.risks, []) AS hr, dcf.fcf AS dfcf, tech.rsi, coalesce(tech.signals, []) AS sig,
            len(list_filter(coalesce(tech.signals, []), lambda x: contains(lower(x), 'bullish'))) AS bu, len(list_filter(coalesce(tech.signals, []), lambda x: contains(lower(x), 'bearish'))) AS be
            FROM inf LEFT JOIN sm ON sm.ticker = inf.ticker LEFT JOIN he ON he.ticker = inf.ticker LEFT JOIN dcf ON dcf.ticker = inf.ticker LEFT JOIN tech ON tech.ticker = inf.ticker),
    re1 AS (SELECT *, CASE WHEN uv THEN 40 WHEN average_upside > 10 THEN 30 WHEN average_upside > 0 THEN 20 ELSE 10 END + coalesce(health_score, 0) * 40 + CASE WHEN bu > be THEN 20 WHEN be > bu THEN 5 ELSE 12 END AS score,
            list_concat(list_filter(hr, lambda x: contains(x, 'High') OR contains(x, 'Negative')), list_filter([CASE WHEN coalesce(dfcf, 0) <= 0 THEN 'Negative or zero free cash flow' END, CASE WHEN rsi > 80 THEN 'Extremely overbought (RSI > 80)' END], lambda x: x IS NOT NULL)) AS hi,
            list_concat(list_filter(hr, lambda x: contains(x, 'Moderate')), list_filter([CASE WHEN rsi > 70 AND rsi <= 80 THEN 'Overbought (RSI > 70)' END], lambda x: x IS NOT NULL)) AS me,
            list_filter(hr, lambda x: NOT contains(x, 'High') AND NOT contains(x, 'Negative') AND NOT contains(x, 'Moderate')) AS lo FROM re0),
    re AS (SELECT *, CASE WHEN score >= 80 THEN 'STRONG BUY' WHEN score >= 65 THEN 'BUY' WHEN score >= 50 THEN 'HOLD' WHEN score >= 35 THEN 'SELL' ELSE 'STRONG SELL' END AS recommendation,
            CASE WHEN score >= 80 THEN 'High' WHEN score >= 65 THEN 'Medium' WHEN score >= 50 THEN 'Low' WHEN score >= 35 THEN 'Medium' ELSE 'High' END AS confidence,
            len(hi) + len(me) + len(lo) AS total, CASE WHEN len(hi) > 2 THEN 'High' WHEN len(hi) + len(me) + len(lo) > 3 THEN 'Medium' ELSE 'Low' END AS overall_risk FROM re1)"""
_PRICES = "open high low close adjusted_close"
_FACTS = "expected_return volatility sharpe_ratio"
_WIDE = ", ".join(f"max(CASE WHEN mu.j = {i} THEN w.w END) AS w{i}" for i in range(5))


def _pick(best: str) -> str:
    return _out(f"SELECT m.portfolio_id, any_value(expected_return) AS expected_return, any_value(volatility) AS volatility, any_value(sharpe_ratio) AS sharpe_ratio, {_WIDE} FROM m JOIN {best} USING (portfolio_id) JOIN w ON w.pid = m.portfolio_id JOIN mu ON mu.ticker = w.ticker GROUP BY m.portfolio_id", f"{_FACTS} w0 w1 w2 w3 w4", ADJUSTED_BARS + "," + CLOUD)


_RECORD = "SELECT ticker, close AS current_price, rsi, macd, macd_signal, macd_histogram, bb_upper, bb_lower, volume_sma, volume AS current_volume, volume_ratio, price_change_1d, price_change_5d, price_change_1mo, resistance, support, high, low, open, volume, sma_20, sma_50, sma_200, CAST(len(signals) AS INTEGER) AS n_signals FROM tech"
_RECORD_DOUBLES = "current_price rsi macd macd_signal macd_histogram bb_upper bb_lower volume_sma volume_ratio price_change_1d price_change_5d price_change_1mo resistance support high low open sma_20 sma_50 sma_200"
_WHY = """CASE WHEN uv THEN 'Stock appears undervalued based on multiple valuation methods.' ELSE 'Stock appears fairly valued or overvalued.' END || ' ' ||
        CASE health_status WHEN 'Excellent' THEN 'Excellent financial health with strong fundamentals.' WHEN 'Good' THEN 'Good financial health with solid fundamentals.' WHEN 'Fair' THEN 'Fair financial health, monitor closely.' ELSE 'Poor financial health, significant risks present.' END ||
        CASE WHEN bu > 0 THEN ' Technical indicators show bullish momentum.' WHEN be > 0 THEN ' Technical indicators show bearish momentum.' ELSE '' END"""
_FULL = """SELECT re.*, dcf.fair_value AS dcf_value, cp.implied_price, gr.intrinsic_value, he.current_ratio, coalesce(he.long_name, he.ticker) AS company_name, tech.macd, tech.close AS price
        FROM re LEFT JOIN dcf ON dcf.ticker = re.ticker LEFT JOIN cp ON cp.ticker = re.ticker LEFT JOIN gr ON gr.ticker = re.ticker LEFT JOIN he ON he.ticker = re.ticker LEFT JOIN tech ON tech.ticker = re.ticker"""


def _facts(name: str, source: str) -> str:
    return ", ".join(f"(SELECT {f} FROM {source}) AS {name}_{f}" for f in _FACTS.split())


ORACLES = {
    "latest_averages": _out(f"SELECT ticker, date, close, sma_20, sma_50, sma_200 FROM (SELECT *, {_roll('avg', 'close', 20)} AS sma_20, {_roll('avg', 'close', 50)} AS sma_50, {_roll('avg', 'close', 200)} AS sma_200, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM bars) WHERE b = 1", "close sma_20 sma_50 sma_200", BARS),
    "weekly_bars": _out("SELECT * FROM bars", _PRICES, BARS),
    "price_scan_period": _out("SELECT * FROM bars WHERE date >= (SELECT max(date) FROM bars) - INTERVAL 6 MONTH", _PRICES, BARS),
    "adjusted_scan_365d": _out("SELECT ticker, date, adjusted_close FROM bars WHERE ticker IN ('T1', 'T3') AND date >= (SELECT max(date) FROM bars) - 365", "adjusted_close", BARS),
    "company_info_defaults": _out("SELECT ticker, coalesce(long_name, ticker) AS name, coalesce(sector, 'Unknown') AS sector, coalesce(industry, 'Unknown') AS industry, country, cap AS market_cap, '' AS description FROM inf", "market_cap", COMPANIES + "," + INFO),
    "parse_ticker_list": "SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS pos, t AS ticker FROM (SELECT unnest(list_filter(list_transform(string_split('aapl, MSFT ,, amzn,none', ','), lambda x: upper(trim(x))), lambda x: x <> '')) AS t)",
    "latest_bar": _out("SELECT * EXCLUDE (b) FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM bars) WHERE b = 1", _PRICES, BARS),
    "sma_20_50_200": _out(f"SELECT ticker, date, {_roll('avg', 'close', 20)} AS sma_20, {_roll('avg', 'close', 50)} AS sma_50, {_roll('avg', 'close', 200)} AS sma_200 FROM bars", "sma_20 sma_50 sma_200", COMPANY_BARS),
    "indicator_state": _out("SELECT ticker, date, close, n_bars, sma_20, sma_50, sma_200, bb_upper, bb_lower, volume_sma, volume_ratio, price_change_1d, price_change_5d, price_change_1mo, resistance, support, rsi, macd, macd_signal, macd_histogram FROM ind WHERE back = 1", "close sma_20 sma_50 sma_200 bb_upper bb_lower volume_sma volume_ratio price_change_1d price_change_5d price_change_1mo resistance support rsi macd macd_signal macd_histogram", COMPANY_BARS + "," + INDICATORS),
    "sma_from_store": _out(f"SELECT ticker, date, {_roll('avg', 'close', 20)} AS sma_20, {_roll('avg', 'close', 50)} AS sma_50, {_roll('avg', 'close', 200)} AS sma_200 FROM bars", "sma_20 sma_50 sma_200", COMPANY_BARS),
    "price_diff": _out("SELECT ticker, date, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS change FROM bars", "change", BARS),
    "rsi_14": _out("SELECT * FROM rsi", "rsi", BARS + "," + RSI),
    "ema_12_26": _out("SELECT ticker, date, e12 AS ema_12, e26 AS ema_26 FROM ema", "ema_12 ema_26", BARS + "," + EMA),
    "macd": _out("SELECT ticker, date, e12 - e26 AS macd, sig AS macd_signal, (e12 - e26) - sig AS macd_histogram FROM ema", "macd macd_signal macd_histogram", BARS + "," + EMA),
    "bollinger_20_2": _out("SELECT ticker, date, bb_upper, bb_lower FROM ind", "bb_upper bb_lower", BARS + "," + INDICATORS),
    "volume_ratio": _out("SELECT ticker, date, volume, volume_sma, volume_ratio FROM ind", "volume_sma volume_ratio", BARS + "," + INDICATORS),
    "momentum_1_5_21": _out("SELECT ticker, date, price_change_1d, price_change_5d, price_change_1mo FROM ind", "price_change_1d price_change_5d price_change_1mo", BARS + "," + INDICATORS),
    "support_resistance": _out("SELECT ticker, date, resistance, support FROM ind", "resistance support", BARS + "," + INDICATORS),
    "technical_signals": _out("SELECT ticker, array_to_string(signals, '|') AS signals FROM tech", "", COMPANY_BARS + "," + INDICATORS),
    "technical_signals_6mo": _out("SELECT ticker, array_to_string(signals, '|') AS signals FROM tech", "", RECENT_BARS + "," + INDICATORS),
    "technical_record": _out(_RECORD, _RECORD_DOUBLES, COMPANY_BARS + "," + INDICATORS),
    "technical_record_6mo": _out(_RECORD, _RECORD_DOUBLES, RECENT_BARS + "," + INDICATORS),
    "daily_returns": _out("SELECT * FROM ret", "ret", BARS + "," + RETURNS),
    "aligned_returns": _out("SELECT * FROM al", "ret", BARS + "," + RETURNS),
    "mean_returns": _out("SELECT ticker, m AS mean_return FROM mu", "mean_return", ADJUSTED_BARS + "," + MOMENTS),
    "cov_matrix": _out("SELECT * FROM sg", "cov", ADJUSTED_BARS + "," + MOMENTS),
    "efficient_frontier": _out("SELECT * FROM m", _FACTS, YEAR_BARS + "," + CLOUD),
    "max_sharpe": _pick("bs"),
    "min_volatility": _pick("bv"),
    "diversification_ratio": _out("SELECT (SELECT sqrt(avg(cov)) FROM sg WHERE ticker_i = ticker_j) / v0 AS diversification_ratio FROM vo JOIN bs ON vo.pid = bs.portfolio_id", "diversification_ratio", ADJUSTED_BARS + "," + CLOUD),
    "stock_metrics": _out("SELECT mu.ticker, (SELECT w.w FROM w, bs WHERE w.pid = bs.portfolio_id AND w.ticker = mu.ticker) AS weight_max_sharpe, (SELECT w.w FROM w, bv WHERE w.pid = bv.portfolio_id AND w.ticker = mu.ticker) AS weight_min_vol, m * 252 AS annual_return, sqrt(cov * 252) AS annual_volatility, (m * 252 - 0.04) / sqrt(cov * 252) AS sharpe_ratio FROM mu JOIN sg ON sg.ticker_i = mu.ticker AND sg.ticker_j = mu.ticker", "weight_max_sharpe weight_min_vol annual_return annual_volatility sharpe_ratio", ADJUSTED_BARS + "," + CLOUD),
    "equal_weight_portfolio": _out("SELECT * FROM m", _FACTS, ADJUSTED_BARS + "," + MOMENTS + "," + _measure("w AS (SELECT CAST(0 AS BIGINT) AS pid, ticker, 1.0 / (SELECT count(*) FROM mu) AS w FROM mu)")),
    "custom_weight_portfolio": _out("SELECT * FROM m", _FACTS, ADJUSTED_BARS + "," + MOMENTS + "," + _measure(f"w AS (SELECT CAST(0 AS BIGINT) AS pid, v.ticker, CAST(v.w AS DOUBLE) AS w FROM (VALUES {_GIVEN}) v(ticker, w))")),
    "portfolio_by_join": _out("SELECT * FROM m", _FACTS, YEAR_BARS + "," + CLOUD),
    "position_limits": _out("SELECT pid AS portfolio_id, ticker, w, limited_w FROM lw", "w limited_w", YEAR_BARS + "," + MOMENTS + "," + LIMITED),
    "limited_frontier": _out("SELECT * FROM m", _FACTS, YEAR_BARS + "," + MOMENTS + "," + _measure(LIMITED.replace(" w AS (", " w9 AS (").replace("FROM w ", "FROM w9 ") + ", w AS (SELECT pid, ticker, limited_w AS w FROM lw)")),
    "portfolio_metrics_many": _out(METRICS_MANY, "total_return annual_return annual_volatility sharpe_ratio sortino_ratio calmar_ratio max_drawdown win_rate avg_win avg_loss profit_factor", YEAR_BARS + "," + CLOUD),
    "portfolio_text": _out("""SELECT 'Expected Return: ' || printf('%.1f%%', expected_return * 100) || chr(10) || 'Volatility: ' || printf('%.1f%%', volatility * 100) || chr(10) || 'Sharpe Ratio: ' || printf('%.2f', sharpe_ratio) || chr(10) ||
        (SELECT string_agg('    ' || w.ticker || ': ' || printf('%.1f%%', w.w * 100), chr(10) ORDER BY w.ticker) FROM w, bs WHERE w.pid = bs.portfolio_id) AS value FROM m JOIN bs USING (portfolio_id)""", "", YEAR_BARS + "," + CLOUD),
    "portfolio_result": _out(f"""SELECT 'portfolio_20020101_000000.json' AS file, '["T0","T1","T2","T3","T4"]' AS tickers, {_facts("current", "eq")}, {_facts("best", "m JOIN bs USING (portfolio_id)")}, {_facts("calm", "m JOIN bv USING (portfolio_id)")},
        (SELECT (SELECT sqrt(avg(cov)) FROM sg WHERE ticker_i = ticker_j) / v0 FROM vo JOIN bs ON vo.pid = bs.portfolio_id) AS diversification_ratio, (SELECT w.w FROM w, bs WHERE w.pid = bs.portfolio_id AND w.ticker = 'T1') AS best_w1,
        (SELECT sqrt(cov * 252) FROM sg WHERE ticker_i = 'T3' AND ticker_j = 'T3') AS t3_volatility, CAST((SELECT count(*) FROM m) AS INTEGER) AS n_points, (SELECT max(expected_return) FROM m) AS highest_return, (SELECT min(volatility) FROM m) AS lowest_volatility, (SELECT max(sharpe_ratio) FROM m) AS highest_sharpe""",
        "current_expected_return current_volatility current_sharpe_ratio best_expected_return best_volatility best_sharpe_ratio calm_expected_return calm_volatility calm_sharpe_ratio diversification_ratio best_w1 t3_volatility highest_return lowest_volatility highest_sharpe",
        YEAR_BARS + "," + CLOUD + """,
        e0 AS (SELECT (SELECT avg(m) FROM mu) * 252 AS expected_return, (SELECT sqrt(sum(cov) / 25 * 252) FROM sg) AS volatility),
        eq AS (SELECT *, (expected_return - 0.04) / volatility AS sharpe_ratio FROM e0)"""),
    "portfolio_returns": _out("SELECT * FROM s", "ret", ADJUSTED_BARS + "," + SERIES),
    "drawdown_series": _out("SELECT date, ret, cumulative, peak, (cumulative - peak) / peak AS drawdown FROM dd", "ret cumulative peak drawdown", ADJUSTED_BARS + "," + SERIES),
    "portfolio_metrics": _out("""SELECT total_return, annual_return, annual_volatility, (annual_return - 0.04) / annual_volatility AS sharpe_ratio, (annual_return - 0.04) / downside AS sortino_ratio, annual_return / abs(max_drawdown) AS calmar_ratio, max_drawdown, win_rate, avg_win, avg_loss, profit_factor
        FROM (SELECT *, total_return * 252 / n AS annual_return FROM (SELECT count(*) AS n, product(1 + ret) - 1 AS total_return, stddev_samp(ret) * sqrt(252) AS annual_volatility, min((cumulative - peak) / peak) AS max_drawdown, sqrt(avg(ret * ret) FILTER (ret < 0)) * sqrt(252) AS downside,
        (count(*) FILTER (ret > 0)) / count(*) AS win_rate, avg(ret) FILTER (ret > 0) AS avg_win, avg(ret) FILTER (ret < 0) AS avg_loss, abs((sum(ret) FILTER (ret > 0)) / (sum(ret) FILTER (ret < 0))) AS profit_factor FROM dd))""", "total_return annual_return annual_volatility sharpe_ratio sortino_ratio calmar_ratio max_drawdown win_rate avg_win avg_loss profit_factor", ADJUSTED_BARS + "," + SERIES),
    "latest_statement_items": _out("SELECT ticker, statement, item, DATE '2001-12-31' AS fiscal_date, value FROM it", "value", COMPANIES + "," + ITEMS),
    "fundamentals": _out("SELECT * FROM f", "total_assets current_assets current_liabilities total_liabilities total_equity revenue net_income operating_income interest_expense operating_cash_flow capex", RATIOS),
    "ratios": _out(f"SELECT ticker, {', '.join(RATIO_NAMES.split())} FROM ra", RATIO_NAMES, RATIOS),
    "ratios_unpivot": _out("SELECT ticker, ratio_name, v AS value FROM un", "value", RATIOS + "," + _score(False)),
    "health_score": _out("SELECT ticker, health_score, health_status FROM hs", "health_score", RATIOS + "," + _score(False)),
    "health_score_with_roe": _out("SELECT ticker, health_score, health_status FROM hs", "health_score", RATIOS + "," + _score(True)),
    "health_risks": _out("SELECT ticker, array_to_string(risks, '|') AS risks FROM he", "", HEALTH),
    "health_recommendations": _out("SELECT ticker, CASE WHEN len(advice) > 0 THEN array_to_string(advice, '|') ELSE 'Financially healthy company' END AS recommendations FROM he", "", HEALTH),
    "health_record": _out("SELECT ticker, coalesce(long_name, ticker) AS company_name, '2002-01-01' AS analysis_date, health_score, health_status, free_cash_flow, revenue, net_income, total_equity, total_assets FROM he", "health_score free_cash_flow revenue net_income total_equity total_assets", HEALTH),
    "dcf_valuation": _out("SELECT * FROM dcf", "current_price fair_value upside fcf growth_rate discount_rate", VALUES),
    "dcf_projection": _out("SELECT ticker, year, fcf, fcf / pow(1.08, year) AS present_value FROM yr", "fcf present_value", VALUES),
    "comparable_analysis": _out("SELECT * FROM cp", "current_price implied_price implied_pe_price implied_pb_price implied_ps_price avg_pe avg_pb avg_ps upside", SECTOR),
    "comparable_analysis_fixed_peers": _out("SELECT * FROM cp", "current_price implied_price implied_pe_price implied_pb_price implied_ps_price avg_pe avg_pb avg_ps upside", VALUES + ", px AS (SELECT count(*) AS peer_count, avg(nullif(pe, 0)) AS avg_pe, avg(nullif(pb, 0)) AS avg_pb, avg(nullif(ps, 0)) AS avg_ps FROM inf WHERE ticker IN ('S1', 'S2', 'S3', 'S4', 'S5') AND pe IS NOT NULL AND pb IS NOT NULL AND ev IS NOT NULL HAVING count(*) > 0)," + _comps("px", "true")),
    "graham_formula": _out("SELECT *, intrinsic_value * 0.75 AS margin_of_safety_price, current_price < graham_number AS is_undervalued_graham, current_price < intrinsic_value * 0.75 AS is_undervalued_intrinsic FROM gr", "current_price graham_number growth_assumption eps book_value intrinsic_value margin_of_safety_price", VALUES),
    "valuation_summary": _out("SELECT * FROM sm", "current_price average_fair_value average_upside range_min range_max", SUMMARY),
    "individual_valuations": _out("SELECT ticker, method, value, upside FROM iv", "value upside", SUMMARY),
    "recommendation": _out("SELECT ticker, score, recommendation, confidence FROM re", "score", REPORT),
    "rationale": _out(f"SELECT ticker, {_WHY} AS rationale FROM re", "", REPORT),
    "risk_assessment": _out("SELECT ticker, array_to_string(hi, '|') AS high_risks, array_to_string(me, '|') AS medium_risks, array_to_string(lo, '|') AS low_risks, CAST(total AS INTEGER) AS total_risks, overall_risk FROM re", "", REPORT),
    "stock_report": _out("SELECT ticker, average_fair_value, health_status, rsi, recommendation, score, overall_risk FROM re", "average_fair_value rsi score", REPORT),
    "compare_ranked": _out("SELECT ticker, coalesce(current_price, 0.0) AS current_price, coalesce(average_fair_value, 0.0) AS fair_value, coalesce(average_upside, 0.0) AS upside_pct, coalesce(health_score, 0.0) AS health_score, recommendation, score AS overall_score FROM re", "current_price fair_value upside_pct health_score overall_score", REPORT),
    "report_json": _out(f"""SELECT ticker || '_analysis_20020101_000000.json' AS file, ticker, '2002-01-01 00:00:00' AS generated_date, dcf_value, implied_price, intrinsic_value, average_fair_value AS fair_value, health_score, current_ratio, company_name, macd, price, recommendation, score, CAST(len(hi) AS INTEGER) AS high, overall_risk FROM ({_FULL})""",
        "dcf_value implied_price intrinsic_value fair_value health_score current_ratio macd price score", REPORT),
    "report_text": _out(f"""SELECT ticker, 'STOCK ANALYSIS REPORT' || chr(10) || repeat('=', 21) || chr(10) || chr(10) || 'Ticker: ' || ticker || chr(10) || 'Generated: 2002-01-01 00:00:00' || chr(10) || chr(10) ||
        'RECOMMENDATION: ' || recommendation || chr(10) || 'Confidence: ' || confidence || chr(10) || 'Score: ' || printf('%.1f', score::DOUBLE) || '/100' || chr(10) || chr(10) || 'Rationale: ' || {_WHY} || chr(10) || chr(10) ||
        'VALUATION SUMMARY' || chr(10) || repeat('-', 17) || chr(10) || 'Current Price: $' || printf('%.2f', coalesce(current_price, 0)::DOUBLE) || chr(10) || 'Fair Value: $' || printf('%.2f', coalesce(average_fair_value, 0)::DOUBLE) || chr(10) ||
        'Upside: ' || printf('%.1f', coalesce(average_upside, 0)::DOUBLE) || '%' || chr(10) || 'Undervalued: ' || CASE WHEN uv THEN 'Yes' ELSE 'No' END || chr(10) || chr(10) ||
        'FINANCIAL HEALTH' || chr(10) || repeat('-', 16) || chr(10) || 'Score: ' || printf('%.2f', coalesce(health_score, 0)::DOUBLE) || '/1.0' || chr(10) || 'Status: ' || coalesce(health_status, 'N/A') || chr(10) || chr(10) ||
        'RISK ASSESSMENT' || chr(10) || repeat('-', 15) || chr(10) || 'Overall Risk: ' || overall_risk || chr(10) || 'High Risks: ' || len(hi) || chr(10) || 'Medium Risks: ' || len(me) || chr(10) || 'Low Risks: ' || len(lo) || chr(10) AS value FROM re""", "", REPORT),
    "analysis_results": _out("""SELECT ticker, DATE '2002-01-01' AS analysis_date, 'valuation' AS analysis_type, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS recommendation, average_fair_value AS fair_value, CAST(NULL AS VARCHAR) AS health_status, CAST(NULL AS DOUBLE) AS rsi, CAST(NULL AS VARCHAR) AS confidence FROM re
        UNION ALL SELECT ticker, DATE '2002-01-01', 'health', health_score, NULL, NULL, health_status, NULL, NULL FROM re
        UNION ALL SELECT re.ticker, DATE '2002-01-01', 'technical', NULL, NULL, NULL, NULL, re.rsi, NULL FROM re JOIN tech ON tech.ticker = re.ticker
        UNION ALL SELECT ticker, DATE '2002-01-01', 'recommendation', score, recommendation, NULL, NULL, NULL, confidence FROM re""", "score fair_value rsi", REPORT),
    "refresh_tickers": _out("""SELECT 'S' || k AS ticker, coalesce(long_name, i.ticker) AS name, coalesce(sector, 'Unknown') AS sector, coalesce(industry, 'Unknown') AS industry, country, cap AS market_cap, '2001-01-01' AS last_updated, 2 * n AS n_rows, n AS n_days
        FROM inf i JOIN (SELECT ticker AS t, count(*) AS n FROM bars WHERE date >= (SELECT max(date) FROM bars) - INTERVAL 1 YEAR GROUP BY 1) ON t = i.ticker WHERE k % 2 = 0""", "market_cap", COMPANY_BARS + "," + COMPANIES + "," + INFO),
    "company_lookup": _out("SELECT ticker, s_name AS name, r_name AS sector, n_name AS industry, n_name AS country, price * shares AS market_cap FROM co WHERE k = 3", "market_cap", COMPANIES),
    "ticker_checks": f"SELECT * FROM (VALUES ('{WANTED}', true, true), ('aapl', false, true), (' , ,', false, false), ('A,b', true, true)) v(tickers, portfolio, comparison)",
    "filing_requests": """SELECT ticker, lpad(n, 10, '0') AS cik, '10-Q' AS filing_type, 'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=' || lpad(n, 10, '0') || '&type=10-Q&count=3' AS url, 'https://www.sec.gov/Archives/edgar/data/' || lpad(n, 10, '0') || '/20010203/' AS text_url
        FROM (VALUES ('AAPL', '320193'), ('MSFT', '789019'), ('AMZN', '1018724')) v(ticker, n)""",
    "price_append_dedup": _out("SELECT * FROM bars", _PRICES, BARS),
    "company_upsert": _out("SELECT ticker, s_name AS name, r_name AS sector, n_name AS industry, n_name AS country, price * shares * CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS market_cap, CASE WHEN k % 3 <> 0 THEN '2001-01-01' ELSE '2002-01-01' END AS last_updated FROM co WHERE k % 3 <> 0 OR k % 2 = 0", "market_cap", COMPANIES),
    "filing_dates": """SELECT page_id, found, CAST(sequence AS INTEGER) AS sequence FROM (SELECT page_id, unnest(m) AS found, generate_subscripts(m, 1) AS sequence FROM (SELECT page_id, list_slice(regexp_extract_all(html, 'href="([^"]*)"', 1), 1, 5) AS m FROM pages))""",
    "filing_list_by_type": f"""SELECT page_id, url, CAST(200 AS INTEGER) AS status, 'es' AS filing_type, found, CAST(sequence AS INTEGER) AS sequence FROM (SELECT page_id, url, unnest(m) AS found, generate_subscripts(m, 1) AS sequence FROM
        (SELECT page_id, url, list_slice(regexp_extract_all(html, 'href="([^"]*)"', 1), 1, 3) AS m FROM pages WHERE regexp_extract(url, '{PAGE_TYPE}', 1) = 'es'))""",
    "filing_text": "SELECT page_id, coalesce(substr(html, 1, 5000), '') AS text FROM pages",
    "cik_lookup": f"""SELECT * FROM (SELECT json_extract_string(v, '$.ticker') AS ticker, lpad(coalesce(json_extract_string(v, '$.cik_str'), k), 10, '0') AS cik FROM (SELECT unnest(json_keys(j)) AS k, j, json_extract(j, '$."' || unnest(json_keys(j)) || '"') AS v FROM (SELECT '{CIK_JSON}'::JSON AS j))) WHERE ticker IN ('AAPL', 'MSFT', 'AMZN', 'NONE')""",
    "hourly_bars": _out("SELECT event_type AS ticker, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2", "open high low close"),
}
ORACLES = {name: sql.replace("/*digits*/", str(DIGITS[name])) for name, sql in ORACLES.items()}
