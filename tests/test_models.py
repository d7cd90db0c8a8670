"""Branch tables: every arm of scores, risks, advice, recommendation and risk level, with missing sections."""

import datetime as dt
import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import health as H
from tickerloom.operators import portfolio as P
from tickerloom.operators import report as R
from tickerloom.operators import returns as T
from tickerloom.operators import valuation as V
from tickerloom.functions.expr import fixed, percent
from tickerloom.sources import filings, market, sinks, tables

RATIOS = "ticker string, " + ", ".join(f"{r} double" for r in H.RATIOS) + ", revenueGrowth double"


def ratio_row(spark, **values):
    return spark.createDataFrame([tuple(["X", *[values.get(r) for r in H.RATIOS], values.get("revenueGrowth")])], RATIOS)


@pytest.mark.parametrize(
    ("values", "score", "status"),
    [
        ({}, 0.0, "Poor"),
        ({"current_ratio": 2.0}, 1.0, "Excellent"),
        ({"current_ratio": 1.5}, 0.5, "Fair"),
        ({"current_ratio": 1.4999}, 0.0, "Poor"),
        ({"debt_to_equity": 0.3, "current_ratio": 1.5}, 0.75, "Good"),
        ({"debt_to_equity": 0.5}, 0.5, "Fair"),
        ({"debt_to_equity": 0.51, "net_margin": 0.15, "interest_coverage": 5.0, "current_ratio": 2.0}, 0.75, "Good"),
        ({"return_on_equity": 0.5}, 0.0, "Poor"),
    ],
)
def test_health_score(spark, values, score, status):
    row = H.with_score(ratio_row(spark, **values)).first()
    assert (row.health_score, row.health_status) == (score, status)


def test_roe_alias(spark):
    assert H.with_score(ratio_row(spark, return_on_equity=0.5), {"roe": "return_on_equity"}).first().health_score == 1.0


@pytest.mark.parametrize(
    ("values", "risks"),
    [
        ({}, ["High liquidity risk (current ratio < 1.0)", "Low profitability (net margin < 5%)"]),
        ({"current_ratio": 1.0, "net_margin": 0.05}, ["Moderate liquidity risk (current ratio < 1.5)"]),
        ({"current_ratio": 1.5, "net_margin": 0.05, "debt_to_equity": 1.0}, ["Moderate leverage risk (debt/equity > 0.5)"]),
        ({"current_ratio": 1.5, "net_margin": 0.05, "debt_to_equity": 1.01, "free_cash_flow": -1.0, "revenueGrowth": -0.1}, ["High leverage risk (debt/equity > 1.0)", "Negative free cash flow", "Declining revenue"]),
    ],
)
def test_health_risks(spark, values, risks):
    assert ratio_row(spark, **values).select(H.risks().alias("r")).first().r == risks


def test_advice_default(spark):
    row = H.with_score(ratio_row(spark, current_ratio=2.0)).select(H.advice().alias("a")).first()
    assert row.a == ["Financially healthy company"]


SECTIONS = "ticker string, summary struct<is_undervalued:boolean,average_upside:double,current_price:double,average_fair_value:double>, health struct<health_score:double,health_status:string,risks:array<string>>, technical struct<signals:array<string>,indicators:struct<rsi:double>>, dcf struct<fcf:double,growth_rate:double>"


@pytest.mark.parametrize(
    ("undervalued", "gain", "health", "signals", "score", "word", "trust"),
    [
        (True, 5.0, 1.0, ["MACD bullish"], 100.0, "STRONG BUY", "High"),
        (False, 10.1, 0.5, ["MACD bullish"], 70.0, "BUY", "Medium"),
        (False, 10.0, 0.5, [], 52.0, "HOLD", "Low"),
        (False, 0.0, 0.5, ["MACD bearish"], 35.0, "SELL", "Medium"),
        (False, -1.0, 0.0, ["MACD bearish"], 15.0, "STRONG SELL", "High"),
    ],
)
def test_recommendation(spark, undervalued, gain, health, signals, score, word, trust):
    df = spark.createDataFrame([("X", (undervalued, gain, 1.0, 1.0), (health, "Good", []), (signals, (50.0,)), None)], SECTIONS)
    got = R.with_recommendation(df).first().recommendation
    assert (round(got.score, 9), got.recommendation, got.confidence) == (score, word, trust)


def test_missing_sections(spark):
    row = R.with_risks(R.with_recommendation(spark.createDataFrame([("X", None, None, None, None)], SECTIONS))).first()
    assert row.recommendation.score == 22.0
    assert row.recommendation.rationale == "Stock appears fairly valued or overvalued. Poor financial health, significant risks present."
    assert row.risk.risk_levels.high == ["Negative or zero free cash flow"] and row.risk.overall_risk == "Low"


@pytest.mark.parametrize(("rsi", "level"), [(81.0, "high"), (80.0, "medium"), (70.0, None), (None, None)])
def test_risk_levels(spark, rsi, level):
    health = (0.5, "Fair", ["High liquidity risk (current ratio < 1.0)", "Moderate leverage risk (debt/equity > 0.5)", "Low profitability (net margin < 5%)", "Negative free cash flow"])
    risk = R.with_risks(spark.createDataFrame([("X", None, health, ([], (rsi,)), (1.0, 0.05))], SECTIONS)).first().risk
    assert risk.risk_counts.high == 2 + (level == "high") and risk.risk_counts.medium == 1 + (level == "medium") and risk.risk_counts.low == 1
    assert risk.overall_risk == ("High" if level == "high" else "Medium")


def test_price_zero_counts_as_undervalued(spark):
    items = spark.createDataFrame([("X", "cashflow", i, dt.date(2020, 1, 1), 100.0) for i in ("Free Cash Flow", "Operating Cash Flow")], "ticker string, statement string, item string, fiscal_date date, value double")
    info = spark.createDataFrame([("X", 0.0, 10.0)], "ticker string, currentPrice double, sharesOutstanding double")
    row = V.dcf(items, info).first()
    assert row.upside == 0 and row.is_undervalued and row.fair_value > 0


def test_latest_year_and_label_fallback(spark):
    d0, d1 = dt.date(2019, 1, 1), dt.date(2020, 1, 1)
    rows = [("X", "balance", "Total Assets", d0, 1.0), ("X", "balance", "Total Assets", d1, 5.0), ("X", "balance", "Current Assets", d1, 0.0), ("X", "balance", "Total Current Assets", d1, 7.0), ("X", "income", "Revenue", d1, 3.0), ("Y", "balance", "Total Assets", d1, 5.0)]
    got = H.fundamentals(spark.createDataFrame(rows, "ticker string, statement string, item string, fiscal_date date, value double")).collect()
    assert len(got) == 1 and (got[0].total_assets, got[0].current_assets, got[0].revenue, got[0].capex) == (5.0, 7.0, 3.0, 0.0)


def test_frontier_properties(spark, sf_dir):
    from tickerloom.operators.returns import aligned_returns

    returns = aligned_returns(market.bars(spark, sf_dir)).cache()
    places, cloud = P.positions(returns), P.frontier(returns, 200).cache()
    rows = cloud.toPandas()
    best, calm = P.max_sharpe(cloud, places).first(), P.min_volatility(cloud, places).first()
    assert best.sharpe_ratio == rows.sharpe_ratio.max() and calm.volatility == rows.volatility.min() and len(rows) == 200
    assert abs(sum(best.w) - 1) < 1e-12 and best.tickers == sorted(best.tickers)


def test_performance_without_losses_or_rows(spark):
    series = spark.createDataFrame([(dt.date(2020, 1, d), 0.01 * d) for d in range(1, 4)], "date date, ret double")
    row = P.performance(series).first()
    assert row.max_drawdown == 0 and row.calmar_ratio == 0 and row.profit_factor == 0 and row.sortino_ratio == 0 and row.win_rate == 1
    assert P.performance(series.limit(0)).count() == 0


def test_filings(spark):
    html = "".join(f'<td nowrap="nowrap">2020-01-{d:02d}</td>' for d in range(1, 9))
    got = filings.filing_list(spark.createDataFrame([("A", html), ("B", "none"), ("C", None)], "ticker string, html string")).collect()
    assert [(r.ticker, r.filing_date, r.sequence) for r in got] == [("A", f"2020-01-{d:02d}", d) for d in range(1, 6)]
    long = spark.createDataFrame([("A", "x" * 6000), ("B", None)], "ticker string, html string")
    assert [len(r.text) for r in filings.filing_text(long).orderBy("ticker").collect()] == [5000, 0]


def test_sinks(spark, sf_dir, tmp_path):
    bars = market.bars(spark, sf_dir)
    for _ in range(2):
        sinks.append_prices(bars.drop("adjusted_close"), str(tmp_path / "prices"))
    stored = spark.read.parquet(str(tmp_path / "prices"))
    assert stored.count() == 2 * bars.count() and sinks.latest_prices(stored).count() == bars.count()
    assert stored.where("adjusted_close <> close").count() == 0
    sinks.write_lines(spark.range(2).select(F.col("id").cast("string").alias("value")), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 2


def test_periods(spark, sf_dir):
    bars = market.bars(spark, sf_dir)
    end = bars.agg(F.max("date")).first()[0]
    assert sorted(market.since(bars, "6mo").collect()) == sorted(market.since(bars, "6mo", end).collect())
    assert market.last_days(bars, 0).select("date").distinct().count() == 1


def test_store(spark, sf_dir, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):  # a second time changes nothing
        store.create("stored_test")
    assert all(store.read(name).count() == 0 for name in tables.SCHEMAS)
    assert all((tmp_path / "store" / name).is_dir() for name in ("reports", "logs", "data"))
    prices = market.company_bars(spark, sf_dir, "1y").where("ticker in ('S1', 'S2')")
    info = market.company_info(spark, sf_dir)
    store.refresh(prices, info, dt.datetime(2001, 1, 1))
    store.refresh(prices, info.withColumn("marketCap", F.lit(5.0)), dt.datetime(2002, 1, 1))
    rows = {r.ticker: r for r in store.read("companies").collect()}
    assert set(rows) == {"S1", "S2"} and all(r.market_cap == 5.0 and r.last_updated.year == 2001 for r in rows.values())
    assert store.read("price_data").count() == 2 * prices.count()
    assert store.company("S2").first().ticker == "S2" and store.company("S9").count() == 0
    assert spark.table("stored_test.companies").columns == store.read("companies").columns
    spark.sql("DROP DATABASE stored_test CASCADE")


def test_filing_requests(spark):
    directory = filings.cik_directory(spark.createDataFrame([('{"7": {"ticker": "A"}}',)], "json string"))
    asked = filings.filing_requests(spark.createDataFrame([("a",), ("none",)], "ticker string"), directory, "8-K", 2)
    assert [(r.ticker, r.url.split("?")[1]) for r in asked.collect()] == [("A", "action=getcompany&CIK=0000000007&type=8-K&count=2")]
    html = "".join(f'<td nowrap="nowrap">2020-01-{d:02d}</td>' for d in range(1, 9))
    answers = asked.select("url").crossJoin(spark.createDataFrame([(200, html), (500, html)], "status int, html string"))
    got = filings.fetched_filings(asked, answers, 2).collect()
    assert [(r.filing_date, r.filing_type, r.sequence, r.text_url.rsplit("/", 3)[1:]) for r in got] == [(f"2020-01-0{d}", "8-K", d, ["0000000007", f"2020010{d}", ""]) for d in (1, 2)]


def test_ticker_checks():
    assert market.parse_tickers(" aapl,, msft ", 2) == ["AAPL", "MSFT"]
    for text, least in (("aapl", 2), (" ,", 1), ("", 1)):
        with pytest.raises(ValueError, match="at least"):
            market.parse_tickers(text, least)


@pytest.mark.parametrize(("period", "end", "start"), [("6mo", dt.date(2001, 10, 29), dt.date(2001, 4, 29)), ("1mo", dt.date(2004, 3, 31), dt.date(2004, 2, 29)), ("2y", dt.date(2004, 2, 29), dt.date(2002, 2, 28)), ("5d", dt.date(2001, 1, 3), dt.date(2000, 12, 29))])
def test_period_start(period, end, start):
    assert market.period_start(end, period) == start


def test_numbers_as_text(spark):
    row = spark.createDataFrame([(0.125, 0.375, 0.1234, -0.05)], "a double, b double, c double, d double").select(fixed(F.col("a"), 2).alias("a"), fixed(F.col("b"), 2).alias("b"), percent(F.col("c")).alias("c"), percent(F.col("d"), 2).alias("d")).first()
    assert tuple(row) == ("0.12", "0.38", "12.3%", "-5.00%")


def test_numbers_as_text_are_exact(spark):
    """Random doubles of every size, all halves, and their neighbours, as Python writes them."""
    r = random.Random(5)
    values = [r.uniform(-1, 1) * 10 ** r.uniform(-6, 17) for _ in range(60_000)] + [struct.unpack("<d", r.randbytes(8))[0] for _ in range(20_000)]
    halves = [k / 8 for k in range(-2000, 2000)] + [k / 200 for k in range(-3000, 3000)] + [2.0**k for k in range(-80, 1024)] + [-0.0, 0.0, float("inf"), -float("inf"), float("nan"), 2.675, 8.345, 1e23, -0.001]
    values += halves + [math.nextafter(x, x + s) for x in halves for s in (-1, 1) if math.isfinite(x)]
    data = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").repartition(8)
    rows = data.select("i", fixed(F.col("x"), 0).alias("a"), fixed(F.col("x"), 1).alias("b"), fixed(F.col("x"), 2).alias("c"), percent(F.col("x")).alias("d")).collect()
    for row in rows:
        x = values[row.i]
        assert (row.b, row.c, row.d) == (f"{x:.1f}", f"{x:.2f}", f"{x:.1%}") and row.a == f"{x:.0f}", (x, row)
    assert spark.range(1).select(fixed(F.lit(None).cast("double"), 2).alias("a")).first().a is None


def test_scans_prune(spark, sf_dir):
    plan = market.bars(spark, sf_dir, "6mo")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "Join" not in plan


def _prices(tickers, days, gaps=0):
    r = np.random.default_rng(4)
    start = dt.date(2020, 1, 1)
    prices = 100 * np.cumprod(1 + 0.02 * r.standard_normal((days, tickers)), axis=0)
    return [(f"N{i:04d}", start + dt.timedelta(d), float(prices[d, i])) for i in range(tickers) for d in range(days) if d == 0 or not gaps or (i * 31 + d * 17) % gaps]


def test_blocks_of_many_tickers(spark, monkeypatch):
    """Covariances and the frontier over several blocks of tickers, chunks of days and blocks of portfolios, against numpy."""
    monkeypatch.setattr(T, "BLOCK_TICKERS", 16)
    monkeypatch.setattr(T, "CHUNK_DAYS", 40)
    monkeypatch.setattr(P, "BLOCK_PORTFOLIOS", 24)
    data = _prices(90, 130, gaps=7)
    prices = spark.createDataFrame(data, "ticker string, date date, close double")
    wide = pd.DataFrame(data, columns=["ticker", "date", "close"]).pivot(index="date", columns="ticker", values="close").ffill().pct_change().dropna()
    returns = T.aligned_returns(prices).cache()
    got = returns.toPandas().pivot(index="date", columns="ticker", values="ret")
    assert got.shape == wide.shape and np.allclose(got, wide, atol=1e-12)
    cov = T.covariance(returns).toPandas().pivot(index="ticker_i", columns="ticker_j", values="cov")
    assert np.allclose(cov, wide.cov(), rtol=1e-9, atol=1e-12)
    cloud = P.frontier(returns, 60).toPandas().set_index("portfolio_id").sort_index()
    raw = np.array([P._raw(p, range(90)) for p in range(60)], float)
    w = raw / raw.sum(axis=1, keepdims=True)
    assert np.allclose(cloud.expected_return, w @ wide.mean().to_numpy() * 252) and np.allclose(cloud.volatility, np.sqrt(np.einsum("pi,ij,pj->p", w, wide.cov().to_numpy() * 252, w)))
    some = P.random_weights(spark.range(60).withColumnRenamed("id", "portfolio_id"), P.positions(returns))
    assert np.allclose(P.measured(some, returns).toPandas().set_index("portfolio_id").sort_index().volatility, cloud.volatility)


def test_limits(spark):
    """Against a search for the shift; limits that leave no room give no weights."""
    r = random.Random(2)
    rows = [(p, f"t{i}", x) for p in range(80) for xs in [[r.random() ** 3 for _ in range(r.randint(2, 9))]] for i, x in enumerate(v / sum(xs) for v in xs)]
    for least, most in ((0.05, 0.3), (0.0, 1.0), (0.2, 0.2), (0.1, 0.5)):
        got = P.limited(spark.createDataFrame(rows, "portfolio_id long, ticker string, w double"), least, most).toPandas()
        for _, one in got.groupby("portfolio_id"):
            n, w = len(one), one.w.to_numpy()
            if n * least > 1 + 1e-9 or n * most < 1 - 1e-9:
                assert one.limited_w.isna().all()
                continue
            low, high = -2.0, 2.0
            for _ in range(80):
                middle = (low + high) / 2
                low, high = (middle, high) if np.clip(w - middle, least, most).sum() > 1 else (low, middle)
            assert np.allclose(one.limited_w, np.clip(w - low, least, most), atol=1e-9) and abs(one.limited_w.sum() - 1) < 1e-9


def test_drawdowns_of_many_portfolios(spark, monkeypatch):
    monkeypatch.setattr(P, "SCAN_DAYS", 9)
    r = np.random.default_rng(1)
    rets = r.standard_normal((6, 200)) * 0.05
    rets[3, 20], rets[4, 50], rets[5] = -1.0, -1.7, abs(rets[5])
    rows = [(p, dt.date(2020, 1, 1) + dt.timedelta(int(3 * d)), float(rets[p, d])) for p in range(6) for d in range(200)]
    series = spark.createDataFrame(rows, "portfolio_id long, date date, ret double")
    got = P.drawdowns(series).orderBy("portfolio_id", "date").toPandas()
    grown = np.cumprod(1 + rets, axis=1)
    peak = np.maximum.accumulate(grown, axis=1)
    assert np.allclose(got.cumulative, grown.ravel()) and np.allclose(got.peak, peak.ravel()) and np.allclose(got.drawdown, ((grown - peak) / peak).ravel())
    facts = P.performance(series).orderBy("portfolio_id").toPandas()
    assert np.allclose(facts.max_drawdown, ((grown - peak) / peak).min(axis=1)) and len(facts) == 6
    plan = P.drawdowns(series)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_returns_of_gaps_and_late_tickers(spark):
    """Against a grid: gaps return 0, a late ticker's first days are missing, one without prices leaves no common day."""
    d = lambda k: dt.date(2021, 3, k)
    rows = [("A", d(1), 10.0), ("A", d(2), 11.0), ("A", d(5), 12.0), ("B", d(3), 5.0), ("B", d(4), None), ("B", d(6), 6.0), ("C", d(1), 1.0)]
    schema = "ticker string, date date, close double"
    got = {(r.ticker, r.date.day): r.ret for r in T.daily_returns(spark.createDataFrame(rows, schema)).collect()}
    want = {("A", 1): None, ("A", 2): 0.1, ("A", 3): 0.0, ("A", 4): 0.0, ("A", 5): 12 / 11 - 1, ("A", 6): 0.0, ("B", 6): 0.2} | {("B", k): None for k in (1, 2, 3)} | {("B", k): 0.0 for k in (4, 5)} | {("C", 1): None} | {("C", k): 0.0 for k in range(2, 7)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) if want[k] is not None else got[k] is None for k in want)
    assert sorted({r.date.day for r in T.aligned_returns(spark.createDataFrame(rows, schema)).collect()}) == [4, 5, 6]
    silent = spark.createDataFrame([*rows, ("D", d(2), None)], schema)
    assert T.aligned_returns(silent).count() == 0 and T.daily_returns(silent).where("ticker = 'D' and ret is null").count() == 6


def test_upserts_by_parts(spark, sf_dir, tmp_path, monkeypatch):
    """Buckets that are not touched keep their files; an upsert that dies leaves the table as it was; old folders go."""
    store = tables.Store(spark, f"file://{tmp_path}/store")
    store.create("parts_test")
    rows = market.companies(spark, sf_dir)
    many = rows.unionByName(spark.range(60).select(F.concat(F.lit("X"), "id").alias("ticker"), *[F.lit(c).alias(c) for c in ("name", "sector", "industry", "country")], F.lit(1.0).alias("market_cap")))
    store.upsert(many, dt.datetime(2001, 1, 1))
    files = lambda: {str(p) for p in (tmp_path / "store" / "companies").rglob("part-*")}
    first, before = store._newest(), files()
    one = rows.where("ticker = 'S3'").withColumn("market_cap", F.lit(7.0))
    with monkeypatch.context() as m:
        m.setattr(tables.Store, "_switch", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.upsert(one, dt.datetime(2002, 1, 1))
    assert store._newest() == first and store.company("S3").first().market_cap != 7.0 and store.read("companies").count() == many.count()
    reader = store.read("companies").where("ticker = 'S3'")
    store.upsert(one, dt.datetime(2002, 1, 1))
    second = store._newest()
    assert sum(first[k] != second[k] for k in first) == 1 and before <= files()
    assert store.company("S3").first().market_cap == 7.0 and store.company("S3").first().last_updated.year == 2001
    assert reader.first().market_cap != 7.0  # planned before the switch, still readable
    assert spark.table("parts_test.companies").count() == many.count() and spark.table("parts_test.companies").where("market_cap = 7").count() == 1
    store.upsert(one, dt.datetime(2003, 1, 1))
    assert not before <= files() and store.read("companies").count() == many.count()
    store.upsert(one.limit(0), dt.datetime(2003, 1, 1))
    spark.sql("DROP DATABASE parts_test CASCADE")


def test_named_documents(spark, tmp_path):
    rows = [("A_analysis_20020101_000000.json", '{"a": 1}'), ("b c d%.json", "x"), (None, "y")]
    folder = f"file://{tmp_path}/reports"
    documents = spark.createDataFrame(rows, "file string, value string")
    (tmp_path / "reports" / "_staging-left").mkdir(parents=True)  # of a run that ended early
    for _ in range(2):
        sinks.write_documents(documents, folder)
    assert (tmp_path / "reports" / rows[0][0]).read_text() == rows[0][1] + "\n" and (tmp_path / "reports" / "b c d%.json").is_file()
    assert sorted(p.name for p in (tmp_path / "reports").iterdir() if p.name[0] not in "._") == sorted(r[0] for r in rows[:2])
    assert sorted(tuple(r) for r in sinks.read_documents(spark, folder).collect()) == sorted(rows[:2])


def test_bucketed_prices(spark, sf_dir, capsys):
    from tickerloom.operators.indicators import with_averages

    bars = market.company_bars(spark, sf_dir)
    stored = tables.bucketed_prices(bars, "bucketed_test", 4)
    plan = with_averages(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan
    with_averages(stored.where("ticker = 'S3'")).explain("formatted")
    assert "SelectedBucketsCount: 1 out of 4" in capsys.readouterr().out
    assert tables.bucketed_prices(bars, "bucketed_test", 4).count() == 2 * bars.count()
    assert "Exchange" not in with_averages(spark.table("bucketed_test"))._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE bucketed_test")


def test_indicator_state_through_refreshes(spark):
    """After each of ten refreshes, some late, repeated or of new tickers, the state gives what all bars give."""
    from tickerloom.operators import indicators as I
    from tickerloom.operators import state as S

    r, start = random.Random(6), dt.date(2020, 1, 1)
    rows, price = [], {}
    for k in range(260):
        for t in ("A", "B", "C"):
            if (t == "C" and k < 130) or (t == "B" and k % 5 == 0):
                continue
            price[t] = price.get(t, 50.0) * (1 + (r.random() - 0.5) / 10 if t != "C" else 1.01)
            p = price[t]
            rows.append((t, start + dt.timedelta(k), p, p + r.random(), p - r.random(), p, r.randrange(1000)))
    schema = "ticker string, date date, open double, high double, low double, close double, volume bigint"
    bars, held = spark.createDataFrame(rows, schema).cache(), spark.createDataFrame([], S.STATE)
    for k in range(10):
        until, since = start + dt.timedelta(26 * (k + 1)), start + dt.timedelta(26 * k - (3 if k % 2 else 0))
        held = S.advanced(held, bars.where((F.col("date") < until) & (F.col("date") >= since)))
        held = spark.createDataFrame(held.collect(), S.STATE)
        want = {x.ticker: x for x in I.latest(I.with_all(bars.where(F.col("date") < until))).collect()}
        got = S.indicators(held).collect()
        assert {x.ticker for x in got} == set(want) and all(len(x.bars) <= S.KEPT for x in held.collect())
        for x in got:
            assert x.date == want[x.ticker].date and x.n_bars == want[x.ticker].n_bars
            assert all(getattr(x, c) == (None if (w := getattr(want[x.ticker], c)) is None else pytest.approx(w, rel=1e-9, abs=1e-9)) for c in S.INDICATORS), (k, x, want[x.ticker])
