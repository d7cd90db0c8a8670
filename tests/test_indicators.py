"""Indicators and returns against pandas on random walks, with gaps and short histories."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tickerloom.operators import indicators as I
from tickerloom.operators import returns as R


def walk(seed, n, ticker):
    r = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(r.normal(0, 0.02, n)))
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    return pd.DataFrame({"ticker": ticker, "date": days, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": r.integers(1, 1000, n), "adjusted_close": close})


@pytest.fixture(scope="module")
def bars(spark):
    pdf = pd.concat([walk(1, 150, "A"), walk(2, 700, "B"), walk(3, 19, "C")])
    return pdf, spark.createDataFrame(pdf)


def by_ticker(df):
    out = df.toPandas().sort_values(["ticker", "date"])
    return {t: g.reset_index(drop=True) for t, g in out.groupby("ticker")}


def twin(pdf, f):
    return {t: f(g.sort_values("date").reset_index(drop=True)) for t, g in pdf.groupby("ticker")}


def same(got, want, tol=1e-9):
    np.testing.assert_allclose(np.asarray(got, float), np.asarray(want, float), rtol=tol, atol=1e-9)


def test_rolling(bars):
    pdf, df = bars
    got = by_ticker(I.with_volume(I.with_levels(I.with_bollinger(I.with_averages(df)))))
    for t, g in twin(pdf, lambda g: g).items():
        same(got[t].sma_50, g.close.rolling(50).mean())
        middle, spread = g.close.rolling(20).mean(), g.close.rolling(20).std()
        same(got[t].bb_upper, middle + 2 * spread, 1e-7)
        same(got[t].resistance, g.high.rolling(20).max())
        same(got[t].support, g.low.rolling(20).min())
        same(got[t].volume_ratio, (g.volume / g.volume.rolling(20).mean()).fillna(1.0))


def test_rsi(bars):
    pdf, df = bars

    def rsi(g):
        d = g.close.diff()
        up, down = d.where(d > 0, 0.0).rolling(14).mean(), (-d).where(d < 0, 0.0).rolling(14).mean()
        return 100 - 100 / (1 + up / down)

    got = by_ticker(I.with_rsi(df))
    for t, want in twin(pdf, rsi).items():
        same(got[t].rsi, want)
        assert got[t].rsi.dropna().between(0, 100).all()


@pytest.mark.parametrize("spread", [230.0, 10.0])
def test_ema_and_macd_over_blocks(bars, monkeypatch, spread):
    monkeypatch.setattr(I, "SPREAD", spread)
    pdf, df = bars
    got = by_ticker(I.with_macd(I.with_ema(df, "close", {"e1": 1, "e60": 60})))

    def line(g):
        m = g.close.ewm(span=12, adjust=False).mean() - g.close.ewm(span=26, adjust=False).mean()
        return g.close, g.close.ewm(span=60, adjust=False).mean(), m, m.ewm(span=9, adjust=False).mean()

    for t, want in twin(pdf, line).items():
        for name, w in zip(("e1", "e60", "macd", "macd_signal"), want, strict=True):
            same(got[t][name], w, 1e-8)


def test_flat_and_rising(spark):
    rows = [("F", dt.date(2020, 1, d), 5.0, 5.0, 5.0, 5.0, 10, 5.0) for d in range(1, 25)] + [("U", dt.date(2020, 1, d), 5.0 + d, 5.0 + d, 5.0 + d, 5.0 + d, 10, 5.0) for d in range(1, 25)]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume long, adjusted_close double")
    last = {r.ticker: r for r in I.latest(I.with_rsi(df)).collect()}
    assert last["F"].rsi is None and last["U"].rsi == 100
    signals = {r.ticker: r.signals for r in I.technical(df).collect()}
    assert signals["F"][0].endswith("(bearish)") and "Near resistance level" in signals["F"] and signals["F"][-1] == "Overall bias: Bearish"
    assert signals["U"][0].endswith("(bullish)") and "RSI > 70 (overbought)" in signals["U"]


@pytest.mark.parametrize(("n", "there"), [(21, 0), (22, 1)])
def test_minimum_history(spark, n, there):
    assert I.technical(spark.createDataFrame(walk(5, n, "A"))).count() == there


def test_returns_fill_gaps_and_align(spark):
    pdf = pd.concat([walk(1, 40, "A"), walk(2, 40, "B").drop(index=[5, 6, 20]), walk(3, 40, "C").iloc[3:]])
    wide = pdf.pivot(index="date", columns="ticker", values="close").sort_index()
    want = wide.ffill().pct_change(fill_method=None).dropna()
    got = R.aligned_returns(spark.createDataFrame(pdf)).toPandas().pivot(index="date", columns="ticker", values="ret").sort_index()
    same(got, want)
    cov = R.covariance(R.aligned_returns(spark.createDataFrame(pdf))).toPandas().pivot(index="ticker_i", columns="ticker_j", values="cov")
    same(cov, want.cov())


def test_empty_bars(spark):
    empty = spark.createDataFrame(walk(1, 3, "A")).limit(0)
    assert I.technical_record(empty).count() == 0 and R.aligned_returns(empty).count() == 0
