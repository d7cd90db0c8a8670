"""Registered queries of the market engine, each over whole tables, rounded for comparison."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions.expr import fixed, percent, rounded
from ..operators import health as H
from ..operators import indicators as I
from ..operators import portfolio as P
from ..operators import report as R
from ..operators import returns as T
from ..operators import valuation as V
from ..operators.state import indicators
from ..sources import filing_source, filings, market, sinks, tables
from ..streaming.bars import window_bars

AS_OF = date(2002, 1, 1)
GENERATED = datetime(2002, 1, 1)
#: Weights of the given portfolio.
WEIGHTS = {"T0": 0.4, "T1": 0.3, "T2": 0.15, "T3": 0.1, "T4": 0.05}
#: Least and greatest weight of a ticker in a limited portfolio.
LIMITS = (0.1, 0.3)
CIK_JSON = '{"0": {"cik_str": "320193", "ticker": "AAPL", "title": "A"}, "1": {"cik_str": "789019", "ticker": "MSFT", "title": "M"}, "1018724": {"ticker": "AMZN", "title": "Z"}}'
#: Stands for a filing's type in the addresses of pages: the folder named by two letters.
PAGE_TYPE = "^[a-z]+://[^/]+/([a-z][a-z])/"
WANTED = "aapl, MSFT ,, amzn,none"

#: Decimals kept: money sums are large, so that their last bits differ between engines; prices have exact ties at six.
MONEY = 6
PRICES = 7
DIGITS = {}

QUERIES = {}


def query(f, digits: int = PRICES):
    DIGITS[f.__name__] = digits
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
    return f


def money_query(f):
    return query(f, MONEY)


def _peers(info):
    return info.withColumn("peer_group", F.coalesce("sector", F.lit("Unknown")))


def _models(spark, d):
    """Statements, info and peers on one stored base, so that the lines are summed once for all models."""
    base = tables.written(market.company_base(spark, d), "companies")
    sector = _peers(market.company_info(spark, d, base))
    return market.statement_items(spark, d, base), sector, sector


def _reports(spark, d):
    statements, info, peers = _models(spark, d)
    return R.reports(market.company_bars(spark, d, "6mo"), statements, info, peers, AS_OF, "peer_group", None)


def _flat(items, sep="|"):
    return F.array_join(items, sep)


@query
def latest_averages(spark, d):
    bars = I.with_averages(market.bars(spark, d))
    return I.latest(bars).select("ticker", "date", "close", "sma_20", "sma_50", "sma_200")


@query
def weekly_bars(spark, d):
    return market.bars(spark, d)


@query
def price_scan_period(spark, d):
    return market.bars(spark, d, "6mo")


@query
def adjusted_scan_365d(spark, d):
    return market.bars(spark, d, days=365).where(F.col("ticker").isin("T1", "T3")).select("ticker", "date", "adjusted_close")


@money_query
def company_info_defaults(spark, d):
    return market.company_scan(market.company_info(spark, d))


@query
def parse_ticker_list(spark, d):
    return spark.range(1).select(F.posexplode(market.ticker_list(F.lit(WANTED))).alias("pos", "ticker"))


@query
def latest_bar(spark, d):
    return I.latest(market.bars(spark, d))


@query
def sma_20_50_200(spark, d):
    return I.with_averages(market.company_bars(spark, d)).select("ticker", "date", "sma_20", "sma_50", "sma_200")


@query
def sma_from_store(spark, d):
    """The averages from prices bucketed by ticker: no exchange."""
    stored = tables.bucketed_prices(market.company_bars(spark, d), f"prices_{uuid.uuid4().hex}")
    return I.with_averages(stored).select("ticker", "date", "sma_20", "sma_50", "sma_200")


@query
def indicator_state(spark, d):
    """The last indicators of every company, after a refresh for each year of bars, without a look back at earlier ones."""
    store = tables.Store(spark, tables.work_path(spark, "store"))
    store.create()
    bars = tables.written(market.company_bars(spark, d), "bars")
    span = bars.agg(F.min(F.year("date")).alias("first"), F.max(F.year("date")).alias("last")).first()
    for year in range(span.first, span.last + 1):
        store.refresh_indicators(bars.where(F.year("date") == year))
    return indicators(store.indicator_state())


@query
def price_diff(spark, d):
    return market.bars(spark, d).select("ticker", "date", I.change().alias("change"))


@query
def rsi_14(spark, d):
    return I.with_rsi(market.bars(spark, d)).select("ticker", "date", "rsi")


@query
def ema_12_26(spark, d):
    return I.with_ema(market.bars(spark, d), "close", {"ema_12": 12, "ema_26": 26}).select("ticker", "date", "ema_12", "ema_26")


@query
def macd(spark, d):
    return I.with_macd(market.bars(spark, d)).select("ticker", "date", "macd", "macd_signal", "macd_histogram")


@query
def bollinger_20_2(spark, d):
    return I.with_bollinger(market.bars(spark, d)).select("ticker", "date", "bb_upper", "bb_lower")


@query
def volume_ratio(spark, d):
    return I.with_volume(market.bars(spark, d)).select("ticker", "date", "volume", "volume_sma", "volume_ratio")


@query
def momentum_1_5_21(spark, d):
    return I.with_momentum(market.bars(spark, d)).select("ticker", "date", "price_change_1d", "price_change_5d", "price_change_1mo")


@query
def support_resistance(spark, d):
    return I.with_levels(market.bars(spark, d)).select("ticker", "date", "resistance", "support")


@query
def technical_signals(spark, d):
    return I.technical(market.company_bars(spark, d), period=None).select("ticker", _flat("signals").alias("signals"))


@query
def technical_signals_6mo(spark, d):
    return I.technical(market.company_bars(spark, d)).select("ticker", _flat("signals").alias("signals"))


def _record(bars):
    t = I.technical_record(bars, None).select("technical.*")
    return t.select("ticker", "current_price", "indicators.*", "price_data.*", "moving_averages.*", F.size("signals").alias("n_signals"))


@query
def technical_record(spark, d):
    return _record(market.company_bars(spark, d))


@query
def technical_record_6mo(spark, d):
    return _record(market.company_bars(spark, d, "6mo"))


@query
def daily_returns(spark, d):
    return T.daily_returns(market.bars(spark, d))


@query
def aligned_returns(spark, d):
    return T.aligned_returns(market.bars(spark, d))


def _returns(spark, d):
    """Returns of adjusted closes, over all bars."""
    return T.aligned_returns(market.bars(spark, d), "adjusted_close")


def _year_returns(spark, d):
    """The same of the trailing 365 days."""
    return T.aligned_returns(market.bars(spark, d, days=365), "adjusted_close")


@query
def mean_returns(spark, d):
    return T.mean_returns(_returns(spark, d))


@query
def cov_matrix(spark, d):
    return T.covariance(tables.written(_returns(spark, d), "returns"))


def _cloud(spark, d, source=_returns):
    """The returns, stored, and the frontier measured on them."""
    returns = tables.written(source(spark, d), "returns")
    return returns, tables.written(P.frontier(returns), "frontier")


_FACTS = ("portfolio_id", "expected_return", "volatility", "sharpe_ratio")


@query
def efficient_frontier(spark, d):
    return P.frontier(tables.written(_year_returns(spark, d), "returns")).select(*_FACTS)


def _best(spark, d, pick, source=_returns):
    returns, cloud = _cloud(spark, d, source)
    return pick(cloud, P.positions(returns))


def _weights_flat(df):
    return df.select(*_FACTS, *[F.col("w")[i].alias(f"w{i}") for i in range(5)])


@query
def max_sharpe(spark, d):
    return _weights_flat(_best(spark, d, P.max_sharpe))


@query
def min_volatility(spark, d):
    return _weights_flat(_best(spark, d, P.min_volatility))


@query
def diversification_ratio(spark, d):
    returns, cloud = _cloud(spark, d)
    return P.diversification(P.max_sharpe(cloud, P.positions(returns)), returns)


@query
def stock_metrics(spark, d):
    returns, cloud = _cloud(spark, d)
    places = P.positions(returns)
    return P.stock_metrics(returns, P.max_sharpe(cloud, places), P.min_volatility(cloud, places))


@query
def portfolio_text(spark, d):
    best = _best(spark, d, P.max_sharpe, _year_returns)
    line = lambda label, value: F.concat(F.lit(label), value)
    weights = F.transform(F.arrays_zip("tickers", "w"), lambda x: F.concat(F.lit("    "), x["tickers"], F.lit(": "), percent(x["w"])))
    return best.select(F.concat_ws("\n", line("Expected Return: ", percent(F.col("expected_return"))), line("Volatility: ", percent(F.col("volatility"))), line("Sharpe Ratio: ", fixed(F.col("sharpe_ratio"), 2)), F.concat_ws("\n", weights)).alias("value"))


@query
def equal_weight_portfolio(spark, d):
    returns = tables.written(_returns(spark, d), "returns")
    return P.measured(P.equal_weights(returns), returns).select(*_FACTS)


@query
def custom_weight_portfolio(spark, d):
    return P.measured(P.given_weights(spark, WEIGHTS), _returns(spark, d)).select(*_FACTS)


@query
def portfolio_by_join(spark, d):
    """The frontier's portfolios, measured by the join of their weights with returns instead of in blocks."""
    returns = tables.written(_year_returns(spark, d), "returns")
    every = spark.range(P.PORTFOLIOS).select(F.col("id").alias("portfolio_id"))
    return P.measured(P.random_weights(every, P.positions(returns)), returns).select(*_FACTS)


@query
def position_limits(spark, d):
    """The frontier's portfolios with every weight brought between the limits."""
    returns = tables.written(_year_returns(spark, d), "returns")
    every = spark.range(P.PORTFOLIOS).select(F.col("id").alias("portfolio_id"))
    return P.limited(P.random_weights(every, P.positions(returns)), *LIMITS)


@query
def limited_frontier(spark, d):
    """Those portfolios, measured."""
    returns = tables.written(_year_returns(spark, d), "returns")
    every = spark.range(P.PORTFOLIOS).select(F.col("id").alias("portfolio_id"))
    held = P.limited(P.random_weights(every, P.positions(returns)), *LIMITS)
    return P.measured(held.select("portfolio_id", "ticker", F.col("limited_w").alias("w")), returns).select(*_FACTS)


def _json(path, kind="double"):
    return F.get_json_object("value", path).cast(kind)


@query
def portfolio_result(spark, d):
    """The result record, written as a JSON file of its name and read back where SQL can follow it."""
    folder = tables.work_path(spark, "portfolios")
    sinks.write_documents(sinks.portfolio_json(P.optimize(market.bars(spark, d, days=365)), GENERATED), folder)
    out = sinks.read_documents(spark, folder)
    parts = {"current": "current_portfolio", "best": "optimized_portfolios.max_sharpe", "calm": "optimized_portfolios.min_volatility"}
    facts = [_json(f"$.{path}.{f}").alias(f"{name}_{f}") for name, path in parts.items() for f in _FACTS[1:]]
    frontier = [F.from_json(F.get_json_object("value", f"$.efficient_frontier.{f}"), "array<double>").alias(f) for f in ("returns", "volatilities", "sharpe_ratios")]
    return out.select(
        "file", _json("$.tickers", "string").alias("tickers"), *facts, _json("$.diversification_ratio").alias("diversification_ratio"),
        _json("$.optimized_portfolios.max_sharpe.weights[1]").alias("best_w1"), _json("$.stock_metrics.T3.annual_volatility").alias("t3_volatility"), *frontier,
    ).select("*", F.size("returns").alias("n_points"), F.array_max("returns").alias("highest_return"), F.array_min("volatilities").alias("lowest_volatility"), F.array_max("sharpe_ratios").alias("highest_sharpe")).drop("returns", "volatilities", "sharpe_ratios")


def _series(spark, d):
    return P.portfolio_returns(_returns(spark, d), P.given_weights(spark, WEIGHTS).drop("portfolio_id"))


@query
def portfolio_returns(spark, d):
    return _series(spark, d)


@query
def drawdown_series(spark, d):
    return P.drawdowns(_series(spark, d))


@query
def portfolio_metrics(spark, d):
    return P.performance(_series(spark, d))


@query
def portfolio_metrics_many(spark, d):
    """Performance of all the frontier's portfolios, in one scan."""
    returns = tables.written(_year_returns(spark, d), "returns")
    held = P.random_weights(spark.range(P.PORTFOLIOS).select(F.col("id").alias("portfolio_id")), P.positions(returns))
    return P.performance(P.portfolio_returns(returns, held))


@money_query
def latest_statement_items(spark, d):
    return H.latest_items(market.statement_items(spark, d))


@money_query
def fundamentals(spark, d):
    return H.fundamentals(market.statement_items(spark, d))


def _ratios(spark, d):
    return H.ratios(market.statement_items(spark, d), market.company_info(spark, d))


@money_query
def ratios(spark, d):
    return _ratios(spark, d).select("ticker", *H.RATIOS)


@money_query
def ratios_unpivot(spark, d):
    return H.unpivoted(_ratios(spark, d).select("ticker", *H.RATIOS))


@money_query
def health_score(spark, d):
    return H.with_score(_ratios(spark, d)).select("ticker", "health_score", "health_status")


@money_query
def health_score_with_roe(spark, d):
    return H.with_score(_ratios(spark, d), {"roe": "return_on_equity"}).select("ticker", "health_score", "health_status")


@query
def health_risks(spark, d):
    return _ratios(spark, d).select("ticker", _flat(H.risks()).alias("risks"))


@query
def health_recommendations(spark, d):
    return H.with_score(_ratios(spark, d)).select("ticker", _flat(H.advice()).alias("recommendations"))


@money_query
def health_record(spark, d):
    t = H.health_record(market.statement_items(spark, d), market.company_info(spark, d), AS_OF).select("health.*")
    return t.drop("ratios", "risks", "recommendations")


@money_query
def dcf_valuation(spark, d):
    return V.dcf(market.statement_items(spark, d), market.company_info(spark, d))


@money_query
def dcf_projection(spark, d):
    return V.dcf_projection(market.statement_items(spark, d))


@money_query
def comparable_analysis(spark, d):
    info = _peers(market.company_info(spark, d))
    return V.comparables(info, info, "peer_group")


@money_query
def comparable_analysis_fixed_peers(spark, d):
    info = market.company_info(spark, d)
    peers = info.where(F.col("ticker").isin("S1", "S2", "S3", "S4", "S5")).withColumn("peer_group", F.lit("all"))
    return V.comparables(info, peers)


@money_query
def graham_formula(spark, d):
    return V.graham(market.company_info(spark, d))


@money_query
def valuation_summary(spark, d):
    s = V.valuation(*_models(spark, d), "peer_group").where(F.col("summary").isNotNull())
    return s.select("ticker", "summary.current_price", "summary.average_fair_value", "summary.average_upside", "summary.is_undervalued", F.col("summary.valuation_range.min").alias("range_min"), F.col("summary.valuation_range.max").alias("range_max"))


@money_query
def individual_valuations(spark, d):
    return V.valuation(*_models(spark, d), "peer_group").select("ticker", F.inline("summary.individual_valuations"))


@money_query
def recommendation(spark, d):
    return _reports(spark, d).select("ticker", "recommendation.score", "recommendation.recommendation", "recommendation.confidence")


@query
def rationale(spark, d):
    return _reports(spark, d).select("ticker", "recommendation.rationale")


@query
def risk_assessment(spark, d):
    levels = [_flat(F.col(f"risk.risk_levels.{x}")).alias(f"{x}_risks") for x in ("high", "medium", "low")]
    return _reports(spark, d).select("ticker", *levels, F.col("risk.total_risks").alias("total_risks"), F.col("risk.overall_risk").alias("overall_risk"))


@money_query
def stock_report(spark, d):
    return _reports(spark, d).select(
        "ticker", F.col("summary.average_fair_value").alias("average_fair_value"), F.col("health.health_status").alias("health_status"),
        F.col("technical.indicators.rsi").alias("rsi"), F.col("recommendation.recommendation").alias("recommendation"), F.col("recommendation.score").alias("score"), F.col("risk.overall_risk").alias("overall_risk"),
    )


@money_query
def compare_ranked(spark, d):
    # sorting by range reads its input twice: once for the bounds
    return R.ranked(tables.written(R.comparison(_reports(spark, d)), "compared"))


@money_query
def report_json(spark, d):
    """The report documents, written under their names and read back where SQL can follow them."""
    folder = tables.work_path(spark, "reports")
    sinks.write_documents(sinks.report_json(_reports(spark, d), GENERATED), folder)
    stored = sinks.read_documents(spark, folder)
    valuation = "$.sections.valuation"
    return stored.select(
        "file", _json("$.ticker", "string").alias("ticker"), _json("$.generated_date", "string").alias("generated_date"),
        _json(f"{valuation}.dcf.fair_value").alias("dcf_value"), _json(f"{valuation}.comparable_analysis.implied_price").alias("implied_price"),
        _json(f"{valuation}.graham_analysis.intrinsic_value").alias("intrinsic_value"), _json(f"{valuation}.summary.average_fair_value").alias("fair_value"),
        _json("$.sections.financial_health.health_score").alias("health_score"), _json("$.sections.financial_health.ratios.current_ratio").alias("current_ratio"),
        _json("$.sections.financial_health.company_name", "string").alias("company_name"), _json("$.sections.technical_analysis.indicators.macd").alias("macd"),
        _json("$.sections.technical_analysis.current_price").alias("price"), _json("$.investment_recommendation.recommendation", "string").alias("recommendation"),
        _json("$.investment_recommendation.score").alias("score"), _json("$.risk_assessment.risk_counts.high", "int").alias("high"), _json("$.risk_assessment.overall_risk", "string").alias("overall_risk"),
    )


@query
def report_text(spark, d):
    return R.report_text(_reports(spark, d), GENERATED)


@money_query
def analysis_results(spark, d):
    """Rows of the results table, appended, and read back where SQL can follow them."""
    store = tables.Store(spark, tables.work_path(spark, "store"))
    store.create()
    store.add_results(sinks.analysis_results(_reports(spark, d), AS_OF))
    value = lambda path, kind: F.get_json_object("result_data", path).cast(kind)
    return store.read("analysis_results").select(
        "ticker", "analysis_date", "analysis_type", "score", "recommendation", value("$.summary.average_fair_value", "double").alias("fair_value"),
        value("$.health_status", "string").alias("health_status"), value("$.indicators.rsi", "double").alias("rsi"), value("$.confidence", "string").alias("confidence"),
    )


@query
def price_append_dedup(spark, d):
    """Prices appended twice to the stored table, and its view without duplicates."""
    store = tables.Store(spark, tables.work_path(spark, "store"))
    store.create()
    prices = market.bars(spark, d)
    for _ in range(2):
        store.add_prices(prices)
    return sinks.latest_prices(store.read("price_data"))


@money_query
def company_upsert(spark, d):
    """Two upserts into the stored table: first two thirds of the companies, then every other one with new caps."""
    store = tables.Store(spark, tables.work_path(spark, "store"))
    store.create()
    k = F.substring("ticker", 2, 10).cast("int")
    store.upsert(market.companies(spark, d).where(k % 3 != 0), datetime(2001, 1, 1))
    store.upsert(market.companies(spark, d).where(k % 2 == 0).withColumn("market_cap", F.col("market_cap") * 2), datetime(2002, 1, 1))
    return store.read("companies").withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd"))


@money_query
def refresh_tickers(spark, d):
    """A year of prices and the facts of every other company, fetched twice into fresh tables."""
    store = tables.Store(spark, tables.work_path(spark, "store"))
    store.create()
    k = F.substring("ticker", 2, 10).cast("int")
    prices = tables.written(market.company_bars(spark, d, "1y").where(k % 2 == 0), "fetched")
    for year in (2001, 2002):
        store.refresh(prices, market.company_info(spark, d), datetime(year, 1, 1))
    held = store.read("price_data")
    counts = held.groupBy("ticker").agg(F.count("*").alias("n_rows")).join(sinks.latest_prices(held).groupBy("ticker").agg(F.count("*").alias("n_days")), "ticker")
    return store.read("companies").join(counts, "ticker").withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd"))


@money_query
def company_lookup(spark, d):
    """Point look-ups of a stored and of an unknown ticker."""
    store = tables.Store(spark, tables.work_path(spark, "store"))
    store.create()
    store.upsert(market.companies(spark, d), datetime(2001, 1, 1))
    return store.company("S3").unionAll(store.company("none")).drop("last_updated")


@query
def ticker_checks(spark, d):
    """Which lists of tickers are long enough for a portfolio (two) and for a comparison (one)."""

    def passes(text, least):
        try:
            return bool(market.parse_tickers(text, least))
        except ValueError:
            return False

    lists = [WANTED, "aapl", " , ,", "A,b"]
    return spark.createDataFrame([(t, passes(t, 2), passes(t, 1)) for t in lists], "tickers string, portfolio boolean, comparison boolean")


@query
def filing_requests(spark, d):
    """The addresses to ask for filing lists, and that of a filing's text."""
    wanted = spark.range(1).select(F.explode(market.ticker_list(F.lit(WANTED))).alias("ticker"))
    found = filings.filing_requests(wanted, filings.cik_directory(spark.range(1).select(F.lit(CIK_JSON).alias("json"))), "10-Q", 3)
    return found.select("*", filings.text_url("cik", F.lit("2001-02-03")).alias("text_url"))


@query
def filing_dates(spark, d):
    return filings.filing_dates(market.table(spark, d, "pages").select("page_id", "html"), 'href="([^"]*)"').withColumnRenamed("filing_date", "found")


@query
def filing_list_by_type(spark, d):
    """Links of Spanish pages, at most three a page: type, status and count are answered in the scan."""
    found = filing_source.responses(spark, f"{d}/pages.parquet", "es", 200, 3, key="page_id", pattern='href="([^"]*)"', type_pattern=PAGE_TYPE)
    return found.withColumnRenamed("filing_date", "found")


@query
def filing_text(spark, d):
    return filings.filing_text(market.table(spark, d, "pages").select("page_id", "html"))


@query
def cik_lookup(spark, d):
    wanted = spark.range(1).select(F.explode(market.ticker_list(F.lit(WANTED))).alias("ticker"))
    return filings.cik_lookup(wanted, filings.cik_directory(spark.range(1).select(F.lit(CIK_JSON).alias("json"))))


@query
def hourly_bars(spark, d):
    events = market.table(spark, d, "events").select(F.col("event_type").alias("ticker"), "ts", "value", "event_id")
    return window_bars(events).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def entry(spark, d="/root/testdata/sf0.001"):
    return QUERIES["latest_averages"](spark, d)
