"""Portfolio analytics: weighted returns, the Monte-Carlo frontier, optimal portfolios, performance.

A portfolio's variance is that of its own return series, so no covariance matrix is needed to measure it:
blocks of random portfolios make their weights in place, multiply them with blocks of returns, and their
moments add up over chunks of days. Given portfolios are rows (portfolio_id, ticker, w) joined with returns.
Any number of tickers works alike.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.code import shipped
from ..sources.tables import written
from .returns import aligned_returns, blocked, matrix, mean_returns

YEAR = 252
RISK_FREE = 0.04
PORTFOLIOS = 10_000
#: Portfolios that one task measures over a chunk of days.
BLOCK_PORTFOLIOS = 512
#: Days in a block of a drawdown scan.
SCAN_DAYS = 64


def positions(returns: DataFrame) -> DataFrame:
    """(ticker, j): each ticker's place in order, from one row that lists the tickers' names alone."""
    names = returns.select("ticker").distinct().agg(F.sort_array(F.collect_list("ticker")).alias("t"))
    return names.select(F.posexplode("t").alias("j", "ticker")).select("ticker", "j")


def _sharpe(df: DataFrame, risk_free: float) -> DataFrame:
    return df.withColumn("sharpe_ratio", F.when(F.col("volatility") > 0, (F.col("expected_return") - risk_free) / F.col("volatility")).otherwise(0.0))


def measured(weights: DataFrame, returns: DataFrame, risk_free: float = RISK_FREE) -> DataFrame:
    """Expected return, volatility and Sharpe ratio of portfolios given as rows (portfolio_id, ticker, w).

    One join by ticker; partial sums make each portfolio's return a date before the shuffle.
    """
    series = weights.join(returns, "ticker").groupBy("portfolio_id", "date").agg(F.sum(F.col("w") * F.col("ret")).alias("r"))
    facts = series.groupBy("portfolio_id").agg((F.avg("r") * YEAR).alias("expected_return"), F.sqrt(F.var_samp("r") * YEAR).alias("volatility"))
    return _sharpe(facts, risk_free)


def equal_weights(returns: DataFrame) -> DataFrame:
    n = returns.agg(F.count_distinct("ticker").alias("n"))
    return returns.select("ticker").distinct().crossJoin(F.broadcast(n)).select(F.lit(0).cast("long").alias("portfolio_id"), "ticker", (F.lit(1.0) / F.col("n")).alias("w"))


def given_weights(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    """A portfolio by ticker name; a ticker without a weight has none."""
    rows = F.array(*[F.struct(F.lit(t).alias("ticker"), F.lit(float(w)).alias("w")) for t, w in weights.items()])
    return spark.range(1).select(F.lit(0).cast("long").alias("portfolio_id"), F.inline(rows))


def random_weights(portfolios: DataFrame, places: DataFrame) -> DataFrame:
    """(portfolio_id, ticker, w) of the portfolios named: a weight is the hash of portfolio and ticker position, normalised; the same on every run."""
    text = F.concat(F.col("portfolio_id").cast("string"), F.lit(":"), F.col("j").cast("string"))
    raw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") + 1
    dealt = places.crossJoin(F.broadcast(portfolios.select("portfolio_id"))).select("portfolio_id", "ticker", raw.alias("raw"))
    total = dealt.groupBy("portfolio_id").agg(F.sum("raw").alias("total"))
    return dealt.join(total, "portfolio_id").select("portfolio_id", "ticker", (F.col("raw") / F.col("total")).alias("w"))


def _raw(portfolio: int, places: list[int]) -> list[int]:
    """What ``random_weights`` hashes, for one portfolio and some tickers."""
    return [int(hashlib.md5(f"{portfolio}:{j}".encode(), usedforsecurity=False).hexdigest()[:8], 16) + 1 for j in places]


_MOMENTS = "portfolio_id long, n double, mean double, m2 double"


def frontier(returns: DataFrame, n: int = PORTFOLIOS, risk_free: float = RISK_FREE) -> DataFrame:
    """Expected return, volatility and Sharpe ratio of n random portfolios (0 to n - 1) over any number of tickers.

    A task has a block of portfolios and a chunk of days; it adds up weights times returns ticker block by ticker
    block. Weights are not stored anywhere: they follow from their hashes, and their sum over all tickers divides
    at the end. The chunks' counts, means and squared deviations then make one row a portfolio.
    """
    shipped(returns.sparkSession)
    places = positions(returns)
    count = returns.agg(F.count_distinct("ticker")).first()[0]
    named = returns.join(places, "ticker").select(F.lpad(F.col("j").cast("string"), 12, "0").alias("ticker"), "date", "ret")  # blocks carry places as names
    rows = blocked(named, "ret", count)
    dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // BLOCK_PORTFOLIOS))))
    size = BLOCK_PORTFOLIOS

    def moments(key, table):
        ids = range(key[0].as_py() * size, min(n, (key[0].as_py() + 1) * size))
        total, sums = np.zeros(len(ids)), 0.0
        for batch in table.to_batches(max_chunksize=1):
            for row in batch.to_pylist():
                x, at = matrix(row), [int(t) for t in row["tickers"]]
                raw = np.array([_raw(p, at) for p in ids], float)
                total += raw.sum(axis=1)
                sums = sums + raw @ x
        series = sums / total[:, None]
        mean = series.mean(axis=1)
        m2 = ((series - mean[:, None]) ** 2).sum(axis=1)
        return pa.table([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), float(series.shape[1]))), pa.array(mean), pa.array(m2)], names=["portfolio_id", "n", "mean", "m2"])

    chunks = dealt.groupBy("part", "chunk").applyInArrow(moments, _MOMENTS)
    days, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    spread = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - days * mean * mean
    facts = chunks.groupBy("portfolio_id").agg((mean * YEAR).alias("expected_return"), F.sqrt(F.when(days > 1, F.greatest(spread, F.lit(0.0)) / F.greatest(days - 1, F.lit(1.0))) * YEAR).alias("volatility"))
    return _sharpe(facts, risk_free)


def _best(portfolios: DataFrame, places: DataFrame, by: str, highest: bool) -> DataFrame:
    row = F.struct("portfolio_id", "expected_return", "volatility", "sharpe_ratio")
    pick = F.max_by(row, F.struct(by, -F.col("portfolio_id"))) if highest else F.min_by(row, F.struct(by, F.col("portfolio_id")))
    best = portfolios.agg(pick.alias("b")).select("b.*")
    listed = random_weights(best, places).groupBy("portfolio_id").agg(F.sort_array(F.collect_list(F.struct("ticker", "w"))).alias("x"))
    return best.join(F.broadcast(listed), "portfolio_id").select("portfolio_id", F.col("x.ticker").alias("tickers"), F.col("x.w").alias("w"), "expected_return", "volatility", "sharpe_ratio")


def max_sharpe(portfolios: DataFrame, places: DataFrame) -> DataFrame:
    """The portfolio with the highest Sharpe ratio, with its weights in ticker order; among equals the first."""
    return _best(portfolios, places, "sharpe_ratio", True)


def min_volatility(portfolios: DataFrame, places: DataFrame) -> DataFrame:
    return _best(portfolios, places, "volatility", False)


def limited(weights: DataFrame, least: float, most: float) -> DataFrame:
    """(portfolio_id, ticker, w, limited_w): the nearest weights that sum to 1 and lie between ``least`` and ``most``.

    The projection on the capped simplex: weights less one shift a portfolio, cut off at the limits. As the shift
    grows, a weight leaves the upper limit at w - most and reaches the lower one at w - least. With these points
    sorted, running sums give the weights' total at each, and so the stretch in which it passes 1. Where
    the limits allow no such weights, limited_w is NULL.
    """
    ends = F.array(F.struct((F.col("w") - most).alias("at"), F.lit(1).alias("step")), F.struct((F.col("w") - least).alias("at"), F.lit(-1).alias("step")))
    points = weights.select("portfolio_id", F.inline(ends)).groupBy("portfolio_id", "at").agg(F.sum("step").alias("step"))
    sizes = weights.groupBy("portfolio_id").agg(F.count("*").alias("n"))
    line = Window.partitionBy("portfolio_id").orderBy("at")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumns({"moving": F.sum("step").over(upto), "next": F.lead("at").over(line)})
    # what is lost up to the next point: the moving weights times the way there
    points = points.withColumn("lost", F.sum(F.col("moving") * (F.col("next") - F.col("at"))).over(upto)).withColumn("before", F.coalesce(F.lag("lost").over(line), F.lit(0.0)))
    points = points.join(sizes, "portfolio_id")
    excess = F.col("n") * most - 1 - F.col("before")  # the total less 1 at this point
    crossed = points.where((excess >= -1e-12) & (F.col("moving") > 0)).withColumn("shift", F.col("at") + F.greatest(excess, F.lit(0.0)) / F.greatest("moving", F.lit(1)))
    shift = crossed.where(F.col("shift") <= F.col("next") + 1e-12).groupBy("portfolio_id").agg(F.min("shift").alias("shift"))
    possible = sizes.where((F.col("n") * least <= 1 + 1e-12) & (F.col("n") * most >= 1 - 1e-12)).join(shift, "portfolio_id", "left").select("portfolio_id", F.coalesce("shift", F.lit(0.0)).alias("shift"))
    return weights.join(possible, "portfolio_id", "left").select("portfolio_id", "ticker", "w", F.greatest(F.lit(least), F.least(F.lit(most), F.col("w") - F.col("shift"))).alias("_w"), "shift").select("portfolio_id", "ticker", "w", F.when(F.col("shift").isNotNull(), F.col("_w")).alias("limited_w"))


def diversification(best: DataFrame, returns: DataFrame) -> DataFrame:
    """Root of the mean variance over the portfolio's volatility, neither annualised; 1 without volatility."""
    mean = returns.groupBy("ticker").agg(F.var_samp("ret").alias("v")).agg(F.avg("v").alias("mean_variance"))
    spread = F.col("volatility") / math.sqrt(YEAR)
    return best.select("volatility").crossJoin(F.broadcast(mean)).select(F.when(spread > 0, F.sqrt("mean_variance") / spread).otherwise(1.0).alias("diversification_ratio"))


def stock_metrics(returns: DataFrame, sharpe: DataFrame, calm: DataFrame, risk_free: float = RISK_FREE) -> DataFrame:
    """Per ticker: its weights in both optimal portfolios, annual return and volatility, Sharpe ratio."""
    facts = returns.groupBy("ticker").agg((F.avg("ret") * YEAR).alias("annual_return"), F.sqrt(F.var_samp("ret") * YEAR).alias("annual_volatility"))

    def rows(best: DataFrame, name: str) -> DataFrame:
        return best.select(F.inline(F.arrays_zip("tickers", "w"))).select(F.col("tickers").alias("ticker"), F.col("w").alias(name))

    both = facts.join(rows(sharpe, "weight_max_sharpe"), "ticker").join(rows(calm, "weight_min_vol"), "ticker")
    ratio = F.when(F.col("annual_volatility") > 0, (F.col("annual_return") - risk_free) / F.col("annual_volatility")).otherwise(0.0)
    return both.select("ticker", "weight_max_sharpe", "weight_min_vol", "annual_return", "annual_volatility", ratio.alias("sharpe_ratio"))


def optimize(prices: DataFrame, weights: dict[str, float] | None = None, n: int = PORTFOLIOS, column: str = "adjusted_close", risk_free: float = RISK_FREE) -> DataFrame:
    """One nested row: tickers, the current portfolio, both optima, stock metrics, diversification, the frontier.

    ``prices`` are the bars of the period, as a rule those of the trailing 365 days (``market.last_days``).
    """
    spark = prices.sparkSession
    returns = written(aligned_returns(prices, column), "returns")  # read by every part
    places = positions(returns)
    cloud = written(frontier(returns, n, risk_free), "frontier")
    best, calm = (written(f(cloud, places), "best") for f in (max_sharpe, min_volatility))
    held = given_weights(spark, weights) if weights else equal_weights(returns)
    listed = positions(returns).join(held, "ticker", "left").agg(F.sort_array(F.collect_list(F.struct("ticker", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("x"))
    current = measured(held, returns, risk_free).crossJoin(F.broadcast(listed)).withColumn("w", F.col("x.w"))

    def record(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct(F.col("w").alias("weights"), "expected_return", "volatility", "sharpe_ratio").alias(name))

    metrics = stock_metrics(returns, best, calm, risk_free)
    by_ticker = metrics.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", F.struct(*metrics.columns[1:]).alias("m"))))).alias("stock_metrics"))
    points = cloud.agg(F.sort_array(F.collect_list(F.struct("portfolio_id", "expected_return", "volatility", "sharpe_ratio"))).alias("p"))
    lists = points.select(F.struct(F.col("p.expected_return").alias("returns"), F.col("p.volatility").alias("volatilities"), F.col("p.sharpe_ratio").alias("sharpe_ratios")).alias("efficient_frontier"))
    out = best.select("tickers")
    for part in (record(current, "current_portfolio"), record(best, "max_sharpe"), record(calm, "min_volatility"), by_ticker, diversification(best, returns), lists):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out.withColumn("optimized_portfolios", F.struct("max_sharpe", "min_volatility")).drop("max_sharpe", "min_volatility")


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """(date, ret) of a portfolio given by rows (ticker, w), or (portfolio_id, date, ret) of many given by rows (portfolio_id, ticker, w)."""
    key = ["portfolio_id"] if "portfolio_id" in weights.columns else []
    return returns.join(weights, "ticker").groupBy(*key, "date").agg(F.sum(F.col("ret") * F.col("w")).alias("ret"))


def drawdowns(series: DataFrame) -> DataFrame:
    """(date, ret, cumulative, peak, drawdown) of returns, of one portfolio or, with a column portfolio_id, of many.

    A scan in two levels: within blocks of ``SCAN_DAYS`` days, each a partition of its own, then over the blocks'
    products and extremes, which are carried into the block behind them. A negative growth factor
    turns a block's lowest value into its highest, so both are kept.
    """
    key = ["portfolio_id"] if "portfolio_id" in series.columns else []
    rows = series.withColumn("_b", F.floor(F.unix_date("date") / SCAN_DAYS))
    inner = Window.partitionBy(*key, "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.product(1 + F.col("ret")).over(inner))
    blocks = rows.groupBy(*key, "_b").agg(F.max_by("_c", "date").alias("_p"), F.max("_c").alias("_high"), F.min("_c").alias("_low"), F.lit(1).alias("_one"))
    before = Window.partitionBy(*(key or ["_one"])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_carry", F.coalesce(F.product("_p").over(before), F.lit(1.0)))
    blocks = blocks.withColumn("_peak", F.max(F.greatest(F.col("_carry") * F.col("_high"), F.col("_carry") * F.col("_low"))).over(before))
    rows = rows.join(blocks.select(*key, "_b", "_carry", "_peak"), [*key, "_b"]).withColumn("cumulative", F.col("_carry") * F.col("_c"))
    rows = rows.withColumn("peak", F.greatest("_peak", F.max("cumulative").over(inner)))
    return rows.select(*key, "date", "ret", "cumulative", "peak", ((F.col("cumulative") - F.col("peak")) / F.col("peak")).alias("drawdown"))


def performance(series: DataFrame, risk_free: float = RISK_FREE) -> DataFrame:
    """Eleven performance metrics of returns (date, ret), one row for each portfolio_id if there is such a column; none without returns."""
    key = ["portfolio_id"] if "portfolio_id" in series.columns else []
    r = F.col("ret")
    facts = drawdowns(series).groupBy(*key).agg(
        F.count("*").alias("n"),
        (F.product(1 + r) - 1).alias("total_return"),
        (F.stddev_samp("ret") * math.sqrt(YEAR)).alias("annual_volatility"),
        F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.sqrt(F.avg(F.when(r < 0, r * r))) * math.sqrt(YEAR), F.lit(0.0)).alias("downside"),
        (F.count_if(r > 0) / F.count("*")).alias("win_rate"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("won"),
        F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)).alias("lost"),
    )
    facts = facts.where("n > 0").withColumn("annual_return", F.col("total_return") * YEAR / F.col("n"))
    excess = F.col("annual_return") - risk_free
    return facts.select(
        *key,
        "total_return",
        "annual_return",
        "annual_volatility",
        F.when(F.col("annual_volatility") > 0, excess / F.col("annual_volatility")).otherwise(0.0).alias("sharpe_ratio"),
        F.when(F.col("downside") > 0, excess / F.col("downside")).otherwise(0.0).alias("sortino_ratio"),
        F.when(F.col("max_drawdown") != 0, F.col("annual_return") / F.abs("max_drawdown")).otherwise(0.0).alias("calmar_ratio"),
        "max_drawdown",
        "win_rate",
        "avg_win",
        "avg_loss",
        F.when(F.col("lost") != 0, F.abs(F.col("won") / F.col("lost"))).otherwise(0.0).alias("profit_factor"),
    )
