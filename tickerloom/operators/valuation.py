"""Valuation models: discounted cash flow, comparables, Graham, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import first_truthy, listed, or_else

GROWTH, TERMINAL, DISCOUNT, YEARS = 0.05, 0.025, 0.08, 5
GROWTH_CAP, MARGIN = 0.15, 0.75
METRICS = {"pe": "trailingPE", "pb": "priceToBook", "ps": "priceToSalesTrailing12Months", "ev_to_ebitda": "enterpriseToEbitda", "market_cap": "marketCap"}


def upside(value: Column, price: Column) -> Column:
    """Percent by which a value exceeds the price; 0 without a price."""
    return F.when(price > 0, (value - price) / price * 100).otherwise(0.0)


def _free_cash(statements: DataFrame) -> DataFrame:
    """(ticker, fcf): the latest free cash flow, where both it and operating cash flow are reported, and positive."""
    flow = statements.where(F.col("statement") == "cashflow").groupBy("ticker").agg(
        F.max_by(F.when(F.col("item") == "Free Cash Flow", F.col("value")), F.when(F.col("item") == "Free Cash Flow", F.col("fiscal_date"))).alias("fcf"),
        F.max(F.col("item") == "Operating Cash Flow").alias("operating"),
    )
    return flow.where(F.col("operating") & (F.col("fcf") > 0)).select("ticker", "fcf")


def dcf(statements: DataFrame, info: DataFrame, growth: float = GROWTH, terminal: float = TERMINAL, discount: float = DISCOUNT, years: int = YEARS) -> DataFrame:
    """Fair value from free cash flow grown for some years and a terminal value, all discounted."""
    fcf = F.col("fcf")
    steps = F.sequence(F.lit(1), F.lit(years))
    present = F.aggregate(F.transform(steps, lambda i: fcf * F.pow(F.lit(1 + growth), i) / F.pow(F.lit(1 + discount), i)), F.lit(0.0), lambda a, x: a + x)
    end = fcf * (1 + growth) ** years * (1 + terminal) / (discount - terminal) / (1 + discount) ** years
    shares, price = or_else("sharesOutstanding", 1.0), or_else("currentPrice", 0.0)
    out = _free_cash(statements).join(info, "ticker")
    fair = F.when(shares > 0, (present + end) / shares).otherwise(0.0)
    return out.select("ticker", price.alias("current_price"), fair.alias("fair_value"), "fcf").select(
        "ticker", "current_price", "fair_value", upside(F.col("fair_value"), F.col("current_price")).alias("upside"), "fcf",
        F.lit(growth).alias("growth_rate"), F.lit(discount).alias("discount_rate"), (F.col("fair_value") > F.col("current_price")).alias("is_undervalued"),
    )


def dcf_projection(statements: DataFrame, growth: float = GROWTH, discount: float = DISCOUNT, years: int = YEARS) -> DataFrame:
    """(ticker, year, fcf, present_value) of the projected years."""
    rows = _free_cash(statements).select("ticker", F.col("fcf").alias("base"), F.explode(F.sequence(F.lit(1), F.lit(years))).alias("year"))
    value = F.col("base") * F.pow(F.lit(1 + growth), "year")
    return rows.select("ticker", "year", value.alias("fcf"), (value / F.pow(F.lit(1 + discount), "year")).alias("present_value"))


def peer_averages(peers: DataFrame) -> DataFrame:
    """Per peer_group: mean non-zero multiples of the peers that have all five metrics, and their number."""
    valid = peers.dropna(subset=list(METRICS.values()))
    return valid.groupBy("peer_group").agg(
        F.count("*").alias("peer_count"),
        *[F.avg(F.when(F.col(METRICS[m]) != 0, F.col(METRICS[m]))).alias(f"avg_{m}") for m in ("pe", "pb", "ps")],
    )


def comparables(info: DataFrame, peers: DataFrame, group: str | None = None) -> DataFrame:
    """Implied prices from peers' multiples. ``peers`` has info columns and peer_group; targets join on ``group``,
    or, without one, all targets share the single group. Only the averages, one row a group, are broadcast."""
    averages = peer_averages(peers)
    targets = info.withColumn("peer_group", F.col(group)) if group else info.withColumn("peer_group", F.lit("all"))
    joined = targets.join(averages, "peer_group")
    price = or_else("currentPrice", 0.0)
    implied = {m: F.when((or_else(base, 0.0) != 0) & F.col(f"avg_{m}").isNotNull(), F.col(base) * F.col(f"avg_{m}")).otherwise(0.0) for m, base in (("pe", "trailingEps"), ("pb", "bookValue"), ("ps", "revenuePerShare"))}
    out = joined.withColumns({f"implied_{m}_price": v for m, v in implied.items()})
    positive = F.filter(F.array(*[F.col(f"implied_{m}_price") for m in implied]), lambda x: x > 0)
    mean = F.when(F.size(positive) > 0, F.aggregate(positive, F.lit(0.0), lambda a, x: a + x) / F.size(positive)).otherwise(0.0)
    out = out.withColumn("implied_price", mean)
    return out.select("ticker", price.alias("current_price"), "implied_price", *[f"implied_{m}_price" for m in implied], "peer_count", "avg_pe", "avg_pb", "avg_ps", upside(F.col("implied_price"), price).alias("upside"))


def graham(info: DataFrame) -> DataFrame:
    """Graham number and growth value of tickers with positive earnings and book value."""
    eps, book, price = F.col("trailingEps"), F.col("bookValue"), or_else("currentPrice", 0.0)
    out = info.where((eps > 0) & (book > 0)).select(
        "ticker", price.alias("current_price"), F.sqrt(22.5 * eps * book).alias("graham_number"),
        F.least(or_else("earningsGrowth", 0.05), F.lit(GROWTH_CAP)).alias("growth_assumption"), eps.alias("eps"), book.alias("book_value"),
    )
    out = out.withColumn("intrinsic_value", F.col("eps") * (8.5 + 2 * F.col("growth_assumption")))
    out = out.withColumn("margin_of_safety_price", F.col("intrinsic_value") * MARGIN)
    return out.withColumns({"is_undervalued_graham": F.col("current_price") < F.col("graham_number"), "is_undervalued_intrinsic": F.col("current_price") < F.col("margin_of_safety_price")})


def methods() -> Column:
    """The valuations of a row with structs dcf, comps and graham: array of (method, value, upside), positive ones only."""

    def one(name: str, value: Column, gain: Column) -> Column:
        return F.when(value > 0, F.struct(F.lit(name).alias("method"), value.alias("value"), gain.alias("upside")))

    discounted = upside(F.col("graham.intrinsic_value") * MARGIN, F.col("graham.current_price"))
    return listed(one("DCF", F.col("dcf.fair_value"), F.col("dcf.upside")), one("Comparables", F.col("comps.implied_price"), F.col("comps.upside")), one("Graham", F.col("graham.intrinsic_value"), discounted))


def summary(models: DataFrame) -> DataFrame:
    """``models`` (ticker and nullable structs dcf, comps, graham) with struct ``summary``; NULL without a valuation."""
    out = models.withColumn("_v", methods())
    n = F.size("_v")
    mean = lambda field: F.aggregate(F.transform("_v", lambda x: x[field]), F.lit(0.0), lambda a, x: a + x) / n
    price = first_truthy("dcf.current_price", "comps.current_price", "graham.current_price")
    record = F.struct(
        price.alias("current_price"), mean("value").alias("average_fair_value"), mean("upside").alias("average_upside"), (mean("value") > price).alias("is_undervalued"),
        F.struct(F.array_min(F.col("_v.value")).alias("min"), F.array_max(F.col("_v.value")).alias("max")).alias("valuation_range"), F.col("_v").alias("individual_valuations"),
    )
    return out.withColumn("summary", F.when(n > 0, record)).drop("_v")


def valuation(statements: DataFrame, info: DataFrame, peers: DataFrame, group: str | None = None) -> DataFrame:
    """(ticker, dcf, comps, graham, summary) for every ticker of ``info``; a model that does not apply is NULL."""
    out = info.select("ticker")
    for name, model in (("dcf", dcf(statements, info)), ("comps", comparables(info, peers, group)), ("graham", graham(info))):
        out = out.join(model.select("ticker", F.struct(*model.columns).alias(name)), "ticker", "left")
    return summary(out)
