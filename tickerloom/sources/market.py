"""Sources: scans with pushed-down periods and defaults, and market tables derived from the test schema."""

from __future__ import annotations

from calendar import monthrange
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import or_else

PRICES = "ticker string, date date, open double, high double, low double, close double, volume bigint, adjusted_close double"
COMPANIES = "ticker string, name string, sector string, industry string, country string, market_cap double, last_updated timestamp"
RESULTS = "ticker string, analysis_date date, analysis_type string, result_data string, score double, recommendation string"
#: Days or months of a period's name.
PERIODS = {"1d": ("days", 1), "5d": ("days", 5), "1mo": ("months", 1), "3mo": ("months", 3), "6mo": ("months", 6), "1y": ("months", 12), "2y": ("months", 24), "5y": ("months", 60)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker_list(text: Column) -> Column:
    """A comma list as an array of tickers: trimmed, upper case, blanks dropped, order kept."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.upper(F.trim(t))), lambda t: F.length(t) > 0)


def parse_tickers(text: str, least: int = 1) -> list[str]:
    """The tickers of a comma list, checked before anything is planned: a portfolio asks for two, a comparison for one."""
    found = [t.strip().upper() for t in text.split(",") if t.strip()]
    if len(found) < least:
        raise ValueError(f"Please enter at least {least} ticker{'s' if least > 1 else ''}")
    return found


def period_start(end: date, period: str = "1y") -> date:
    """The first day of the period that ends with ``end``; months end where the shorter month does."""
    unit, n = PERIODS[period]
    if unit == "days":
        return end - timedelta(days=n)
    months = end.year * 12 + end.month - 1 - n
    year, month = divmod(months, 12)
    return date(year, month + 1, min(end.day, monthrange(year, month + 1)[1]))


def since(bars: DataFrame, period: str = "1y", end: date | None = None) -> DataFrame:
    """Bars from ``end`` (the latest date, unless given) less the period on; the bounds are literals."""
    end = end or bars.agg(F.max("date")).first()[0]
    return bars if end is None else bars.where(F.col("date").between(F.lit(period_start(end, period)), F.lit(end)))


def last_days(bars: DataFrame, days: int = 365, end: date | None = None) -> DataFrame:
    """Bars of the trailing calendar days."""
    end = end or bars.agg(F.max("date")).first()[0]
    return bars if end is None else bars.where(F.col("date").between(F.lit(end - timedelta(days=days)), F.lit(end)))


def company_scan(info: DataFrame) -> DataFrame:
    """Company attributes with their defaults."""
    return info.select(
        "ticker",
        F.coalesce("longName", "ticker").alias("name"),
        or_else("sector", "Unknown").alias("sector"),
        or_else("industry", "Unknown").alias("industry"),
        or_else("country", "US").alias("country"),
        or_else("marketCap", 0.0).alias("market_cap"),
        or_else("longBusinessSummary", "").alias("description"),
    )


def _money(c: str, scale: int = 2, digits: int = 12) -> Column:
    return F.col(c).cast(f"decimal({digits},{scale})")


def weekly_bars(lineitem: DataFrame, ticker: Column, many: bool = False) -> DataFrame:
    """Weekly bars from order lines: one pass, partial sums before the shuffle; decimals make sums exact.

    ``many`` is for tickers that have few lines a week: lines are dealt by ticker and week first. Partial sums would
    not make them fewer, and the first trade's six keys would have each task sort a whole split of the input.
    """
    lines = lineitem.select(
        ticker.alias("ticker"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
    )
    lines = lines.repartition("ticker", "date") if many else lines
    first = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    quantity = F.sum(_money("l_quantity")).cast("double")
    value = F.sum(_money("l_extendedprice")).cast("double")
    net = F.sum(_money("l_extendedprice") * (F.lit(1) - _money("l_discount", 2, 4))).cast("double")
    return lines.groupBy("ticker", "date").agg(
        F.min_by("px", first).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        (value / quantity).alias("close"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("volume"),
        (net / quantity).alias("adjusted_close"),
    )


def _scan(spark: SparkSession, sf_dir: str, ticker: Column, period: str | None = None, days: int | None = None, many: bool = False) -> DataFrame:
    """Weekly bars, of all time or of a trailing period.

    The last day is one scalar read from the date column alone; the period's first day then reaches the
    Parquet scan, below the weekly sums. Lines before it cannot be in a week that begins after it.
    """
    lines = table(spark, sf_dir, "lineitem")
    last = lines.agg(F.max("l_shipdate").cast("date")).first()[0] if period or days is not None else None
    if last is None:
        return weekly_bars(lines, ticker, many)
    end = last - timedelta(days=last.weekday())
    start = period_start(end, period) if period else end - timedelta(days=days)
    kept = lines.where(F.col("l_shipdate") >= F.lit(f"{start} 00:00:00").cast("timestamp_ntz"))
    return weekly_bars(kept, ticker, many).where(F.col("date") >= F.lit(start))


def bars(spark: SparkSession, sf_dir: str, period: str | None = None, days: int | None = None) -> DataFrame:
    """Five tickers, T0 to T4."""
    return _scan(spark, sf_dir, F.concat(F.lit("T"), (F.col("l_suppkey") % 5).cast("string")), period, days)


def company_bars(spark: SparkSession, sf_dir: str, period: str | None = None) -> DataFrame:
    """One ticker for each supplier."""
    return _scan(spark, sf_dir, F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), period, many=True)


def company_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with nation, region and revenue r; k is the supplier key."""
    revenue = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum(_money("l_extendedprice")).cast("double").alias("r"))
    s, n, g = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    named = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(g), n.n_regionkey == g.r_regionkey)
    k = F.col("k")
    return (
        named.select(F.col("s_suppkey").alias("k"), "s_name", "n_name", "r_name")
        .join(revenue, "k")
        .select(
            "k", "s_name", "n_name", "r_name", "r", F.concat(F.lit("S"), k.cast("string")).alias("ticker"),
            F.lit(1_000_000.0).alias("shares"), (20.0 + (k % 10) * 10.0).alias("price"),
            (F.col("r") * ((k % 9) - 2) / 20).alias("net_income"), (F.col("r") * ((k % 6) - 1) / 4).alias("equity"),
            (F.col("r") * ((k % 8) - 2) / 20).alias("ocf"), (-F.col("r") * (k % 3) / 40).alias("capex"),
        )
    )


def statement_items(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Long statements (ticker, statement, item, fiscal_date, value) for two fiscal years; ``base`` is a stored ``company_base``."""
    k, r = F.col("k"), F.col("r")

    def row(statement: str, item, value: Column) -> Column:
        return F.struct(F.lit(statement).alias("statement"), (F.lit(item) if isinstance(item, str) else item).alias("item"), value.alias("value"))

    def either(condition: Column, then: str, other: str) -> Column:
        return F.when(condition, F.lit(then)).otherwise(F.lit(other))

    free = F.col("ocf") - F.abs("capex")
    items = F.array(
        row("income", either(k % 4 == 0, "Revenue", "Total Revenue"), r),
        row("balance", either(k % 2 == 1, "Total Current Assets", "Current Assets"), r * (0.5 + (k % 7) * 0.4)),
        row("balance", either(k % 2 == 1, "Total Current Liabilities", "Current Liabilities"), r),
        row("balance", "Total Liabilities", r * (k % 5) / 8),
        row("balance", "Total Assets", r * 2),
        row("balance", either(k % 3 == 0, "Stockholders' Equity", "Total Equity"), F.col("equity")),
        row("income", "Net Income", F.col("net_income")),
        row("income", "Operating Income", r * ((k % 9) - 1) / 15),
        row("income", "Interest Expense", -r * (k % 4) / 50),
        row("cashflow", either(k % 5 == 4, "Cash Flow From Continuing Operating Activities", "Operating Cash Flow"), F.col("ocf")),
        row("cashflow", either(k % 2 == 0, "Capital Expenditures", "Capital Expenditure"), F.col("capex")),
        row("cashflow", F.when(k % 10 != 9, F.lit("Free Cash Flow")), free),
    )
    years = F.array(*[F.struct(F.lit(d).cast("date").alias("fiscal_date"), F.lit(s).alias("scale")) for d, s in (("2001-12-31", 1.0), ("2000-12-31", 0.9))])
    long = (company_base(spark, sf_dir) if base is None else base).select("ticker", F.explode(items).alias("i"), years.alias("years")).select("ticker", "i.*", F.explode("years").alias("y"))
    return long.where(F.col("item").isNotNull()).select("ticker", "statement", "item", "y.fiscal_date", (F.col("value") * F.col("y.scale")).alias("value"))


def company_info(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """One row for each company with the nullable keys that the models read; ``base`` is a stored ``company_base``."""
    k, price, shares, r = F.col("k"), F.col("price"), F.col("shares"), F.col("r")
    eps, book = F.col("net_income") / shares, F.col("equity") / shares
    return (company_base(spark, sf_dir) if base is None else base).select(
        "ticker",
        *[F.when(k % 8 != 7, F.col(c)).alias(n) for c, n in (("s_name", "longName"), ("r_name", "sector"), ("n_name", "industry"))],
        F.col("n_name").alias("country"), F.lit(None).cast("string").alias("longBusinessSummary"), (price * shares).alias("marketCap"),
        F.when(k % 10 != 9, F.col("ocf") - F.abs("capex")).alias("freeCashflow"),
        shares.alias("sharesOutstanding"), price.alias("currentPrice"),
        F.when(eps > 0, price / eps).alias("trailingPE"), F.when(book > 0, price / book).alias("priceToBook"),
        (price / (r / shares)).alias("priceToSalesTrailing12Months"), F.when(k % 7 != 6, 5.0 + k % 13).alias("enterpriseToEbitda"),
        eps.alias("trailingEps"), book.alias("bookValue"), (r / shares).alias("revenuePerShare"),
        F.when(k % 5 != 0, ((k % 7) - 1) * 0.05).alias("earningsGrowth"),
        ((k % 10) / 20).alias("grossMargins"), (((k % 6) - 2) * 0.04).alias("revenueGrowth"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company_base(spark, sf_dir).select("ticker", F.col("s_name").alias("name"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"), F.col("n_name").alias("country"), (F.col("price") * F.col("shares")).alias("market_cap"))
