"""Financial health: ratios from statements, benchmark score, risks and advice."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import first_truthy, listed, or_else, ratio, said

#: Ratio, kind of bound, bound, good.
BENCHMARKS = [
    ("current_ratio", "min", 1.5, 2.0),
    ("debt_to_equity", "max", 0.5, 0.3),
    ("interest_coverage", "min", 3.0, 5.0),
    ("roe", "min", 0.15, 0.20),
    ("net_margin", "min", 0.10, 0.15),
]
RATIOS = ["current_ratio", "debt_to_equity", "debt_to_assets", "gross_margin", "operating_margin", "net_margin", "return_on_equity", "return_on_assets", "interest_coverage", "capex_coverage", "free_cash_flow", "fcf_margin"]
#: Statement, column, labels of an item in order of preference.
ITEMS = [
    ("balance", "total_assets", ["Total Assets"]),
    ("balance", "current_assets", ["Current Assets", "Total Current Assets"]),
    ("balance", "current_liabilities", ["Current Liabilities", "Total Current Liabilities"]),
    ("balance", "total_liabilities", ["Total Liabilities"]),
    ("balance", "total_equity", ["Total Equity", "Stockholders' Equity"]),
    ("income", "revenue", ["Total Revenue", "Revenue"]),
    ("income", "net_income", ["Net Income"]),
    ("income", "operating_income", ["Operating Income"]),
    ("income", "interest_expense", ["Interest Expense"]),
    ("cashflow", "operating_cash_flow", ["Operating Cash Flow", "Cash Flow From Continuing Operating Activities"]),
    ("cashflow", "capex", ["Capital Expenditure", "Capital Expenditures"]),
]


def latest_items(statements: DataFrame) -> DataFrame:
    """Items at the latest balance-sheet date of each ticker that has balance and income statements."""
    at = F.max(F.when(F.col("statement") == "balance", F.col("fiscal_date")))
    income = F.max(F.col("statement") == "income")
    w = Window.partitionBy("ticker")
    marked = statements.withColumns({"_at": at.over(w), "_income": income.over(w)})
    return marked.where((F.col("fiscal_date") == F.col("_at")) & F.col("_income")).drop("_at", "_income")


def fundamentals(statements: DataFrame) -> DataFrame:
    """One row of named items for each ticker; a missing item is 0, and 0 gives way to the next label."""
    named = latest_items(statements).groupBy("ticker").agg(
        *[F.max(F.when((F.col("statement") == s) & (F.col("item") == label), F.col("value"))).alias(f"{name}_{i}") for s, name, labels in ITEMS for i, label in enumerate(labels)]
    )
    return named.select("ticker", *[(F.abs(v) if name in ("interest_expense", "capex") else v).alias(name) for _, name, labels in ITEMS for v in [first_truthy(*[f"{name}_{i}" for i in range(len(labels))])]])


def ratios(statements: DataFrame, info: DataFrame) -> DataFrame:
    """Fundamentals with the twelve ratios; a ratio whose base is not positive is NULL."""
    c = F.col
    out = fundamentals(statements).join(info.select("ticker", "longName", "grossMargins", "revenueGrowth"), "ticker", "left")
    out = out.withColumn("free_cash_flow", c("operating_cash_flow") - c("capex"))
    return out.withColumns(
        {
            "current_ratio": ratio(c("current_assets"), c("current_liabilities")),
            "debt_to_equity": ratio(c("total_liabilities"), c("total_equity")),
            "debt_to_assets": F.when(c("total_equity") > 0, ratio(c("total_liabilities"), c("total_assets"), 0.0)),
            "gross_margin": F.when(c("revenue") > 0, or_else("grossMargins", 0.0)),
            "operating_margin": ratio(c("operating_income"), c("revenue")),
            "net_margin": ratio(c("net_income"), c("revenue")),
            "return_on_equity": ratio(c("net_income"), c("total_equity")),
            "return_on_assets": ratio(c("net_income"), c("total_assets")),
            "interest_coverage": ratio(c("operating_income"), c("interest_expense")),
            "capex_coverage": ratio(c("operating_cash_flow"), c("capex")),
            "fcf_margin": ratio(c("free_cash_flow"), c("revenue"), 0.0),
        }
    )


def unpivoted(df: DataFrame) -> DataFrame:
    """(ticker, ratio_name, value) of the ratios that a ticker has."""
    return df.unpivot("ticker", RATIOS, "ratio_name", "value").where(F.col("value").isNotNull())


def with_score(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """health_score and health_status: the mean of 1, 1/2 or 0 for each benchmark whose ratio is there.

    Benchmarks find ratios by name inside the row, so no shuffle is needed; a name that no ratio has
    (``roe``) never scores unless ``aliases`` leads to one.
    """
    points = []
    for name, kind, bound, good in BENCHMARKS:
        name = (aliases or {}).get(name, name)
        if name in df.columns:
            v = F.col(name)
            reach = (lambda x, v=v: v >= x) if kind == "min" else (lambda x, v=v: v <= x)
            points.append(F.when(v.isNotNull(), F.when(reach(good), 1.0).when(reach(bound), 0.5).otherwise(0.0)))
    got = listed(*points)
    score = F.when(F.size(got) > 0, F.aggregate(got, F.lit(0.0), lambda a, x: a + x) / F.size(got)).otherwise(0.0)
    out = df.withColumn("health_score", score)
    s = F.col("health_score")
    return out.withColumn("health_status", F.when(s >= 0.8, "Excellent").when(s >= 0.6, "Good").when(s >= 0.4, "Fair").otherwise("Poor"))


def risks() -> Column:
    """Risk texts of a row of ratios; a missing ratio reads as 0."""
    cr, de, nm = or_else("current_ratio", 0.0), or_else("debt_to_equity", 0.0), or_else("net_margin", 0.0)
    return listed(
        F.when(cr < 1.0, "High liquidity risk (current ratio < 1.0)").when(cr < 1.5, "Moderate liquidity risk (current ratio < 1.5)"),
        F.when(de > 1.0, "High leverage risk (debt/equity > 1.0)").when(de > 0.5, "Moderate leverage risk (debt/equity > 0.5)"),
        said(nm < 0.05, "Low profitability (net margin < 5%)"),
        said(or_else("free_cash_flow", 0.0) < 0, "Negative free cash flow"),
        said(or_else("revenueGrowth", 0.0) < 0, "Declining revenue"),
    )


def advice() -> Column:
    """Advice texts of a scored row."""
    s = F.col("health_score")
    found = listed(
        F.when(s < 0.4, "Avoid - poor financial health").when(s < 0.6, "Caution - monitor closely"),
        said(or_else("current_ratio", 0.0) < 1.5, "Improve working capital management"),
        said(or_else("debt_to_equity", 0.0) > 0.5, "Reduce debt levels"),
        said(or_else("free_cash_flow", 0.0) > 0, "Strong cash flow generation"),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Financially healthy company")))


def health(statements: DataFrame, info: DataFrame) -> DataFrame:
    """Ratios, score, status, risks and advice of each ticker with statements."""
    out = with_score(ratios(statements, info))
    return out.withColumns({"risks": risks(), "recommendations": advice()})


def health_record(statements: DataFrame, info: DataFrame, as_of: date) -> DataFrame:
    """(ticker, health): the nested record."""
    record = F.struct(
        "ticker", F.coalesce("longName", "ticker").alias("company_name"), F.date_format(F.lit(as_of).cast("date"), "yyyy-MM-dd").alias("analysis_date"),
        F.struct(*RATIOS).alias("ratios"), "health_score", "health_status", "free_cash_flow", "revenue", "net_income", "total_equity", "total_assets", "risks", "recommendations",
    )
    return health(statements, info).select("ticker", record.alias("health"))
