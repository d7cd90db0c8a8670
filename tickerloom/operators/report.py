"""Reports: recommendation, rationale, risk assessment, the full record, comparison and text."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import fixed, listed, mentions, or_else, said
from .health import health_record
from .indicators import technical_record
from .valuation import valuation


# The sentences, labels and headings below are fixed values.


def _signals() -> Column:
    return F.coalesce(F.col("technical.signals"), F.array().cast("array<string>"))


def with_rationale(df: DataFrame, out: str = "rationale") -> DataFrame:
    status = F.coalesce(F.col("health.health_status"), F.lit(""))
    value = F.when(or_else(F.col("summary.is_undervalued"), False), "Stock appears undervalued based on multiple valuation methods.").otherwise("Stock appears fairly valued or overvalued.")
    health = (
        F.when(status == "Excellent", "Excellent financial health with strong fundamentals.")
        .when(status == "Good", "Good financial health with solid fundamentals.")
        .when(status == "Fair", "Fair financial health, monitor closely.")
        .otherwise("Poor financial health, significant risks present.")
    )
    technical = F.when(mentions(_signals(), "bullish") > 0, "Technical indicators show bullish momentum.").when(mentions(_signals(), "bearish") > 0, "Technical indicators show bearish momentum.")
    return df.withColumn(out, F.concat_ws(" ", value, health, technical))


def with_recommendation(df: DataFrame) -> DataFrame:
    """``df`` (structs summary, health, technical, any of them NULL) with struct ``recommendation``."""
    gain = or_else(F.col("summary.average_upside"), 0.0)
    value = F.when(or_else(F.col("summary.is_undervalued"), False), 40.0).when(gain > 10, 30.0).when(gain > 0, 20.0).otherwise(10.0)
    up, down = mentions(_signals(), "bullish"), mentions(_signals(), "bearish")
    technical = F.when(up > down, 20.0).when(down > up, 5.0).otherwise(12.0)
    out = with_rationale(df, "_why").withColumn("_score", (value + or_else(F.col("health.health_score"), 0.0) * 40 + technical) / 100.0 * 100)
    s = F.col("_score")
    levels = [(80, "STRONG BUY", "High"), (65, "BUY", "Medium"), (50, "HOLD", "Low"), (35, "SELL", "Medium")]
    word, trust = F.lit("STRONG SELL"), F.lit("High")
    for least, name, confidence in reversed(levels):
        word, trust = F.when(s >= least, name).otherwise(word), F.when(s >= least, confidence).otherwise(trust)
    record = F.struct(s.alias("score"), word.alias("recommendation"), trust.alias("confidence"), F.col("_why").alias("rationale"))
    return out.withColumn("recommendation", record).drop("_why", "_score")


def with_risks(df: DataFrame) -> DataFrame:
    """``df`` with struct ``risk``: levels, counts, total and overall risk. A missing cash-flow model counts as no cash flow."""
    found = F.coalesce(F.col("health.risks"), F.array().cast("array<string>"))
    severe = lambda r: r.contains("High") | r.contains("Negative")
    rsi = or_else(F.col("technical.indicators.rsi"), 50.0)
    high = F.concat(F.filter(found, severe), listed(said(or_else(F.col("dcf.fcf"), 0.0) <= 0, "Negative or zero free cash flow"), said(rsi > 80, "Extremely overbought (RSI > 80)")))
    medium = F.concat(
        F.filter(found, lambda r: ~severe(r) & r.contains("Moderate")),
        listed(said(or_else(F.col("dcf.growth_rate"), 0.0) > 0.15, "High growth assumptions in valuation"), said((rsi > 70) & ~(rsi > 80), "Overbought (RSI > 70)")),
    )
    low = F.filter(found, lambda r: ~severe(r) & ~r.contains("Moderate"))
    out = df.withColumns({"_h": high, "_m": medium, "_l": low})
    total = F.size("_h") + F.size("_m") + F.size("_l")
    record = F.struct(
        F.struct(F.col("_h").alias("high"), F.col("_m").alias("medium"), F.col("_l").alias("low")).alias("risk_levels"),
        F.struct(F.size("_h").alias("high"), F.size("_m").alias("medium"), F.size("_l").alias("low")).alias("risk_counts"),
        total.alias("total_risks"),
        F.when(F.size("_h") > 2, "High").when(total > 3, "Medium").otherwise("Low").alias("overall_risk"),
    )
    return out.withColumn("risk", record).drop("_h", "_m", "_l")


def reports(bars: DataFrame, statements: DataFrame, info: DataFrame, peers: DataFrame, as_of: date, group: str | None = None, period: str | None = "6mo") -> DataFrame:
    """The full report of every ticker of ``info``: valuation, health, technical, recommendation, risk.

    Sections are built once for all tickers and joined by ticker; a section that does not apply is NULL.
    ``period`` is the technical section's (None: all bars given, as after a scan of that period).
    """
    out = valuation(statements, info, peers, group)
    out = out.join(health_record(statements, info, as_of), "ticker", "left").join(technical_record(bars, period), "ticker", "left")
    out = with_risks(with_recommendation(out))
    section = F.struct("dcf", F.col("comps").alias("comparable_analysis"), F.col("graham").alias("graham_analysis"), "summary")
    return out.withColumn("valuation", section)


def comparison(full: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    """Seven columns of each (wanted) report."""
    rows = full.where(F.col("ticker").isin(tickers)) if tickers else full
    return rows.select(
        "ticker", or_else(F.col("summary.current_price"), 0.0).alias("current_price"), or_else(F.col("summary.average_fair_value"), 0.0).alias("fair_value"),
        or_else(F.col("summary.average_upside"), 0.0).alias("upside_pct"), or_else(F.col("health.health_score"), 0.0).alias("health_score"),
        F.col("recommendation.recommendation").alias("recommendation"), F.col("recommendation.score").alias("overall_score"),
    )


def ranked(compared: DataFrame) -> DataFrame:
    """Highest score first, then by ticker."""
    return compared.orderBy(F.desc("overall_score"), "ticker")


def report_text(full: DataFrame, generated: datetime) -> DataFrame:
    """(ticker, value): the readable summary."""
    number = lambda c, digits: fixed(or_else(F.col(c), 0.0), digits)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    line = lambda label, value, after="": F.concat(F.lit(label), value, F.lit(after))

    def titled(title: str, rule: str) -> list[Column]:
        return [F.lit(title), F.lit(rule * len(title))]

    lines = [
        *titled("STOCK ANALYSIS REPORT", "="), F.lit(""),
        line("Ticker: ", F.col("ticker")), line("Generated: ", F.lit(generated.strftime("%Y-%m-%d %H:%M:%S")), "\n"),
        line("RECOMMENDATION: ", text("recommendation.recommendation")), line("Confidence: ", text("recommendation.confidence")),
        line("Score: ", number("recommendation.score", 1), "/100\n"), line("Rationale: ", text("recommendation.rationale"), "\n"),
        *titled("VALUATION SUMMARY", "-"),
        line("Current Price: $", number("summary.current_price", 2)), line("Fair Value: $", number("summary.average_fair_value", 2)),
        line("Upside: ", number("summary.average_upside", 1), "%"), line("Undervalued: ", F.when(or_else(F.col("summary.is_undervalued"), False), "Yes").otherwise("No"), "\n"),
        *titled("FINANCIAL HEALTH", "-"),
        line("Score: ", number("health.health_score", 2), "/1.0"), line("Status: ", text("health.health_status"), "\n"),
        *titled("RISK ASSESSMENT", "-"),
        line("Overall Risk: ", text("risk.overall_risk")),
        *[line(f"{level.title()} Risks: ", F.col(f"risk.risk_counts.{level}").cast("string")) for level in ("high", "medium", "low")],
    ]
    return full.select("ticker", F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("value"))
