"""Technical indicators over bars (ticker, date, open, high, low, close, volume, adjusted_close).

All windows are ordered by date within a ticker, so every indicator shares one shuffle by ticker.
A value is NULL until its window is full. Bars are taken as they come; see ``latest_prices`` for
a view with one row a day.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.expr import full, listed, mentions, said
from ..sources.market import since

#: A block of the exponential average ends before (1 - alpha) ** -rows reaches e ** SPREAD.
SPREAD = 230.0
#: What has decayed by e ** -REACH no longer reaches a double.
REACH = 40.0


def ordered() -> WindowSpec:
    """Rows of a ticker by date; made when asked for, as it needs a session."""
    return Window.partitionBy("ticker").orderBy("date")


def last_rows(n: int) -> WindowSpec:
    return ordered().rowsBetween(-(n - 1), 0)


def sma(n: int, column: str = "close") -> Column:
    return full(F.avg(column).over(last_rows(n)), column, n, last_rows(n))


def change(column: str = "close") -> Column:
    return F.col(column) - F.lag(column).over(ordered())


def latest(df: DataFrame) -> DataFrame:
    """The last row of each ticker; aggregates before the shuffle."""
    rest = [c for c in df.columns if c not in ("ticker", "date")]
    return df.groupBy("ticker").agg(F.max_by(F.struct("date", *rest), "date").alias("row")).select("ticker", "row.*")


def with_rsi(bars: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """Relative strength over simple means; the first row's missing change counts as no change.

    Without losses the value is 100, and NULL if there were no gains either.
    """
    moved = bars.withColumn("_d", change())
    moved = moved.withColumns({"_up": F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0), "_down": F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)})
    moved = moved.withColumns({"_g": full(F.avg("_up").over(last_rows(n)), "_up", n, last_rows(n)), "_l": full(F.avg("_down").over(last_rows(n)), "_down", n, last_rows(n))})
    value = F.when(F.col("_l") > 0, 100 - 100 / (1 + F.col("_g") / F.col("_l"))).when((F.col("_l") == 0) & (F.col("_g") > 0), 100.0)
    return moved.withColumn(out, value).drop("_d", "_up", "_down", "_g", "_l")


def with_ema(bars: DataFrame, column: str, spans: dict[str, int]) -> DataFrame:
    """Exponential averages y = (1 - a) y' + a x with a = 2 / (span + 1), started at the first value.

    Each block of rows has a closed form (a running sum of x / (1 - a)^j, scaled back), and blocks
    are short enough that nothing overflows however long a ticker's history is. What a row inherits
    from earlier blocks decays by (1 - a) for each row; as many blocks are carried over as still
    reach a double (one, for spans up to some hundred).
    """
    out = bars.withColumn("_n", F.row_number().over(ordered()) - 1)
    before = ordered().rowsBetween(Window.unboundedPreceding, -1)
    block = Window.partitionBy("ticker", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    for name, span in spans.items():
        if span == 1:
            out = out.withColumn(name, F.col(column))
            continue
        a = 2 / (span + 1)
        keep = 1 - a
        rows = max(8, min(4096, int(SPREAD / -math.log(keep))))
        out = out.withColumns({"_b": F.floor(F.col("_n") / rows), "_j": (F.col("_n") % rows).cast("double")})
        part = F.when(F.col("_n") == 0, F.col(column)).otherwise(F.col(column) * a)
        out = out.withColumn("_own", F.sum(part * F.pow(F.lit(1 / keep), "_j")).over(block) * F.pow(F.lit(keep), "_j"))
        out = out.withColumn("_whole", F.col("_own"))
        for _ in range(math.ceil(REACH / (rows * -math.log(keep)))):
            # the average at the end of the block before, itself with what it inherits
            ends = F.when(F.col("_j") == rows - 1, F.col("_whole"))
            out = out.withColumn("_carry", F.coalesce(F.last(ends, ignorenulls=True).over(before), F.lit(0.0)))
            out = out.withColumn("_whole", F.col("_own") + F.col("_carry") * F.pow(F.lit(keep), F.col("_j") + 1))
        out = out.withColumn(name, F.col("_whole")).drop("_own", "_whole", "_carry", "_b", "_j")
    return out.drop("_n")


def with_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd (fast less slow average), macd_signal (average of that line) and macd_histogram."""
    line = with_ema(bars, "close", {"_fast": fast, "_slow": slow}).withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return with_ema(line, "macd", {"macd_signal": signal}).withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def with_bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    w = last_rows(n)
    middle, spread = F.avg("close").over(w), F.stddev_samp("close").over(w) * width
    return bars.withColumns({"bb_upper": full(middle + spread, "close", n, w), "bb_lower": full(middle - spread, "close", n, w)})


def with_volume(bars: DataFrame, n: int = 20) -> DataFrame:
    """volume_sma and volume_ratio; the ratio is 1 where the average is missing or not positive."""
    out = bars.withColumn("volume_sma", sma(n, "volume"))
    return out.withColumn("volume_ratio", F.when(F.col("volume_sma") > 0, F.col("volume") / F.col("volume_sma")).otherwise(1.0))


def with_momentum(bars: DataFrame) -> DataFrame:
    """Percent change over 1, 5 and 21 rows."""
    return bars.withColumns({name: (F.col("close") / F.lag("close", k).over(ordered()) - 1) * 100 for name, k in (("price_change_1d", 1), ("price_change_5d", 5), ("price_change_1mo", 21))})


def with_levels(bars: DataFrame, n: int = 20) -> DataFrame:
    """resistance and support: highest high and lowest low of the last n rows, the current one included."""
    w = last_rows(n)
    return bars.withColumns({"resistance": full(F.max("high").over(w), "high", n, w), "support": full(F.min("low").over(w), "low", n, w)})


def with_averages(bars: DataFrame, lengths: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    return bars.withColumns({f"sma_{n}": sma(n) for n in lengths})


def with_all(bars: DataFrame) -> DataFrame:
    """Every indicator at every bar."""
    counted = with_averages(bars).withColumn("n_bars", F.count("*").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    return with_macd(with_rsi(with_levels(with_momentum(with_volume(with_bollinger(counted))))))


def signals() -> Column:
    """The list of signals of a row of ``with_all``; a missing value never fires, but reads as bearish in either-or signals."""
    close = F.col("close")
    found = listed(
        F.when(close > F.col("sma_20"), "Price above 20-day MA (bullish)").otherwise("Price below 20-day MA (bearish)"),
        said((F.col("sma_20") > F.col("sma_50")) & (F.col("sma_50") > F.col("sma_200")), "All MAs in bullish alignment"),
        F.when(F.col("rsi") > 70, "RSI > 70 (overbought)").when(F.col("rsi") < 30, "RSI < 30 (oversold)").otherwise("RSI neutral"),
        F.when(F.col("macd") > F.col("macd_signal"), "MACD bullish").otherwise("MACD bearish"),
        said(F.col("volume_ratio") > 1.5, "High volume (significant move)"),
        F.when(close > F.col("resistance") * 0.98, "Near resistance level").when(close < F.col("support") * 1.02, "Near support level"),
    )

    def with_bias(items: Column) -> Column:
        up, down = mentions(items, "bullish"), mentions(items, "bearish")
        bias = F.when(up > down, "Bullish").when(down > up, "Bearish").otherwise("Neutral")
        return F.concat(items, F.array(F.concat(F.lit("Overall bias: "), bias)))

    return F.transform(F.array(found), with_bias)[0]


def _ema_weight(span: int) -> Column:
    """What the close ``_k`` bars back weighs in the last exponential average; the first of all bars starts it."""
    keep = 1 - 2 / (span + 1)
    return F.pow(F.lit(keep), F.col("_k")) * F.when(F.col("_first"), 1.0).otherwise(1 - keep)


def _signal_weight(span: int, signal: int = 9) -> Column:
    """The same for the average of averages: the sum of both weights' products over the bars from that one to the last."""
    keep, after = 1 - 2 / (span + 1), 1 - 2 / (signal + 1)
    spread = (F.pow(F.lit(keep), F.col("_k") + 1) - F.pow(F.lit(after), F.col("_k") + 1)) / (keep - after)
    return spread * (1 - after) * F.when(F.col("_first"), 1.0).otherwise(1 - keep)


def last_analysis(bars: DataFrame) -> DataFrame:
    """The last row of each ticker in ``with_all``, without the rows before it.

    Bars are numbered from the last one back, in one sort of the bars alone; one aggregate then adds up what each bar
    contributes. Averages over a history have closed weights, so all bars count and none is carried along. Both
    averages of a line weigh 1 in all, so closes count as distances from the last one, and a flat history gives 0.
    """
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    rows = bars.withColumns({"_k": F.row_number().over(back) - 1, "_before": F.lead("close").over(back), "_first": F.lead(F.lit(1)).over(back).isNull(), "_last": F.coalesce(F.first("close").over(back.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))})
    rows = rows.withColumn("_d", F.col("close") - F.col("_before"))
    rows = rows.withColumns({"_up": F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0), "_down": F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)})
    k = F.col("_k")

    def at(n: int, c: str) -> Column:
        return F.max(F.when(k == n, F.col(c)))

    def rolled(f, c: str, n: int) -> Column:
        inside = F.when(k < n, F.col(c))
        return F.when(F.count(inside) == n, f(inside))

    def line(weight) -> Column:
        return F.sum((F.coalesce("close", F.lit(0.0)) - F.col("_last")) * (weight(12) - weight(26)))

    found = rows.groupBy("ticker").agg(
        *[at(0, c).alias(c) for c in bars.columns if c != "ticker"],
        F.count("*").alias("n_bars"),
        *[rolled(F.avg, "close", n).alias(f"sma_{n}") for n in (20, 50, 200)],
        rolled(F.stddev_samp, "close", 20).alias("_spread"),
        rolled(F.avg, "volume", 20).alias("volume_sma"),
        *[((at(0, "close") / at(n, "close") - 1) * 100).alias(name) for name, n in (("price_change_1d", 1), ("price_change_5d", 5), ("price_change_1mo", 21))],
        rolled(F.max, "high", 20).alias("resistance"),
        rolled(F.min, "low", 20).alias("support"),
        rolled(F.avg, "_up", 14).alias("_g"),
        rolled(F.avg, "_down", 14).alias("_l"),
        line(_ema_weight).alias("macd"),
        line(_signal_weight).alias("macd_signal"),
    )
    found = found.withColumns(
        {
            "bb_upper": F.col("sma_20") + F.col("_spread") * 2,
            "bb_lower": F.col("sma_20") - F.col("_spread") * 2,
            "volume_ratio": F.when(F.col("volume_sma") > 0, F.col("volume") / F.col("volume_sma")).otherwise(1.0),
            "rsi": F.when(F.col("_l") > 0, 100 - 100 / (1 + F.col("_g") / F.col("_l"))).when((F.col("_l") == 0) & (F.col("_g") > 0), 100.0),
            "macd_histogram": F.col("macd") - F.col("macd_signal"),
        }
    )
    return found.drop("_spread", "_g", "_l")


def technical(bars: DataFrame, min_bars: int = 22, period: str | None = "6mo") -> DataFrame:
    """The analysis of each ticker's last bar over the trailing ``period`` (None: all bars given).

    Tickers with fewer than ``min_bars`` bars have none. A scan that already ends at the period needs no second one.
    """
    bars = since(bars, period) if period else bars
    return last_analysis(bars).where(F.col("n_bars") >= min_bars).withColumn("signals", signals())


def technical_record(bars: DataFrame, period: str | None = "6mo") -> DataFrame:
    """(ticker, technical): the nested record of an analysis."""
    names = ["rsi", "macd", "macd_signal", "macd_histogram", "bb_upper", "bb_lower", "volume_sma", F.col("volume").alias("current_volume"), "volume_ratio", "price_change_1d", "price_change_5d", "price_change_1mo", "resistance", "support"]
    record = F.struct(
        "ticker",
        F.col("close").alias("current_price"),
        F.struct(*names).alias("indicators"),
        "signals",
        F.struct("high", "low", "open", "volume").alias("price_data"),
        F.struct("sma_20", "sma_50", "sma_200").alias("moving_averages"),
    )
    return technical(bars, period=period).select("ticker", record.alias("technical"))
