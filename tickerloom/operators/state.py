"""Indicators kept as one state row a ticker, brought forward by new bars without the old ones.

A row holds the last ``KEPT`` bars, how many there were, and the running exponential averages; every indicator of
the last bar follows from it. A refresh shuffles the new bars and the state rows of their tickers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bars that the longest window looks back on.
KEPT = 200
_BAR = "struct<date:date,open:double,high:double,low:double,close:double,volume:bigint>"
STATE = f"ticker string, n_bars bigint, bars array<{_BAR}>, ema_12 double, ema_26 double, macd_signal double"
#: Columns of ``indicators``, all doubles but the first two and the volume.
INDICATORS = ["sma_20", "sma_50", "sma_200", "bb_upper", "bb_lower", "volume_sma", "volume_ratio", "price_change_1d", "price_change_5d", "price_change_1mo", "resistance", "support", "rsi", "macd", "macd_signal", "macd_histogram"]


def advanced(state: DataFrame, bars: DataFrame) -> DataFrame:
    """The state after ``bars`` (ticker, date, open, high, low, close, volume), for the tickers of either.

    Bars up to a ticker's last kept date have been taken in before and are left out, so a refresh may overlap or come
    twice; of new bars of one day the one that orders last counts. Bars without a date or close are left out.
    """
    bar = F.struct("date", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("bigint").alias("volume"))
    days = bars.where("ticker is not null and date is not null and close is not null").groupBy("ticker", "date").agg(F.max(bar).alias("bar"))
    fresh = days.groupBy("ticker").agg(F.sort_array(F.collect_list("bar")).alias("fresh"))
    both = state.join(fresh, "ticker", "full")
    none = F.array().cast(f"array<{_BAR}>")
    both = both.withColumn("bars", F.coalesce("bars", none)).withColumn("_last", F.array_max(F.transform("bars", lambda b: b["date"])))
    both = both.withColumn("fresh", F.filter(F.coalesce("fresh", none), lambda b: F.col("_last").isNull() | (b["date"] > F.col("_last"))))
    start = F.struct(F.coalesce("n_bars", F.lit(0)).cast("bigint").alias("n"), F.col("ema_12").alias("a"), F.col("ema_26").alias("b"), F.col("macd_signal").alias("s"))

    def step(old: Column, bar: Column) -> Column:
        moved = lambda y, x, span: F.when(old["n"] == 0, x).otherwise(y + (x - y) * (2 / (span + 1)))
        a, b = moved(old["a"], bar["close"], 12), moved(old["b"], bar["close"], 26)
        return F.struct((old["n"] + 1).alias("n"), a.alias("a"), b.alias("b"), moved(old["s"], a - b, 9).alias("s"))

    both = both.withColumn("_x", F.aggregate("fresh", start, step)).withColumn("bars", F.concat("bars", "fresh"))
    kept = F.when(F.size("bars") > KEPT, F.slice("bars", F.size("bars") - (KEPT - 1), KEPT)).otherwise(F.col("bars"))
    return both.select("ticker", F.col("_x.n").alias("n_bars"), kept.alias("bars"), F.col("_x.a").alias("ema_12"), F.col("_x.b").alias("ema_26"), F.col("_x.s").alias("macd_signal"))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def indicators(state: DataFrame) -> DataFrame:
    """The indicators of each ticker's last bar, as the full computation over all bars gives them; a value is NULL until its window is full.

    Each array is cut out once and each sum taken once, in a select of its own: what a lambda or several columns read is
    a column by then, not an expression that is worked out again for every element.
    """
    n = F.col("n_bars")
    last = F.element_at("bars", -1)

    def tail(c: str, k: int) -> Column:
        return F.slice(F.col("bars")[c], F.greatest(F.lit(1), F.size("bars") - (k - 1)), F.lit(k))

    def windowed(value: Column, k: int) -> Column:
        return F.when(n >= k, value)

    def back(k: int) -> Column:
        return F.when(n > k, (F.col("close") / F.try_element_at("bars", -F.lit(k + 1))["close"] - 1) * 100)

    def side(sign: float) -> Column:
        return F.aggregate("_moves", F.lit(0.0), lambda s, x: s + F.greatest(x * sign, F.lit(0.0))) / 14

    cut = state.where(F.size("bars") > 0).select(
        "ticker", last["date"].alias("date"), last["close"].alias("close"), last["volume"].alias("_volume"), "n_bars", "bars", "ema_12", "ema_26", "macd_signal",
        *[tail("close", k).alias(f"_c{k}") for k in (15, 20, 50, 200)], tail("volume", 20).cast("array<double>").alias("_v"), tail("high", 20).alias("_h"), tail("low", 20).alias("_w"),
    )
    moves = F.zip_with(F.slice("_c15", F.lit(2), F.lit(14)), F.slice("_c15", F.lit(1), F.size("_c15") - 1), lambda x, y: x - y)
    means = cut.select(
        "*", *[(_sum(F.col(f"_c{k}")) / F.size(f"_c{k}")).alias(f"_m{k}") for k in (20, 50, 200)], (_sum(F.col("_v")) / F.size("_v")).alias("_vm"), moves.alias("_moves"),
    )
    # the first of all bars has no change, which counts as none
    sides = means.select(
        "*", F.sqrt(F.aggregate("_c20", F.lit(0.0), lambda s, x: s + (x - F.col("_m20")) * (x - F.col("_m20"))) / 19).alias("_sd"),
        side(1.0).alias("_gain"), side(-1.0).alias("_loss"), windowed(F.col("_vm"), 20).alias("volume_sma"),
    )
    out = sides.select(
        "ticker", "date", "close", "n_bars", *[windowed(F.col(f"_m{k}"), k).alias(f"sma_{k}") for k in (20, 50, 200)],
        windowed(F.col("_m20") + F.col("_sd") * 2, 20).alias("bb_upper"), windowed(F.col("_m20") - F.col("_sd") * 2, 20).alias("bb_lower"), "volume_sma", F.when(F.col("volume_sma") > 0, F.col("_volume") / F.col("volume_sma")).otherwise(1.0).alias("volume_ratio"),
        back(1).alias("price_change_1d"), back(5).alias("price_change_5d"), back(21).alias("price_change_1mo"),
        windowed(F.array_max("_h"), 20).alias("resistance"), windowed(F.array_min("_w"), 20).alias("support"),
        windowed(F.when(F.col("_loss") > 0, 100 - 100 / (1 + F.col("_gain") / F.col("_loss"))).when((F.col("_loss") == 0) & (F.col("_gain") > 0), 100.0), 14).alias("rsi"), (F.col("ema_12") - F.col("ema_26")).alias("macd"), "macd_signal",
    )
    return out.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
