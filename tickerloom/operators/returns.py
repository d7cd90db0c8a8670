"""Returns of price histories, aligned over a set of tickers, their means and covariances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.code import shipped

#: Tickers of a block of returns, as hashing deals them; a block of a chunk of days is what a task holds.
BLOCK_TICKERS = 256
#: Calendar days of a chunk.
CHUNK_DAYS = 512


def ordered() -> WindowSpec:
    """Rows of a ticker by date; made when asked for, as it needs a session."""
    return Window.partitionBy("ticker").orderBy("date")


def _calendar(prices: DataFrame) -> DataFrame:
    """One row: all dates in order; as many as days have passed."""
    return prices.select("date").distinct().agg(F.sort_array(F.collect_list("date")).alias("dates"))


def daily_returns(prices: DataFrame, column: str = "close") -> DataFrame:
    """(ticker, date, ret) on the union of all dates: a gap keeps the last price, so it returns 0.

    A price is valid from its date to the next one's. The window runs over the rows that are given; only what
    comes out is filled up to the calendar, so nothing larger than the input is shuffled. Dates up to a
    ticker's first price have a NULL return.
    """
    known = prices.select("ticker", "date", F.col(column).alias("p")).where(F.col("p").isNotNull())
    spans = known.select("ticker", "date", (F.col("p") / F.lag("p").over(ordered()) - 1).alias("ret"), F.lag("date").over(ordered()).isNull().alias("first"), F.lead("date").over(ordered()).alias("until"))
    # a ticker without any price is on the calendar too
    silent = prices.groupBy("ticker").agg(F.count(column).alias("n")).where("n = 0").select("ticker", F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("ret"), F.lit(True).alias("first"), F.lit(None).cast("date").alias("until"))
    spans = spans.unionByName(silent).crossJoin(F.broadcast(_calendar(prices)))
    day = lambda d: F.struct(d.alias("date"), F.when(d == F.col("date"), F.col("ret")).when(d > F.col("date"), F.lit(0.0)).alias("ret"))
    valid = F.filter("dates", lambda d: (F.col("first") | (d >= F.col("date"))) & (F.col("until").isNull() | (d < F.col("until"))))
    return spans.select("ticker", F.inline(F.transform(valid, day)))


def aligned_returns(prices: DataFrame, column: str = "close") -> DataFrame:
    """Returns on the dates on which every ticker has one: those after the latest of all first prices."""
    first = prices.groupBy("ticker").agg(F.min(F.when(F.col(column).isNotNull(), F.col("date"))).alias("first"))
    since = first.agg(F.max("first").alias("since"), F.count_if(F.col("first").isNull()).alias("silent"))
    returns = daily_returns(prices, column).crossJoin(F.broadcast(since))  # one row
    return returns.where((F.col("silent") == 0) & (F.col("date") > F.col("since"))).select("ticker", "date", "ret")


def mean_returns(returns: DataFrame) -> DataFrame:
    return returns.groupBy("ticker").agg(F.avg("ret").alias("mean_return"))


def blocked(rows: DataFrame, value: str, n_tickers: int) -> DataFrame:
    """(block, chunk, tickers, days, x): dense blocks of a value by ticker and date, one row a block and chunk of days."""
    blocks = max(1, -(-n_tickers // BLOCK_TICKERS))
    placed = rows.select(F.pmod(F.hash("ticker"), F.lit(blocks)).alias("block"), F.floor(F.unix_date("date") / CHUNK_DAYS).alias("chunk"), "ticker", F.unix_date("date").alias("day"), F.col(value).alias("x"))
    lines = placed.groupBy("block", "chunk", "ticker").agg(F.sort_array(F.collect_list(F.struct("day", "x"))).alias("d"))
    lines = lines.groupBy("block", "chunk").agg(F.sort_array(F.collect_list(F.struct("ticker", F.col("d.x").alias("x")))).alias("t"), F.max("d.day").alias("days"))
    return lines.select("block", "chunk", F.col("t.ticker").alias("tickers"), "days", F.flatten(F.col("t.x")).alias("x"))


def matrix(row: dict) -> np.ndarray:
    """Tickers x days."""
    return np.array(row["x"], float).reshape(len(row["tickers"]), -1)


def covariance(returns: DataFrame) -> DataFrame:
    """(ticker_i, ticker_j, cov): sample covariances of every pair of tickers, of returns that are aligned.

    Deviations from the means lie in blocks of tickers and days. Each block meets each other one once, by chunk
    of days; the products of two blocks come out as sums over the chunk's days, and are added up by pair of
    tickers. No row stands for a pair and a day.
    """
    shipped(returns.sparkSession)
    facts = returns.agg(F.count_distinct("ticker").alias("tickers"), F.count_distinct("date").alias("days")).first()
    blocks = max(1, -(-facts.tickers // BLOCK_TICKERS))
    centred = returns.join(mean_returns(returns), "ticker").select("ticker", "date", (F.col("ret") - F.col("mean_return")).alias("x"))
    rows = blocked(centred, "x", facts.tickers)
    others = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    paired = rows.select("*", F.inline(others))

    def products(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {row["block"]: (row["tickers"], matrix(row)) for b in batches for row in b.to_pylist()}
        i, j = key[0].as_py(), key[1].as_py()
        if i not in sides or j not in sides:
            return
        (names, x), (others, y) = sides[i], sides[j]
        sums = x @ y.T
        for k, name in enumerate(names):
            out = [pa.array([name] * len(others)), pa.array(others), pa.array(sums[k])]
            yield pa.RecordBatch.from_arrays(out, names=["ticker_i", "ticker_j", "s"])
            if i != j:
                yield pa.RecordBatch.from_arrays([out[1], out[0], out[2]], names=["ticker_i", "ticker_j", "s"])

    summed = paired.groupBy("i", "j", "chunk").applyInArrow(_whole(products), "ticker_i string, ticker_j string, s double")
    n = facts.days
    return summed.groupBy("ticker_i", "ticker_j").agg((F.sum("s") / (n - 1) if n > 1 else F.lit(None).cast("double")).alias("cov"))


def _whole(by_batch):
    """A function of a group's key and batches as one of its key and table."""

    def run(key, table):
        out = list(by_batch(key, iter(table.to_batches())))
        return pa.Table.from_batches(out) if out else pa.table({"ticker_i": pa.array([], pa.string()), "ticker_j": pa.array([], pa.string()), "s": pa.array([], pa.float64())})

    return run
