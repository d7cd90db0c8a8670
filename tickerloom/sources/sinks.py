"""Sinks: price appends and their deduplicated view, the company upsert, reports and results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import date, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import shipped
from .files import Files, arrow_reaches, arrow_uri, partition_value
from .market import RESULTS

PRICE_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "volume", "adjusted_close"]


def price_rows(prices: DataFrame) -> DataFrame:
    """Rows for the price table; a missing adjusted close (or column) falls back to the close."""
    adjusted = F.coalesce("adjusted_close", "close") if "adjusted_close" in prices.columns else F.col("close")
    return prices.withColumn("adjusted_close", adjusted).select(*PRICE_COLUMNS)


def append_prices(prices: DataFrame, path: str) -> None:
    """Append, partitioned by ticker; appending again duplicates rows, which ``latest_prices`` undoes."""
    price_rows(prices).repartition("ticker").write.mode("append").partitionBy("ticker").parquet(path)


def latest_prices(prices: DataFrame) -> DataFrame:
    """One row for each ticker and date: the one that orders last."""
    rest = [c for c in PRICE_COLUMNS if c not in ("ticker", "date")]
    kept = prices.groupBy("ticker", "date").agg(F.max(F.struct(*rest)).alias("row"))
    return kept.select("ticker", "date", "row.*")


def upsert_companies(target: DataFrame, source: DataFrame, now) -> DataFrame:
    """Target after the upsert: attributes from the source where it has the ticker; last_updated is set on insert only."""
    fields = ["name", "sector", "industry", "country", "market_cap"]
    t, s = target.alias("t"), source.alias("s")
    both = t.join(s, F.col("t.ticker") == F.col("s.ticker"), "full")
    return both.select(
        F.coalesce("t.ticker", "s.ticker").alias("ticker"),
        *[F.when(F.col("s.ticker").isNotNull(), F.col(f"s.{f}")).otherwise(F.col(f"t.{f}")).alias(f) for f in fields],
        F.when(F.col("t.ticker").isNotNull(), F.col("t.last_updated")).otherwise(F.lit(now)).alias("last_updated"),
    )


#: Fixed value: the stamp in report file names.
STAMP = "%Y%m%d_%H%M%S"


def report_document(generated: datetime) -> Column:
    """The report of a row of ``reports`` as one nested record; a section that does not apply is left out of its JSON."""
    sections = F.struct("valuation", F.col("health").alias("financial_health"), F.col("technical").alias("technical_analysis"))
    return F.struct(
        "ticker",
        F.lit(generated.strftime("%Y-%m-%d %H:%M:%S")).alias("generated_date"),
        sections.alias("sections"),
        F.col("recommendation").alias("investment_recommendation"),
        F.col("risk").alias("risk_assessment"),
    )


def report_file(generated: datetime, suffix: str = "json") -> Column:
    """The file name of a ticker's report."""
    return F.concat(F.coalesce("ticker", F.lit("unknown")), F.lit(f"_analysis_{generated.strftime(STAMP)}.{suffix}"))


def report_json(reports: DataFrame, generated: datetime) -> DataFrame:
    """(ticker, file, value): each report as a JSON document under its file name."""
    return reports.select("ticker", report_file(generated).alias("file"), F.to_json(report_document(generated)).alias("value"))


def portfolio_json(result: DataFrame, generated: datetime) -> DataFrame:
    """(file, value): a portfolio result, the frontier's arrays included, as a JSON document."""
    fields = ["tickers", "current_portfolio", "optimized_portfolios", "stock_metrics", "diversification_ratio", "efficient_frontier"]
    return result.select(F.lit(f"portfolio_{generated.strftime(STAMP)}.json").alias("file"), F.to_json(F.struct(*fields)).alias("value"))


def write_documents(documents: DataFrame, folder: str) -> None:
    """Write rows (file, value) as files of exactly these names in ``folder``.

    Tasks write each document into a staging folder of their attempt and say where; Spark's own commit keeps what
    successful attempts said, whatever had to be tried again. Only then each document gets its name, by a rename, in
    tasks too. A run that ends early leaves a hidden folder and can be repeated. Rows with one name are lines of one file.
    Stores that Arrow's file systems do not reach are written by Spark's writer and renamed by the driver.
    """
    spark = documents.sparkSession
    files, staging = Files(spark, folder), f"{folder}/_staging-{uuid.uuid4().hex}"
    # a named count, as few bytes would be merged into one task, but each document costs a task some milliseconds
    named = documents.where("file is not null").select("file", "value").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    files.make(staging)
    if arrow_reaches(staging):
        _write_in_tasks(named, folder, staging)
    else:
        files.drop(staging)
        _write_by_driver(named, folder, staging, files)
    files.drop(staging)


def _write_in_tasks(named: DataFrame, folder: str, staging: str) -> None:
    spark = named.sparkSession
    shipped(spark)
    home, stage = arrow_uri(folder), arrow_uri(staging)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(stage)
        attempt, name, out = f"task-{TaskContext.get().taskAttemptId()}", None, None
        store.create_dir(f"{root}/{attempt}")
        n = 0
        for batch in batches:
            begun = []
            for file, value in zip(batch["file"].to_pylist(), batch["value"].to_pylist(), strict=True):
                if file != name:
                    if out:
                        out.close()
                    name, n = file, n + 1
                    begun.append((file, f"{attempt}/{n}"))
                    out = store.open_output_stream(f"{root}/{attempt}/{n}")
                out.write((value or "").encode() + b"\n")
            yield pa.record_batch([pa.array([f for f, _ in begun], pa.string()), pa.array([s for _, s in begun], pa.string())], names=["file", "staged"])
        if out:
            out.close()

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(stage)
        _, target = fs.FileSystem.from_uri(home)
        for batch in batches:
            for file, staged in zip(batch["file"].to_pylist(), batch["staged"].to_pylist(), strict=True):
                try:
                    _remove_checksum(store, f"{target}/.{file}.crc")
                    store.move(f"{root}/{staged}", f"{target}/{file}")
                except FileNotFoundError:
                    # an attempt before this one has moved it
                    if store.get_file_info(f"{target}/{file}").type != fs.FileType.File:
                        raise
            yield batch.slice(0, 0)

    schema = "file string, staged string"
    named.sortWithinPartitions("file").mapInArrow(put, schema).write.parquet(f"{staging}/_names")
    spark.read.schema(schema).parquet(f"{staging}/_names").mapInArrow(rename, schema).write.format("noop").mode("overwrite").save()


def _remove_checksum(store: fs.FileSystem, name: str) -> None:
    """What Hadoop's local file system wrote beside an older document of the name does not fit the new one."""
    if store.type_name == "local" and store.get_file_info(name).type == fs.FileType.File:
        store.delete_file(name)


def _write_by_driver(named: DataFrame, folder: str, staging: str, files: Files) -> None:
    named.write.partitionBy("file").option("maxRecordsPerFile", 0).text(staging)
    for name in files.names(staging):
        if name.startswith("file="):
            (part,) = [x for x in files.names(f"{staging}/{name}") if x.startswith("part-")]
            files.move(f"{staging}/{name}/{part}", f"{folder}/{partition_value(name)}")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(file, value) of the documents in a folder, each whole."""
    return spark.read.option("wholetext", True).text(folder).select(F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("file"), F.rtrim("value", F.lit("\n")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write column ``value`` as text."""
    lines.select("value").write.mode("overwrite").text(path)


def analysis_results(reports: DataFrame, as_of: date) -> DataFrame:
    """Rows of the results table: one for each section of a report."""
    def part(kind: str, data, score, recommendation):
        return F.struct(F.lit(kind).alias("analysis_type"), data.alias("result_data"), score.cast("double").alias("score"), recommendation.cast("string").alias("recommendation"))

    null = F.lit(None)
    parts = F.array(
        part("valuation", F.to_json("valuation"), null, null),
        part("health", F.to_json("health"), F.col("health.health_score"), null),
        part("technical", F.to_json("technical"), null, null),
        part("recommendation", F.to_json("recommendation"), F.col("recommendation.score"), F.col("recommendation.recommendation")),
    )
    rows = reports.select("ticker", F.lit(as_of).cast("date").alias("analysis_date"), F.inline(parts)).where(F.col("result_data").isNotNull())
    return rows.select(*[c.split()[0] for c in RESULTS.split(", ")])


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").partitionBy("analysis_type").parquet(path)
