"""Stored tables: work folders, creation, appends, upserts that write, point lookups, the refresh of tickers."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from . import sinks
from .files import Files
from .market import COMPANIES, PRICES, RESULTS, company_scan

#: The stored tables and their columns.
SCHEMAS = {"companies": COMPANIES, "price_data": PRICES, "analysis_results": RESULTS}
#: Folders under a store's root besides the tables' own.
FOLDERS = ("reports", "logs", "data")

_made: list[str] = []
_local: dict[str, str] = {}


def _drop(spark: SparkSession, *paths: str) -> None:
    """Delete folders through the file system that holds them."""
    for path in paths:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be over; the folder belongs to the cluster
            return


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder the cluster names; removed when the driver ends.

    Without such a setting a temporary folder serves, but only where driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _local.setdefault(app, f"file://{tempfile.mkdtemp(prefix='tickerloom-')}")
    if not _made:
        atexit.register(lambda: _drop(spark, *_made))
    _made.append(f"{root.rstrip('/')}/tickerloom-market/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a small shared input once and read it back, so that the plans built on it do not repeat its scans."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Hash buckets of the company table: what an upsert replaces.
COMPANY_BUCKETS = 32
#: Buckets of a price store.
PRICE_BUCKETS = 32


def bucketed_prices(prices: DataFrame, name: str, buckets: int = PRICE_BUCKETS, path: str | None = None) -> DataFrame:
    """Append prices to a table that is bucketed by ticker and sorted by ticker and date, and read it.

    Windows and joins by ticker on it need no exchange, a filter on tickers reads their buckets only, and
    one shuffle pays for it when rows come in.
    """
    spark = prices.sparkSession
    rows = sinks.price_rows(prices).repartition(buckets, "ticker")
    write = rows.write.mode("append").format("parquet").bucketBy(buckets, "ticker").sortBy("ticker", "date")
    write = write if spark.catalog.tableExists(name) else write.option("path", path or work_path(spark, name))
    write.saveAsTable(name)
    return spark.table(name)


class Store:
    """The tables under one root folder.

    ``companies`` and ``indicator_state`` lie in hash buckets. Which folder holds a bucket is said by the newest numbered list in
    ``_versions``; an upsert writes the buckets it touches into a new folder and then adds a list, which is one
    rename. Until then, and if it never comes to that, readers see the old table. Folders that neither the
    newest list nor the one before names are removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)
        self.database: str | None = None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, database: str | None = None) -> None:
        """Make the folders, and each table if it does not exist; with a database, also as tables (companies: a view) for SQL."""
        for name in (*SCHEMAS, *FOLDERS):
            self.files.make(self.path(name))
        self.database = database
        if database:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
            for name, columns in SCHEMAS.items():
                if name != "companies":
                    self.spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet LOCATION '{self.path(name)}'")
            self._publish()

    def _versions(self, table: str) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(self.path(f"{table}/_versions")) if n.endswith(".json"))

    def _folders(self, table: str, version: int | None) -> dict[int, str]:
        """The folder of each bucket that holds rows."""
        return {int(k): v for k, v in json.loads(self.files.read(self.path(f"{table}/_versions/{version:08d}.json"))).items()} if version is not None else {}

    def _newest(self, table: str = "companies") -> dict[int, str]:
        return self._folders(table, next(reversed(self._versions(table)), None))

    def _switch(self, table: str, folders: dict[int, str]) -> None:
        """From now on these folders are the table."""
        old = self._versions(table)[-2:]
        self.files.make(self.path(f"{table}/_versions"))
        self.files.write_new(self.path(f"{table}/_versions/{old[-1] + 1 if old else 0:08d}.json"), json.dumps(folders))
        if len(old) == 2:
            gone = set(self._folders(table, old[0]).values()) - set(self._folders(table, old[1]).values()) - set(folders.values())
            for folder in gone:
                self.files.drop(self.path(f"{table}/{folder}"))
            self.files.drop(self.path(f"{table}/_versions/{old[0]:08d}.json"))

    def _parts(self, table: str, folders: dict[int, str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.path(f"{table}/{f}") for f in sorted(folders.values())])

    def _replace(self, table: str, keys: DataFrame, schema: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the buckets of ``keys``' tickers by ``change``, in a new folder, and switch to it."""
        before = self._newest(table)
        touched = [r.b for r in keys.select(_bucket(F.col("ticker")).alias("b")).distinct().collect()]  # as many as buckets at most
        if not touched:
            return
        after = change(self._parts(table, {k: before[k] for k in touched if k in before}, schema))
        folder = uuid.uuid4().hex
        after.withColumn("bucket", _bucket(F.col("ticker"))).repartition("bucket").write.partitionBy("bucket").parquet(self.path(f"{table}/{folder}"))
        self._switch(table, before | {k: f"{folder}/bucket={k}" for k in touched})

    def _publish(self) -> None:
        """The view for SQL names the newest folders."""
        if self.database:
            kept = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in COMPANIES.split(", "))
            none = ", ".join(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in COMPANIES.split(", "))
            found = [f"SELECT {kept} FROM parquet.`{self.path(f'companies/{f}')}`" for f in self._newest().values()]
            self.spark.sql(f"CREATE OR REPLACE VIEW `{self.database}`.companies AS {' UNION ALL '.join(found) or f'SELECT {none} WHERE false'}")

    def read(self, name: str) -> DataFrame:
        """A stored table; one that holds nothing yet is empty."""
        return self._parts("companies", self._newest(), COMPANIES) if name == "companies" else self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    def company(self, ticker: str) -> DataFrame:
        """The row of one ticker, if it is stored; only its bucket is read, and the ticker reaches the Parquet scan."""
        bucket = self.spark.range(1).select(_bucket(F.lit(ticker)).alias("b")).first().b
        return self._parts("companies", {k: f for k, f in self._newest().items() if k == bucket}, COMPANIES).where(F.col("ticker") == ticker).limit(1)

    def add_prices(self, prices: DataFrame) -> None:
        """Append price rows; ``sinks.latest_prices`` is the view without duplicates."""
        rows = sinks.price_rows(prices)
        kept = [F.col(c.split()[0]).cast(c.split()[1]) for c in PRICES.split(", ")]
        rows.select(*kept).write.mode("append").parquet(self.path("price_data"))

    def add_results(self, results: DataFrame) -> None:
        results.select(*[c.split()[0] for c in RESULTS.split(", ")]).write.mode("append").parquet(self.path("analysis_results"))

    def upsert(self, source: DataFrame, now: datetime) -> None:
        """Attributes of known tickers are replaced, new tickers are added; buckets without either keep their files.

        Rows without a ticker are left out. One upsert at a time: a second one that ends later finds its number taken.
        """
        source = written(source.where("ticker is not null"), "upsert")
        kept = [F.col(c.split()[0]).cast(c.split()[1]) for c in COMPANIES.split(", ")]
        self._replace("companies", source, COMPANIES, lambda target: sinks.upsert_companies(target, source, now).select(*kept))
        self._publish()

    def indicator_state(self) -> DataFrame:
        """One row a ticker; see ``operators.state``."""
        return self._parts("indicator_state", self._newest("indicator_state"), state.STATE)

    def refresh_indicators(self, bars: DataFrame) -> None:
        """Bring the indicator state forward by new bars; buckets without any keep their files."""
        bars = written(bars, "bars")
        self._replace("indicator_state", bars.where("ticker is not null"), state.STATE, lambda old: state.advanced(old, bars))

    def refresh(self, prices: DataFrame, info: DataFrame, now: datetime) -> None:
        """Fetched prices are appended and fetched company facts upserted; tickers without a price are left alone."""
        have = written(prices.select("ticker").distinct(), "refreshed")
        self.add_prices(prices)
        self.upsert(company_scan(info).join(have, "ticker", "left_semi"), now)


def _bucket(ticker: Column) -> Column:
    return F.pmod(F.hash(ticker), F.lit(COMPANY_BUCKETS))
