"""Filings: the ticker directory, filing dates in pages, and filing texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a filing date's cell.
DATE_CELL = r'<td nowrap="nowrap">(\d{4}-\d{2}-\d{2})</td>'
TEXT_CHARS = 5000
#: Fixed value: where filings are.
BASE_URL = "https://www.sec.gov"


def list_url(cik: str | Column, filing_type: str = "10-K", limit: int = 5) -> Column:
    """The address of a company's filing list, with its parameters."""
    number = F.col(cik) if isinstance(cik, str) else cik
    query = F.concat(F.lit("action=getcompany&CIK="), F.url_encode(number), F.lit("&type="), F.url_encode(F.lit(filing_type)), F.lit(f"&count={limit}"))
    return F.concat(F.lit(f"{BASE_URL}/cgi-bin/browse-edgar?"), query)


def text_url(cik: str | Column, filing_date: str | Column) -> Column:
    """The address of a filing's text: the number and the date without its dashes."""
    number, day = (F.col(c) if isinstance(c, str) else c for c in (cik, filing_date))
    return F.concat(F.lit(f"{BASE_URL}/Archives/edgar/data/"), number, F.lit("/"), F.replace(day, F.lit("-"), F.lit("")), F.lit("/"))


def filing_requests(tickers: DataFrame, directory: DataFrame, filing_type: str = "10-K", limit: int = 5) -> DataFrame:
    """(ticker, cik, filing_type, url) of the lists to fetch; tickers without a number are left out."""
    return cik_lookup(tickers, directory).select("ticker", "cik", F.lit(filing_type).alias("filing_type"), list_url("cik", filing_type, limit).alias("url"))


def fetched_filings(requests: DataFrame, responses: DataFrame, limit: int = 5) -> DataFrame:
    """Filings in the responses (url, status, html) to ``requests``; only a status of 200 counts."""
    pages = requests.join(responses.where("status = 200"), "url")
    return filing_dates(pages.select("ticker", "cik", "filing_type", "html"), limit=limit).withColumn("text_url", text_url("cik", "filing_date"))


def cik_directory(documents: DataFrame, column: str = "json") -> DataFrame:
    """(ticker, cik) from directory documents: a map of entries; ``cik_str`` counts before the entry's key."""
    entries = documents.select(F.posexplode(F.map_entries(F.from_json(column, "map<string,struct<cik_str:string,ticker:string,title:string>>"))).alias("pos", "e"))
    number = F.coalesce("e.value.cik_str", "e.key")
    padded = F.when(F.length(number) < 10, F.lpad(number, 10, "0")).otherwise(number)
    return entries.select("pos", F.col("e.value.ticker").alias("ticker"), padded.alias("cik"))


def cik_lookup(tickers: DataFrame, directory: DataFrame) -> DataFrame:
    """The first directory entry of each wanted ticker; tickers without one are left out."""
    first = directory.groupBy("ticker").agg(F.min_by("cik", "pos").alias("cik"))
    return tickers.select(F.upper("ticker").alias("ticker")).distinct().join(first, "ticker")


def filing_dates(pages: DataFrame, pattern: str = DATE_CELL, limit: int = 5, html: str = "html") -> DataFrame:
    """The first ``limit`` matches in each page, numbered from 1; other columns stay."""
    keep = [c for c in pages.columns if c != html]
    found = F.slice(F.regexp_extract_all(html, F.lit(pattern), 1), 1, limit)
    return pages.select(*keep, F.posexplode(found).alias("pos", "filing_date")).withColumn("sequence", F.col("pos") + 1).drop("pos")


def filing_list(pages: DataFrame, filing_type: str = "10-K", limit: int = 5) -> DataFrame:
    """Filings of pages keyed by ticker."""
    return filing_dates(pages.select("ticker", "html"), limit=limit).select("ticker", F.lit(filing_type).alias("filing_type"), "filing_date", "sequence")


def filing_text(pages: DataFrame, html: str = "html", chars: int = TEXT_CHARS) -> DataFrame:
    """Pages with their text cut to ``chars`` characters; a missing page is an empty text."""
    return pages.withColumn("text", F.coalesce(F.substring(html, 1, chars), F.lit(""))).drop(html)
