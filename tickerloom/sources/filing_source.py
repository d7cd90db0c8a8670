"""Stored filing lists as a data source: type, status and count of a request are answered in its scan.

``responses`` reads a Parquet file or folder of fetched pages (url, html and, where there is one,
status) and gives a row for each filing date in a page. ``filing_type`` and ``status`` are tested
before a page's text is read: a row group without a wanted page is passed over on its short columns
alone. ``count`` ends the search in a page once it is reached.

The three are options of a load and not filters that Spark pushes: in Spark 4.1 what was pushed
to a Python source seems to stay with the load: a second, unfiltered query on the same DataFrame lost rows.

A task takes the row groups that begin in its range of a file's bytes, so planning lists files and
opens none, and a task holds one small batch of pages. Files are read through Arrow's file systems
(local or mounted folders, S3, GCS, HDFS); a view of Hadoop's is resolved first. For other stores,
read the table with Spark and use ``filings.filing_dates``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import unquote_plus

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .filings import DATE_CELL
from .files import Files

NAME = "filings"
#: Fixed value: where a list's address names the type.
TYPE_PARAMETER = r"[?&]type=([^&#]*)"
#: Bytes of a file that one task takes, pages read at once, and rows given out at once.
SPLIT_BYTES = 64 << 20
PAGES = 64
ROWS = 4096


@dataclass
class FileRange(InputPartition):
    path: str
    low: int
    high: int


class FilingReader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema):
        self.options, self.schema = options, schema
        self.filing_type = options.get("filing_type")
        self.status, self.count = (int(options[k]) if k in options else None for k in ("status", "count"))

    def partitions(self) -> list[FileRange]:
        system, root = fs.FileSystem.from_uri(self.options["path"])
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in found if i.is_file and not re.search(r"/[_.][^/]*$", i.path))
        split = int(self.options.get("split_bytes", SPLIT_BYTES))
        return [FileRange(p, low, low + split) for p, size in files for low in range(0, size, split)]

    def _type(self, url: str | None) -> str | None:
        found = re.search(self.options.get("type_pattern", TYPE_PARAMETER), url or "")
        return unquote_plus(found[1]) if found else None

    def read(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.options["path"])
        with pq.ParquetFile(system.open_input_file(part.path)) as file:
            short = [c for c in ("url", "status") if c in file.schema_arrow.names]
            keys = [self.options["key"]] if "key" in self.options else []
            for g in range(file.num_row_groups):
                first = file.metadata.row_group(g).column(0)
                if not part.low <= min(first.data_page_offset, first.dictionary_page_offset or first.data_page_offset) < part.high:
                    continue
                if not any(self._wanted(r) for b in file.iter_batches(ROWS, [g], short) for r in b.to_pylist()):
                    continue
                for pages in file.iter_batches(PAGES, [g], [*keys, *short, "html"]):
                    yield from self._rows(pages)

    def _wanted(self, page: dict) -> bool:
        """Whether the short columns let a page pass; without a status among them, that is left open."""
        right_type = self.filing_type is None or self._type(page["url"]) == self.filing_type
        return right_type and (self.status is None or page.get("status", self.status) == self.status)

    def _rows(self, pages: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pattern, rows = re.compile(self.options.get("pattern", DATE_CELL)), []
        for page in pages.to_pylist():
            html = page.pop("html")
            page.setdefault("status", 404 if html is None else 200)
            if not self._wanted(page):
                continue
            page["filing_type"] = self._type(page["url"])
            for i, match in enumerate(islice(pattern.finditer(html or ""), self.count), 1):
                rows.append({**page, "filing_date": match[1], "sequence": i})
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_pylist(rows, self.schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.schema)


class FilingSource(DataSource):
    """Options: path; filing_type, status and count; pattern and type_pattern (group 1 counts); key, a long column to carry along; split_bytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        key = f"`{self.options['key']}` long, " if "key" in self.options else ""
        return f"{key}url string, status int, filing_type string, filing_date string, sequence int"

    def reader(self, schema) -> FilingReader:
        types = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
        return FilingReader(dict(self.options), pa.schema([(f.name, types[f.dataType.simpleString()]) for f in schema]))


def responses(spark: SparkSession, path: str, filing_type: str | None = None, status: int | None = None, count: int | None = None, **options: str) -> DataFrame:
    """(key,) url, status, filing_type, filing_date, sequence of the pages stored at ``path``.

    Only pages of a type and status, and the first ``count`` filings of each, where these are given.
    Defined results: a page without a status column counts as 200, or as 404 where its html is null; a
    null or empty page has no rows; an address without a type has a null type, which is no type asked
    for; repeated pages give their rows each; other columns are not read; an empty table gives none.
    """
    asked = {k: str(v) for k, v in {"filing_type": filing_type, "status": status, "count": count}.items() if v is not None}
    spark.dataSource.register(FilingSource)
    return spark.read.format(NAME).options(path=Files(spark, path).resolved(path), **asked, **options).load()
