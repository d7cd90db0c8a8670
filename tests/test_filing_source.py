"""The filing source against the plain search, with type, status and count answered in the scan."""

import pytest
from pyspark.sql import functions as F

from tickerloom.sources import filing_source, filings


def page(n):
    return "".join(f'<td nowrap="nowrap">2020-{m:02d}-01</td>' for m in range(1, n + 1))


PAGES = [
    (1, "https://a/list?CIK=1&type=10-K&count=5", 200, page(8)),
    (2, "https://a/list?CIK=2&type=8-K%2FA", 200, page(2)),
    (3, "https://a/list?type=10-K", 500, page(3)),
    (4, "https://a/list", 200, page(1)),
    (5, "https://a/list?type=10-K", 200, None),
    (6, "https://a/list?type=10-K", 200, ""),
    (None, None, None, page(2)),
    (1, "https://a/list?CIK=1&type=10-K&count=5", 200, page(8)),
    (8, "https://a/list?type=10-Q", 200, "x" * 200_000 + page(4)),
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = spark.createDataFrame(PAGES, "id long, url string, status int, html string").withColumn("filing_date", F.lit("clash"))
    path = f"file://{tmp_path_factory.mktemp('pages')}/t"
    rows.repartition(3).write.parquet(path)
    return path


def plain(spark, stored):
    pages = spark.read.parquet(stored).drop("filing_date")
    kind = F.url_decode(F.nullif(F.regexp_extract("url", "type=([^&]*)", 1), F.lit("")))
    return filings.filing_dates(pages.withColumn("filing_type", kind), limit=1000)


COLUMNS = ["id", "url", "status", "filing_type", "filing_date", "sequence"]
CASES = [
    ({}, "true"),
    ({"filing_type": "10-K", "status": 200, "count": 5}, "filing_type = '10-K' AND status = 200 AND sequence <= 5"),
    ({"filing_type": "8-K/A"}, "filing_type = '8-K/A'"),
    ({"status": 500}, "status = 500"),
    ({"status": 200, "count": 1}, "status = 200 AND sequence = 1"),
    ({"filing_type": "none"}, "false"),
    ({"count": 0}, "false"),
]


@pytest.mark.parametrize(("asked", "where"), CASES)
def test_requests(spark, stored, asked, where):
    got = filing_source.responses(spark, stored, **asked, key="id").select(*COLUMNS)
    want = plain(spark, stored).where(where).select(*COLUMNS)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_one_load_serves_several_filters(spark, stored):
    found = filing_source.responses(spark, stored, key="id")
    whole = found.count()
    assert found.where("status = 200").union(found.where("status <> 200 OR status IS NULL")).count() == whole == found.count()


def test_row_groups_are_read_once(spark, tmp_path):
    """Tasks share a file by ranges; each row group belongs to one of them."""
    rows = spark.range(2000).select("id", F.concat(F.lit("https://a/l?type=T"), F.col("id") % 7).alias("url"), F.lit(page(1)).alias("html"))
    path = f"file://{tmp_path}/t"
    rows.repartition(1).write.option("parquet.block.size", 4096).option("parquet.block.size.row.check.min", 10).parquet(path)
    found = filing_source.responses(spark, path, key="id", split_bytes="5000")
    assert found.rdd.getNumPartitions() > 2
    assert found.count() == 2000 and found.where("status = 200").count() == 2000
    asked = filing_source.responses(spark, path, "T3", 200, key="id", split_bytes="5000")
    assert sorted(r.id for r in asked.collect()) == list(range(3, 2000, 7))


def test_empty_and_missing(spark, tmp_path):
    spark.createDataFrame([], "url string, html string").write.parquet(f"file://{tmp_path}/none")
    assert filing_source.responses(spark, f"file://{tmp_path}/none").collect() == []
    with pytest.raises(Exception, match="FileNotFound|does not exist"):
        filing_source.responses(spark, f"file://{tmp_path}/absent").collect()
