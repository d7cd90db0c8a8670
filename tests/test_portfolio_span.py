"""Portfolio queries over all bars: what lies before the last year counts."""

import shutil

import duckdb
import pytest

from tickerloom.plans import queries as Q

WHOLE = ["mean_returns", "cov_matrix", "max_sharpe", "min_volatility", "diversification_ratio", "stock_metrics", "equal_weight_portfolio", "custom_weight_portfolio", "portfolio_returns", "drawdown_series", "portfolio_metrics"]


@pytest.fixture(scope="module")
def last_year(sf_dir, tmp_path_factory):
    """The tables without the order lines of the weeks before the trailing 365 days."""
    folder = tmp_path_factory.mktemp("last_year")
    week = "date_trunc('week', l_shipdate)"
    duckdb.sql(f"COPY (SELECT * FROM '{sf_dir}/lineitem.parquet' WHERE {week} >= (SELECT max({week}) FROM '{sf_dir}/lineitem.parquet') - INTERVAL 365 DAY) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    shutil.copy(f"{sf_dir}/supplier.parquet", folder)
    return str(folder)


@pytest.mark.parametrize("name", WHOLE)
def test_earlier_bars_count(spark, sf_dir, last_year, name):
    whole, part = ([tuple(r) for r in Q.QUERIES[name](spark, d).collect()] for d in (sf_dir, last_year))
    assert whole and part and sorted(map(repr, whole)) != sorted(map(repr, part))
