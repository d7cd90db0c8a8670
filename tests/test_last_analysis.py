"""The last bar's analysis in one sort, against the indicators of every bar."""

import pandas as pd
import pytest

from tickerloom.operators import indicators as I
from tests.test_indicators import walk

pytestmark = pytest.mark.filterwarnings("ignore")


def test_equals_the_last_row_of_all_indicators(spark):
    lengths = (1, 2, 14, 19, 20, 22, 27, 60, 200, 1300)
    bars = spark.createDataFrame(pd.concat([walk(k, n, f"N{n}") for k, n in enumerate(lengths)]))
    got = {r.ticker: r.asDict() for r in I.last_analysis(bars).collect()}
    want = {r.ticker: r.asDict() for r in I.latest(I.with_all(bars)).collect()}
    assert sorted(got) == sorted(want) == sorted(f"N{n}" for n in lengths)
    for t, row in want.items():
        assert set(row) == set(got[t])
        for c, x in row.items():
            assert got[t][c] == (pytest.approx(x, rel=1e-9, abs=1e-9) if isinstance(x, float) else x), (t, c)


def test_signals_sort_the_bars_once(spark):
    plan = I.technical(spark.createDataFrame(walk(1, 30, "A")), period=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
