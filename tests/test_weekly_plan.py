"""Weekly bars of many tickers: no task sorts a whole split of the order lines."""

from tickerloom.plans import queries as Q


def test_lines_are_dealt_before_they_are_sorted(spark, sf_dir):
    for name in ("technical_signals", "technical_record"):
        plan = Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Sort [" in plan and "Sort [" not in plan.rsplit("Exchange", 1)[1], name
