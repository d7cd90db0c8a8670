"""The indicators of a state row read each array a few times, not once for every element of another."""

from tickerloom.operators import state


def test_lambdas_do_not_nest(spark):
    plan = state.indicators(spark.createDataFrame([], state.STATE))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") <= 20
