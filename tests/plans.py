"""What Spark planned while something ran."""

import re


def plans(spark, run) -> list[str]:
    """The physical plans, as they were in the end, of the queries that run() starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = {x.executionId() for x in _all(store)}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return [x.physicalPlanDescription() for x in _all(store) if x.executionId() not in before]


def _all(store):
    found = store.executionsList()
    return [found.apply(i) for i in range(found.size())]


def broadcasts(spark, run) -> list[str]:
    found = plans(spark, run)
    assert any("Exchange" in p for p in found), "no plans were seen"
    return [p for p in found if "BroadcastExchange" in p]


def most_joins(spark, run) -> int:
    """Merged joins of the plan with the most of them."""
    return max(len(re.findall(r"\(\d+\) SortMergeJoin", p)) for p in plans(spark, run))
