"""What a query's final plan has broadcast: tables of an axis, a row or column of the grid each, and never pixels."""

import pytest

from rasterloom import queries

DATA = "/root/testdata/sf0.001"


def broadcast_rows(df):
    """Rows of each broadcast of the plan that ran."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    found = []

    def walk(node):
        if node.nodeName() == "BroadcastExchange":
            found.append(node.metrics().apply("numOutputRows").value())
        if "QueryStage" in node.nodeName():
            walk(node.plan())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    plan = run.executedPlan()
    walk(plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return found


@pytest.mark.parametrize("name", ["combined_stats_labelled", "combined_stats_long", "combined_stats_with_zero"])
def test_no_pixels_are_broadcast(spark, name):
    """By the size of their file, pixels of the combined_stats_ queries looked small: at 60 times sf0.1 the driver's 1 GB of heap couldn't hold the 4.8 to 6 million rows."""
    r = queries.fine(spark, DATA)
    most = max(r.grid.nx, r.grid.ny)
    assert most < r.pixels.count() / 5
    found = broadcast_rows(queries.QUERIES[name](spark, DATA))
    assert found and max(found) <= most
