"""Physical plans of every registered query keep the shapes that scale: no
cartesian or nested-loop joins, no Python evaluation, and no grouped
aggregate that sorts its input (string min/max buffers force SortAggregate,
which sorts every input row on the map side)."""
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
# fits and streams plan inside Spark ML or a streaming query, not one DataFrame
SKIP = {"compare_models", "random_search", "final_fit", "score_stream"}
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas"]
GROUPED_SORT_AGG = re.compile(r"SortAggregate\(key=\[[^\]]")


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SKIP))
def test_plan_shapes(spark, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in FORBIDDEN if p in plan], plan
    assert not GROUPED_SORT_AGG.search(plan), plan
