"""The edge layout of iterative operators is made once, whatever is released between supersteps."""

import pytest
from pyspark.sql import functions as F

from edgewise.plans.iterate import StepCutter
from edgewise.plans.skew import KeyedEdges


@pytest.mark.parametrize("least, salted", [(2, True), (100, False)])
def test_a_step_neither_counts_hot_keys_nor_sorts_edges_again(spark, least, salted):
    edges = [(1, i) for i in range(2, 12)] + [(i, 1) for i in range(2, 12)]
    cutter = StepCutter(4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e, n = cutter.inputs(spark.createDataFrame(edges, "src bigint, dst bigint"))
        layout = KeyedEdges(e, "src", "dst", cutter=cutter, total_edges=n, min_hot_degree=least).persist(cutter)
        state, _ = cutter.cut(e.select(F.col("dst").alias("id")).distinct(), reliable=True)  # releases the steps before
        sent = layout.attach(state, "id")
        plan = sent._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert (layout.hot is not None) == salted
        left = plan[plan.index("SortMergeJoin"):plan.index("InMemoryTableScan")]
        assert "Sort [" not in left and "Exchange" not in left
        assert not [x for x in (layout.hot, state) if x is not None and "Aggregate" in x._jdf.queryExecution().optimizedPlan().toString()]
        assert sorted(map(tuple, sent.select("src", "dst").collect())) == sorted(edges)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        cutter.close()
