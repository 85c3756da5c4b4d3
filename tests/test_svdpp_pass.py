"""SVD++ reads the ratings with both ends' values once for the steps of users and items."""

import re

from edgewise.graph import Graph
from edgewise.plans.iterate import StepCutter


def test_users_and_items_are_summed_in_one_pass_over_the_ratings(spark, monkeypatch):
    plans = []
    cut = StepCutter.cut

    def told(self, df, *a, **kw):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(self, df, *a, **kw)

    monkeypatch.setattr(StepCutter, "cut", told)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = spark.createDataFrame([(1, -1, 4.0), (1, -2, 2.0), (2, -1, 5.0), (3, -2, None)], "src bigint, dst bigint, weight double")
        out, mu = Graph.from_edges(e).svd_plus_plus(rank=2, max_iter=1)
        rows = {r["id"]: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # laid out by user and by item, each read once
    assert max(len(re.findall(r"InMemoryRelation \[src#\d+L?, dst#\d+L?, r#", p)) for p in plans) <= 2
    assert abs(mu - 11 / 3) < 1e-9 and len(rows) == 5
    assert rows[3]["column3"] is None and all(rows[i]["column3"] is not None for i in (1, 2, -1, -2))
