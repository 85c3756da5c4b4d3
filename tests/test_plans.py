"""Plan-shape checks: pruning reaches the scan, loop steps reuse the edge layout."""

from conftest import SMOKE, make_graph
from edgewise import queries
from edgewise.plans import iterate


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(queries.QUERIES["validate_requests"](spark, SMOKE))
    scan = [line for line in plan.splitlines() if "orders.parquet" in line or "ReadSchema" in line]
    text = " ".join(scan)
    assert "o_totalprice" not in text and "o_orderkey" in text


def test_pagerank_step_joins_cached_edges_without_shuffling_them(spark, monkeypatch):
    plans = []
    orig = iterate.StepCutter.cut

    def spy(self, df, metrics=None, reliable=False):
        plans.append(_plan(df))
        return orig(self, df, metrics, reliable)

    monkeypatch.setattr(iterate.StepCutter, "cut", spy)
    g = make_graph(spark, [(i, (i * 7 + 1) % 50) for i in range(50)])
    g.page_rank(max_iter=2).vertices.count()
    step = [p for p in plans if "_w" in p and "sum" in p][0]
    assert "InMemoryTableScan" in step and "BroadcastHashJoin" in step
    assert step.count("Exchange hashpartitioning") == 1  # only the partial sums move
