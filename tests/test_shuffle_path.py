"""What iterative operators and motifs move when nothing is small enough to be broadcast."""

from contextlib import contextmanager

import pytest
from conftest import make_graph

from edgewise.operators import pagerank
from edgewise.plans import fixtures as fx
from edgewise.plans.iterate import StepCutter


@contextmanager
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lattice_parts_are_dealt_before_they_make_edges(spark, tmp_path):
    (spark.createDataFrame([(i,) for i in range(40)], "p_partkey bigint").coalesce(1)
     .write.parquet(str(tmp_path / "part.parquet")))
    edges = fx.part_lattices(spark, str(tmp_path)).edges
    plan = _plan(edges)
    assert "REPARTITION_BY_NUM" in plan[plan.index("Generate"):]
    want = sorted((a, a + 3 * j) for a in range(40) for j in range(1, fx.LATTICE_REACH[a % 3] + 1) if a + 3 * j < 40)
    assert sorted(map(tuple, edges.select("src", "dst").collect())) == want


def test_matches_are_not_sorted_to_meet_the_edges_that_exclude_them(spark):
    pairs = sorted({(i % 7, (i * 5 + 1) % 11) for i in range(60)} | {((i * 5 + 1) % 11, i % 7) for i in range(0, 60, 4)})
    with no_broadcast(spark):
        found = make_graph(spark, pairs).find("(a)-[]->(b); (b)-[]->(c); !(c)-[]->(a)")
        plan = _plan(found)
        got = sorted((r.a.id, r.b.id, r.c.id) for r in found.collect())
    assert "ShuffledHashJoin" in plan and "LeftAnti" in plan[plan.index("ShuffledHashJoin"):].splitlines()[0]
    assert got == sorted((a, b, c) for a, b in pairs for b2, c in pairs if b2 == b and (c, a) not in pairs)


@pytest.mark.parametrize("broadcast", [True, False])
def test_pagerank_deals_its_edges_once_and_without_weights(spark, monkeypatch, broadcast):
    laid = []

    class Spy(pagerank.KeyedEdges):
        def __init__(self, edges, *args, **kw):
            laid.append(edges.columns)
            super().__init__(edges, *args, **kw)

    monkeypatch.setattr(pagerank, "KeyedEdges", Spy)
    pairs = [(1, 2), (1, 2), (2, 3), (3, 1), (3, 4), (11, 12), (12, 11)]

    def ranks():
        g = make_graph(spark, pairs)
        one = g.page_rank(max_iter=3, source_id=1).vertices.collect()
        many = g.parallel_personalized_page_rank(source_ids=[1], max_iter=3).collect()
        return {r.id: r.pagerank for r in one}, {r.id: r.pagerank for r in many}

    if broadcast:
        one, many = ranks()
    else:
        with no_broadcast(spark):
            one, many = ranks()
    assert laid == [["src", "dst"]] * 2
    rank = {v: 0.0 for e in pairs for v in e} | {1: 1.0}
    for _ in range(3):
        new = {v: 0.15 if v == 1 else 0.0 for v in rank}
        for a, b in pairs:
            new[b] += 0.85 * rank[a] / sum(s == a for s, _ in pairs)
        rank = new
    total = sum(rank.values())
    assert one == pytest.approx({v: r / total for v, r in rank.items()})
    assert many == pytest.approx({v: r / total for v, r in rank.items() if r})


def test_labels_between_two_hops_are_made_once(spark, monkeypatch):
    kept = []
    keep = StepCutter.keep
    monkeypatch.setattr(StepCutter, "keep", lambda self, df: kept.append(df.columns) or keep(self, df))
    pairs = [(1, 2), (2, 3), (3, 1), (3, 1), (3, 4), (5, 5), (4, 6), (6, 4)]
    got = {r.id: r.component for r in make_graph(spark, pairs).strongly_connected_components().collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 4}
    assert ["id", "_in", "_out", "_fell"] in kept
