"""Matrix times vector in cells and the power iteration built on it; wedges of triangles; edges of Pregel loops."""

import random

import numpy as np
import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from edgewise.graph import Graph
from edgewise.plans import blocks
from edgewise.plans.iterate import StepCutter


@pytest.fixture
def tiny(monkeypatch):
    """Blocks, pieces and batches so small that a small graph has many of each."""
    monkeypatch.setattr(blocks, "SMALL", 8)
    monkeypatch.setattr(blocks, "PIECE", 16)


def edges_of(seed, n=60, m=400, hub=3):
    rng = random.Random(seed)
    es = [(rng.randrange(n), rng.randrange(n), float(rng.randint(1, 5))) for _ in range(m)]
    return es + [(hub, x, 1.0) for x in range(n)]


def test_cells_multiply_as_a_matrix_does(spark, tiny):
    es = edges_of(1)
    e = spark.createDataFrame(es, "src long, dst long, w double")
    cutter = StepCutter()
    try:
        places = blocks.numbered(cutter, spark.range(60), 60)
        assert places.select("_b").distinct().count() > 3
        cells = blocks.CellEdges(cutter, e, places, len(es))
        x = blocks.vectors(places.withColumn("x", F.col("id") * 0.5 + 1), "x")
        got = as_dict(blocks.values_of(cells.times(cells.times(x)), places))
    finally:
        cutter.close()
    a = np.zeros((60, 60))
    for s, d, w in es:
        a[d, s] += w
    want = a @ (a @ (np.arange(60) * 0.5 + 1))
    assert all(got.get(i, 0.0) == pytest.approx(want[i]) for i in range(60))


def test_random_start_does_not_depend_on_partitions(spark, tiny, monkeypatch):
    from edgewise.operators import communities
    seen = []
    told = communities.values_of

    def values(vecs, places):
        seen.append(as_dict(told(vecs, places)))
        return told(vecs, places)

    monkeypatch.setattr(communities, "values_of", values, raising=False)
    e = spark.createDataFrame(edges_of(2), "src long, dst long, w double")
    for parts in (1, 7):
        Graph.from_edges(e.repartition(parts)).power_iteration_clustering(3, 2)
    assert len(seen) == 2 and seen[0].keys() == seen[1].keys()
    assert all(seen[0][i] == pytest.approx(seen[1][i], rel=1e-9) for i in seen[0])
    # two steps of the row-normalised similarities, by numpy, from the same start
    a = np.zeros((60, 60))
    for s, d, _ in edges_of(2):
        if s != d:
            a[s, d] += 1.0
            a[d, s] += 1.0
    x = np.array([r[0] for r in spark.range(60).orderBy("id").select(communities._normal("id")).collect()])
    assert abs(x.mean()) < 0.6 and 0.5 < x.std() < 1.6
    for _ in range(2):
        x = a @ x / a.sum(axis=1)
    x /= np.abs(x).sum()
    assert all(seen[0][i] == pytest.approx(x[i], rel=1e-6, abs=1e-12) for i in range(60))


def test_bad_similarities_raise(spark):
    g = Graph.from_edges(spark.createDataFrame([(1, 2, -1.0), (2, 3, 1.0)], "src long, dst long, s double"))
    with pytest.raises(ValueError):
        g.power_iteration_clustering(2, 3, "s")


def test_triangles_form_wedges_at_the_first_vertex_only(spark):
    from edgewise.operators.triangles import oriented_edges, triangles_of
    rng = random.Random(5)
    es = {(rng.randrange(14), rng.randrange(14)) for _ in range(60)}
    o = oriented_edges(spark.createDataFrame(sorted(es), "src long, dst long"))
    und = {frozenset(e) for e in es if e[0] != e[1]}
    found = [frozenset(r) for r in triangles_of(o).collect()]
    want = {frozenset((a, b, c)) for a in range(14) for b in range(a) for c in range(b)
            if {frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= und}
    assert len(found) == len(set(found)) and set(found) == want


def test_pregel_runs_the_plan_of_its_edges_once(spark):
    from edgewise.operators.messages import Pregel
    seen = spark.sparkContext.accumulator(0)

    def tell(x):
        seen.add(1)
        return True

    e = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long").where(F.udf(tell, "boolean").asNondeterministic()("src"))
    g = Graph(spark.range(10), e)
    out = (g.pregel.set_max_iter(2).with_vertex_column("x", F.lit(1), F.coalesce(Pregel.msg(), F.lit(0)).cast("int"))
           .send_msg_to_dst(Pregel.src("x")).agg_msgs(F.sum(Pregel.msg())).run())
    assert {r.id: r.x for r in out.collect()} == {i: int(i > 1) for i in range(10)}
    assert seen.value == 9
