"""Graph operators on hand-made micro graphs, checked against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from brute import (components, distances_to, label_propagation, pagerank, strong_components,
                   triangles)
from conftest import as_dict, make_graph
from edgewise.graph import Graph


def rand_graph(seed, n=25, m=70):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
    return list(range(n)), edges


# ---- structure -----------------------------------------------------------------

def test_degrees_count_self_loop_twice_and_omit_zero(spark):
    g = make_graph(spark, [(1, 1), (1, 2), (1, 2)], vertices=[1, 2, 3])
    assert as_dict(g.degrees) == {1: 4, 2: 2}
    assert as_dict(g.in_degrees) == {1: 1, 2: 2}
    assert as_dict(g.out_degrees) == {1: 3}


def test_from_edges_and_drop_isolated(spark):
    g = make_graph(spark, [(1, 2), (2, 3)], vertices=[1, 2, 3, 4])
    assert sorted(r.id for r in g.drop_isolated_vertices().vertices.collect()) == [1, 2, 3]
    assert sorted(r.id for r in Graph.from_edges(g.edges).vertices.collect()) == [1, 2, 3]


def test_filter_vertices_removes_touching_edges(spark):
    g = make_graph(spark, [(1, 2), (2, 3), (3, 1)], vertices=[1, 2, 3])
    f = g.filter_vertices(F.col("id") != 2)
    assert sorted((r.src, r.dst) for r in f.edges.collect()) == [(3, 1)]
    assert g.filter_edges("src < dst").edges.count() == 2


def test_triplets_drop_edges_to_missing_vertex(spark):
    g = make_graph(spark, [(1, 2), (2, 9)], vertices=[1, 2])
    t = g.triplets.collect()
    assert [(r.src.id, r.edge.dst, r.dst.id) for r in t] == [(1, 2, 2)]


def test_graph_requires_columns(spark):
    v = spark.createDataFrame([(1,)], "x bigint")
    e = spark.createDataFrame([(1, 2)], "src bigint, dst bigint")
    with pytest.raises(ValueError):
        Graph(v, e)


# ---- PageRank ------------------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_pagerank_matches_power_iteration(spark, seed):
    vs, es = rand_graph(seed)
    g = make_graph(spark, es, vertices=vs)
    got = as_dict(g.page_rank(max_iter=7).vertices.select("id", "pagerank"))
    want = pagerank(vs, es, iters=7)
    assert got.keys() == want.keys()
    for v in vs:
        assert got[v] == pytest.approx(want[v], rel=1e-9, abs=1e-12)
    assert sum(got.values()) == pytest.approx(len(vs))


def test_personalized_pagerank_sums_to_one(spark):
    vs, es = rand_graph(3)
    g = make_graph(spark, es, vertices=vs)
    got = as_dict(g.page_rank(max_iter=6, source_id=0).vertices.select("id", "pagerank"))
    want = pagerank(vs, es, iters=6, source=0)
    for v in vs:
        assert got[v] == pytest.approx(want[v], abs=1e-12)
    par = g.parallel_personalized_page_rank(source_ids=[0, 1], max_iter=6)
    p0 = {r.id: r.pagerank for r in par.where("source = 0").collect()}
    for v, x in want.items():
        assert p0.get(v, 0.0) == pytest.approx(x, abs=1e-12)


def test_pagerank_tolerance_and_argument_check(spark):
    vs, es = rand_graph(4)
    g = make_graph(spark, es, vertices=vs)
    r = g.page_rank(tol=1e-9).vertices
    assert r.count() == len(vs)
    with pytest.raises(ValueError):
        g.page_rank()
    with pytest.raises(ValueError):
        g.page_rank(max_iter=3, tol=0.1)


def test_pagerank_edge_weight_and_dangling(spark):
    g = make_graph(spark, [(1, 2), (1, 3), (2, 3)], vertices=[1, 2, 3, 4])
    res = g.page_rank(max_iter=3)
    w = {(r.src, r.dst): r.weight for r in res.edges.collect()}
    assert w == {(1, 2): 0.5, (1, 3): 0.5, (2, 3): 1.0}
    assert sum(as_dict(res.vertices.select("id", "pagerank")).values()) == pytest.approx(4.0)


# ---- paths -------------------------------------------------------------------------------

def test_shortest_paths_chain_of_50(spark):
    from edgewise.operators.paths import distances_map
    es = [(i, i + 1) for i in range(49)]
    g = make_graph(spark, es)
    sp = g.shortest_paths([49, 10])
    d = {(r.id, r.landmark): r.distance for r in sp.collect()}
    assert d[(0, 49)] == 49 and d[(10, 10)] == 0 and (11, 10) not in d
    m = {r.id: r.distances for r in distances_map(g, sp).collect()}
    assert m[49] == {49: 0} and m[5] == {10: 5, 49: 44}


def test_shortest_paths_random_vs_bfs(spark):
    vs, es = rand_graph(5)
    g = make_graph(spark, es, vertices=vs)
    got = {(r.id, r.landmark): r.distance for r in g.shortest_paths([0, 3]).collect()}
    want = {(v, lm): d for lm in (0, 3) for v, d in distances_to(vs, es, lm).items()}
    assert got == want


def test_shortest_paths_string_ids(spark):
    g = make_graph(spark, [("a", "b"), ("b", "c")], id_type="string")
    got = {(r.id, r.landmark): r.distance for r in g.shortest_paths(["c"]).collect()}
    assert got == {("c", "c"): 0, ("b", "c"): 1, ("a", "c"): 2}


def test_bfs_all_shortest_paths(spark):
    from edgewise.operators.paths import bfs_paths
    es = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 5), (5, 6)]
    g = make_graph(spark, es)
    p = bfs_paths(g, "id = 1", "id = 6").collect()
    assert sorted(r.path for r in p) == ["1,5,6"]
    p = bfs_paths(g, "id = 1", "id = 4").collect()
    assert sorted(r.path for r in p) == ["1,2,4", "1,3,4"] and {r.length for r in p} == {2}
    p = bfs_paths(g, "id = 1", "id = 1").collect()
    assert [(r.path, r.length) for r in p] == [("1", 0)]
    assert bfs_paths(g, "id = 6", "id = 1").count() == 0
    assert bfs_paths(g, "id = 1", "id = 6", max_path_length=1).count() == 0
    wide = g.bfs("id = 1", "id = 4")
    assert wide.columns == ["from", "e0", "v1", "e1", "to"]


def test_bfs_edge_filter(spark):
    from edgewise.operators.paths import bfs_paths
    g = make_graph(spark, [(1, 2), (2, 3), (1, 3)])
    p = bfs_paths(g, "id = 1", "id = 3", edge_filter="NOT (src = 1 AND dst = 3)").collect()
    assert [r.path for r in p] == ["1,2,3"]


# ---- triangles ----------------------------------------------------------------------------

def test_two_disjoint_triangles_with_noise(spark):
    es = [(1, 2), (2, 3), (3, 1), (1, 2), (2, 1), (4, 5), (5, 6), (6, 4), (6, 6), (7, 4)]
    g = make_graph(spark, es)
    got = as_dict(g.triangle_count().select("id", "count"))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0}


@pytest.mark.parametrize("seed", [6, 7])
def test_triangles_random_vs_brute(spark, seed):
    vs, es = rand_graph(seed, n=20, m=90)
    g = make_graph(spark, es, vertices=vs)
    assert as_dict(g.triangle_count().select("id", "count")) == triangles(vs, es)


def test_triangles_star_hub(spark):
    es = [(0, i) for i in range(1, 1001)] + [(1, 2), (3, 4)]
    g = make_graph(spark, es)
    got = as_dict(g.triangle_count().select("id", "count"))
    assert got[0] == 2 and got[1] == 1 and got[5] == 0 and sum(got.values()) == 6


# ---- components and communities ----------------------------------------------------------------

def test_connected_components_chain_and_isolated(spark):
    es = [(i + 1, i) for i in range(49)]
    g = make_graph(spark, es, vertices=list(range(50)) + [100])
    got = as_dict(g.connected_components().select("id", "component"))
    assert set(got[i] for i in range(50)) == {0} and got[100] == 100


@pytest.mark.parametrize("seed", [8, 9])
def test_components_random_vs_brute(spark, seed):
    vs, es = rand_graph(seed, n=40, m=35)
    g = make_graph(spark, es, vertices=vs)
    assert as_dict(g.connected_components().select("id", "component")) == components(vs, es)
    assert as_dict(g.strongly_connected_components().select("id", "component")) == \
        strong_components(vs, es)


def test_scc_refines_cc_and_string_ids(spark):
    es = [("b", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "x")]
    g = make_graph(spark, es, id_type="string")
    scc = as_dict(g.strongly_connected_components().select("id", "component"))
    assert scc == {"a": "a", "b": "a", "c": "c", "d": "c", "x": "x"}
    cc = as_dict(g.connected_components().select("id", "component"))
    assert cc == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x"}


@pytest.mark.parametrize("seed", [10, 11])
def test_label_propagation_vs_brute(spark, seed):
    vs, es = rand_graph(seed, n=30, m=45)
    g = make_graph(spark, es, vertices=vs)
    got = as_dict(g.label_propagation(4).select("id", "label"))
    assert got == label_propagation(vs, es, 4)


def test_label_propagation_tie_goes_to_smallest(spark):
    g = make_graph(spark, [(1, 5), (2, 5)], vertices=[1, 2, 5, 9])
    got = as_dict(g.label_propagation(1).select("id", "label"))
    assert got == {1: 5, 2: 5, 5: 1, 9: 9}


def test_power_iteration_clustering_two_blocks(spark):
    es = [(a, b) for a in range(5) for b in range(a + 1, 5)] + \
         [(a, b) for a in range(10, 15) for b in range(a + 1, 15)] + [(4, 10)]
    g = make_graph(spark, es)
    got = as_dict(g.power_iteration_clustering(2, 20).select("id", "cluster"))
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(11, 15)}) == 1
    assert got[0] != got[12]


def test_graph_persist_checkpoint_roundtrip(spark):
    g = make_graph(spark, [(1, 2), (2, 3)])
    p = g.persist()
    assert p.vertices.is_cached and p.edges.is_cached
    p.unpersist()
    c = g.checkpoint()
    assert c.vertices.count() == 3 and c.edges.count() == 2
    assert "ExistingRDD" in c.edges._jdf.queryExecution().executedPlan().toString()


def test_camel_case_calls(spark):
    from brute import components as cc_brute
    vs, es = rand_graph(12, n=30, m=30)
    g = make_graph(spark, es, vertices=vs)
    want = cc_brute(vs, es)
    assert as_dict(g.connectedComponents(algorithm="min_label").select("id", "component")) == want
    assert as_dict(g.connectedComponents().select("id", "component")) == want
    pr = as_dict(g.pageRank(resetProbability=0.15, maxIter=3).vertices.select("id", "pagerank"))
    assert sum(pr.values()) == pytest.approx(len(vs))
    sp = {r.id: r.distances for r in g.shortestPaths(landmarks=[0]).collect()}
    assert sp[0] == {0: 0} and len(sp) == len(vs)
    assert g.triangleCount().count() == len(vs)
    assert g.inDegrees.count() > 0 and g.dropIsolatedVertices().vertices.count() <= len(vs)


def test_limits_are_not_silent(spark):
    """A lower limit raises; converged ranks do not depend on one; unknown sources raise."""
    import pytest
    two_cycles = make_graph(spark, [(4, 3), (3, 4), (1, 2), (2, 1), (1, 3)])
    assert as_dict(two_cycles.strongly_connected_components()) == {1: 1, 2: 1, 3: 3, 4: 3}
    with pytest.raises(RuntimeError, match="no component"):
        two_cycles.strongly_connected_components(max_iter=1)
    with pytest.raises(ValueError, match="not a vertex"):
        two_cycles.page_rank(source_id=99, max_iter=2)


def test_call_spellings_and_ids(spark):
    import pytest
    from edgewise.graph import Graph
    g = make_graph(spark, [(1, 2), (2, 3)])
    assert Graph.fromEdges(g.edges).vertices.count() == 3
    assert g.bfs(fromExpr="id = 1", toExpr="id = 3", maxPathLength=4).columns == ["from", "e0", "v1", "e1", "to"]
    none = g.bfs(fromExpr="id = 3", toExpr="id = 1")
    assert none.count() == 0 and none.schema["from"].dataType["id"].dataType.typeName() == "long"
    assert set(as_dict(g.connectedComponents(algorithm="graphframes", broadcastThreshold=10), value="component").values()) == {1}
    with pytest.raises(ValueError, match="different types"):
        Graph(spark.createDataFrame([("1",)], "id string"), g.edges)
    null_end = spark.createDataFrame([(1, 2), (2, None)], "src long, dst long")
    assert Graph.from_edges(null_end).vertices.count() == 2
    twice = Graph(spark.createDataFrame([(1,), (1,), (2,)], "id long"), spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert twice.page_rank(max_iter=2).vertices.count() == 2


def test_parallel_ranks_as_vectors(spark):
    g = make_graph(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    got = {r["id"]: list(r["pageranks"]) for r in g.parallelPersonalizedPageRank(sourceIds=[2, 1], maxIter=3).collect()}
    assert set(got) == {1, 2, 3, 4} and all(len(v) == 2 for v in got.values())
    assert all(abs(sum(v[i] for v in got.values()) - 1) < 1e-9 for i in range(2))


def layered(layers, width):
    """Every vertex of a layer leads to every one of the next, the first pair twice; all lead back to the first layer."""
    at = lambda i, j: i * width + j
    e = [(at(i, j), at(i + 1, k)) for i in range(layers - 1) for j in range(width) for k in range(width)]
    return e + [(at(0, 0), at(1, 0))] + [(at(i, j), at(0, 0)) for i in range(1, layers) for j in range(width)]


def test_bfs_many_long_paths(spark):
    from edgewise.operators.paths import bfs_paths
    e = layered(6, 3)
    g = make_graph(spark, e)
    got = sorted((r.path, r.length) for r in bfs_paths(g, "id < 3", "id = 16").collect())
    want = [((str(j), str(a + 3), str(b + 6), str(c + 9), str(d + 12), "16"), 1 + (j == a == 0))
            for j in range(3) for a in range(3) for b in range(3) for c in range(3) for d in range(3)]
    assert got == sorted((",".join(p), 5) for p, n in want for _ in range(n))
    wide = g.bfs("id < 3", "id = 16")
    assert wide.columns == ["from", "e0", "v1", "e1", "v2", "e2", "v3", "e3", "v4", "e4", "to"]
    rows = wide.collect()
    assert sorted(",".join(str(r[c].id) for c in wide.columns if c[0] != "e") for r in rows) == [p for p, _ in got]
    assert all((r.e2.src, r.e2.dst) == (r.v2.id, r.v3.id) for r in rows)
    assert bfs_paths(g, "id < 3", "id = 16", max_path_length=4).count() == 0


def test_path_counts(spark):
    g = make_graph(spark, layered(6, 3), vertices=[*range(18), 99])
    got = {r.id: (r.distance, r.n_paths) for r in g.path_counts("id = 0").collect()}
    want = {0: (0, 1)} | {3 * i + j: (i, 2 * (j == 0) + (j != 0) if i == 1 else 4 * 3 ** (i - 2)) for i in range(1, 6) for j in range(3)}
    assert got == want
    assert {r.distance for r in g.path_counts("id = 0", max_path_length=2).collect()} == {0, 1, 2}
    assert g.path_counts("id = 7", edge_filter="src < 0").collect()[0][:] == (7, 0, 1)
    assert g.path_counts("id = -1").count() == 0
    double = [(i, i + 1) for i in range(63) for _ in range(2)]
    with pytest.raises(Exception, match="more shortest paths than a long holds"):
        make_graph(spark, double).path_counts("id = 0")
    assert make_graph(spark, double[:-2]).path_counts("id = 0").agg(F.max("n_paths")).first()[0] == 1 << 62


def test_a_deep_search_reads_few_tables(spark):
    from edgewise.plans.iterate import MOST_PIECES, Pieces, StepCutter
    cutter = StepCutter()
    pieces = Pieces(cutter, "id")
    sizes = [1] * 30 + [40, 3, 2, 1] + [1] * 12
    for i, n in enumerate(sizes):
        pieces.add(spark.range(i * 100, i * 100 + n), n)
        assert len(pieces.parts) <= MOST_PIECES
    rows = [r.id for r in pieces.table().collect()]
    assert sorted(rows) == [i * 100 + k for i, n in enumerate(sizes) for k in range(n)]
    assert [n for _, n in pieces.parts] == [df.count() for df, _ in pieces.parts]
    cutter.close()
