"""Motif search, message aggregation, Pregel and the skew-safe join layout."""

import pytest
from pyspark.sql import functions as F

from brute import pagerank
from conftest import as_dict, make_graph
from edgewise.graph import Graph
from edgewise.operators.motif import parse


def test_motif_parse_and_errors():
    t = parse("(a)-[e]->(b); !(b)-[]->(a); (c)")
    assert [x.negated for x in t] == [False, True, False]
    with pytest.raises(ValueError):
        parse("(a)-[e]->")
    with pytest.raises(ValueError):
        parse("(a)-[e]->(b); (b)-[e]->(c)")
    with pytest.raises(ValueError):
        parse("!(a)-[e]->(b)")


def test_motif_two_hop_mutual_negated(spark):
    g = make_graph(spark, [(1, 2), (2, 3), (3, 1), (2, 1), (3, 4)])
    two = g.find("(a)-[e]->(b); (b)-[e2]->(c)")
    assert two.columns == ["a", "e", "b", "e2", "c"]
    rows = {(r.a.id, r.b.id, r.c.id) for r in two.collect()}
    assert rows == {(1, 2, 3), (1, 2, 1), (2, 3, 1), (2, 3, 4), (3, 1, 2), (2, 1, 2)}
    mutual = {(r.a.id, r.b.id) for r in g.find("(a)-[]->(b); (b)-[]->(a)").collect()}
    assert mutual == {(1, 2), (2, 1)}
    open_ = {(r.a.id, r.b.id, r.c.id)
             for r in g.find("(a)-[]->(b); (b)-[]->(c); !(c)-[]->(a)").collect()}
    assert (1, 2, 3) not in open_ and (2, 3, 4) in open_


def test_motif_self_loop_and_cross_product_rejected(spark):
    g = make_graph(spark, [(1, 1), (1, 2)])
    assert [r.a.id for r in g.find("(a)-[]->(a)").collect()] == [1]
    with pytest.raises(ValueError):
        g.find("(a)-[]->(b); (c)-[]->(d)")


def test_aggregate_messages(spark):
    v = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id bigint, age int")
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src bigint, dst bigint")
    g = Graph(v, e)
    got = g.aggregate_messages(F.sum("msg").alias("s"), send_to_dst=F.col("src.age"),
                               send_to_src=F.col("dst.age"))
    assert as_dict(got) == {1: 50, 2: 40, 3: 30}
    only_dst = g.aggregate_messages(F.count("msg").alias("n"),
                                    send_to_dst=F.when(F.col("src.age") > 10, F.lit(1)))
    assert as_dict(only_dst) == {3: 1}


def test_pregel_pagerank_matches_unnormalised_power_iteration(spark):
    from edgewise.operators.messages import Pregel
    es = [(1, 2), (2, 3), (3, 1), (3, 2)]
    g = make_graph(spark, es)
    n = 3
    v = g.vertices.join(g.out_degrees, "id", "left").fillna(0, ["outDegree"])
    ranks = (Graph(v, g.edges).pregel.setMaxIter(4)
             .withVertexColumn("rank", F.lit(1.0 / n),
                               F.coalesce(Pregel.msg(), F.lit(0.0)) * 0.85 + 0.15 / n)
             .sendMsgToDst(Pregel.src("rank") / Pregel.src("outDegree"))
             .aggMsgs(F.sum(Pregel.msg())).run())
    got = as_dict(ranks.select("id", "rank"))
    want = pagerank([1, 2, 3], es, iters=4)
    total = sum(got.values())
    for k in want:
        assert got[k] * n / total == pytest.approx(want[k], rel=1e-9)


def test_salted_layout_gives_same_pagerank_on_a_star(spark):
    """Force the shuffle path with a salted hub and compare with the broadcast path."""
    es = [(0, i) for i in range(1, 400)] + [(i, 0) for i in range(1, 400, 3)] + [(5, 6)]
    g = make_graph(spark, es)
    base = as_dict(g.page_rank(max_iter=4).vertices.select("id", "pagerank"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("edgewise.skew.minHotDegree", "10")
    spark.conf.set("edgewise.skew.saltBuckets", "7")
    try:
        salted = as_dict(g.page_rank(max_iter=4).vertices.select("id", "pagerank"))
        sp = {(r.id, r.landmark): r.distance for r in g.shortest_paths([0]).collect()}
        lpa = as_dict(g.label_propagation(2).select("id", "label"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("edgewise.skew.minHotDegree")
        spark.conf.unset("edgewise.skew.saltBuckets")
    for k, x in base.items():
        assert salted[k] == pytest.approx(x, rel=1e-12)
    assert sp[(0, 0)] == 0 and sp[(1, 0)] == 1 and (6, 0) not in sp
    assert as_dict(g.label_propagation(2).select("id", "label")) == lpa


def test_keyed_edges_plan_salts_hot_keys(spark):
    from edgewise.plans.skew import KeyedEdges
    e = spark.createDataFrame([(0, i) for i in range(100)] + [(1, 2)], "src bigint, dst bigint")
    k = KeyedEdges(e, "src", "dst", total_edges=101, vertex_count=None, min_hot_degree=5,
                   salt_buckets=4)
    salts = {r._salt for r in k.edges.where("src = 0").select("_salt").collect()}
    # as many sub-keys as leave at most min_hot_degree edges in each, on average
    assert salts <= set(range(20)) and len(salts) > 4
    parallel = spark.createDataFrame([(0, 1)] * 100, "src bigint, dst bigint")
    split = KeyedEdges(parallel, "src", "dst", total_edges=100, vertex_count=None, min_hot_degree=5, salt_buckets=4)
    assert split.edges.select("_salt").distinct().count() > 4
    v = spark.createDataFrame([(0, 1.0), (1, 2.0)], "id bigint, x double")
    assert k.attach(v).count() == 101


def test_svd_plus_plus_lowers_training_error(spark):
    from edgewise.operators.svdpp import svd_plus_plus, training_rmse
    rows = [(u, -i, float((u * 7 + i * 3) % 5)) for u in range(1, 30) for i in range(1, 12)
            if (u + i) % 3]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, weight double")
    g = Graph.from_edges(e)
    r0, mu = svd_plus_plus(g, rank=4, max_iter=0)
    # default step sizes: steps of all ratings of a vertex are summed in one
    # synchronous update, so much larger steps overshoot
    r5, _ = svd_plus_plus(g, rank=4, max_iter=5)
    assert r5.count() == g.vertices.count()
    assert training_rmse(g, r5, mu) < training_rmse(g, r0, mu)
