"""Graph operators with broadcast joins off and hubs split: one vertex owns a third of the edges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from conftest import SMOKE, as_dict, make_graph
from edgewise.plans.skew import join_hub_safe

SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "edgewise.skew.minHotDegree": "20", "edgewise.skew.maxHotKeys": "64",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def split_hubs(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hub_edges(n=400, seed=1):
    """A hub with out- and in-edges of a third of all, some chains, cycles and small parts."""
    rng = random.Random(seed)
    e = [(0, v) if v % 2 else (v, 0) for v in range(1, n // 2)]
    e += [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]
    for start in range(1000, 1200, 5):
        e += [(start + k, start + (k + 1) % 5) for k in range(rng.randrange(2, 6))]
    return e


def ids(edges):
    return sorted({x for e in edges for x in e})


def test_rows_of_a_hub_stay_spread(spark, split_hubs):
    """The join with a hub's value leaves no partition with more than a few times the mean."""
    rows = spark.range(30_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("u"), F.col("id").alias("v"))
    values = rows.groupBy("u").agg(F.min("v").alias("m"))
    got = join_hub_safe(rows, "u", values, 30_000)
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == 30_000 and sizes[-1] < 3 * 30_000 / len(sizes)
    assert as_dict(got.where("u = 7").select("u", "m").distinct(), "u") == {7: 0}
    # the plain join holds the hub in one partition
    plain = [r["count"] for r in rows.join(values, "u").groupBy(F.spark_partition_id()).count().collect()]
    assert max(plain) >= 10_000


@pytest.mark.parametrize("algorithm", ["large_star", "min_label"])
def test_components_with_a_hub(spark, split_hubs, algorithm):
    e = hub_edges()
    got = as_dict(make_graph(spark, e).connected_components(algorithm=algorithm).select("id", "component"))
    assert got == brute.components(ids(e), e)


def test_strong_components_with_a_hub(spark, split_hubs):
    for seed in (1, 2):
        e = hub_edges(120, seed)
        got = as_dict(make_graph(spark, e).strongly_connected_components().select("id", "component"))
        assert got == brute.strong_components(ids(e), e)


def test_strong_components_release_what_they_cache(spark):
    spark.catalog.clearCache()
    g = make_graph(spark, [(1, 2), (2, 1), (3, 4)])
    assert as_dict(g.strongly_connected_components().select("id", "component")) == {1: 1, 2: 1, 3: 3, 4: 4}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    with pytest.raises(RuntimeError):
        make_graph(spark, [(1, 2), (2, 1), (2, 5), (5, 2), (1, 9), (9, 7), (7, 9)]).strongly_connected_components(max_iter=0)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


QUERIES = ["triangle_count", "motif_two_hop", "motif_negated", "bfs", "pagerank_static", "aggregate_messages_src"]


@pytest.mark.parametrize("name", QUERIES)
def test_queries_with_hubs_split(spark, split_hubs, name):
    from oracle_compare import compare
    r = compare(spark, name, SMOKE)
    assert r["status"] == "ok", r


def test_a_pregel_step_shuffles_no_edges(spark, split_hubs):
    """The laid-out edges are read from the cache, in the order of the join's key; only one end is joined."""
    from edgewise.operators import messages
    from edgewise.plans.iterate import StepCutter
    e = hub_edges()
    g = make_graph(spark, e)
    cutter = StepCutter()
    state, _ = cutter.cut(g.vertices.withColumn("rank", F.lit(1.0)), reliable=True)
    sent = messages._Sender(cutter, g, state, None, None, messages.Pregel.src("rank") * 2, None)
    assert list(sent.layouts) == ["src"] and messages.reads(messages.Pregel.src("rank") + F.col("dst"), "dst", ["id", "rank"]) == ["id", "rank"]
    plan = sent.messages(state)._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("InMemoryTableScan")
    below = plan[:scan].rindex("Join")  # nothing but the scan stands between the join and the edges
    assert "Exchange" not in plan[below:scan] and plan.count("InMemoryTableScan") >= 1
    got = as_dict(sent.messages(state).groupBy("id").agg(F.sum("_pregel_msg").alias("m")), "id", "m")
    want = {}
    for a, b in e:
        want[b] = want.get(b, 0) + 2.0
    assert got == want
    cutter.close()


def test_pregel_active_vertices(spark):
    """Hops from vertex 0: only vertices reached in the last step send, and the loop ends by itself."""
    from edgewise.operators.messages import Pregel
    e = [(0, 1), (1, 2), (2, 3), (3, 1), (5, 6), (9, 9)]
    g = make_graph(spark, e)
    hops = (g.pregel.set_max_iter(50).with_vertex_column("d", F.when(F.col("id") == 0, 0), F.coalesce("d", Pregel.msg()))
            .with_vertex_column("step", F.when(F.col("id") == 0, 0).otherwise(-1),
                                F.when(F.col("d").isNull() & Pregel.msg().isNotNull(), Pregel.msg()).otherwise(-1))
            .send_msg_to_dst(Pregel.src("d") + 1).agg_msgs(F.min(Pregel.msg())).set_active("step >= 0").run())
    assert as_dict(hops.select("id", "d")) == {0: 0, 1: 1, 2: 2, 3: 3, 5: None, 6: None, 9: None}


def test_wedges_of_a_hub_are_split(spark, split_hubs):
    from edgewise.plans.skew import join_pairs_hub_safe
    n = 6000
    into = spark.range(n, numPartitions=4).select(F.col("id").alias("x"), F.lit(1).cast("long").alias("y"))
    out = spark.range(5).select(F.lit(1).cast("long").alias("y"), (F.col("id") + n).alias("z"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = join_pairs_hub_safe(into, "y", "x", out, n)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 5 * n and max(sizes) < 2 * sum(sizes) / len(sizes) and len(sizes) >= 3
    e = [(x, 1000) for x in range(200)] + [(1000, 2000 + z) for z in range(200)] + [(x, 2000 + x) for x in range(0, 200, 3)]
    got = as_dict(make_graph(spark, e).triangle_count().select("id", "count"))
    assert got == brute.triangles(ids(e), e)


def motif_brute(edges, listed, pattern):
    """All matches by trying every edge for every term."""
    from edgewise.operators.motif import parse
    terms = parse(pattern)
    names = list(dict.fromkeys(n for t in terms for n in (t.src, t.dst) if n))
    found = [{}]
    for t in terms:
        if t.negated or t.vertex_only:
            continue
        found = [{**m, **{n: x for n, x in ((t.src, a), (t.dst, b)) if n}} for m in found for a, b in edges
                 if all(m.get(n, x) == x for n, x in ((t.src, a), (t.dst, b)) if n)
                 and (t.src is None or t.src != t.dst or a == b)]
    have = set(edges)
    found = [m for m in found if all(m[n] in listed for n in names)
             and not any(t.negated and (m[t.src], m[t.dst]) in have for t in terms)]
    return sorted(tuple(m[n] for n in names) for m in found)


MOTIFS = ["(a)-[]->(b); (b)-[]->(c)", "(a)-[e]->(b); (c)-[f]->(b)", "(a)-[]->(b); (b)-[]->(c); (c)-[]->(a)",
          "(a)-[]->(b); (b)-[]->(c); !(c)-[]->(a)", "(a)-[]->(b); (b)-[]->(b); !(b)-[]->(a)",
          "(a)-[]->(b); (b)-[]->(c); (d)-[]->(c)", "(a)-[]->(); (a)-[]->(b); (a)", "(b)-[]->(c); (a)-[]->(b); (a)-[]->(c); !(c)-[]->(b)"]


@pytest.mark.parametrize("pattern", MOTIFS)
@pytest.mark.parametrize("attributes", [False, True])
def test_motifs_with_a_hub(spark, split_hubs, pattern, attributes):
    from edgewise.graph import Graph
    rng = random.Random(3)
    e = ([(0, v) if v % 2 else (v, 0) for v in range(1, 50)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(25)]
         + [(7, 7), (0, 0), (0, 1), (0, 1), (3, 99)])
    listed = set(range(50))  # 99 is not, so no name is bound to it
    v = spark.createDataFrame([(x, f"v{x}") for x in [*listed, 5]], "id bigint, name string")
    g = Graph(v if attributes else v.select("id"), spark.createDataFrame(e, "src bigint, dst bigint"))
    got = g.find(pattern)
    names = [c for c in got.columns if dict(got.dtypes)[c].startswith("struct<id")]
    assert sorted(tuple(r[n].id for n in names) for r in got.collect()) == motif_brute(e, listed, pattern)
    if attributes:
        assert got.where(" or ".join(f"{n}.name != concat('v', {n}.id)" for n in names)).count() == 0


def test_cells_of_a_hub_hold_a_bounded_share(spark, split_hubs):
    """A middle vertex of a third of all edges, in and out: no task makes a few times the median of the pairs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        e = [(x, 0) for x in range(1, 601)] + [(0, x) for x in range(1001, 1601)] + [(x, x + 1) for x in range(2000, 3200)]
        m = make_graph(spark, e).find("(a)-[]->(b); (b)-[]->(c)")
        sizes = sorted(r["count"] for r in m.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sum(sizes) == 600 * 600 + 1199
    assert len(sizes) == 8 and sizes[-1] < 3 * sizes[len(sizes) // 2]


def test_motif_order_by_cost():
    """The closing term and the loop come before a term that multiplies the rows."""
    from edgewise.operators.motif import parse, term_order
    terms = parse("(a)-[]->(b); (b)-[]->(c); (b)-[]->(a); (a)-[]->(a)")
    products = {("i", "i"): 1e6, ("o", "o"): 5e5, ("i", "o"): 1e5, ("o", "i"): 1e5}
    order = [(t.src, t.dst) for t in term_order(terms, 1000, 10, products)]
    assert order == [("a", "b"), ("a", "a"), ("b", "a"), ("b", "c")]
    # from the start with fewer rows when no term closes: in-hubs come first in the pattern, last in the order
    chain = parse("(a)-[]->(c); (b)-[]->(c); (b)-[]->(d)")
    assert [(t.src, t.dst) for t in term_order(chain, 1000, 0, products)][-1] == ("a", "c")
