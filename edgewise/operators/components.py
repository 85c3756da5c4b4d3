"""Connected and strongly connected components.

Connected components (direction ignored; a component is named by its
smallest id) use the alternating large-star / small-star rounds of Kiveris
et al. (2014): O(log n) rounds, each a group-by (map-side partial ``min``,
so a hub is pre-reduced in every task) and a join.  The loop stops when an
observed (count, sum of 64-bit hashes) fingerprint of the edge set repeats.

The minimum of a vertex reaches its edges through ``skew.join_hub_safe``, and
the ids a hub sends are distinct pairs, so a vertex with a third of all edges
is no single task.

Strongly connected components propagate two labels at once, the smallest id
that reaches a vertex and the smallest id it reaches.  Where both are equal,
that id reaches the vertex and is reached by it: it names their component.
Members of one component have the same pair of labels, so edges between
different pairs are dropped, which cuts the rest of the graph into many small
parts.  A vertex without edges left is its own component, so chains and trees end
in one round, without a separate trimming loop.  Parts of few edges
(``plans.strong``) are solved whole, each in one task, in one pass over them all;
in larger ones the labels start anew, and every round settles the smallest id of
each.  So the driver plans a few rounds for the large parts, not one after another
for the deepest of very many small ones.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import edge_set_fingerprint
from ..graph import DST, ID, SRC, Graph, result_base
from ..plans.iterate import StepCutter
from ..plans import strong
from ..plans.skew import KeyedEdges, join_hub_safe


_fingerprint = edge_set_fingerprint


def _large_star(e: DataFrame, n: int) -> DataFrame:
    """e: ``n`` undirected edges (x, y) stored once.  Emits (v, m(u)) for v > u."""
    nbr = e.select(F.col("x").alias("u"), F.col("y").alias("v")).union(
        e.select(F.col("y").alias("u"), F.col("x").alias("v")))
    m = nbr.groupBy("u").agg(F.min("v").alias("_m"))
    m = m.select("u", F.least(F.col("u"), F.col("_m")).alias("m"))
    return (join_hub_safe(nbr.where(F.col("v") > F.col("u")), "u", m, 2 * n)
            .select(F.col("v").alias("x"), F.col("m").alias("y")).distinct())


def _small_star(e: DataFrame, n: int) -> DataFrame:
    """e: ``n`` edges (x, y).  Orient to (larger, smaller); for each x link x and
    all its smaller neighbours to their minimum."""
    o = e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    m = o.groupBy("u").agg(F.min("v").alias("m"))
    j = join_hub_safe(o, "u", m, n)
    linked = (j.where(F.col("v") != F.col("m")).select(F.col("v").alias("x"), F.col("m").alias("y"))
              .union(m.select(F.col("u").alias("x"), F.col("m").alias("y"))))
    return linked.distinct()


def connected_components(g: Graph, checkpoint_interval: int = 2,
                         algorithm: str = "large_star") -> DataFrame:
    """Vertices with ``component`` = smallest id in their weak component.

    ``algorithm="large_star"`` (default) alternates large-star / small-star
    rounds, O(log n) of them; ``"min_label"`` propagates the smallest id along
    edges, one round per hop of the graph's diameter, sending messages only
    from vertices whose label dropped.
    """
    if algorithm == "min_label":
        return _min_label_components(g, checkpoint_interval)
    if algorithm != "large_star":
        raise ValueError(f"unknown algorithm {algorithm!r}: use 'large_star' or 'min_label'")
    cutter = StepCutter(checkpoint_interval)
    try:
        vids, _, pairs, _ = cutter.graph_inputs(g.vertices, g.edges, [ID], [SRC, DST])
        e = (pairs.where(F.col(SRC) != F.col(DST))
             .select(F.greatest(SRC, DST).alias("x"), F.least(SRC, DST).alias("y")).distinct())
        e, fp = cutter.cut(e, _fingerprint("x", "y"))
        while True:
            e, large = cutter.cut(_large_star(e, fp["n"]), {"n": F.count(F.lit(1))})
            e, new_fp = cutter.cut(_small_star(e, large["n"]), _fingerprint("x", "y"))
            if new_fp == fp:
                break
            fp = new_fp
        # converged: stars (x -> component minimum y)
        comp, _ = cutter.cut(e.groupBy(F.col("x").alias(ID)).agg(F.min("y").alias("component")), reliable=True)
    finally:
        cutter.close()
    return (result_base(g, vids).join(comp, ID, "left")
            .withColumn("component", F.coalesce(F.col("component"), F.col(ID))))


def _first_hop(vids: DataFrame, sym: DataFrame, cutter: StepCutter) -> tuple[DataFrame, dict]:
    """Labels after one hop, each the smallest id beside a vertex, in the pass that counts the edges of each vertex.

    ``unknown`` counts the ends of edges that are no vertices, ``most`` is the largest number of edges of an end.
    """
    near = sym.groupBy(F.col("a").alias(ID)).agg(F.min("b").alias("_m"), F.count(F.lit(1)).alias("_n"))
    both = vids.select(ID, F.lit(True).alias("_known")).join(near, ID, "full")
    fell = F.coalesce(F.col("_m") < F.col(ID), F.lit(False))
    return cutter.cut(both.select(ID, F.when(fell, F.col("_m")).otherwise(F.col(ID)).alias("component"),
                                  fell.alias("_changed"), "_known", "_n"),
                      {"unknown": F.count_if(F.col("_known").isNull()), "most": F.max("_n"), "edges": F.sum("_n"),
                       "changed": F.count_if("_changed")}, reliable=True)


def _min_label_components(g: Graph, checkpoint_interval: int) -> DataFrame:
    cutter = StepCutter(checkpoint_interval)
    try:
        # read by the vertices, the first hop and the layout
        edges = g.edges if g.edges.is_cached else cutter.keep(g.edges)
        vids, n = cutter.inputs(g.vertices.select(ID).where(F.col(ID).isNotNull()).dropDuplicates([ID]))
        pairs = edges.select(SRC, DST).where(F.col(SRC) != F.col(DST))
        sym = (pairs.select(F.col(SRC).alias("a"), F.col(DST).alias("b"))
               .union(pairs.select(F.col(DST).alias("a"), F.col(SRC).alias("b"))))
        label, seen = _first_hop(vids, sym, cutter)
        if seen["unknown"]:
            # an end that is no vertex has no label to send
            for end in ("a", "b"):
                sym = sym.join(vids.select(F.col(ID).alias(end)), end, "left_semi")
            label, seen = _first_hop(vids, sym.select("a", "b"), cutter)
        label = label.select(ID, "component", "_changed")
        if seen["changed"]:
            layout = KeyedEdges(sym, "a", "b", cutter=cutter, total_edges=seen["edges"], vertex_count=n,
                                most=seen["most"], unique=True).persist(cutter)
            if edges is not g.edges:
                cutter.release(edges)
        while seen["changed"]:
            senders = label.where(F.col("_changed")).select(ID, "component")
            msg = layout.attach(senders, ID).groupBy(F.col("b").alias(ID)).agg(F.min("component").alias("_m"))
            new = (label.join(msg, ID, "left")
                   .select(ID, F.least("component", F.coalesce("_m", F.col("component"))).alias("component"),
                           F.coalesce(F.col("_m") < F.col("component"), F.lit(False)).alias("_changed")))
            label, seen = cutter.cut(new, {"changed": F.count_if("_changed")}, reliable=True)
    finally:
        cutter.close()
    label = label.drop("_changed")
    return result_base(g, vids).join(label, ID, "left").withColumn(
        "component", F.coalesce(F.col("component"), F.col(ID)))


#: hops that labels travel in one step of strongly connected components
HOPS = 2


def _spread(layout: KeyedEdges, state: DataFrame) -> DataFrame:
    """One hop of both labels from the vertices whose labels fell; ``_fell`` marks those that fall now."""
    sent = layout.attach(state.where("_fell").select(ID, "_in", "_out"), ID)
    along = F.col("_along")
    got = sent.groupBy(F.col("_z").alias(ID)).agg(F.min(F.when(along, F.col("_in"))).alias("_mi"),
                                                  F.min(F.when(~along, F.col("_out"))).alias("_mo"))
    fell = (F.col("_mi") < F.col("_in")) | (F.col("_mo") < F.col("_out"))
    return state.join(got, ID, "left").select(ID, F.least("_in", "_mi").alias("_in"), F.least("_out", "_mo").alias("_out"),
                                              F.coalesce(fell, F.lit(False)).alias("_fell"))


def strongly_connected_components(g: Graph, checkpoint_interval: int = 2,
                                  max_iter: int | None = None) -> DataFrame:
    """Vertices with ``component`` = smallest id among mutually reachable vertices.

    Runs until every vertex has its component; a lower ``max_iter`` (rounds) that
    runs out before that raises.
    """
    cutter = StepCutter(checkpoint_interval)
    found: list[DataFrame] = []
    try:
        vids, _, pairs, _ = cutter.graph_inputs(g.vertices, g.edges, [ID], [SRC, DST])
        # not made distinct: a repeated edge changes no label
        e = pairs.where(F.col(SRC) != F.col(DST))
        m = e.count()
        for step in count():
            if not m:
                break
            if max_iter is not None and step >= max_iter:
                raise RuntimeError(f"the ends of {m} edges have no component yet after {max_iter} rounds")
            arcs = (e.select(F.col(SRC).alias("_a"), F.col(DST).alias("_z"), F.lit(True).alias("_along"))
                    .union(e.select(F.col(DST).alias("_a"), F.col(SRC).alias("_z"), F.lit(False).alias("_along"))))
            ends = arcs.select(F.col("_a").alias(ID)).distinct()
            state, s = cutter.cut(ends.select(ID, F.col(ID).alias("_in"), F.col(ID).alias("_out"), F.lit(True).alias("_fell")),
                                  {"n": F.count(F.lit(1))}, reliable=True)
            layout = KeyedEdges(arcs, "_a", "_z", cutter=cutter, total_edges=2 * m, vertex_count=s["n"]).persist(cutter)
            while True:
                new, between = state, []
                for hop in range(HOPS):
                    new = _spread(layout, new)
                    if hop < HOPS - 1:  # read twice by the next hop, made once
                        new = cutter.keep(new)
                        between.append(new)
                state, seen = cutter.cut(new, {"fell": F.count_if("_fell")}, reliable=True)
                for kept in between:
                    cutter.release(kept)
                if not seen["fell"]:
                    break
            cutter.release(layout.edges)
            found.append(state.where(F.col("_in") == F.col("_out")).select(ID, F.col("_in").alias("component")))
            # members of one component have the same pair of labels
            open_ = state.where(F.col("_in") != F.col("_out"))
            left = join_hub_safe(e, SRC, open_.select(F.col(ID).alias(SRC), F.col("_in").alias("_i"), F.col("_out").alias("_o")), m)
            left = join_hub_safe(left, DST, open_.select(F.col(ID).alias(DST), "_in", "_out"), m)
            left, m = cutter.inputs(left.where((F.col("_i") == F.col("_in")) & (F.col("_o") == F.col("_out")))
                                    .select(SRC, DST, "_in", "_out"))
            if not m or max_iter is not None and step + 1 >= max_iter:
                continue
            part = ["_in", "_out"]
            large, k = cutter.inputs(left.groupBy(*part).count().where(F.col("count") > strong.PART).select(*part))
            small, m = left, 0
            if k:
                large = F.broadcast(large)  # at most one row for PART edges
                e, m = cutter.inputs(left.join(large, part, "left_semi").select(SRC, DST))
                small = left.join(large, part, "left_anti")
            solved = strong.in_parts(small, SRC, DST, part, ID, "component")
            found.append(cutter.cut(solved, reliable=True)[0])
    finally:
        cutter.close()
    base = result_base(g, vids)
    if not found:
        return base.withColumn("component", F.col(ID))
    return (base.join(reduce(DataFrame.unionByName, found), ID, "left")
            .withColumn("component", F.coalesce(F.col("component"), F.col(ID))))
