"""Shortest paths to landmarks and breadth-first path search.

Both are level-synchronous frontier loops: a level is one join of the
frontier with the edge table (laid out once, hub keys salted) plus an anti
join against the rows already found, which lie in a bounded number of
written tables (``Pieces``) however deep the graph is.  Levels are
checkpointed; the stop test (empty frontier / a target reached) is an
observed count on the same job.  Rounds = graph depth, and each vertex enters
the frontier once per landmark, so the edges are read O(landmarks) times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import expr
from ..graph import DST, ID, SRC, Graph
from ..plans.iterate import Pieces, StepCutter
from ..plans.skew import KeyedEdges


def _typed_list(spark, values, dtype, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype.simpleString()}")


def shortest_paths(g: Graph, landmarks, checkpoint_interval: int = 2) -> DataFrame:
    """Hop distance from every vertex **to** each landmark, along edge direction.

    Long form ``(id, landmark, distance)``; a landmark is at distance 0 from
    itself, unreachable pairs are absent.  ``distances_map`` gives the map view.
    """
    spark = g.vertices.sparkSession
    dtype = g.vertices.schema[ID].dataType
    cutter = StepCutter(checkpoint_interval)
    try:
        vids, n, pairs, m = cutter.graph_inputs(g.vertices, g.edges, [ID], [SRC, DST])
        # the landmark list comes from the caller: a driver-bounded broadcast
        lms = F.broadcast(_typed_list(spark, list(landmarks), dtype, "landmark"))
        frontier = (vids.join(lms, F.col(ID) == F.col("landmark"), "inner")
                    .select(ID, "landmark", F.lit(0).alias("distance")))
        # messages travel against edge direction: the frontier holds dst ids
        layout = KeyedEdges(pairs, DST, SRC, cutter=cutter, total_edges=m,
                            vertex_count=n * max(len(landmarks), 1)).persist(cutter)
        # what is found is kept for the result: always written, never just persisted
        frontier, m = cutter.cut(frontier, {"n": F.count(F.lit(1))}, reliable=True)
        found = Pieces(cutter, ID, "landmark").add(frontier, m["n"])
        d = 0
        while m["n"]:
            d += 1
            nxt = (layout.attach(frontier.select(ID, "landmark"), ID)
                   .select(F.col(SRC).alias(ID), "landmark").distinct()
                   .join(found.table().select(ID, "landmark"), [ID, "landmark"], "left_anti")
                   .withColumn("distance", F.lit(d)))
            frontier, m = cutter.cut(nxt, {"n": F.count(F.lit(1))}, reliable=True)
            if m["n"]:
                found.add(frontier, m["n"])
        return found.table()
    finally:
        cutter.close()


def distances_map(g: Graph, long_form: DataFrame) -> DataFrame:
    """Vertices with a ``distances`` map (landmark -> hops); empty when none.

    The collected list per vertex is bounded by the number of landmarks.
    """
    maps = long_form.groupBy(ID).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("landmark", "distance")))).alias("distances"))
    empty = F.create_map().cast(maps.schema["distances"].dataType)
    return (g.vertices.join(maps, ID, "left")
            .withColumn("distances", F.coalesce("distances", empty)))


@dataclass
class PathDag:
    """The edges that lie on a shortest path from a source to a target, step by step.

    ``steps[i]`` holds ``(src, dst, n)``: the pairs of step ``i`` and their number of
    parallel edges.  ``ends`` are the sources that are targets (length 0 only).
    """

    length: int
    steps: list[DataFrame]
    ends: DataFrame
    edges: DataFrame

    def paths(self) -> DataFrame:
        """One row per path of vertices: ``_p0 .. _pL``, and ``_n`` paths of edges along it.
        Only ids are carried."""
        if not self.steps:
            return self.ends.select(F.col(ID).alias("_p0"), F.lit(1).cast("long").alias("_n"))
        out = self.steps[0].select(F.col(SRC).alias("_p0"), F.col(DST).alias("_p1"), F.col("n").alias("_n"))
        for i, step in enumerate(self.steps[1:], 1):
            out = (out.join(step.select(F.col(SRC).alias(f"_p{i}"), F.col(DST).alias(f"_p{i + 1}"), "n"), f"_p{i}")
                   .withColumn("_n", F.col("_n") * F.col("n")).drop("n"))
        return out


def path_dag(g: Graph, from_expr, to_expr, edge_filter=None, max_path_length: int = 10,
             checkpoint_interval: int = 2) -> PathDag | None:
    """Multi-source BFS up to the first level holding a target; None when no target is
    reachable within ``max_path_length`` edges.

    The edges that enter a new level are written as the level is found, so the pruning
    from the targets back reads those only, never the whole edge table again.
    """
    edges = g.edges if edge_filter is None else g.edges.where(expr(edge_filter))
    cutter = StepCutter(checkpoint_interval)
    counts = {"n": F.count(F.lit(1)), "hit": F.sum(F.col("_is_target").cast("int"))}
    try:
        v, n, pairs, n_edges = cutter.graph_inputs(
            g.vertices, edges, [ID, expr(to_expr).alias("_is_target"), expr(from_expr).alias("_is_source")], [SRC, DST])
        level, m = cutter.cut(v.where(F.col("_is_source")).select(ID, "_is_target"), counts, reliable=True)
        seen = Pieces(cutter, ID).add(level.select(ID), m["n"])
        layout = KeyedEdges(pairs, SRC, DST, cutter=cutter, total_edges=n_edges, vertex_count=n).persist(cutter)
        steps: list[DataFrame] = []
        while not m["hit"]:
            if not m["n"] or len(steps) >= max_path_length:
                return None
            entering = (layout.attach(level.select(ID), ID).groupBy(SRC, DST).agg(F.count(F.lit(1)).alias("n"))
                        .join(seen.table(), F.col(DST) == F.col(ID), "left_anti"))
            step, _ = cutter.cut(entering, reliable=True)
            steps.append(step)
            level, m = cutter.cut(step.select(F.col(DST).alias(ID)).distinct().join(v.select(ID, "_is_target"), ID),
                                  counts, reliable=True)
            if m["n"]:
                seen.add(level.select(ID), m["n"])
        # back from the targets: only edges that lead to one stay
        ends = level.where(F.col("_is_target")).select(ID)
        for i in range(len(steps) - 1, -1, -1):
            steps[i], _ = cutter.cut(steps[i].join(ends, F.col(DST) == F.col(ID), "left_semi"), reliable=True)
            ends = steps[i].select(F.col(SRC).alias(ID)).distinct()
        return PathDag(len(steps), steps, ends, edges)
    finally:
        cutter.close()


def bfs(g: Graph, from_expr, to_expr, edge_filter=None, max_path_length: int = 10
        ) -> DataFrame:
    """All shortest paths from a vertex matching ``from_expr`` to one matching
    ``to_expr``: columns ``from, e0, v1, e1, ..., to`` (vertex and edge structs).

    A start vertex that already matches ``to_expr`` gives 0-length paths
    (``from``, ``to``).  Empty when nothing is reachable within
    ``max_path_length`` edges.  The result has one row per shortest path;
    that count is the size of the answer, not of an intermediate.  Paths are
    put together as ids; vertices and edges are joined to them at the end.
    """
    whole = F.struct(*[F.col(c) for c in g.vertices.columns])
    dag = path_dag(g, from_expr, to_expr, edge_filter, max_path_length)
    if dag is None:
        return g.vertices.select(whole.alias("from"), whole.alias("to")).where(F.lit(False))
    out = dag.paths().drop("_n")
    vstruct = g.vertices.select(F.col(ID).alias("_vid"), whole.alias("_v"))
    if dag.length == 0:
        p = out.join(vstruct, F.col("_p0") == F.col("_vid"))
        return p.select(F.col("_v").alias("from"), F.col("_v").alias("to"))
    names = ["from"] + [f"v{i}" for i in range(1, dag.length)] + ["to"]
    for i, name in enumerate(names):
        out = out.join(vstruct.select(F.col("_vid").alias(f"_p{i}"), F.col("_v").alias(name)), f"_p{i}")
    each = dag.edges.select(F.col(SRC).alias("_s"), F.col(DST).alias("_d"),
                            F.struct(*[F.col(c) for c in dag.edges.columns]).alias("_e"))
    order = [names[0]]
    for i, step in enumerate(dag.steps):
        on_path = each.join(step, (F.col("_s") == F.col(SRC)) & (F.col("_d") == F.col(DST)), "left_semi")
        out = out.join(on_path.select(F.col("_s").alias(f"_p{i}"), F.col("_d").alias(f"_p{i + 1}"),
                                      F.col("_e").alias(f"e{i}")), [f"_p{i}", f"_p{i + 1}"])
        order += [f"e{i}", names[i + 1]]
    return out.select(*order)


def bfs_paths(g: Graph, from_expr, to_expr, edge_filter=None, max_path_length: int = 10
              ) -> DataFrame:
    """``bfs`` as ids: ``from_id, to_id, length, path`` (ids joined by ','); parallel edges
    give a row each, as there."""
    dag = path_dag(g, from_expr, to_expr, edge_filter, max_path_length)
    if dag is None:
        kind = g.vertices.schema[ID].dataType.simpleString()
        return g.vertices.sparkSession.createDataFrame(
            [], f"from_id {kind}, to_id {kind}, length int, path string")
    ids = [F.col(f"_p{i}").cast("string") for i in range(dag.length + 1)]
    return (dag.paths().withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
            .select(F.col("_p0").alias("from_id"), F.col(f"_p{dag.length}").alias("to_id"),
                    F.lit(dag.length).alias("length"), F.concat_ws(",", *ids).alias("path")))


def path_counts(g: Graph, from_expr, edge_filter=None, max_path_length: int | None = None,
                checkpoint_interval: int = 2) -> DataFrame:
    """``id, distance, n_paths``: hops from the nearest vertex matching ``from_expr`` to every vertex
    reached, and the number of shortest paths (of edges) that lead there, without listing any.

    A source has distance 0 and one path.  Counts are added level by level as partial sums; one
    above 2^63 - 1 is an error.
    """
    edges = g.edges if edge_filter is None else g.edges.where(expr(edge_filter))
    cutter = StepCutter(checkpoint_interval)
    counts = {"n": F.count(F.lit(1))}
    one = F.lit(1).cast("long")
    try:
        v, n, pairs, n_edges = cutter.graph_inputs(g.vertices, edges, [ID, expr(from_expr).alias("_is_source")], [SRC, DST])
        level, m = cutter.cut(v.where(F.col("_is_source")).select(ID, F.lit(0).alias("distance"), one.alias("n_paths")),
                              counts, reliable=True)
        found = Pieces(cutter, ID).add(level, m["n"])
        layout = KeyedEdges(pairs, SRC, DST, cutter=cutter, total_edges=n_edges, vertex_count=n).persist(cutter)
        d = 0
        while m["n"] and (max_path_length is None or d < max_path_length):
            d += 1
            total = F.sum(F.col("n_paths").cast("decimal(38,0)"))
            many = F.raise_error(F.lit("more shortest paths than a long holds")).cast("long")
            reached = (layout.attach(level.select(ID, "n_paths"), ID).groupBy(F.col(DST).alias(ID))
                       .agg(F.when(total > (1 << 63) - 1, many).otherwise(total.cast("long")).alias("n_paths")))
            nxt = (reached.join(found.table().select(ID), ID, "left_anti").join(v.select(ID), ID, "left_semi")
                   .select(ID, F.lit(d).alias("distance"), "n_paths"))
            level, m = cutter.cut(nxt, counts, reliable=True)
            if m["n"]:
                found.add(level, m["n"])
        return found.table()
    finally:
        cutter.close()
