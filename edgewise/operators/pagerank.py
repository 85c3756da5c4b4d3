"""PageRank: fixed iterations, to tolerance, personalised, many sources at once.

Update (synchronous, no dangling redistribution inside the loop)::

    r'(v) = reset(v) + (1 - a) * sum_{u -> v} r(u) / outdeg(u)

``reset(v) = a`` for plain PageRank and ``a * [v == source]`` when
personalised.  Plain ranks start at 1.0 and are finally scaled so that they
sum to the number of vertices; personalised ranks start at 1 on the source
and are finally scaled to sum to 1.  Parallel edges count separately.

Plan per superstep (two shuffles, both vertex- or combiner-sized):

1. the shares ``(id, rank * 1/outdeg)`` of the vertices with out-edges (personalised:
   with a rank above 0) are joined to the edge table, which was laid out once by ``src``
   (hub sources salted, see ``plans.skew``) and persisted, so only the vertex side moves;
2. contributions are summed by ``dst`` with map-side partial aggregation and
   left-joined back to the state, which is already partitioned by ``id``.

Each step is checkpointed (``checkpoint_interval``) and the tolerance test is
an observed ``max(abs(delta))`` on the same job.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import DST, ID, SRC, Graph, result_base
from ..plans.iterate import StepCutter
from ..plans.skew import KeyedEdges


def _check_args(max_iter, tol):
    if (max_iter is None) == (tol is None):
        raise ValueError("give exactly one of max_iter and tol")
    if max_iter is not None and max_iter < 0:
        raise ValueError("max_iter must be >= 0")
    if tol is not None and not tol > 0:
        raise ValueError("tol must be above 0")


def _out_weights(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col(SRC).alias(ID)).agg(
        (F.lit(1.0) / F.count(F.lit(1))).alias("_inv"))


def _layout(cutter: StepCutter, pairs: DataFrame, m: int, rows: int) -> tuple[KeyedEdges, DataFrame]:
    """``m`` edges laid out by source for steps that join ``rows`` values, and ``id, _inv``: 1 / outdegree.

    The shares of a vertex are worked out before they meet its edges, so the edges are dealt once and
    carry no weight; the degrees are counted on the layout, where the edges of a vertex already lie together.
    """
    layout = KeyedEdges(pairs.where(F.col(SRC).isNotNull()), SRC, DST, cutter=cutter, total_edges=m,
                        vertex_count=rows).persist(cutter)
    inv, _ = cutter.cut(_out_weights(layout.edges), reliable=True)
    return layout, inv


def page_rank(g: Graph, reset_probability: float = 0.15, max_iter: int | None = None,
              tol: float | None = None, source_id=None, checkpoint_interval: int = 2) -> Graph:
    """PageRank; returns a graph with ``pagerank`` on vertices and ``weight`` on edges.

    With ``tol`` the loop runs until no rank moves by more than it: a step
    shrinks every difference by ``1 - reset_probability``, so it ends.

    The loop state holds ranks only for vertices with in-edges: any other
    vertex keeps the constant rank ``reset`` after the first step, which the
    share of a vertex supplies with a ``coalesce``.  A step is therefore one
    join of the laid-out edges with the shares and one partial sum
    by ``dst``; the vertex table is joined once, at the end.
    """
    _check_args(max_iter, tol)
    a = float(reset_probability)
    cutter = StepCutter(checkpoint_interval)
    try:
        vids, n, pairs, m = cutter.graph_inputs(g.vertices, g.edges, [ID], [SRC, DST])
        layout, inv = _layout(cutter, pairs, m, n)

        if source_id is None:
            def reset_of(c):
                return F.lit(a)

            def init_of(c):
                return F.lit(1.0)
        else:
            def reset_of(c):
                return F.when(c == F.lit(source_id), F.lit(a)).otherwise(F.lit(0.0))

            def init_of(c):
                return F.when(c == F.lit(source_id), F.lit(1.0)).otherwise(F.lit(0.0))

        # no rows, and known to have none, so that the first step runs no job for them
        state = vids.select(ID, F.lit(0.0).alias("pagerank")).where(F.lit(False))
        default = init_of           # rank of a vertex missing from the state
        if source_id is not None and not vids.where(F.col(ID) == F.lit(source_id)).take(1):
            raise ValueError(f"source {source_id!r} is not a vertex")
        for i in range(max_iter) if max_iter is not None else count():
            rank = F.coalesce(F.col("pagerank"), default(F.col(ID)))
            shares = inv.join(state, ID, "left").select(ID, (rank * F.col("_inv")).alias("_weighted"))
            if source_id is not None:  # only the vertices reached so far have anything to send
                shares = shares.where(F.col("_weighted") != 0.0)
            sums = layout.attach(shares, ID).groupBy(F.col(DST).alias(ID)).agg(F.sum("_weighted").alias("_s"))
            new = sums.select(ID, (reset_of(F.col(ID)) + F.lit(1.0 - a) * F.col("_s"))
                              .alias("pagerank"))
            if tol is None:
                state, _ = cutter.cut(new)
            else:
                if i == 0:
                    # first step: every vertex moves from its start value
                    cmp = (vids.join(new, ID, "left")
                           .select(ID, F.coalesce("pagerank", reset_of(F.col(ID))).alias("pagerank"),
                                   init_of(F.col(ID)).alias("_old")))
                else:
                    cmp = new.join(state.withColumnRenamed("pagerank", "_old"), ID, "left")
                cmp, mt = cutter.cut(cmp, {"delta": F.max(F.abs(F.col("pagerank") - F.col("_old")))})
                state = cmp.drop("_old")
                if (mt.get("delta") or 0.0) <= tol:
                    default = reset_of
                    break
            default = reset_of

        full = vids.join(state, ID, "left").select(
            ID, F.coalesce(F.col("pagerank"), default(F.col(ID))).alias("pagerank"))
        full, fm = cutter.cut(full, {"total": F.sum("pagerank")}, reliable=True)
        total = fm.get("total") or 0.0
        scale = (1.0 / total if source_id is not None else n / total) if total else 0.0
        ranks = full.select(ID, (F.col("pagerank") * F.lit(scale)).alias("pagerank"))
        verts = result_base(g, vids).join(ranks, ID, "left").withColumn(
            "pagerank", F.coalesce("pagerank", F.lit(0.0)))
        edges = (g.edges.join(inv.withColumnRenamed(ID, SRC), SRC, "left")
                 .withColumnRenamed("_inv", "weight"))
        return Graph(verts, edges)
    finally:
        # the result reads only checkpointed tables
        cutter.close()


def parallel_personalized_page_rank(g: Graph, source_ids, reset_probability: float = 0.15,
                                    max_iter: int = 10, checkpoint_interval: int = 2
                                    ) -> DataFrame:
    """Personalised PageRank for many sources in one loop.

    Long form ``(id, source, pagerank)`` holding the non-zero entries; per
    source the ranks sum to 1.  All sources share one shuffle per step.
    """
    a = float(reset_probability)
    spark = g.vertices.sparkSession
    cutter = StepCutter(checkpoint_interval)
    try:
        vids, n, pairs, m = cutter.graph_inputs(g.vertices, g.edges, [ID], [SRC, DST])
        srcs = spark.createDataFrame([(s,) for s in source_ids],
                                     f"source {g.vertices.schema[ID].dataType.simpleString()}")
        layout, inv = _layout(cutter, pairs, m, n * max(len(source_ids), 1))
        # sources must be vertices; the list comes from the caller, so it is
        # bounded by driver memory and safe to broadcast
        seeds = (srcs.join(vids, F.col("source") == F.col(ID), "left_semi")
                 .select(F.col("source").alias(ID), "source"))
        seeds, _ = cutter.inputs(seeds)
        resets = F.broadcast(seeds.withColumn("_r", F.lit(a)))
        state, _ = cutter.cut(seeds.withColumn("pagerank", F.lit(1.0)))
        for _ in range(max_iter):
            shares = state.join(inv, ID).select(ID, "source", (F.col("pagerank") * F.col("_inv")).alias("_weighted"))
            sums = (layout.attach(shares, ID)
                    .groupBy(F.col(DST).alias(ID), "source").agg(F.sum("_weighted").alias("_s")))
            new = (sums.join(resets, [ID, "source"], "full")
                   .select(ID, "source",
                           (F.coalesce("_r", F.lit(0.0))
                            + F.lit(1.0 - a) * F.coalesce("_s", F.lit(0.0))).alias("pagerank"))
                   .where(F.col("pagerank") != 0.0))
            state, _ = cutter.cut(new)
        totals = state.groupBy("source").agg(F.sum("pagerank").alias("_t"))
        out = (state.join(F.broadcast(totals), "source")
               .select(ID, "source", (F.col("pagerank") / F.col("_t")).alias("pagerank")))
        out, _ = cutter.cut(out, reliable=True)
        return out
    finally:
        cutter.close()
