"""Relational graph views: endpoints, triplets, degrees and subgraphs.

All are single-pass DataFrame plans: aggregations are hash aggregates with
map-side partial combine (a hub vertex is pre-counted in every task before
the shuffle), and subgraph filters are semi joins, which Catalyst turns into
broadcast semi joins when the kept side is measured small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import DST, ID, SRC, Graph


def vertices_of(edges: DataFrame) -> DataFrame:
    """Distinct endpoints of ``edges`` as an ``id`` column; a NULL endpoint is no vertex."""
    return (edges.select(F.col(SRC).alias(ID))
            .union(edges.select(F.col(DST).alias(ID)))
            .where(F.col(ID).isNotNull()).distinct())


def triplets(g: Graph) -> DataFrame:
    """``src``, ``edge``, ``dst`` structs; edges with a missing endpoint drop out."""
    v = g.vertices
    vs = v.select(F.col(ID).alias("_sid"), F.struct(*[F.col(c) for c in v.columns]).alias("src"))
    vd = v.select(F.col(ID).alias("_did"), F.struct(*[F.col(c) for c in v.columns]).alias("dst"))
    e = g.edges.select(F.col(SRC).alias("_es"), F.col(DST).alias("_ed"),
                       F.struct(*[F.col(c) for c in g.edges.columns]).alias("edge"))
    return (e.join(vs, F.col("_es") == F.col("_sid"))
            .join(vd, F.col("_ed") == F.col("_did"))
            .select("src", "edge", "dst"))


def in_degrees(g: Graph) -> DataFrame:
    """``id, inDegree`` for vertices with at least one incoming edge."""
    return g.edges.groupBy(F.col(DST).alias(ID)).agg(F.count(F.lit(1)).cast("int").alias("inDegree"))


def out_degrees(g: Graph) -> DataFrame:
    """``id, outDegree`` for vertices with at least one outgoing edge."""
    return g.edges.groupBy(F.col(SRC).alias(ID)).agg(F.count(F.lit(1)).cast("int").alias("outDegree"))


def degrees(g: Graph) -> DataFrame:
    """``id, degree``; a self-loop counts twice, zero degrees are omitted."""
    ends = g.edges.select(F.explode(F.array(F.col(SRC), F.col(DST))).alias(ID))
    return ends.groupBy(ID).agg(F.count(F.lit(1)).cast("int").alias("degree"))


def _cond(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def filter_vertices(g: Graph, condition: Column | str) -> Graph:
    """Keep vertices matching ``condition`` and edges between kept vertices."""
    kept = g.vertices.where(_cond(condition))
    keys = kept.select(ID)
    e = (g.edges.join(keys.withColumnRenamed(ID, "_k1"), F.col(SRC) == F.col("_k1"), "left_semi")
         .join(keys.withColumnRenamed(ID, "_k2"), F.col(DST) == F.col("_k2"), "left_semi"))
    return Graph(kept, e)


def filter_edges(g: Graph, condition: Column | str) -> Graph:
    """Keep edges matching ``condition``; vertices are unchanged."""
    return Graph(g.vertices, g.edges.where(_cond(condition)))


def drop_isolated_vertices(g: Graph) -> Graph:
    """Keep only vertices that are an endpoint of some edge."""
    used = vertices_of(g.edges).withColumnRenamed(ID, "_u")
    return Graph(g.vertices.join(used, F.col(ID) == F.col("_u"), "left_semi"), g.edges)
