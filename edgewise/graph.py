"""A property graph as two DataFrames.

``vertices`` has an ``id`` column, ``edges`` has ``src`` and ``dst``; every
other column is an attribute.  Nothing here collects data: each method
returns DataFrames (or a new ``Graph``) whose plans Catalyst optimises.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID, SRC, DST = "id", "src", "dst"


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def __post_init__(self):
        if ID not in self.vertices.columns:
            raise ValueError(f"vertices need an '{ID}' column, got {self.vertices.columns}")
        missing = [c for c in (SRC, DST) if c not in self.edges.columns]
        if missing:
            raise ValueError(f"edges need columns {missing}, got {self.edges.columns}")
        kinds = {c: t for c, t in (*self.vertices.dtypes, *self.edges.dtypes) if c in (ID, SRC, DST)}
        if (kinds[ID] == "string") != (kinds[SRC] == "string") or (kinds[SRC] == "string") != (kinds[DST] == "string"):
            raise ValueError(f"ids are of different types: {kinds}")

    # ---- construction -------------------------------------------------
    @staticmethod
    def from_edges(edges: DataFrame) -> "Graph":
        """Vertices are the distinct endpoints of ``edges``."""
        from .operators.structure import vertices_of
        return Graph(vertices_of(edges), edges)

    @staticmethod
    def fromEdges(edges: DataFrame) -> "Graph":  # noqa: N802
        return Graph.from_edges(edges)

    # ---- views ---------------------------------------------------------
    @property
    def triplets(self) -> DataFrame:
        from .operators.structure import triplets
        return triplets(self)

    @property
    def in_degrees(self) -> DataFrame:
        from .operators.structure import in_degrees
        return in_degrees(self)

    @property
    def out_degrees(self) -> DataFrame:
        from .operators.structure import out_degrees
        return out_degrees(self)

    @property
    def degrees(self) -> DataFrame:
        from .operators.structure import degrees
        return degrees(self)

    # ---- subgraphs -------------------------------------------------------
    def filter_vertices(self, condition: Column | str) -> "Graph":
        from .operators.structure import filter_vertices
        return filter_vertices(self, condition)

    def filter_edges(self, condition: Column | str) -> "Graph":
        from .operators.structure import filter_edges
        return filter_edges(self, condition)

    def drop_isolated_vertices(self) -> "Graph":
        from .operators.structure import drop_isolated_vertices
        return drop_isolated_vertices(self)

    # ---- algorithms ------------------------------------------------------
    def page_rank(self, **kw) -> "Graph":
        from .operators.pagerank import page_rank
        return page_rank(self, **kw)

    def parallel_personalized_page_rank(self, **kw) -> DataFrame:
        from .operators.pagerank import parallel_personalized_page_rank
        return parallel_personalized_page_rank(self, **kw)

    def shortest_paths(self, landmarks, **kw) -> DataFrame:
        from .operators.paths import shortest_paths
        return shortest_paths(self, landmarks, **kw)

    def bfs(self, from_expr=None, to_expr=None, fromExpr=None, toExpr=None,  # noqa: N803
            edgeFilter=None, maxPathLength=None, **kw) -> DataFrame:  # noqa: N803
        from .operators.paths import bfs
        if edgeFilter is not None:
            kw["edge_filter"] = edgeFilter
        if maxPathLength is not None:
            kw["max_path_length"] = maxPathLength
        return bfs(self, from_expr if from_expr is not None else fromExpr,
                   to_expr if to_expr is not None else toExpr, **kw)

    def path_counts(self, from_expr, **kw) -> DataFrame:
        from .operators.paths import path_counts
        return path_counts(self, from_expr, **kw)

    def triangle_count(self) -> DataFrame:
        from .operators.triangles import triangle_count
        return triangle_count(self)

    def connected_components(self, **kw) -> DataFrame:
        from .operators.components import connected_components
        return connected_components(self, **kw)

    def strongly_connected_components(self, **kw) -> DataFrame:
        from .operators.components import strongly_connected_components
        return strongly_connected_components(self, **kw)

    def label_propagation(self, max_iter: int, **kw) -> DataFrame:
        from .operators.communities import label_propagation
        return label_propagation(self, max_iter, **kw)

    def power_iteration_clustering(self, k: int, max_iter: int, weight_col=None,
                                   init_mode: str = "random") -> DataFrame:
        from .operators.communities import power_iteration_clustering
        return power_iteration_clustering(self, k, max_iter, weight_col, init_mode)

    def aggregate_messages(self, *aggs, send_to_src=None, send_to_dst=None) -> DataFrame:
        from .operators.messages import aggregate_messages
        return aggregate_messages(self, *aggs, send_to_src=send_to_src, send_to_dst=send_to_dst)

    @property
    def pregel(self):
        from .operators.messages import Pregel
        return Pregel(self)

    def find(self, pattern: str) -> DataFrame:
        from .operators.motif import find
        return find(self, pattern)

    def svd_plus_plus(self, **kw):
        from .operators.svdpp import svd_plus_plus
        return svd_plus_plus(self, **kw)

    # ---- camelCase spellings (the usual graph-library call style) ----------
    @property
    def inDegrees(self) -> DataFrame:  # noqa: N802
        return self.in_degrees

    @property
    def outDegrees(self) -> DataFrame:  # noqa: N802
        return self.out_degrees

    def filterVertices(self, condition) -> "Graph":  # noqa: N802
        return self.filter_vertices(condition)

    def filterEdges(self, condition) -> "Graph":  # noqa: N802
        return self.filter_edges(condition)

    def dropIsolatedVertices(self) -> "Graph":  # noqa: N802
        return self.drop_isolated_vertices()

    def pageRank(self, resetProbability: float = 0.15, sourceId=None, maxIter=None,  # noqa: N802
                 tol=None) -> "Graph":
        return self.page_rank(reset_probability=resetProbability, source_id=sourceId,
                              max_iter=maxIter, tol=tol)

    def parallelPersonalizedPageRank(self, resetProbability: float = 0.15,  # noqa: N802
                                     sourceIds=None, maxIter: int = 10) -> DataFrame:
        """Vertices with a ``pageranks`` vector: one entry per source, in the order given."""
        from pyspark.ml.functions import array_to_vector
        sources = list(sourceIds or [])
        long = self.parallel_personalized_page_rank(
            source_ids=sources, reset_probability=resetProbability, max_iter=maxIter)
        per = long.groupBy(ID).agg(F.map_from_entries(F.collect_list(F.struct("source", "pagerank"))).alias("_r"))
        kind = dict(self.vertices.dtypes)[ID]
        ranks = F.transform(F.array(*(F.lit(s).cast(kind) for s in sources)),
                            lambda s: F.coalesce(F.try_element_at("_r", s), F.lit(0.0)))
        empty = F.array(*(F.lit(0.0) for _ in sources))
        return (self.vertices.join(per, ID, "left")
                .withColumn("pageranks", array_to_vector(F.coalesce(ranks, empty))).drop("_r"))

    def shortestPaths(self, landmarks) -> DataFrame:  # noqa: N802
        """Vertices with a ``distances`` map, as the map-valued call returns."""
        from .operators.paths import distances_map
        return distances_map(self, self.shortest_paths(list(landmarks)))

    def triangleCount(self) -> DataFrame:  # noqa: N802
        return self.triangle_count()

    def connectedComponents(self, algorithm: str = "graphframes",  # noqa: N802
                            checkpointInterval: int = 2, broadcastThreshold: int = 1_000_000) -> DataFrame:
        """``algorithm``: "graphframes" (large-star rounds) or "graphx" (falling labels).

        ``broadcastThreshold`` is accepted for compatibility: joins are planned
        from measured sizes.
        """
        names = {"graphframes": "large_star", "graphx": "min_label"}
        return self.connected_components(algorithm=names.get(algorithm, algorithm),
                                         checkpoint_interval=max(1, checkpointInterval))

    def stronglyConnectedComponents(self, maxIter: int | None = None) -> DataFrame:  # noqa: N802
        return self.strongly_connected_components(max_iter=maxIter)

    def labelPropagation(self, maxIter: int) -> DataFrame:  # noqa: N802
        return self.label_propagation(maxIter)

    def aggregateMessages(self, *aggs, sendToSrc=None, sendToDst=None) -> DataFrame:  # noqa: N802
        return self.aggregate_messages(*aggs, send_to_src=sendToSrc, send_to_dst=sendToDst)

    def powerIterationClustering(self, k: int, maxIter: int, weightCol=None) -> DataFrame:  # noqa: N802
        return self.power_iteration_clustering(k, maxIter, weightCol)

    def svdPlusPlus(self, rank: int = 10, maxIter: int = 2, minValue: float = 0.0,  # noqa: N802
                    maxValue: float = 5.0, gamma1: float = 0.007, gamma2: float = 0.007,
                    gamma6: float = 0.005, gamma7: float = 0.015):
        return self.svd_plus_plus(rank=rank, max_iter=maxIter, min_value=minValue,
                                  max_value=maxValue, gamma1=gamma1, gamma2=gamma2,
                                  gamma6=gamma6, gamma7=gamma7)

    # ---- storage -----------------------------------------------------------
    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> "Graph":
        return Graph(self.vertices.persist(level), self.edges.persist(level))

    def cache(self) -> "Graph":
        return self.persist()

    def unpersist(self, blocking: bool = False) -> "Graph":
        self.vertices.unpersist(blocking)
        self.edges.unpersist(blocking)
        return self

    def checkpoint(self, eager: bool = True) -> "Graph":
        """Reliable checkpoint of both tables into the session's checkpoint folder."""
        from .session import checkpoint_dir
        checkpoint_dir(self.vertices.sparkSession)
        return Graph(self.vertices.checkpoint(eager), self.edges.checkpoint(eager))


def result_base(g: Graph, materialized_ids: DataFrame) -> DataFrame:
    """The vertex table to attach a result column to.

    When the vertices carry nothing but ``id``, the ids an operator already
    materialised are used, so the (possibly expensive) vertex plan is not run
    again; otherwise the user's vertices keep all their attributes.
    """
    return materialized_ids if g.vertices.columns == [ID] else g.vertices


def id_type_of(g: Graph):
    return g.vertices.schema[ID].dataType


def ids(df: DataFrame, col: str = ID) -> DataFrame:
    return df.select(F.col(col).alias(ID))
