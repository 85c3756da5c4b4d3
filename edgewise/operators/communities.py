"""Community detection: label propagation and power iteration clustering.

Label propagation is synchronous: every vertex starts with its own id,
receives the label of each neighbour over each incident edge (both
directions, parallel edges count separately) and takes the most frequent
one.  Ties go to the smallest label (pinned; the classic library breaks
them arbitrarily).  A vertex without neighbours keeps its label.

The state holds only vertices with neighbours, so a round is one join of
the laid-out edges with it and two aggregations, without a join against the
whole vertex table.  Votes are counted with two aggregations, ``(id, label) -> count`` then
``id -> min_by(label, (-count, label))``, both with map-side partial
aggregation, so a hub never gathers its neighbour list in one place.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import DST, ID, SRC, Graph, result_base
from ..plans.blocks import CellEdges, doubles, numbered, rows_of, values_of, vectors, wide_rows
from ..plans.iterate import StepCutter
from ..plans.skew import KeyedEdges

# ship the task functions by value: executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def label_propagation(g: Graph, max_iter: int, checkpoint_interval: int = 2) -> DataFrame:
    """Vertices with a ``label`` column after ``max_iter`` synchronous rounds."""
    cutter = StepCutter(checkpoint_interval)
    try:
        vids, n, pairs, _ = cutter.graph_inputs(g.vertices, g.edges, [ID], [SRC, DST])
        sym = (pairs.select(F.col(SRC).alias("a"), F.col(DST).alias("b"))
               .unionAll(pairs.select(F.col(DST).alias("a"), F.col(SRC).alias("b"))))
        sym, m = cutter.inputs(sym)
        layout = KeyedEdges(sym, "a", "b", cutter=cutter, total_edges=m,
                            vertex_count=n).persist(cutter)
        # Every vertex with a neighbour receives votes in every round, so the
        # new labels are exactly the vote winners; a vertex missing from the
        # state (before the first round, or isolated) carries its own id.
        id_type = g.vertices.schema[ID].dataType.simpleString()
        labels = vids.sparkSession.createDataFrame([], f"{ID} {id_type}, label {id_type}")
        for _ in range(max_iter):
            votes = (layout.attach(labels, ID, how="left")
                     .select("b", F.coalesce(F.col("label"), F.col("a")).alias("label"))
                     .groupBy(F.col("b").alias(ID), "label").agg(F.count(F.lit(1)).alias("_n")))
            best = votes.groupBy(ID).agg(
                F.min_by("label", F.struct((-F.col("_n")).alias("k"), F.col("label").alias("l")))
                .alias("label"))
            labels, _ = cutter.cut(best)
        out = (result_base(g, vids).join(labels, ID, "left")
               .withColumn("label", F.coalesce(F.col("label"), F.col(ID))))
        cutter.close(keep=[labels])
        return out
    finally:
        cutter.close(keep=[labels] if "labels" in locals() else [])


def power_iteration_clustering(g: Graph, k: int, max_iter: int = 20, weight_col: str | None = None,
                               init_mode: str = "random") -> DataFrame:
    """``id, cluster`` by power iteration clustering (Lin & Cohen), as Spark ML defines it.

    Edges are read as undirected similarities (non-negative weights; 1.0
    when ``weight_col`` is None); the weights of a pair, in either direction,
    add up.  Ids must be integral.  The row-normalised similarities are multiplied
    ``max_iter`` times with a value per vertex (fewer when the change settles), and
    Spark ML's k-means parts the values.  ``init_mode`` "random" starts from normal
    values drawn by a hash of the id, "degree" from the degrees, so reruns start alike.

    The edges lie in cells (``plans.blocks``), and a step moves vectors of blocks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    if dict(g.edges.dtypes)[SRC] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("power iteration clustering needs integral ids")
    if init_mode not in ("random", "degree"):
        raise ValueError(f"unknown init_mode {init_mode!r}: use 'random' or 'degree'")
    spark = g.edges.sparkSession
    cutter = StepCutter()
    w = F.col("w")
    wrong = w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))
    try:
        pairs = (g.edges.where(F.col(SRC) != F.col(DST))
                 .groupBy(F.least(SRC, DST).cast("long").alias("src"), F.greatest(SRC, DST).cast("long").alias("dst"))
                 .agg(F.sum((F.col(weight_col) if weight_col else F.lit(1.0)).cast("double")).alias("w")))
        pairs, told = cutter.cut(pairs, {"n": F.count(F.lit(1)), "wrong": F.count_if(wrong)}, reliable=True)
        if told["wrong"]:
            raise ValueError(f"{told['wrong']} pairs have a similarity that is negative, missing or not finite")
        if not told["n"]:
            return spark.createDataFrame([], "id long, cluster int")
        ids, n = cutter.inputs(pairs.select(F.col("src").alias(ID)).union(pairs.select(F.col("dst").alias(ID))).distinct())
        places = numbered(cutter, ids, n)
        cells = CellEdges(cutter, pairs, places, told["n"], symmetric=True)
        ones, _ = cutter.cut(vectors(places.withColumn("v", F.lit(1.0)), "v"), reliable=True)
        drawn = None
        if init_mode == "random":
            drawn, _ = cutter.cut(vectors(places.withColumn("v", _normal(ID)), "v"), reliable=True)
        with wide_rows(spark):
            last = _power_iteration(cutter, cells, ones, drawn, n, max_iter)
            points, _ = cutter.cut(values_of(last, places), reliable=True)
    finally:
        cutter.close()
    points = points.select(ID, array_to_vector(F.array("v")).alias("_v"))
    held = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = KMeans(k=k, seed=0, maxIter=20, featuresCol="_v", predictionCol="cluster", solver="row").fit(held)
    finally:
        held.unpersist(blocking=False)
    return model.transform(points).select(ID, "cluster")


def _normal(col: str) -> Column:
    """A standard normal value drawn by a hash of the column."""
    def uniform(salt):  # above 0 and below 1
        return (F.shiftrightunsigned(F.xxhash64(col, F.lit(salt)), 12) + 0.5) / float(1 << 52)

    return F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(2.0 * np.pi * uniform(2))


def _power_iteration(cutter: StepCutter, cells: CellEdges, ones: DataFrame, start: DataFrame | None, n: int, max_iter: int) -> DataFrame:
    """Vectors (``_b, v``) after the steps of the power iteration from ``start`` (None: the degrees), each scaled to a
    sum of sizes of 1."""
    def sizes(batches):
        for r in rows_of(batches):
            yield pa.RecordBatch.from_pydict({"_b": [r["_b"]], "v": [r["v"]], "size": [float(np.abs(doubles(r["v"])).sum())]})

    def step(scale):
        def run(batches):
            for r in rows_of(batches):
                d, x = np.maximum(doubles(r["d"]), np.finfo(float).eps), doubles(r["x"]) * scale
                v = doubles(r["v"]) * scale / d
                yield pa.RecordBatch.from_pydict({"_b": [r["_b"]], "v": [v.tobytes()], "x": [x.tobytes()],
                                                  "size": [float(np.abs(v).sum())]})
        return run

    def moved(norm):
        def run(batches):
            for r in rows_of(batches):
                v, x = doubles(r["v"]), doubles(r["x"])
                yield pa.RecordBatch.from_pydict({"delta": [float(np.abs(v / norm - x).sum())],
                                                  "xv": [float(x @ v)], "xx": [float(x @ x)]})
        return run

    normed = "_b long, v binary, size double"
    degrees, _ = cutter.cut(cells.times(ones), reliable=True)
    start = degrees if start is None else start
    now, told = cutter.cut(start.mapInArrow(sizes, normed), {"size": F.sum("size")}, reliable=True)
    tol = max(1e-5 / n, 1e-8)
    before = change = float("inf")
    for _ in range(max_iter):
        if not change > tol:
            break
        new = (cells.times(now).join(degrees.withColumnRenamed("v", "d"), "_b")
               .join(now.select("_b", F.col("v").alias("x")), "_b").select("_b", "v", "d", "x")
               .mapInArrow(step(1.0 / told["size"]), "_b long, v binary, x binary, size double"))
        now, told = cutter.cut(new, {"size": F.sum("size")}, reliable=True)
        seen = now.select("v", "x").mapInArrow(moved(told["size"]), "delta double, xv double, xx double")
        delta, xv, xx = seen.agg(F.sum("delta"), F.sum("xv"), F.sum("xx")).first()
        change = abs(delta - before)
        if change < tol and abs(told["size"] - abs(xv / xx)) > tol:
            raise RuntimeError("the power iteration does not converge: two eigenvalues of equal size and opposite sign")
        before = delta
    scale = 1.0 / told["size"]

    def scaled(batches):
        for r in rows_of(batches):
            yield pa.RecordBatch.from_pydict({"_b": [r["_b"]], "v": [(doubles(r["v"]) * scale).tobytes()]})

    last, _ = cutter.cut(now.mapInArrow(scaled, "_b long, v binary"), reliable=True)
    return last
