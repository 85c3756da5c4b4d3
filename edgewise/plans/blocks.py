"""A fixed weighted edge table multiplied again and again with a value per vertex, block by block.

A join per superstep moves one row per edge.  Here every vertex has a place in a block of at most
``BLOCK`` vertices (by a hash of its id, so that neighbouring ids part), and the edges from one block
into another form a cell.  Cells are written once as pieces of at most ``PIECE`` edges: places as
32-bit numbers, ordered by target.  A step brings each block's values to the pieces that leave it,
sums every piece by target inside the task, and sums these partial sums by block: one shuffle of at
most one value per edge, mostly far fewer, and no row per edge.

A task holds one piece, one block's values and one block's sums at a time, whatever the size of the
graph.  A vertex with any share of all edges has them spread over the cells of its block, which
``SPREAD`` groups divide among tasks.
"""

from __future__ import annotations

import sys
from contextlib import contextmanager
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .iterate import StepCutter
from .skew import join_hub_safe, shuffle_partitions

# ship the task functions by value: executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BITS = 18
BLOCK = 1 << BLOCK_BITS   # most vertices of a block
PIECE = 1 << 19           # most edges of a piece
SPREAD = 4                # groups of the cells that leave a block
SMALL, SMALL_PARTS = 1 << 14, 24  # small graphs get blocks of this size, up to so many, to be dealt over tasks
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def wide_rows(spark: SparkSession, rows: int = 4):
    """Few rows per Arrow batch while tables of pieces and blocks are read (MBs a row)."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def _runs(batches, keys, columns, most=None):
    """Consecutive rows of equal whole-number ``keys``: the key and one array per column, at most ``most`` rows."""
    now, held, n = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for a, z in zip([0, *cuts], [*cuts, batch.num_rows]):
            this = tuple(key[:, a].tolist())
            if now is not None and (this != now or most and n >= most):
                yield now, [np.concatenate(c) for c in zip(*held)]
                held, n = [], 0
            now = this
            held.append([c[a:z] for c in cols])
            n += z - a
    if now is not None:
        yield now, [np.concatenate(c) for c in zip(*held)]


def _row(**values) -> pa.RecordBatch:
    """One row: whole numbers and floats as they are, arrays as their bytes."""
    cols = {k: pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray)
            else pa.array([v], pa.int64() if isinstance(v, int) else pa.float64()) for k, v in values.items()}
    return pa.RecordBatch.from_pydict(cols)


def rows_of(batches):
    """Rows of Arrow batches, one dict each."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            yield {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}


def doubles(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64)


def numbered(cutter: StepCutter, ids: DataFrame, n: int) -> DataFrame:
    """``id, _b, _i``: block and place of each of ``n`` distinct ids. Places of a block run from 0."""
    parts = max(1, min(SMALL_PARTS, ceil(n / SMALL)), ceil(n / (BLOCK * 0.75)))
    at = F.monotonically_increasing_id()
    out, _ = cutter.cut(ids.select("id").repartition(parts, "id").sortWithinPartitions("id")
                        .select("id", at.alias("_at"))
                        .select("id", F.shiftright("_at", BLOCK_BITS).alias("_b"),
                                F.col("_at").bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("_i")), reliable=True)
    return out


def vectors(rows: DataFrame, value: str) -> DataFrame:
    """``_b, v``: the values of each block in the order of places, from one row ``_b, _i, value`` for each vertex."""
    def run(batches):
        for (b,), (i, x) in _runs(batches, [0], [1, 2]):
            v = np.zeros(int(i[-1]) + 1)
            v[i] = x
            yield _row(_b=b, v=v)

    dealt = rows.select("_b", "_i", F.col(value).cast("double").alias("x"))
    return dealt.repartition(shuffle_partitions(rows.sparkSession), "_b").sortWithinPartitions("_b", "_i").mapInArrow(run, "_b long, v binary")


def values_of(vecs: DataFrame, places: DataFrame) -> DataFrame:
    """``id, v`` from ``_b, v``, the inverse of :func:`vectors`."""
    def run(batches):
        for r in rows_of(batches):
            v = doubles(r["v"])
            for a in range(0, len(v), 10000):
                part = v[a:a + 10000]
                yield pa.RecordBatch.from_pydict({"_b": pa.array(np.full(len(part), r["_b"])), "v": pa.array(part),
                                                  "_i": pa.array(np.arange(a, a + len(part), dtype=np.int32))})

    return places.join(vecs.select("_b", "v").mapInArrow(run, "_b long, v double, _i int"), ["_b", "_i"]).select("id", "v")


class CellEdges:
    """Weighted edges ``src, dst, w`` in cells, to be multiplied with vectors (``_b, v``) of the places' blocks."""

    def __init__(self, cutter: StepCutter, edges: DataFrame, places: DataFrame, total: int, symmetric: bool = False):
        self.spark = edges.sparkSession
        self.partitions = shuffle_partitions(self.spark)
        e = join_hub_safe(edges, "src", places.select(F.col("id").alias("src"), F.col("_b").alias("_sb"), F.col("_i").alias("_si")), total)
        e = join_hub_safe(e, "dst", places.select(F.col("id").alias("dst"), F.col("_b").alias("_tb"), F.col("_i").alias("_ti")), total)
        e = e.select("_sb", "_tb", "_si", "_ti", "w")
        if symmetric:  # both directions of an edge, whose ends are looked up once
            way = F.array(F.struct("_sb", "_tb", "_si", "_ti"),
                          F.struct(F.col("_tb").alias("_sb"), F.col("_sb").alias("_tb"), F.col("_ti").alias("_si"), F.col("_si").alias("_ti")))
            e = e.select(F.explode(way).alias("e"), "w").select("e.*", "w")

        def pack(batches):
            for (sb, tb), (si, ti, w) in _runs(batches, [0, 1], [2, 3, 4], PIECE):
                order = np.argsort(ti, kind="stable")
                ti, w = ti[order], w[order]
                first = np.flatnonzero(np.r_[True, ti[1:] != ti[:-1]])
                yield _row(_sb=sb, _tb=tb, si=si[order].astype(np.int32), at=ti[first].astype(np.int32),
                           first=first.astype(np.int32), w=w[:1] if (w == w[0]).all() else w)

        cell = ["_sb", "_g"]
        group = F.pmod(F.xxhash64("_tb"), F.lit(SPREAD)).cast("int").alias("_g")
        pieces = (e.repartition(self.partitions, "_sb", group).sortWithinPartitions("_sb", "_tb")
                  .mapInArrow(pack, "_sb long, _tb long, si binary, at binary, first binary, w binary"))
        pieces, _ = cutter.cut(pieces, reliable=True)
        # dealt and sorted once, so that a step moves the values only
        self.pieces = cutter.keep(pieces.select("*", group).repartition(self.partitions, *cell).sortWithinPartitions(*cell))
        self.pieces.count()

    def times(self, vecs: DataFrame) -> DataFrame:
        """``_b, v``: for each target the sum of weight times the source's value; blocks without incoming edges are left out."""
        def multiply(batches):
            for r in rows_of(batches):
                x = doubles(r["v"])[np.frombuffer(r["si"], np.int32)] * doubles(r["w"])
                yield pa.RecordBatch.from_pydict({
                    "_b": pa.array([r["_tb"]], pa.int64()), "at": pa.array([r["at"]], pa.binary()),
                    "v": pa.array([np.add.reduceat(x, np.frombuffer(r["first"], np.int32)).tobytes()], pa.binary())})

        def add(batches):
            now, most = None, 0
            for r in rows_of(batches):
                if r["_b"] != now:
                    if now is not None:
                        yield _row(_b=now, v=acc[:most])
                    now, acc, most = r["_b"], np.zeros(BLOCK), 0
                at = np.frombuffer(r["at"], np.int32)
                acc[at] += doubles(r["v"])
                most = max(most, int(at[-1]) + 1)
            if now is not None:
                yield _row(_b=now, v=acc[:most])

        sent = vecs.select(F.col("_b").alias("_sb"), "v", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_g"))
        # never broadcast: a vector is as long as the vertices are many
        parts = (self.pieces.join(sent.hint("merge"), ["_sb", "_g"]).select("_tb", "si", "at", "first", "w", "v")
                 .mapInArrow(multiply, "_b long, at binary, v binary"))
        return parts.repartition(self.partitions, "_b").sortWithinPartitions("_b").mapInArrow(add, "_b long, v binary")
