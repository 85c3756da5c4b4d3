"""Weighted edges dealt over a grid of cells, where a step meets both ends' values.

Ids fall into blocks by a hash, ``rows`` of them for sources and ``cols`` for targets; the edges from
one block into another are a cell. A step sends the value of an end once to each cell that holds
edges of it, not once for each edge, and each cell gives one partial sum for an end. The blocks are
as many as keep the ends of a cell at about ``2 * BLOCK`` and its edges at about ``PIECE``, even if
all edges have one end. A task holds the ends of a cell and ``SLICE`` edges at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import shuffle_partitions

# ship the task functions by value: executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 20   # most ids of a block, about
PIECE = 1 << 25   # most edges of a cell, about
SIDE = 5          # least blocks a side, to be dealt over tasks
CHUNK = 512       # edges of a written row
SLICE = 1 << 17   # edges that a task looks at at once, at least
MASK = 62         # bits that say which cells an end goes to
ROWS = 1 << 11    # rows of an Arrow batch


class Grid:
    """``rows`` x ``cols`` cells for ``edges`` edges of about ``sources`` and ``targets`` ids."""

    def __init__(self, edges: int, sources: int, targets: int):
        least = max(SIDE, ceil(edges / PIECE))
        self.rows, self.cols = max(least, ceil(sources / BLOCK)), max(least, ceil(targets / BLOCK))

    def row(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.rows)).cast("int")

    def col(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.cols)).cast("int")

    @staticmethod
    def bit(block: Column) -> Column:
        """The bit of a block; :meth:`sent` takes their union over an end's edges."""
        one = F.lit(1).cast("long")
        return F.call_function("shiftleft", one, F.pmod(block, F.lit(MASK)))

    def sent(self, values: DataFrame, key: Column, mask: str, kind: int) -> DataFrame:
        """(v, vec) rows for the cells that hold edges of v; ``kind`` 0: v is a source, 1: a target."""
        n = self.rows if kind else self.cols
        other = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.call_function(
            "shiftright", F.col(mask), F.pmod(b, F.lit(MASK))).bitwiseAND(F.lit(1).cast("long")) == 1)
        own = self.col(key) if kind else self.row(key)
        # a null id is the end of no edge of a cell
        dealt = values.where(key.isNotNull()).select("v", "vec", own.alias("_own"), F.explode(other).alias("_other"))
        cell = F.col("_other") * self.cols + F.col("_own") if kind else F.col("_own") * self.cols + F.col("_other")
        return dealt.select(cell.cast("int").alias("cell"), F.lit(kind).alias("kind"), "v", "vec")


def packed(edges: DataFrame) -> DataFrame:
    """(cell, a, b, w) edges as rows of at most ``CHUNK`` edges of a cell, in the order of ``a``."""
    rows = edges.select("cell", "a", "b", "w").repartition(shuffle_partitions(edges.sparkSession), "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            if not len(cell):
                continue
            cuts = np.flatnonzero(np.diff(cell)) + 1
            at = sorted({0, len(cell), *cuts.tolist(), *(x for lo, hi in zip([0, *cuts], [*cuts, len(cell)], strict=True)
                                                         for x in range(lo, hi, CHUNK))})
            a, b = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            w = batch.column(3).fill_null(0.0).to_numpy()
            ok = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            two = list(zip(at[:-1], at[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(cell[i]) for i, _ in two], pa.int32()), pa.array([int(a[i]) for i, _ in two], pa.int64()),
                 *(pa.array([x[i:j].tobytes() for i, j in two], pa.binary()) for x in (a, b, w, ok))],
                names=["cell", "v", "a", "b", "w", "ok"])

    return rows.sortWithinPartitions("cell", "a").mapInArrow(run, "cell int, v long, a binary, b binary, w binary, ok binary")


def summed(keys: np.ndarray, ok: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(keys, how many are ok, sums of the values that are) of ``keys`` in order."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sums = (np.add.reduceat(np.where(ok.reshape(-1, *[1] * (x.ndim - 1)), x, 0.0), first, axis=0) for x in values)
    return keys[first], np.add.reduceat(ok.astype(np.int64), first), *sums


def arrays(values: np.ndarray, ok: np.ndarray) -> pa.Array:
    """Rows of ``values`` as lists; null where not ok."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.ravel()),
                                    mask=pa.array(~ok))


class Side:
    """Ids of a cell with their values."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rank: int):
        self.ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        self.ok = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, bool)
        self.values = np.concatenate([p[2] for p in parts]) if parts else np.zeros((0, rank))

    def places(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, ids), max(0, len(self.ids) - 1))
        if not len(self.ids) or (self.ids[at] != ids).any():
            raise RuntimeError("an end of an edge came without its value")
        return at


def step(grid_edges: DataFrame, sides: list[DataFrame], widths: tuple[int, int], begin: Callable, schema: str) -> DataFrame:
    """What ``begin(source side, target side)`` makes of each cell: two functions, one that gives batches for a
    slice of edges (a, b, w, ok), in the order of a, one that gives those at the end of the cell.
    ``widths`` are the lengths of the values of sources and of targets."""
    empty = [F.lit(None).cast("binary").alias(c) for c in ("a", "b", "w", "ok")]
    rows = grid_edges.select("cell", F.lit(2).alias("kind"), "v", F.lit(None).cast("array<double>").alias("vec"), "a", "b", "w", "ok")
    for side in sides:
        rows = rows.unionByName(side.select("cell", "kind", "v", "vec", *empty))
    rows = rows.repartition(shuffle_partitions(grid_edges.sparkSession), "cell").sortWithinPartitions("cell", "kind", "v")

    def values(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vec = batch.column(3)
        ok = vec.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((len(ok), width))
        out[ok] = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        return batch.column(2).to_numpy(), ok, out

    def joined(col: pa.Array, kind) -> np.ndarray:
        return np.frombuffer(b"".join(col.to_pylist()), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held, work = None, ([], []), [], None

        def edges():
            nonlocal held
            if held:
                cols = [np.concatenate([h[i] for h in held]) for i in range(4)]
                held = []
                yield from work[0](*cols)

        def end():
            if work:
                yield from edges()
                yield from work[1]()

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = (np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                if cell[lo] != now:
                    yield from end()
                    now, parts, held, work = cell[lo], ([], []), [], None
                part = batch.slice(lo, hi - lo)
                if kind[lo] < 2:
                    parts[kind[lo]].append(values(part, widths[kind[lo]]))
                    continue
                if work is None:
                    work, parts = begin(*map(Side, parts, widths)), ([], [])
                held.append([joined(part.column(4), np.int64), joined(part.column(5), np.int64),
                             joined(part.column(6), np.float64), joined(part.column(7), bool)])
                if sum(len(h[0]) for h in held) >= SLICE:
                    yield from edges()
        yield from end()

    return rows.mapInArrow(run, schema)
