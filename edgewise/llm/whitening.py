"""Embedding whitening by a weighted multiplicity covariance.

Vectors are put on an integer grid (``x = floor(64 * c) + 1000000``), and rows with
identical x are grouped: a distinct vector is fitted once with a weight, its number of
copies (``weights="count"``) or one (``weights="one"``), whitened once, and joined back
to its rows by a SHA-256 of x. The fit is two passes over the distinct vectors: exact
integer sums, then a weighted centred matrix product, in which a task adds up one
matrix of dimension squared and Spark sums the tasks' matrices entry by entry. Only
that matrix reaches the driver, whose eigenvectors are the components.

Centring is exact before any rounding: ``n * x - S`` is formed in whole numbers. The
result holds one row per kept input row and component; ``identity_error`` comes from
a further pass that measures the covariance of the whitened vectors themselves.

Defined cases: a row whose vector is null, empty or holds a null, NaN or infinite
entry is left out, as is one whose length is not the most frequent (the longer one of
ties) among the others; a null id stays null and repeated rows stay; components
without variance (an eigenvalue of at most 1e-13 of the trace) do not exist, so one
distinct vector alone gives no row, as an empty table does; extra columns are ignored.
Entries beyond 2^61 on the grid are put there. Whole numbers are exact at any size: a
task falls back on Python's where 64 bits are too few; a deviation of more than 38
digits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare_batches, staged

#: fixed values of the grid
SCALE, OFFSET = 64, 1_000_000
#: entries farther out on the grid are put here
FARTHEST = 1 << 61
#: components returned
COMPONENTS = 16
#: the least eigenvalue of a component, as a part of the trace
LEAST = 1e-13
#: vectors longer than this are refused: the driver holds a matrix of this many squared numbers
MOST_DIMENSIONS = 4096
#: limit under which sums of products of 64-bit whole numbers are exact
EXACT = float(1 << 62)


def gridded(embedding: str) -> Column:
    """x of a vector of floating-point numbers, within FARTHEST."""
    def x(c: Column) -> Column:
        far = F.lit(float(FARTHEST))
        return F.floor(F.greatest(F.least(c.cast("double") * SCALE, far), -far)) + OFFSET
    return F.transform(embedding, x)


def keyed(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, key) of the rows that are kept."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.where((F.size("v") > 0) & finite)
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")) \
        .agg(F.max(F.struct("c", "d"))["d"]).first()[0] or 0
    if length > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {length} dimensions: at most {MOST_DIMENSIONS} fit the covariance")
    x = rows.where(F.size("v") == length).select("id", gridded("v").alias("x"))
    return x.withColumn("key", F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256)))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """x of each row, and the weights."""
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), batch.column("w").to_numpy(zero_copy_only=False)


def _summed(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray | None], value: str) -> list:
    """Entries 0, 1, ... of ``of`` of each batch, summed over all: one array a task, then a sum by entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(batch)
                total = part if total is None else total + part
        if total is not None:
            kind = pa.float64() if value == "double" else pa.string()
            entries = total if value == "double" else [str(v) for v in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(entries, kind)], names=["at", "v"])

    prepare_batches(df.sparkSession)
    out = df.mapInArrow(run, f"at int, v {'double' if value == 'double' else 'string'}")
    rows = out.groupBy("at").agg(F.sum(F.col("v").cast(value)).alias("v")).collect()
    return [v for _, v in sorted((r["at"], r["v"]) for r in rows)]


def _whole(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """n * x - S in whole numbers: of 64 bits where they are enough."""
    s = np.array(sums, dtype=object)
    small = all(abs(v) < EXACT for v in sums)

    def centred(x: np.ndarray) -> np.ndarray:
        if small and float(np.abs(x).max(initial=0)) * n < EXACT:
            return x * np.int64(n) - s.astype(np.int64)
        return x.astype(object) * n - s
    return centred


class Fit:
    """n, exact sums, eigenvalues (falling), unit eigenvectors as columns, and the trace."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of the rows (x, w), each counted w times; None without any row."""
    def totals(batch: pa.RecordBatch) -> np.ndarray:
        x, w = _arrays(batch)
        if float(np.abs(x).max(initial=0)) * float(w.sum()) < EXACT:
            s = (x * w[:, None]).sum(0)
        else:
            s = (x.astype(object) * w[:, None].astype(object)).sum(0)
        return np.array([int(w.sum()), *(int(v) for v in s)], dtype=object)

    sums = [int(v) for v in _summed(distinct, totals, "decimal(38,0)")]
    if not sums:
        return None
    n, sums = sums[0], sums[1:]
    centred = _whole(n, sums)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        x, w = _arrays(batch)
        y = centred(x).astype(np.float64) / n
        return ((y * w[:, None]).T @ y).ravel()

    d = len(sums)
    v = np.array(_summed(distinct, products, "double")).reshape(d, d) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(v))
    keep = [i for i in range(min(components, d)) if values[i] > LEAST * trace > 0]
    values, vectors = values[keep], vectors[:, keep]
    # a sign that does not depend on the solver: the largest entry is positive
    largest = np.abs(vectors).argmax(0) if keep else []
    return Fit(n, sums, values, vectors * np.sign([vectors[r, i] for i, r in enumerate(largest)]), trace)


def whitened(distinct: DataFrame, model: Fit) -> DataFrame:
    """(key, w, deviation, z): the exact squared distance of n * x from the sums, and the whitened vector."""
    centred, n = _whole(model.n, model.sums), model.n
    scale = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _ = _arrays(batch)
            y = centred(x)
            if y.dtype != object and (y.astype(np.float64) ** 2).sum(1).max() < EXACT:
                deviation = (y * y).sum(1).tolist()
            else:
                deviation = [int(v) for v in (y.astype(object) ** 2).sum(1)]
            z = (y.astype(np.float64) / n) @ scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("w"), pa.array([str(v) for v in deviation], pa.string()), lists],
                names=["key", "w", "deviation", "z"])

    out = distinct.select("key", "w", "x").mapInArrow(run, "key binary, w long, deviation string, z array<double>")
    return out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    def rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("z").flatten().to_numpy().reshape(-1, k), batch.column("w").to_numpy()[:, None]

    def totals(batch: pa.RecordBatch) -> np.ndarray:
        z, w = rows(batch)
        return (z * w).sum(0)

    mean = np.array(_summed(white, totals, "double")) / n

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z, w = rows(batch)
        return (((z - mean) * w).T @ (z - mean)).ravel()

    cov = np.array(_summed(white, products, "double")).reshape(k, k) / n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", weights: str = "one",
           components: int = COMPONENTS) -> DataFrame:
    """One row per kept row and component: id, component (from 1), n, deviation (exact decimal), whitened,
    explained and identity_error. ``n`` is the sum of the weights of the fit.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights are 'one' or 'count', not {weights!r}")
    spark = table.sparkSession
    rows = keyed(table, id_col, vector_col)
    w = F.count(F.lit(1)) if weights == "count" else F.lit(1).cast("long")
    distinct = staged(rows.groupBy("key").agg(F.first("x").alias("x"), w.alias("w")), "whiten-distinct")
    model = fit(distinct, components)
    kind = rows.schema["id"].dataType.simpleString()
    if model is None or not len(model.values):
        return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), "
                                         "whitened double, explained double, identity_error double")
    white = staged(whitened(distinct, model), "whiten-white")
    error = identity_error(white, model.n, len(model.values))
    each = staged(rows.select("id", "key"), "whiten-rows").join(white.select("key", "deviation", "z"), "key")
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
    return each.select("id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
