"""SVD++ collaborative filtering (Koren, 2008) as synchronous DataFrame steps.

Edges are ratings ``src`` (user) -> ``dst`` (item) with the value in
``weight``.  Every vertex holds two factor arrays, a bias and
``norm = 1/sqrt(degree)``; users use ``f1`` as p, items use ``f1`` as q and
``f2`` as y.  One iteration:

1. each user's implicit term ``imp = p + norm * sum(y of its items)``;
2. per rating: ``pred = clamp(mu + b_u + b_i + q . imp)``, ``err = r - pred``;
   both ends get the sums of ``err`` and of ``err`` times the other end's factors,
   in one pass over the ratings;
3. every vertex adds its gradient step (gamma1 for biases, gamma2 for factors,
   gamma6 / gamma7 regularisation, which is its own value times its ratings).

The ratings lie in a grid of cells (``plans.grid``), written once. An iteration
sends each vertex's values to the cells that hold ratings of it, and each cell
gives a partial sum for a vertex, so what is moved is a few rows a vertex, not a
row of factors a rating, and a popular item is reduced inside every cell. The
steps of a user and of an item are summed apart, so a user carries no array for
the ``y`` that only items move. An id that is user and item at once gets both sums.

Factors start from plain whole-number
arithmetic on the id and the position (:func:`start_value`), so runs are
reproducible and any SQL engine can repeat them.  Returns the vertices with
``column1`` .. ``column4`` (f1, f2, bias, norm) and the mean rating.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import array_add, array_axpy, array_dot
from ..graph import DST, ID, SRC, Graph
from ..plans.blocks import wide_rows
from ..plans.grid import ROWS, Grid, Side, arrays, packed, step, summed
from ..plans.iterate import StepCutter
from ..plans.skew import join_hub_safe

# ship the task functions by value: executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_dot = array_dot
_axpy = array_axpy
#: modulus and factors of the start values
START_MOD, START_ID, START_AT, START_TAG = 10007, 7919, 104729, 1299709


def start_value(id_: Column, at: int, tag: int) -> Column:
    """A value in [0, 1) of an id's ``at``-th factor (``tag`` 1: f1, 2: f2): a number modulo 10007."""
    key = id_ if isinstance(id_, Column) else F.col(id_)
    mixed = F.pmod(key, F.lit(START_MOD)) * START_ID + (at + 1) * START_AT + tag * START_TAG
    return F.pmod(F.pmod(mixed, F.lit(START_MOD)) * F.pmod(mixed, F.lit(START_MOD)) + at, F.lit(START_MOD)) / F.lit(float(START_MOD))


def _init(rank: int, tag: int, integral: bool) -> Column:
    # an explicit array, not transform(sequence, lambda): a lambda over an outer
    # column confuses constraint inference on the checkpointed state
    key = F.col(ID).cast("long") if integral else F.crc32(F.col(ID).cast("string").cast("binary"))
    return F.array(*[start_value(key, k, tag) for k in range(rank)])


def _sum_arrays(partial: DataFrame, rank: int) -> DataFrame:
    """(v, y): element-wise sums of the partial arrays ``s`` of length ``rank``."""
    summed_ = partial.groupBy("v").agg(*[F.sum(F.col("s")[k]).alias(f"_y{k}") for k in range(rank)])
    return summed_.select("v", F.array(*[F.col(f"_y{k}") for k in range(rank)]).alias("y"))


def _whole(values) -> Column:
    """An array without null elements, or null."""
    c = F.col(values) if isinstance(values, str) else values
    return F.when(~F.exists(c, lambda x: x.isNull()), c)


def _implicit():
    """Sums of the items' arrays for the users of a cell."""
    def begin(_, items: Side):
        def edges(a, b, w, ok):
            at = items.places(b)
            v, n, s = summed(a, items.ok[at], items.values[at])
            yield pa.RecordBatch.from_arrays([pa.array(v), arrays(s, n > 0)], names=["v", "s"])

        return edges, lambda: iter(())

    return begin


def _errors(rank: int, mu: float | None, least: float, most: float):
    """Sums of the errors of a cell's ratings for both ends, and of the errors times the other end's factors."""
    def rows(v, user, n, s, e, ew) -> pa.RecordBatch:
        none = n == 0
        return pa.RecordBatch.from_arrays(
            [pa.array(v), pa.array(np.full(len(v), user)), arrays(s, ~none), pa.array(e, mask=none), pa.array(ew, mask=none),
             pa.array(n)], names=["v", "user", "s", "e", "ew", "n"])

    def begin(users: Side, items: Side):
        n, sums = np.zeros(len(items.ids), np.int64), np.zeros((len(items.ids), rank + 2))
        seen = np.zeros(len(items.ids), bool)

        def edges(a, b, w, ok):
            x, y = users.places(a), items.places(b)
            ok = ok & users.ok[x] & items.ok[y] & (mu is not None)
            mine, other = users.values[x], items.values[y]
            pred = (mu or 0.0) + mine[:, rank + 1] + other[:, rank] + (other[:, :rank] * mine[:, :rank]).sum(axis=1)
            # as in SQL, not-a-number counts as the largest
            pred = np.where(np.isnan(pred), most, np.minimum(np.maximum(pred, least), most))
            err = w - pred
            v, k, s, e = summed(a, ok, err[:, None] * other[:, :rank], err)
            yield rows(v, True, k, s, e, e * 0.0)
            order = np.argsort(y, kind="stable")
            at, k, s = summed(y[order], ok[order], np.column_stack(
                [err[:, None] * mine[:, :rank], err, err * mine[:, rank]])[order])
            n[at] += k
            sums[at] += s
            seen[at] = True

        def end():
            if seen.any():
                yield rows(items.ids[seen], False, n[seen], sums[seen, :rank], sums[seen, rank], sums[seen, rank + 1])

        return edges, end

    return begin


def svd_plus_plus(g: Graph, rank: int = 10, max_iter: int = 2, min_value: float = 0.0,
                  max_value: float = 5.0, gamma1: float = 0.007, gamma2: float = 0.007,
                  gamma6: float = 0.005, gamma7: float = 0.015, checkpoint_interval: int = 2,
                  rating_col: str = "weight") -> tuple[DataFrame, float]:
    cutter = StepCutter(checkpoint_interval)
    try:
        edges = g.edges if g.edges.is_cached else cutter.keep(g.edges)
        # ids that the graph's edges give are read from the kept edges, not from their plan at the end
        base = cutter.cut(g.vertices, reliable=True)[0] if g.vertices.columns == [ID] else g.vertices
        e = edges.select(SRC, DST, F.col(rating_col).cast("double").alias("r"))
        told = e.agg(F.avg("r").alias("mu"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct(SRC).alias("users"),
                     F.approx_count_distinct(DST).alias("items")).first()
        mu, grid = told["mu"], Grid(told["n"], told["users"], told["items"])
        integral = dict(e.dtypes)[SRC] in ("tinyint", "smallint", "int", "bigint")
        key = lambda c: F.col(c).cast("long" if integral else "string")
        ends = e.select(F.posexplode(F.array(F.col(SRC), F.col(DST))).alias("_end", ID), "r",
                        grid.bit(grid.col(key(DST))).alias("_to_items"), grid.bit(grid.row(key(SRC))).alias("_to_users"))
        stats = ends.groupBy(ID).agg(F.count(F.lit(1)).alias("_n"), F.avg("r").alias("_avg"),
                                     *[F.bit_or(F.when(F.col("_end") == i, F.col(c)).otherwise(0)).alias(c)
                                       for i, c in enumerate(("_to_items", "_to_users"))])
        state = stats.select(ID, (F.col(ID).cast("long") if integral else F.monotonically_increasing_id()).alias("_v"),
                             "_to_items", "_to_users",
                             _init(rank, 1, integral).alias("f1"), _init(rank, 2, integral).alias("f2"),
                             (F.col("_avg") - F.lit(mu)).alias("bias"),
                             (F.lit(1.0) / F.sqrt(F.col("_n").cast("double"))).alias("norm"))
        state, _ = cutter.cut(state, reliable=True)
        placed = e.where(F.col(SRC).isNotNull() & F.col(DST).isNotNull()).select(
            (grid.row(key(SRC)) * grid.cols + grid.col(key(DST))).cast("int").alias("cell"), SRC, DST, F.col("r").alias("w"))
        for end, number in ((SRC, "a"), (DST, "b")):
            if integral:
                placed = placed.withColumn(number, F.col(end).cast("long"))
            else:
                numbers = state.select(F.col(ID).alias(end), F.col("_v").alias(number))
                placed = join_hub_safe(placed, end, numbers, told["n"])
        cells, _ = cutter.cut(packed(placed), reliable=True)
        if edges is not g.edges:
            cutter.release(edges)
        for _ in range(max_iter):
            with wide_rows(e.sparkSession, ROWS):
                # 1. implicit term per user
                y = grid.sent(state.select("_v", ID, "_to_users", F.col("_v").alias("v"), _whole("f2").alias("vec")),
                              key(ID), "_to_users", 1)
                ysum, _ = cutter.cut(_sum_arrays(step(cells, [y], (0, rank), _implicit(), "v long, s array<double>"), rank),
                                     reliable=True)
                # the user's side as one array: implicit term, norm, bias
                side = F.concat(_axpy(F.col("norm"), F.col("y"), F.col("f1")), F.array("norm", "bias"))
                users = state.join(ysum, state["_v"] == ysum["v"]).select(ID, "_to_items", "v", _whole(side).alias("vec"))
                items = state.select(ID, "_to_users", F.col("_v").alias("v"), _whole(F.concat("f1", F.array("bias"))).alias("vec"))
                # 2. error per rating; both ends' sums in one pass: a rating's share of an end is the other's factors times it
                sides = [grid.sent(users, key(ID), "_to_items", 0), grid.sent(items, key(ID), "_to_users", 1)]
                sent = step(cells, sides, (rank + 2, rank + 1), _errors(rank, mu, min_value, max_value),
                            "v long, user boolean, s array<double>, e double, ew double, n long")
                sums = sent.groupBy("v", "user").agg(
                    *[F.sum(F.col("s")[k]).alias(f"_s{k}") for k in range(rank)],
                    F.sum("e").alias("e"), F.sum("ew").alias("ew"), F.sum("n").alias("n"))
                sums, _ = cutter.cut(sums.select(F.col("v").alias("_v"), "user", F.array(*[F.col(f"_s{k}") for k in range(rank)]).alias("s"),
                                                 "e", "ew", "n"), reliable=True)
            of_user = sums.where("user").select("_v", F.col("s").alias("us"), F.col("e").alias("ue"), F.col("n").alias("un"))
            of_item = sums.where("not user").select("_v", F.col("s").alias("is"), F.col("e").alias("ie"), F.col("ew").alias("iw"),
                                                    F.col("n").alias("in"))
            g2, g7 = F.lit(gamma2), F.lit(gamma7)
            # 3. every vertex's steps: the regularisation is its own value times its ratings
            new = state.join(of_user, "_v", "left").join(of_item, "_v", "left").select(
                *state.columns,
                F.zip_with("us", "f1", lambda x, p: (x - g7 * F.col("un") * p) * g2).alias("p1"),
                F.zip_with("is", "f1", lambda x, q: (x - g7 * F.col("in") * q) * g2).alias("q1"),
                F.when(F.col("is").isNotNull(), F.zip_with("f1", "f2", lambda q, y: (F.col("iw") * q - g7 * F.col("in") * y) * g2)).alias("q2"),
                ((F.col("ue") - F.lit(gamma6) * F.col("un") * F.col("bias")) * F.lit(gamma1)).alias("pb"),
                ((F.col("ie") - F.lit(gamma6) * F.col("in") * F.col("bias")) * F.lit(gamma1)).alias("qb"))

            def moved(old: str, *steps: str) -> Column:
                out = F.col(old)
                for s in steps:
                    out = F.when(F.col(s).isNull(), out).otherwise(array_add(out, s))
                return out

            new = new.select(ID, "_v", "_to_items", "_to_users", moved("f1", "p1", "q1").alias("f1"), moved("f2", "q2").alias("f2"),
                             (F.col("bias") + F.coalesce("pb", F.lit(0.0)) + F.coalesce("qb", F.lit(0.0))).alias("bias"), "norm")
            state, _ = cutter.cut(new, reliable=True)
        if not max_iter:
            state, _ = cutter.cut(state, reliable=True)
    finally:
        cutter.close()
    out = base.join(state, ID, "left").select(
        *[F.col(c) for c in g.vertices.columns],
        F.col("f1").alias("column1"), F.col("f2").alias("column2"),
        F.col("bias").alias("column3"), F.col("norm").alias("column4"))
    return out, mu


def training_rmse(g: Graph, factors: DataFrame, mu: float, min_value: float = 0.0,
                  max_value: float = 5.0, rating_col: str = "weight") -> float:
    """Root mean squared error of the model on its training ratings."""
    u = factors.select(F.col(ID).alias("_u"), F.col("column1").alias("p"),
                       F.col("column3").alias("bu"), F.col("column4").alias("nu"))
    i = factors.select(F.col(ID).alias("_i"), F.col("column1").alias("q"),
                       F.col("column2").alias("y"), F.col("column3").alias("bi"))
    e = g.edges.select(SRC, DST, F.col(rating_col).cast("double").alias("r"))
    rank = factors.select(F.size("column1")).first()[0]
    ysum = _sum_arrays(e.join(i, F.col(DST) == F.col("_i")).select(F.col(SRC).alias("v"), F.col("y").alias("s")),
                       rank).select(F.col("v").alias("_s"), F.col("y").alias("ysum"))
    t = (e.join(u, F.col(SRC) == F.col("_u")).join(i, F.col(DST) == F.col("_i"))
         .join(ysum, F.col(SRC) == F.col("_s")))
    imp = _axpy(F.col("nu"), F.col("ysum"), F.col("p"))
    pred = F.lit(mu) + F.col("bu") + F.col("bi") + _dot(F.col("q"), imp)
    pred = F.least(F.greatest(pred, F.lit(min_value)), F.lit(max_value))
    return t.agg(F.sqrt(F.avg(F.pow(F.col("r") - pred, 2)))).first()[0]
