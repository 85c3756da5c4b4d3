"""SVD++ on a grid of cells: values go once to a cell, and the files of a step go with it."""

import glob
import os
import random

import pytest
from edgewise.graph import Graph
from edgewise.operators import svdpp
from edgewise.plans import grid
from edgewise.plans.iterate import StepCutter


def ratings(spark, n=40, kind="bigint"):
    rng = random.Random(4)
    rows = [(u, -1 - rng.randrange(n), rng.choice([1.0, 2.5, 4.0, None])) for u in range(n) for _ in range(12)]
    rows += [(u, -1, 3.0) for u in range(n) for _ in range(10)]  # one item with nearly half of the ratings
    rows += [(900, -901, None), (900, -1, None), (901, -901, None), (3, -902, None), (4, 3, 2.0), (None, -1, 2.0), (5, None, 1.0)]
    if kind == "string":
        rows = [tuple(None if x is None else f"v{x}" for x in r[:2]) + r[2:] for r in rows]
    return Graph.from_edges(spark.createDataFrame(rows, f"src {kind}, dst {kind}, weight double"))


def table(out):
    return {r["id"]: [x for c in ("column1", "column2", "column3", "column4")
                      for x in (r[c] if isinstance(r[c], list) else [r[c]])] for r in out.collect()}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_cells_of_any_size_give_the_same(spark, monkeypatch, kind):
    g = ratings(spark, kind=kind)
    whole, mu = g.svd_plus_plus(rank=3, max_iter=2)
    whole = table(whole)
    for name, value in (("BLOCK", 9), ("PIECE", 70), ("CHUNK", 3), ("SLICE", 17), ("ROWS", 5)):
        monkeypatch.setattr(grid, name, value)
    cut, mu_cut = g.svd_plus_plus(rank=3, max_iter=2)
    cut = table(cut)
    assert mu == mu_cut and set(cut) == set(whole) and len(cut) > 80
    for v, row in whole.items():
        assert [x is None for x in cut[v]] == [x is None for x in row], v
        assert all(x is None or abs(x - y) < 1e-9 for x, y in zip(row, cut[v], strict=True)), v


def test_values_go_once_to_a_cell(spark, monkeypatch):
    counts = []
    step = grid.step

    def told(cells, sides, *a):
        counts.append(sum(s.count() for s in sides))
        return step(cells, sides, *a)

    monkeypatch.setattr(svdpp, "step", told)
    g = ratings(spark)
    n = g.edges.count()
    g.svd_plus_plus(rank=2, max_iter=1)
    # 40 users and about as many items, five cells each at most; a rating sends nothing
    assert len(counts) == 2 and max(counts) < n and max(counts) <= (45 + 45) * grid.SIDE


def test_a_written_step_leaves_no_shuffle_files(spark):
    def files():
        return set(glob.glob(os.path.join(spark.sparkContext._jsc.sc().getConf().get("spark.local.dir", "/tmp"), "blockmgr-*/*/shuffle_*.data")))

    cutter = StepCutter()
    before = files()
    out, _ = cutter.cut(spark.range(10_000).groupBy("id").count(), reliable=True)
    assert not files() - before
    assert out.count() == 10_000
