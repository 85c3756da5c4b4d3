"""Embedding whitening against plain numpy."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from edgewise.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, key string, id int, w int, n int, v int, z int"


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], SCHEMA).repartition(4)


def grid(v):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)


def brute(rows, weights="one", components=16):
    """{id: ...} by exact sums and one dense eigendecomposition."""
    kept = [(i, grid(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    each = [x for _, x in kept] if weights == "count" else sorted({x for _, x in kept})
    n, d = len(each), len(each[0])
    s = [sum(x[k] for x in each) for k in range(d)]
    y = np.array([[float(Fraction(n * x[k] - s[k], n)) for k in range(d)] for x in each])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    return kept, n, s, values[order], vectors[:, order], np.trace(v)


def check(spark, rows, weights="one", components=16):
    kept, n, s, values, vectors, trace = brute(rows, weights, components)
    got = whitening.whiten(table(spark, [(i, v, 0) for i, v in rows]), weights=weights, components=components).collect()
    assert len(got) == len(kept) * len(values)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    signs = {}
    for i, x in kept:
        assert sorted(by[i]) == list(range(1, len(values) + 1))
        for c, rs in by[i].items():
            for r in rs:
                assert r["n"] == n and r["identity_error"] <= 1e-4
                assert abs(r["explained"] - values[c - 1] / trace) <= 1e-9 * r["explained"] + 1e-15
                if sum(1 for j, _ in kept if j == i) == 1:
                    assert int(r["deviation"]) == sum((n * a - b) ** 2 for a, b in zip(x, s))
                    z = sum(float(Fraction(n * a - b, n)) * vectors[k, c - 1] for k, (a, b) in enumerate(zip(x, s))) / math.sqrt(values[c - 1])
                    if abs(z) > 1e-6:
                        signs.setdefault(c, set()).add(round(r["whitened"] / z, 6))
    assert all(len(v) == 1 and abs(next(iter(v))) == 1 for v in signs.values()) and len(signs) == len(values)
    return got


def vectors(n=120, d=20, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) @ np.diag(np.linspace(3, 0.3, d))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base.astype(np.float32))]
    # a third of all rows hold one vector, others repeat in pairs
    rows += [(1000 + i, rows[3][1]) for i in range(70)] + [(2000 + i, rows[i][1]) for i in range(10)]
    return rows


@pytest.mark.parametrize("weights", ["one", "count"])
def test_against_numpy(spark, weights):
    check(spark, vectors(), weights)


def test_rows_left_out_and_ties(spark):
    rows = vectors(40, 6)
    odd = [(5000, None), (5001, [None] * 6), (5002, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (5003, [float("inf")] * 6), (5004, [])]
    got = check(spark, rows + [(rows[0][0], rows[0][1])] + odd, components=4)
    assert {r["vec_id"] for r in got} == {i for i, _ in rows}
    # another length than the others
    more = whitening.whiten(table(spark, [(i, v, 0) for i, v in rows + [(6000, [1.0, 2.0]), (None, rows[1][1])]]), components=4).collect()
    assert 6000 not in {r["vec_id"] for r in more} and sum(r["vec_id"] is None for r in more) == 4


def test_components_without_variance_and_few_rows(spark):
    rows = [(i, [float(i % 5), float(2 * (i % 5)), 7.0]) for i in range(30)]
    got = whitening.whiten(table(spark, [(i, v, 0) for i, v in rows])).collect()
    assert {r["component"] for r in got} == {1} and {r["n"] for r in got} == {5} and len(got) == 30
    for few in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]):
        assert whitening.whiten(table(spark, few)).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, []), weights="two")


def test_whole_numbers_beyond_64_bits(spark):
    far = [(0, [1e17, 0.0]), (1, [-1e17, 1.0]), (2, [3e38, 2.0]), (3, [0.5, 1.0])]
    got = {r["vec_id"]: r for r in whitening.whiten(table(spark, [(i, v, 0) for i, v in far])).collect() if r["component"] == 1}
    far_off = 1 << 61
    xs = {i: [max(min(x, far_off + 1_000_000), 1_000_000 - far_off) for x in grid(v)] for i, v in far}
    s = [sum(x[k] for x in xs.values()) for k in range(2)]
    for i, x in xs.items():
        want = sum((4 * a - b) ** 2 for a, b in zip(x, s))
        assert got[i]["deviation"] is None if want >= 10 ** 38 else int(got[i]["deviation"]) == want
