"""Min-label components: the layout of the edges is made in one shuffle, and ends that are no vertices stay silent."""

from __future__ import annotations

import random

import pytest

import brute
from conftest import as_dict, make_graph
from edgewise.plans import iterate


@pytest.mark.parametrize("limit", ["-1", "10MB"])
def test_edges_are_not_written_before_they_are_laid_out(spark, monkeypatch, limit):
    rng = random.Random(8)
    e = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] * 2 + [(3, 3), (None, 4), (5, None)]
    cut, written = iterate.StepCutter.cut, []

    def spied(self, df, metrics=None, reliable=False):
        written.append(set(df.columns))
        return cut(self, df, metrics, reliable)

    monkeypatch.setattr(iterate.StepCutter, "cut", spied)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    spark.catalog.clearCache()
    try:
        got = as_dict(make_graph(spark, e, vertices=range(60)).connected_components(algorithm="min_label"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    plain = [x for x in e if None not in x]
    assert got == brute.components(list(range(60)), plain)
    assert {"src", "dst"} not in written  # without broadcasts the edges only pass through the layout
    assert limit != "-1" or {"a", "b"} not in written
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_ends_that_are_no_vertices_send_nothing(spark):
    # 1 - 7 - 2 would join 1 and 2, but 7 is no vertex
    g = make_graph(spark, [(1, 7), (7, 2), (2, 3), (0, 9)], vertices=[1, 2, 3, 9])
    assert as_dict(g.connected_components(algorithm="min_label")) == {1: 1, 2: 2, 3: 2, 9: 9}
    assert as_dict(make_graph(spark, [], vertices=[4, 5]).connected_components(algorithm="min_label")) == {4: 4, 5: 5}
