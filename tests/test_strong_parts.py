"""Strong components: the small parts that labels leave are solved in one pass, not one round after another."""

import random

import pyarrow as pa
import pytest
from brute import strong_components
from conftest import as_dict, make_graph
from edgewise.plans import strong
from edgewise.plans.iterate import StepCutter


def nested(n, at=0, k=6):
    """Strong parts in a row, each reaching the next: a round of labels settles one of them."""
    out = []
    for part in range(n):
        a = at + part * k
        # the smallest ids in the middle, so that no label splits many parts at once
        ids = [a + (i * 5) % k for i in range(k)]
        out += [(ids[i], ids[(i + 1) % k]) for i in range(k)]
        if part:
            out.append((a - 1, a))
    return out


def test_parts_take_few_rounds(spark, monkeypatch):
    steps = []
    cut = StepCutter.cut
    monkeypatch.setattr(StepCutter, "cut", lambda self, *a, **k: (steps.append(1), cut(self, *a, **k))[1])
    edges = [e for i in range(4) for e in nested(6, at=1000 * i)]
    got = as_dict(make_graph(spark, edges).strongly_connected_components().select("id", "component"))
    assert got == strong_components({x for e in edges for x in e}, edges)
    assert len(steps) < 20


@pytest.mark.parametrize(("most", "kind"), [(1 << 16, "bigint"), (4, "bigint"), (9, "string")])
def test_random_graphs(spark, monkeypatch, most, kind):
    monkeypatch.setattr(strong, "PART", most)
    rng = random.Random(most)
    edges = nested(3, at=500) + [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(100, 101), (101, 100), (101, 100)]
    if kind == "string":
        edges = [(f"v{a}", f"v{b}") for a, b in edges]
    got = as_dict(make_graph(spark, edges, id_type=kind).strongly_connected_components().select("id", "component"))
    assert got == strong_components({x for e in edges for x in e}, edges)


def test_a_task_gets_parts_whole(monkeypatch):
    """Ids by their smallest, whatever the order they come in."""
    ids, names = strong.named(pa.array(["c", "b", "a", "x"]), pa.array(["b", "c", "x", "q"]))
    assert dict(zip(ids.to_pylist(), names.to_pylist(), strict=True)) == {"c": "b", "b": "b", "a": "a", "x": "x", "q": "q"}
