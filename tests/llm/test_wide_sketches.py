"""The n-gram join sends the texts of pairs whose wide sketches let them link, not of all that share a signature."""

import random

import numpy as np
import pytest
from edgewise.llm import ngram_join


def test_texts_of_unlinked_pairs_are_not_sent(spark, monkeypatch):
    """Long texts share signatures by their common passages: their pairs grow with the square of the table."""
    rng = random.Random(3)
    common = " ".join(f"c{i}" for i in range(500))
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(1300)) + " " + common) for i in range(16)]
    words = rows[0][1].split()
    words[7] = "other"
    rows.append((100, " ".join(words)))  # the one near copy
    candidates, sent = [], []
    meet = ngram_join._links
    old = ngram_join.staged

    def links(pairs, texts, *a):
        sent.append({tuple(sorted(r)) for r in pairs.collect()})
        assert texts.count() == len({x for p in sent[-1] for x in p})
        return meet(pairs, texts, *a)

    def staged(df, name, *a, **k):
        out = old(df, name, *a, **k)
        if name == "join-candidates":
            candidates.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_links", links)
    monkeypatch.setattr(ngram_join, "staged", staged)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(docs, 80, 5).collect()}
    assert got == {i: 0 if i == 100 else i for i, _ in rows}
    assert sum(candidates) > 20, "the texts share no signatures, so this tests nothing"
    assert len(set().union(*sent)) == 1


@pytest.mark.parametrize("similarity", [30, 80, 95])
def test_wide_sketches_of_linked_sets_pass(similarity):
    rng = np.random.default_rng(similarity)
    passed = 0
    for size in (1, 9, 300, 1023, 1024, 5000):
        for _ in range(20):
            both = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, k, dtype=np.uint64)]))
                    for k in rng.integers(0, 1 + size * (100 - similarity) // similarity, 2))
            linked = 100 * len(both) >= similarity * (len(a) + len(b) - len(both))
            near = ngram_join.sketches_near(
                *(x for s in (a, b) for x in (ngram_join.parity_sketch(s, ngram_join.wide_bits(len(s), similarity)), len(s))),
                similarity)
            assert near or not linked
            passed += linked
    assert passed > 20
    far = [rng.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(2)]
    if similarity >= 80:
        assert not ngram_join.sketches_near(*(x for s in far for x in (
            ngram_join.parity_sketch(s, ngram_join.wide_bits(len(s), similarity)), len(s))), similarity)
