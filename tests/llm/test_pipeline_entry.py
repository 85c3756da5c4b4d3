"""The pipeline's stages, each against a brute-force version on its own input; oracles of the queries."""

from __future__ import annotations

import collections
import re

import corpus_pipeline
import duckdb
import pytest
from llm_documents import awkward_rows, documents  # noqa: F401  (fixtures)
from test_mixing_dedup_langid import brute_targets
from test_text_operators import brute_components
from tokenizers import Tokenizer

from edgewise.llm import queries

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark, documents, awkward_rows):
    docs = documents([*awkward_rows, (950, "123 456 !!", "en", "s1")]).select(*corpus_pipeline.COLUMNS, "k1")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r)[:4] for r in docs.collect()]
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "test-stage")
        seen.append((name, before, docs.collect(), docs.columns))
    for name, _, _, columns in seen[:-1]:
        assert columns == corpus_pipeline.COLUMNS, name
    (_, before, after, _), *_ = seen
    assert {r.doc_id for r in after} == {r[0] for r in before if r[1] and any(map(str.isalpha, r[1]))}
    _, before, after, _ = seen[1]
    last = {}
    for r in before:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
        last[key] = max(last.get(key, -1), r[0])
    assert {r.doc_id for r in after} == set(last.values())
    _, before, after, _ = seen[2]
    assert {r.doc_id for r in after} == {d for d, (_, c) in brute_components(before, 80, 5).items() if d == c}
    _, before, after, _ = seen[3]
    copies = collections.Counter(r.doc_id for r in after)
    assert set(copies) <= {r[0] for r in before} and max(copies.values()) <= 3
    n_words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes = collections.Counter()
    for r in before:
        sizes[r[3]] += n_words(r[1])
    taken = collections.Counter()
    for r in after:
        taken[r.source] += n_words(r.text)
    for source, target in brute_targets(sizes).items():
        largest = max(n_words(r[1]) for r in before if r[3] == source)
        assert abs(taken[source] - target) <= largest / 2 + 1, source
    _, before, after, _ = seen[4]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r[0]: r[1] for r in before}
    assert len(after) == len(before)
    assert all(r.input_ids == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids for r in after)


def test_pipeline_of_awkward_rows(spark, documents):
    """Null ids and texts, repeated rows and an empty table: every stage ends, and only copies and letterless texts go."""
    rows = [(None, "Eine Zeile ohne Nummer", "de", None), (None, "Eine Zeile ohne Nummer", "de", None), (1, None, None, None),
            (2, "", "en", "s"), (3, "one line of words here", "en", "s"), (3, "one line of words here", "en", "s"),
            (4, "1 2 3", "en", "s"), (5, "another short line", None, "s")]
    kept = {"Eine Zeile ohne Nummer", "one line of words here", "another short line"}
    for given, want in ((rows, kept), ([], set())):
        docs = documents(given).select(*corpus_pipeline.COLUMNS, "k1", "size")
        for name, stage in corpus_pipeline.STAGES[:3]:
            docs = corpus_pipeline.staged(stage(spark, docs, SF), "test-stage")
        assert sorted(r.text for r in docs.collect()) == sorted(want)
        for name, stage in corpus_pipeline.STAGES[3:]:
            docs = corpus_pipeline.staged(stage(spark, docs, SF), "test-stage")
        assert docs.count() >= len(want) - 1 and (want or not docs.count())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    # a column of whole numbers with nulls is of another type on either side
    whole = [x[cols].apply(lambda c: c.astype("Int64") if c.dtype.kind == "f" and (c.dropna() % 1 == 0).all() else c) for x in (want, got)]
    sides = [x.astype(str).sort_values(cols).reset_index(drop=True) for x in whole]
    assert sides[0].equals(sides[1])
