"""Conversation prefix trie against a brute-force trie."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from edgewise.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, i int, digest string, n int, conv int, seg int, kind string"


def brute(rows) -> list[tuple]:
    """Rows (conv_id, turn, role, text) to the nodes, sorted; turns of one number by digest."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            whole = f"{len(r.encode())}:{r}{x}".encode()
            own[c].append((t is not None, t or 0, hashlib.sha256(whole).digest()[:16], r, x))
    own = {c: [s[3:] for s in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, p in full.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
            if d:
                kids[tuple(p[:d - 1])].add(tuple(p[:d]))
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **kw) -> list[tuple]:
    table = spark.createDataFrame([(*r, *[None] * 6) for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(table, **kw).collect()), key=str)


def conversations(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    bases = [[(rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", "ccc", None])) for _ in range(n)]
             for n in (0, 1, 3, 9, 14, 30)]
    rows = []
    for c in rng.sample(range(0, 400), 160):
        turns = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            turns.append((rng.choice(["user", "tool"]), rng.choice(["x", "yy", "é"])))
        rows += [(c, t if rng.random() < 0.97 else None, r, x) for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment, shard_rows", [(64, 4096), (64, 40), (4, 40), (3, 10000), (1, 60)])
def test_against_brute_force(spark, segment, shard_rows):
    rows = conversations()
    assert found(spark, rows, segment=segment, shard_rows=shard_rows) == brute(rows)


def test_copies_over_several_shards(spark):
    """A group of copies with most of the rows: its nodes are skeleton nodes, its ids end in several shards."""
    same = [("user", "hello"), ("assistant", "hi there")] * 6
    rows = [(c, t, r, x) for c in range(0, 900, 5) for t, (r, x) in enumerate(same)]
    rows += [(c, t, "user", f"own {c % 7} {t}") for c in range(1, 200, 5) for t in range(12)]
    assert found(spark, rows, shard_rows=30) == brute(rows)


def test_one_conversation_holds_most_turns(spark):
    rows = [(10, t, "user", str(t % 3)) for t in range(700)] + [(15, t, "user", str(t % 3)) for t in range(650)]
    rows += [(c, t, "user", str(t % 3)) for c in range(20, 30) for t in range(c)]
    assert found(spark, rows, segment=16, shard_rows=20) == brute(rows)


def test_defined_cases(spark):
    assert found(spark, []) == []
    rows = [(None, 0, "user", "no id"), (7, None, None, None), (7, 0, "user", "a"), (7, 0, "user", "a"), (5, 2, "user", "é" * 50_000)]
    assert found(spark, rows) == brute(rows)
    # nothing but turns that are not taken: a conversation without turns, whose only node is the root
    alone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    got = found(spark, [(alone, 0, "user", "dropped")])
    assert got == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_segments_hold_bounded_rows(spark):
    turns = spark.range(1000).select(F.lit(1).alias("conv"), F.col("id").alias("pos"), F.lit(b"x").alias("digest"), F.lit(1).alias("size"))
    rows = prefix_trie.segments(turns, spark.createDataFrame([(1,)], "conv long"), 64)
    assert rows.agg(F.max(F.size("path"))).first()[0] == 64
