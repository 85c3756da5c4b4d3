"""Mixing, exact dedup and language ID on small tables, against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from edgewise.llm import exact_dedup, langid, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __source int, size int, row int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, 1, 1, 1) if len(r) == 4 else r for r in rows], DOCS)


def brute_classes(rows):
    by = {}
    for r in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        by.setdefault(t, []).append(r[0])
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "Abc É", "x", "a"), (2, "aBC É", "x", None), (3, "abc é", None, "a"), (4, None, "x", "a"),
        (5, "", "x", "a"), (None, "abc É", "x", "b"), (7, "long " * 60_000, "x", "b"),
        (8, "LONG " * 60_000, "x", "b"), (9, "long " * 59_999 + "lonG!", "x", "b"),
        (11, "same", "x", "a"), (11, "same", "x", "a"), (10, "same", "x", "a")]


@pytest.mark.parametrize("primes", [exact_dedup.PRIMES, (3, 5)])
def test_exact_classes(spark, primes):
    """Weak primes make different texts of one length collide; the comparison parts them."""
    rows = [*ROWS, *((100 + i, f"text {i % 40:03d}", "x", "a") for i in range(80))]
    got = exact_dedup.exact_classes(docs(spark, rows), primes=primes)
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(rows)


def test_exact_empty_and_filter(spark):
    assert exact_dedup.exact_classes(docs(spark, [])).count() == 0
    d = docs(spark, ROWS)
    kept = exact_dedup.drop_exact_copies(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 8, 9, 11]


def test_fingerprint_combines():
    tables = [exact_dedup.powers(b, p, exact_dedup.CHUNK)
              for b, p in zip(exact_dedup.BASES[0], exact_dedup.PRIMES, strict=True)]
    text = bytes(range(256)) * 700
    whole = exact_dedup.fingerprint(text, tables, exact_dedup.BASES[0])
    for k, (b, p) in enumerate(zip(exact_dedup.BASES[0], exact_dedup.PRIMES, strict=True)):
        h = 0
        for c in text:
            h = (h * b + c + 1) % p
        assert whole[k] == h
        left = exact_dedup.fingerprint(text[:1000], tables, exact_dedup.BASES[0])[k]
        right = exact_dedup.fingerprint(text[1000:], tables, exact_dedup.BASES[0])[k]
        assert exact_dedup.combine(left, right, len(text) - 1000, b, p) == h


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_targets_and_shards(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 90)), "x", s)
            for i, s in enumerate((["hot"] * 400 + ["b"] * 60 + ["a", "é", None] * 20 + ["tiny"] * 2) * 2)]
    rows += [(5000, None, None, "none"), (5001, "", "x", None), (None, "a b", "x", "hot"), (5002, "a b", "x", "a"),
             (5002, "a b", "x", "a")]
    d = docs(spark, rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = brute_targets(sizes)
    targets, blocks = mixing.plan(d, block_words=400)
    out = mixing.assigned(d, targets, blocks).collect()
    assert len(out) == len(rows)
    for s, t in want.items():
        mine = [r for r in out if r.source == s]
        assert all(math.isclose(r.target, t, rel_tol=1e-9, abs_tol=1e-9) for r in mine)
        assert abs(sum(r.size * r.copies for r in mine) - t) <= 45, s
        assert all(r.copies <= 3 and r.source_size == sizes[s] for r in mine)
    mixed = mixing.mix(d, block_words=400, shards=5)
    assert mixed.columns == [*d.columns, "mix_shard", "mix_key"]
    got = mixed.collect()
    assert len(got) == sum(r.copies for r in out)
    assert {r.mix_shard for r in got} == set(range(5))
    again = mixing.mix(d.repartition(3), block_words=400, shards=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_empty(spark):
    d = docs(spark, [])
    targets, blocks = mixing.plan(d)
    assert mixing.assigned(d, targets, blocks).count() == 0
    assert mixing.mix(d).count() == 0


def test_targets_of_many_sources(spark):
    """Ranks and levels summed range by range equal the plain ones."""
    sizes = {(f"s{i * 7919 % 1000:03d}" if i % 50 else None): 1 + i * i % 977 for i in range(600)}
    sized = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(7)
    got = {r.source: r for r in mixing.source_targets(sized).collect()}
    want = brute_targets(sizes)
    assert [got[s].rank for s in sorted((s for s in sizes if s), key=str.encode)] == list(range(1, len(sizes)))
    assert got[None].rank == len(sizes) and got.keys() == want.keys()
    assert all(math.isclose(got[s].target, t, rel_tol=1e-9) for s, t in want.items())
    assert any(t == 3.0 * sizes[s] for s, t in want.items())


def test_shard_quotas_of_runs_of_sources(spark):
    """Three levels of runs: every quota and every shard's total is exact, and shares are near even."""
    quotas = {r: 1000 + r % 7 if r % 5 else r for r in range(1, 31)}
    got = mixing.shard_quotas(spark.createDataFrame(list(quotas.items()), "rank int, quota long"), shards=4, width=4).collect()
    assert len(got) == 4 * len(quotas)
    for rank, quota in quotas.items():
        parts = sorted((r["first"], r["last"]) for r in got if r["rank"] == rank)
        assert parts[0][0] == 0 and parts[-1][1] == quota
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        assert all(abs(b - a - quota / 4) <= 6 * math.sqrt(quota) / 2 for a, b in parts)
    totals = [sum(r["last"] - r["first"] for r in got if r["shard"] == s) for s in range(4)]
    assert sum(totals) == sum(quotas.values()) and max(totals) - min(totals) <= 2


def test_shard_quotas_are_exact(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 7), (3, 0), (4, 60)], "rank int, quota long")
    got = mixing.shard_quotas(quotas, shards=6).collect()
    for rank, quota in ((1, 1000), (2, 7), (3, 0), (4, 60)):
        parts = sorted((r["first"], r["last"]) for r in got if r["rank"] == rank)
        assert parts[0][0] == 0 and parts[-1][1] == quota
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    totals = [sum(r["last"] - r["first"] for r in got if r["shard"] == s) for s in range(6)]
    assert max(totals) - min(totals) <= 2


def test_hypergeometric_matches_its_distribution(spark):
    u = (F.col("id") + 0.5) / 4000.0
    k = mixing.hypergeometric(F.lit(8).cast("long"), F.lit(20).cast("long"), F.lit(7).cast("long"), u)
    got = {r.k: r["count"] / 4000 for r in spark.range(4000).select(k.alias("k")).groupBy("k").count().collect()}
    for x in range(8):
        p = math.comb(8, x) * math.comb(12, 7 - x) / math.comb(20, 7)
        assert abs(got.get(x, 0.0) - p) < 1e-3


def test_language(spark):
    langs = {"aa": "bola mira tok sel", "bb": "grunt wesk plim dosh", "cc": "éta ôlu ñam ürü"}
    rows = []
    for i in range(600):
        lang = list(langs)[i % 3]
        words = langs[lang].split()
        rows.append((i, " ".join(words[(i + k) % 4] + words[(i * k) % 4] for k in range(12)), lang, "s"))
    rows += [(900, None, "aa", "s"), (901, "123 !!! ²", None, "s"), (902, "x" * 300_000, None, "s"),
             (903, "bolamira toksel bola", None, "s"), (None, "grunt", "bb", "s"), (903, "éta", None, "s")]
    got = langid.predictions(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(900, "und"), (901, "und"), (903, "aa"), (903, "cc"), (None, "bb")} <= by
    assert all(0 <= r.score <= 1 for r in got)
    held = [(r, rows[r.doc_id][2]) for r in got if r.doc_id is not None and r.doc_id < 600
            and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == lang for r, lang in held) >= 0.98 * len(held)
    nothing = docs(spark, [(1, "abc", None, "s"), (2, None, None, None)])
    assert {r.lang_pred for r in langid.predictions(nothing).collect()} == {"und"}
    assert langid.predictions(docs(spark, [])).count() == 0


def brute_language(rows):
    """Plain counts of all words and n-grams of labelled rows, and the scores of a text, term by term."""
    train = [(t, lang) for d, t, lang, _ in rows if lang and t and d is not None and zlib.crc32(str(d).encode()) % 5]
    langs = sorted({lang for _, lang in train})
    counts = [collections.defaultdict(collections.Counter) for _ in range(5)]
    grams_of = lambda w, n: [w[i:i + n] for i in range(len(w) - n + 1)]
    for t, lang in train:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            counts[0][w][lang] += 1
            for n in range(1, 5):
                for g in grams_of(f"\x02{w}\x03", n):
                    counts[n][g][lang] += 1
    total = [{lang: sum(c[lang] for c in level.values()) for lang in langs} for level in counts]
    log = lambda n, g, lang: math.log((counts[n][g][lang] + 0.5) / (total[n][lang] + 0.5 * len(counts[n])))

    def word(w, lang):
        if w in counts[0]:
            return log(0, w, lang)
        w, terms, at = f"\x02{w}\x03", [], 0
        while at < len(w):
            n = next((n for n in (4, 3, 2, 1) if at + n <= len(w) and w[at:at + n] in counts[n]), 0)
            terms.append(log(n, w[at:at + n], lang) - (4 - n) if n else math.log(1e-6))
            at += max(1, n - 1)
        return sum(terms) / len(terms)

    def predict(t):
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not words:
            return "und", 0.0
        s = [sum(word(w, lang) for w in words) / len(words) * min(20, len(words)) for lang in langs]
        best = max(range(len(langs)), key=lambda i: (s[i], -i))
        return langs[best], 1 / sum(math.exp(x - s[best]) for x in s)

    return [(r[0], *predict(r[1])) for r in rows]


def test_language_scores_equal_plain_counts(spark):
    rng = random.Random(8)
    letters = {"aa": "abcdefg", "bb": "cdefghij", "cc": "éabüfgh"}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randrange(1, 8))) for _ in range(60)] for k, v in letters.items()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(1, 30))), k, "s")
            for i, k in enumerate(list(letters) * 40)]
    rows += [(500 + i, " ".join("".join(rng.choice("abcdefghijüéxyz") for _ in range(rng.randrange(1, 12)))
                                for _ in range(rng.randrange(1, 6))), None, "s") for i in range(80)]
    rows += [(700, None, "aa", "s"), (701, "12 !", "aa", "s"), (702, "Ab ab AB", None, "s")]
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predictions(docs(spark, rows)).collect())
    for have, want in zip(got, brute_language(rows), strict=True):
        assert have[:2] == want[:2] and math.isclose(have[2], want[2], rel_tol=1e-6), (have, want)
