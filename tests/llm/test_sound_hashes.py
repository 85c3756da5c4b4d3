"""Words that share nothing do not count as equal; models reach executors that lack the package; shuffle files go."""

from __future__ import annotations

import glob
import os
import random
import subprocess
import sys
import textwrap
from collections import Counter

from edgewise.llm import common, fingerprint, ngram_join, secret_scan, shingles, toxicity

#: a word and its complement, equal at no place: a polynomial of powers of two cannot tell them apart
LONG = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
OTHER = LONG.translate(str.maketrans("ab", "ba"))


def test_long_structured_words_differ(spark):
    (a,), (b,), (c,) = ([int(h) for h in x] for x in shingles.word_hashes([LONG.encode(), OTHER.encode(), LONG.encode()]))
    assert a == c != b
    docs = spark.createDataFrame([(1, LONG, None, None, None), (2, OTHER, None, None, None), (3, LONG, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    kept = {r["doc_id"] for r in ngram_join.drop_near_copies(docs).collect()}
    assert kept == {1, 2}
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprint.neighbours(docs).collect()}
    assert found[1] == found[3] != found[2]


def test_hash_of_a_word_does_not_depend_on_its_surroundings():
    rng = random.Random(1)
    for _ in range(200):
        words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 9))]
        text = rng.choice([" ", "\n", ""]) + rng.choice([" ", "  ", "\t"]).join(words) + rng.choice(["", " "])
        alone = [int(next(shingles.word_hashes([w.encode()]))[0]) for w in words]
        assert [int(h) for h in next(shingles.word_hashes([text.encode()]))] == alone
    assert [len(h) for h in shingles.word_hashes([b"", b" ", b"x"])] == [0, 0, 1]


def test_word_shingles():
    assert ngram_join.word_shingles("A b\tc\x0bd  e", 4) == {(b"a", b"b", b"c", b"d"), (b"b", b"c", b"d", b"e")}
    assert ngram_join.word_shingles("a b", 4) == {(b"a", b"b")} and ngram_join.word_shingles(None, 4) == set()


def test_spans_are_compared_in_linear_time():
    rng = random.Random(3)
    base = sorted((("hex", a, a + rng.randrange(1, 40), "") for a in rng.sample(range(2000), 60)), key=lambda s: s[1])
    text = "".join(rng.choice("aB3 /") for _ in range(2100))
    near = [s for s in secret_scan.generic_spans(text * 1, [])]
    want = [s for s in near if not any(a < s[2] and s[1] < b for _, a, b, _ in base)]
    assert secret_scan.generic_spans(text, base) == want
    lexicon = toxicity.Lexicon({"bad": 2.0}, ["bad cat", "big bad"], [0.0] * 4)
    m = toxicity.Matcher(lexicon)
    assert m.features("bad") == m.features("bad") != (0.0, 0.0, 0.0) == m.features("a bad cat, a big bad one")
    assert m.features("bad bad cat")[0] == 2.0 and m.features("big bad bad")[1] == m.features("bad bad cat")[1]


def test_toxic_scores_against_plain_counts(spark):
    """Lexicon and features against counts of words and pairs, odds and the cover of mild phrases, one row at a time."""
    import math
    import re
    import zlib
    rng = random.Random(5)
    words = ["sun", "sea", "vile", "dog", "hot", "kind", "mean"]
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.3
        text = [rng.choice(words[:2] + words[3:]) for _ in range(8)]
        if toxic:
            text.insert(rng.randrange(8), "vile")
        elif rng.random() < 0.3:
            text += ["vile", "dog"] if rng.random() < 0.9 else ["vile"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    train = [(t, y) for (i, t), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5]
    size = Counter(y for _, y in train)

    def odds(p, n):
        return math.log((p + 0.5) / (size[1] + 1)) - math.log((n + 0.5) / (size[0] + 1))

    one, two = (Counter(), Counter()), (Counter(), Counter())
    for t, y in train:
        w = re.findall("[a-z]+", t)
        one[y].update(set(w))
        two[y].update({f"{a} {b}" for a, b in zip(w, w[1:])})
    terms = {w for c in one for w in c if one[0][w] + one[1][w] >= 5}
    pairs = {p for c in two for p in c if two[0][p] + two[1][p] >= 5 and two[0][p] >= 3 * two[1][p] and odds(two[1][p], two[0][p]) < 0}
    weights = {w: odds(one[1][w], one[0][w]) for w in terms if odds(one[1][w], one[0][w]) >= 2}
    for p in pairs:
        for w in p.split():
            if w in terms and 2 * two[0][p] >= one[0][w] and one[1][w] - two[1][p] >= 5:
                rest = odds(one[1][w] - two[1][p], one[0][w] - two[0][p])
                if rest >= 2:
                    weights[w] = max(weights.get(w, 0.0), rest)
    assert set(lexicon.weights) == set(weights) and "vile" in weights
    assert all(abs(lexicon.weights[w] - v) < 1e-9 for w, v in weights.items())
    assert lexicon.exceptions == sorted(p for p in pairs if set(p.split()) & set(weights))
    got = {r["doc_id"]: r for r in toxicity.scores(docs, lexicon, ["doc_id"]).collect()}
    for i, t in rows:
        w = re.findall("[a-z]+", t)
        kept = [weights[x] for k, x in enumerate(w) if x in weights and not any(
            0 <= j < len(w) - 1 and f"{w[j]} {w[j + 1]}" in lexicon.exceptions for j in (k - 1, k))]
        feats = (max(kept), math.log1p(sum(kept)), math.log1p(100 * sum(kept) / len(w))) if kept else (0.0, 0.0, 0.0)
        z = lexicon.coefficients[0] + sum(a * b for a, b in zip(lexicon.coefficients[1:], feats))
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_shuffle_files_go_with_their_step(spark, tmp_path):
    def files():
        return set(glob.glob(os.path.join(spark.sparkContext._jsc.sc().getConf().get("spark.local.dir", "/tmp"), "blockmgr-*/*/shuffle_*.data")))

    before = files()
    out = common.staged(spark.range(10_000).groupBy("id").count(), "cleanup")
    assert not files() - before and out.count() == 10_000
    assert spark.conf.get(common.CLEANUP, "false") == "false"


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The driver finds the package by its path alone: Python workers start elsewhere, without it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {root!r})
        from edgewise.session import local_session
        import __spark_entry__ as entry
        spark = local_session(cores="2", shuffle_partitions=2, driver_memory="2g")

        def bare(batches):
            try:
                import edgewise
                raise RuntimeError("the worker has the package")
            except ModuleNotFoundError:
                yield from batches

        spark.range(2).mapInArrow(bare, "id long").collect()
        for name in {("op3_toxicity", "op4_bpe_encode", "op10_language_id", "op12_pii", "op13_whitening")!r}:
            assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
        print("all ran")
        """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "all ran" in done.stdout, done.stderr[-2000:]
