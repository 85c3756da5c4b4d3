"""Personal data: patterns against the plain regular expressions, the tagger's gradients, windows, learned spans."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest

from edgewise.llm import char_tagger, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text: str) -> list[tuple[str, int, int]]:
    def digits(s):
        return [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(d[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def test_base_spans_against_plain_patterns():
    rng = random.Random(4)
    bits = ["a", "B7", ".", "@", "x.y", "-", "%", " ", "+", "1", "255", "256", "0", "00", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (555) 123-4567", "(", ")", "é", "@b.c", "1.2.3.4", "\n", "999.1.1.1", "5", "12345678"]
    found = 0
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30)))
        found += len(brute(text))
        assert pii.base_spans(text) == brute(text), text
    assert found > 2000


def test_patterns_take_linear_time():
    began = time.time()
    for bit in ("a", "1", "a@", "1.", "+1", "1 ", ".@", "1-", "(1", "+"):
        pii.base_spans(bit * 300_000)
    assert time.time() - began < 30


def test_gradients():
    rng = np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in char_tagger.start(5, 4, 3, 1).items()}
    ids, tags, lengths = rng.integers(0, 99, (3, 6)).astype(np.int16), rng.integers(0, 5, (3, 6)), np.array([6, 4, 1])
    _, d = char_tagger._gradients(m, ids, tags, lengths)
    for name, w in m.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if name == "embed":
                at = (int(ids[0, rng.integers(0, 6)]), at[1])
            old, loss = w[at], []
            for step in (1e-3, -1e-3):
                w[at] = old + step
                loss.append(char_tagger._gradients(m, ids, tags, lengths)[0])
            w[at] = old
            assert abs((loss[0] - loss[1]) / 2e-3 - d[name][at]) < 1e-4


def test_decode_is_the_best_path_of_all():
    rng = np.random.default_rng(2)
    m = char_tagger.start(3, 4, 3, 1)
    m["move"] = rng.normal(size=(3, 3)).astype(np.float32)
    ids, lengths = rng.integers(0, 99, (4, 6)).astype(np.int16), np.array([6, 5, 2, 1])
    tags, sure = char_tagger.decode(m, ids, lengths)
    emit, *_ = char_tagger._forward(m, ids, False)
    for b, n in enumerate(lengths):
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        score = np.array([sum(emit[k, b, p[k]] for k in range(n)) + m["first"][p[0]]
                          + sum(m["move"][p[k - 1], p[k]] for k in range(1, n)) for p in paths])
        assert tags[b, :n].tolist() == paths[score.argmax()].tolist()
        share = np.exp(score - score.max())
        for k in range(n):
            assert abs(share[paths[:, k] == tags[b, k]].sum() / share.sum() - sure[b, k]) < 1e-4


def entity(rng, kind):
    if kind == "email":
        return f"{rng.choice(['ana', 'jo', 'th.in'])}.{rng.randrange(100):02d}@mail{rng.randrange(10)}.example.com"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "phone":
        return f"+1 ({rng.randrange(1000):03d}) 555-{rng.randrange(10000):04d}"
    if kind == "card":
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(body + c for c in "0123456789" if pii.luhn(body + c))
    return rng.choice(["%x" % rng.getrandbits(90), str(rng.randrange(10 ** 5)), "a@b"])


def text_with(rng, kind, n=18):
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
    words.insert(rng.randrange(n), entity(rng, kind))
    return " ".join(words)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(8)
    texts = [text_with(rng, k) for k in [*pii.KINDS, "none"] for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    return pii.learn(docs, per_kind=110)


def test_learned_spans(model):
    assert model["kinds"] == pii.KINDS
    rng = random.Random(9)
    for kind in ("email", "ip", "phone"):  # unseen windows are tagged as their patterns say
        texts = [text_with(rng, kind) for _ in range(30)]
        right = sum(any(p[2] == kind for p in _tagged(t, model)) for t in texts)
        assert right >= 27
    # what no pattern takes: the plus is missing, a letter outside the local part's alphabet
    text = "thin on call 1 (826) 555-7388 erth on tio"
    assert pii.base_spans(text) == [] and [k for k, *_ in pii.learned_spans([text], [[]], model)[0]] == ["phone"]
    clean = [text_with(rng, "none") for _ in range(60)]
    assert not any(pii.learned_spans(clean, [pii.base_spans(t) for t in clean], model))


def _tagged(text, model):
    ids = char_tagger.char_ids(text[:pii.WINDOW])[None]
    tags, sure = char_tagger.decode(model["weights"], ids, np.array([ids.shape[1]]))
    return pii.pieces(tags[0].tolist(), sure[0].tolist(), 0)


def test_windows_without_seeds_change_nothing(model):
    rng = random.Random(10)
    texts = [" ".join(text_with(rng, rng.choice([*pii.KINDS, "none"]), 90) for _ in range(3)) for _ in range(25)] + ["", "no", "1"]
    bases = [[] for _ in texts]  # nothing is taken by patterns: all that the tagger finds counts
    some = pii.learned_spans(texts, bases, model)
    assert some == pii.learned_spans(texts, bases, model, every_window=True) and sum(map(len, some)) > 20


def test_window_starts_cover_the_text():
    for n in (1, 127, 128, 129, 192, 193, 1000):
        starts = pii.window_starts(n, None)
        covered = set().union(*(range(a, min(a + pii.WINDOW, n)) for a in starts))
        assert covered == set(range(n)) and all(a < n for a in starts)
        for p in (0, n // 2, n - 1):
            mine = pii.window_starts(n, [p])
            assert mine == [a for a in starts if a <= p < a + pii.WINDOW]


def test_reconciled():
    whole, left, right = (50, 70, "ip", 0.9), (50, 64, "ip", 0.95), (60, 70, "ip", 0.8)
    assert pii.reconciled([(0, 64, [left]), (0, 128, [whole])], 500) == [whole]
    assert pii.reconciled([(0, 64, [left]), (60, 200, [right])], 500) == [(50, 70, "ip", 0.8)]
    # of overlapping spans those with the largest total stay
    spans = [(0, 10, "ip", 0.9), (8, 12, "card", 0.99), (12, 30, "ip", 0.9), (0, 31, "email", 0.5)]
    assert pii.reconciled([(0, 100, spans)], 100) == [spans[0], spans[2]]
    assert pii.reconciled([], 0) == []


def test_marks_and_kinds_too_rare(spark):
    assert pii.marks([("ip", 2, 5), ("email", 0, 3)], 1, 6) == [2, 2, 4, 4, 0]
    docs = spark.createDataFrame([(1, "a 1.2.3.4 b"), (2, None)], "doc_id long, text string")
    assert pii.learn(docs) is None


def test_scan_defined_cases(spark, model):
    schema = "doc_id long, text string, spans int, kind string, n_ip string"
    rows = [(1, "x 1.2.3.4 y jo@mail1.example.com +1 (555) 123-4567 and 4111 1111 1111 1111", 0, "", ""), (1, "x 1.2.3.4 y", 0, "", ""),
            (2, None, 0, "", ""), (3, "", 0, "", ""), (None, "thin on call 1 (826) 555-7388 erth on tio", 0, "", ""),
            (4, "thin ther " * 20_000 + "10.0.0.1", 0, "", "")]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = pii.scan(docs, model, ["doc_id"]).withColumn("spans", pii.spans_text()).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_email"]): r for r in got}
    assert by[1, 1]["spans"] == pii.joined(brute(rows[0][1])) and [by[1, 1][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert by[1, 1]["base_sha256"] == hashlib.sha256(by[1, 1]["spans"].encode()).hexdigest()
    assert by[2, 0]["spans"] == "" and by[3, 0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[None, 0]["spans"].startswith("phone:") and by[None, 0]["n_phone"] == 0 and by[None, 0]["n_learned"] == 1
    assert by[4, 0]["spans"] == "ip:200000:200008"
    assert pii.scan(docs.limit(0), None, ["doc_id"]).collect() == []
