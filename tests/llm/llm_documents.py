"""Documents with awkward rows, for the tests of every operator."""

from __future__ import annotations

import random

import pytest

#: more columns than documents has, some with names that operators use inside
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "k1 string, node int, sig int, row int, d string, t int, size int, found int, value int, runs int, "
          "place int, h int, bucket int, anchor int, kept string, c int")
AWKWARD = [None] * 16


def random_texts(n: int, seed: int = 7) -> list[str]:
    """Texts with shared passages, near copies and copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out: list[str] = []
    for _ in range(n):
        kind = rng.randrange(6)
        if kind == 0 and out:
            out.append(rng.choice(out))
        elif kind <= 2 and out:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
        else:
            w = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
            if kind == 3:
                w[len(w) // 2:len(w) // 2] = passage.split(" ")
            out.append(" ".join(w))
    return out


@pytest.fixture(scope="session")
def documents(spark):
    """make(rows of (doc_id, text, lang, source)) -> DataFrame of SCHEMA."""
    def make(rows):
        return spark.createDataFrame([(*r, None, *AWKWARD) for r in rows], SCHEMA).repartition(3)
    return make


@pytest.fixture(scope="session")
def awkward_rows():
    texts = random_texts(150)
    rows = [(i * 3, t, "en", f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    rows += [(900, None, None, None), (901, "", "en", "s1"), (902, " \n\t ", "en", "s1"), (903, "one", "en", "s1"),
             (904, "One two three", "en", "s1"), (905, "one TWO three", "en", "s1"), (906, "word " * 30_000, "en", "s2"),
             (907, "x" * 40_000, "en", "s2"), (908, texts[3].upper(), "en", "s0"), (909, "é\x00\x1c é\x85  y", "en", "s0")]
    return rows
