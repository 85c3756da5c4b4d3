"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, strips marks, maps homoglyphs and reads digits and signs
inside words as the letters they stand for (``1d10t``, ``сlоwn``). The lexicon
is learned on Spark from all labelled rows that are not held out: a word's
weight is its smoothed log odds between toxic and other documents. Exception
phrases are pairs of words with a lexicon word whose documents are mostly not
toxic; a match inside one does not count. All patterns are matched in one pass
of an automaton at word borders. The score is logistic in the strongest match,
the sum of the matches, and that sum divided by the length; its few
coefficients are fitted on a bounded sample of the training rows
(``FIT_DOCS``).

Defined cases: null and empty texts have no match and score as such; without
both labels among the training rows nothing is learned and the score is the
share of toxic ones (0 without any row); repeated label rows count as often as
they occur; null labels are not used; a null id is held out.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_value, column, field, held_out, map_batches, staged

#: least documents of a term, least log odds, rows the coefficients are fitted on
LEAST_DOCS, LEAST_ODDS, FIT_DOCS = 5, 2.0, 20_000
#: bytes of terms and phrases that a task holds at most; a lexicon beyond that raises, nothing is left out
MOST_BYTES = 64 << 20

#: fixed values: letters that look like Latin ones, and signs written for letters
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏгвкмнтαβεικνορτυχγωı", "aeopcyxijsdhlrbkmhtabeiknoptuxywi", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
_INNER = re.compile(r"(?<=[a-z0134578@$!|])[0134578@$!|]+(?=[a-z])|(?<![a-z0134578@$!|])[0134578@$!|]+(?=[a-z])"
                    r"|(?<=[a-z])[013457]+(?![\w@$!|])")
_WORD = re.compile(r"[a-z]+")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


class _Fold(dict):
    """Character table that learns what it meets: base letter, homoglyph or itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
        out = "".join(HOMOGLYPHS.get(x, x) for x in base)
        if len(self) < 70_000:
            self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded text; words are runs of a-z in it."""
    if not text:
        return ""
    if not text.isascii():
        text = _INVISIBLE.sub("", text).translate(_FOLD)
    return _INNER.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text.lower())


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(fold(text)))


def pairs_of(text: str | None) -> set[str]:
    """Neighbouring pairs of words of a text."""
    words = _WORD.findall(fold(text))
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str]
    coefficients: list[float]


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.where("toxic is not null").select("doc_id", "toxic").where(~held_out())
    # the same plan at every size: labels have no bound that would let them be broadcast
    return docs.select("doc_id", "text").join(known.hint("merge"), "doc_id")


def _term_counts(rows: DataFrame, terms_of: Callable[[str | None], set[str]]) -> DataFrame:
    """(term, pos, neg): documents of either label with the term, summed by batch first."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(column(batch, "text").to_pylist(), column(batch, "toxic").to_pylist(), strict=True):
            for t in terms_of(text):
                counts.setdefault(t, [0, 0])[toxic == 1] += 1
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()),
             pa.array([c[0] for c in counts.values()], pa.int64())], names=["term", "pos", "neg"])

    sent = map_batches(rows.select("text", "toxic"), run, T.StructType(
        [T.StructField("term", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("neg", T.LongType())]))
    return sent.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon, exceptions and coefficients from the labelled rows that are not held out."""
    rows = staged(_training(docs, labels), "toxic-training", "zstd")
    n = {r.y: r.n for r in rows.groupBy((F.col("toxic") == 1).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(True, 0), n.get(False, 0)
    if not pos or not neg:
        return Lexicon({}, [], [math.inf if pos else -math.inf, 0.0, 0.0, 0.0])
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    # words first, then pairs: their shuffles are not on disk at one time
    counts = staged(_term_counts(rows, words_of).withColumn("odds", odds).where(F.col("pos") + F.col("neg") >= LEAST_DOCS),
                    "toxic-words")
    pairs = staged(_term_counts(rows, pairs_of).withColumn("odds", odds).where(
        (F.col("pos") + F.col("neg") >= LEAST_DOCS) & (F.col("neg") >= 3 * F.col("pos")) & (F.col("odds") < 0)), "toxic-pairs")
    words = counts.where(F.col("odds") >= LEAST_ODDS)
    _fits(words)
    weights = {r.term: float(r.odds) for r in words.select("term", "odds").collect()}
    # a word whose mild documents are mostly those of one phrase counts without that phrase
    inside = pairs.select(F.explode(F.split("term", " ")).alias("word"), F.col("term").alias("phrase"),
                          F.col("pos").alias("p"), F.col("neg").alias("n"))
    mostly = counts.join(inside, F.col("term") == F.col("word")).where(
        (F.col("n") * 2 >= F.col("neg")) & (F.col("pos") - F.col("p") >= LEAST_DOCS))
    rest = F.log((F.col("pos") - F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") - F.col("n") + 0.5) / (neg + 1.0))
    mostly = mostly.withColumn("rest", rest).where(F.col("rest") >= LEAST_ODDS).groupBy("word").agg(F.max("rest").alias("rest"))
    _fits(mostly.select(F.col("word").alias("term")))
    for r in mostly.collect():
        weights[r.word] = max(float(r.rest), weights.get(r.word, 0.0))
    exceptions: list[str] = []
    if weights:
        known = docs.sparkSession.createDataFrame([(w,) for w in weights], "w string")
        halves = pairs.select("term", F.explode(F.split("term", " ")).alias("w"))
        mild = halves.join(known, "w", "left_semi").select("term").distinct()
        _fits(mild)
        exceptions = sorted(r.term for r in mild.collect())
    lexicon = Lexicon(weights, exceptions, [0.0] * 4)
    share = min(1.0, FIT_DOCS / (pos + neg))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    fit = _matched(rows.where(draw < share), lexicon, ["toxic"]).limit(2 * FIT_DOCS).toArrow()
    x = np.stack([np.ones(len(fit)), *(fit[c].to_numpy() for c in ("strongest", "total", "rate"))], axis=1)
    lexicon.coefficients = _logistic(x, (fit["toxic"].to_numpy() == 1).astype(float))
    return lexicon


def _fits(terms: DataFrame) -> None:
    """Raise where terms have more bytes than a task is to hold."""
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"a lexicon of {size} bytes: at most {MOST_BYTES} fit a task; raise LEAST_DOCS or LEAST_ODDS")


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.1
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


class Matcher:
    """Aho-Corasick over the lexicon and its exception phrases."""

    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            self.automaton.add_word(f" {term} ", (len(term), weight, False))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(" " + phrase.replace(" ", "  ") + " ", (len(phrase) + 1, 0.0, True))
        self.any = bool(len(self.automaton))
        if self.any:
            self.automaton.make_automaton()

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Strongest match, sum of matches (log), and sum by length (words, log)."""
        words = _WORD.findall(fold(text)) if self.any else []
        if not words:
            return 0.0, 0.0, 0.0
        hits, excused = [], []
        for end, (n, weight, exception) in self.automaton.iter(" " + "  ".join(words) + " "):
            (excused if exception else hits).append((end - n, end, weight))
        excused.sort()
        begins, reach = [x for x, *_ in excused], list(accumulate((y for _, y, _ in excused), max))
        kept = [w for a, b, w in hits if not ((k := bisect_right(begins, a)) and reach[k - 1] >= b)]
        if not kept:
            return 0.0, 0.0, 0.0
        total = sum(kept)
        return max(kept), math.log1p(total), math.log1p(100 * total / len(words))


def _matched(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    shared = broadcast_value(docs.sparkSession, lexicon)  # bounded: MOST_BYTES
    names = ["strongest", "total", "rate"]
    schema = T.StructType([*(field(docs, c) for c in keep), *(T.StructField(n, T.DoubleType()) for n in names)])
    ready: list[Matcher] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not ready:
            ready.append(Matcher(shared()))
        found = [ready[0].features(t) for t in column(batch, "text").to_pylist()]
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep),
                                           *(pa.array([f[i] for f in found], pa.float64()) for i in range(3))],
                                          names=schema.names)

    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), run, schema)


def scores(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``keep`` columns, the features, ``score`` (0 to 1) and ``predicted``."""
    b, *w = lexicon.coefficients
    z = F.lit(b) + sum((F.col(c) * k for c, k in zip(("strongest", "total", "rate"), w, strict=True)), F.lit(0.0))
    out = _matched(docs, lexicon, keep).withColumn("score", 1 / (1 + F.exp(-z)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
