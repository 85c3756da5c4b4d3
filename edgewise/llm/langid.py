"""Language ID: known words first, shorter and shorter character n-grams after.

The model is fitted on a bounded sample of labelled documents (at most
``SAMPLE_DOCS`` a language, chosen by a hash of the id), with counts made on
Spark. It holds per-language log frequencies of at most ``MAX_WORDS`` words and
``MAX_GRAMS`` n-grams of each length and language. A known word scores its own
log frequencies; an unseen one is covered position by position with the longest
known n-gram (4, 3, 2, then 1 character), each step down with a penalty.

Defined cases: null or letterless text is ``und`` with score 0; ties go to the
first language by name; without any labelled text every row is ``und``; a null
id is held out; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_value, column, field, held_out, map_batches, staged

SAMPLE_DOCS, MAX_WORDS, MAX_GRAMS, ORDER = 1000, 10_000, 10_000, 4
UNDETERMINED = "und"
#: words remembered by a task between batches
CACHE_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    found = _WORD.findall(text.lower()) if text else []
    if found and not any(any(map(str.isalpha, w)) for w in found):
        return []
    return found


@dataclass
class Model:
    """Per-language log frequencies of words and n-grams, by row of a matrix."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    unseen: np.ndarray


def sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS, seed: int = 17) -> DataFrame:
    """At most ``per_lang`` labelled rows (lang, text) a language, not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # a written table: its size decides whether the join broadcasts it
    counts = staged(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-counts")
    near = (known.select("doc_id", "lang", "text", draw.alias("draw"))
            .join(counts, "lang")
            .where(F.col("draw") < 2.0 * per_lang / F.col("n")))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    return (near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_lang)
            .select("lang", "text"))


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts: dict[tuple[str, int, str], int] = {}
    for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist(), strict=True):
        for w in words_of(text):
            key = (lang, 0, w)
            counts[key] = counts.get(key, 0) + 1
            marked = f"\x02{w}\x03"
            for n in range(1, ORDER + 1):
                for i in range(len(marked) - n + 1):
                    key = (lang, n, marked[i:i + n])
                    counts[key] = counts.get(key, 0) + 1
    keys = list(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
         pa.array([k[2] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
        names=["lang", "n", "gram", "c"])


def fit(docs: DataFrame, per_lang: int = SAMPLE_DOCS) -> Model | None:
    """Fit on the sample; None when there is no labelled text."""
    counted = map_batches(sample(docs, per_lang), _counted, T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("n", T.IntegerType()),
        T.StructField("gram", T.StringType()), T.StructField("c", T.LongType())]))
    totals = counted.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))
    top = (totals.withColumn("at", rank)
           .where(F.col("at") <= F.when(F.col("n") == 0, MAX_WORDS).otherwise(MAX_GRAMS)))
    rows = top.select("lang", "n", "gram", "c").toArrow().to_pylist()  # bounded by the two maxima
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    at = {lang: i for i, lang in enumerate(langs)}
    words: dict[str, int] = {}
    grams: dict[str, int] = {}
    for r in rows:
        where = grams if r["n"] else words
        where.setdefault(r["gram"], len(words) + len(grams))
    table = np.zeros((len(words) + len(grams), len(langs)))
    size = np.zeros((ORDER + 1, len(langs)))
    kinds = np.zeros(len(table), np.int64)
    for r in rows:
        i = (grams if r["n"] else words)[r["gram"]]
        table[i, at[r["lang"]]] = r["c"]
        kinds[i] = r["n"]
        size[r["n"], at[r["lang"]]] += r["c"]
    vocabulary = np.bincount(kinds, minlength=ORDER + 1)
    scale = size[kinds] + 0.5 * vocabulary[kinds][:, None]
    table = np.log((table + 0.5) / scale)
    # a character no language has seen tells nothing
    unseen = np.full(len(langs), math.log(1e-6))
    return Model(langs, words, grams, table, unseen)


def word_scores(model: Model, word: str) -> np.ndarray:
    """Per-language scores of one word: its own row, or the backoff cover."""
    if (i := model.words.get(word)) is not None:
        return model.table[i]
    marked = f"\x02{word}\x03"
    total, at, steps = np.zeros(len(model.langs)), 0, 0
    while at < len(marked):
        for n in range(min(ORDER, len(marked) - at), 0, -1):
            if (i := model.grams.get(marked[at:at + n])) is not None:
                total = total + model.table[i] - (ORDER - n)
                at += max(1, n - 1)
                break
        else:
            total = total + model.unseen
            at += 1
        steps += 1
    return total / max(1, steps)


def predictor(model: Model):
    """text -> (language, score); remembers a bounded number of words."""
    seen: dict[str, int] = {}
    matrix = np.zeros((CACHE_WORDS, len(model.langs)))

    def row(word: str) -> int:
        if (i := seen.get(word)) is None:
            i = seen[word] = len(seen)
            matrix[i] = word_scores(model, word)
        return i

    def predict(text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words:
            return UNDETERMINED, 0.0
        total = np.zeros(len(model.langs))
        for at in range(0, len(words), CACHE_WORDS // 4):
            part = words[at:at + CACHE_WORDS // 4]
            if len(seen) + len(part) > CACHE_WORDS:
                seen.clear()
            rows = [row(w) for w in part]
            total += matrix[rows].sum(axis=0)
        # the mean word, as often as there are words, up to 20
        spread = total / len(words) * min(len(words), 20)
        p = np.exp(spread - spread.max())
        best = int(p.argmax())
        return model.langs[best], float(p[best] / p.sum())

    return predict


def predictions(docs: DataFrame, train: DataFrame | None = None, per_lang: int = SAMPLE_DOCS,
                id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: the id) with ``lang_pred`` and ``score`` for every row.

    ``train`` has doc_id, text and lang; without it the rows of ``docs`` are used.
    """
    spark = docs.sparkSession
    model = fit(train if train is not None else docs, per_lang)
    shared = broadcast_value(spark, model)
    names = keep if keep is not None else [id_col]
    schema = T.StructType([*(field(docs, c) for c in names), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    ready: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not ready:
            model = shared()
            ready.append(predictor(model) if model else lambda text: (UNDETERMINED, 0.0))
        found = [ready[0](t) for t in column(batch, "text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*(column(batch, c) for c in names), pa.array([f[0] for f in found], pa.string()),
             pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return map_batches(docs.select(*dict.fromkeys([*names, "text"])), run, schema)
