"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``K`` smallest of the distinct 48-bit hashes of a text's
five-word shingles (words: runs without ASCII white space; fewer words: the
whole sequence). Sketches merge: the union's sketch is the ``K`` smallest
hashes of both. Two sketches estimate resemblance (the share of the union's
sketch that both hold), containment, and the number of distinct shingles (from
the K-th smallest hash); all are exact up to ``K`` shingles.

Defined cases: null text is empty; an empty text has an empty sketch, is like
another empty one (1) and unlike any other (0); an empty table gives an empty
result; extra columns are ignored. In :func:`neighbours` equal ids are ordered
by a hash of the text, null ids come last, and a single row is its own
neighbour.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, field, map_batches, prepare_batches, staged
from .shingles import shingle_hashes, word_hashes

K, WORDS, BITS = 128, 5, 48
#: ranges of ids at most; each is sorted by one task, which may spill
RANGES = 4096


def sketches(texts: list[str], k: int = K) -> Iterator[np.ndarray]:
    """The sorted bottom-k sketch of each text."""
    for hashes in word_hashes([t.encode("utf-8", "surrogatepass") for t in texts]):
        # sorted before, so the shifted ones are sorted too
        short = shingle_hashes(hashes, WORDS) >> np.uint64(64 - BITS)
        yield short[np.concatenate([[True], short[1:] != short[:-1]])][:k] if len(short) else short


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float((both <= union[-1]).sum() / len(union))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0 ** BITS / float(a[-1] + np.uint64(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds (an empty text is in any)."""
    if not len(a):
        return 1.0
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return min(1.0, j * (n + m) / (1 + j) / n)


def to_text(sketch: np.ndarray) -> str:
    """Base64 of the hashes, six bytes each, in order."""
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.b64encode(raw.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    return np.hstack([np.zeros((len(raw), 2), np.uint8), raw]).reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", k: int = K) -> DataFrame:
    """``keep`` columns, ``sketch`` (array of longs) and the estimate ``n_distinct``."""
    schema = T.StructType([*(field(docs, c) for c in keep), T.StructField("sketch", T.ArrayType(T.LongType())),
                           T.StructField("n_distinct", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(sketches([t or "" for t in column(batch, text_col).to_pylist()], k))
        return pa.RecordBatch.from_arrays(
            [*(column(batch, c) for c in keep), pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64())),
             pa.array([distinct_shingles(s, k) for s in found], pa.float64())], names=schema.names)

    return map_batches(docs.select(*dict.fromkeys([*keep, text_col])), run, schema)


def merged(sketched: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One sketch per group of :func:`fingerprints` rows, whatever the group's size.

    The smallest distinct hashes are ranked in parts first, so that a group's last
    step reads at most ``k`` hashes a part.
    """
    rows = sketched.select(*by, F.explode("sketch").alias("__h")).distinct()
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__h"), F.lit(256)))
    for keys in ([*by, "__part"], by):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))
        rows = rows.withColumn("__rank", rank).where(F.col("__rank") <= k)
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list("__h")).alias("sketch"))


def _ranged(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) dealt by ranges of ids; the first row of a range ends the range before, too.

    Columns place, tail, id, h, text; a place holds its range in descending order, then that first row.
    """
    n = docs.count()
    ranges = max(1, min(RANGES, n // 64))
    found = docs.select(F.percentile_approx(F.col("id").cast("double"), [i / ranges for i in range(1, ranges)],
                                            10 * RANGES)).first()[0] if ranges > 1 else []
    splits = [-float("inf"), *sorted({float(x) for x in found or []}), float("inf")]
    splits = splits if len(splits) > 2 else [splits[0], 0.0, splits[-1]]
    cut = Bucketizer(splits=splits, inputCol="id_double", outputCol="bucket", handleInvalid="keep")
    rows = docs.withColumn("id_double", F.coalesce(F.col("id").cast("double"), F.lit(float("nan"))))
    # a missing id falls into the extra bucket: last in the order
    bucket = F.when(F.col("id").isNull(), -1).otherwise(F.col("bucket").cast("long"))
    rows = cut.transform(rows).select(bucket.alias("bucket"), "id", "text", F.xxhash64("text").alias("h"))
    heads = rows.groupBy("bucket").agg(F.max(F.struct("id", "h")).alias("head"))  # at most RANGES + 2 rows
    order = Window.orderBy("bucket")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = staged(heads.select("bucket", F.col("head.id").alias("head_id"), F.col("head.h").alias("head_h"),
                                F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(every)).alias("before")),
                   "fingerprint-ranges")
    rows = rows.join(F.broadcast(heads), "bucket")
    is_head = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    own = F.struct(F.col("bucket").alias("place"), F.lit(0).alias("tail"))
    tail = F.struct(F.col("before").alias("place"), F.lit(1).alias("tail"))
    rows = rows.select(F.explode(F.when(is_head, F.array(own, tail)).otherwise(F.array(own))).alias("to"),
                       "id", "h", "text").select("to.*", "id", "h", "text")
    return rows.repartition("place").sortWithinPartitions("place", "tail", F.col("id").desc_nulls_last(),
                                                          F.col("h").desc())


def edited(text: str, after: str) -> str:
    """The last half of ``text`` replaced by the first as many code points of ``after``."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness to it and to the next document's.

    The next document is that of the next smaller id (after the smallest: the largest).
    """
    rows = _ranged(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    text, double = T.StringType(), T.DoubleType()
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()),
        *(T.StructField(c, text) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
        *(T.StructField(c, double) for c in ("near_edited", "near_next", "contained_edited", "n_distinct"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            ids, tails, texts = (r + column(batch, c).to_pylist()
                                 for r, c in zip(rest, ("id", "tail", "text"), strict=True))
            rest = (ids[-1:], tails[-1:], texts[-1:])
            yield send(ids, tails, texts)

    def send(ids: list, tails: list, texts: list) -> pa.RecordBatch:
        own = list(sketches(texts, k))
        at = [i for i in range(len(ids) - 1) if not tails[i]]
        changed = [edited(texts[i], texts[i + 1]) for i in at]
        theirs = list(sketches(changed, k))
        cols = [pa.array([ids[i] for i in at], pa.int64() if isinstance(schema[0].dataType, T.LongType) else None),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                pa.array([to_text(own[i]) for i in at], pa.string()), pa.array([to_text(s) for s in theirs], pa.string()),
                pa.array([resemblance(own[i], s, k) for i, s in zip(at, theirs, strict=True)], pa.float64()),
                pa.array([resemblance(own[i], own[i + 1], k) for i in at], pa.float64()),
                pa.array([containment(own[i], s, k) for i, s in zip(at, theirs, strict=True)], pa.float64()),
                pa.array([distinct_shingles(own[i], k) for i in at], pa.float64())]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    prepare_batches(docs.sparkSession)
    return rows.mapInArrow(run, schema)
