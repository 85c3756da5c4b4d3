"""Exact dedup by composable polynomial fingerprints.

A text is lower-cased (A-Z only) and cut into chunks of ``CHUNK`` bytes. Each
chunk hashes on its own, as a polynomial in a fixed base modulo two primes;
chunk hashes combine by length-shifted arithmetic
(``h(xy) = h(x) * base**len(y) + h(y)``), so a huge document, or one that
comes in several parts, needs no pass from left to right. Rows with the same
length and fingerprint form a group; every member is then compared byte by
byte with the member that stays, chunk against chunk. Groups in which that
comparison finds a difference are fingerprinted again with other bases.

Defined cases: a null text counts as empty; empty texts equal each other; of
equal texts the row with the largest id stays (null is below any id), and of
repeated rows with that id one stays; an empty table gives an empty result;
only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, field, map_batches, staged

CHUNK = 1 << 16
PRIMES = (2147483647, 2147483629)
#: bases of each comparison level: a level is used only where the one above collided
BASES = ((1103515245, 1299709193), (982451653, 1190494759), (715827883, 2038074743),
         (1540483477, 668265263), (374761393, 1431655751))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
KEYS = ["n_bytes", "fp1", "fp2"]


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**(n-1), ..., base, 1 modulo prime."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, prime))
        take = min(done, n - done)
        out[done:done + take] = out[:take] * step % np.uint64(prime)
        done += take
    return out[::-1].copy()


def chunk_hash(data: np.ndarray, table: np.ndarray, prime: int) -> int:
    """Hash of one chunk of at most ``CHUNK`` bytes (values shifted by one)."""
    return int(np.dot(data.astype(np.uint64) + np.uint64(1), table[len(table) - len(data):])) % prime


def combine(left: int, right: int, right_len: int, base: int, prime: int) -> int:
    """Hash of the concatenation of two parts."""
    return (left * pow(base, right_len, prime) + right) % prime


def fingerprint(data: bytes, tables, bases, primes=PRIMES, chunk: int = CHUNK) -> tuple[int, ...]:
    """Fingerprint of a byte string: chunk hashes, combined."""
    raw, out = np.frombuffer(data, np.uint8), []
    for table, base, prime in zip(tables, bases, primes, strict=True):
        h = 0
        for at in range(0, len(raw), chunk):
            part = raw[at:at + chunk]
            h = combine(h, chunk_hash(part, table, prime), len(part), base, prime)
        out.append(h)
    return tuple(out)


def with_fingerprints(docs: DataFrame, level: int = 0, text_col: str = "text", primes=PRIMES,
                      digest: bool = False, chunks: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_bytes, fp1, fp2``; with the SHA-256 (hex) and chunk list if asked for."""
    bases = BASES[level]
    names = docs.columns if keep is None else keep
    fields = [field(docs, c) for c in names]
    fields += [T.StructField(k, T.LongType()) for k in KEYS]
    if digest:
        fields.append(T.StructField("text_sha256", T.StringType()))
    if chunks:
        fields.append(T.StructField("chunks", T.ArrayType(T.BinaryType())))
    tables: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not tables:
            tables.extend(powers(b, p, CHUNK) for b, p in zip(bases, primes, strict=True))
        data = [normalise(t) for t in column(batch, text_col).to_pylist()]
        fps = [fingerprint(d, tables, bases, primes) for d in data]
        cols = [column(batch, c) for c in names]
        cols += [pa.array([len(d) for d in data], pa.int64()),
                 pa.array([f[0] for f in fps], pa.int64()), pa.array([f[1] for f in fps], pa.int64())]
        if digest:
            cols.append(pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()))
        if chunks:
            cols.append(pa.array([[d[i:i + CHUNK] for i in range(0, len(d), CHUNK)] for d in data],
                                 pa.list_(pa.binary())))
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return map_batches(docs.select(*dict.fromkeys([*names, text_col])), run, T.StructType(fields))


def _differing(docs: DataFrame, groups: DataFrame, id_col: str, level: int, primes) -> DataFrame:
    """Keys of groups with a member whose bytes differ from those of the one that stays."""
    many = groups.where("group_size > 1").select(*KEYS, "keep_id")
    rows = with_fingerprints(docs, level, primes=primes, chunks=True, keep=[id_col])
    # always the shuffle plan: the texts of single documents end at the merge
    members = (rows.join(many.hint("merge"), KEYS)
               .select(*KEYS, F.col(id_col).eqNullSafe(F.col("keep_id")).alias("stays"),
                       F.posexplode("chunks").alias("at", "chunk")))
    members = staged(members, "dedup-members")
    kept = staged(members.where("stays").groupBy(*KEYS, "at").agg(F.min("chunk").alias("kept_chunk")),
                  "dedup-kept")
    return (members.join(kept, [*KEYS, "at"]).where("chunk <> kept_chunk")
            .select(*KEYS).distinct())


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  primes=PRIMES, level: int = 0) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    docs = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    table = with_fingerprints(docs, level, primes=primes, digest=True, keep=[id_col])
    table = staged(table.withColumn("row", F.monotonically_increasing_id()), "dedup-fingerprints")
    groups = staged(table.groupBy(*KEYS).agg(
        F.max(F.struct(F.col(id_col).alias("id"), F.col("row").alias("row"))).alias("last"),
        F.count(F.lit(1)).alias("group_size"))
        .select(*KEYS, F.col("last.id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size"),
        "dedup-groups")
    differ = staged(_differing(docs, groups, id_col, level, primes), "dedup-differing")
    rows = table.join(groups, KEYS)
    rest = None
    if differ.take(1):
        if level + 1 >= len(BASES):
            raise RuntimeError("fingerprints of different texts agree under every base")
        rows = rows.join(differ, KEYS, "left_anti")
        again = with_fingerprints(docs, level, primes=primes).join(differ, KEYS, "left_semi")
        rest = exact_classes(again.select(id_col, "text"), id_col, "text", PRIMES, level + 1)
    out = rows.select(id_col, "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                      "text_sha256")
    return out.unionByName(rest) if rest is not None else out


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_classes` drops; all columns stay."""
    plain = docs.select(id_col, text_col)
    classes = exact_classes(plain, id_col, text_col)
    gone = (classes.where(~F.col("kept"))
            .select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"),
                    F.col("keep_id").alias("__keep")).distinct())
    gone = staged(gone, "dedup-gone")
    sha = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")),
                             "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256)
    keyed = docs.withColumn("__text_sha", sha)
    cond = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_sha") == F.col("__sha"))
    lower = keyed.join(gone.where(~F.col("__id").eqNullSafe(F.col("__keep"))).select("__id", "__sha")
                       .hint("merge"), cond, "left_anti")
    repeated = gone.where(F.col("__id").eqNullSafe(F.col("__keep"))).select("__id", "__sha")
    if not repeated.take(1):
        return lower.drop("__text_sha")
    once = lower.join(repeated, cond, "left_semi").dropDuplicates([id_col, "__text_sha"])
    return lower.join(repeated, cond, "left_anti").unionByName(once).drop("__text_sha")
