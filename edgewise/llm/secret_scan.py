"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every text: assignments, access keys, long hex
runs, and generic tokens that look random (several classes of characters, high
entropy). Every candidate's value is hashed, and the hashes are aggregated over
the whole corpus by distinct repository and distinct owner. A value that more
than ``MOST_OWNERS`` owners or more than ``MOST_REPOSITORIES`` repositories hold
is a copied example; one that stays below both is a live-looking credential.
Base spans always stay; a generic token adds a span only if it is live-looking.
Without a column of repositories each distinct whole text is one, so that copies
of a document count once, whoever owns them.

Defined cases: null text is empty; a null owner or repository is one of its own;
repeated rows are scanned each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, field, map_batches, staged

#: fixed values: the base kinds, in order, their patterns and least lengths
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
                    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: what the method adds: a generic token of one owner
OWNED = "owned"
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LEAST_ENTROPY = 3.5
#: owners and repositories that a live-looking value has at most
MOST_OWNERS, MOST_REPOSITORIES = 1, 8


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), leftmost and non-overlapping for each kind."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _overlap(begins: list[int], reach: list[int], start: int, end: int) -> bool:
    """Whether a span meets one of those that begin at ``begins``; ``reach``: the farthest end up to each."""
    k = bisect_left(begins, end)
    return k > 0 and reach[k - 1] > start


def generic_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Random-looking tokens that no base span overlaps."""
    out = []
    begins, reach = [a for _, a, _, _ in base], list(accumulate((b for *_, b, _ in base), max))
    for m in GENERIC.finditer(text):
        v = m[0]
        if not (any(map(str.isdigit, v)) and any(map(str.isalpha, v))):
            continue
        if entropy(v) >= LEAST_ENTROPY and not _overlap(begins, reach, m.start(), m.end()):
            out.append((OWNED, m.start(), m.end(), v))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, base counts and digest, and all candidates with the hash of their value."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()),
                         T.StructField("kind", T.StringType()), T.StructField("end", T.LongType()),
                         T.StructField("value", T.StringType())])
    schema = T.StructType([*(field(docs, c) for c in keep), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
                           T.StructField("base_sha256", T.StringType()), T.StructField("found", T.ArrayType(span))])
    order = {k: i for i, k in enumerate([*KINDS, OWNED])}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, found = [], [], []
        for text in column(batch, "text").to_pylist():
            base = base_spans(text or "")
            counts.append(Counter(s[0] for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            found.append([{"start": a, "rank": order[k], "kind": k, "end": b,
                           "value": hashlib.sha256(v.encode()).hexdigest()[:32]}
                          for k, a, b, v in base + generic_spans(text or "", base)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()),
                                   ("end", pa.int64()), ("value", pa.string())]))
        return pa.RecordBatch.from_arrays(
            [*(column(batch, c) for c in keep), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS),
             pa.array(digests, pa.string()), pa.array(found, kind)], names=schema.names)

    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """(value, repositories, owners, uses) over all candidates, the first two distinct; partial sums by value and name."""
    names = F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("name")) for c in ("owner", "repository")))
    each = found.select("value", F.explode(names).alias("n")).groupBy("value", "n.side", "n.name") \
        .agg(F.count(F.lit(1)).alias("uses"))
    owner = F.col("side") == "owner"
    return each.groupBy("value").agg(F.count_if(~owner).alias("repositories"), F.count_if(owner).alias("owners"),
                                     F.sum(F.when(owner, F.col("uses"))).alias("uses"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str | None = None,
         owner_col: str = "source", most_owners: int = MOST_OWNERS,
         most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """One row per input row: id, base counts and digest, ``spans`` (an array of all spans with
    their value's owners and repositories), ``n_copied`` and ``n_live``. Without ``repository_col``
    the whole text is the repository.
    """
    repository = F.col(repository_col).cast("string") if repository_col else F.substring(F.sha2(text_col, 256), 1, 32)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       repository.alias("repository"),
                       F.col(owner_col).cast("string").alias("owner"))
    rows = staged(candidates(docs, ["id", "repository", "owner"]).withColumn("row", F.monotonically_increasing_id()),
                  "secret-candidates")
    found = rows.select("row", "repository", "owner", F.explode("found").alias("f")).select(
        "row", "repository", "owner", "f.*")
    values = staged(ownership(found), "secret-ownership")
    copied = lambda s: (s["owners"] > most_owners) | (s["repositories"] > most_repositories)
    judged = found.join(values, "value").where((F.col("kind") != OWNED) | ~copied(
        {c: F.col(c) for c in ("owners", "repositories")}))
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct("start", "rank", "kind", "end", "value", "owners", "repositories"))).alias("spans"))
    # a document without candidates has no row here
    out = rows.drop("found", "repository", "owner").join(staged(spans, "secret-spans"), "row", "left") \
        .withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))
    return out.select(F.col("id").alias(id_col), *(f"n_{k}" for k in KINDS), "base_sha256", "spans",
                      F.size(F.filter("spans", copied)).cast("long").alias("n_copied"),
                      F.size(F.filter("spans", lambda s: ~copied(s))).cast("long").alias("n_live"))


def spans_text(spans="spans"):
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")
