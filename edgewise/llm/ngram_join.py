"""N-gram Jaccard join: universe partitioning, pigeonhole, exact verification.

Sets of word shingles fall into size bands. In a band the universe of shingles
is hashed into segments; two sets that link differ in at most ``d`` shingles,
so, when the segments' thresholds add up to more than ``d``, some segment
differs by less than its threshold. A threshold of 1 asks for equal segments
(one signature), one of 2 also for segments that differ by one shingle (the
one-deletion neighbourhood). Thresholds are allocated at the lowest expected
cost, measured on a bounded sample: cost decides only how much work is done,
not what is found. A set sends signatures in the order of that allocation, a
subset of segments that is just large enough for its own size; empty segments
don't count. Sets whose segments are too empty for that send all, with the
empty ones.

Sets with a common signature are candidates. Equal sets are one node. Each
bucket first compares its members with one centre; verified links merge nodes
into components, and what a bucket still holds of several components is
compared (the nearest pair of each two components first, then) member by member, so every link
between different components is found while linked groups need no pairs.
Verification is exact: a pair that reaches the similarity by its 64-bit shingle hashes
is compared again by its shingles' words before it links. Texts are sent only for pairs
that a parity sketch as wide as their sets lets pass: long texts share signatures by
chance, and the pairs of those grow faster than the table. Sets count as equal by a
96-bit key of their hashes.

Defined cases: null text is empty; a text without words is linked with nothing
(its component is its own id); rows with equal sets share a component, named by
its smallest id (nulls are ignored); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, discard, field, map_batches, prepare_batches, staged
from .exact_dedup import normalise
from .shingles import mix, shingle_hashes, word_hashes

#: percent of the union that the intersection reaches, words a shingle
SIMILARITY, WORDS = 85, 4
#: documents in the cost sample, share of them that makes a signature hot, parts of a hot centre
SAMPLE_DOCS, HOT_SHARE, CENTRE_ROWS = 2048, 0.002, 1024
#: rounds of one centre a bucket before members of different components meet
CENTRE_ROUNDS = 1
#: bits of the parity sketch that bucket rows carry: they differ in no more places than the sets do
SKETCH_BITS = 512
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
_BAND_GROWTH = 1.5


class Bands:
    """Size bands and the differences that linked sets in them can have."""

    def __init__(self, similarity: int):
        self.similarity = similarity
        self.starts = [1]

    def _grow(self, size: int) -> None:
        while self.starts[-1] <= size:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * _BAND_GROWTH)))

    def difference(self, total: int) -> int:
        """Most shingles in which two linked sets of ``total`` shingles together differ."""
        s = self.similarity
        return (100 - s) * total // (100 + s)

    def partner(self, size: int) -> int:
        """Size of the largest set that can link with one of ``size``."""
        return 100 * size // self.similarity

    def last(self, band: int) -> int:
        """Largest size whose own band this is."""
        while len(self.starts) <= band + 1:
            self._grow(self.starts[-1])
        return self.starts[band + 1] - 1

    def top(self, band: int) -> int:
        """Largest size in the band: a partner of the largest own one."""
        return self.partner(self.last(band))

    def of(self, size: int) -> list[int]:
        """Bands of a set: a linked pair meets in the band of the smaller one."""
        self._grow(size)
        band = max(b for b in range(len(self.starts)) if self.starts[b] <= size)
        first = band
        while first and size <= self.top(first - 1):
            first -= 1
        return list(range(first, band + 1))

    def segments(self, band: int) -> int:
        """Segments of a band: one more than the largest difference, and some to spare."""
        need = self.difference(self.last(band) + self.top(band)) + 1
        return need + need // 6

    def need(self, band: int, size: int) -> int:
        """Thresholds that a set of ``size`` must reach in a band."""
        return self.difference(size + min(self.top(band), self.partner(size))) + 1


def segment_sums(tokens: np.ndarray, band: int, m: int) -> tuple[np.ndarray, ...]:
    """(tokens by segment, their segment, segments that occur, their first place, their sum)."""
    # the high bits choose the segment, so that equal tokens always share one
    segment = ((mix(tokens + np.uint64(band * 2 + 1)) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(segment, kind="stable")
    tokens, segment = mix(tokens[order]), segment[order]
    present, first = np.unique(segment, return_index=True)
    return tokens, segment, present, first, np.add.reduceat(tokens, first)


def _key(sums: np.ndarray, segment: np.ndarray, band: int) -> np.ndarray:
    return mix(sums ^ mix(segment + np.uint64(band << 32) + np.uint64(1)))


def signatures(tokens: np.ndarray, band: int, bands: Bands, plan: list[tuple[int, bool]]) -> np.ndarray:
    """Signatures of a set in a band under ``plan``: (segment, with deletions) in order."""
    m, need = bands.segments(band), bands.need(band, len(tokens))
    rows, segment, present, first, sums = segment_sums(tokens, band, m)
    count = np.zeros(m, np.int64)
    count[present] = np.diff(np.append(first, len(rows)))
    total = np.zeros(m, np.uint64)
    total[present] = sums
    segs = np.array([s for s, _ in plan], np.int64)
    deletes = np.array([d for _, d in plan], bool)
    usable = np.where(deletes, count[segs] >= 2, count[segs] >= 1)
    reached = np.cumsum(usable)
    sparse = not len(reached) or reached[-1] < need
    if not sparse:
        upto = int(np.searchsorted(reached, need)) + 1
        segs, deletes, usable = segs[:upto], deletes[:upto], usable[:upto]
    else:
        usable = np.ones(len(segs), bool)
    exact = segs[~deletes & usable]
    out = [_key(total[exact], exact.astype(np.uint64), band)]
    wide = np.zeros(m, bool)
    wide[segs[deletes & usable]] = True
    if wide.any():
        mine = wide[segment.astype(np.int64)]
        out.append(_key(total[segment[mine].astype(np.int64)] - rows[mine], segment[mine], band))
    return np.concatenate(out)


def default_plan(m: int) -> list[tuple[int, bool]]:
    return [(s, False) for s in range(m)]


def allocate(m: int, exact_cost: np.ndarray, wide_cost: np.ndarray) -> list[tuple[int, bool]]:
    """Thresholds in the order of their marginal cost: a segment's second step follows its first."""
    heap = [(float(exact_cost[s]), s, False) for s in range(m)]
    heapq.heapify(heap)
    plan = []
    while heap:
        _, s, wide = heapq.heappop(heap)
        plan.append((s, wide))
        if not wide:
            heapq.heappush(heap, (max(float(wide_cost[s] - exact_cost[s]), float(exact_cost[s])), s, True))
    return plan


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """96-bit key of a set, its size in the low half of the second part (two signed longs)."""
    with np.errstate(over="ignore"):
        a = int(mix(tokens).sum(dtype=np.uint64)) ^ len(tokens)
        b = int(mix(tokens + np.uint64(0x51ED270B)).sum(dtype=np.uint64)) >> 33
    return (a ^ (1 << 63)) - (1 << 63), (b << 32) | len(tokens)


def parity_sketch(tokens: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each of ``bits`` hash classes whether it holds an odd number of shingles."""
    at = (mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1).view(np.int64)


def wide_bits(size: int, similarity: int) -> int:
    """Bits of a set's wide sketch: four times the most shingles in which a set of its size that links with it differs.

    Unlinked sets differ in about half of the bits. A power of two, so that a sketch folds to a narrower one.
    """
    return max(SKETCH_BITS, 1 << max(0, 4 * Bands(similarity).difference(2 * size) - 1).bit_length())


def sketches_near(a: np.ndarray, n: int, b: np.ndarray, m: int, similarity: int) -> bool:
    """The wide sketches of two sets of ``n`` and ``m`` shingles allow them to link (whoever links passes)."""
    words = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in (a, b))
    apart = int(np.bitwise_count((a ^ b).view(np.uint64)).sum(dtype=np.int64))
    return apart * (100 + similarity) <= (n + m) * (100 - similarity)


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    for hashes in word_hashes([normalise(t) for t in texts]):
        yield shingle_hashes(hashes, words)


def word_shingles(text: str | None, words: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves: tuples of words; the whole sequence if there are fewer."""
    found = normalise(text).split()
    n = min(words, len(found))
    return {tuple(found[i:i + n]) for i in range(len(found) - n + 1)} if n else set()


def alike(a: set, b: set, similarity: int) -> bool:
    both = len(a & b)
    return 100 * both >= similarity * (len(a) + len(b) - both)


# ---- on Spark -----------------------------------------------------------------------------------

def _size():
    """Size of a set, from its key."""
    return F.expr("k2 & 4294967295")


def keyed(docs: DataFrame, words: int, keep: list[str], similarity: int | None = None) -> DataFrame:
    """``keep`` columns with the set key (k1, k2), and with a ``similarity`` the sketch and the wide one for it."""
    more = ["k1", "k2", *(SKETCH if similarity else [])]
    schema = T.StructType([*(field(docs, c) for c in keep), *(T.StructField(n, T.LongType()) for n in more),
                           *([T.StructField("wide", T.BinaryType())] if similarity else [])])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(column(batch, "text").to_pylist(), words))
        keys, wide = np.array([set_key(s) for s in sets], np.int64), []
        if similarity:
            each = [parity_sketch(s, wide_bits(len(s), similarity)) for s in sets]
            narrow = [np.bitwise_xor.reduce(x.reshape(-1, len(SKETCH)), axis=0) for x in each]
            keys, wide = np.hstack([keys, np.array(narrow)]), [pa.array([x.tobytes() for x in each], pa.binary())]
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep),
                                           *(pa.array(np.ascontiguousarray(k)) for k in keys.T), *wide], names=schema.names)

    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), run, schema)


def _costs(docs: DataFrame, n_docs: int, similarity: int, words: int, sample_docs: int):
    """Plans by band and hot signatures, from a bounded sample of documents."""
    share = min(1.0, sample_docs / max(1, n_docs))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    picked = docs.where(draw < share) if share < 1 else docs
    bands = Bands(similarity)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for s in shingle_sets(column(batch, "text").to_pylist(), words):
            for band in bands.of(len(s)) if len(s) else ():
                m = bands.segments(band)
                rows, segment, present, first, sums = segment_sums(s, band, m)
                sigs = [_key(sums, present, band), _key(sums[np.searchsorted(present, segment)] - rows, segment, band)]
                for wide, (sig, seg) in enumerate(zip(sigs, (present, segment), strict=True)):
                    for col, x in zip(out, (sig.view(np.int64), np.full(len(sig), band), seg.astype(np.int64),
                                            np.full(len(sig), wide), np.full(len(sig), set_key(s)[0])), strict=True):
                        col.append(x)
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                          names=["sig", "band", "seg", "wide", "k1"])

    each = map_batches(picked.select("text"), run, T.StructType(
        [T.StructField(n, T.LongType()) for n in ("sig", "band", "seg", "wide", "k1")])).distinct()
    hot_from = max(8, int(HOT_SHARE * share * n_docs))
    per = each.groupBy("sig", "band", "seg", "wide").agg(F.count(F.lit(1)).alias("n")).groupBy("band", "seg", "wide").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"),
        F.collect_list(F.when(F.col("n") >= hot_from, F.col("sig"))).alias("hot")).collect()
    hot = np.array(sorted({x for r in per for x in r.hot}), np.int64)
    exact: dict[int, np.ndarray] = {}
    wide: dict[int, np.ndarray] = {}
    for r in per:
        m = bands.segments(r.band)
        into = wide if r.wide else exact
        # a row sent costs 1, a candidate pair of the sample stands for more
        into.setdefault(r.band, np.full(m, 0.0))[r.seg] = r.rows + 4.0 * r.pairs
    plans = {b: allocate(bands.segments(b), exact[b], exact[b] + wide.get(b, np.zeros(len(exact[b]))))
             for b in exact}
    return plans, hot


def bucket_rows(docs: DataFrame, plans: dict, hot: np.ndarray, similarity: int, words: int) -> DataFrame:
    """(sig, k1) of buckets with two different sets at least, once for each set.

    The first part of the key tells sets apart; where it does not, each set gets what the other sent.
    The lowest bit of a signature says whether it is hot.
    """
    shared = docs.sparkSession.sparkContext.broadcast((plans, hot))  # bounded by the sample
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("sig", "k1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, hot = shared.value
        bands, seen = Bands(similarity), set()
        for batch in batches:
            sigs, keys = [], []
            for s in shingle_sets(column(batch, "text").to_pylist(), words):
                if not len(s) or (key := set_key(s)) in seen:
                    continue  # copies of a set send once a task
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(key)
                found = [signatures(s, b, bands, plans.get(b) or default_plan(bands.segments(b)))
                         for b in bands.of(len(s))]
                sigs.append(np.concatenate(found))
                keys.append((key[0], len(sigs[-1])))
            if not sigs:
                continue
            sig = np.concatenate(sigs).view(np.int64)
            cols = [(sig & ~np.int64(1)) | np.isin(sig & ~np.int64(1), hot & ~np.int64(1)),
                    np.repeat(np.array([k[0] for k in keys], np.int64), [k[1] for k in keys])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=schema.names)

    prepare_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(run, schema)
    # hot buckets need no test
    is_hot = F.col("sig").bitwiseAND(F.lit(1)) == 1
    of = Window.partitionBy("sig", F.when(is_hot, F.xxhash64("k1"))).orderBy("k1")
    last = F.last("k1").over(of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.lag("k1").over(of)
    first = F.first("k1").over(of)
    return (rows.select("sig", "k1", (is_hot | (first != last)).alias("several"), (~before.eqNullSafe(F.col("k1"))).alias("new"))
            .where("several and new").select("sig", "k1"))


def _meet(pairs: DataFrame, values: DataFrame, read, matches) -> DataFrame:
    """Of (centre, node) pairs those whose ``values`` match. A centre's members are dealt out in parts.

    ``read`` makes a list of a batch's values, one a row; ``matches(centre's, member's)`` decides.
    """
    per = staged(pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("n")), "join-centres")
    parts = F.ceil(F.col("n") / CENTRE_ROWS)
    members = pairs.join(per, "centre").select("centre", "node", F.pmod(F.xxhash64("node"), parts).alias("part"),
                                               F.lit(1).alias("member"))
    heads = per.select("centre", F.col("centre").alias("node"),
                       F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(0).alias("member"))
    rows = members.unionByName(heads).join(values, "node")
    rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, None
        for batch in batches:
            centres, nodes = column(batch, "centre").to_pylist(), column(batch, "node").to_pylist()
            parts, members = column(batch, "part").to_pylist(), column(batch, "member").to_pylist()
            out: list[tuple[int, int]] = []
            for c, v, p, member, value in zip(centres, nodes, parts, members, read(batch), strict=True):
                if not member:
                    now, head = (c, p), value
                    continue
                if now != (c, p):
                    raise RuntimeError("a centre's members came without it")
                if matches(head, value):
                    out.append((c, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                              pa.array([x[1] for x in out], pa.int64())], names=["centre", "node"])

    return rows.mapInArrow(run, "centre long, node long")


def _close(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Of (centre, node) pairs those that their wide sketches let pass."""
    def read(batch: pa.RecordBatch) -> list[tuple[np.ndarray, int]]:
        return [(np.frombuffer(w, np.int64), n) for w, n in zip(
            column(batch, "wide").to_pylist(), column(batch, "n").to_pylist(), strict=True)]

    return _meet(pairs, nodes.select("node", "wide", _size().alias("n")), read,
                 lambda a, b: sketches_near(*a, *b, similarity))


def _links(pairs: DataFrame, texts: DataFrame, similarity: int, words: int) -> DataFrame:
    """Of (centre, node) pairs the verified ones."""
    def read(batch: pa.RecordBatch) -> Iterator[list]:
        found = column(batch, "text").to_pylist()
        # text, hashes of its shingles, the shingles once they are asked for
        return ([text, s, None] for text, s in zip(found, shingle_sets(found, words), strict=True))

    def matches(head: list, other: list) -> bool:
        a, b = head[1], other[1]
        both = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * both < similarity * (len(a) + len(b) - both):
            return False
        head[2] = word_shingles(head[0], words) if head[2] is None else head[2]
        return alike(head[2], word_shingles(other[0], words), similarity)

    return _meet(pairs, texts, read, matches)


def component_labels(links: DataFrame) -> DataFrame:
    """(node, label) of linked nodes, label the smallest node of the component.

    Large-star and small-star rounds, each a partial minimum and a join, staged.
    """
    after = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .where("u <> v").distinct(), "join-edges")
    while _not_stars(after).take(1):
        both = after.unionByName(after.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that a hub's rows can be split in the join
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
                       "join-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        after = staged(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "join-edges")
    return staged(after.select(F.col("u").alias("node"), F.col("v").alias("label"))
                  .unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()),
                  "join-labels")


def _not_stars(edges: DataFrame) -> DataFrame:
    """Nodes with two parents, or with a parent and a child."""
    ends = edges.select("u", F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up")))
    ups = ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return ups.where("ups > 1 or (ups = 1 and low = 0)")


def _classes(docs: DataFrame, similarity: int, words: int, sample_docs: int,
             centre_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their set key, one row per set: component_id, first_id and whether it stands for its component)."""
    rows = staged(keyed(docs, words, ["doc_id"], similarity), "join-rows")
    nodes = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in [*SKETCH, "wide"]))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "join-nodes")
    plans, hot = _costs(docs, rows.count(), similarity, words, sample_docs)
    buckets = bucket_rows(docs, plans, hot, similarity, words).join(nodes.drop("first_id", "wide"), "k1")
    buckets = staged(buckets.select("sig", "node", _size().alias("n"), *SKETCH), "join-buckets")
    labels = _label_rounds(docs, nodes, buckets, similarity, words, centre_rounds)
    sets = nodes.select("node", "k1", "k2", "first_id").join(labels, "node", "left") \
        .withColumn("label", F.coalesce("label", "node"))
    first = F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "node")
    names = staged(sets.groupBy("label").agg(F.min(first).alias("first")), "join-names")
    sets = staged(sets.join(names, "label").select(
        "k1", "k2", "first_id", F.col("first.first_id").alias("component_id"),
        (F.col("node") == F.col("first.node")).alias("stands")), "join-named")
    return rows.select("doc_id", "k1", "k2"), sets


def components(docs: DataFrame, similarity: int = SIMILARITY, words: int = WORDS, id_col: str = "doc_id",
               text_col: str = "text", sample_docs: int = SAMPLE_DOCS, centre_rounds: int = CENTRE_ROUNDS) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, sets = _classes(docs, similarity, words, sample_docs, centre_rounds)
    # sets without shingles are linked with nothing, not even with each other
    return rows.join(sets, ["k1", "k2"]).select(
        F.col("doc_id").alias(id_col), _size().alias("n_shingles"),
        F.when(_size() == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, similarity: int = SIMILARITY, words: int = WORDS, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component (its smallest id) and all without words; all columns stay.

    Rows that repeat both id and words all stay or all go.
    """
    boxed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, sets = _classes(boxed.select("doc_id", "text"), similarity, words, SAMPLE_DOCS, CENTRE_ROUNDS)
    gone = rows.join(sets, ["k1", "k2"]).where((_size() > 0) & ~(
        F.col("stands") & F.col("doc_id").eqNullSafe(F.col("first_id"))))
    gone = staged(gone.select(F.col("doc_id").alias("g_id"), F.col("k1").alias("g1"), F.col("k2").alias("g2"))
                  .distinct(), "join-gone")
    here = keyed(boxed, words, ["doc", "doc_id"])
    return here.join(gone.hint("merge"), (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))
                     & F.col("doc_id").eqNullSafe(F.col("g_id")), "left_anti").select("doc.*")


def _label_rounds(docs: DataFrame, nodes: DataFrame, buckets: DataFrame, similarity: int, words: int,
                  centre_rounds: int) -> DataFrame:
    """Labels of linked nodes: rounds of candidate pairs, verification and merging."""
    labels = nodes.where(F.lit(False)).select("node", F.col("node").alias("label"))
    checked, mixed = None, buckets.withColumn("label", F.col("node"))
    for turn in range(centre_rounds + 2):
        if turn or not centre_rounds:
            mixed = _mixed(buckets, labels)
        if turn < centre_rounds:
            pairs = _centre_pairs(mixed, turn, similarity)
        else:
            # the nearest pair of each two components first: one link makes their other pairs needless
            pairs = _all_pairs(mixed, similarity, nearest=turn == centre_rounds)
        pairs = pairs.select("centre", "node").distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["centre", "node"], "left_anti")
        pairs = staged(pairs, "join-candidates")
        if not pairs.take(1):
            continue
        close = staged(_close(pairs, nodes, similarity), "join-close")
        texts = _texts(docs, nodes, close, words)
        found = staged(_links(close, texts, similarity, words), "join-links")
        discard(texts)
        turned = pairs.unionByName(pairs.select(F.col("node").alias("centre"), F.col("centre").alias("node")))
        checked = turned if checked is None else checked.unionByName(turned)
        new = found.select(F.col("centre").alias("u"), F.col("node").alias("v"))
        if turn:
            new = new.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v")))
        labels = component_labels(new)
    return labels


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(node, text) of the nodes of ``pairs``: of one row of each, the one with its first id and its key."""
    both = pairs.select("node").unionByName(pairs.select(F.col("centre").alias("node"))).distinct()
    wanted = staged(nodes.join(both, "node").select(F.col("first_id").alias("want"), F.col("k1").alias("w1"),
                                                    F.col("k2").alias("w2"), "node"), "join-wanted")
    near = docs.join(wanted.select("want").distinct(), F.col("doc_id").eqNullSafe(F.col("want")), "left_semi")
    texts = keyed(near, words, ["doc_id", "text"]).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("want")) & (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")))
    return staged(texts.groupBy("node").agg(F.first("text").alias("text")), "join-texts")


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold several components, with their label and the bucket's blocks."""
    names = labels.withColumnRenamed("label", "l")
    now = buckets.join(names, "node", "left").select("sig", "node", "n", *SKETCH, F.coalesce("l", "node").alias("label"))
    per = now.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                 F.ceil(F.count(F.lit(1)) / CENTRE_ROWS).alias("blocks"))
    per = staged(per.where("lo <> hi").select("sig", "blocks"), "join-mixed")
    return now.join(per, "sig")


def _near(similarity: int, other: str = "c_"):
    """Sizes and sketches allow the two sets to link (whoever links passes)."""
    n, m = F.col("n"), F.col(other + "n")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(other + c))) for c in SKETCH), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * similarity) & \
        (apart * (100 + similarity) <= (n + m) * (100 - similarity))


def _centre_pairs(held: DataFrame, turn: int, similarity: int) -> DataFrame:
    """Each member of a bucket with its centre: the node of the smallest hash of this turn."""
    order = F.xxhash64("node", F.lit(turn))
    columns = ["node", "n", "label", *SKETCH]
    centre = held.groupBy("sig").agg(F.min(F.struct(order.alias("o"), *columns)).alias("c"))
    centre = staged(centre.select("sig", F.col("c.node").alias("centre"),
                                  *(F.col("c." + c).alias("c_" + c) for c in columns[1:])), "join-centre")
    return held.join(centre, "sig").where((F.col("label") != F.col("c_label")) & _near(similarity))


def _all_pairs(held: DataFrame, similarity: int, nearest: bool = False) -> DataFrame:
    """Pairs of a bucket's members in different components that :func:`_near` lets pass;
    with ``nearest`` only the pair of each two components whose sketches are nearest.

    Buckets are cut in blocks of about ``CENTRE_ROWS`` members; a task looks at
    two blocks at a time and sends what passes, not the pairs it looks at.
    """
    columns = ["node", "n", "label", *SKETCH]
    rows = held.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.select("sig", "mine", *columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
                       .alias("other"))
    rows = rows.select("sig", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine",
                       *columns)
    keys = ["sig", "lo", "hi"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "mine")

    def near(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        """(node, node) rows; columns: node, n, label, sketch."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for at in range(0, len(a), 64):
            x, y = a[at:at + 64, None, :], b[None, :, :]
            total = x[..., 1] + y[..., 1]
            ok = (x[..., 2] != y[..., 2]) & (np.minimum(x[..., 1], y[..., 1]) * 100
                                             >= np.maximum(x[..., 1], y[..., 1]) * similarity)
            differ = (x[..., 3:] ^ y[..., 3:]).view(np.uint64)  # signed numbers would be counted by their size
            apart = np.bitwise_count(differ).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero(ok & (apart * (100 + similarity) <= total * (100 - similarity)))
            if len(i) and not nearest:
                yield np.stack([a[at + i, 0], b[j, 0]], axis=1)
            elif len(i):
                # of this slice, then of all, the nearest of each two components
                share = apart[i, j] / total[i, j]
                two = np.sort(np.stack([a[at + i, 2], b[j, 2]], axis=1), axis=1)
                order = np.lexsort((share, two[:, 1], two[:, 0]))
                first = order[np.append(True, (np.diff(two[order], axis=0) != 0).any(axis=1))]
                for x, y, z, k in zip(*two[first].T.tolist(), share[first].tolist(), first.tolist(), strict=True):
                    found = (z, int(a[at + i[k], 0]), int(b[j[k], 0]))
                    best[x, y] = min(best.get((x, y), found), found)
        if best:
            yield np.array([x[1:] for x in best.values()], np.int64)

    def looked(group: np.ndarray) -> Iterator[np.ndarray]:
        mine, rows = group[:, 3], group[:, 4:]
        if mine[0] == mine[-1] and group[0, 1] == group[0, 2]:
            for at in range(0, len(rows), CENTRE_ROWS):
                part = rows[at:at + CENTRE_ROWS]
                for found in near(part, rows[at:]):
                    yield found[found[:, 0] != found[:, 1]]
        else:
            cut = int(np.searchsorted(mine, mine[0], side="right"))
            yield from near(rows[:cut], rows[cut:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 4 + len(columns)), np.int64)
        for batch in batches:
            rest = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns], axis=1).astype(np.int64)])
            edges = np.flatnonzero((rest[1:, :3] != rest[:-1, :3]).any(axis=1)) + 1
            if len(edges):
                yield from send(np.split(rest[:edges[-1]], edges[:-1]))
                rest = rest[edges[-1]:]
        if len(rest):
            yield from send([rest])

    def send(groups: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for found in (f for g in groups if len(g) > 1 for f in looked(g)):
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["centre", "node"])

    return rows.mapInArrow(run, "centre long, node long")
