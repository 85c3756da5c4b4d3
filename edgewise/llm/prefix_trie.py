"""Conversation prefix trie by a splitter skeleton.

A conversation is a path of turns (a 128-bit digest of role and text each), and
every distinct prefix of a path is a node of a trie. Paths are sorted and dealt to
shards by splitter paths taken from a bounded sample. The members of a node are
neighbours in that order, so a node whose members lie in several shards is a prefix
of a splitter: the trie of the splitters (the skeleton) is broadcast, each shard
finishes all its other nodes in one pass over its sorted paths, and for skeleton
nodes it emits partial aggregates, which a reduction over all shards combines.

Long conversations: a path is cut into segments of ``SEGMENT`` turns. A segment is
keyed by its number and a hash of all turns before it, and the trie of each such
group hangs under the node where the segment before it ended. What lies in deeper
segments reaches a node as two sums per member, from a first pass over the deeper
segments alone. No row holds more than ``SEGMENT`` turns, however long a conversation.

Splitters carry the conversation id, so a group of copies is dealt to several shards
too. Only the digest of a hot node's end list is sequential by its definition: its
ids reach one task in joined chunks, in order, and are hashed as a stream.

Defined cases: null role and text are empty; turns without a number come first;
turns of one number are in the order of their digests, and repeated rows are turns
of their own; rows without a conversation id belong to none and are left out; an
empty table gives no node, not even a root; extra columns are ignored; ids are whole
numbers, and ``c - c % 5`` rounds down for negative ones.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, prepare_batches, staged

#: turns in a segment of a path
SEGMENT = 64
#: paths per shard: at least the first while there are fewer shards than shuffle partitions, at most the second
SHARD_ROWS, MOST_SHARD_ROWS = 4096, 1 << 20
#: sampled paths for each splitter
OVERSAMPLE = 16
#: characters of ids in one chunk of an end list
CHUNK = 1 << 16
#: the rebuilding rule: conversations in a family, and the modulus of the number of shared turns
FAMILY, SHARED = 5, 9

NODE, PARTIAL, ENDS, LINK = 0, 1, 2, 3
PARTS = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("sk", T.LongType()), T.StructField("parent_sk", T.LongType()),
    T.StructField("seg", T.LongType()), T.StructField("group", T.StringType()), T.StructField("depth", T.LongType()),
    T.StructField("conv", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("children", T.LongType()), T.StructField("leaves", T.LongType()), T.StructField("saved", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("ends", T.StringType())])
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- turns, numbered and rebuilt ------------------------------------------------

def numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, i, digest, size): the turns of each conversation from 0, in order.

    Rows are sorted over all conversations by range, so that the turns of one
    conversation may lie in several parts; each part numbers its own turns, and a
    part's first conversation continues after the parts before it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("at"),
        F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    order = [F.col("at").asc_nulls_first(), F.col("digest")]
    parts = staged(rows.repartitionByRange(F.col("conv"), *order).withColumn("part", F.spark_partition_id()), "trie-turns")
    counts = parts.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # only a part's first conversation can have begun in an earlier part: at most one row a part
    late = counts.select("conv", "part", before.alias("before")).where("before > 0")
    within = F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order)).cast("long") - 1
    return parts.select("conv", "part", within.alias("w"), "digest", "size") \
        .join(F.broadcast(late), ["conv", "part"], "left") \
        .select("conv", (F.col("w") + F.coalesce("before", F.lit(0))).alias("i"), "digest", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, digest, size) of every rebuilt conversation, and (conv) of all conversations.

    Conversation c is the first h turns of c - c % FAMILY, then its own after its first h.
    """
    lens = staged(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "trie-lengths")
    head = F.col("conv") - F.pmod("conv", F.lit(FAMILY))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).cast("long")
    heads = lens.select(F.col("conv").alias("head"), F.col("n").alias("head_n"))
    family = staged(lens.select("conv", head.alias("head"), h.alias("h")).join(heads, "head", "left")
                    .select("conv", "h", F.least("h", F.coalesce("head_n", F.lit(0))).alias("q")), "trie-families")
    own = turns.join(family, "conv").where(F.col("i") >= F.col("h")) \
        .select("conv", (F.col("i") - F.col("h") + F.col("q")).alias("pos"), "digest", "size")
    given = turns.where((F.pmod("conv", F.lit(FAMILY)) == 0) & (F.col("i") < SHARED - 1)) \
        .select(F.explode(F.sequence("conv", F.col("conv") + (FAMILY - 1))).alias("conv"), "i", "digest", "size")
    given = given.join(family, "conv").where(F.col("i") < F.col("q")).select("conv", F.col("i").alias("pos"), "digest", "size")
    return own.unionByName(given), lens.select("conv")


def segments(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, seg, group, next, path, sizes): a row for each ``segment`` turns of a conversation, and one at least.

    ``path`` holds the digests; ``sizes`` starts with the size of the turn before them. ``group`` hashes all
    turns of the segments before, ``next`` those of this one too if it is full.
    """
    each = turns.select("conv", F.floor(F.col("pos") / segment).cast("long").alias("seg"),
                        (F.col("pos") % segment).cast("int").alias("idx"), "digest", "size")
    # the last turn of a full segment is the top of the next one
    tops = each.where(F.col("idx") == segment - 1).select("conv", (F.col("seg") + 1).alias("seg"), F.lit(-1).alias("idx"),
                                                         F.lit(None).cast("binary").alias("digest"), "size")
    roots = convs.select("conv", F.lit(0).cast("long").alias("seg"), F.lit(-1).alias("idx"),
                         F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("size"))
    rows = each.unionByName(tops).unionByName(roots).groupBy("conv", "seg").agg(
        F.sort_array(F.collect_list(F.struct("idx", "digest", "size"))).alias("u"))
    rows = staged(rows.select("conv", "seg", F.transform(F.slice("u", 2, segment), lambda u: u["digest"]).alias("path"),
                              F.transform("u", lambda u: u["size"]).alias("sizes")), "trie-segments")
    full = rows.where(F.size("path") == segment)
    if full.isEmpty():
        return rows.withColumns({"group": F.lit(""), "next": F.lit(None).cast("string")})
    inside = F.sha2(F.array_join(F.transform("path", F.hex), ""), 256)
    upto = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = [F.bit_xor(F.xxhash64(F.lit(s), "seg", "inside")).over(upto) for s in range(4)]
    keys = staged(full.select("conv", "seg", inside.alias("inside")).select(
        "conv", "seg", F.concat_ws(":", *(r.cast("string") for r in running)).alias("next")), "trie-keys")
    group = keys.select("conv", (F.col("seg") + 1).alias("seg"), F.col("next").alias("group"))
    out = rows.join(keys, ["conv", "seg"], "left").join(group, ["conv", "seg"], "left")
    return staged(out.withColumn("group", F.coalesce("group", F.lit(""))), "trie-keyed")


# ---- splitters and their trie ------------------------------------------------------

def splitters(rows: DataFrame, shards: int) -> list[tuple]:
    """At most ``shards`` - 1 keys (seg, group, path, conv) that part the sorted rows about evenly."""
    if shards < 2:
        return []
    sample = rows.select("seg", "group", "path", "conv").orderBy(F.xxhash64(F.lit(7), "conv", "seg")).limit(OVERSAMPLE * shards)
    found = sorted((r["seg"], r["group"], tuple(bytes(x) for x in r["path"]), r["conv"]) for r in sample.collect())
    return sorted({found[i * len(found) // shards] for i in range(1, shards)}) if found else []


def skeleton(keys: list[tuple]) -> tuple[dict, dict, list[tuple[int, int, list[int]]]]:
    """The trie of the splitter paths: tops {(seg, group): node}, steps {(node, digest): node} and
    (node, parent or -1, ancestors with itself) for each node. At most ``SEGMENT`` + 1 nodes a splitter.
    """
    tops: dict = {}
    steps: dict = {}
    nodes: list[tuple[int, int, list[int]]] = []

    def add(table: dict, key, parent: int) -> int:
        if key not in table:
            table[key] = len(nodes)
            nodes.append((len(nodes), parent, [*(nodes[parent][2] if parent >= 0 else []), len(nodes)]))
        return table[key]

    for seg, group, path, _ in keys:
        at = add(tops, (seg, group), -1)
        for digest in path:
            at = add(steps, (at, digest), at)
    return tops, steps, nodes


# ---- one sorted pass over a shard -----------------------------------------------------

class _Open:
    """A node whose members are being read."""
    __slots__ = ("sk", "depth", "size", "link", "n", "conv", "children", "leaves", "saved", "sha", "ids", "held", "done")

    def __init__(self, sk, depth: int, size: int, link: str | None):
        self.sk, self.depth, self.size, self.link = sk, depth, size, link
        self.n = self.children = self.leaves = self.saved = 0
        self.conv = None    # smallest member
        self.sha = None     # of the ids that end here
        self.ids: list[str] = []
        self.held = 0
        self.done: list[tuple] = []  # finished children, which wait for this node's smallest member


def _walk(rows: Iterator[tuple], tops: dict, steps: dict, segment: int) -> Iterator[tuple]:
    """Rows of ``PARTS`` for rows (seg, group, next, path, sizes, conv, more_leaves, more_saved) in sorted order."""
    stack: list[_Open] = []
    place, last = None, ()

    def flush(node: _Open) -> Iterator[tuple]:
        """Ids read so far: hashed on, or a chunk of a skeleton node."""
        if not node.ids:
            return
        text = ",".join(node.ids)
        if node.sk is None:
            if node.sha is None:
                node.sha = hashlib.sha256(text.encode())
            else:
                node.sha.update(b"," + text.encode())
        else:
            yield (ENDS, node.sk, None, None, None, None, int(node.ids[0]), *[None] * 6, text)
        node.ids, node.held = [], 0

    def close() -> Iterator[tuple]:
        node = stack.pop()
        seg, group = place
        yield from flush(node)
        up = stack[-1] if stack else None
        if node.sk is None:
            leaves, saved = node.leaves, node.saved
            if node.link is None:
                leaves += not node.children
                saved += (node.n - 1) * node.size
            row = (NODE if node.link is None else LINK, seg if node.link is None else seg + 1,
                   group if node.link is None else node.link, node.depth, node.conv, node.n, node.children, leaves, saved,
                   node.size, node.sha.hexdigest() if node.sha else NO_ENDS)
            if up is None:
                yield _row(row, None, None)
            else:
                up.done.append(row)
                up.children += 1
                up.leaves += leaves
                up.saved += saved
        else:
            yield (PARTIAL, node.sk, None, seg, group if node.link is None else node.link, node.depth, node.conv, None,
                   node.n, node.children, node.leaves, node.saved, node.size, None if node.link is None else "link")
        for row in node.done:
            yield _row(row, node.conv if node.sk is None else None, node.sk)
        if up is not None:
            up.n += node.n
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)

    for seg, group, nxt, path, sizes, conv, more_leaves, more_saved in rows:
        if place != (seg, group):
            while stack:
                yield from close()
            place, last = (seg, group), ()
            stack.append(_Open(tops.get(place), seg * segment, sizes[0], None))
        common = 0
        for a, b in zip(last, path):
            if a != b:
                break
            common += 1
        while len(stack) > common + 1:
            yield from close()
        for k in range(common, len(path)):
            sk = stack[-1].sk
            stack.append(_Open(None if sk is None else steps.get((sk, path[k])), seg * segment + k + 1, sizes[k + 1],
                               nxt if k + 1 == segment else None))
        node, last = stack[-1], path
        node.n += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        if node.link is None:
            node.ids.append(str(conv))
            node.held += len(node.ids[-1]) + 1
            if node.held >= CHUNK:
                yield from flush(node)
        else:  # it goes on in the next segment
            node.leaves += more_leaves
            node.saved += more_saved
    while stack:
        yield from close()


def _row(row: tuple, parent, parent_sk) -> tuple:
    kind, seg, group, depth, conv, n, children, leaves, saved, size, ends = row
    return kind, None, parent_sk, seg, group, depth, conv, parent, n, children, leaves, saved, size, ends


def parts(rows: DataFrame, segment: int, shards: int) -> tuple[DataFrame, list[tuple[int, int, list[int]]]]:
    """Rows of ``PARTS`` from all shards, and the skeleton's nodes.

    ``rows``: the columns of :func:`segments`, more_leaves and more_saved.
    """
    spark = rows.sparkSession
    keys = splitters(rows, shards)
    tops, steps, nodes = skeleton(keys)
    shared = spark.sparkContext.broadcast((keys, tops, steps))
    prepare_batches(spark)
    names = ["seg", "group", "next", "path", "sizes", "conv", "more_leaves", "more_saved"]
    rows = rows.select(*names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value[0]
        for batch in batches:
            c = batch.to_pydict()
            at = [bisect_right(keys, (s, g, tuple(p), v)) for s, g, p, v in zip(c["seg"], c["group"], c["path"], c["conv"])]
            yield batch.append_column("shard", pa.array(at, pa.int32()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tops, steps = shared.value
        schema = pa.schema([(f.name, {T.IntegerType(): pa.int32(), T.StringType(): pa.string()}.get(f.dataType, pa.int64()))
                            for f in PARTS])
        read = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(len(names)))))
        out: list[tuple] = []
        for row in _walk(read, tops, steps, segment):
            out.append(row)
            if len(out) == 8 * BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    if keys:
        dealt = rows.mapInArrow(deal, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())]))
        dealt = dealt.repartitionById(len(keys) + 1, F.col("shard"))
    else:
        dealt = rows.coalesce(1).withColumn("shard", F.lit(0))
    dealt = dealt.sortWithinPartitions("seg", "group", "path", "conv")
    return staged(dealt.select(*names).mapInArrow(walk, PARTS), "trie-parts"), nodes


def _end_digests(chunks: DataFrame) -> DataFrame:
    """(sk, ends): SHA-256 of each skeleton node's chunks, joined in the order of their first ids, as a stream."""
    schema = "sk long, ends string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        found: list[tuple] = []
        for batch in batches:
            for sk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if sk != now:
                    if sha is not None:
                        found.append((now, sha.hexdigest()))
                    now, sha = sk, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
        if sha is not None:
            found.append((now, sha.hexdigest()))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["sk", "ends"])

    return chunks.repartition("sk").sortWithinPartitions("sk", "conv").select("sk", "ends").mapInArrow(run, schema)


def nodes_of(rows: DataFrame, segment: int, shards: int) -> DataFrame:
    """(seg, depth, conv, parent, n, children, leaves, saved, size, ends) of every node of the given segments.

    ``parent`` is the parent's smallest member; a top node of a segment after the first takes it from the
    segment before, where it is known.
    """
    found, tree = parts(rows, segment, shards)
    spark = rows.sparkSession
    shape = spark.createDataFrame(tree, "sk long, up long, above array<long>")
    partial = found.where(F.col("kind") == PARTIAL).groupBy("sk").agg(
        F.first("seg").alias("seg"), F.first("group").alias("group"), F.first("depth").alias("depth"),
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.first("size").alias("size"),
        F.first("ends").isNotNull().alias("link"))
    partial = staged(partial.join(shape, "sk"), "trie-skeleton")
    below = partial.groupBy("up").agg(F.count(F.lit(1)).alias("more")).withColumnRenamed("up", "sk")
    total = partial.join(below, "sk", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    total = total.withColumn("leaves", F.col("leaves") + F.when(F.col("link") | (F.col("children") > 0), 0).otherwise(1)) \
        .withColumn("saved", F.col("saved") + F.when(F.col("link"), F.lit(0)).otherwise((F.col("n") - 1) * F.col("size")))
    # a node's subtree: every skeleton node reports what is its own to all above it
    sums = total.select(F.explode("above").alias("sk"), "leaves", "saved").groupBy("sk").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    known = F.broadcast(partial.select(F.col("sk").alias("k_sk"), F.col("conv").alias("k_conv")))  # at most SEGMENT + 1 a splitter
    ends = _end_digests(found.where(F.col("kind") == ENDS).select("sk", "conv", "ends"))
    top = total.drop("leaves", "saved").join(sums, "sk").join(ends, "sk", "left") \
        .join(known, F.col("up") == F.col("k_sk"), "left") \
        .select(F.when(F.col("link"), F.lit(LINK)).otherwise(F.lit(NODE)).alias("kind"),
                F.when(F.col("link"), F.col("seg") + 1).otherwise(F.col("seg")).alias("seg"), "group", "depth", "conv",
                F.col("k_conv").alias("parent"), "n", "children", "leaves", "saved", "size",
                F.coalesce("ends", F.lit(NO_ENDS)).alias("ends"))
    rest = found.where(F.col("kind").isin(NODE, LINK)).join(known, F.col("parent_sk") == F.col("k_sk"), "left") \
        .withColumn("parent", F.coalesce("parent", "k_conv"))
    return rest.select(*top.columns).unionByName(top)


def trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie of the given conversations.

    ``turns``: (conv, pos, digest, size), positions from 0; ``convs``: (conv) of all, those without turns too.
    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows = segments(turns, convs, segment)
    zero = {c: F.lit(0).cast("long") for c in ("more_leaves", "more_saved")}
    deep = rows.where(F.col("seg") > 0)
    n, n_deep = rows.agg(F.count(F.lit(1)), F.count_if(F.col("seg") > 0)).first()
    if n_deep:  # what each conversation's own nodes in deeper segments add to all above
        inner = nodes_of(deep.withColumns(zero), segment, _shards(deep, n_deep, shard_rows)).where(F.col("kind") == NODE)
        owned = inner.withColumn("leaf", (F.col("children") == 0).cast("long")).groupBy("conv", "seg").agg(
            F.sum("size").alias("owned"), F.sum("leaf").alias("leaf"))
        sent = F.aggregate(F.slice("sizes", 1, segment), F.lit(0).cast("long"), lambda a, x: a + x)
        deeper = Window.partitionBy("conv").orderBy("seg").rowsBetween(1, Window.unboundedFollowing)
        each = rows.select("conv", "seg", sent.alias("sent")).join(
            deep.select("conv").distinct(), "conv", "left_semi").join(owned, ["conv", "seg"], "left")
        more = each.select("conv", "seg", F.coalesce(F.sum(F.coalesce("leaf", F.lit(0))).over(deeper), F.lit(0)).alias("more_leaves"),
                           F.coalesce(F.sum(F.col("sent") - F.coalesce("owned", F.lit(0))).over(deeper), F.lit(0)).alias("more_saved"))
        rows = rows.join(staged(more, "trie-deeper"), ["conv", "seg"], "left").fillna(0, ["more_leaves", "more_saved"])
    else:
        rows = rows.withColumns(zero)
    out = nodes_of(rows, segment, _shards(rows, n, shard_rows))
    nodes, links = out.where(F.col("kind") == NODE), out.where(F.col("kind") == LINK)
    if n_deep:
        links = links.select("seg", "group", F.col("parent").alias("l_parent"))
        nodes = nodes.withColumn("top", (F.col("seg") > 0) & (F.col("depth") == F.col("seg") * segment)) \
            .join(links.withColumn("top", F.lit(True)), ["seg", "group", "top"], "left") \
            .withColumn("parent", F.coalesce("parent", "l_parent"))
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def _shards(rows: DataFrame, n: int, shard_rows: int) -> int:
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(-(-n // shard_rows), most), -(-n // MOST_SHARD_ROWS))


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", segment: int = SEGMENT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns; columns as in :func:`trie`."""
    rows = staged(numbered(turns, conv_col, turn_col, role_col, text_col), "trie-numbered")
    return trie(*rebuilt(rows), segment, shard_rows)
