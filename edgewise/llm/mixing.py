"""Mix sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame functions only. Sizes are words. A target above its source's size
takes whole passes over the source and a fraction of one more. The rows of a
source are dealt by hash into blocks of about ``block_words`` words; every pass
takes whole blocks in a permuted order, the last one up to the words that are
left, and within its last block row by row in hash order, then the smallest rows
that fill the gap, so a source ends within half a small row of its target.

The taken blocks are dealt to the output shards by a binary tree: each node
splits its vector of per-source block counts in two by a multivariate
hypergeometric draw (a chain of conditional hypergeometric draws by inverse
distribution), so the quotas of all shards add up exactly. More than ``SOURCES``
sources are dealt run by run, then within each run, so no row or task holds them all. A shard then draws
its quota as the next blocks of each source's permuted order, which are
disjoint, and shuffles its rows by hash.

Defined cases: null text has size 0; a null source is a source of its own and
comes last; sources without words get target 0; repeated rows are dealt each
for itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS, SHARDS, SEED, MOST = 1 << 20, 16, 2024, 3
#: counts that one row of the tree holds
SOURCES = 1024


def n_words(text: Column) -> Column:
    """Runs of characters other than space, tab, LF, VT, FF and CR; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: rank, source_size, target.

    Shares follow the weights and stop at ``most`` times the source's size; what
    is above goes to the others by weight. In closed form: in the order of
    cap / weight, a source is capped when the words left at its turn, shared by
    the weights left, would fill its cap.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = _before(per, [F.col("source").asc_nulls_last()], {"above": F.lit(1).cast("long")})
    per = per.withColumn("rank", (F.col("above") + 1).cast("int"))
    per = per.withColumn("w", F.array(*map(F.lit, weights))[((F.col("rank") - 1) % len(weights)).cast("int")])
    per = per.withColumn("cap", (F.col("source_size") * most).cast("double"))
    per = per.withColumn("fill", F.col("cap") / F.col("w"))
    per = _before(per, [F.col("fill"), F.col("rank")], {"cap_before": F.col("cap"), "w_before": F.col("w")})
    total, all_w = per.agg(F.sum("source_size"), F.sum("w")).first()
    per = per.withColumn("level", (F.lit(total).cast("double") - F.col("cap_before")) / (F.lit(all_w).cast("double") - F.col("w_before")))
    per = staged(per.withColumn("capped", F.col("cap") <= F.col("level") * F.col("w")), "mix-levels")
    # the level of the first source that is not capped holds for all after it
    level = per.where(~F.col("capped")).agg(F.min_by("level", F.struct("fill", "rank"))).first()[0]
    return per.select("source", "rank", "source_size",
                      F.when(F.col("capped"), F.col("cap")).otherwise(F.lit(level).cast("double") * F.col("w")).alias("target"))


def _before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums over all rows before each, in ``order``: ranges of rows are summed apart,
    and the sums of the ranges, a row for each partition, give each its start."""
    parted = staged(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("range").agg(*[F.sum(c).alias(f"{n}_range") for n, c in sums.items()])
    starts = starts.select("range", *[F.coalesce(F.sum(f"{n}_range").over(ahead), F.lit(0)).alias(f"{n}_start") for n in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (parted.join(F.broadcast(starts), "range")
            .select(*rows.columns, *[(F.col(f"{n}_start") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n)
                                     for n, c in sums.items()]))


def _hash(*cols: Column | str) -> Column:
    return F.xxhash64(*cols)


def _log_factorial(n: Column) -> Column:
    """ln n!: Stirling's series at n + 8, stepped down."""
    z = n.cast("double") + 8
    low = sum((F.log(n.cast("double") + i) for i in range(1, 9)), F.lit(0.0))
    return z * F.log(z) - z + 0.5 * F.log(2 * math.pi * z) + 1 / (12 * z) - 1 / (360 * z * z * z) - low


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(good: Column, all_: Column, draws: Column, u: Column) -> Column:
    """A draw of the good among ``draws`` out of ``all_``, by inverse distribution at ``u``.

    The support is cut at 12 standard deviations (and 12 more) from the mean.
    """
    def moments(x: Column) -> Column:
        n = F.greatest(x["all"], F.lit(1)).cast("double")
        mean = x["draws"] * x["good"] / n
        var = mean * (1 - x["good"] / n) * (n - x["draws"]) / F.greatest(n - 1, F.lit(1.0))
        return F.struct(x.alias("x"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), var)).alias("sd"))

    def support(m: Column) -> Column:
        x, far = m["x"], 12 * m["sd"] + 12
        lo = F.greatest(F.lit(0).cast("long"), x["draws"] + x["good"] - x["all"])
        return F.struct(x.alias("x"), F.floor(m["mean"]).cast("long").alias("mid"),
                        F.greatest(lo, F.floor(m["mean"] - far).cast("long")).alias("first"),
                        F.least(x["draws"], x["good"], F.ceil(m["mean"] + far).cast("long")).alias("last"))

    def log_p(x: Column, k: Column) -> Column:
        return _log_choose(x["good"], k) + _log_choose(x["all"] - x["good"], x["draws"] - k)

    def weights(s: Column) -> Column:
        return _let(log_p(s["x"], F.least(s["last"], F.greatest(s["first"], s["mid"]))), lambda peak: F.struct(
            s["x"]["u"].alias("u"), s["first"].alias("first"),
            F.transform(F.sequence(s["first"], s["last"]), lambda k: F.exp(log_p(s["x"], k) - peak)).alias("p")))

    def pick(w: Column) -> Column:
        goal = w["u"] * F.aggregate(w["p"], F.lit(0.0), lambda a, p: a + p)
        # as many steps up as partial sums stay below the goal
        steps = _let(goal, lambda g: F.aggregate(
            w["p"], F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")),
            lambda a, p: F.struct((a["sum"] + p).alias("sum"),
                                  (a["n"] + (a["sum"] + p < g).cast("long")).alias("n")))["n"])
        return w["first"] + F.least(steps, F.size(w["p"]) - 1)

    given = F.struct(good.alias("good"), all_.alias("all"), draws.alias("draws"), u.alias("u"))
    return _let(_let(_let(_let(given, moments), support), weights), pick)


def _split(counts: Column, draws: Column, node: Column, seed: int) -> Column:
    """Left share of each source's count: ``draws`` blocks in all."""
    start = F.struct(draws.alias("draws"), F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).alias("all"),
                     F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        u = (F.pmod(_hash(node, F.size(a["out"]), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        return _let(hypergeometric(c, a["all"], a["draws"], u), lambda k: F.struct(
            (a["draws"] - k).alias("draws"), (a["all"] - c).alias("all"), F.concat(a["out"], F.array(k)).alias("out")))

    return F.aggregate(counts, start, step, lambda a: a["out"])


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED, width: int = SOURCES) -> DataFrame:
    """(rank, quota) to (rank, shard, first, last): ranks of the permuted blocks of a shard.

    A row holds at most ``width`` counts: with more sources, runs of ``width`` of them (runs of runs,
    and so on) are dealt first, then each run's share of every shard among its members, which gives
    the same distribution.
    """
    most = quotas.agg(F.max("rank")).first()[0] or 0
    levels = 1
    while width ** levels <= most:
        levels += 1
    shares: DataFrame | None = None  # (key, shard, count) of the level above
    for level in reversed(range(levels)):
        key = F.floor(F.col("rank") / F.lit(width ** level)).cast("long")
        members = (quotas.groupBy(key.alias("key")).agg(F.sum("quota").alias("count"))
                   .groupBy(F.floor(F.col("key") / F.lit(width)).cast("long").alias("parent"))
                   .agg(F.array_sort(F.collect_list(F.struct("key", "count"))).alias("c")))
        if shares is not None:
            by_shard = shares.groupBy(F.col("key").alias("parent")).agg(
                F.transform(F.array_sort(F.collect_list(F.struct("shard", "count"))), lambda x: x["count"]).alias("by_shard"))
            members = members.join(by_shard, "parent")
        shares = _deal(members, shards, seed, level, given=shares is not None)
        if level:
            shares = staged(shares, "mix-shares")
    flat = shares.withColumnRenamed("key", "rank")
    upto = Window.partitionBy("rank").orderBy("shard")
    return flat.withColumn("last", F.sum("count").over(upto)).select(
        "rank", "shard", (F.col("last") - F.col("count")).alias("first"), "last")


def _deal(members: DataFrame, shards: int, seed: int, level: int, given: bool) -> DataFrame:
    """(parent, c: keys and counts) to (key, shard, count) by the splitting tree over the shards.

    ``given``: a shard's total of a parent is in ``by_shard``; else it is an even share.
    """
    kept = ["parent", *(["by_shard"] if given else []), "keys"]
    node = members.select(*kept[:-1], F.lit(1).cast("long").alias("node"), F.lit(0).alias("shard"), F.lit(shards).alias("n"),
                          F.transform("c", lambda x: x["key"]).alias("keys"),
                          F.transform("c", lambda x: x["count"]).alias("counts"))
    lot = _hash("node", "parent", F.lit(level)) if given else F.col("node")

    def total(counts):
        return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    for _ in range(math.ceil(math.log2(max(1, shards)))):
        half = F.floor(F.col("n") / 2).cast("int")
        draws = total(F.slice("by_shard", F.col("shard") + 1, half)) if given else \
            F.floor(total("counts") * half / F.col("n")).cast("long")
        node = node.withColumn("draws", draws)
        node = node.withColumn("left", _split(F.col("counts"), F.col("draws"), lot, seed))
        rest = F.zip_with("counts", "left", lambda c, x: c - x)
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("shard"), half.alias("n"),
                                 F.col("left").alias("counts")),
                        F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("shard") + half).alias("shard"),
                                 (F.col("n") - half).alias("n"), rest.alias("counts")))
        node = node.select(*kept, F.explode(sides).alias("x")).select(*kept, "x.*").where("n > 0")
    return (node.select("shard", F.explode(F.arrays_zip("keys", "counts")).alias("x"))
            .select("shard", F.col("x.keys").alias("key"), F.col("x.counts").alias("count")))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS,
         seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """What the mix takes: (targets by source, blocks with the part taken in the last pass).

    ``part`` of a block is 2 (whole), 0 (not at all) or 1 (rows up to ``edge``
    in hash order, of the others those up to ``edge2`` by size); ``at`` is its place in the source's permuted order.
    """
    light = staged(_light(docs, id_col, text_col, source_col, seed), "mix-sizes")
    targets = source_targets(light, weights).withColumn(
        "n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    targets = targets.withColumn(
        "passes", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long"))
    targets = staged(targets.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")),
                     "mix-targets")
    placed = _placed(light, targets, seed)
    words = placed.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    order = Window.partitionBy("rank").orderBy(_hash("rank", "block", F.lit(seed + 2)), "block")
    blocks = words.withColumn("at", F.row_number().over(order) - 1) \
        .withColumn("room", F.col("rest") - F.sum("words").over(order) + F.col("words"))
    blocks = staged(blocks.withColumn("part", F.when(F.col("words") <= F.col("room"), 2)
                                      .when(F.col("room") > 0, 1).otherwise(0)), "mix-blocks")
    cut = placed.join(blocks.where("part = 1").select("rank", "block", "room"), ["rank", "block"])
    filled = (cut.withColumn("sum", F.sum("size").over(_upto("key", "id", "size"))).where("sum <= room")
              .groupBy("rank", "block").agg(F.max(F.struct("key", "id", "size")).alias("edge"),
                                            F.max("sum").alias("filled")))
    # what the next row in hash order would overrun goes to the smallest rows after it
    after = (cut.join(filled, ["rank", "block"], "left").where(~_within("edge"))
             .withColumn("sum", F.sum("size").over(_upto("size", "key", "id")))
             .where(F.col("sum") - F.col("size") / 2 <= F.col("room") - F.coalesce("filled", F.lit(0)))
             .groupBy("rank", "block").agg(F.max(F.struct("size", "key", "id")).alias("edge2")))
    return targets, staged(blocks.join(filled, ["rank", "block"], "left").join(after, ["rank", "block"], "left")
                           .select("rank", "block", "at", "part", "edge", "edge2"), "mix-parts")


def _upto(*order: str):
    return Window.partitionBy("rank", "block").orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _within(edge: str, *order: str) -> Column:
    """The row is at or before the edge of its block; no edge: it is not."""
    return F.coalesce(F.struct(*(order or ("key", "id", "size"))) <= F.col(edge), F.lit(False))


def _light(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       n_words(F.col(text_col)).alias("size"), _hash(F.col(id_col), F.lit(seed)).alias("key"), *more)


def _placed(light: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Rows with their source's target and their block."""
    to = targets.withColumnRenamed("source", "to_source")
    return (light.join(to, F.col("source").eqNullSafe(F.col("to_source"))).drop("to_source")
            .withColumn("block", F.pmod(_hash("key", F.lit(seed + 1)), F.col("n_blocks"))))


def assigned(docs: DataFrame, targets: DataFrame, blocks: DataFrame, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target``, ``copies`` and its block's place;
    the input columns are kept in the struct ``doc``. Repeated rows share one decision.
    """
    light = _light(docs, id_col, text_col, source_col, seed, F.struct("*").alias("doc"))
    some = _within("edge") | _within("edge2", "size", "key", "id")
    last = F.when(F.col("part") == 2, 1).when(F.col("part") == 0, 0).otherwise(some.cast("int"))
    return (_placed(light, targets, seed).join(blocks, ["rank", "block"])
            .withColumn("copies", F.col("passes") + last))


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shards: int = SHARDS,
          seed: int = SEED) -> DataFrame:
    """The rows of :func:`assigned` with ``shards``: the output shard of each copy that the mix takes."""
    targets, blocks = plan(docs, id_col, text_col, source_col, weights, block_words, seed)
    n = blocks.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("part") > 0).cast("long")).alias("last"))
    n = n.join(targets.select("rank", "passes"), "rank")
    quotas = n.select("rank", (F.col("passes") * F.col("n") + F.col("last")).alias("quota"))
    ranges = shard_quotas(quotas, shards, seed).groupBy("rank").agg(
        F.array_sort(F.collect_list(F.struct("first", "last", "shard"))).alias("ranges"))
    per = staged(ranges.join(n.select("rank", "n"), "rank"), "mix-shards")
    rows = assigned(docs, targets, blocks, id_col, text_col, source_col, seed).join(per, "rank")
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)) \
        .otherwise(F.array().cast("array<bigint>"))
    # a pass over the source continues its permuted order, which the shards' quotas cut
    place = lambda c: c * F.col("n") + F.col("at")
    return rows.withColumn("shards", F.transform(copies, lambda c: F.filter(
        "ranges", lambda r: (r["first"] <= place(c)) & (place(c) < r["last"]))[0]["shard"]))


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """The mix: a row per taken copy with all input columns, ``mix_shard`` and ``mix_key``.

    Arguments as for :func:`dealt`. Written with ``partitionBy("mix_shard")`` after
    ``sortWithinPartitions("mix_key")`` each shard is shuffled locally.
    """
    rows = dealt(docs, *args, **options)
    seed = options.get("seed", SEED)
    return rows.select("doc", "key", F.posexplode("shards").alias("copy", "mix_shard")).select(
        "doc.*", "mix_shard", _hash("key", "copy", F.lit(seed + 3)).alias("mix_key"))
