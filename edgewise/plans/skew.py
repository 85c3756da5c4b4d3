"""Join layout for iterative message passing, safe against hub vertices.

Every superstep joins the (large, fixed) edge table with a (smaller,
changing) per-vertex value table on one endpoint.  Two things decide how
that join scales:

* Broadcast only with a proven bound.  The vertex table is broadcast when its
  counted row number times a fixed row width fits under
  ``spark.sql.autoBroadcastJoinThreshold``; otherwise it is a shuffle join
  (and AQE may still switch at run time, from measured sizes).
* Hub vertices.  One vertex may own a third of all edges.  Keys whose degree
  is above ``total_edges / max_hot`` are "hot"; there are at most
  ``max_hot`` of them, so that list is broadcast safely.  Edges of a hot key
  are spread over ``salt_buckets`` sub-keys by a hash of the other endpoint,
  and the hot key's value row is replicated once per sub-key.  The edge
  table is laid out and sorted once by ``(key, salt)`` and persisted, so each
  step shuffles and sorts only the value side; without hot keys, by the key
  alone.  The hot keys are found once and written.
"""

from __future__ import annotations

import copy
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALT = "_salt"
HOT = "_hot"
PAIRS_PER_ROW = 100  # a task may make this many times the pairs of the rows that it may read

# session settings (all optional)
CONF_MAX_HOT = "edgewise.skew.maxHotKeys"          # bound on the hot-key list
CONF_MIN_HOT_DEGREE = "edgewise.skew.minHotDegree"  # never salt keys below this degree
CONF_SALT_BUCKETS = "edgewise.skew.saltBuckets"     # sub-keys per hot key


def broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes (-1: disabled)."""
    raw = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10MB")).strip().lower()
    m = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", raw)
    if not m:
        return 10 * 1024 * 1024
    n = int(m.group(1))
    return n * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}[m.group(2)]


def fits_broadcast(spark: SparkSession, rows: int, row_bytes: int = 32) -> bool:
    limit = broadcast_limit(spark)
    return limit > 0 and rows * row_bytes <= limit


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def hub_limits(spark: SparkSession) -> tuple[int, int]:
    """Bound on the hot-key list, and the degree up to which no key is hot."""
    return int(spark.conf.get(CONF_MAX_HOT, "1024")), int(spark.conf.get(CONF_MIN_HOT_DEGREE, "100000"))


def join_hub_safe(rows: DataFrame, key: str, values: DataFrame, total: int) -> DataFrame:
    """``rows`` ⋈ ``values`` (one row per ``key``) where a key may own any share of the ``total`` rows.

    Keys above ``total / maxHotKeys`` rows are at most ``maxHotKeys``, whose values are broadcast, so
    their rows stay where they are; all others meet in a shuffle join of bounded keys. For a table
    that changes with every step; a fixed one is laid out once (:class:`KeyedEdges`).
    """
    max_hot, least = hub_limits(rows.sparkSession)
    limit = max(total // max(max_hot, 1), least)
    if total <= limit:
        return rows.join(values, key)
    hot = rows.groupBy(key).count().where(F.col("count") > limit).select(key)
    marked = F.broadcast(hot.withColumn(HOT, F.lit(True)))
    few = values.join(F.broadcast(hot), key, "left_semi")
    near = rows.join(F.broadcast(few), key)
    far = rows.join(marked, key, "left").where(F.col(HOT).isNull()).drop(HOT).join(values, key)
    return near.select(*far.columns).unionByName(far)


def join_pairs_hub_safe(rows: DataFrame, key: str, spread: str, values: DataFrame, total: int) -> DataFrame:
    """``rows`` ⋈ ``values`` on ``key``, where both sides may hold many rows of a key.

    The rows of a hot key are dealt over sub-keys by ``spread``, and the values of that key are
    repeated once per sub-key: give as ``rows`` the side whose keys are hot, as ``values`` the other.
    """
    max_hot, least = hub_limits(rows.sparkSession)
    limit = max(total // max(max_hot, 1), least)
    if total <= limit:
        return rows.join(values, key)
    hot = F.broadcast(rows.groupBy(key).count().where(F.col("count") > limit)
                      .select(key, F.ceil(F.col("count") / F.lit(limit)).cast("int").alias(HOT)))
    parts = F.coalesce(F.col(HOT), F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn(SALT, F.pmod(F.xxhash64(spread), parts)).drop(HOT)
    each = values.join(hot, key, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long")))).drop(HOT)
    return dealt.join(each, [key, SALT]).drop(SALT)


def hot_cells(counts: DataFrame, keys: list[str], left: int, right: int, pairs: float) -> DataFrame | None:
    """The hot keys of a join where both sides may hold many rows of a key, and their grid of cells.

    ``counts`` has the rows of each key on the left (``nl``) and on the right (``nr``); ``left``,
    ``right`` and ``pairs`` are the sums of nl, nr and nl * nr. A key above a ``maxHotKeys``-th of one
    of the three is hot, so at most three times ``maxHotKeys`` are. The left rows of a hot key are dealt
    over ``_p`` parts and the right ones over ``_q``, such that no cell passes the limits and as few
    rows as possible are copied. None when no key can be hot.
    """
    max_hot, least = hub_limits(counts.sparkSession)
    most_left, most_right = (max(n // max(max_hot, 1), least) for n in (left, right))
    most_pairs = max(pairs / max(max_hot, 1), float(least) * PAIRS_PER_ROW)
    if left <= most_left and right <= most_right and pairs <= most_pairs:
        return None
    nl, nr = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("nl", "nr"))
    rows_left, rows_right = F.ceil(nl / most_left), F.ceil(nr / most_right)
    cells = F.greatest(rows_left * rows_right, F.ceil(nl * nr / most_pairs))
    return (counts.where((F.col("nl") > most_left) | (F.col("nr") > most_right)
                         | (F.col("nl").cast("double") * F.col("nr") > most_pairs))
            .withColumn("_p", F.greatest(rows_left, F.least(nl, F.ceil(F.sqrt(cells * nl / nr)).cast("double"))).cast("long"))
            .withColumn("_q", F.greatest(rows_right, F.ceil(cells / F.col("_p"))).cast("long"))
            .select(*keys, "_p", "_q"))


def join_in_cells(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``left`` ⋈ ``right`` on ``keys``; the rows of a hot key (:func:`hot_cells`) meet in a grid of cells.

    For joins other than inner ones ``right`` has at most one row for a key. Both sides are to be
    written tables, as rows are dealt by their place.
    """
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)  # at most three times maxHotKeys rows

    def dealt(df, own, other, parts, copies):
        one = F.lit(1).cast("long")
        return (df.join(hot, keys, "left")
                .withColumn(own, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(F.col(parts), one)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(copies), one) - 1)))
                .drop("_p", "_q"))

    cell = ["_cell_l", "_cell_r"]
    return (dealt(left, "_cell_l", "_cell_r", "_p", "_q")
            .join(dealt(right, "_cell_r", "_cell_l", "_q", "_p"), [*keys, *cell], how).drop(*cell))


class KeyedEdges:
    """Edges laid out for repeated joins with vertex values on ``key``.

    ``edges`` must contain ``key`` and ``spread``.  ``attach(values, id_col)``
    returns edges joined with the value rows whose ``id_col`` equals ``key``.
    ``most`` is the largest number of edges of a key, if it is known: where it
    rules out hot keys, none are searched. ``unique`` drops repeated edges, where
    no key is hot in the layout's own shuffle.
    """

    def __init__(self, edges: DataFrame, key: str, spread: str, *, cutter=None,
                 total_edges: int | None = None, vertex_count: int | None = None,
                 max_hot: int | None = None, min_hot_degree: int | None = None,
                 salt_buckets: int | None = None, value_row_bytes: int = 48,
                 most: int | None = None, unique: bool = False):
        spark = edges.sparkSession
        conf = spark.conf
        most, least = hub_limits(spark)
        max_hot = int(max_hot if max_hot is not None else most)
        min_hot_degree = int(min_hot_degree if min_hot_degree is not None else least)
        salt_buckets = int(salt_buckets if salt_buckets is not None
                           else conf.get(CONF_SALT_BUCKETS, "64"))
        self.key, self.spread = key, spread
        self.salt_buckets = int(salt_buckets)
        self.partitions = shuffle_partitions(spark)
        self.broadcast_values = (vertex_count is not None and
                                 fits_broadcast(spark, vertex_count, value_row_bytes))
        if self.broadcast_values:
            # the value side is small and counted: no salt, no re-layout
            self.hot = None
            self.edges = self._written(edges.distinct(), cutter) if unique else edges
            return
        n_edges = total_edges if total_edges is not None else edges.count()
        threshold = max(n_edges // max(max_hot, 1), int(min_hot_degree))
        if most is not None and most <= threshold:
            self.hot = None
            dealt = edges.repartition(self.partitions, key)
            self.edges = (dealt.distinct() if unique else dealt).sortWithinPartitions(key)
            return
        if unique:  # before they are dealt: a pair may hold any share of the edges
            edges = self._written(edges.distinct(), cutter)
        # at most max_hot keys can exceed total/max_hot: a proven bound
        # a hot key gets as many sub-keys as keep each below the threshold
        parts = F.greatest(F.lit(self.salt_buckets), F.ceil(F.col("count") / F.lit(max(threshold, 1))))
        hot = (edges.groupBy(key).count().where(F.col("count") > threshold)
               .select(F.col(key).alias("_hot_key"), parts.cast("int").alias(HOT)))
        if cutter is not None:  # written, as a step that is only persisted is released with the next written one
            hot, told = cutter.cut(hot, {"n": F.count(F.lit(1))}, reliable=True)
            if not told["n"]:
                hot = None
        self.hot = None if hot is None else F.broadcast(hot)
        keys = [key] if hot is None else [key, SALT]
        # sorted once, so that no superstep sorts the edges again for its merge join
        self.edges = self._salted(edges).repartition(self.partitions, *keys).sortWithinPartitions(*keys)

    @staticmethod
    def _written(edges: DataFrame, cutter) -> DataFrame:
        return edges if cutter is None else cutter.cut(edges, reliable=True)[0]

    def _salted(self, edges: DataFrame) -> DataFrame:
        if self.hot is None:
            return edges
        return (edges.join(self.hot, edges[self.key] == F.col("_hot_key"), "left")
                # the running number parts parallel edges of one pair, too
                .withColumn(SALT, F.when(F.col(HOT).isNotNull(), F.pmod(
                    F.xxhash64(F.col(self.spread), F.monotonically_increasing_id()), F.col(HOT)))
                            .otherwise(F.lit(0)).cast("int"))
                .drop("_hot_key", HOT))

    def with_rows(self, edges: DataFrame) -> "KeyedEdges":
        """The same edges with more columns, to be joined once: hot keys are split as here, nothing is kept."""
        out = copy.copy(self)
        out.edges = self._salted(edges)
        return out

    def persist(self, cutter) -> "KeyedEdges":
        self.edges = cutter.keep(self.edges)
        if not self.broadcast_values:
            # a step planned before the layout is there does not know its partitioning and would shuffle it again
            self.edges.count()
        return self

    def _salted_values(self, values: DataFrame, id_col: str) -> DataFrame:
        return (values.join(self.hot, values[id_col] == F.col("_hot_key"), "left")
                .withColumn(SALT, F.explode(F.when(F.col(HOT).isNotNull(), F.sequence(F.lit(0), F.col(HOT) - 1))
                                            .otherwise(F.array(F.lit(0)))))
                .drop("_hot_key", HOT))

    def attach(self, values: DataFrame, id_col: str = "id", how: str = "inner") -> DataFrame:
        """Edges ⋈ values on key = id_col; ``id_col`` is dropped from the result."""
        if self.broadcast_values:
            joined = self.edges.join(F.broadcast(values),
                                     self.edges[self.key] == values[id_col], how)
            return joined.drop(values[id_col])
        if self.hot is None:
            return self.edges.join(values, self.edges[self.key] == values[id_col], how).drop(values[id_col])
        vals = self._salted_values(values, id_col)
        vals = vals.withColumnRenamed(SALT, "_vsalt")
        joined = self.edges.join(
            vals, (self.edges[self.key] == vals[id_col]) & (self.edges[SALT] == vals["_vsalt"]), how)
        return joined.drop(vals[id_col]).drop("_vsalt").drop(SALT)
