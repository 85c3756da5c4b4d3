"""Graphs and job-log tables derived from the driver's parquet tables.

There is no graph table in the test data, so every graph is a view over
the TPC-H-like tables.  Each definition here has a SQL twin in
``edgewise.oracle`` that DuckDB runs as the correctness oracle.

Scale notes: ``part_next`` is a ``lead`` over a window partitioned by order
key and ``user_handoff`` over a window partitioned by day; a window keeps a
whole partition key in one task (it spills, but does not split), so a single
order or day holding a third of all rows would be one long task.  They are
test fixtures, not operators.  ``doc_copies`` links each copy to the
smallest id of its text (a star) instead of emitting every pair of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.structure import vertices_of
from .skew import shuffle_partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def line_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item with the part and quantity of the next line of its order."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return li.select(F.col("l_partkey").alias("src"),
                     F.lead("l_partkey").over(w).alias("dst"),
                     F.col("l_quantity"),
                     F.lead("l_quantity").over(w).alias("next_quantity"))


def part_next_raw(spark: SparkSession, sf_dir: str) -> Graph:
    """Multigraph: every consecutive pair of lines, self-loops and repeats kept."""
    e = line_successors(spark, sf_dir).where(F.col("dst").isNotNull())
    return Graph.from_edges(e)


def part_next(spark: SparkSession, sf_dir: str) -> Graph:
    e = (line_successors(spark, sf_dir)
         .where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src")))
         .select("src", "dst").distinct())
    return Graph.from_edges(e)


def part_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size", "p_retailprice")


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """All parts as vertices (with attributes) and the part_next edges."""
    return Graph(part_vertices(spark, sf_dir), part_next(spark, sf_dir).edges)


def user_handoff(spark: SparkSession, sf_dir: str) -> Graph:
    """user -> user whose event comes next on the same day (by ts, event_id)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    e = (ev.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"))
         .where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
         .distinct())
    return Graph.from_edges(e)


def order_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Order -> the customer's next order; back where the next one is cheaper; the next but one leads
    back to an order of its priority. Customers are the weak components, with strong ones of many sizes inside."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = o.select("o_orderkey", "o_totalprice", "o_orderpriority", F.lead("o_orderkey").over(w).alias("n1"),
                 F.lead("o_totalprice").over(w).alias("p1"), F.lead("o_orderkey", 2).over(w).alias("n2"),
                 F.lead("o_orderpriority", 2).over(w).alias("q2"))
    ends = F.array(
        F.struct(F.col("o_orderkey").alias("src"), F.col("n1").alias("dst")),
        F.when(F.col("p1") < F.col("o_totalprice"), F.struct(F.col("n1").alias("src"), F.col("o_orderkey").alias("dst"))),
        F.when(F.col("q2") == F.col("o_orderpriority"), F.struct(F.col("n2").alias("src"), F.col("o_orderkey").alias("dst"))))
    e = s.select(F.explode(ends).alias("e")).where("e is not null").select("e.*").where("src is not null and dst is not null")
    return Graph.from_edges(e)


def doc_copies(spark: SparkSession, sf_dir: str) -> Graph:
    """Exact text copies: each copy points to the smallest doc id with its text.

    Texts are keyed by their SHA-256 so the shuffle moves 32-byte keys, not
    documents; the per-key minimum is a partial aggregate (hot texts are
    pre-reduced in every task).
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    e = (d.join(first.where(F.col("copies") > 1), "h")
         .where(F.col("doc_id") != F.col("rep"))
         .select(F.col("rep").alias("src"), F.col("doc_id").alias("dst")))
    return Graph.from_edges(e)


def ratings(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer -> part, weight = average quantity; part ids are negated so
    the two id spaces do not collide."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    e = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
         .groupBy(F.col("o_custkey").alias("src"), (-F.col("l_partkey")).alias("dst"))
         .agg(F.avg("l_quantity").alias("weight")))
    return Graph.from_edges(e)


# Part keys of one remainder modulo 3 are linked with this many next keys of the remainder.
LATTICE_REACH = (2, 8, 24)


def part_lattices(spark: SparkSession, sf_dir: str) -> Graph:
    """Three parts without a link between them: a part and the next 2, 8 or 24 keys of its remainder modulo 3.

    Their mean degrees differ fourfold, so a power iteration that starts from degrees tells them apart.
    """
    # dealt first: the narrow table is read in few tasks, and every row makes up to 24
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).repartition(shuffle_partitions(spark), "id")
    reach = F.array(*[F.lit(n) for n in LATTICE_REACH])[F.col("id") % 3]
    e = (p.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), reach)).alias("j"))
         .select("src", (F.col("src") + 3 * F.col("j")).alias("dst"))
         .join(p.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return Graph.from_edges(e.select("src", "dst"))


def geo(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer -> nation -> region and supplier -> nation, string ids."""
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    cid = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    sid = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    nid = lambda col: F.concat(F.lit("N"), F.col(col).cast("string"))
    rid = lambda col: F.concat(F.lit("R"), F.col(col).cast("string"))
    v = (c.select(cid.alias("id"), F.lit("customer").alias("kind"))
         .unionByName(s.select(sid.alias("id"), F.lit("supplier").alias("kind")))
         .unionByName(n.select(nid("n_nationkey").alias("id"), F.lit("nation").alias("kind")))
         .unionByName(r.select(rid("r_regionkey").alias("id"), F.lit("region").alias("kind"))))
    e = (c.select(cid.alias("src"), nid("c_nationkey").alias("dst"))
         .unionByName(s.select(sid.alias("src"), nid("s_nationkey").alias("dst")))
         .unionByName(n.select(nid("n_nationkey").alias("src"), rid("n_regionkey").alias("dst"))))
    return Graph(v, e)


__all__ = ["table", "line_successors", "part_next_raw", "part_next",
           "part_vertices", "part_graph", "user_handoff", "order_chain", "part_lattices", "doc_copies", "ratings", "geo",
           "vertices_of"]


# ---- job-log fixtures --------------------------------------------------------------

# Which event type stands in for which stage stamp (a click
# ends creation and starts execution at the same moment, as a run does).
STAMP_OF_EVENT = {"view": ["start creation"],
                  "click": ["finish creation", "start execution"],
                  "purchase": ["finish execution", "start deletion"],
                  "error": ["finish deletion"]}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job requests from orders (priority as tenant, customer as user).

    The order key modulo 16 decides what is wrong with a request, so that every rule
    is broken by some and half of them are valid.
    """
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 16
    long_name = F.repeat(F.lit("x"), 33)
    return o.select(
        key.alias("name"),
        F.when(kind == 0, F.lit(None)).when(kind == 1, F.col("o_orderpriority")).when(kind == 2, long_name)
        .otherwise(F.regexp_replace(F.lower("o_orderpriority"), "[^0-9a-z]+", "-")).alias("tenant"),
        F.when(kind == 3, F.lit(None)).when(kind == 4, F.concat(F.lit("User "), F.col("o_custkey").cast("string")))
        .when(kind == 5, long_name).otherwise(F.col("o_custkey").cast("string")).alias("user"),
        F.concat(F.when(kind == 6, F.repeat(F.lit("m"), 128)).otherwise(F.lit("user")),
                 F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("user_email"),
        F.when(kind == 7, F.lit(None)).otherwise(F.concat(
            F.lit("graphs/"), F.when(kind == 2, F.repeat(F.lit("d/"), 64)).otherwise(F.lit("")),
            F.lower("o_orderstatus"), F.lit("/"), key)).alias("graph_location"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None))
        .otherwise(F.pmod(F.col("o_custkey"), F.lit(4)) + 1).cast("int").alias("nr_workers"),
        F.col("o_orderdate").alias("ts"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("name"), "ts", "event_id")


def signup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per (user, day): the first signup of that day."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("request_ts"))


def day_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome per (user, day): 200 if a purchase happened, else 400 for an error."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    bought = F.max((F.col("event_type") == "purchase").cast("int"))
    return ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.when(bought == 1, F.lit(200)).otherwise(F.lit(400)).alias("result_code"))


def signup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signup as a request of its own."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return ev.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("request_ts"))


def outcome_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase (200) and error (400) as an outcome of its own."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    code = F.when(F.col("event_type") == "purchase", F.lit(200)).otherwise(F.lit(400))
    return ev.select("user_id", F.col("ts").cast("timestamp").alias("outcome_ts"), code.alias("result_code"))


def stage_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage stamps ``(run, action, ts)``: run = user and day, first stamp per action."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin(list(STAMP_OF_EVENT)))
    mapping = F.create_map(*[x for k, v in STAMP_OF_EVENT.items()
                             for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    run = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    return (ev.select(run.alias("run"), F.explode(mapping[F.col("event_type")]).alias("action"), "ts")
            .groupBy("run", "action").agg(F.min("ts").alias("ts")))
