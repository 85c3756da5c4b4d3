"""Named queries: one per operator, over graphs derived from the test tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose
column names equal those of its SQL twin in ``edgewise.oracle``.  Doubles are
rounded to 6 places on both sides (sums are not associative).  Map, vector
and struct outputs are flattened to long form so two engines hash alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .plans import fixtures as fx
from .plans.iterate import materialize
from .session import prepare

PAGERANK_ITER = 10
PAGERANK_TOL = 1e-3
RESET = 0.15
PERSONAL_SOURCES = (1, 2, 3)
LANDMARKS = (1, 2, 3)
LPA_ITER = 5
PREGEL_ITER = 5
PIC_ITER = 10


def _r(c, places: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# ---- step 0: structure -------------------------------------------------------

def from_edges(spark, sf):
    return fx.part_next(spark, sf).vertices


def in_degrees(spark, sf):
    return fx.part_next_raw(spark, sf).in_degrees


def out_degrees(spark, sf):
    return fx.part_next_raw(spark, sf).out_degrees


def degrees(spark, sf):
    return fx.part_next_raw(spark, sf).degrees


# ---- step 1: PageRank -----------------------------------------------------------

def pagerank_static(spark, sf):
    g = fx.part_next(spark, sf).page_rank(reset_probability=RESET, max_iter=PAGERANK_ITER)
    return g.vertices.select("id", _r("pagerank").alias("pagerank"))


def pagerank_topk(spark, sf, k: int = 20):
    ranks = pagerank_static(spark, sf)
    return ranks.orderBy(F.desc("pagerank"), F.asc("id")).limit(k)


def pagerank_edge_weight(spark, sf):
    g = fx.part_next(spark, sf).page_rank(reset_probability=RESET, max_iter=PAGERANK_ITER)
    return g.edges.select("src", "dst", _r("weight").alias("weight"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "from_edges": from_edges,
    "in_degrees": in_degrees,
    "out_degrees": out_degrees,
    "degrees": degrees,
    "pagerank_static": pagerank_static,
    "pagerank_topk": pagerank_topk,
    "pagerank_edge_weight": pagerank_edge_weight,
}


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    prepare(spark)
    return QUERIES[name](spark, sf_dir)


# ---- step 2: shortest paths, triangles --------------------------------------------

def shortest_paths(spark, sf):
    from .operators.paths import shortest_paths as sp
    return sp(fx.part_next(spark, sf), list(LANDMARKS))


def triangle_count(spark, sf):
    return fx.part_next(spark, sf).triangle_count().select("id", "count")


QUERIES.update({
    "shortest_paths": shortest_paths,
    "triangle_count": triangle_count,
})


# ---- step 6: components and communities ---------------------------------------------

def connected_components(spark, sf):
    return fx.part_next(spark, sf).connected_components().select("id", "component")


def doc_copy_components(spark, sf):
    return fx.doc_copies(spark, sf).connected_components().select("id", "component")


def strongly_connected_components(spark, sf):
    return fx.part_next(spark, sf).strongly_connected_components().select("id", "component")


def label_propagation(spark, sf):
    return fx.part_next(spark, sf).label_propagation(LPA_ITER).select("id", "label")


def power_iteration_clustering(spark, sf):
    return fx.part_next(spark, sf).power_iteration_clustering(k=4, max_iter=10)


def power_iteration_partition(spark, sf):
    """Clusters of a graph whose parts a power iteration tells apart; a cluster is named by its smallest id."""
    found = fx.part_lattices(spark, sf).power_iteration_clustering(
        k=len(fx.LATTICE_REACH), max_iter=PIC_ITER, init_mode="degree")
    found, _ = materialize(found)
    first = found.groupBy("cluster").agg(F.min("id").alias("first_id"))
    return found.join(F.broadcast(first), "cluster").select("id", "first_id")  # k rows


QUERIES.update({
    "connected_components": connected_components,
    "doc_copy_components": doc_copy_components,
    "strongly_connected_components": strongly_connected_components,
    "label_propagation": label_propagation,
    "power_iteration_clustering": power_iteration_clustering,
    "power_iteration_partition": power_iteration_partition,
})


# ---- step 4: relational graph operators ------------------------------------------

def triplets(spark, sf):
    t = fx.part_graph(spark, sf).triplets
    return t.select(F.col("src.id").alias("src_id"), F.col("src.p_brand").alias("src_brand"),
                    F.col("dst.id").alias("dst_id"), F.col("dst.p_brand").alias("dst_brand"),
                    (F.col("src.p_size") + F.col("dst.p_size")).alias("size_sum"))


def filter_vertices(spark, sf):
    g = fx.part_graph(spark, sf).filter_vertices("p_size <= 25")
    return g.edges.select("src", "dst")


def filter_edges(spark, sf):
    g = fx.part_next_raw(spark, sf).filter_edges(F.col("l_quantity") > F.col("next_quantity"))
    return g.edges.select("src", "dst", "l_quantity", "next_quantity")


def drop_isolated(spark, sf):
    return fx.part_graph(spark, sf).drop_isolated_vertices().vertices.select("id", "p_size")


def aggregate_messages_src(spark, sf):
    g = fx.part_graph(spark, sf)
    return g.aggregate_messages(_r(F.sum("msg")).alias("total_price"),
                                F.count("msg").alias("n_msgs"),
                                send_to_src=F.col("dst.p_retailprice"))


def aggregate_messages_dst(spark, sf):
    g = fx.part_graph(spark, sf)
    return g.aggregate_messages(F.max("msg").alias("max_size"),
                                F.count("msg").alias("n_msgs"),
                                send_to_dst=F.col("src.p_size"),
                                send_to_src=F.when(F.col("dst.p_size") > 40, F.col("dst.p_size")))


# ---- step 5: PageRank variants and Pregel ---------------------------------------------

def pagerank_tol(spark, sf):
    g = fx.part_next(spark, sf).page_rank(reset_probability=RESET, tol=PAGERANK_TOL)
    return g.vertices.select("id", _r("pagerank").alias("pagerank"))


def pagerank_personalized(spark, sf):
    g = fx.part_next(spark, sf).page_rank(reset_probability=RESET, max_iter=PAGERANK_ITER,
                                          source_id=PERSONAL_SOURCES[0])
    return g.vertices.select("id", _r("pagerank").alias("pagerank"))


def pagerank_parallel_personalized(spark, sf):
    r = fx.part_next(spark, sf).parallel_personalized_page_rank(
        source_ids=list(PERSONAL_SOURCES), reset_probability=RESET, max_iter=PAGERANK_ITER)
    return r.select("id", "source", _r("pagerank").alias("pagerank"))


def pregel_pagerank(spark, sf):
    from .operators.messages import Pregel
    edges, _ = materialize(fx.part_next(spark, sf).edges)  # read by several jobs
    g = Graph.from_edges(edges)
    n = g.vertices.count()
    v = g.vertices.join(g.out_degrees, "id", "left").fillna(0, ["outDegree"])
    ranks = (Graph(v, g.edges).pregel.set_max_iter(PREGEL_ITER)
             .with_vertex_column("rank", F.lit(1.0 / n),
                                 F.coalesce(Pregel.msg(), F.lit(0.0)) * F.lit(1.0 - RESET)
                                 + F.lit(RESET / n))
             .send_msg_to_dst(Pregel.src("rank") / Pregel.src("outDegree"))
             .agg_msgs(F.sum(Pregel.msg()))
             .run())
    return ranks.select("id", _r("rank").alias("rank"))


# ---- step 7: motifs and BFS ---------------------------------------------------------

def motif_two_hop(spark, sf):
    """Two-hop paths per start vertex: counted, as the paths grow with the square of a hub's edges."""
    m = fx.part_next(spark, sf).find("(a)-[e1]->(b); (b)-[e2]->(c)")
    return m.groupBy(F.col("a.id").alias("a_id")).agg(F.count(F.lit(1)).alias("paths"))


def motif_mutual(spark, sf):
    m = fx.user_handoff(spark, sf).find("(a)-[e1]->(b); (b)-[e2]->(a)")
    return m.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def motif_negated(spark, sf):
    """Two-hop paths per start vertex that no edge closes, counted."""
    m = fx.user_handoff(spark, sf).find("(a)-[]->(b); (b)-[]->(c); !(c)-[]->(a)")
    return m.groupBy(F.col("a.id").alias("a_id")).agg(F.count(F.lit(1)).alias("paths"))


BFS_FROM = "p_size = 1"
BFS_TO = "p_size = 50"


def bfs(spark, sf):
    from .operators.paths import bfs_paths
    return bfs_paths(fx.part_graph(spark, sf), BFS_FROM, BFS_TO, max_path_length=10)


PATHS_FROM = "o_orderpriority = '1-URGENT'"


def path_counts(spark, sf):
    """Orders by hops and shortest paths from an urgent one, along the chains of customers."""
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    return Graph(orders, fx.order_chain(spark, sf).edges).path_counts(PATHS_FROM)


QUERIES.update({
    "path_counts": path_counts,
    "triplets": triplets,
    "filter_vertices": filter_vertices,
    "filter_edges": filter_edges,
    "drop_isolated": drop_isolated,
    "aggregate_messages_src": aggregate_messages_src,
    "aggregate_messages_dst": aggregate_messages_dst,
    "pagerank_tol": pagerank_tol,
    "pagerank_personalized": pagerank_personalized,
    "pagerank_parallel_personalized": pagerank_parallel_personalized,
    "pregel_pagerank": pregel_pagerank,
    "motif_two_hop": motif_two_hop,
    "motif_mutual": motif_mutual,
    "motif_negated": motif_negated,
    "bfs": bfs,
})


# ---- step 3: sources and sinks --------------------------------------------------------

def ws_text_source(spark, sf):
    """part_next_raw edges written as tab-separated text, read back by the
    whitespace reader with type inference."""
    from .session import scratch_path
    from .sources.text import read_whitespace_table, write_whitespace_table
    path = scratch_path(spark, "ws-text")
    edges = fx.part_next_raw(spark, sf).edges.select("src", "dst", "l_quantity")
    write_whitespace_table(edges, path)
    return read_whitespace_table(spark, path)


def csv_sink_roundtrip(spark, sf):
    """Shortest-path distance maps written by the CSV sink (maps as JSON) and read back."""
    from .operators.paths import distances_map
    from .operators.paths import shortest_paths as sp
    from .session import scratch_path
    from .sources.csv_sink import read_csv, write_csv
    g = fx.part_next(spark, sf)
    res = distances_map(g, sp(g, list(LANDMARKS)))
    path = scratch_path(spark, "csv-sink")
    write_csv(res, path)
    return read_csv(spark, path, "id bigint, distances string")


# ---- step 8: job-log tables ---------------------------------------------------------------

def validate_requests(spark, sf):
    from .operators.joblog import validate_requests as vr
    v = vr(fx.requests(spark, sf))
    return v.select("name", F.concat_ws(",", "violations").alias("violations"), "is_valid")


def normalize_requests(spark, sf):
    from .operators.joblog import normalize_requests as nr
    return nr(fx.requests(spark, sf))


def first_arrivals(spark, sf):
    from .operators.joblog import first_arrivals as fa
    return fa(fx.arrivals(spark, sf), "name", "ts", "event_id")


def request_outcomes(spark, sf):
    from .operators.joblog import request_outcomes as ro
    return ro(fx.signup_requests(spark, sf), fx.day_outcomes(spark, sf), ["user_id", "day"])


def stage_log_source(spark, sf):
    from .session import scratch_path
    from .sources.stage_log import read_stage_log, write_stage_log
    path = scratch_path(spark, "stage-log")
    write_stage_log(fx.stage_stamps(spark, sf), path)
    return read_stage_log(spark, path)


def _durations(spark, sf):
    from .operators.joblog import stage_durations as sd
    return sd(fx.stage_stamps(spark, sf))


def stage_durations(spark, sf):
    d = _durations(spark, sf)
    return d.select("run", *[_r(c).alias(c) for c in d.columns if c.endswith("_sec")])


def stage_summary(spark, sf):
    from .operators.joblog import stage_summary as ss
    d = _durations(spark, sf).withColumn(
        "day", F.regexp_extract("run", r"(\d{4}-\d{2}-\d{2})$", 1))
    return ss(d, "day")


def outcome_classes(spark, sf):
    from .operators.joblog import outcome_classes as oc
    return oc(request_outcomes(spark, sf))


# ---- step 9: streaming twins --------------------------------------------------------------

#: slices of the tables' time range, in which a stream's folder is fed
SLICES = 3
MATCH_HOURS, STREAM_DELAY = 6, "1 day"


def _fed(spark, tables, step, keep=()):
    """Write each (rows, time column) of ``tables`` to a folder of its own in slices of time, and call ``step`` with
    the folders after each slice.

    A stream reads files in the order of their modification times; fed this way, no row of a later
    slice is there before the earlier ones are read, whichever writer ends first. A last record far after all
    others, empty but for its time and the columns ``keep``, moves the watermark past every open state. (The
    filter for keys of a join runs before the watermark: there the record needs a key.)
    """
    from .session import scratch_path
    folders = [scratch_path(spark, "stream-source") for _ in tables]
    ends = [rows.agg(F.min(ts), F.max(ts)).first() for rows, ts in tables]
    known = [e for e in ends if e[0] is not None]
    if known:
        low, high = min(e[0] for e in known), max(e[1] for e in known)
        cuts = [low + (high - low) * k / SLICES for k in range(1, SLICES)]
    else:
        cuts = []
    bounds = [None, *cuts, None]
    result = None
    for a, b in zip(bounds, bounds[1:]):
        for (rows, ts), folder in zip(tables, folders):
            part = rows if a is None else rows.where(F.col(ts) >= F.lit(a))
            part = part if b is None else part.where(F.col(ts) < F.lit(b))
            part.write.mode("append").parquet(folder)
        result = step(*folders)
    if known:
        for (rows, ts), folder in zip(tables, folders):
            after = F.lit(high) + F.expr("INTERVAL 30 days")
            beat = rows.dropna(subset=list(keep)).limit(1).select(*(
                after.alias(c) if c == ts else F.col(c) if c in keep else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
            beat.write.mode("append").parquet(folder)
        result = step(*folders)
    return result


def first_arrivals_stream(spark, sf):
    """First arrivals with a watermark: the state holds a row per key and open day."""
    from .session import scratch_path
    from .streaming.joblog_stream import first_arrivals_stream as fas
    ev, log = fx.table(spark, sf, "events"), scratch_path(spark, "arrivals-log")
    seen = _fed(spark, [(ev, "ts")], lambda path: fas(spark, path, ev.schema, key="user_id", log_path=log, watermark=STREAM_DELAY))
    return seen.where(F.col("name").isNotNull())


def daily_arrivals_stream(spark, sf):
    """Who was seen on which day, deduplicated within the watermark."""
    from .session import scratch_path
    from .streaming.joblog_stream import distinct_arrivals_stream as das
    ev, log = fx.table(spark, sf, "events"), scratch_path(spark, "distinct-log")
    seen = _fed(spark, [(ev, "ts")], lambda path: das(spark, path, ev.schema, ["user_id", "day"], STREAM_DELAY, log_path=log))
    return seen.where(F.col("user_id").isNotNull())


def request_outcomes_stream(spark, sf):
    from .session import scratch_path
    from .streaming.joblog_stream import request_outcomes_stream as ros
    ev, log = fx.table(spark, sf, "events"), scratch_path(spark, "outcomes-log")
    return _fed(spark, [(ev, "ts")], lambda path: ros(spark, path, ev.schema, watermark=STREAM_DELAY, log_path=log))


def request_outcome_match(spark, sf):
    """Every signup with the user's first purchase or error within six hours."""
    from .operators.joblog import match_outcomes
    requests, outcomes = fx.signup_events(spark, sf), fx.outcome_events(spark, sf)
    return match_outcomes(requests, outcomes, "user_id", MATCH_HOURS * 3600)


def request_outcome_match_stream(spark, sf):
    """The same from two streams, joined in time."""
    from .session import scratch_path
    from .streaming.joblog_stream import matched_stream
    requests, outcomes, log = fx.signup_events(spark, sf), fx.outcome_events(spark, sf), scratch_path(spark, "matched-log")
    done = _fed(spark, [(requests, "request_ts"), (outcomes, "outcome_ts")],
                lambda r, o: matched_stream(spark, r, requests.schema, o, outcomes.schema, "user_id",
                                            f"{MATCH_HOURS} hours", log_path=log), keep=["user_id"])
    return done.where(F.col("event_id").isNotNull()).select("event_id", "user_id", "request_ts", "outcome_ts", "result_code")


def stage_percentiles(spark, sf):
    """Median and 95th percentile of stage seconds by rollup, and whether their ranks keep the bound."""
    from .operators.joblog import percentile_ranks
    from .operators.joblog import stage_percentiles as sp
    d = _durations(spark, sf).withColumn("day", F.regexp_extract("run", r"(\d{4}-\d{2}-\d{2})$", 1))
    accuracy = 1000
    ranks = percentile_ranks(d, sp(d, "day", (0.5, 0.95), accuracy), "day")
    want, slack = F.col("percentage") * F.col("n"), F.ceil(F.col("n") / accuracy) + 1
    return ranks.select("stage", "day", "n", "percentage",
                        ((F.col("below") <= want + slack) & (F.col("upto") >= want - slack)).alias("rank_within_bound"))


QUERIES.update({
    "ws_text_source": ws_text_source,
    "csv_sink_roundtrip": csv_sink_roundtrip,
    "validate_requests": validate_requests,
    "normalize_requests": normalize_requests,
    "first_arrivals": first_arrivals,
    "request_outcomes": request_outcomes,
    "stage_log_source": stage_log_source,
    "stage_durations": stage_durations,
    "stage_summary": stage_summary,
    "outcome_classes": outcome_classes,
    "first_arrivals_stream": first_arrivals_stream,
    "request_outcomes_stream": request_outcomes_stream,
    "daily_arrivals_stream": daily_arrivals_stream,
    "request_outcome_match": request_outcome_match,
    "request_outcome_match_stream": request_outcome_match_stream,
    "stage_percentiles": stage_percentiles,
})


# ---- step 10: factorisation ------------------------------------------------------------

def svd_plus_plus(spark, sf):
    """SVD++ on customer -> part ratings (average quantity, scaled to 0..5)."""
    g = fx.ratings(spark, sf)
    g = Graph(g.vertices, g.edges.withColumn("weight", F.col("weight") / 10.0))
    res, _mu = g.svd_plus_plus(rank=10, max_iter=2)
    return res.select("id", _r("column3").alias("bias"), _r("column4").alias("norm"),
                      _r(F.aggregate("column1", F.lit(0.0), lambda a, x: a + x)).alias("f1_sum"))


QUERIES["svd_plus_plus"] = svd_plus_plus


def connected_components_min_label(spark, sf):
    """Connected components by min-label propagation (the O(diameter) option)."""
    g = fx.part_next(spark, sf)
    return g.connected_components(algorithm="min_label").select("id", "component")


QUERIES["connected_components_min_label"] = connected_components_min_label


def geo_components(spark, sf):
    """Connected components over string ids: customers, suppliers, nations, regions."""
    return fx.geo(spark, sf).connected_components().select("id", "component")


QUERIES["geo_components"] = geo_components


def persist_checkpoint(spark, sf):
    """Degrees read from a graph that was persisted, checkpointed and released again."""
    g = fx.part_next(spark, sf).persist()
    kept = g.checkpoint()
    g.unpersist()
    return kept.degrees


QUERIES["persist_checkpoint"] = persist_checkpoint


def order_components(spark, sf):
    """Connected components of a graph with one per customer."""
    return fx.order_chain(spark, sf).connected_components().select("id", "component")


def order_components_min_label(spark, sf):
    return fx.order_chain(spark, sf).connected_components(algorithm="min_label").select("id", "component")


def order_strong_components(spark, sf):
    """Strongly connected components of a graph with very many, of many sizes."""
    return fx.order_chain(spark, sf).strongly_connected_components().select("id", "component")


QUERIES.update({
    "order_components": order_components,
    "order_components_min_label": order_components_min_label,
    "order_strong_components": order_strong_components,
})
