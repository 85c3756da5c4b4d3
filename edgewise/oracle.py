"""DuckDB SQL twins of ``edgewise.queries`` (the correctness oracle).

Written independently of the Spark code: each graph is a CTE over the
driver's tables and each iterative operator is unrolled or expressed with a
recursive CTE.  Column names match the Spark queries exactly.
"""

from __future__ import annotations

from .plans.fixtures import LATTICE_REACH
from .queries import LANDMARKS, LPA_ITER, PAGERANK_ITER, PAGERANK_TOL, PERSONAL_SOURCES, \
    PIC_ITER, PREGEL_ITER, RESET

# ---- graph views ------------------------------------------------------------------

LINE_SUCCESSORS = """
SELECT l_partkey AS src,
       lead(l_partkey) OVER w AS dst,
       l_quantity,
       lead(l_quantity) OVER w AS next_quantity
FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)
"""

PART_NEXT_RAW = f"SELECT * FROM ({LINE_SUCCESSORS}) WHERE dst IS NOT NULL"
PART_NEXT = (f"SELECT DISTINCT src, dst FROM ({LINE_SUCCESSORS}) "
             "WHERE dst IS NOT NULL AND dst <> src")
USER_HANDOFF = """
SELECT DISTINCT src, dst FROM (
  SELECT user_id AS src,
         lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst
  FROM events)
WHERE dst IS NOT NULL AND src <> dst
"""
PART_VERTICES = ("SELECT p_partkey AS id, p_brand, p_type, p_size, p_retailprice FROM part")


def vertices_sql(edges_cte: str) -> str:
    return f"SELECT src AS id FROM {edges_cte} UNION SELECT dst FROM {edges_cte}"


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# ---- step 0 --------------------------------------------------------------------

SQL: dict[str, str] = {}

SQL["from_edges"] = f"WITH e AS ({PART_NEXT}) {vertices_sql('e')}"
SQL["in_degrees"] = (f"WITH e AS ({PART_NEXT_RAW}) SELECT dst AS id, "
                     "CAST(count(*) AS INTEGER) AS inDegree FROM e GROUP BY dst")
SQL["out_degrees"] = (f"WITH e AS ({PART_NEXT_RAW}) SELECT src AS id, "
                      "CAST(count(*) AS INTEGER) AS outDegree FROM e GROUP BY src")
SQL["degrees"] = (f"WITH e AS ({PART_NEXT_RAW}), ends AS (SELECT src AS id FROM e "
                  "UNION ALL SELECT dst FROM e) SELECT id, CAST(count(*) AS INTEGER) AS degree "
                  "FROM ends GROUP BY id")


# ---- step 1: PageRank ---------------------------------------------------------------

def pagerank_sql(edges_sql: str, iters: int, reset: float = RESET) -> str:
    """Unrolled power iteration; final scale to sum = |V|.  Returns CTE text
    ending in a relation ``ranks(id, pagerank)`` (unrounded)."""
    a, b = _d(reset), f"({_d(1.0)} - {_d(reset)})"
    parts = [f"e AS ({edges_sql})",
             f"v AS ({vertices_sql('e')})",
             f"od AS (SELECT src AS id, {_d(1.0)} / count(*) AS inv FROM e GROUP BY src)",
             f"r0 AS (SELECT id, {_d(1.0)} AS pr FROM v)"]
    for i in range(1, iters + 1):
        parts.append(
            f"r{i} AS (SELECT v.id, {a} + {b} * coalesce(s.s, {_d(0.0)}) AS pr FROM v LEFT JOIN "
            f"(SELECT e.dst AS id, sum(r.pr * od.inv) AS s FROM e JOIN r{i-1} r ON e.src = r.id "
            f"JOIN od ON od.id = e.src GROUP BY e.dst) s ON v.id = s.id)")
    parts.append(f"ranks AS (SELECT id, pr * (CAST((SELECT count(*) FROM v) AS DOUBLE) / "
                 f"(SELECT sum(pr) FROM r{iters})) AS pagerank FROM r{iters})")
    return "WITH " + ",\n".join(parts) + "\n"


SQL["pagerank_static"] = (pagerank_sql(PART_NEXT, PAGERANK_ITER)
                          + "SELECT id, round(pagerank, 6) AS pagerank FROM ranks")
SQL["pagerank_topk"] = (pagerank_sql(PART_NEXT, PAGERANK_ITER)
                        + "SELECT id, round(pagerank, 6) AS pagerank FROM ranks "
                          "ORDER BY pagerank DESC, id ASC LIMIT 20")
SQL["pagerank_edge_weight"] = (f"WITH e AS ({PART_NEXT}), od AS (SELECT src, count(*) AS n "
                               "FROM e GROUP BY src) SELECT e.src, e.dst, "
                               f"round({_d(1.0)} / od.n, 6) AS weight FROM e JOIN od USING (src)")


# ---- step 2 ---------------------------------------------------------------------

def landmark_distances_sql(edges_sql: str, landmarks) -> str:
    """BFS to landmarks as a keyed recursive CTE: a pair enters once, at its
    first (smallest) level, so the recursion ends on cyclic graphs."""
    lm = ", ".join(str(x) for x in landmarks)
    return f"""
WITH RECURSIVE e AS ({edges_sql}),
v AS ({vertices_sql('e')}),
sp(id, landmark, distance) USING KEY (id, landmark) AS (
  SELECT id, id AS landmark, 0 AS distance FROM v WHERE id IN ({lm})
  UNION
  SELECT e.src AS id, sp.landmark, min(sp.distance) + 1 AS distance
  FROM sp JOIN e ON e.dst = sp.id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.sp r WHERE r.id = e.src AND r.landmark = sp.landmark)
  GROUP BY e.src, sp.landmark
)
"""


SQL["shortest_paths"] = (landmark_distances_sql(PART_NEXT, LANDMARKS)
                         + "SELECT id, landmark, distance FROM sp")


def triangle_count_sql(edges_sql: str) -> str:
    return f"""
WITH e AS ({edges_sql}),
v AS ({vertices_sql('e')}),
u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst),
t AS (SELECT e1.a AS x, e1.b AS y, e2.b AS z
      FROM u e1 JOIN u e2 ON e1.b = e2.a JOIN u e3 ON e3.a = e1.a AND e3.b = e2.b),
p AS (SELECT x AS id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t),
c AS (SELECT id, count(*) AS n FROM p GROUP BY id)
SELECT v.id, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM v LEFT JOIN c ON v.id = c.id
"""


SQL["triangle_count"] = triangle_count_sql(PART_NEXT)


# ---- step 6 ----------------------------------------------------------------------

DOC_COPIES = """
SELECT r.rep AS src, d.doc_id AS dst
FROM documents d
JOIN (SELECT text, min(doc_id) AS rep, count(*) AS copies FROM documents GROUP BY text) r
  ON d.text = r.text
WHERE r.copies > 1 AND d.doc_id <> r.rep
"""


def weak_components_sql(edges_sql: str) -> str:
    """Smallest id that reaches a vertex over undirected edges, by falling labels."""
    return f"""
WITH RECURSIVE e AS ({edges_sql}),
v AS ({vertices_sql('e')}),
u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
lab(id, component) USING KEY (id) AS (
  SELECT id, id FROM v
  UNION
  SELECT u.b AS id, min(lab.component) AS component
  FROM lab JOIN u ON u.a = lab.id JOIN recurring.lab r ON r.id = u.b
  WHERE lab.component < r.component
  GROUP BY u.b
)
SELECT id, component FROM lab
"""


def strong_components_sql(edges_sql: str) -> str:
    """Directed reachability closure; component = smallest mutually reachable id."""
    return f"""
WITH RECURSIVE e AS ({edges_sql}),
v AS ({vertices_sql('e')}),
r(id, reach) AS (SELECT id, id FROM v UNION SELECT r.id, e.dst FROM r JOIN e ON e.src = r.reach)
SELECT r1.id, min(r1.reach) AS component
FROM r r1 JOIN r r2 ON r1.reach = r2.id AND r2.reach = r1.id
GROUP BY r1.id
"""


SQL["connected_components"] = weak_components_sql(PART_NEXT)
SQL["doc_copy_components"] = weak_components_sql(DOC_COPIES)
SQL["strongly_connected_components"] = strong_components_sql(PART_NEXT)


def label_propagation_sql(edges_sql: str, iters: int) -> str:
    parts = [f"e AS ({edges_sql})", f"v AS ({vertices_sql('e')})",
             "sym AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst AS a, src AS b FROM e)",
             "l0 AS (SELECT id, id AS label FROM v)"]
    for i in range(1, iters + 1):
        parts.append(f"""c{i} AS (SELECT s.b AS id, l.label, count(*) AS n
  FROM sym s JOIN l{i-1} l ON s.a = l.id GROUP BY s.b, l.label)""")
        parts.append(f"""b{i} AS (SELECT id, label FROM (SELECT id, label, row_number() OVER
  (PARTITION BY id ORDER BY n DESC, label ASC) AS rn FROM c{i}) WHERE rn = 1)""")
        parts.append(f"""l{i} AS (SELECT p.id, coalesce(b.label, p.label) AS label
  FROM l{i-1} p LEFT JOIN b{i} b ON p.id = b.id)""")
    return "WITH " + ",\n".join(parts) + f"\nSELECT id, label FROM l{iters}"


SQL["label_propagation"] = label_propagation_sql(PART_NEXT, LPA_ITER)


def power_iteration_sql(edges_sql: str, k: int, iters: int) -> str:
    """Unrolled power iteration of the row-normalised adjacency from the degrees; the values, in order,
    are parted at their k - 1 widest gaps, and a part is named by its smallest id."""
    parts = [f"e AS ({edges_sql})",
             "s AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e)",
             "w AS (SELECT a AS id, CAST(count(*) AS DOUBLE) AS d FROM s GROUP BY a)",
             "v0 AS (SELECT id, d / (SELECT sum(d) FROM w) AS v FROM w)"]
    for i in range(1, iters + 1):
        parts.append(f"v{i} AS (SELECT s.a AS id, avg(v.v) AS v FROM s JOIN v{i-1} v ON v.id = s.b GROUP BY s.a)")
    parts += [f"o AS (SELECT id, v, v - lag(v) OVER (ORDER BY v, id) AS gap FROM v{iters})",
              f"cut AS (SELECT gap FROM o WHERE gap IS NOT NULL ORDER BY gap DESC LIMIT {k - 1})",
              "c AS (SELECT id, sum(CASE WHEN gap >= (SELECT min(gap) FROM cut) THEN 1 ELSE 0 END) "
              "OVER (ORDER BY v, id) AS part FROM o)"]
    return "WITH " + ",\n".join(parts) + "\nSELECT id, min(id) OVER (PARTITION BY part) AS first_id FROM c"


PART_LATTICES = ("SELECT p.p_partkey AS src, q.p_partkey AS dst FROM part p, range(1, "
                 f"{max(LATTICE_REACH) + 1}) t(j), part q WHERE q.p_partkey = p.p_partkey + 3 * t.j AND t.j <= "
                 "CASE p.p_partkey % 3 " + " ".join(f"WHEN {r} THEN {n}" for r, n in enumerate(LATTICE_REACH)) + " END")

SQL["power_iteration_partition"] = power_iteration_sql(PART_LATTICES, len(LATTICE_REACH), PIC_ITER)


# ---- step 4 ----------------------------------------------------------------------

SQL["triplets"] = f"""
WITH e AS ({PART_NEXT}), p AS ({PART_VERTICES})
SELECT s.id AS src_id, s.p_brand AS src_brand, d.id AS dst_id, d.p_brand AS dst_brand,
       s.p_size + d.p_size AS size_sum
FROM e JOIN p s ON e.src = s.id JOIN p d ON e.dst = d.id
"""
SQL["filter_vertices"] = f"""
WITH e AS ({PART_NEXT}), k AS (SELECT id FROM ({PART_VERTICES}) WHERE p_size <= 25)
SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)
"""
SQL["filter_edges"] = (f"SELECT src, dst, l_quantity, next_quantity FROM ({PART_NEXT_RAW}) "
                       "WHERE l_quantity > next_quantity")
SQL["drop_isolated"] = f"""
WITH e AS ({PART_NEXT})
SELECT id, p_size FROM ({PART_VERTICES}) WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e)
"""
SQL["aggregate_messages_src"] = f"""
WITH e AS ({PART_NEXT}), p AS ({PART_VERTICES})
SELECT s.id, round(sum(d.p_retailprice), 6) AS total_price, count(d.p_retailprice) AS n_msgs
FROM e JOIN p s ON e.src = s.id JOIN p d ON e.dst = d.id GROUP BY s.id
"""
SQL["aggregate_messages_dst"] = f"""
WITH e AS ({PART_NEXT}), p AS ({PART_VERTICES}),
t AS (SELECT s.id AS sid, s.p_size AS ssize, d.id AS did, d.p_size AS dsize
      FROM e JOIN p s ON e.src = s.id JOIN p d ON e.dst = d.id),
m AS (SELECT did AS id, ssize AS msg FROM t
      UNION ALL SELECT sid AS id, CASE WHEN dsize > 40 THEN dsize END AS msg FROM t)
SELECT id, max(msg) AS max_size, count(msg) AS n_msgs FROM m WHERE msg IS NOT NULL GROUP BY id
"""


# ---- step 5 ----------------------------------------------------------------------

def pagerank_tol_sql(edges_sql: str, tol: float, max_steps: int = 100, reset: float = RESET) -> str:
    """Power iteration that freezes once an update moved no rank by more than tol."""
    a, b = _d(reset), f"({_d(1.0)} - {_d(reset)})"
    parts = [f"e AS ({edges_sql})", f"v AS ({vertices_sql('e')})",
             f"od AS (SELECT src AS id, {_d(1.0)} / count(*) AS inv FROM e GROUP BY src)",
             f"r0 AS (SELECT id, {_d(1.0)} AS pr FROM v)",
             "c0 AS (SELECT false AS conv)"]
    for i in range(1, max_steps + 1):
        parts.append(
            f"n{i} AS (SELECT v.id, {a} + {b} * coalesce(s.s, {_d(0.0)}) AS pr FROM v LEFT JOIN "
            f"(SELECT e.dst AS id, sum(r.pr * od.inv) AS s FROM e JOIN r{i-1} r ON e.src = r.id "
            f"JOIN od ON od.id = e.src GROUP BY e.dst) s ON v.id = s.id)")
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT n.id, CASE WHEN (SELECT conv FROM c{i-1}) THEN p.pr "
            f"ELSE n.pr END AS pr FROM n{i} n JOIN r{i-1} p ON n.id = p.id)")
        parts.append(
            f"c{i} AS MATERIALIZED (SELECT (SELECT conv FROM c{i-1}) OR "
            f"max(abs(n.pr - p.pr)) <= {_d(tol)} AS conv FROM n{i} n JOIN r{i-1} p ON n.id = p.id)")
    k = max_steps
    parts.append(f"ranks AS (SELECT id, pr * (CAST((SELECT count(*) FROM v) AS DOUBLE) / "
                 f"(SELECT sum(pr) FROM r{k})) AS pagerank FROM r{k})")
    return "WITH " + ",\n".join(parts) + "\n"


SQL["pagerank_tol"] = (pagerank_tol_sql(PART_NEXT, PAGERANK_TOL)
                       + "SELECT id, round(pagerank, 6) AS pagerank FROM ranks")


def personalized_sql(edges_sql: str, sources, iters: int, reset: float = RESET) -> str:
    """Sparse personalised PageRank for several sources: relation ``pp(id, source, pr)``
    holding non-zero entries, each source normalised to sum 1."""
    a, b = _d(reset), f"({_d(1.0)} - {_d(reset)})"
    vals = ", ".join(f"({s})" for s in sources)
    parts = [f"e AS ({edges_sql})", f"v AS ({vertices_sql('e')})",
             f"od AS (SELECT src AS id, {_d(1.0)} / count(*) AS inv FROM e GROUP BY src)",
             f"srcs AS (SELECT source FROM (VALUES {vals}) t(source) "
             "WHERE source IN (SELECT id FROM v))",
             f"p0 AS (SELECT source AS id, source, {_d(1.0)} AS pr FROM srcs)"]
    for i in range(1, iters + 1):
        parts.append(
            f"s{i} AS (SELECT e.dst AS id, p.source, sum(p.pr * od.inv) AS s FROM p{i-1} p "
            f"JOIN e ON e.src = p.id JOIN od ON od.id = p.id GROUP BY e.dst, p.source)")
        parts.append(
            f"p{i} AS (SELECT * FROM (SELECT coalesce(s.id, r.id) AS id, "
            f"coalesce(s.source, r.source) AS source, coalesce(r.ra, {_d(0.0)}) + {b} * "
            f"coalesce(s.s, {_d(0.0)}) AS pr FROM s{i} s FULL OUTER JOIN "
            f"(SELECT source AS id, source, {a} AS ra FROM srcs) r "
            f"ON s.id = r.id AND s.source = r.source) WHERE pr <> 0)")
    parts.append(f"pp AS (SELECT id, source, pr / sum(pr) OVER (PARTITION BY source) AS pr "
                 f"FROM p{iters})")
    return "WITH " + ",\n".join(parts) + "\n"


SQL["pagerank_parallel_personalized"] = (
    personalized_sql(PART_NEXT, PERSONAL_SOURCES, PAGERANK_ITER)
    + "SELECT id, source, round(pr, 6) AS pagerank FROM pp")
SQL["pagerank_personalized"] = (
    personalized_sql(PART_NEXT, PERSONAL_SOURCES[:1], PAGERANK_ITER)
    + "SELECT v.id, round(coalesce(pp.pr, 0.0), 6) AS pagerank FROM v LEFT JOIN pp ON v.id = pp.id")


def pregel_pagerank_sql(edges_sql: str, iters: int, reset: float = RESET) -> str:
    parts = [f"e AS ({edges_sql})", f"v AS ({vertices_sql('e')})",
             "n AS (SELECT count(*) AS n FROM v)",
             "od AS (SELECT src AS id, count(*) AS deg FROM e GROUP BY src)",
             f"r0 AS (SELECT id, {_d(1.0)} / (SELECT n FROM n) AS rank FROM v)"]
    for i in range(1, iters + 1):
        parts.append(
            f"r{i} AS (SELECT v.id, coalesce(m.s, {_d(0.0)}) * ({_d(1.0)} - {_d(reset)}) + "
            f"{_d(reset)} / (SELECT n FROM n) AS rank FROM v LEFT JOIN "
            f"(SELECT e.dst AS id, sum(r.rank / od.deg) AS s FROM e JOIN r{i-1} r ON e.src = r.id "
            f"JOIN od ON od.id = e.src GROUP BY e.dst) m ON v.id = m.id)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT id, round(rank, 6) AS rank FROM r{iters}"


SQL["pregel_pagerank"] = pregel_pagerank_sql(PART_NEXT, PREGEL_ITER)


# ---- step 7 ----------------------------------------------------------------------

SQL["motif_two_hop"] = f"""
WITH e AS ({PART_NEXT})
SELECT e1.src AS a_id, count(*) AS paths FROM e e1 JOIN e e2 ON e1.dst = e2.src GROUP BY e1.src
"""
SQL["motif_mutual"] = f"""
WITH e AS ({USER_HANDOFF})
SELECT e1.src AS a_id, e1.dst AS b_id FROM e e1 JOIN e e2 ON e1.dst = e2.src AND e2.dst = e1.src
"""
SQL["motif_negated"] = f"""
WITH e AS ({USER_HANDOFF})
SELECT e1.src AS a_id, count(*) AS paths FROM e e1 JOIN e e2 ON e1.dst = e2.src
WHERE NOT EXISTS (SELECT 1 FROM e e3 WHERE e3.src = e2.dst AND e3.dst = e1.src) GROUP BY e1.src
"""


def bfs_sql(edges_sql: str, vertices_sql_: str, from_cond: str, to_cond: str,
            max_len: int = 10) -> str:
    """Multi-source BFS levels (keyed recursive CTE), then every path that climbs
    one level per edge and ends on a target at the first level holding one."""
    return f"""
WITH RECURSIVE e AS ({edges_sql}), v AS ({vertices_sql_}),
s AS (SELECT id FROM v WHERE {from_cond}),
t AS (SELECT id FROM v WHERE {to_cond}),
lvl(id, d) USING KEY (id) AS (
  SELECT id, 0 FROM s
  UNION
  SELECT e.dst AS id, min(lvl.d) + 1 AS d FROM lvl JOIN e ON e.src = lvl.id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.lvl r WHERE r.id = e.dst)
  GROUP BY e.dst
),
lim AS (SELECT min(lvl.d) AS l FROM lvl JOIN t ON lvl.id = t.id),
paths(from_id, cur, path, len) AS (
  SELECT id, id, CAST(id AS VARCHAR), 0 FROM s
  UNION ALL
  SELECT p.from_id, e.dst, p.path || ',' || CAST(e.dst AS VARCHAR), p.len + 1
  FROM paths p JOIN e ON e.src = p.cur JOIN lvl ON lvl.id = e.dst AND lvl.d = p.len + 1
  WHERE p.len < (SELECT l FROM lim)
)
SELECT from_id, cur AS to_id, len AS length, path FROM paths
WHERE len = (SELECT l FROM lim) AND len <= {max_len} AND cur IN (SELECT id FROM t)
"""


def _bfs_entry():
    from .queries import BFS_FROM, BFS_TO
    return bfs_sql(PART_NEXT, PART_VERTICES, BFS_FROM, BFS_TO, 10)


SQL["bfs"] = _bfs_entry()


# ---- step 3 ----------------------------------------------------------------------

SQL["ws_text_source"] = f"SELECT src, dst, l_quantity FROM ({PART_NEXT_RAW})"
SQL["csv_sink_roundtrip"] = (landmark_distances_sql(PART_NEXT, LANDMARKS) + """
, m AS (SELECT id, '{' || string_agg('"' || CAST(landmark AS VARCHAR) || '":' ||
                                      CAST(distance AS VARCHAR), ',' ORDER BY landmark) || '}' AS d
        FROM sp GROUP BY id)
SELECT v.id, coalesce(m.d, '{}') AS distances FROM v LEFT JOIN m ON v.id = m.id
""")


# ---- step 8 ----------------------------------------------------------------------

REQUESTS = """
SELECT CAST(o_orderkey AS VARCHAR) AS name,
       CASE o_orderkey % 16 WHEN 0 THEN NULL WHEN 1 THEN o_orderpriority WHEN 2 THEN repeat('x', 33)
            ELSE regexp_replace(lower(o_orderpriority), '[^0-9a-z]+', '-', 'g') END AS tenant,
       CASE o_orderkey % 16 WHEN 3 THEN NULL WHEN 4 THEN 'User ' || CAST(o_custkey AS VARCHAR) WHEN 5 THEN repeat('x', 33)
            ELSE CAST(o_custkey AS VARCHAR) END AS "user",
       CASE o_orderkey % 16 WHEN 6 THEN repeat('m', 128) ELSE 'user' END || CAST(o_custkey AS VARCHAR) || '@example.com'
         AS user_email,
       CASE o_orderkey % 16 WHEN 7 THEN NULL ELSE 'graphs/' || CASE o_orderkey % 16 WHEN 2 THEN repeat('d/', 64) ELSE '' END
            || lower(o_orderstatus) || '/' || CAST(o_orderkey AS VARCHAR) END AS graph_location,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST((o_custkey % 4) + 1 AS INTEGER) END
         AS nr_workers,
       o_orderdate AS ts
FROM orders
"""

SQL["validate_requests"] = f"""
WITH r AS ({REQUESTS}),
c AS (SELECT name, concat_ws(',',
   CASE WHEN tenant IS NULL THEN 'tenant_missing' END,
   CASE WHEN tenant IS NOT NULL AND NOT regexp_full_match(tenant, '^[0-9a-z-./]+$')
        THEN 'tenant_pattern' END,
   CASE WHEN length(tenant) > 32 THEN 'tenant_length' END,
   CASE WHEN "user" IS NULL THEN 'user_missing' END,
   CASE WHEN "user" IS NOT NULL AND NOT regexp_full_match("user", '^[0-9a-z-./]+$')
        THEN 'user_pattern' END,
   CASE WHEN length("user") > 32 THEN 'user_length' END,
   CASE WHEN length(user_email) > 128 THEN 'email_length' END,
   CASE WHEN graph_location IS NULL THEN 'location_missing' END,
   CASE WHEN length(graph_location) > 128 THEN 'location_length' END) AS violations FROM r)
SELECT name, violations, violations = '' AS is_valid FROM c
"""
SQL["normalize_requests"] = f"""
WITH r AS ({REQUESTS})
SELECT name, lower(tenant) AS tenant, lower("user") AS "user",
       coalesce(nr_workers, 2) AS nr_workers, 'mount.' || graph_location AS module,
       concat_ws('-', lower(tenant), lower("user"), name) AS run_name
FROM r
"""
SQL["first_arrivals"] = """
SELECT name, first_ts, event_id FROM (
  SELECT user_id AS name, ts AS first_ts, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events) WHERE rn = 1
"""
REQUEST_OUTCOMES = """
WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS request_ts
           FROM events WHERE event_type = 'signup' GROUP BY ALL),
o AS (SELECT user_id, CAST(ts AS DATE) AS day,
             CASE WHEN max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1
                  THEN 200 ELSE 400 END AS result_code
      FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL)
SELECT r.user_id, r.day, r.request_ts, o.result_code
FROM r LEFT JOIN o ON r.user_id = o.user_id AND r.day = o.day
"""
SQL["request_outcomes"] = REQUEST_OUTCOMES

STAGE_STAMPS = """
SELECT run, action, min(ts) AS ts FROM (
  SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS run, a.action, ts
  FROM events JOIN (VALUES ('view', 'start creation'), ('click', 'finish creation'),
                           ('click', 'start execution'), ('purchase', 'finish execution'),
                           ('purchase', 'start deletion'), ('error', 'finish deletion'))
                   a(event_type, action) USING (event_type))
GROUP BY run, action
"""
SQL["stage_log_source"] = f"SELECT run, action, ts FROM ({STAGE_STAMPS})"
STAGE_DURATIONS = f"""
WITH s AS ({STAGE_STAMPS}),
p AS (SELECT run,
  min(CASE WHEN action = 'start creation' THEN ts END) AS sc,
  min(CASE WHEN action = 'finish creation' THEN ts END) AS fc,
  min(CASE WHEN action = 'start execution' THEN ts END) AS se,
  min(CASE WHEN action = 'finish execution' THEN ts END) AS fe,
  min(CASE WHEN action = 'start deletion' THEN ts END) AS sd,
  min(CASE WHEN action = 'finish deletion' THEN ts END) AS fd
  FROM s GROUP BY run)
SELECT run, (epoch_us(fc) - epoch_us(sc)) / 1e6 AS creation_sec,
       (epoch_us(fe) - epoch_us(se)) / 1e6 AS execution_sec,
       (epoch_us(fd) - epoch_us(sd)) / 1e6 AS deletion_sec
FROM p
"""
SQL["stage_durations"] = f"""
SELECT run, round(creation_sec, 6) AS creation_sec, round(execution_sec, 6) AS execution_sec,
       round(deletion_sec, 6) AS deletion_sec FROM ({STAGE_DURATIONS})
"""
SQL["stage_summary"] = f"""
WITH d AS (SELECT *, regexp_extract(run, '(\\d{{4}}-\\d{{2}}-\\d{{2}})$', 1) AS day
           FROM ({STAGE_DURATIONS})),
l AS (SELECT day, 'creation' AS stage, creation_sec AS sec FROM d
      UNION ALL SELECT day, 'execution', execution_sec FROM d
      UNION ALL SELECT day, 'deletion', deletion_sec FROM d)
SELECT stage, day, count(*) AS n,
       round(CAST(sum(CAST(round(sec * 1e6) AS DECIMAL(38,0))) AS DOUBLE) / count(*) / 1e6, 6)
         AS avg_sec,
       round(stddev_samp(sec), 3) AS stddev_sec, round(min(sec), 6) AS min_sec,
       round(max(sec), 6) AS max_sec
FROM l WHERE sec IS NOT NULL GROUP BY ROLLUP (stage, day)
"""
SQL["outcome_classes"] = f"""
SELECT CASE WHEN result_code IS NULL THEN 'no_outcome' WHEN result_code = 200 THEN 'ok'
            WHEN result_code = 400 THEN 'user_error' WHEN result_code = 500 THEN 'platform_error'
            ELSE 'other' END AS outcome_class, count(*) AS n
FROM ({REQUEST_OUTCOMES}) GROUP BY 1
"""
SQL["first_arrivals_stream"] = SQL["first_arrivals"]
SQL["request_outcomes_stream"] = REQUEST_OUTCOMES
SQL["daily_arrivals_stream"] = "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events"
SQL["request_outcome_match"] = """
WITH r AS (SELECT event_id, user_id, ts AS request_ts FROM events WHERE event_type = 'signup'),
o AS (SELECT user_id, ts AS outcome_ts, CASE event_type WHEN 'purchase' THEN 200 ELSE 400 END AS result_code
      FROM events WHERE event_type IN ('purchase', 'error')),
j AS (SELECT r.*, o.outcome_ts, o.result_code,
             row_number() OVER (PARTITION BY r.event_id ORDER BY o.outcome_ts, o.result_code) AS rn
      FROM r LEFT JOIN o ON o.user_id = r.user_id AND o.outcome_ts >= r.request_ts
                        AND o.outcome_ts <= r.request_ts + INTERVAL 6 HOUR)
SELECT event_id, user_id, request_ts, outcome_ts, result_code FROM j WHERE rn = 1
"""
SQL["request_outcome_match_stream"] = SQL["request_outcome_match"]
SQL["stage_percentiles"] = f"""
WITH d AS (SELECT *, regexp_extract(run, '(\\d{{4}}-\\d{{2}}-\\d{{2}})$', 1) AS day
           FROM ({STAGE_DURATIONS})),
l AS (SELECT day, 'creation' AS stage, creation_sec AS sec FROM d
      UNION ALL SELECT day, 'execution', execution_sec FROM d
      UNION ALL SELECT day, 'deletion', deletion_sec FROM d),
g AS (SELECT stage, day, count(*) AS n FROM l WHERE sec IS NOT NULL GROUP BY ROLLUP (stage, day))
SELECT g.stage, g.day, g.n, p.percentage, true AS rank_within_bound
FROM g JOIN (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) p(percentage) ON g.n > 0
"""

SQL["connected_components_min_label"] = weak_components_sql(PART_NEXT)

GEO = """
SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst FROM customer
UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
"""
SQL["geo_components"] = weak_components_sql(GEO).replace(
    vertices_sql("e"), vertices_sql("e") + " UNION SELECT 'R' || r_regionkey FROM region")
SQL["persist_checkpoint"] = (f"WITH e AS ({PART_NEXT}), ends AS (SELECT src AS id FROM e "
                             "UNION ALL SELECT dst FROM e) SELECT id, CAST(count(*) AS INTEGER) AS degree "
                             "FROM ends GROUP BY id")

ORDER_CHAIN = """
SELECT src, dst FROM (
  SELECT UNNEST([{'src': o_orderkey, 'dst': n1},
                 CASE WHEN p1 < o_totalprice THEN {'src': n1, 'dst': o_orderkey} END,
                 CASE WHEN q2 = o_orderpriority THEN {'src': n2, 'dst': o_orderkey} END], recursive := true)
  FROM (SELECT o_orderkey, o_totalprice, o_orderpriority, lead(o_orderkey) OVER w AS n1, lead(o_totalprice) OVER w AS p1,
               lead(o_orderkey, 2) OVER w AS n2, lead(o_orderpriority, 2) OVER w AS q2
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)))
WHERE src IS NOT NULL AND dst IS NOT NULL
"""


def path_counts_sql(edges_sql: str, sources_sql: str) -> str:
    """Levels of a keyed recursive CTE; a row of a level adds up the paths of the level before."""
    return f"""
WITH RECURSIVE e AS ({edges_sql}),
lvl(id, d, n) USING KEY (id) AS (
  SELECT id, 0, CAST(1 AS HUGEINT) FROM ({sources_sql}) s
  UNION
  SELECT e.dst AS id, min(lvl.d) + 1 AS d, sum(lvl.n) AS n FROM lvl JOIN e ON e.src = lvl.id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.lvl r WHERE r.id = e.dst)
  GROUP BY e.dst
)
SELECT id, d AS distance, CAST(n AS BIGINT) AS n_paths FROM lvl
"""


SQL["path_counts"] = path_counts_sql(
    ORDER_CHAIN, "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'")
SQL["order_components"] = weak_components_sql(ORDER_CHAIN)
SQL["order_components_min_label"] = SQL["order_components"]
SQL["order_strong_components"] = strong_components_sql(ORDER_CHAIN)


# ---- factorisation ----------------------------------------------------------------------

RATINGS = """
SELECT o_custkey AS src, -l_partkey AS dst, avg(l_quantity) / 10.0 AS r
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
"""


def svd_sql(ratings_sql: str, rank: int = 10, iters: int = 2) -> str:
    """SVD++ unrolled: lists of ``rank`` factors, synchronous steps; ends in a relation ``s<iters>``."""
    def listed(expr: str) -> str:
        return "[" + ", ".join(expr.replace("$", str(k + 1)) for k in range(rank)) + "]"

    def start(tag: int) -> str:
        out = []
        for k in range(rank):
            mixed = f"((((id % 10007) + 10007) % 10007) * 7919 + {(k + 1) * 104729 + tag * 1299709}) % 10007"
            out.append(f"((({mixed}) * ({mixed}) + {k}) % 10007) / 10007.0::DOUBLE")
        return "[" + ", ".join(out) + "]"

    parts = [f"e AS MATERIALIZED ({ratings_sql})", "mu AS (SELECT avg(r) AS mu FROM e)",
             "ends AS (SELECT src AS id, r FROM e UNION ALL SELECT dst, r FROM e)",
             f"s0 AS MATERIALIZED (SELECT id, {start(1)} AS f1, {start(2)} AS f2, avg(r) - (SELECT mu FROM mu) AS bias, "
             "1.0::DOUBLE / sqrt(count(*)::DOUBLE) AS norm FROM ends GROUP BY id)"]
    dot = " + ".join(f"i.f1[{k + 1}] * u.imp[{k + 1}]" for k in range(rank))
    for n in range(iters):
        parts += [
            f"y{n} AS (SELECT e.src AS id, {listed('sum(s.f2[$])')} AS y FROM e JOIN s{n} s ON s.id = e.dst GROUP BY e.src)",
            f"u{n} AS MATERIALIZED (SELECT s.*, {listed('s.norm * y.y[$] + s.f1[$]')} AS imp FROM s{n} s JOIN y{n} y ON y.id = s.id)",
            f"t{n} AS MATERIALIZED (SELECT e.src, e.dst, u.f1 AS p, u.bias AS ub, u.norm AS un, u.imp, i.f1 AS q, i.f2 AS y, "
            f"i.bias AS ib, e.r - least(greatest((SELECT mu FROM mu) + u.bias + i.bias + ({dot}), 0.0), 5.0) AS err "
            f"FROM e JOIN u{n} u ON u.id = e.src JOIN s{n} i ON i.id = e.dst)",
            f"p{n} AS (SELECT src AS id, {listed('sum((err * q[$] - 0.015 * p[$]) * 0.007)')} AS d1, "
            f"sum((err - 0.005 * ub) * 0.007) AS db FROM t{n} GROUP BY src)",
            f"q{n} AS (SELECT dst AS id, {listed('sum((err * imp[$] - 0.015 * q[$]) * 0.007)')} AS d1, "
            f"{listed('sum((err * un * q[$] - 0.015 * y[$]) * 0.007)')} AS d2, "
            f"sum((err - 0.005 * ib) * 0.007) AS db FROM t{n} GROUP BY dst)",
            f"s{n + 1} AS MATERIALIZED (SELECT s.id, {listed('s.f1[$] + coalesce(p.d1[$], 0) + coalesce(q.d1[$], 0)')} AS f1, "
            f"{listed('s.f2[$] + coalesce(q.d2[$], 0)')} AS f2, s.bias + coalesce(p.db, 0) + coalesce(q.db, 0) AS bias, s.norm "
            f"FROM s{n} s LEFT JOIN p{n} p ON p.id = s.id LEFT JOIN q{n} q ON q.id = s.id)"]
    return "WITH " + ",\n".join(parts)


SQL["svd_plus_plus"] = svd_sql(RATINGS) + """
SELECT id, round(bias, 6) AS bias, round(norm, 6) AS norm, round(list_sum(f1), 6) AS f1_sum FROM s2
"""
