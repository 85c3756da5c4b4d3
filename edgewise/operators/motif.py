"""Motif search: ``g.find("(a)-[e]->(b); (b)-[]->(c); !(c)-[]->(a)")``.

Grammar (terms separated by ``;``)::

    term    := ["!"] "(" name? ")" "-" "[" name? "]" "->" "(" name? ")"
             | "(" name ")"
    name    := [A-Za-z_][A-Za-z0-9_]*

A named vertex binds a struct of all vertex columns, a named edge a struct
of all edge columns; anonymous ``()`` / ``[]`` bind nothing.  Terms sharing
a name are joined on it; different names may bind the same vertex.  A
negated term removes matches that have such an edge (a left anti join); its
vertices must be named by positive terms and its edge must be anonymous.
Every positive term must share a name with the ones before it (after
reordering): a pattern made of disconnected parts would be a cross product
and is rejected.

Matching moves ids only: edges and vertices are written once, terms are joined on vertex ids, and
the vertex columns come last. The order of the terms is the one with the fewest estimated rows,
from sums over the degrees of all vertices. A vertex listed twice counts once, and a named vertex
must be listed. When the largest degree allows a vertex too many rows, the rows of each join key are
counted and hot keys meet in a grid of cells (``plans.skew.hot_cells``); else the joins are plain.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import DST, ID, SRC, Graph
from ..plans.iterate import StepCutter
from ..plans.skew import PAIRS_PER_ROW, fits_broadcast, hot_cells, hub_limits, join_in_cells, shuffle_partitions

HASHED_ROWS = 1 << 21  # most edges that a task holds as a hash table

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_EDGE_TERM = re.compile(
    rf"^(!?)\(\s*({_NAME})?\s*\)\s*-\s*\[\s*({_NAME})?\s*\]\s*->\s*\(\s*({_NAME})?\s*\)$")
_VERTEX_TERM = re.compile(rf"^\(\s*({_NAME})\s*\)$")


@dataclass(frozen=True)
class Term:
    negated: bool
    src: str | None
    edge: str | None
    dst: str | None
    vertex_only: bool = False

    def names(self) -> set[str]:
        return {n for n in (self.src, self.edge, self.dst) if n}


def parse(pattern: str) -> list[Term]:
    terms = []
    for raw in pattern.split(";"):
        t = raw.strip()
        if not t:
            continue
        m = _EDGE_TERM.match(t)
        if m:
            terms.append(Term(m.group(1) == "!", m.group(2), m.group(3), m.group(4)))
            continue
        m = _VERTEX_TERM.match(t)
        if m:
            terms.append(Term(False, m.group(1), None, None, vertex_only=True))
            continue
        raise ValueError(f"cannot parse motif term {t!r}")
    if not terms:
        raise ValueError("empty motif")
    seen_edges: set[str] = set()
    for t in terms:
        if t.negated and t.edge:
            raise ValueError(f"negated term may not name its edge: {t}")
        if t.edge:
            if t.edge in seen_edges:
                raise ValueError(f"edge name {t.edge!r} used twice")
            seen_edges.add(t.edge)
    return terms


def term_order(terms: list[Term], edges: int, loops: int, products: dict[tuple[str, str], float]) -> list[Term]:
    """The order with the fewest estimated rows over all its steps; of equals, the first of the pattern.

    ``products[p, q]`` is the sum over all vertices of degree p times degree q ("i" in, "o" out): a term
    that hangs on one bound vertex makes ``products / edges`` rows of one. A term between bound vertices
    adds none (a loop leaves its share of the edges), so it comes as soon as it can.
    """
    best: tuple[float, list[Term]] | None = None
    for start in terms:
        order, rows, total = [], 0.0, 0.0
        bound: dict[str, str] = {}
        pending = list(terms)
        while pending:
            ways = []
            for t in pending:
                ends = [(n, role) for n, role in ((t.src, "o"), (t.dst, "i")) if n in bound]
                if not order:
                    ways.append(float(loops if t.src and t.src == t.dst else edges) if t is start else None)
                elif not ends:
                    ways.append(None)
                elif len(ends) == 2:
                    ways.append(rows * (loops / max(edges, 1) if t.src == t.dst else 1.0))
                else:
                    (name, role), = ends
                    ways.append(rows * products[bound[name], role] / max(edges, 1))
            at = min((i for i, w in enumerate(ways) if w is not None),
                     key=lambda i: (ways[i], not {pending[i].src, pending[i].dst} <= set(bound), i), default=None)
            if at is None:
                raise ValueError("motif has disconnected parts (would be a cross product)")
            rows = ways[at]
            total += rows
            t = pending.pop(at)
            order.append(t)
            for name, role in ((t.src, "o"), (t.dst, "i")):
                if name:
                    bound.setdefault(name, role)
        if best is None or total < best[0]:
            best = (total, order)
    return best[1]


def _at(name: str) -> str:
    """Column of a name while terms are joined."""
    return f"_m_{name}"


class _Matcher:
    """The written tables of one search, and what their degrees tell about hubs."""

    def __init__(self, cutter: StepCutter, g: Graph, with_attributes: bool):
        self.cutter, self.spark = cutter, g.edges.sparkSession
        columns = [F.col(SRC), F.col(DST)]
        if with_attributes:
            columns.append(F.struct(*[F.col(f"`{c}`") for c in g.edges.columns]).alias("_e"))
        self.vertices, _, self.edges, self.m = cutter.graph_inputs(
            g.vertices, g.edges, [F.col(f"`{c}`") for c in g.vertices.columns], columns)
        ends = (self.edges.groupBy(F.col(SRC).alias("id")).agg(
                    F.lit(0).cast("long").alias("i"), F.count(F.lit(1)).alias("o"),
                    F.count(F.when(F.col(SRC) == F.col(DST), 1)).alias("loops"))
                .unionByName(self.edges.groupBy(F.col(DST).alias("id")).agg(
                    F.count(F.lit(1)).alias("i"), F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("loops"))))
        degrees = (ends.where("id is not null").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("i", "o", "loops")])
                   .join(self.vertices.select("id", F.lit(True).alias("known")), "id", "left"))

        def product(p, q):
            return F.coalesce(F.sum(F.col(p).cast("double") * F.col(q)), F.lit(0.0))

        self.degrees, told = cutter.cut(degrees, {
            "ii": product("i", "i"), "oo": product("o", "o"), "io": product("i", "o"),
            "most": F.coalesce(F.max(F.greatest("i", "o")), F.lit(0)), "loops": F.coalesce(F.sum("loops"), F.lit(0)),
            "unknown": F.count(F.when(F.col("known").isNull(), 1))}, reliable=True)
        self.products = {("i", "i"): told["ii"], ("o", "o"): told["oo"], ("i", "o"): told["io"], ("o", "i"): told["io"]}
        self.most, self.loops, self.unknown = int(told["most"]), int(told["loops"]), int(told["unknown"])
        self.least = hub_limits(self.spark)[1]

    def _counts(self, role: str, key: str, n: str) -> DataFrame:
        return self.degrees.where(F.col(role) > 0).select(F.col("id").alias(key), F.col(role).alias(n))

    def _hot(self, keys: list[str], left: DataFrame, right: DataFrame) -> DataFrame:
        """Hot keys of a join, from the rows of each key on both sides (columns ``nl`` and ``nr``)."""
        both = left.join(right, keys, "full_outer").na.fill(0, ["nl", "nr"])
        counts, told = self.cutter.cut(both, {
            "left": F.coalesce(F.sum("nl"), F.lit(0)), "right": F.coalesce(F.sum("nr"), F.lit(0)),
            "pairs": F.coalesce(F.sum(F.col("nl").cast("double") * F.col("nr")), F.lit(0.0))}, reliable=True)
        return hot_cells(counts, keys, told["left"], told["right"], told["pairs"])

    def table(self, t: Term) -> DataFrame:
        """Edges of a term: only loops for one vertex at both ends, and no ends that are not listed."""
        e = self.edges
        if t.src and t.src == t.dst:
            e = e.where(F.col(SRC) == F.col(DST))
        for name, end, role in ((t.src, SRC, "o"), (t.dst, DST, "i")):
            if name:
                e = e.where(F.col(end).isNotNull())
            if name and self.unknown:
                strange = self.degrees.where("known is null").select(F.col("id").alias(end))
                hot = None
                if self.most > self.least:
                    hot = self._hot([end], self._counts(role, end, "nl"), strange.withColumn("nr", F.lit(1).cast("long")))
                e = join_in_cells(e, strange, [end], hot, "left_anti")
        ends = {name: end for name, end in ((t.src, SRC), (t.dst, DST)) if name}
        return e.select(*[F.col(end).alias(_at(name)) for name, end in ends.items()],
                        *([F.col("_e").alias(_at(t.edge))] if t.edge else []))

    def join(self, rows: DataFrame, done: list[Term], t: Term, role: dict[str, str]) -> DataFrame:
        """``rows``, matches of the terms ``done``, with the edges of ``t``."""
        right = self.table(t)
        names = [n for n in dict.fromkeys((t.src, t.dst)) if n in role]
        keys = [_at(n) for n in names]
        # no vertex can have more rows than this on the left, nor more pairs with the edges
        if self.most ** len(done) <= self.least and self.most ** (len(done) + 1) <= self.least * PAIRS_PER_ROW:
            return rows.join(right, keys)
        if len(done) == 1 and len(names) == 1:
            left = self._counts(role[names[0]], keys[0], "nl")
        else:
            rows, _ = self.cutter.cut(rows, reliable=True)
            left = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("nl"))
        counted = (self._counts("o" if names[0] == t.src else "i", keys[0], "nr") if len(names) == 1
                   else right.groupBy(*keys).agg(F.count(F.lit(1)).alias("nr")))
        return join_in_cells(rows, right, keys, self._hot(keys, left, counted))

    def without(self, rows: DataFrame, done: list[Term], t: Term) -> DataFrame:
        """``rows`` that have no edge for the negated term."""
        ends = {t.src: SRC, t.dst: DST}
        e = self.edges.where(F.col(SRC) == F.col(DST)) if t.src == t.dst else self.edges
        right = e.select(*[F.col(end).alias(_at(name)) for name, end in ends.items()]).distinct()
        return self._one_each(rows, done, right, [_at(name) for name in ends], "left_anti")[0]

    def _hashed(self) -> bool:
        """Whether a task's share of the edges is held as a table, so that the matches, which are many more,
        are not sorted (and spilled) to meet them. Edges that may be broadcast are left to Spark."""
        return (not fits_broadcast(self.spark, self.m, 16)
                and self.m <= HASHED_ROWS * shuffle_partitions(self.spark))

    def _one_each(self, rows, done, right, keys, how):
        """Join with at most one row of ``right`` for a key; also ``rows`` as they were read."""
        if self.most ** len(done) <= self.least:
            if how == "left_anti" and self._hashed():
                right = right.hint("shuffle_hash")
            return rows.join(right, keys, how), rows
        rows, _ = self.cutter.cut(rows, reliable=True)
        hot = self._hot(keys, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("nl")),
                        right.select(*keys, F.lit(1).cast("long").alias("nr")))
        return join_in_cells(rows, right, keys, hot, how), rows

    def attach(self, rows: DataFrame, done: list[Term], names: list[str]) -> DataFrame:
        """The struct of its vertex in place of each id."""
        columns = self.vertices.columns
        kind = self.vertices.schema[ID].dataType
        for n in names:
            if columns == [ID]:
                rows = rows.withColumn(_at(n), F.struct(F.col(_at(n)).cast(kind).alias(ID)))
                continue
            found = self.vertices.select(F.col(ID).alias(_at(n)), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_v"))
            rows = (self._one_each(rows, done, found, [_at(n)], "inner")[0]
                    .drop(_at(n)).withColumnRenamed("_v", _at(n)))
        return rows


def find(g: Graph, pattern: str) -> DataFrame:
    """Rows of matches; one struct column per name, in order of first use."""
    terms = parse(pattern)
    positive = [t for t in terms if not t.negated]
    steps = [t for t in positive if not t.vertex_only]
    names = list(dict.fromkeys(n for t in terms for n in (t.src, t.edge, t.dst) if n))
    vnames = {n for t in terms for n in (t.src, t.dst) if n}
    enames = {t.edge for t in terms if t.edge}
    if vnames & enames:
        raise ValueError(f"names used for both vertices and edges: {vnames & enames}")
    bound = {n for t in positive for n in (t.src, t.dst) if n}
    for t in terms:
        if t.negated and not (t.src in bound and t.dst in bound):
            raise ValueError(f"negated term needs vertices named by positive terms: {t}")
    alone = bound - {n for t in steps for n in (t.src, t.dst)}
    if len(alone) > 1 or alone and steps or not positive:
        raise ValueError("motif has disconnected parts (would be a cross product)")
    if steps:  # raises before any job
        term_order(steps, 1, 1, dict.fromkeys(((p, q) for p in "io" for q in "io"), 1.0))

    cutter = StepCutter()
    try:
        search = _Matcher(cutter, g, bool(enames))
        role: dict[str, str] = {}
        done: list[Term] = []
        rows = None if steps else search.vertices.select(F.col(ID).alias(_at(*alone)))
        for t in term_order(steps, search.m, search.loops, search.products) if steps else []:
            rows = search.table(t) if rows is None else search.join(rows, done, t, role)
            done.append(t)
            for name, kind in ((t.src, "o"), (t.dst, "i")):
                if name:
                    role.setdefault(name, kind)
        for t in terms:
            if t.negated:
                rows = search.without(rows, done, t)
        rows = search.attach(rows, done, [n for n in names if n in vnames])
        return rows.select(*[F.col(_at(n)).alias(n) for n in names])
    finally:
        cutter.close()
