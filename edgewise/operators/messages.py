"""Message aggregation and Pregel-style supersteps.

Message expressions read the triplet columns ``src``, ``dst`` and ``edge``
(structs holding every vertex / edge column); aggregations read ``msg``.
NULL messages are dropped, and vertices that receive none are omitted from
``aggregate_messages``.  Any Spark aggregate works, and all of them run as
hash aggregates with map-side partial combine, so a vertex with millions of
in-edges is reduced inside every task before the shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import DST, ID, SRC, Graph
from ..plans.iterate import StepCutter
from ..plans.skew import KeyedEdges, join_hub_safe
from .structure import triplets

MSG = "msg"


def _c(x) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def _messages(t: DataFrame, send_to_src, send_to_dst) -> DataFrame:
    parts = []
    if send_to_dst is not None:
        parts.append(t.select(F.col("dst.id").alias(ID), _c(send_to_dst).alias(MSG)))
    if send_to_src is not None:
        parts.append(t.select(F.col("src.id").alias(ID), _c(send_to_src).alias(MSG)))
    if not parts:
        raise ValueError("give send_to_src and/or send_to_dst")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col(MSG).isNotNull())


def aggregate_messages(g: Graph, *aggs: Column, send_to_src=None, send_to_dst=None) -> DataFrame:
    """``id`` plus one column per aggregate of the messages a vertex received."""
    if not aggs:
        raise ValueError("give at least one aggregate over F.col('msg')")
    return _messages(triplets(g), send_to_src, send_to_dst).groupBy(ID).agg(*aggs)


class Pregel:
    """Synchronous supersteps over vertex columns.

    ``with_vertex_column(name, initial, update)``: ``update`` may read the
    column's current value and ``Pregel.msg()`` (NULL when no message
    arrived).  Messages are sent along edges with ``send_msg_to_src`` /
    ``send_msg_to_dst`` and combined with ``agg_msgs``.  Runs ``max_iter``
    supersteps, checkpointing the vertex state every ``checkpoint_interval``
    steps.  All updates of a step read the values of the previous step.

    The edges are laid out once by the end that the message expression reads
    (``reads``), with hub ids split, so that a superstep moves vertex rows and
    messages only; an end that no expression reads is not joined, and of the
    other one only the columns that are read travel.  ``set_active(expr)`` (over
    vertex columns) lets only vertices send for which it holds, and ends the
    loop once it holds for none.
    """

    def __init__(self, graph: Graph):
        self.graph = graph
        self._max_iter = 10
        self._interval = 2
        self._cols: list[tuple[str, Column, Column]] = []
        self._to_src = None
        self._to_dst = None
        self._agg = None
        self._active: Column | None = None

    # -- expression helpers ----------------------------------------------------
    @staticmethod
    def msg() -> Column:
        return F.col("_pregel_msg")

    @staticmethod
    def src(name: str) -> Column:
        return F.col(f"src.{name}")

    @staticmethod
    def dst(name: str) -> Column:
        return F.col(f"dst.{name}")

    @staticmethod
    def edge(name: str) -> Column:
        return F.col(f"edge.{name}")

    # -- builder -------------------------------------------------------------------
    def set_max_iter(self, n: int) -> "Pregel":
        self._max_iter = int(n)
        return self

    def set_checkpoint_interval(self, n: int) -> "Pregel":
        self._interval = int(n)
        return self

    def with_vertex_column(self, name: str, initial, update) -> "Pregel":
        self._cols.append((name, _c(initial), _c(update)))
        return self

    def send_msg_to_src(self, expr) -> "Pregel":
        self._to_src = _c(expr)
        return self

    def send_msg_to_dst(self, expr) -> "Pregel":
        self._to_dst = _c(expr)
        return self

    def agg_msgs(self, agg) -> "Pregel":
        self._agg = _c(agg)
        return self

    def set_active(self, expr) -> "Pregel":
        self._active = _c(expr)
        return self

    # camelCase aliases for users of the JVM-style API
    setMaxIter = set_max_iter
    setCheckpointInterval = set_checkpoint_interval
    withVertexColumn = with_vertex_column
    sendMsgToSrc = send_msg_to_src
    sendMsgToDst = send_msg_to_dst
    aggMsgs = agg_msgs

    def run(self) -> DataFrame:
        if not self._cols or self._agg is None:
            raise ValueError("need with_vertex_column(...) and agg_msgs(...)")
        g = self.graph
        cutter = StepCutter(self._interval)
        try:
            state = g.vertices
            for name, init, _ in self._cols:
                state = state.withColumn(name, init)
            state, m = cutter.cut(state, {"n": F.count(F.lit(1))}, reliable=True)
            sent = _Sender(cutter, g, state, m["n"], self._to_src, self._to_dst, self._active)
            for _ in range(self._max_iter):
                msgs = sent.messages(state).groupBy(ID).agg(self._agg.alias("_pregel_msg"))
                new = state.join(msgs, ID, "left")
                names = {c[0] for c in self._cols}
                new = new.select(*[F.col(c) for c in state.columns if c not in names],
                                 *[update.alias(name) for name, _, update in self._cols])
                active = {} if self._active is None else {"active": F.count_if(self._active)}
                state, seen = cutter.cut(new, active or None, reliable=True)
                if active and not seen["active"]:
                    break
            return state
        finally:
            cutter.close()


def reads(expr: Column | None, end: str, columns: list[str]) -> list[str]:
    """The columns of ``end`` ("src" or "dst") that a message expression reads; all where it takes the struct whole.

    Read off the expression's text: a name that only looks like the end costs a join, nothing else.
    """
    if expr is None:
        return []
    text = str(expr)
    dotted = re.findall(rf"\b{end}\b[`]?(?:\.[`]?(\w+))?", text)
    return list(columns) if any(c not in columns for c in dotted) else list(dict.fromkeys(dotted))


class _Sender:
    """Edges laid out for the messages of a Pregel loop."""

    def __init__(self, cutter: StepCutter, g: Graph, state: DataFrame, n: int, to_src, to_dst, active):
        self.parts = [(expr, to) for expr, to in ((to_dst, "dst"), (to_src, "src")) if expr is not None]
        if not self.parts:
            raise ValueError("give send_msg_to_src and/or send_msg_to_dst")
        self.active = active
        ids = state.select(F.col(ID).alias("_es"))
        e = g.edges.select(F.col(SRC).alias("_es"), F.col(DST).alias("_ed"), F.struct(*g.edges.columns).alias("edge"))
        if not any(reads(expr, "edge", g.edges.columns) for expr, _ in self.parts):
            e = e.drop("edge")
        # as with triplets, both ends are vertices: tested once, not in every step
        e, total = cutter.inputs(e)
        e = join_hub_safe(join_hub_safe(e, "_es", ids, total), "_ed", ids.withColumnRenamed("_es", "_ed"), total)
        self.edges, total = cutter.inputs(e)
        self.layouts = {end: KeyedEdges(self.edges, key, other, cutter=cutter, total_edges=total, vertex_count=n).persist(cutter)
                        for end, key, other in (("src", "_es", "_ed"), ("dst", "_ed", "_es"))
                        if any(self._needs(expr, to, end, state.columns) for expr, to in self.parts)}

    def _needs(self, expr, to: str, end: str, columns: list[str]) -> list[str]:
        """Columns of an end that a message takes; the sender's id at least, where only active ones send."""
        found = reads(expr, end, columns)
        return found or ([ID] if self.active is not None and end != to else [])

    def messages(self, state: DataFrame) -> DataFrame:
        out = None
        for expr, to in self.parts:
            rows = self.edges
            for k, end in enumerate(e for e in ("src", "dst") if self._needs(expr, to, e, state.columns)):
                cols = self._needs(expr, to, end, state.columns)
                who = state.where(self.active) if self.active is not None and end != to else state
                values = who.select(F.col(ID).alias("_v"), F.struct(*cols).alias(end))
                layout = self.layouts[end] if not k else self.layouts[end].with_rows(rows)
                rows = layout.attach(values, "_v")
            part = rows.select(F.col("_ed" if to == "dst" else "_es").alias(ID), expr.alias("_pregel_msg"))
            out = part if out is None else out.unionByName(part)
        return out.where(F.col("_pregel_msg").isNotNull())
