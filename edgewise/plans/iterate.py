"""Superstep driver for iterative graph operators.

Each superstep is one DataFrame plan.  Lineage is cut with a reliable
checkpoint into the session's checkpoint folder (never a local checkpoint:
an executor lost after the step would take the only copy with it).  Between
checkpoints a step is persisted (memory and disk), so a lost block is
recomputed from at most ``interval`` steps of lineage. A plan that reads the
state twice doubles with every step that is not cut, so at most ``MOST_UNCUT``
steps go without, whatever the interval asked for.

Convergence scalars come from ``DataFrame.observe`` on the same job that
materialises the step, so a stop test costs no extra pass over the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import checkpoint_dir


MOST_UNCUT = 4
MOST_PIECES = 8


#: Spark's setting that removes a query's shuffle files when it has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder. The shuffle files of this step go as it ends, so that the steps don't add up on disk."""
    conf = df.sparkSession.conf
    checkpoint_dir(df.sparkSession)
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # select: a plan made under the setting
    finally:
        conf.set(CLEANUP, before)


class StepCutter:
    """Materialises successive supersteps and releases superseded ones."""

    def __init__(self, interval: int = 2):
        self.interval = min(max(int(interval), 1), MOST_UNCUT)
        self._steps: list[DataFrame] = []   # persisted, not yet superseded
        self._inputs: list[DataFrame] = []  # loop invariants
        self._count = 0

    def cut(self, df: DataFrame, metrics: dict[str, Column] | None = None,
            reliable: bool = False) -> tuple[DataFrame, dict]:
        """Materialise ``df``; returns it with the observed ``metrics``.

        Every ``interval``-th step (and every ``reliable`` one) is written to
        the checkpoint folder; the steps in between are persisted.
        """
        self._count += 1
        obs = None
        if metrics:
            obs = Observation(f"step{self._count}")
            df = df.observe(obs, *[c.alias(k) for k, c in metrics.items()])
        if reliable or self._count % self.interval == 0:
            out = written(df)
            for old in self._steps:
                old.unpersist(blocking=False)
            self._steps = []
        else:
            out = df.persist(StorageLevel.MEMORY_AND_DISK)
            out.count()
            self._steps.append(out)
        values = dict(obs.get) if obs is not None else {}
        return out, values

    def inputs(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Checkpoint a loop input once and return it with its row count."""
        out, m = self.cut(df, {"n": F.count(F.lit(1))}, reliable=True)
        return out, int(m["n"])

    def graph_inputs(self, vertices: DataFrame, edges: DataFrame, vertex_cols, edge_cols):
        """Checkpoint a graph's vertex and edge projections with their counts.

        The edge table stays cached while both are materialised: a vertex
        table derived from the edges (``Graph.from_edges``) then reuses the
        cached edges instead of recomputing the edge plan.
        """
        cached = edges.is_cached
        if not cached:
            edges.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # one row per id, so that no result multiplies a vertex listed twice
            v, n = self.inputs(vertices.select(*vertex_cols).where(F.col("id").isNotNull()).dropDuplicates(["id"]))
            e, m = self.inputs(edges.select(*edge_cols))
        finally:
            if not cached:
                edges.unpersist(blocking=False)
        return v, n, e, m

    def keep(self, df: DataFrame) -> DataFrame:
        """Persist a loop-invariant input (edges) for the life of the loop."""
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._inputs.append(out)
        return out

    def release(self, df: DataFrame) -> None:
        """Release one input kept with :meth:`keep` before the loop ends."""
        df.unpersist(blocking=False)
        self._inputs = [d for d in self._inputs if d is not df]

    def close(self, keep=()) -> None:
        """Release every persisted step and input except those in ``keep``
        (the ones a returned, still lazy, result reads)."""
        kept = [d for d in self._steps + self._inputs if any(d is k for k in keep)]
        for d in self._steps + self._inputs:
            if not any(d is k for k in keep):
                d.unpersist(blocking=False)
        self._steps, self._inputs = kept, []


class Pieces:
    """Rows that a loop adds batch by batch, kept in at most ``MOST_PIECES`` written tables.

    A batch is a written table itself.  Past that number the youngest tables, up to the oldest that
    the ones after it outgrew, become one, dealt by ``keys``.  A row is thus rewritten a logarithmic
    number of times, and a step reads a bounded number of tables, whatever the depth.
    """

    def __init__(self, cutter: StepCutter, *keys: str):
        self.cutter, self.keys = cutter, keys
        self.parts: list[tuple[DataFrame, int]] = []

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [df for df, _ in self.parts])

    def add(self, batch: DataFrame, rows: int) -> "Pieces":
        self.parts.append((batch, rows))
        if len(self.parts) > MOST_PIECES:
            sizes = [n for _, n in self.parts]
            at = next((i for i in range(len(sizes) - 1) if sum(sizes[i + 1:]) >= sizes[i]), len(sizes) - 2)
            young = reduce(DataFrame.unionByName, [df for df, _ in self.parts[at:]])
            merged, _ = self.cutter.cut(young.repartition(*self.keys), reliable=True)
            self.parts[at:] = [(merged, sum(sizes[at:]))]
        return self


def materialize(df: DataFrame, metrics: dict[str, Column] | None = None
                ) -> tuple[DataFrame, dict]:
    """One reliable checkpoint with observed scalars."""
    return StepCutter(interval=1).cut(df, metrics)
