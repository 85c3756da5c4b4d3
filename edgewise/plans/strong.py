"""Strongly connected components of edges that come in closed parts, each small enough for one task.

A part holds whole components: no edge that matters leaves it. Parts of at most ``PART`` edges are
dealt to tasks, and a task finds the components of a few parts at a time (at most ``PART`` edges
more than it was given in a batch), by Tarjan's algorithm without recursion.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ship the task functions by value: executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART = 1 << 16  # most edges of a part that one task takes


def components(n: int, src: np.ndarray, dst: np.ndarray) -> list[int]:
    """The number of each vertex's component, for vertices 0 to ``n`` - 1."""
    order = np.argsort(src, kind="stable")
    to = dst[order].tolist()
    first = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    seen, low, comp, at = [0] * n, [0] * n, [-1] * n, first[:n]
    stack: list[int] = []
    clock = found = 0
    for root in range(n):
        if seen[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not seen[v]:
                clock += 1
                seen[v] = low[v] = clock
                stack.append(v)
            down = False
            end = first[v + 1]
            while at[v] < end:
                w = to[at[v]]
                at[v] += 1
                if not seen[w]:
                    path.append(w)
                    down = True
                    break
                if comp[w] < 0:
                    low[v] = min(low[v], seen[w])
            if down:
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                while True:
                    w = stack.pop()
                    comp[w] = found
                    if w == v:
                        break
                found += 1
    return comp


def named(src: pa.Array, dst: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(ids, the smallest id of each one's component) of the ends of edges."""
    ends = pa.chunked_array([src, dst]).combine_chunks().dictionary_encode()
    ids, codes = ends.dictionary, ends.indices.to_numpy()
    n = len(ids)
    rank = np.empty(n, np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(n)
    comp = np.array(components(n, codes[:len(src)], codes[len(src):]))
    # vertices by component, then by id: the first of a component names it
    order = np.lexsort((rank, comp))
    heads = np.append(True, comp[order][1:] != comp[order][:-1])
    name = np.empty(n, np.int64)
    name[order] = order[heads][np.cumsum(heads) - 1]
    return ids, ids.take(pa.array(name))


def in_parts(edges: DataFrame, src: str, dst: str, part: list[str], id_: str, name: str) -> DataFrame:
    """(``id_``, ``name``): the smallest id of the component of each end of ``edges``; columns ``part`` say which part."""
    kind = edges.schema[src].dataType
    schema = T.StructType([T.StructField(id_, kind), T.StructField(name, kind)])
    rows = edges.select(src, dst, *part).repartition(*part).sortWithinPartitions(*part)

    def send(held: pa.Table) -> Iterator[pa.RecordBatch]:
        if held.num_rows:
            found = named(held.column(0).combine_chunks(), held.column(1).combine_chunks())
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in found],
                                             names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows >= PART:
                # up to the last row that begins a part
                here = [pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)) for x in batch.columns[2:]]
                last = batch.slice(0, 1).to_pylist()[0]
                before = held[-1].slice(held[-1].num_rows - 1).to_pylist()[0]
                begins = [0] if any(last[c] != before[c] for c in part) else []
                changed = here[0]
                for x in here[1:]:
                    changed = pc.or_(changed, x)
                begins += [int(i) + 1 for i in np.flatnonzero(changed.to_numpy(zero_copy_only=False))]
                if begins:
                    yield from send(pa.Table.from_batches([*held, batch.slice(0, begins[-1])]))
                    batch, held, rows = batch.slice(begins[-1]), [], 0
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield from send(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)
