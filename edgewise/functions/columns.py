"""Column expressions shared by the operators (all built-in, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def expr(c) -> Column:
    """A Column, or a SQL expression string parsed into one."""
    return F.expr(c) if isinstance(c, str) else c


def undirected(a="src", b="dst") -> list[Column]:
    """The endpoints of an edge ordered (smaller, larger): canonical undirected form."""
    return [F.least(col(a), col(b)), F.greatest(col(a), col(b))]


def array_dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def array_axpy(alpha, x, y) -> Column:
    """alpha * x + y, element-wise, for arrays x and y and a scalar alpha."""
    return F.zip_with(col(x), col(y), lambda u, v: col(alpha) * u + v)


def array_add(x, y) -> Column:
    return F.zip_with(col(x), col(y), lambda u, v: u + v)


def hash_uniform(*cols, bits: int = 30) -> Column:
    """A reproducible value in [0, 1) from a 64-bit hash of the given columns."""
    return F.pmod(F.xxhash64(*[col(c) for c in cols]), F.lit(1 << bits)) / F.lit(float(1 << bits))


def edge_set_fingerprint(x: str, y: str) -> dict[str, Column]:
    """(count, sum of 64-bit hashes) of a set of pairs, for change detection."""
    return {"n": F.count(F.lit(1)),
            "h": F.sum(F.xxhash64(F.col(x), F.col(y)).cast("decimal(38,0)"))}
