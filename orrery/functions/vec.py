"""Column expressions over array<double> vectors. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as it when a vector is divided by its norm.
EPS_NORM = 1e-12
#: Ten times the double-precision epsilon: smaller scales count as 1.
EPS_SCALE = 10 * 2.220446049250313e-16


def col(v: str | Column) -> Column:
    return F.col(v) if isinstance(v, str) else v


def lit(values: Sequence[float] | np.ndarray) -> Column:
    """A vector (or a list of rows) as a literal array of doubles."""
    a = np.asarray(values, dtype=float)
    if a.ndim == 2:
        return F.array(*[lit(r) for r in a]) if len(a) else F.expr("cast(array() as array<array<double>>)")
    return F.array(*[F.lit(float(x)) for x in a]) if len(a) else F.expr("cast(array() as array<double>)")


def as_double(v: str | Column) -> Column:
    return col(v).cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, where an expression would be computed again for each use or element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: str | Column) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def add(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def sub(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def mul(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x * y)


def div(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: F.try_divide(x, y))


def scale(v: str | Column, by: float | Column) -> Column:
    if isinstance(by, (int, float)):
        return F.transform(col(v), lambda x: x * F.lit(float(by)))
    return let(by, lambda b: F.transform(col(v), lambda x: x * b))


def norm(v: str | Column, p: float = 2) -> Column:
    if p == 2:
        return F.sqrt(total(F.transform(col(v), lambda x: x * x)))
    if p == 1:
        return total(F.transform(col(v), F.abs))
    if p == float("inf"):
        return F.array_max(F.transform(col(v), F.abs))
    return F.pow(total(F.transform(col(v), lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(1.0 / p))


def normalize(v: str | Column, p: float = 2) -> Column:
    """v divided by its p-norm, by EPS_NORM where that is smaller."""
    return let(col(v), lambda w: let(F.greatest(norm(w, p), F.lit(EPS_NORM)), lambda n: F.transform(w, lambda x: x / n)))


def l2_squared(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)))


def lp_distance(a: str | Column, b: str | Column, p: float) -> Column:
    return norm(sub(a, b), p)


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(normalize(a), normalize(b))


def angular(a: str | Column, b: str | Column) -> Column:
    """Angle over pi, the cosine clamped to [-1, 1]."""
    return F.acos(F.least(F.greatest(cosine(a, b), F.lit(-1.0)), F.lit(1.0))) / F.lit(np.pi)


def matvec(v: str | Column, matrix: np.ndarray) -> Column:
    """The row vector v times a small matrix (rows: v's dimensions)."""
    return let(col(v), lambda w: F.transform(lit(np.asarray(matrix, float).T), lambda r: dot(w, r)))


def permute(v: str | Column, permutation: Sequence[int]) -> Column:
    """out[j] = v[permutation[j]]."""
    return let(col(v), lambda w: F.transform(F.array(*[F.lit(int(i)) for i in permutation]), lambda i: F.get(w, i)))


def pad(v: str | Column, width: int) -> Column:
    """v followed by zeros up to `width`."""
    return F.concat(col(v), F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(col(v)), F.lit(0))))


def head(v: str | Column, width: int) -> Column:
    return F.slice(col(v), 1, width)


def argmax(v: str | Column) -> Column:
    """0-based place of the first greatest element."""
    return (F.array_position(col(v), F.array_max(col(v))) - 1).cast("int")


def close(a: str | Column, b: str | Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Elementwise |a - b| <= atol + rtol * |b| for arrays of one length."""
    same = F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y))
    return (F.size(col(a)) == F.size(col(b))) & F.coalesce(F.forall(same, lambda x: x), F.lit(False))


def rounded(v: str | Column, digits: int = 6) -> Column:
    return F.transform(col(v), lambda x: F.round(x, digits))
