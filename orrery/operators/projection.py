"""Relative projections: each vector described by its relation to a set of anchors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import vec
from orrery.operators.transforms import Transform

#: A projection takes the vector column and the anchor matrix and gives an array with one number per anchor.
Projection = Callable[..., Column]
PROJECTIONS: dict[str, Projection] = {}

#: Anchors beyond this many are refused: they are literals of the plan.
MOST_ANCHORS = 4096


def projection_fn(name: str) -> Callable[[Projection], Projection]:
    """Register a projection under a name of its own."""

    def register(fn: Projection) -> Projection:
        if name in PROJECTIONS:
            raise ValueError(f"projection {name!r} exists")
        PROJECTIONS[name] = fn
        return fn

    return register


def _each(v: Column, anchors: np.ndarray, relation: Callable[[Column, Column], Column]) -> Column:
    return vec.let(v, lambda w: F.transform(vec.lit(anchors), lambda a: relation(w, a)))


def _unit(anchors: np.ndarray) -> np.ndarray:
    return anchors / np.maximum(np.linalg.norm(anchors, axis=1, keepdims=True), vec.EPS_NORM)


@projection_fn("CoB")
def change_of_basis(v: Column, anchors: np.ndarray) -> Column:
    """Coefficients of v in the anchors, of least norm where they are not unique: v times the anchors' pseudo-inverse."""
    return vec.matvec(v, np.linalg.pinv(anchors))


@projection_fn("cosine")
def cosine(v: Column, anchors: np.ndarray) -> Column:
    unit = vec.normalize(v)
    return _each(unit, _unit(anchors), vec.dot)


@projection_fn("angular")
def angular(v: Column, anchors: np.ndarray) -> Column:
    return F.transform(cosine(v, anchors), lambda c: F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))) / F.lit(np.pi))


@projection_fn("lp")
def lp(v: Column, anchors: np.ndarray, p: float = 2) -> Column:
    return _each(v, anchors, lambda x, a: vec.lp_distance(x, a, p))


@projection_fn("euclidean")
def euclidean(v: Column, anchors: np.ndarray) -> Column:
    return _each(v, anchors, lambda x, a: F.sqrt(vec.l2_squared(x, a)))


@projection_fn("l1")
def l1(v: Column, anchors: np.ndarray) -> Column:
    return lp(v, anchors, 1)


def pointwise(func: Callable[[np.ndarray, np.ndarray], float]) -> Projection:
    """A projection from a plain function of two vectors, called for every pair of row and anchor. The slow way: use it for
    functions that no column expression gives."""

    def project(v: Column, anchors: np.ndarray) -> Column:
        @F.pandas_udf("array<double>")
        def each(rows: pd.Series) -> pd.Series:
            return rows.map(lambda r: None if r is None else [float(func(np.asarray(r, float), a)) for a in anchors])

        return each(v)

    return project


def collect_anchors(df: DataFrame, vector: str = "vector", order: str = "offset") -> np.ndarray:
    """The anchor matrix in the order of a column. Anchors are literals of the plan, so their number is checked."""
    rows = df.select(order, vec.as_double(vector).alias("v")).orderBy(order).limit(MOST_ANCHORS + 1).collect()
    if len(rows) > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors")
    return np.array([r.v for r in rows], float)


def relative_projection(df: DataFrame, anchors: DataFrame | np.ndarray, projection: str | Projection = "cosine", vector: str = "vector", out: str | None = None, **params) -> DataFrame:
    """`df` with `out` (or the vector itself) as its projection: narrow, anchors go into the plan."""
    matrix = anchors if isinstance(anchors, np.ndarray) else collect_anchors(anchors, vector)
    fn = PROJECTIONS[projection] if isinstance(projection, str) else projection
    return df.withColumn(out or vector, fn(vec.as_double(vector), matrix, **params))


class RelativeProjection(Transform):
    """fit takes the anchors: the absolute transform is fitted on and applied to them, the relative one is fitted on the
    anchors projected on themselves. transform: absolute transform, projection, relative transform."""

    name, invertible = "relative_projection", False

    def __init__(self, projection: str | Projection = "cosine", abs_transform: Transform | None = None, rel_transform: Transform | None = None, order: str = "offset", **params) -> None:
        super().__init__()
        self.projection, self.abs_transform, self.rel_transform, self.order, self.params = projection, abs_transform, rel_transform, order, params

    def _fit(self, df, vector):
        if self.abs_transform:
            df = self.abs_transform.fit_transform(df, vector)
        anchors = collect_anchors(df, vector, self.order)
        if self.rel_transform:
            self.rel_transform.fit(relative_projection(df, anchors, self.projection, vector, **self.params), vector)
        return {"anchors": anchors}

    def transform(self, df, vector="vector", out=None):
        anchors = self._ready()["anchors"]
        target = out or vector
        df = df.withColumn(target, vec.as_double(vector))
        if self.abs_transform:
            df = self.abs_transform.transform(df, target)
        df = relative_projection(df, anchors, self.projection, target, **self.params)
        return self.rel_transform.transform(df, target) if self.rel_transform else df
