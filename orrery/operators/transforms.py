"""Fitted, invertible transforms of vector columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import vec
from orrery.operators.kernels import apply_matrix, moments

State = dict[str, Any]


# -- states: aggregates over all rows, small results ------------------------------------------------------------------------


def centering_state(df: DataFrame, vector: str = "vector") -> State:
    return {"shift": moments(df, vector).mean}


def handle_zeros(scale: np.ndarray) -> np.ndarray:
    """Scales of (nearly) constant dimensions become 1; NaN stays NaN."""
    scale = np.asarray(scale, float)
    return np.where(scale < vec.EPS_SCALE, 1.0, scale)


def std_scaling_state(df: DataFrame, vector: str = "vector") -> State:
    return {"scale": handle_zeros(moments(df, vector).std())}


def standard_scaling_state(df: DataFrame, vector: str = "vector") -> State:
    m = moments(df, vector)
    return {"shift": m.mean, "scale": handle_zeros(m.std())}


def mean_norm_state(df: DataFrame, vector: str = "vector", p: float = 2) -> State:
    return {"mean_norm": df.agg(F.avg(vec.norm(vec.as_double(vector), p))).first()[0]}


def dim_of(df: DataFrame, vector: str = "vector") -> int:
    row = df.select(F.size(vector)).where(F.col(vector).isNotNull()).first()
    if row is None:
        raise ValueError("an empty frame has no dimension")
    return row[0]


def random_permutation_state(df: DataFrame, vector: str = "vector", random_seed: int = 0) -> State:
    return {"permutation": np.random.default_rng(random_seed).permutation(dim_of(df, vector))}


def random_isometry_state(df: DataFrame, vector: str = "vector", random_seed: int = 0) -> State:
    """A rotation drawn evenly from all orthogonal matrices: QR of a Gaussian matrix with the signs of R's diagonal fixed."""
    d = dim_of(df, vector)
    q, r = np.linalg.qr(np.random.default_rng(random_seed).standard_normal((d, d)))
    return {"matrix": q * np.sign(np.diag(r))}


# -- row functions: (vector column, state) -> column ------------------------------------------------------------------------


def centering(v: Column, shift) -> Column:
    return vec.sub(v, vec.lit(shift))


def centering_inverse(v: Column, shift) -> Column:
    return vec.add(v, vec.lit(shift))


def std_scaling(v: Column, scale) -> Column:
    return vec.div(v, vec.lit(scale))


def std_scaling_inverse(v: Column, scale) -> Column:
    return vec.mul(v, vec.lit(scale))


def standard_scaling(v: Column, shift, scale) -> Column:
    return std_scaling(centering(v, shift), scale)


def standard_scaling_inverse(v: Column, shift, scale) -> Column:
    return centering_inverse(std_scaling_inverse(v, scale), shift)


def lp_normalize(v: Column, p: float = 2) -> Column:
    return vec.normalize(v, p)


def isotropic_scaling(v: Column, scale: float) -> Column:
    return vec.scale(v, scale)


def isotropic_scaling_inverse(v: Column, scale: float) -> Column:
    return vec.scale(v, 1 / scale)


def dimension_permutation(v: Column, permutation) -> Column:
    return vec.permute(v, permutation)


def dimension_permutation_inverse(v: Column, permutation) -> Column:
    return vec.permute(v, np.argsort(permutation))


def isometry(v: Column, matrix) -> Column:
    return vec.matvec(v, matrix)


def isometry_inverse(v: Column, matrix) -> Column:
    return vec.matvec(v, np.asarray(matrix).T)


# -- transforms -------------------------------------------------------------------------------------------------------------


class Transform:
    """fit learns a state from a frame, transform and inverse_transform map its vector column. All columns and rows stay."""

    name = "transform"
    invertible = True
    stateless = False

    def __init__(self) -> None:
        self.state: State | None = {} if self.stateless else None

    def _fit(self, df: DataFrame, vector: str) -> State:
        return {}

    def _forward(self, v: Column) -> Column:
        return v

    def _backward(self, v: Column) -> Column:
        return v

    def fit(self, df: DataFrame, vector: str = "vector") -> Transform:
        self.state = self._fit(df, vector)
        return self

    def _ready(self) -> State:
        if self.state is None:
            raise RuntimeError(f"{self.name} is not fitted")
        return self.state

    def get_state(self) -> State:
        return dict(self._ready())

    def transform(self, df: DataFrame, vector: str = "vector", out: str | None = None) -> DataFrame:
        self._ready()
        return df.withColumn(out or vector, self._forward(vec.as_double(vector)))

    def inverse_transform(self, df: DataFrame, vector: str = "vector", out: str | None = None) -> DataFrame:
        if not self.invertible:
            raise ValueError(f"{self.name} is not invertible")
        self._ready()
        return df.withColumn(out or vector, self._backward(vec.as_double(vector)))

    def fit_transform(self, df: DataFrame, vector: str = "vector", out: str | None = None) -> DataFrame:
        return self.fit(df, vector).transform(df, vector, out)

    def __call__(self, df: DataFrame, vector: str = "vector", inverse: bool = False) -> DataFrame:
        return self.inverse_transform(df, vector) if inverse else self.transform(df, vector)


class SimpleTransform(Transform):
    """Adapter of a row function, with an optional state function and inverse; `params` are passed to all of them."""

    def __init__(self, transform_fn: Callable[..., Column], state_fn: Callable[..., State] | None = None, inverse_fn: Callable[..., Column] | None = None, name: str | None = None, **params: Any) -> None:
        self.transform_fn, self.state_fn, self.inverse_fn, self.params = transform_fn, state_fn, inverse_fn, params
        self.name = name or transform_fn.__name__
        self.invertible, self.stateless = inverse_fn is not None, state_fn is None
        super().__init__()

    def _fit(self, df, vector):
        return self.state_fn(df, vector) if self.state_fn else {}

    def _forward(self, v):
        return self.transform_fn(v, **self.state, **self.params)

    def _backward(self, v):
        return self.inverse_fn(v, **self.state, **self.params)


class Identity(Transform):
    name, stateless = "identity", True


class Centering(Transform):
    name = "centering"

    def _fit(self, df, vector):
        return centering_state(df, vector)

    def _forward(self, v):
        return centering(v, **self.state)

    def _backward(self, v):
        return centering_inverse(v, **self.state)


class STDScaling(Transform):
    name = "std_scaling"

    def _fit(self, df, vector):
        return std_scaling_state(df, vector)

    def _forward(self, v):
        return std_scaling(v, **self.state)

    def _backward(self, v):
        return std_scaling_inverse(v, **self.state)


class StandardScaling(Transform):
    name = "standard_scaling"

    def _fit(self, df, vector):
        return standard_scaling_state(df, vector)

    def _forward(self, v):
        return standard_scaling(v, **self.state)

    def _backward(self, v):
        return standard_scaling_inverse(v, **self.state)


class LPNorm(Transform):
    name, invertible, stateless = "lp_norm", False, True

    def __init__(self, p: float = 2) -> None:
        super().__init__()
        self.p = p

    def _forward(self, v):
        return lp_normalize(v, self.p)


class MeanLPNorm(Transform):
    """Normalises rows; the inverse multiplies by the mean norm of the fitted rows, which is no true inverse."""

    name = "mean_lp_norm"

    def __init__(self, p: float = 2) -> None:
        super().__init__()
        self.p = p

    def _fit(self, df, vector):
        return mean_norm_state(df, vector, self.p)

    def _forward(self, v):
        return lp_normalize(v, self.p)

    def _backward(self, v):
        return vec.scale(v, self.state["mean_norm"])


class IsotropicScaling(Transform):
    name, stateless = "isotropic_scaling", True

    def __init__(self, scale: float) -> None:
        super().__init__()
        self.scale = scale

    def _forward(self, v):
        return isotropic_scaling(v, self.scale)

    def _backward(self, v):
        return isotropic_scaling_inverse(v, self.scale)


class _Matrix(Transform):
    """A transform by a matrix in the state: a literal expression for small ones, BLAS over Arrow batches for large ones."""

    largest_literal = 32

    def transform(self, df, vector="vector", out=None):
        m = self._ready()["matrix"]
        return super().transform(df, vector, out) if len(m) <= self.largest_literal else apply_matrix(df, vector, m, out=out)

    def inverse_transform(self, df, vector="vector", out=None):
        m = self._ready()["matrix"]
        return super().inverse_transform(df, vector, out) if len(m) <= self.largest_literal else apply_matrix(df, vector, m.T, out=out)


class RandomIsometry(_Matrix):
    name = "random_isometry"

    def __init__(self, random_seed: int = 0) -> None:
        super().__init__()
        self.random_seed = random_seed

    def _fit(self, df, vector):
        return random_isometry_state(df, vector, self.random_seed)

    def _forward(self, v):
        return isometry(v, **self.state)

    def _backward(self, v):
        return isometry_inverse(v, **self.state)


class RandomDimensionPermutation(Transform):
    name = "random_dimension_permutation"

    def __init__(self, random_seed: int = 0) -> None:
        super().__init__()
        self.random_seed = random_seed

    def _fit(self, df, vector):
        return random_permutation_state(df, vector, self.random_seed)

    def _forward(self, v):
        return dimension_permutation(v, **self.state)

    def _backward(self, v):
        return dimension_permutation_inverse(v, **self.state)


class InverseTransform(Transform):
    """Another transform with its directions swapped."""

    def __init__(self, transform: Transform) -> None:
        if not transform.invertible:
            raise ValueError(f"{transform.name} is not invertible")
        self.inner, self.name = transform, f"inverse_{transform.name}"

    state = property(lambda self: self.inner.state, lambda self, value: None)

    def fit(self, df, vector="vector"):
        self.inner.fit(df, vector)
        return self

    def transform(self, df, vector="vector", out=None):
        return self.inner.inverse_transform(df, vector, out)

    def inverse_transform(self, df, vector="vector", out=None):
        return self.inner.transform(df, vector, out)


class TransformSequence(Transform):
    """Transforms one after another: each is fitted on what the ones before give; the inverse runs backwards."""

    name = "sequence"

    def __init__(self, transforms: Sequence[Transform]) -> None:
        self.transforms = list(transforms)

    state = property(lambda self: {i: t.state for i, t in enumerate(self.transforms)}, lambda self, value: None)
    invertible = property(lambda self: all(t.invertible for t in self.transforms))

    def fit(self, df, vector="vector"):
        for t in self.transforms:
            df = t.fit(df, vector).transform(df, vector)
        return self

    def transform(self, df, vector="vector", out=None):
        df = df if out in (None, vector) else df.withColumn(out, F.col(vector))
        for t in self.transforms:
            df = t.transform(df, out or vector)
        return df

    def inverse_transform(self, df, vector="vector", out=None):
        if not self.invertible:
            raise ValueError("the sequence is not invertible")
        df = df if out in (None, vector) else df.withColumn(out, F.col(vector))
        for t in reversed(self.transforms):
            df = t.inverse_transform(df, out or vector)
        return df


#: Transforms by name, as saved indexes refer to them.
NAMED: dict[str, Callable[[Column], Column]] = {"identity": lambda v: v, "l2_normalize": lambda v: lp_normalize(v, 2), "l1_normalize": lambda v: lp_normalize(v, 1)}
