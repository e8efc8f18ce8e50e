"""Alignment of one vector space to another: rows are paired by an equi-join on their identity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import vec
from orrery.functions.ranking import hash_order, spread_rank
from orrery.operators.kernels import apply_matrix, least_squares, moments
from orrery.operators.transforms import StandardScaling, Transform


def pair(x: DataFrame, y: DataFrame, vector: str = "vector", on: str = "offset") -> DataFrame:
    """(on, x, y): rows of both frames with the same identity."""
    return x.select(on, vec.as_double(vector).alias("x")).join(y.select(on, vec.as_double(vector).alias("y")), on)


def svd_align_state(pairs: DataFrame) -> dict:
    """The orthogonal matrix that brings x closest to y: U V' of the SVD of X'Y."""
    m = moments(pairs, "x", "y")
    if m.split * 2 != len(m.mean):
        raise ValueError("both spaces must have one width; use ZeroPadding")
    u, _, v = np.linalg.svd(m.raw("x", "y"), full_matrices=False)
    return {"matrix": u @ v}


def lstsq_align_state(pairs: DataFrame) -> dict:
    return {"matrix": least_squares(pairs, "x", "y")}


def lstsq_ortho_align_state(pairs: DataFrame) -> dict:
    """The orthogonal part of the least-squares map; rectangular for spaces of two widths."""
    u, _, v = np.linalg.svd(least_squares(pairs, "x", "y"), full_matrices=False)
    return {"matrix": u @ v}


def sgd_affine_align_state(pairs: DataFrame, num_steps: int = 300, lr: float = 1e-3, random_seed: int = 0) -> dict:
    """An affine map by full-batch Adam on the mean squared error. The gradient needs only the moments of the pairs, so the
    data are read once and the steps run on small matrices. Starts from uniform weights within 1 / sqrt(width)."""
    m = moments(pairs, "x", "y")
    dx, dy = m.split, len(m.mean) - m.split
    rng = np.random.default_rng(random_seed)
    w = np.vstack([rng.uniform(-1, 1, (dx, dy)), rng.uniform(-1, 1, (1, dy))]) / np.sqrt(dx)
    top = np.hstack([m.raw("x", "x"), m.n * m.x_mean[:, None]])
    gram = np.vstack([top, np.append(m.n * m.x_mean, m.n)])
    cross = np.vstack([m.raw("x", "y"), m.n * m.y_mean])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, num_steps + 1):
        gradient = 2 * (gram @ w - cross) / (m.n * dy)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w = w - lr * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return {"matrix": w[:-1], "bias": w[-1]}


ALIGNERS: dict[str, Callable[..., dict]] = {"svd": svd_align_state, "lstsq": lstsq_align_state, "lstsq_ortho": lstsq_ortho_align_state, "sgd_affine": sgd_affine_align_state}


class MatrixAligner:
    """Fits any state function (pairs) -> {"matrix"[, "bias"]} and maps x vectors by it."""

    def __init__(self, name: str, state_fn: Callable[..., dict] | None = None, **params) -> None:
        self.name, self.state_fn, self.params = name, state_fn or ALIGNERS[name], params
        self.state: dict | None = None

    def fit(self, x: DataFrame, y: DataFrame, vector: str = "vector", on: str = "offset") -> MatrixAligner:
        return self.fit_pairs(pair(x, y, vector, on))

    def fit_pairs(self, pairs: DataFrame) -> MatrixAligner:
        self.state = self.state_fn(pairs, **self.params)
        return self

    def transform(self, x: DataFrame, vector: str = "vector", out: str | None = None) -> DataFrame:
        if self.state is None:
            raise RuntimeError(f"{self.name} is not fitted")
        return apply_matrix(x, vector, self.state["matrix"], self.state.get("bias"), out)

    def inverse_transform(self, *_, **__):
        raise NotImplementedError("aligners map one way")


class SGDAffineAligner(MatrixAligner):
    def __init__(self, num_steps: int = 300, lr: float = 1e-3, random_seed: int = 0) -> None:
        super().__init__("sgd_affine", num_steps=num_steps, lr=lr, random_seed=random_seed)


class ZeroPadding:
    """Brings two spaces to one width with zeros at the end; either side may be missing."""

    def __init__(self) -> None:
        self.x_dim: int | None = None
        self.y_dim: int | None = None

    def fit(self, x_dim: int, y_dim: int) -> ZeroPadding:
        self.x_dim, self.y_dim = x_dim, y_dim
        return self

    @property
    def width(self) -> int:
        if self.x_dim is None:
            raise RuntimeError("zero padding is not fitted")
        return max(self.x_dim, self.y_dim)

    def transform(self, x: DataFrame | None = None, y: DataFrame | None = None, vector: str = "vector"):
        widen = lambda d: None if d is None else d.withColumn(vector, vec.pad(vec.as_double(vector), self.width))
        return widen(x), widen(y)

    def inverse_transform(self, x: DataFrame | None = None, y: DataFrame | None = None, vector: str = "vector"):
        trim = lambda d, n: None if d is None else d.withColumn(vector, vec.head(vector, n))
        return trim(x, self.x_dim), trim(y, self.y_dim)


def unpaired(x: DataFrame, y: DataFrame, seed: int = 0, on: str = "offset") -> tuple[DataFrame, DataFrame]:
    """Both spaces for an estimator that must not rely on pairs: the offsets of x are those of a random order (of their md5)."""
    ranked = spread_rank(x.withColumn("__at", hash_order(seed, on)), [], "__at", "__n", [on])
    return ranked.withColumn(on, (F.col("__n") - 1).cast("long")).drop("__at", "__n"), y


class Translator:
    """x to y: both sides are normalised, padded and aligned; what comes out is cut to y's width and y's normalisation undone."""

    def __init__(self, aligner: MatrixAligner, x_transform: Transform | None = None, y_transform: Transform | None = None, dim_matcher: ZeroPadding | None = None, name: str | None = None) -> None:
        self.aligner, self.x_transform, self.y_transform, self.dim_matcher = aligner, x_transform, y_transform, dim_matcher
        self.name = name or f"translator_{aligner.name}"

    def fit(self, x: DataFrame, y: DataFrame, vector: str = "vector", on: str = "offset") -> Translator:
        if self.x_transform:
            x = self.x_transform.fit_transform(x, vector)
        if self.y_transform:
            y = self.y_transform.fit_transform(y, vector)
        if self.dim_matcher:
            size = lambda d: d.select(F.size(vector)).where(F.col(vector).isNotNull()).first()[0]
            x, y = self.dim_matcher.fit(size(x), size(y)).transform(x, y, vector)
        self.aligner.fit(x, y, vector, on)
        return self

    def transform(self, x: DataFrame, vector: str = "vector", out: str | None = None) -> DataFrame:
        target = out or vector
        x = x.withColumn(target, vec.as_double(vector))
        if self.x_transform:
            x = self.x_transform.transform(x, target)
        if self.dim_matcher:
            x, _ = self.dim_matcher.transform(x=x, vector=target)
        x = self.aligner.transform(x, target)
        if self.dim_matcher:
            _, x = self.dim_matcher.inverse_transform(y=x, vector=target)
        return self.y_transform.inverse_transform(x, target) if self.y_transform and self.y_transform.invertible else x

    translate = transform


def procrustes() -> Translator:
    """Both spaces standardised, padded to one width and aligned by the best orthogonal matrix."""
    return Translator(MatrixAligner("svd"), StandardScaling(), StandardScaling(), ZeroPadding(), name="procrustes")


def translate(x: DataFrame, y: DataFrame, aligner: str = "svd", vector: str = "vector", on: str = "offset") -> DataFrame:
    """Fit an aligner on the paired rows of x and y and give x in y's coordinates."""
    return Translator(MatrixAligner(aligner), dim_matcher=ZeroPadding() if aligner == "svd" else None).fit(x, y, vector, on).transform(x, vector)
