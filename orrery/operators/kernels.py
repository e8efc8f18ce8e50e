"""Arrow kernels: moments, least squares and matrix products over partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    """An array column as a dense matrix; rows must have one length and no nulls."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


@dataclass(frozen=True)
class Moments:
    """Count, mean and centred scatter of the joined vectors of one or two columns."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    split: int

    def merge(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.scatter + other.scatter + np.outer(d, d) * (self.n * other.n / n), self.split)

    @staticmethod
    def of(z: np.ndarray, split: int) -> Moments:
        mean = z.mean(0)
        c = z - mean
        return Moments(len(z), mean, c.T @ c, split)

    @property
    def x_mean(self) -> np.ndarray:
        return self.mean[: self.split]

    @property
    def y_mean(self) -> np.ndarray:
        return self.mean[self.split :]

    def block(self, a: str, b: str) -> np.ndarray:
        """Centred scatter of two sides, "x" or "y"."""
        part = {"x": slice(0, self.split), "y": slice(self.split, None)}
        return self.scatter[part[a], part[b]]

    def raw(self, a: str, b: str) -> np.ndarray:
        """Uncentred cross products of two sides."""
        mean = {"x": self.x_mean, "y": self.y_mean}
        return self.block(a, b) + self.n * np.outer(mean[a], mean[b])

    def std(self) -> np.ndarray:
        """Unbiased deviation of each dimension; NaN for a single row."""
        return np.sqrt(np.diag(self.scatter) / (self.n - 1)) if self.n > 1 else np.full(len(self.mean), np.nan)


def _pack(m: Moments) -> pd.DataFrame:
    return pd.DataFrame({"n": [m.n], "split": [m.split], "mean": [m.mean], "scatter": [m.scatter.ravel()]})


def _unpack(frame: pd.DataFrame) -> Moments:
    out = Moments(0, np.zeros(0), np.zeros((0, 0)), 0)
    for n, split, mean, scatter in zip(frame["n"], frame["split"], frame["mean"], frame["scatter"]):
        out = out.merge(Moments(int(n), np.asarray(mean), np.asarray(scatter).reshape(len(mean), len(mean)), int(split)))
    return out


def moments(df: DataFrame, x: str, y: str | None = None, fan_in: int = 64) -> Moments:
    """Moments of a vector column, or of two columns of the same rows.

    One pass: each partition gives its own state, states are merged in groups of `fan_in` by tasks, and the driver merges the
    rest, so that it gets at most partitions / fan_in small matrices. Rows with a null vector are left out.
    """
    cols = [F.col(x).cast("array<double>").alias("x")] + ([F.col(y).cast("array<double>").alias("y")] if y else [])
    rows = df.select(*cols).dropna()
    kinds = "n long, split long, mean array<double>, scatter array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(0, np.zeros(0), np.zeros((0, 0)), 0)
        for b in batches:
            if b.num_rows:
                parts = [matrix(b.column(i)) for i in range(b.num_columns)]
                state = state.merge(Moments.of(np.hstack(parts), parts[0].shape[1]))
        if state.n:
            yield pa.RecordBatch.from_pandas(_pack(state), preserve_index=False)

    states = rows.mapInArrow(partial, kinds)
    if rows.rdd.getNumPartitions() > fan_in:
        states = states.withColumn("g", F.floor(F.rand(1) * (rows.rdd.getNumPartitions() // fan_in + 1))).groupBy("g").applyInPandas(lambda f: _pack(_unpack(f)), kinds)
    return _unpack(states.toPandas())


def least_squares(df: DataFrame, x: str, y: str) -> np.ndarray:
    """argmin ||X W - Y|| with the least norm, by TSQR: partitions send only their R and Q'Y, and pairs of such states are
    factored again in tasks before the driver solves the last small system. Better conditioned than the normal equations."""
    rows = df.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")).dropna()
    kinds = "dx long, r array<double>, b array<double>"

    def state(r: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(r) <= r.shape[1]:
            return r, b
        q, small = np.linalg.qr(r)
        return small, q.T @ b

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = b = None
        for batch in batches:
            if batch.num_rows:
                bx, by = matrix(batch.column(0)), matrix(batch.column(1))
                r, b = state(bx, by) if r is None else state(np.vstack([r, bx]), np.vstack([b, by]))
        if r is not None:
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"dx": np.full(len(r), r.shape[1], np.int64), "r": list(r), "b": list(b)}), preserve_index=False)

    def again(frame: pd.DataFrame) -> pd.DataFrame:
        r, b = state(np.array(frame["r"].tolist()), np.array(frame["b"].tolist()))
        return pd.DataFrame({"dx": np.full(len(r), r.shape[1], np.int64), "r": list(r), "b": list(b)})

    states = rows.mapInArrow(partial, kinds)
    parts = rows.rdd.getNumPartitions()
    if parts > 32:
        states = states.withColumn("g", F.spark_partition_id() % (parts // 32 + 1)).groupBy("g").applyInPandas(again, kinds)
    got = states.toPandas()
    if not len(got):
        raise ValueError("no rows to fit")
    return np.linalg.lstsq(np.array(got["r"].tolist()), np.array(got["b"].tolist()), rcond=None)[0]


def apply_matrix(df: DataFrame, vector: str, weights: np.ndarray, bias: np.ndarray | None = None, out: str | None = None) -> DataFrame:
    """Add (or replace by) `out` = vector @ weights + bias, by BLAS over Arrow batches. No shuffle; null vectors stay null."""
    out = out or vector
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((np.ascontiguousarray(weights, float), None if bias is None else np.asarray(bias, float)))

    @F.pandas_udf("array<double>")
    def product(v: pd.Series) -> pd.Series:
        w, b = shared.value
        some = v.notna().to_numpy()
        result = np.full(len(v), None, object)
        if some.any():
            m = np.array(v[some].tolist(), float) @ w
            for i, r in zip(np.flatnonzero(some), m if b is None else m + b):
                result[i] = r
        return pd.Series(result, dtype=object)

    return df.withColumn(out, product(F.col(vector).cast("array<double>")))
