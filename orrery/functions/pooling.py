"""Pooling of token vectors: array<array<double>> with an array<boolean> mask, one row per record (and layer)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.vec import add, col, let, scale


def token_pool(tokens: str | Column, mask: str | Column) -> Column:
    """The vectors of unmasked tokens, a ragged array."""
    pairs = F.zip_with(col(tokens), col(mask), lambda t, m: F.when(m, t))
    return F.filter(pairs, lambda t: t.isNotNull())


def _sum(kept: Column, width: Column) -> Column:
    return F.aggregate(kept, F.array_repeat(F.lit(0.0), width), lambda s, t: add(s, t))


def _width(tokens: str | Column) -> Column:
    return F.coalesce(F.size(F.get(col(tokens), F.lit(0))), F.lit(0))


def sum_pool(tokens: str | Column, mask: str | Column) -> Column:
    """The sum over unmasked tokens; zeros if none is left."""
    return _sum(token_pool(tokens, mask), _width(tokens))


def mean_pool(tokens: str | Column, mask: str | Column) -> Column:
    """The mean over unmasked tokens; NaN if none is left."""
    share = lambda kept: F.when(F.size(kept) > 0, F.try_divide(F.lit(1.0), F.size(kept).cast("double"))).otherwise(F.lit(float("nan")))
    return let(token_pool(tokens, mask), lambda kept: scale(_sum(kept, _width(tokens)), share(kept)))


def cls_pool(tokens: str | Column, mask: str | Column | None = None) -> Column:
    """The first token's vector, masked or not."""
    return F.get(col(tokens), F.lit(0))


POOLERS: dict[str, Callable[..., Column]] = {"token": token_pool, "sum": sum_pool, "mean": mean_pool, "cls": cls_pool}


def pool_layers(df: DataFrame, tokens: str, mask: str, pooler: str, layers: list[int] | None = None, layer_col: str = "layer", out: str = "vector") -> DataFrame:
    """Apply a pooler to the rows of the given layers (all if none are named) of a frame with one row per record and layer."""
    if pooler not in POOLERS:
        raise KeyError(f"no pooler {pooler!r}")
    rows = df if not layers else df.where(F.col(layer_col).isin(list(layers)))
    return rows.withColumn(out, POOLERS[pooler](tokens, mask))
