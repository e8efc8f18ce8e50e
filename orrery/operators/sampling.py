"""Reproducible samples, subsets and splits: rows are ordered by a hash of a seed and their identity."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.ranking import hash_order, spread_rank
from orrery.runtime import checked_broadcast, materialize


class Sampler(Protocol):
    def __call__(self, *spaces: DataFrame, n: int) -> tuple[DataFrame, ...]: ...


def hash_sample(df: DataFrame, n: int, seed: int = 0, on: str = "offset") -> DataFrame:
    """Exactly n rows (or all), those first by md5(seed:id). Hash slices are ranked apart, so no task sorts all rows."""
    ranked = spread_rank(df.select(F.col(on).alias("__id"), hash_order(seed, on).alias("__at")), [], "__at", "__rank", ["__id"])
    return df.join(ranked.where(F.col("__rank") <= n).select(F.col("__id").alias(on)), on, "left_semi")


class Uniform:
    """n rows without replacement, the same identities from every space. Keys and other columns stay."""

    def __init__(self, random_seed: int = 0) -> None:
        self.random_seed = random_seed

    def __call__(self, *spaces: DataFrame, n: int, on: str = "offset") -> tuple[DataFrame, ...]:
        sizes = [s.count() for s in spaces]
        if len(set(sizes)) > 1:
            raise ValueError("spaces of several lengths")
        if not spaces or not 1 <= n <= sizes[0]:
            raise ValueError("n must lie between 1 and the number of rows")
        ids = materialize(hash_sample(spaces[0].select(on), n, self.random_seed, on), "sampled")
        return tuple(s.join(checked_broadcast(ids), on, "left_semi") for s in spaces)


def stratified_sample(df: DataFrame, per_group: int, group: str, seed: int = 0, on: str = "offset") -> DataFrame:
    """Up to `per_group` rows of every group, chosen as in hash_sample."""
    ranked = spread_rank(df.withColumn("__at", hash_order(seed, on)), [group], "__at", "__rank", [on])
    return ranked.where(F.col("__rank") <= per_group).drop("__at", "__rank")


def subset(df: DataFrame, perc: float, seed: int = 42, split: str = "split", on: str = "id", id_out: str = "sample_id") -> DataFrame:
    """floor(n * perc) rows of every split in hash order, numbered from 0 in that order as `id_out`."""
    if not 0 < perc <= 1:
        raise ValueError("perc must lie in (0, 1]")
    ranked = spread_rank(df.withColumn("__at", hash_order(seed, on)), [split], "__at", "__rank", [on])
    sizes = df.groupBy(split).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(split, "__split")
    kept = ranked.join(F.broadcast(sizes), F.col(split).eqNullSafe(F.col("__split"))).where(F.col("__rank") <= F.floor(F.col("__n") * perc))  # one row per split
    return kept.withColumn(id_out, (F.col("__rank") - 1).cast("long")).drop("__at", "__rank", "__n", "__split")


def train_val_split(df: DataFrame, val_share: float = 0.1, seed: int = 42, on: str = "id", out: str = "part") -> DataFrame:
    """Add `out`: "val" for the first round-up share of rows in hash order, "train" for the others. Exact, unlike randomSplit."""
    total = df.count()
    ranked = spread_rank(df.withColumn("__at", hash_order(seed, on)), [], "__at", "__rank", [on])
    return ranked.withColumn(out, F.when(F.col("__rank") <= F.ceil(F.lit(total) * F.lit(val_share)), "val").otherwise("train")).drop("__at", "__rank")
