"""Pairings of the rows of two spaces, and views of several spaces side by side."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.ranking import hash_order, spread_rank
from orrery.sources.catalog import content_id
from orrery.sources.files import read_text, write_text


class Correspondence:
    """(pos, x_id, y_id): row x_id of one space belongs to row y_id of another; repeats are allowed."""

    def __init__(self, df: DataFrame, properties: dict[str, Any] | None = None) -> None:
        self.df = df.select("pos", "x_id", "y_id")
        self.properties = {"_version": 0, "_type": type(self).__name__} | dict(properties or {})

    @staticmethod
    def from_pairs(spark: SparkSession, pairs: list[tuple[int, int]], properties: dict | None = None) -> Correspondence:
        return Correspondence(spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(pairs)], "pos long, x_id long, y_id long"), properties)

    @staticmethod
    def identity(spark: SparkSession, n: int, properties: dict | None = None) -> Correspondence:
        ids = spark.range(n)
        return Correspondence(ids.select(F.col("id").alias("pos"), F.col("id").alias("x_id"), F.col("id").alias("y_id")), properties)

    item_id = property(lambda self: content_id(self.properties))

    def gather(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """(offset, x, y): two equi-joins through the pairing; offset is the pair's place."""
        left = x.select(F.col("offset").alias("x_id"), F.col("vector").alias("x"))
        right = y.select(F.col("offset").alias("y_id"), F.col("vector").alias("y"))
        return self.df.join(left, "x_id").join(right, "y_id").select(F.col("pos").alias("offset"), "x", "y")

    def random_subset(self, n: int, seed: int = 0) -> Correspondence:
        """n pairs in hash order."""
        ranked = spread_rank(self.df.withColumn("at", hash_order(seed, "pos")), [], "at", "n", ["pos"])
        return Correspondence(ranked.where(F.col("n") <= n), self.properties)

    def split(self, share: float, seed: int = 0) -> tuple[Correspondence, Correspondence]:
        """The first share of pairs in hash order, and the others."""
        n = int(self.df.count() * share)
        ranked = spread_rank(self.df.withColumn("at", hash_order(seed, "pos")), [], "at", "n", ["pos"])
        return Correspondence(ranked.where(F.col("n") <= n), self.properties), Correspondence(ranked.where(F.col("n") > n), self.properties)

    def add_noise(self, share: float, seed: int = 0) -> Correspondence:
        """A share of the pairs gets the y of another of them: the chosen pairs, in hash order, pass their y on by one."""
        n = int(self.df.count() * share)
        ranked = spread_rank(self.df.withColumn("at", hash_order(seed, "pos")), [], "at", "n", ["pos"])
        chosen = ranked.where(F.col("n") <= n)
        given = chosen.select((F.col("n") % F.lit(max(n, 1)) + 1).alias("n"), F.col("y_id").alias("new_y"))
        moved = chosen.join(given, "n").select("pos", "x_id", F.col("new_y").alias("y_id"))
        return Correspondence(ranked.where(F.col("n") > n).select("pos", "x_id", "y_id").unionByName(moved), self.properties)

    def save(self, path: str) -> None:
        self.df.write.parquet(f"{path}/pairs")
        write_text(self.df.sparkSession, f"{path}/properties.json", json.dumps(self.properties, indent=4, sort_keys=True))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Correspondence:
        return Correspondence(spark.read.parquet(f"{path}/pairs"), json.loads(read_text(spark, f"{path}/properties.json")))


def correspondence_grid(spark: SparkSession, x_datasets: list[str], y_datasets: list[str], qualities: list[float], splits: list[str]) -> DataFrame:
    """(x_dataset, y_dataset, quality, split): every combination of four short lists."""
    lists = {"x_dataset": x_datasets, "y_dataset": y_datasets, "quality": qualities, "split": splits}
    one = spark.range(1).select(*[F.array(*[F.lit(v) for v in values]).alias(name) for name, values in lists.items()])
    for name in lists:
        one = one.withColumn(name, F.explode(name))
    return one


def dataset_view(dataset: DataFrame, spaces: dict[str, DataFrame], split: str | None = None, on: str = "sample_id") -> DataFrame:
    """The rows of a dataset (of one split) with the vector of each space as a column of its name: inner joins on the id."""
    out = dataset if split is None else dataset.where(F.col("split") == split)
    for name, space in spaces.items():
        out = out.join(space.select(F.col("offset").alias(on), F.col("vector").alias(name)), on)
    return out
