"""A one-to-one map between two columns, kept as a table (x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.runtime import checked_broadcast


class BiMap:
    """Immutable: adding gives a new map. Every x and every y stands once; both kinds are whatever the columns hold."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df.select("x", "y")

    @staticmethod
    def empty(spark: SparkSession, kinds: str = "x string, y long") -> BiMap:
        return BiMap(spark.createDataFrame([], kinds))

    def __len__(self) -> int:
        return self.df.count()

    def __repr__(self) -> str:
        return f"BiMap({', '.join(f'{n} {k}' for n, k in self.df.dtypes)})"

    x = property(lambda self: self.df.select("x"))
    y = property(lambda self: self.df.select("y"))

    def check(self) -> None:
        """One aggregate: neither side may be null or repeat."""
        r = self.df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("x"), F.countDistinct("y").alias("y")).first()
        if (r.x, r.y) != (r.n, r.n):
            raise ValueError("a side repeats or is null")

    def add_all(self, pairs: DataFrame) -> BiMap:
        """With the pairs (x, y) of a frame; pairs that are there already count once. All or none: a side that is bound to
        another value raises."""
        grown = BiMap(self.df.unionByName(pairs.select("x", "y")).distinct())
        grown.check()
        return grown

    def add(self, x, y) -> BiMap:
        return self.add_all(self.df.sparkSession.createDataFrame([(x, y)], self.df.schema))

    def _look(self, wanted: DataFrame, side: str) -> DataFrame:
        return wanted.join(checked_broadcast(self.df) if wanted.isStreaming else self.df, side, "left")

    def get_y(self, wanted: DataFrame) -> DataFrame:
        """`wanted` (x, ..) with y, null where x is not in the map: one equi-join."""
        return self._look(wanted, "x")

    def get_x(self, wanted: DataFrame) -> DataFrame:
        return self._look(wanted, "y")

    def contains_x(self, wanted: DataFrame, out: str = "held") -> DataFrame:
        """`wanted` (x, ..) with a flag."""
        return wanted.join(self.df.select("x", F.lit(True).alias(out)), "x", "left").withColumn(out, F.coalesce(out, F.lit(False)))

    def contains_y(self, wanted: DataFrame, out: str = "held") -> DataFrame:
        return wanted.join(self.df.select("y", F.lit(True).alias(out)), "y", "left").withColumn(out, F.coalesce(out, F.lit(False)))

    def save(self, path: str) -> None:
        """Tab-separated text with a header line."""
        self.df.write.csv(path, sep="\t", header=True)

    @staticmethod
    def load(spark: SparkSession, path: str, kinds: str = "x string, y long") -> BiMap:
        return BiMap(spark.read.csv(path, sep="\t", header=True, schema=kinds))
