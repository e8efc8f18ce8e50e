"""Exact nearest-neighbour and range search over a table of vectors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import vec
from orrery.operators.kernels import matrix
from orrery.operators.transforms import NAMED, lp_normalize
from orrery.runtime import checked_broadcast, materialize
from orrery.sources.files import read_text, write_text

#: Queries that are broadcast at once; a larger query set is taken in blocks of this size.
BLOCK = 4096


@dataclass(frozen=True)
class SearchMetric:
    """A metric: `distance` of two vector columns, whether less is nearer, and a transform of stored vectors."""

    key: str
    ascending: bool
    distance: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    transform: Callable[[Column], Column] | None = None


def _squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q @ x.T, 0)


def _apart(norm: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda q, x: np.stack([norm(np.abs(x - r)) for r in q]) if len(q) else np.zeros((0, len(x)))


METRICS = {
    m.key: m
    for m in (
        SearchMetric("l2", True, vec.l2_squared, _squared),
        SearchMetric("euclidean", True, vec.l2_squared, _squared),
        SearchMetric("cosine", False, vec.dot, lambda q, x: q @ x.T, lp_normalize),
        SearchMetric("inner_product", False, vec.dot, lambda q, x: q @ x.T),
        SearchMetric("l1", True, lambda a, b: vec.norm(vec.sub(a, b), 1), _apart(lambda d: d.sum(1))),
        SearchMetric("linf", True, lambda a, b: vec.norm(vec.sub(a, b), float("inf")), _apart(lambda d: d.max(1))),
    )
}


class SearchIndex:
    """A table (offset, key, vector) searched by a metric. Offsets are dense from 0, keys are unique or null.

    The index is immutable: adding gives a new one. L2 distances and radii are squared. Vectors are stored transformed (unit
    length for cosine); query vectors are taken as they are unless `transform` is set. Ties go to the smaller offset.
    """

    def __init__(self, df: DataFrame, metric: str | SearchMetric, transform: str | None = None, name: str | None = None, stored: bool = False) -> None:
        self.metric = METRICS[metric] if isinstance(metric, str) else metric
        if transform and self.metric.transform:
            raise NotImplementedError("the metric has a transform of its own")
        self.transform_name, self.name = transform, name
        cols = [F.col("offset").cast("long").alias("offset"), (F.col("key") if "key" in df.columns else F.lit(None)).cast("string").alias("key"), vec.as_double("vector").alias("vector")]
        self.df = df.select(*cols) if stored else df.select(*cols[:2], self._prepare(cols[2]).alias("vector"))

    @staticmethod
    def create(spark: SparkSession, metric: str, transform: str | None = None, name: str | None = None) -> SearchIndex:
        return SearchIndex(spark.createDataFrame([], "offset long, key string, vector array<double>"), metric, transform, name)

    def _prepare(self, v: Column) -> Column:
        if self.metric.transform:
            return self.metric.transform(v)
        return NAMED[self.transform_name](v) if self.transform_name else v

    # -- introspection and point access

    def __len__(self) -> int:
        return self.df.count()

    num_elements = property(__len__)

    @property
    def num_dimensions(self) -> int | None:
        row = self.df.select(F.size("vector")).first()
        return row[0] if row else None

    @property
    def metadata(self) -> dict:
        return {"metric": self.metric.key, "transform": self.transform_name, "name": self.name}

    def contains(self, keys: DataFrame, out: str = "held") -> DataFrame:
        """`keys` (key, ..) with a flag: whether the index holds the key."""
        held = self.df.where("key is not null").select("key", F.lit(True).alias(out))
        return keys.join(held, "key", "left").withColumn(out, F.coalesce(out, F.lit(False)))

    def __contains__(self, key: str) -> bool:
        return not self.df.where(F.col("key") == key).isEmpty()

    def vectors(self, offsets: Sequence[int] | DataFrame | None = None, keys: Sequence[str] | DataFrame | None = None) -> DataFrame:
        """(pos, offset, key, vector) of the wanted rows as stored, in the given order; a frame must have (pos, offset | key)."""
        if (offsets is None) == (keys is None):
            raise ValueError("give offsets or keys")
        on, wanted = ("offset", offsets) if keys is None else ("key", keys)
        if not isinstance(wanted, DataFrame):
            kind = "long" if on == "offset" else "string"
            wanted = self.df.sparkSession.createDataFrame([(i, w) for i, w in enumerate(wanted)], f"pos int, {on} {kind}")
        return self.df.join(checked_broadcast(wanted), on).select("pos", "offset", "key", "vector")

    def vector(self, offset: int | None = None, key: str | None = None) -> list[float]:
        if (offset is None) == (key is None):
            raise ValueError("give an offset or a key")
        row = self.df.where(F.col("offset") == offset if key is None else F.col("key") == key).select("vector").first()
        if row is None:
            raise KeyError(offset if key is None else key)
        return row.vector

    # -- growing

    def check(self) -> None:
        """One aggregate: no null or repeated offset, no repeated key, one width."""
        r = self.df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("offset").alias("o"), F.count("key").alias("k"), F.countDistinct("key").alias("d"), F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
        if r.o != r.n or r.k != r.d:
            raise ValueError("offsets and keys must be unique")
        if r.n and r.a != r.b:
            raise ValueError("vectors of several widths")

    def add(self, df: DataFrame, order: str = "offset") -> SearchIndex:
        """A new index with the rows of `df` (order column, [key], vector) behind the present ones. Keys are checked first, so
        that nothing is added when one exists or repeats."""
        keyed = df.withColumn("key", F.col("key").cast("string")) if "key" in df.columns else df.withColumn("key", F.lit(None).cast("string"))
        keys = keyed.where("key is not null").select("key")
        if not keys.groupBy("key").count().where("count > 1").isEmpty() or not keys.join(self.df.select("key"), "key", "left_semi").isEmpty():
            raise KeyError("keys exist already or repeat")
        start = self.df.agg(F.coalesce(F.max("offset") + 1, F.lit(0))).first()[0]
        new = dense_offsets(keyed.select(F.col(order).alias("__order"), "key", vec.as_double("vector").alias("vector")), "__order", start).drop("__order")
        grown = self.df.unionByName(new.withColumn("vector", self._prepare(F.col("vector"))))
        return SearchIndex(grown, self.metric, self.transform_name, self.name, stored=True)

    def add_rows(self, vectors: Sequence[Sequence[float]], keys: Sequence[str] | None = None) -> SearchIndex:
        if keys is not None and len(keys) != len(vectors):
            raise ValueError("as many keys as vectors")
        rows = [(i, None if keys is None else keys[i], [float(x) for x in v]) for i, v in enumerate(vectors)]
        return self.add(self.df.sparkSession.createDataFrame(rows, "offset long, key string, vector array<double>"))

    # -- search

    def _queries(self, query_offsets, query_keys, queries, transform) -> DataFrame:
        if sum(q is not None for q in (query_offsets, query_keys, queries)) != 1:
            raise ValueError("give exactly one of query_offsets, query_keys and queries")
        if queries is None:
            return self.vectors(offsets=query_offsets, keys=query_keys).select(F.col("pos").cast("long").alias("query_id"), "vector")
        if not isinstance(queries, DataFrame):
            rows = [(i, [float(x) for x in v]) for i, v in enumerate(queries)]
            queries = self.df.sparkSession.createDataFrame(rows, "query_id long, vector array<double>")
        v = vec.as_double("vector")
        return queries.select(F.col("query_id").cast("long").alias("query_id"), (self._prepare(v) if transform else v).alias("vector"))

    def _scan(self, queries: DataFrame, keep: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """(query_id, offset, key, distance) of what `keep` takes of each batch's distances, queries in blocks."""
        spark, metric = self.df.sparkSession, self.metric
        kinds = "query_id long, offset long, key string, distance double"

        def scanner(ids: list[int], vectors: np.ndarray):
            shared = spark.sparkContext.broadcast((np.array(ids, np.int64), vectors))

            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                names, q = shared.value
                for b in batches:
                    if not b.num_rows:
                        continue
                    x, offsets = matrix(b.column(2)), b.column(0).to_numpy()
                    for s in range(0, len(q), 256):
                        d = np.round(metric.block(q[s : s + 256], x), 12)
                        row, at = keep(d if metric.ascending else -d, offsets)
                        yield pa.RecordBatch.from_arrays([pa.array(names[s + row]), pa.array(offsets[at]), b.column(1).take(pa.array(at)), pa.array(d[row, at])], names=["query_id", "offset", "key", "distance"])

            return scan

        parts, ids, vectors = [], [], []
        rows = self.df.select("offset", "key", "vector").where("vector is not null")
        for r in queries.where("vector is not null").toLocalIterator():
            ids.append(r.query_id)
            vectors.append(r.vector)
            if len(ids) == BLOCK:
                parts.append(rows.mapInArrow(scanner(ids, np.array(vectors, float)), kinds))
                ids, vectors = [], []
        if ids or not parts:
            parts.append(rows.mapInArrow(scanner(ids, np.array(vectors, float).reshape(len(ids), -1)), kinds))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def search_knn(self, k: int, *, query_offsets=None, query_keys=None, queries=None, transform: bool = False, digits: int | None = None, pad: bool = False) -> DataFrame:
        """(query_id, rank, offset, key, distance): the k nearest rows of each query, a stored query being its own neighbour.
        With `pad`, queries with fewer than k rows get rows of offset -1 up to rank k - 1, with null key and distance.

        Every batch of rows gives its k best by BLAS, and only those are shuffled, by query. Fewer than k rows give all there
        are. `digits` rounds distances before they are ranked, so that other engines agree on ties.
        """
        if k < 1:
            raise ValueError("k must be positive")
        q = self._queries(query_offsets, query_keys, queries, transform)

        def best(d: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if d.shape[1] > k:
                worst = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                return np.nonzero(d <= (worst if digits is None else worst + 10.0**-digits))
            return np.nonzero(np.ones_like(d, bool))

        found = self._scan(q, best)
        if digits is not None:
            found = found.withColumn("distance", F.round("distance", digits) + F.lit(0.0))
        order = F.asc("distance") if self.metric.ascending else F.desc("distance")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "offset")))
        best_k = ranked.where(F.col("rank") <= k).select("query_id", (F.col("rank") - 1).cast("int").alias("rank"), "offset", "key", "distance")
        if not pad:
            return best_k
        places = q.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("rank"))
        return places.join(best_k, ["query_id", "rank"], "left").withColumn("offset", F.coalesce("offset", F.lit(-1)).cast("long"))

    def search_range(self, radius: float, *, query_offsets=None, query_keys=None, queries=None, transform: bool = False, sort: bool = True) -> DataFrame:
        """(query_id, rank, offset, key, distance) of the rows strictly within the radius: squared distance below it, similarity
        above it. Without `sort` there is no rank and no shuffle."""
        q = self._queries(query_offsets, query_keys, queries, transform)
        limit = radius if self.metric.ascending else -radius
        found = self._scan(q, lambda d, _: np.nonzero(d < limit))
        if not sort:
            return found
        order = F.asc("distance") if self.metric.ascending else F.desc("distance")
        return found.withColumn("rank", (F.row_number().over(Window.partitionBy("query_id").orderBy(order, "offset")) - 1).cast("int")).select("query_id", "rank", "offset", "key", "distance")

    # -- persistence

    def save(self, path: str) -> None:
        """A Parquet folder and metadata.json; the transform is stored by its name."""
        self.df.write.mode("overwrite").parquet(f"{path}/vectors")
        write_text(self.df.sparkSession, f"{path}/metadata.json", json.dumps(self.metadata, indent=4, sort_keys=True))

    @staticmethod
    def load(spark: SparkSession, path: str) -> SearchIndex:
        meta = json.loads(read_text(spark, f"{path}/metadata.json"))
        return SearchIndex(spark.read.parquet(f"{path}/vectors"), meta["metric"], meta["transform"], meta["name"], stored=True)


def knn_sql(index: DataFrame, queries: DataFrame, k: int, metric: str, digits: int = 6) -> DataFrame:
    """The readable definition of kNN as one SQL plan: queries broadcast after a size check, distance by higher-order functions,
    row_number per query. Used to cross-check SearchIndex; the kernel is faster."""
    m = METRICS[metric]
    d = F.round(m.distance(F.col("q"), F.col("vector")), digits) + F.lit(0.0)
    asked = queries.select("query_id", F.col("vector").alias("q"))
    if asked.limit(BLOCK + 1).count() > BLOCK:
        raise ValueError(f"more than {BLOCK} queries: use SearchIndex")
    pairs = index.join(F.broadcast(asked), F.lit(True)).select("query_id", "offset", d.alias("distance"))
    order = F.asc("distance") if m.ascending else F.desc("distance")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "offset")))
    return ranked.where(F.col("rank") <= k).select("query_id", (F.col("rank") - 1).cast("int").alias("rank"), "offset", "distance")


def per_query(found: DataFrame) -> DataFrame:
    """(query_id, offsets, keys, distances): a search result as one row per query, in rank order (as many as k, or in range)."""
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "offset", "key", "distance"))).alias("r"))
    return rows.select("query_id", F.col("r.offset").alias("offsets"), F.col("r.key").alias("keys"), F.col("r.distance").alias("distances"))


def dense_offsets(df: DataFrame, order: str, start: int = 0, slices: int = 64) -> DataFrame:
    """Add `offset`: start, start + 1, .. in the order of a column of any kind (nulls first), without one task for all rows.

    Rows are cut into ranges of the column, equal values by a hash of the row, so that a value that most rows hold is spread
    as well; each range is numbered by itself and the sizes of the ranges before are added.
    """
    by = [F.asc_nulls_first(order), F.asc("__h")]
    hashed = df.withColumn("__h", F.xxhash64(*df.columns))
    ranges = hashed.repartitionByRange(slices, *by).sortWithinPartitions(*by).drop("__h")
    # the lower 33 bits of this id number the rows of a partition
    parts = materialize(ranges.withColumn("__b", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    sizes = parts.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return parts.join(F.broadcast(sizes), "__b").withColumn("offset", (F.col("__i") + F.col("__before") + start).cast("long")).drop("__b", "__i", "__before")  # one row per slice


def with_metric(index: SearchIndex, metric: str) -> SearchIndex:
    """The same stored vectors under another metric without a transform of its own."""
    return SearchIndex(index.df, replace(METRICS[metric], transform=None), stored=True)
