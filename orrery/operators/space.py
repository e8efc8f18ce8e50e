"""A space: a table of (offset, key, vector) with properties."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import vec
from orrery.operators import measures, search
from orrery.operators.transforms import Transform
from orrery.runtime import checked_broadcast
from orrery.sources.catalog import content_id
from orrery.sources.files import exists, read_text, write_text

#: Columns of every space; `offset` is the row's identity, `key` may be null.
SCHEMA = T.StructType([T.StructField("offset", T.LongType()), T.StructField("key", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])

#: Version and kind stamped into the properties, and so into the id.
VERSION, KIND = 1, "space"

#: Named readers of vector tables: (spark, path) -> frame with the columns of SCHEMA.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def reader(name: str):
    def register(fn):
        if name in READERS:
            raise ValueError(f"reader {name!r} exists")
        READERS[name] = fn
        return fn

    return register


@reader("parquet")
def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@reader("key_tsv")
def _key_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Interchange form: vectors.parquet (offset, vector) and mapping.tsv (x = key, y = offset)."""
    keys = spark.read.csv(f"{path}/mapping.tsv", sep="\t", header=True, schema="x string, y long")
    return spark.read.parquet(f"{path}/vectors.parquet").join(keys.select(F.col("x").alias("key"), F.col("y").alias("offset")), "offset", "left")


class Space:
    def __init__(self, df: DataFrame, properties: dict[str, Any] | None = None, root_path: str | None = None) -> None:
        self.df = df.select(F.col("offset").cast("long").alias("offset"), (F.col("key") if "key" in df.columns else F.lit(None)).cast("string").alias("key"), vec.as_double("vector").alias("vector"))
        self._properties = {"_version": VERSION, "_type": KIND} | copy.deepcopy(properties or {})
        self.root_path = root_path
        self.source_model: Any = None
        self.decoders: dict[str, Any] = {}

    def attach(self, source_model: Any = None, **decoders: Any) -> Space:
        """The model the vectors come from, and decoders by name: anything with save(path) and properties."""
        self.source_model = source_model or self.source_model
        self.decoders |= decoders
        return self

    # -- construction

    @staticmethod
    def from_df(df: DataFrame, id_col: str, vector_col: str, key_col: str | None = None, properties: dict | None = None) -> Space:
        """Offsets are the frame's own ids: pairing is by them and never by the order of rows."""
        return Space(df.select(F.col(id_col).alias("offset"), (F.col(key_col) if key_col else F.lit(None)).alias("key"), F.col(vector_col).alias("vector")), properties)

    @staticmethod
    def from_rows(spark: SparkSession, vectors: Sequence[Sequence[float]] = (), keys: Sequence[str] | None = None, properties: dict | None = None) -> Space:
        if keys and len(keys) != len(vectors):
            raise ValueError("as many keys as vectors")
        rows = [(i, keys[i] if keys else None, [float(x) for x in v]) for i, v in enumerate(vectors)]
        return Space(spark.createDataFrame(rows, SCHEMA), properties)

    # -- introspection

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def properties(self) -> dict[str, Any]:
        return copy.deepcopy(self._properties)

    name = property(lambda self: self._properties.get("name", "space"))
    split = property(lambda self: self._properties.get("split"))
    version = property(lambda self: self._properties["_version"])
    item_id = property(lambda self: content_id(self._properties))
    vectors = property(lambda self: self.df.select("offset", "vector"))
    keys = property(lambda self: self.df.where("key is not null").select("key", "offset"))

    def __len__(self) -> int:
        return self.df.count()

    @property
    def dim(self) -> int | None:
        row = self.df.where("vector is not null").select(F.size("vector")).first()
        return row[0] if row else None

    @property
    def shape(self) -> tuple[int, int | None]:
        return len(self), self.dim

    def __iter__(self) -> Iterator[list[float]]:
        return (r.vector for r in self.df.orderBy("offset").select("vector").toLocalIterator())

    def __repr__(self) -> str:
        return f"Space({self.name!r}, {({k: v for k, v in self._properties.items() if not k.startswith('_')})})"

    def validate(self) -> None:
        """One aggregate: offsets unique and not null, all rows or none keyed, keys unique, vectors of one width and sound."""
        sound = F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
        r = self.df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("offset").alias("o"), F.count("key").alias("k"), F.countDistinct("key").alias("d"), F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b"), F.count(F.when(~sound, 1)).alias("bad")).first()
        if r.o != r.n:
            raise ValueError("offsets must be unique and not null")
        if r.k not in (0, r.n) or r.k != r.d:
            raise ValueError("either no row or every row has a key, and keys are unique")
        if r.bad or (r.n and r.a != r.b):
            raise ValueError("vectors must be complete and of one width")

    # -- access

    def rows(self, offsets: Sequence[int] | DataFrame) -> DataFrame:
        """(pos, offset, key, vector) in the order of the given offsets, repeats kept."""
        wanted = offsets if isinstance(offsets, DataFrame) else self.spark.createDataFrame(list(enumerate(offsets)), "pos int, offset long")
        return self.df.join(checked_broadcast(wanted), "offset").select("pos", "offset", "key", "vector")

    def __getitem__(self, index: int | slice | Sequence[int]):
        """An int gives a vector, a slice or list a new space (rows of a list renumbered by their place in it)."""
        if isinstance(index, int):
            row = self.df.where(F.col("offset") == index).first()
            if row is None:
                raise IndexError(index)
            return row.vector
        if isinstance(index, slice):
            low, high, step = index.start or 0, index.stop, index.step or 1
            if low < 0 or (high is not None and high < 0) or step < 1:
                raise ValueError("slices count from the start")
            part = self.df.where((F.col("offset") >= low) & ((F.col("offset") - low) % step == 0))
            return Space(part if high is None else part.where(F.col("offset") < high), self._properties)
        return Space(self.rows(index).select(F.col("pos").alias("offset"), "key", "vector"), self._properties)

    def get_vector_by_key(self, key: str) -> list[float]:
        row = self.df.where(F.col("key") == key).first()
        if row is None:
            raise KeyError(key)
        return row.vector

    def equals(self, other: Space, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
        """Equal properties, the same offsets and vectors equal within the tolerances."""
        if self._properties != other._properties:
            return False
        both = self.df.select("offset", "vector").join(other.df.select("offset", F.col("vector").alias("w")), "offset", "full")
        return both.where(~F.coalesce(vec.close("vector", "w", rtol, atol), F.lit(False))).isEmpty()

    # -- new spaces

    def like(self, df: DataFrame | None = None, properties: dict | None = None) -> Space:
        """A space that borrows what is not given; keys stay."""
        return Space(self.df if df is None else df, self._properties if properties is None else properties, self.root_path)

    def to_memory(self) -> Space:
        self.df = self.df.cache()
        return self

    def add_vectors(self, df: DataFrame, order: str = "offset") -> Space:
        """Rows of `df` behind the present ones, with dense new offsets. Keys are demanded where the space has some."""
        keyed = not self.df.where("key is not null").isEmpty()
        has = "key" in df.columns and not df.where("key is not null").isEmpty()
        if keyed != has and not self.df.isEmpty():
            raise ValueError("either all vectors have keys or none")
        new = df if has else df.select(F.col(order).alias(order), F.lit(None).cast("string").alias("key"), "vector")
        if has:
            keys = new.select("key")
            if not keys.groupBy("key").count().where("count > 1 or key is null").isEmpty() or not keys.join(self.df.select("key"), "key", "left_semi").isEmpty():
                raise KeyError("keys exist already, repeat or are missing")
        start = self.df.agg(F.coalesce(F.max("offset") + 1, F.lit(0))).first()[0]
        placed = search.dense_offsets(new.select(F.col(order).alias("__order"), "key", vec.as_double("vector").alias("vector")), "__order", start).drop("__order")
        return self.like(self.df.unionByName(placed))

    def sample(self, sampler, n: int) -> Space:
        return self.like(sampler(self.df, n=n)[0])

    def transform(self, transform: Transform, fit: bool = False) -> Space:
        return self.like(transform.fit_transform(self.df) if fit else transform.transform(self.df))

    def to_index(self, metric: str = "l2", keys: DataFrame | None = None, transform: str | None = None) -> search.SearchIndex:
        """An exact index; keys (offset, key) given here win over those of the space."""
        df = self.df if keys is None else self.df.drop("key").join(keys.select("offset", "key"), "offset", "left")
        return search.SearchIndex(df, metric, transform)

    def compare(self, *others: Space, metrics: dict[str, Callable[[Column, Column], Column]] | list[str] = ("l2", "l1", "cosine")) -> DataFrame:
        return measures.compare(self.df, *[o.df for o in others], metrics=metrics)

    def to_hf_dataset(self, *_):
        raise NotImplementedError("use df.toArrow()")

    # -- persistence

    def save(self, path: str, vectors: bool = True, properties: bool = True, mode: str = "errorifexists") -> None:
        if vectors:
            self.df.write.mode(mode).parquet(f"{path}/vectors")
        if properties:
            write_text(self.spark, f"{path}/properties.json", json.dumps(self._properties, indent=4, sort_keys=True, ensure_ascii=False))
        for at, model in {"source_model": self.source_model, **{f"decoders/{n}": d for n, d in self.decoders.items()}}.items():
            if model is not None and hasattr(model, "save"):
                model.save(f"{path}/{at}")

    @staticmethod
    def load_properties(spark: SparkSession, path: str) -> dict[str, Any]:
        return json.loads(read_text(spark, f"{path}/properties.json"))

    @staticmethod
    def load(spark: SparkSession, path: str, source: str = "parquet") -> Space:
        if not exists(spark, path):
            raise FileNotFoundError(path)
        return Space(READERS[source](spark, f"{path}/vectors"), Space.load_properties(spark, path), path)

    def save_key_tsv(self, path: str) -> None:
        """Interchange form: see the reader key_tsv."""
        self.df.select("offset", "vector").write.parquet(f"{path}/vectors.parquet")
        self.keys.select(F.col("key").alias("x"), F.col("offset").alias("y")).write.csv(f"{path}/mapping.tsv", sep="\t", header=True)
