"""Labelled datasets: one frame with a split column, typed features in the column metadata, and processors by name."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.sampling import subset, train_val_split
from orrery.sources.files import exists, read_text, write_text


class DataType(str, Enum):
    TEXT, IMAGE, LABEL = "text", "image", "label"


class FeatureProperty(str, Enum):
    LANGUAGE, CLASSES, FINE_GRAINED = "language", "classes", "fine_grained"


class DatasetProperty(str, Enum):
    NAME, PERC, VERSION = "name", "perc", "version"


@dataclass(frozen=True)
class Feature:
    col_name: str
    data_type: DataType
    properties: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class FeatureMapping:
    source_col: str
    target_col: str


def map_features(df: DataFrame, *mappings: FeatureMapping) -> DataFrame:
    """Copies of source columns under target names."""
    return df.withColumns({m.target_col: F.col(m.source_col) for m in mappings})


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+|\s+$", "")


class Dataset:
    """A frame with `split`, an id column and features; at least one row of every split need not exist."""

    def __init__(self, name: str, df: DataFrame, features: list[Feature], perc: float = 1.0, id_column: str = "sample_id", properties: dict[str, Any] | None = None) -> None:
        if not 0 < perc <= 1:
            raise ValueError("perc must lie in (0, 1]")
        if not features or len({f.col_name for f in features}) != len(features):
            raise ValueError("features must be there and have names of their own")
        missing = {id_column, "split", *[f.col_name for f in features]} - set(df.columns)
        if missing:
            raise ValueError(f"columns missing: {sorted(missing)}")
        for f in features:
            df = df.withMetadata(f.col_name, {"data_type": f.data_type.value, **f.properties})
        self.name, self.df, self.features, self.perc, self.id_column, self.properties = name, df, features, perc, id_column, dict(properties or {})

    def get_feature(self, col_name: str) -> Feature:
        for f in self.features:
            if f.col_name == col_name:
                return f
        raise KeyError(col_name)

    @property
    def metadata(self) -> dict[str, Any]:
        return {"name": self.name, "perc": self.perc, "id_column": self.id_column, "features": [asdict(f) | {"data_type": f.data_type.value} for f in self.features], "properties": self.properties}

    def __repr__(self) -> str:
        return f"Dataset({self.name!r}, {[f.col_name for f in self.features]})"

    def save(self, path: str) -> None:
        if exists(self.df.sparkSession, path):
            raise FileExistsError(path)
        self.df.write.partitionBy("split").parquet(f"{path}/rows")
        write_text(self.df.sparkSession, f"{path}/metadata.json", json.dumps(self.metadata, indent=4, sort_keys=True))

    @staticmethod
    def load_metadata(spark: SparkSession, path: str) -> dict[str, Any]:
        return json.loads(read_text(spark, f"{path}/metadata.json"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Dataset:
        meta = Dataset.load_metadata(spark, path)
        features = [Feature(f["col_name"], DataType(f["data_type"]), f["properties"]) for f in meta["features"]]
        return Dataset(meta["name"], spark.read.parquet(f"{path}/rows"), features, meta["perc"], meta["id_column"], meta["properties"])


def class_names(df: DataFrame, label: str, split: str = "train", limit: int = 10_000) -> list[str]:
    """Distinct labels of a split in order: what a class label column is numbered by. More than `limit` raise."""
    names = df.where(F.col("split") == split).select(F.col(label).cast("string").alias("name")).where("name is not null").distinct()
    rows = names.orderBy("name").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} labels")
    return [r[0] for r in rows]


def dbpedia(df: DataFrame) -> DataFrame:
    """x = title, ". ", content without quotes around it and white space at its ends; y = label."""
    return df.withColumn("x", F.concat("title", F.lit(". "), strip(F.trim("content", F.lit('"'))))).withColumn("y", F.col("label"))


def imdb(df: DataFrame, seed: int = 42) -> DataFrame:
    """Without the unsupervised split; a tenth of train becomes val."""
    known = df.where(F.col("split") != "unsupervised")
    parts = train_val_split(known.where(F.col("split") == "train"), 0.1, seed, on="id", out="part")
    return known.where(F.col("split") != "train").unionByName(parts.withColumn("split", F.col("part")).drop("part"))


def class_label(df: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """The label as its number among the distinct labels of train, in their order as text, null where train lacks it; and the names."""
    names = class_names(df, label)
    number = F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col(label).cast("string")) - 1
    return df.withColumn(label, F.when(number >= 0, number.cast("int"))), names


#: Processors whose label becomes a class label of the distinct labels in train.
CLASS_LABELS = {"ag_news": "label", "imdb": "label"}
_ENGLISH = {FeatureProperty.LANGUAGE.value: "en"}

#: name -> (process, features): text and image sets in the shape their public sources have.
PROCESSORS: dict[str, tuple[Callable[[DataFrame], DataFrame], list[Feature]]] = {
    "dbpedia_14": (dbpedia, [Feature("x", DataType.TEXT, _ENGLISH), Feature("y", DataType.LABEL)]),
    "trec": (lambda d: d, [Feature("text", DataType.TEXT, _ENGLISH), Feature("coarse_label", DataType.LABEL), Feature("fine_label", DataType.LABEL, {FeatureProperty.FINE_GRAINED.value: True})]),
    "ag_news": (lambda d: d, [Feature("text", DataType.TEXT, _ENGLISH), Feature("label", DataType.LABEL)]),
    "imdb": (imdb, [Feature("text", DataType.TEXT, _ENGLISH), Feature("label", DataType.LABEL)]),
    "mnist": (lambda d: d, [Feature("image", DataType.IMAGE), Feature("label", DataType.LABEL)]),
    "fashion_mnist": (lambda d: d, [Feature("image", DataType.IMAGE), Feature("label", DataType.LABEL)]),
    "cifar10": (lambda d: d.withColumnRenamed("img", "image"), [Feature("image", DataType.IMAGE), Feature("label", DataType.LABEL)]),
    "cifar100": (lambda d: d.withColumnRenamed("img", "image"), [Feature("image", DataType.IMAGE), Feature("coarse_label", DataType.LABEL), Feature("fine_label", DataType.LABEL)]),
}


def process(name: str, df: DataFrame, perc: float = 1.0, seed: int = 42, raw_id: str = "id", id_column: str = "sample_id") -> Dataset:
    """A dataset from raw rows (raw_id, split, ..): seeded subset of every split, processor, feature columns only, new ids."""
    fn, features = PROCESSORS[name]
    made = fn(df)
    if name in CLASS_LABELS:
        made, names = class_label(made, CLASS_LABELS[name])
        features = [f if f.col_name != CLASS_LABELS[name] else Feature(f.col_name, f.data_type, f.properties | {FeatureProperty.CLASSES.value: names}) for f in features]
    part = subset(made, perc, seed, on=raw_id, id_out=id_column)
    return Dataset(name, part.select(id_column, "split", *[f.col_name for f in features]), features, perc, id_column)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image): files below a folder as binary, path-ordered ids are up to the caller."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("content").alias("image"))
