"""Encoders, decoders and the append of encoded batches to spaces."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.pooling import POOLERS
from orrery.functions.vec import as_double
from orrery.sources.files import exists, read_text, write_text


class Encoder(Protocol):
    """Turns a feature column into an array of token vectors of `dim` elements with a mask, or into a vector."""

    dim: int

    def tokens(self, feature: Column) -> tuple[Column, Column]: ...


class HashingEncoder:
    """A deterministic text encoder without a model: each word's vector holds the signs of the hex digits of its md5 (negative from
    8 on), a further md5 for every 32 dimensions, masked where the word is a single character. Built from column expressions only."""

    def __init__(self, dim: int = 64, seed: int = 0) -> None:
        self.dim, self.seed = dim, seed

    def tokens(self, feature: Column) -> tuple[Column, Column]:
        words = F.filter(F.split(F.lower(F.coalesce(feature, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
        hashes = lambda w: F.concat(*[F.md5(F.concat(F.lit(f"{self.seed}:{b}:"), w)) for b in range(-(-self.dim // 32))])
        signs = lambda h: F.transform(F.split(F.substring(h, 1, self.dim), ""), lambda c: F.when(c < "8", 1.0).otherwise(-1.0))
        return F.transform(words, lambda w: signs(hashes(w))), F.transform(words, lambda w: F.length(w) > 1)


class TileEncoder:
    """A deterministic image encoder without a model: the mean byte of each of `dim` equal runs of the content, scaled to -1..1.
    Give it raw pixels; any bytes will do. Runs over Arrow batches."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def vector(self, feature: Column) -> Column:
        dim = self.dim

        @F.pandas_udf("array<double>")
        def encode(values: pd.Series) -> pd.Series:
            out = []
            for content in values:
                data = np.frombuffer(content or b"", np.uint8)
                edges = np.arange(dim + 1) * len(data) // dim
                sums = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
                out.append(((sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(np.diff(edges), 1) / 127.5 - 1).tolist())
            return pd.Series(out, dtype=object)

        return encode(feature)


class BatchEncoder:
    """Any function from a list of feature values to a matrix, run over Arrow batches; give it a loader for heavy models."""

    def __init__(self, load: Callable[[], Callable[[list], np.ndarray]]) -> None:
        self.load = load

    def vector(self, feature: Column) -> Column:
        load, held = self.load, {}

        @F.pandas_udf("array<double>")
        def encode(values: pd.Series) -> pd.Series:
            model = held.setdefault("model", load()) if "model" not in held else held["model"]
            return pd.Series([list(map(float, r)) for r in model(values.tolist())]) if len(values) else pd.Series([], dtype=object)

        return encode(feature)


def collate(df: DataFrame, feature: str, id_column: str = "sample_id") -> DataFrame:
    """(offset, key, feature): what an encoder needs of a dataset, with the record's id."""
    return df.select(F.col(id_column).cast("long").alias("offset"), F.lit(None).cast("string").alias("key"), F.col(feature).alias("feature"))


def _pooled(pooler: str, dim: int) -> Column:
    """The pooled tokens, or zeros where no token counts (the text is empty, say)."""
    some = F.exists("mask", lambda m: m)
    return F.when(some, POOLERS[pooler]("tokens", "mask")).otherwise(F.array_repeat(F.lit(0.0), dim))


def encode_feature(df: DataFrame, feature: str, encoder: Encoder | BatchEncoder, pooler: str = "mean", id_column: str = "sample_id") -> DataFrame:
    """(offset, key, vector) of a dataset's feature: encoded and pooled, the offset being the record's id."""
    rows = collate(df, feature, id_column)
    if isinstance(encoder, (BatchEncoder, TileEncoder)):
        return rows.select("offset", "key", encoder.vector(F.col("feature")).alias("vector"))
    tokens, mask = encoder.tokens(F.col("feature"))
    coded = rows.select("offset", "key", tokens.alias("tokens"), mask.alias("mask"))  # a step of its own, as poolers read it several times
    return coded.select("offset", "key", _pooled(pooler, encoder.dim).alias("vector"))


def encode_poolers(df: DataFrame, feature: str, encoder: Encoder, poolers: list[str], id_column: str = "sample_id") -> DataFrame:
    """(pooler, offset, key, vector): one pass over the texts whatever the number of poolers. Written with partitionBy("pooler"),
    each pooler's part is a space."""
    tokens, mask = encoder.tokens(F.col("feature"))
    coded = collate(df, feature, id_column).select("offset", "key", tokens.alias("tokens"), mask.alias("mask"))
    pooled = coded.select("offset", "key", *[_pooled(p, encoder.dim).alias(f"__{p}") for p in poolers])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pooler"), F.col(f"__{p}").alias("vector")) for p in poolers])).alias("r")
    return pooled.select("offset", "key", each).select("r.pooler", "offset", "key", "r.vector")


def add_encoding(encoded: DataFrame, path: str) -> None:
    """Add encoded rows to the space at `path`, which is made if need be. Rows whose offset is there already are left out, so that
    a batch that is repeated after a failure changes nothing; no row that exists is rewritten. Repeated offsets of one batch
    count once. Several writers at once need a table format with transactions."""
    spark, at = encoded.sparkSession, f"{path}/vectors"
    new = encoded.dropDuplicates(["offset"])
    if exists(spark, at):
        new = new.join(spark.read.parquet(at).select("offset"), "offset", "left_anti")
    new.select("offset", "key", "vector").write.mode("append").parquet(at)


def add_encodings(df: DataFrame, feature: str, encoder: Encoder, poolers: list[str], path: str, store_every: int | None = None, id_column: str = "sample_id") -> None:
    """Encode a dataset into one space per pooler below `path`, in batches of about `store_every` records (all at once if null)."""
    batches = 1 if store_every is None else max(1, -(-df.count() // store_every))
    for i in range(batches):
        part = df if batches == 1 else df.where(F.pmod(F.xxhash64(id_column), F.lit(batches)) == i)
        for pooler in poolers:  # each writes only new offsets
            add_encoding(encode_feature(part, feature, encoder, pooler, id_column), f"{path}/{pooler}")


# -- decoders


class Classifier:
    """A linear, deep (three layers) or SVC classifier of vectors on top of Spark ML."""

    def __init__(self, num_classes: int, input_dim: int | None = None, kind: str = "linear", max_iter: int = 50, seed: int = 0, **trainer) -> None:
        self.num_classes, self.input_dim, self.kind, self.max_iter, self.seed, self.trainer = num_classes, input_dim, kind, max_iter, seed, trainer
        self.model: Model | None = None

    def _estimator(self):
        named = {"featuresCol": "features", "labelCol": "label", "maxIter": self.max_iter} | self.trainer
        if self.kind == "linear":
            return LogisticRegression(**named)
        if self.kind == "deep":
            return MultilayerPerceptronClassifier(layers=[self.input_dim, self.input_dim, max(self.input_dim // 2, 1), self.num_classes], seed=self.seed, **named)
        return OneVsRest(classifier=LinearSVC(featuresCol="features", labelCol="label", maxIter=self.max_iter), featuresCol="features", labelCol="label")

    @staticmethod
    def _features(df: DataFrame, vector: str) -> DataFrame:
        return df.withColumn("features", array_to_vector(as_double(vector)))

    def fit(self, df: DataFrame, vector: str = "vector", label: str = "label") -> Classifier:
        rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(vector), F.col(label).cast("double").alias("label"))
        self.model = Pipeline(stages=[self._estimator()]).fit(self._features(rows, vector))
        return self

    def predict(self, df: DataFrame, vector: str = "vector", out: str = "prediction") -> DataFrame:
        if self.model is None:
            raise RuntimeError("the classifier is not fitted")
        made = self.model.transform(self._features(df, vector))
        return made.withColumn(out, F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", *([] if out == "prediction" else ["prediction"]))

    def scores(self, df: DataFrame, vector: str = "vector", out: str = "scores") -> DataFrame:
        """One number per class: what accuracy takes the greatest of."""
        made = self.model.transform(self._features(df, vector))
        column = vector_to_array("rawPrediction") if "rawPrediction" in made.columns else F.transform(F.sequence(F.lit(0), F.lit(self.num_classes - 1)), lambda i: (i == F.col("prediction").cast("int")).cast("double"))
        return made.withColumn(out, column).drop("features", "rawPrediction", "probability", "prediction")

    def score(self, df: DataFrame, vector: str = "vector", label: str = "label") -> dict[str, float]:
        made = self.predict(df.where(F.col(label).isNotNull()), vector).select(F.col(label).cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction")).cache()
        out = {m: MulticlassClassificationEvaluator(metricName=m).evaluate(made) for m in ("accuracy", "f1", "weightedPrecision", "weightedRecall")}
        made.unpersist()
        return out

    @property
    def properties(self) -> dict:
        return {"kind": self.kind, "num_classes": self.num_classes, "input_dim": self.input_dim, "max_iter": self.max_iter, "seed": self.seed}

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)
        write_text(SparkSession.active(), f"{path}/properties.json", json.dumps(self.properties, sort_keys=True))

    @staticmethod
    def load_properties(spark: SparkSession, path: str) -> dict:
        return json.loads(read_text(spark, f"{path}/properties.json"))

    def load(self, path: str) -> Classifier:
        self.model = PipelineModel.load(path)
        return self


class ColumnModel:
    """A function of a column with the properties that identify it."""

    def __init__(self, fn: Callable[[Column], Column], properties: dict | None = None) -> None:
        self.fn, self.properties = fn, dict(properties or {})

    def predict(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        return df.withColumn(vector, self.fn(F.col(vector)))


class PooledModel:
    """An encoder and a pooler as one model from a feature to a vector."""

    def __init__(self, encoder: Encoder, pooler: str = "mean") -> None:
        self.encoder, self.pooler, self.properties = encoder, pooler, {"encoder": type(encoder).__name__, "pooler": pooler}

    def predict(self, df: DataFrame, feature: str, id_column: str = "sample_id") -> DataFrame:
        return encode_feature(df, feature, self.encoder, self.pooler, id_column)


class StitchedModel:
    """The encoder side of one space with the decoder of another: a translator between them."""

    def __init__(self, translate: Callable[[DataFrame], DataFrame], decoder: Classifier) -> None:
        self.translate, self.decoder = translate, decoder

    def predict(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        return self.decoder.predict(self.translate(df), vector)


def fit_decoder(train: DataFrame, test: DataFrame, num_classes: int, catalog=None, properties: dict | None = None, vector: str = "vector", label: str = "label", **settings) -> tuple[Classifier, dict[str, float]]:
    """Fit on the training rows, score on the test rows and, with a catalog, store the decoder there."""
    model = Classifier(num_classes, **settings).fit(train, vector, label)
    scores = model.score(test, vector, label)
    if catalog is not None:
        catalog.add_item({"kind": model.kind, "num_classes": num_classes} | dict(properties or {}), lambda path: model.save(f"{path}/model"))
    return model, scores
