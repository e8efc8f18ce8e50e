"""Experiments over pairs of spaces and the planner that expands a benchmark into them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.align import Translator, pair
from orrery.operators.correspondence import Correspondence
from orrery.operators.encode import Classifier
from orrery.operators.measures import ROW_MEASURES
from orrery.operators.space import Space
from orrery.sources.catalog import content_id, resolve_items
from orrery.sources.files import read_text


class TaskType(str, Enum):
    LATENT, DOWNSTREAM, AGREEMENT = "latent", "downstream", "agreement"


class TaskProperty(str, Enum):
    ESTIMATOR, METRIC, CORRESPONDENCE = "estimator", "metric", "correspondence"


#: The rows an experiment gives.
RESULT = T.StructType([T.StructField("experiment", T.StringType()), T.StructField("estimator", T.StringType()), T.StructField("metric", T.StringType()), T.StructField("score", T.DoubleType())])

FACETS = ["fit_correspondence", "fit_x_space", "fit_y_space", "test_correspondence", "test_x_space", "test_y_space", "estimator"]


@dataclass
class Experiment:
    """Fit a translator on corresponding rows of two spaces, translate test rows and measure how near they come.

    Metrics are names of ROW_MEASURES. Downstream metrics need a decoder of the y space and the labels of its rows (offset,
    label): all of them or none.
    """

    x_fit: Space
    y_fit: Space
    fit_correspondence: Correspondence
    estimator: Translator
    x_test: Space
    y_test: Space
    test_correspondence: Correspondence
    latent_metrics: list[str] = field(default_factory=lambda: ["l2", "l1", "cosine"])
    y_decoder: Classifier | None = None
    y_labels: DataFrame | None = None
    downstream_metrics: list[str] | None = None

    def __post_init__(self) -> None:
        given = [self.y_decoder is not None, self.y_labels is not None, self.downstream_metrics is not None]
        if any(given) != all(given):
            raise ValueError("give all downstream arguments or none")

    @property
    def properties(self) -> dict[str, Any]:
        of = {k: getattr(self, k).properties for k in ("x_fit", "y_fit", "fit_correspondence", "x_test", "y_test", "test_correspondence")}
        metrics = {m: {"name": m} for m in [*self.latent_metrics, *(self.downstream_metrics or [])]}
        return of | {"estimator": {"name": self.estimator.name}, "metric": metrics}

    item_id = property(lambda self: content_id(self.properties))

    def estimation_stage(self) -> Translator:
        both = self.fit_correspondence.gather(self.x_fit.df, self.y_fit.df)
        side = lambda c: both.select("offset", F.col(c).alias("vector"))
        return self.estimator.fit(side("x"), side("y"))

    def transform_stage(self, estimator: Translator) -> tuple[DataFrame, DataFrame]:
        both = self.test_correspondence.gather(self.x_test.df, self.y_test.df)
        return estimator.transform(both.select("offset", F.col("x").alias("vector"))), both.select("offset", F.col("y").alias("vector"))

    def latent_evaluation_stage(self, x: DataFrame, y: DataFrame) -> dict[str, float]:
        if not self.latent_metrics:
            return {}
        return pair(x, y).agg(*[ROW_MEASURES[m](F.col("x"), F.col("y")).alias(m) for m in self.latent_metrics]).first().asDict()

    def downstream_evaluation_stage(self, x: DataFrame) -> dict[str, float]:
        if self.y_decoder is None:
            return {}
        labels = self.test_correspondence.df.join(self.y_labels.select(F.col("offset").alias("y_id"), "label"), "y_id").select(F.col("pos").alias("offset"), "label")
        scores = self.y_decoder.score(x.join(labels, "offset"))
        return {m: scores[m] for m in self.downstream_metrics}

    def run(self, estimator: Translator | None = None) -> DataFrame:
        """(experiment, estimator, metric, score), one row per metric."""
        fitted = estimator or self.estimation_stage()
        x, y = self.transform_stage(fitted)
        scores = self.latent_evaluation_stage(x, y) | self.downstream_evaluation_stage(x)
        rows = [(self.item_id, fitted.name, m, None if s is None else float(s)) for m, s in scores.items()]
        return x.sparkSession.createDataFrame(rows, RESULT)

    def export(self, results: DataFrame, selection: dict[str, list[str]]) -> DataFrame:
        """Results as a wide table with columns <part>/<property>; a part without properties is a column of the results."""
        properties, cols = self.properties, []
        for part, names in selection.items():
            for name in names:
                if part == "metric":
                    held = F.create_map(*[F.lit(x) for m, p in properties["metric"].items() for x in (m, _text(p.get(name)))])
                    cols.append(F.try_element_at(held, F.col("metric")).alias(f"metric/{name}"))
                else:
                    cols.append(F.lit(_text(properties[part].get(name))).alias(f"{part}/{name}"))
            if not names:
                cols.append(F.col(part))
        return results.select(*cols)


def _text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def export_properties(results: DataFrame, selection: dict[str, list[str]]) -> DataFrame:
    """The same for results that hold their properties as JSON text in a column per part: <part>/<property> columns."""
    cols: list[Column] = []
    for part, names in selection.items():
        cols += [F.get_json_object(part, f"$.{n}").alias(f"{part}/{n}") for n in names] or [F.col(part)]
    return results.select(*cols)


def resolve_benchmark(correspondences: DataFrame, spaces: DataFrame, policies: list[dict], metrics: dict[str, list[str]]) -> DataFrame:
    """Every experiment of every policy: ids of correspondences and spaces, estimator, metric and metric_type.

    Both catalogs are (item_id, properties). A policy names `estimators`, constraints for all its correspondences and spaces,
    a `fit` part and `tests`, each with a split and constraints of its own. Spaces meet correspondences by an equi-join on the
    name of the dataset, so that the plan grows with what fits and not with the catalogs.
    """
    spark, out = correspondences.sparkSession, None

    def part(policy: dict, one: dict, role: str) -> DataFrame:
        limits = policy.get("correspondence_constraints", {}) | one.get("correspondence_constraints", {})
        corr = resolve_items(correspondences, split=one["split"], **limits).select(F.col("item_id").alias(f"{role}_correspondence"), F.get_json_object("properties", "$.x_dataset").alias("xd"), F.get_json_object("properties", "$.y_dataset").alias("yd"))
        for side in "xy":
            wanted = policy.get("space_constraints", {}) | one.get(f"{side}_space_constraints", {})
            held = resolve_items(spaces, split=one["split"], **wanted).select(F.col("item_id").alias(f"{role}_{side}_space"), F.get_json_object("properties", "$.dataset").alias(f"{side}d"))
            corr = corr.join(held, f"{side}d")
        return corr.drop("xd", "yd")

    kinds = [(t, m) for t, names in metrics.items() for m in names]
    scored = F.explode(F.array(*[F.struct(F.lit(t).alias("metric_type"), F.lit(m).alias("metric")) for t, m in kinds]))
    for policy in policies:
        fit = part(policy, policy["fit"], "fit")
        tests = None
        for i, test in enumerate(policy["tests"]):
            one = part(policy, test, "test").withColumn("test", F.lit(i))
            tests = one if tests is None else tests.unionByName(one)
        if tests is None or not kinds or not policy["estimators"]:
            continue
        if tests.limit(100_001).count() > 100_000:
            raise ValueError("more than 100,000 test parts of one policy: its grid would be a cross product of two large sides")
        grid = fit.join(F.broadcast(tests), F.lit(True)).withColumn("estimator", F.explode(F.array(*[F.lit(e) for e in policy["estimators"]]))).withColumn("m", scored)
        grid = grid.select(*FACETS, "test", F.col("m.metric").alias("metric"), F.col("m.metric_type").alias("metric_type"))
        out = grid if out is None else out.unionByName(grid)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"{c} string" for c in FACETS) + ", test int, metric string, metric_type string")


def experiments_summary(experiments: DataFrame) -> DataFrame:
    """One row: the number of experiments and of distinct values of each facet; metrics count with their type."""
    return experiments.agg(F.count(F.lit(1)).alias("experiments"), *[F.countDistinct(c).alias(f"{c}s") for c in FACETS], F.countDistinct("metric", "metric_type").alias("metrics"))


def read_benchmark(spark: SparkSession, path: str) -> dict[str, Any]:
    """{"policies": [..], "metrics": {type: [name, ..]}} from a JSON file, or a YAML file where PyYAML is there."""
    text = read_text(spark, path)
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML needs PyYAML; give the benchmark as JSON") from e
        config = yaml.safe_load(text)
    else:
        config = json.loads(text)
    if not isinstance(config, dict) or not {"policies", "metrics"} <= set(config):
        raise ValueError("a benchmark has policies and metrics")
    return config


def write_benchmark(experiments: DataFrame, path: str) -> None:
    """The planned experiments as JSON lines, written by tasks."""
    experiments.write.json(path)


def load_benchmark(spark: SparkSession, path: str) -> DataFrame:
    kinds = ", ".join(f"{c} string" for c in FACETS) + ", test int, metric string, metric_type string"
    return spark.read.schema(kinds).json(path)


def benchmark_summary(spark: SparkSession, path: str) -> DataFrame:
    """experiments_summary of a stored benchmark."""
    return experiments_summary(load_benchmark(spark, path))
