"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.clusters import describe_clusters, similarity_clusters
from orrery.llm.edits import similar_groups
from orrery.llm.leaks import leaked_spans, remove_leaks
from orrery.llm.mixing import mixture, token_sizes
from orrery.llm.neighbours import nearest
from orrery.llm.overlap import cross_split_overlaps, held_coverage
from orrery.llm.proportional import proportional_sample, unmet
from orrery.llm.spans import shared_amounts, shared_spans
from orrery.llm.subset import varied_subset
from orrery.llm.vectors import valid_vectors
from orrery.runtime import materialize, table


def p1_varied_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_subset(table(spark, sf_dir, "space_vectors"), table(spark, sf_dir, "spaces"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_clusters(valid_vectors(table(spark, sf_dir, "space_vectors"), table(spark, sf_dir, "spaces"))).select("cluster_id", "vec_id")


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = valid_vectors(table(spark, sf_dir, "space_vectors"), table(spark, sf_dir, "spaces"))
    return describe_clusters(similarity_clusters(valid), valid)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split_overlaps(table(spark, sf_dir, "samples"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps by the split and source of the held-out record."""
    records = table(spark, sf_dir, "samples")
    pairs = materialize(cross_split_overlaps(records), "overlaps")
    split = F.lower(F.trim("split"))
    sides = records.select("sample_id", split.alias("split")).where(F.col("split").isin("train", "val", "test")).distinct()
    both = pairs.unionByName(pairs.select(F.col("sample_id_b").alias("sample_id_a"), F.col("sample_id_a").alias("sample_id_b")))
    held = both.join(sides, both["sample_id_a"] == sides["sample_id"]).where("split <> 'train'").select(F.col("sample_id_a").alias("held_id"), F.col("sample_id_b").alias("train_id"), "split")
    found = held.join(sides.where("split = 'train'").select(F.col("sample_id").alias("train_id")), "train_id").distinct()
    source = records.groupBy(F.col("sample_id").alias("held_id")).agg(F.min("source").alias("source"))
    return found.join(source, "held_id").groupBy("split", "source").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("held_id").alias("held_records"))


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each leaked held-out record stands in training, with its split and source."""
    records = table(spark, sf_dir, "samples")
    split = F.lower(F.trim("split"))
    about = records.where(split.isin("val", "test")).groupBy(F.col("sample_id").alias("held_id")).agg(F.min(split).alias("split"), F.min("source").alias("source"))
    return held_coverage(records).join(about, "held_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "samples"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmet(table(spark, sf_dir, "samples"), table(spark, sf_dir, "sample_targets")).select("target_id", F.col("y").cast("long").alias("y"))


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportional_sample(table(spark, sf_dir, "samples"), table(spark, sf_dir, "sample_targets"))[0].select("target_id", "sample_id", "y", "rank_no")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportional_sample(table(spark, sf_dir, "samples"), table(spark, sf_dir, "sample_targets"))[1].select("target_id", "y", "min_rows", "available", "seats", "short")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = valid_vectors(table(spark, sf_dir, "space_vectors"), table(spark, sf_dir, "spaces"))
    return nearest(valid, table(spark, sf_dir, "search_queries")).select("query_id", "vec_id")


def p6_neighbours(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """SearchResult rows of every vector whose id is divisible by 100, by the metric of its space (cosine where that is null)."""
    spaces = table(spark, sf_dir, "spaces")
    valid = valid_vectors(table(spark, sf_dir, "space_vectors"), spaces)
    metric = spaces.select("space_id", F.coalesce("metric", F.lit("cosine")).alias("metric"))
    asked = valid.where("vec_id % 100 = 0").join(F.broadcast(metric), "space_id").select(F.col("vec_id").alias("query_id"), "space_id", "vec_id", F.lit(k).alias("k"), "metric")  # the catalog of spaces
    found = nearest(valid, asked).join(valid.select("vec_id", F.col("vec_offset").alias("nbr_offset"), "space_id"), "vec_id").join(F.broadcast(metric), "space_id")
    distance = F.when(F.col("metric") == "l2", -F.col("score")).otherwise(F.col("score"))
    return found.select("query_id", "rank_no", "nbr_offset", (F.round(distance, 6) + F.lit(0.0)).alias("distance"))


def p6_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that the earlier run in search_results did not give."""
    valid = valid_vectors(table(spark, sf_dir, "space_vectors"), table(spark, sf_dir, "spaces"))
    found = nearest(valid, table(spark, sf_dir, "search_queries")).join(valid.select("vec_id", F.col("vec_offset").alias("nbr_offset")), "vec_id")
    return found.join(table(spark, sf_dir, "search_results"), ["query_id", "nbr_offset"], "left_anti").select("query_id", "vec_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p7_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = mixture(token_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))
    return report.where("capped").select("mix_id", "source")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(token_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(token_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))


def p9_shared_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_amounts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    from orrery.llm.sql import ORACLES

    return {name: sql for name, sql in ORACLES.items() if name in queries()}
