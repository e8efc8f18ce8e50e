"""Valid vectors of latent spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.runtime import checked_broadcast, materialize

_NAMES = ["vec_id", "space_id", "vec_offset", "sample_id", "label", "vector", "added_at"]


def is_valid(vector: Column, dim: Column) -> Column:
    """Not null, of the length `dim`, without null or NaN elements and not only zeros."""
    # array_contains is null where an element is null and none is NaN, and treats NaN as equal to itself; all of this stays in
    # generated code, unlike higher-order functions
    whole = ~F.array_contains(vector, F.lit(float("nan")).cast("float"))
    return F.coalesce((F.size(vector) == dim) & whole & ((F.array_max(vector) != 0) | (F.array_min(vector) != 0)), F.lit(False))


def valid_vectors(vectors: DataFrame, spaces: DataFrame) -> DataFrame:
    """(vec_id, space_id, vec_offset, sample_id, label, vector): one row for each vec_id with a valid vector of its space.

    Of repeated rows of one vec_id the earliest by `added_at` (null first), then the smallest of the other columns, counts.
    Vectors are not shuffled: only the ids are grouped, and just the rows whose id repeats are gathered. Rows with a null
    vec_id, or of a space that is unknown or has no dim, are left out; other columns are ignored.
    """
    dims = spaces.groupBy("space_id").agg(F.max("dim").alias("__dim")).where("space_id is not null and __dim is not null")
    rows = vectors.select(*_NAMES).where("vec_id is not null")
    repeated = checked_broadcast(materialize(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated"))
    single = rows.join(repeated, "vec_id", "left_anti").select(*_NAMES)
    again = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("added_at", *[c for c in _NAMES if c not in ("vec_id", "added_at")])).alias("r"))
    once = single.unionByName(again.select("vec_id", "r.*"))
    return once.join(checked_broadcast(dims), "space_id").where(is_valid(F.col("vector"), F.col("__dim"))).select(*_NAMES[:-1])


def sample_rows(vectors: DataFrame, size: int) -> DataFrame:
    """(space_id, vec_id, vector) of `size` rows of each space, chosen by a hash of vec_id: what models are fitted on.

    Rows are thinned by the hash before they are ranked, so that no task ranks a whole space.
    """
    counts = checked_broadcast(materialize(vectors.groupBy("space_id").agg(F.count(F.lit(1)).alias("rows")), "counts"))
    draw = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 20))
    few = vectors.select("space_id", "vec_id", "vector").join(counts, "space_id").withColumn("draw", draw).where(F.col("draw") * F.col("rows") <= F.lit(1.2 * size + 300) * (1 << 20))
    ranked = few.withColumn("n", F.row_number().over(Window.partitionBy("space_id").orderBy("draw", "vec_id")))
    return ranked.where(F.col("n") <= size).select("space_id", "vec_id", "vector")
