"""Session, scratch storage and size-checked broadcasts shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes a side may have to be broadcast; beyond them operators fall back to a shuffle join.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 256 << 20


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orrery")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, a temporary one only where that is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="orrery-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone
        pass


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orrery-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows and BROADCAST_BYTES bytes, else unchanged. Give it
    materialised or cheap frames: it counts them. Texts and arrays are measured, other columns count 8 bytes."""
    size = F.lit(8 * (len(df.columns) + 1))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array<"):
            size = size + 8 * F.greatest(F.size(name), F.lit(0)) if kind in ("array<int>", "array<bigint>", "array<double>", "array<float>") else size + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    rows, total = df.select(size.cast("long").alias("size")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("size")).first()
    return F.broadcast(df) if rows <= max_rows and (total or 0) <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
