"""Small files on whatever file system Spark uses: local, HDFS or object storage."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _fs(spark, path)
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(size)).decode("utf-8")
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    at, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)
