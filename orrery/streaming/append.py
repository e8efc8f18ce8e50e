"""Streams of encoded vectors: append to a space, and search against a standing index. Extensions of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.encode import add_encoding
from orrery.operators.search import SearchIndex


def append_stream(vectors: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of (offset, key, vector) to the space at `path`; the file sink's log makes each batch count once."""
    writer = vectors.writeStream.format("parquet").option("path", f"{path}/vectors").option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def append_batches(vectors: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The same through add_encoding, for sinks without a log of their own; a batch may come twice after a failure."""
    each = lambda batch, _: add_encoding(batch, path)
    return vectors.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def search_stream(queries: DataFrame, index: SearchIndex, k: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The k nearest rows of every query (query_id, vector) that comes in, appended to `path` with the batch's number."""

    def each(batch: DataFrame, number: int) -> None:
        index.search_knn(k, queries=batch, transform=True).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
