"""Adding points from a stream: the streaming form of add_batch().

Encoding is a projection and works on a streaming DataFrame as on any other. Each
micro-batch is sorted and written as files of its own, named by its number, so a batch that
runs again after a failure replaces its own files and no point counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import INDEX, PointIndex, project


def ingest(points: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream of (id, lat, lng) to the index at path."""

    def save(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions("z_ord", "id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = project(points).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def load(spark: SparkSession, path: str) -> PointIndex:
    """What ingest() has written; each file is sorted, so Z-ranges skip row groups."""
    return PointIndex(spark.read.schema(f"{INDEX}, batch long").parquet(path).drop("batch"), True)


def compact(spark: SparkSession, path: str, into: str) -> PointIndex:
    """All batches that ingest() has written so far, sorted together into one index at `into`: one run instead of one for each batch."""
    return PointIndex(load(spark, path).frame).save(into)
