"""The point index: a DataFrame of quantised points, range-partitioned and sorted by Z-order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morton

POINTS = "id long, lat double, lng double"
INDEX = "id long, nlat long, nlng long, lat_q double, lng_q double, z_ord long"


class IndexNotBuiltError(ValueError):
    """A search needs a built index."""


def project(points: DataFrame, id: str = "id", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Points as index rows: the normalised axes, the decoded position and z_ord. Rows with a null or NaN coordinate are left out.

    The position comes from the axes and never from z_ord, which keeps expressions small.
    """
    axes = points.select(F.col(id).cast("long").alias("id"), morton.normalize_lat(F.col(lat)).alias("nlat"), morton.normalize_lng(F.col(lng)).alias("nlng"))
    axes = axes.filter(F.col("nlat").isNotNull() & F.col("nlng").isNotNull())
    nlat, nlng = F.col("nlat"), F.col("nlng")
    return axes.select("id", "nlat", "nlng", morton.denormalize_lat(nlat).alias("lat_q"), morton.denormalize_lng(nlng).alias("lng_q"), morton.interleave(nlat, nlng).alias("z_ord"))


class PointIndex:
    """Every method that changes points returns a new index. Only build() and load() give one that can be searched."""

    def __init__(self, frame: DataFrame, built: bool = False, persisted: bool = False) -> None:
        self.frame, self.built, self.persisted = frame, built, persisted

    @staticmethod
    def create(spark: SparkSession) -> PointIndex:
        return PointIndex(spark.createDataFrame([], INDEX))

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    def add(self, id: int, lat: float, lng: float) -> PointIndex:
        return self.add_rows([(id, lat, lng)])

    def add_rows(self, rows: Iterable[tuple[int, float, float]]) -> PointIndex:
        return self.add_batch(self.spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in rows], POINTS))

    def add_batch(self, points: DataFrame, id: str = "id", lat: str = "lat", lng: str = "lng") -> PointIndex:
        return PointIndex(self.frame.unionByName(project(points, id, lat, lng)))

    def build(self, partitions: int | None = None, persist: bool = False) -> PointIndex:
        """Sorted by (z_ord, id): the one shuffle of the index. Idempotent."""
        if self.built:
            return self
        by = ["z_ord", "id"]  # many points at one position are no single partition
        ranged = self.frame.repartitionByRange(partitions, *by) if partitions else self.frame.repartitionByRange(*by)
        out = ranged.sortWithinPartitions("z_ord", "id")
        return PointIndex(out.persist() if persist else out, True, persist)

    def lazily_built(self) -> PointIndex:
        """Searchable without a sort: right for one search over a scan, where nothing would be skipped anyway."""
        return PointIndex(self.frame, True)

    def clear(self) -> PointIndex:
        """An index without points; this one stays as it is."""
        return PointIndex.create(self.spark)

    def destroy(self) -> None:
        """Free what build(persist=True) keeps; a frame that the caller persisted is the caller's."""
        if self.persisted:
            self.frame.unpersist()

    def save(self, path: str, rows_per_file: int = 4_000_000) -> PointIndex:
        """As Parquet, sorted, so that a Z-range skips files, row groups and pages by their minima and maxima."""
        self.build().frame.write.option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(path)
        return PointIndex.load(self.spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> PointIndex:
        return PointIndex(spark.read.schema(INDEX).parquet(path), True)

    def rows(self) -> DataFrame:
        if not self.built:
            raise IndexNotBuiltError("build() the index before searching it")
        return self.frame

    def between(self, low: int | Column, high: int | Column) -> DataFrame:
        return self.rows().filter(F.col("z_ord").between(low, high))
