"""What the engine runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .operators import batch
from .operators.index import PointIndex


def engine_info(spark: SparkSession) -> DataFrame:
    """available (whole-stage code generation is on), name, batch_size (rows of a columnar batch)."""
    on = spark.conf.get("spark.sql.codegen.wholeStage", "true") == "true"
    size = int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize", "4096"))
    return spark.createDataFrame([(on, f"Spark {spark.version}", size)], "available boolean, name string, batch_size int")


def benchmark(points: DataFrame, name: str) -> dict[str, float | str | int]:
    """Time of one batch operator over points (id, lat, lng): encode, decode, haversine or filter_radius."""
    encoded = PointIndex(points.sparkSession.createDataFrame([], "id long, nlat long, nlng long, lat_q double, lng_q double, z_ord long")).add_batch(points).frame
    run = {
        "encode": lambda: batch.encode_batch(points).agg(F.max("z_ord")),
        "decode": lambda: batch.decode_batch(encoded).agg(F.max("point.lat"), F.max("point.lng")),
        "haversine": lambda: batch.haversine_batch(points, -23.5505, -46.6333).agg(F.max("distance_km")),
        "filter_radius": lambda: batch.matches(batch.filter_radius(points, -23.5505, -46.6333, 2000.0)),
    }[name]
    began = geo.time_ms()
    run().collect()
    ms, n = geo.time_ms() - began, points.count()
    return {"name": name, "ms": ms, "operations": n, "per_second": n / ms * 1000.0}
