"""Readers of points, and the derived point tables that queries and tests use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, path: str, id: str = "id", lat: str = "lat", lng: str = "lng", format: str = "parquet", **options) -> DataFrame:
    """id, lat, lng from any format that Spark reads; no other column leaves the scan."""
    return spark.read.format(format).options(**options).load(path).select(F.col(id).cast("long").alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"))


def world(k: Column) -> tuple[Column, Column]:
    """A position on the globe from an integer key, by arithmetic that every engine does alike."""
    return ((k * 7919 + 13) % 17989) / F.lit(100.0) - F.lit(89.945), ((k * 104729 + 7) % 35993) / F.lit(100.0) - F.lit(179.965)


def dense(k: Column) -> tuple[Column, Column]:
    """A position in a square of a tenth of a degree."""
    return F.lit(-23.5505) + (((k * 7919 + 13) % 9973) / F.lit(9973.0) - F.lit(0.5)) * F.lit(0.1), F.lit(-46.6333) + (((k * 104729 + 7) % 9967) / F.lit(9967.0) - F.lit(0.5)) * F.lit(0.1)


def _points(df: DataFrame, key: Column, place=world, shift: int = 0) -> DataFrame:
    lat, lng = place(key + shift if shift else key)
    return df.select(key.alias("id"), lat.alias("lat"), lng.alias("lng"))


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def world_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(_load(spark, sf_dir, "customer"), F.col("c_custkey"))


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(_load(spark, sf_dir, "supplier"), F.col("s_suppkey"), shift=500_000).withColumnRenamed("id", "qid")


def dense_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(_load(spark, sf_dir, "events"), F.col("event_id"), dense)


def bulk_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(_load(spark, sf_dir, "lineitem"), F.col("l_orderkey") * 7 + F.col("l_linenumber"))


def messy_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions partly out of range."""
    k = F.col("o_orderkey")
    return _load(spark, sf_dir, "orders").select(k.alias("id"), (k % 401 - F.lit(200.0)).alias("lat"), (k % 1201 - F.lit(600.0)).alias("lng"))
