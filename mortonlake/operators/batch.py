"""Batch operators over columns of raw coordinates: projections and masks, with no index.

Masks are TINYINT 1 or 0, and 0 where a coordinate is null or NaN; their sum counts the matches.
Unlike searches they test the coordinates as given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, morton
from ..plans.ranges import Box, box
from .search import inside


def _mask(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("tinyint")


def encode_batch(df: DataFrame, lat: str = "lat", lng: str = "lng", out: str = "z_ord") -> DataFrame:
    return df.withColumn(out, morton.encode(F.col(lat), F.col(lng)))


def decode_batch(df: DataFrame, z_ord: str = "z_ord", out: str = "point") -> DataFrame:
    return df.withColumn(out, morton.decode(F.col(z_ord)))


def haversine_batch(df: DataFrame, lat: float, lng: float, out: str = "distance_km", lat_col: str = "lat", lng_col: str = "lng", approximate: bool = False) -> DataFrame:
    f = geo.approx_haversine_km if approximate else geo.haversine_km
    return df.withColumn(out, f(lat, lng, F.col(lat_col), F.col(lng_col)))


def fast_distance_batch(df: DataFrame, lat: float, lng: float, out: str = "distance_km", lat_col: str = "lat", lng_col: str = "lng") -> DataFrame:
    return df.withColumn(out, geo.fast_distance_km(lat, lng, F.col(lat_col), F.col(lng_col)))


def filter_range(df: DataFrame, low: int, high: int, z_ord: str = "z_ord", out: str = "in_mask") -> DataFrame:
    return df.withColumn(out, _mask(F.col(z_ord).between(low, high)))


def filter_bbox(df: DataFrame, min_lat: float, max_lat: float, min_lng: float, max_lng: float, lat: str = "lat", lng: str = "lng", out: str = "in_mask") -> DataFrame:
    return df.withColumn(out, _mask(inside(Box(min_lat, max_lat, min_lng, max_lng), lat, lng)))


def filter_radius(df: DataFrame, center_lat: float, center_lng: float, radius_km: float, lat: str = "lat", lng: str = "lng", use_box: bool = True, out: str = "in_mask") -> DataFrame:
    """Box and circle; use_box=False: the circle alone."""
    near = geo.haversine_km(center_lat, center_lng, F.col(lat), F.col(lng)) <= radius_km
    return df.withColumn(out, _mask(inside(box(center_lat, center_lng, radius_km), lat, lng) & near if use_box else near))


def matches(df: DataFrame, mask: str = "in_mask") -> DataFrame:
    return df.agg(F.coalesce(F.sum(mask), F.lit(0)).cast("long").alias("matches"))


def spread_bits_batch(df: DataFrame, col: str, out: str = "spread") -> DataFrame:
    return df.withColumn(out, morton.spread_bits(F.col(col)))


def compact_bits_batch(df: DataFrame, col: str, out: str = "compact") -> DataFrame:
    return df.withColumn(out, morton.compact_bits(F.col(col)))
