"""Angles, distances, boxes, validation: columns in, columns out."""

from __future__ import annotations

import math
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_KM, KM_PER_DEGREE, LEAST_COSINE, MAX_LAT, MAX_LNG, MIN_LAT, MIN_LNG


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def to_radians(deg) -> Column:
    return _c(deg) * F.lit(math.pi / 180.0)


def to_degrees(rad) -> Column:
    return _c(rad) * F.lit(180.0 / math.pi)


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance; rounding never makes it NaN."""
    p1, p2 = to_radians(lat1), to_radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((to_radians(lng2) - to_radians(lng1)) / 2), F.lit(2.0))
    # asin form of the same distance, mentioning `a` once
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    return haversine_km(lat1, lng1, lat2, lng2) * F.lit(1000.0)


def fast_distance_km(lat1, lng1, lat2, lng2) -> Column:
    """Equirectangular distance at the middle latitude; differences of longitude do not wrap."""
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    x = (lng2 - lng1) * F.cos(to_radians((lat1 + lat2) / 2)) * F.lit(KM_PER_DEGREE)
    y = (lat2 - lat1) * F.lit(KM_PER_DEGREE)
    return F.sqrt(x * x + y * y)


def bounding_box(lat, lng, radius_km) -> dict[str, Column]:
    """min_lat, max_lat, min_lng, max_lng around centres that are columns. Literal centres: plans.ranges.box."""
    lat, lng, r = map(_c, (lat, lng, radius_km))
    cosine = F.cos(to_radians(lat))
    cosine = F.when(F.abs(cosine) < LEAST_COSINE, F.lit(LEAST_COSINE)).otherwise(cosine)
    dlat, dlng = r / F.lit(KM_PER_DEGREE), r / (F.lit(KM_PER_DEGREE) * cosine)
    known = lat.isNotNull() & lng.isNotNull() & r.isNotNull()
    limits = {
        "min_lat": F.greatest(lat - dlat, F.lit(MIN_LAT)),
        "max_lat": F.least(lat + dlat, F.lit(MAX_LAT)),
        "min_lng": F.greatest(lng - dlng, F.lit(MIN_LNG)),
        "max_lng": F.least(lng + dlng, F.lit(MAX_LNG)),
    }
    return {n: F.when(known, e) for n, e in limits.items()}


def is_valid_lat(lat: Column) -> Column:
    """False for null, NaN and infinities too."""
    return F.coalesce(lat.between(MIN_LAT, MAX_LAT), F.lit(False))


def is_valid_lng(lng: Column) -> Column:
    return F.coalesce(lng.between(MIN_LNG, MAX_LNG), F.lit(False))


def is_valid_point(lat: Column, lng: Column) -> Column:
    return is_valid_lat(lat) & is_valid_lng(lng)


def clamp_lat(lat: Column) -> Column:
    return F.when(lat.isNotNull(), F.greatest(F.lit(MIN_LAT), F.least(F.lit(MAX_LAT), lat)))


def clamp_lng(lng: Column) -> Column:
    return F.when(lng.isNotNull(), F.greatest(F.lit(MIN_LNG), F.least(F.lit(MAX_LNG), lng)))


def wrap_lng(lng: Column) -> Column:
    """Into [-180, 180] by whole turns; both ends stay. Infinities give null."""
    lng = F.when(F.abs(lng) != float("inf"), lng)
    near = F.when(lng > MAX_LNG, lng - 360.0 * F.ceil((lng - MAX_LNG) / 360.0)).when(lng < MIN_LNG, lng + 360.0 * F.ceil((MIN_LNG - lng) / 360.0)).otherwise(lng)
    return F.when(F.abs(lng) < 1e15, near).otherwise(F.when(F.isnan(lng), lng).otherwise(lng % 360.0 - F.when(lng % 360.0 > MAX_LNG, 360.0).when(lng % 360.0 < MIN_LNG, -360.0).otherwise(0.0)))  # beyond, turns overflow a long


def time_ms() -> float:
    """A monotonic clock on the driver, in milliseconds."""
    return time.perf_counter() * 1000.0


# --- approximations: optional, a few parts in a thousand --------------------------


def approx_sin(x: Column) -> Column:
    """A Taylor polynomial to the 7th power, after a reduction to [-pi/2, pi/2]."""
    turned = x - F.lit(2 * math.pi) * F.round(x / F.lit(2 * math.pi))
    y = F.when(turned > math.pi / 2, F.lit(math.pi) - turned).when(turned < -math.pi / 2, F.lit(-math.pi) - turned).otherwise(turned)
    s = F.pow(y, F.lit(2.0))
    return y * (1 - s / 6 + s * s / 120 - s * s * s / 5040)


def approx_cos(x: Column) -> Column:
    return approx_sin(x + F.lit(math.pi / 2))


def approx_haversine_km(lat1, lng1, lat2, lng2) -> Column:
    p1, p2 = to_radians(lat1), to_radians(lat2)
    a = F.pow(approx_sin((p2 - p1) / 2), F.lit(2.0)) + approx_cos(p1) * approx_cos(p2) * F.pow(approx_sin((to_radians(lng2) - to_radians(lng1)) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))
