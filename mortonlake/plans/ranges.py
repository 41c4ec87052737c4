"""Boxes, rings and Z-ranges of literal centres, in plain Python on the driver."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..constants import KM_PER_DEGREE, LEAST_COSINE, MAX_LAT, MAX_LNG, MIN_LAT, MIN_LNG
from ..functions.morton import encode_int, ordered_int


class Box(NamedTuple):
    min_lat: float
    max_lat: float
    min_lng: float
    max_lng: float


def box(lat: float, lng: float, radius_km: float) -> Box:
    """The search box; each limit is clamped on its own side only and nothing wraps."""
    cosine = math.cos(lat * (math.pi / 180.0))
    if abs(cosine) < LEAST_COSINE:
        cosine = LEAST_COSINE
    dlat, dlng = radius_km / KM_PER_DEGREE, radius_km / (KM_PER_DEGREE * cosine)
    return Box(max(lat - dlat, MIN_LAT), min(lat + dlat, MAX_LAT), max(lng - dlng, MIN_LNG), min(lng + dlng, MAX_LNG))


def z_bounds(b: Box) -> tuple[int, int]:
    """z_ord of the two corners, in order: a superset of the box, as codes grow with either axis."""
    a, z = ordered_int(encode_int(b.min_lat, b.min_lng)), ordered_int(encode_int(b.max_lat, b.max_lng))
    return min(a, z), max(a, z)


def build_ranges(lat: float, lng: float, radius_km: float, most: int = 16) -> list[tuple[int, int]]:
    """Z-ranges of a circle's box as z_ord, both ends included.

    The four ranges between the centre and the corners all hold the centre's code, so
    they always merge to the one range between the box's least and greatest corner.
    """
    if most < 1:
        return []
    return [z_bounds(box(lat, lng, radius_km))]


def build_ranges_adaptive(lat: float, lng: float, radius_km: float, most: int, level: int) -> list[tuple[int, int]]:
    """A range for each cell of a grid over the box, row by row; neighbours share their corners."""
    if most < 1:
        return []
    n = 1 << max(0, level)
    if n * n > most:
        n = math.isqrt(most)
    return grid_ranges(box(lat, lng, radius_km), n)


def grid_ranges(b: Box, n: int) -> list[tuple[int, int]]:
    """A range for each cell of an n by n grid over a box, row by row."""
    dlat, dlng = (b.max_lat - b.min_lat) / n, (b.max_lng - b.min_lng) / n
    out = []
    for i in range(n):
        for j in range(n):
            cell = Box(b.min_lat + i * dlat, b.min_lat + (i + 1) * dlat, b.min_lng + j * dlng, b.min_lng + (j + 1) * dlng)
            out.append(z_bounds(cell))
    return out


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The fewest ranges with the same union, in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def ranges_frame(spark: SparkSession, ranges: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, a, z) for i, (a, z) in enumerate(ranges)], "range_no int, z_min long, z_max long")


def rings(max_radius_km: float) -> list[float]:
    """Radii that a nearest-neighbour search tries: from a tenth of the limit (1 km at least), doubling while within it."""
    out, r = [], max(max_radius_km / 10.0, 1.0)
    while r <= max_radius_km:
        out.append(r)
        r *= 2.0
    return out
