"""Radius, box and nearest-neighbour searches; bounds and statistics.

Results follow the quantised positions. A radius search is its box AND its circle: the box
counts 111.32 km to a degree, is clamped at the poles and the antimeridian and
does not wrap. exact=True searches by the great circle alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_KM, MAX_LAT, MAX_LNG, MIN_LAT, MIN_LNG
from ..functions.geo import haversine_km
from ..plans.ranges import Box, box, grid_ranges, merge_ranges, rings, z_bounds
from .index import PointIndex

RESULT = ("id", "z_ord", "lat", "lng", "distance_km")
#: Up to this k a nearest search holds its k rows on the driver.
DRIVER_ROWS = 10_000


def inside(b: Box, lat: str | Column = "lat_q", lng: str | Column = "lng_q") -> Column:
    lat, lng = (F.col(x) if isinstance(x, str) else x for x in (lat, lng))
    return lat.between(b.min_lat, b.max_lat) & lng.between(b.min_lng, b.max_lng)


def _distance(lat: float, lng: float) -> Column:
    return haversine_km(lat, lng, F.col("lat_q"), F.col("lng_q"))


def without_duplicates(rows: DataFrame, dedup: str = "exact") -> DataFrame:
    """One row of those with equal id and position; "adjacent": rows whose neighbour before in (z_ord, id) order has their id go; "none": all stay."""
    if dedup == "none":
        return rows
    if dedup == "exact":
        return rows.dropDuplicates(["id", "z_ord"])
    if dedup != "adjacent":
        raise ValueError(f"dedup: {dedup}")
    before = F.lag("id").over(Window.orderBy("z_ord", "id"))  # one task: for compatibility, over a Z-range only
    return rows.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("__before") != F.col("id"))).drop("__before")


def _circle(lat: float, lng: float, radius_km: float) -> list[Box]:
    """A box, or two across the antimeridian, that holds the whole great circle."""
    angle = radius_km / EARTH_RADIUS_KM
    dlat = math.degrees(angle) + 1e-9
    south, north = max(lat - dlat, MIN_LAT), min(lat + dlat, MAX_LAT)
    every = [Box(south, north, MIN_LNG, MAX_LNG)]
    if lat + dlat >= MAX_LAT or lat - dlat <= MIN_LAT or angle >= math.pi / 2:
        return every
    dlng = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) + 1e-9
    west, east = lng - dlng, lng + dlng
    if dlng >= 180:
        return every
    if west < MIN_LNG:
        return [Box(south, north, MIN_LNG, east), Box(south, north, west + 360, MAX_LNG)]
    if east > MAX_LNG:
        return [Box(south, north, west, MAX_LNG), Box(south, north, MIN_LNG, east - 360)]
    return [Box(south, north, west, east)]


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _within(index: PointIndex, b: Box, level: int) -> DataFrame:
    """The rows of a box's Z-range or, with a level, of the Z-ranges of a grid of 4**level cells over it, merged: fewer rows beside the box."""
    if not level:
        return index.between(*z_bounds(b))
    return index.rows().filter(_any([F.col("z_ord").between(low, high) for low, high in merge_ranges(grid_ranges(b, 1 << level))]))


def radius_search(index: PointIndex, lat: float, lng: float, radius_km: float, dedup: str = "exact", exact: bool = False, level: int = 0) -> DataFrame:
    """id, z_ord, lat, lng, distance_km of the points within radius_km. A negative radius finds none.

    level: search the Z-ranges of a grid over the box instead of its one range, which is long
    where the box lies across the equator, the prime meridian or another high bit.
    """
    if exact:
        boxes = _circle(lat, lng, radius_km)
        rows = index.rows().filter(_any([F.col("z_ord").between(*z_bounds(b)) for b in boxes]))
        box_test = _any([inside(b) for b in boxes])
    else:
        b = box(lat, lng, radius_km)
        rows, box_test = _within(index, b, 0 if dedup == "adjacent" else level), inside(b)
    if dedup == "adjacent":
        rows = without_duplicates(rows, dedup)
    rows = rows.filter(box_test).withColumn("distance_km", _distance(lat, lng)).filter(F.col("distance_km") <= radius_km)
    rows = rows if dedup == "adjacent" else without_duplicates(rows, dedup)
    return rows.select("id", "z_ord", F.col("lat_q").alias("lat"), F.col("lng_q").alias("lng"), "distance_km")


def bbox_search(index: PointIndex, min_lat: float, max_lat: float, min_lng: float, max_lng: float, level: int = 0) -> DataFrame:
    """id, z_ord, lat, lng of the points in the box, limits included, duplicates too. An inverted box finds none. level: as in radius_search."""
    b = Box(min_lat, max_lat, min_lng, max_lng)
    return _within(index, b, level).filter(inside(b)).select("id", "z_ord", F.col("lat_q").alias("lat"), F.col("lng_q").alias("lng"))


def ranges_search(index: PointIndex, ranges: list[tuple[int, int]]) -> DataFrame:
    """id, z_ord, lat, lng of the points in any of the Z-ranges, each once: merged first, so they reach the scan as few conditions."""
    condition = F.lit(False)
    for low, high in merge_ranges(ranges):
        condition = condition | F.col("z_ord").between(low, high)
    return without_duplicates(index.rows().filter(condition)).select("id", "z_ord", F.col("lat_q").alias("lat"), F.col("lng_q").alias("lng"))


def ring_of(distance: Column, boxes: list[Box], radii: list[float]) -> Column:
    """The first ring whose box and circle hold the row; null for none."""
    out = F.when(inside(boxes[0]) & (distance <= radii[0]), 0)
    for k in range(1, len(radii)):
        out = out.when(inside(boxes[k]) & (distance <= radii[k]), k)
    return out


def knn_search(index: PointIndex, lat: float, lng: float, k: int, max_radius_km: float, dedup: str = "exact") -> DataFrame:
    """The k nearest points by (distance, id), from the first ring that holds k of them, else the last.

    Rings start at a tenth of max_radius_km and double while within it (at most four), so
    points beyond the last are never found. One scan counts the rows of each ring; that
    names the first ring that can hold k. Duplicates are told apart within that ring's rows only, and
    where they leave fewer than k the next ring is tried. The k best come from that ring's own Z-range.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    radii = rings(max_radius_km)
    if not radii:
        raise ValueError("max_radius_km must be at least 1")
    boxes = [box(lat, lng, r) for r in radii]

    def upto(ring: int) -> DataFrame:
        rows = index.between(*z_bounds(boxes[ring]))
        if dedup == "adjacent":
            rows = without_duplicates(rows, dedup)
        rows = rows.filter(inside(boxes[ring])).withColumn("distance_km", _distance(lat, lng))
        return rows.withColumn("ring", ring_of(F.col("distance_km"), boxes, radii)).filter(F.col("ring") <= ring)

    counts = {r[0]: r[1] for r in upto(len(radii) - 1).groupBy("ring").count().collect()}  # at most four rows
    held = [sum(counts.get(i, 0) for i in range(ring + 1)) for ring in range(len(radii))]
    chosen = next((ring for ring, n in enumerate(held) if n >= k), len(radii) - 1)

    def best(ring: int) -> DataFrame:
        rows = upto(ring)
        rows = rows.dropDuplicates(["id", "z_ord"]) if dedup == "exact" else rows
        return rows.orderBy("distance_km", "id").limit(k).select("id", "z_ord", F.col("lat_q").alias("lat"), F.col("lng_q").alias("lng"), "distance_km")

    if dedup != "exact" or chosen == len(radii) - 1:
        return best(chosen)
    if k > DRIVER_ROWS:
        while chosen < len(radii) - 1 and best(chosen).count() < k:
            chosen += 1
        return best(chosen)
    found = best(chosen)
    rows = found.collect()  # at most DRIVER_ROWS
    while len(rows) < k and chosen < len(radii) - 1:
        chosen += 1
        rows = best(chosen).collect()
    return index.spark.createDataFrame(rows, found.schema)


def lower_bound(index: PointIndex, z_ord: int) -> DataFrame:
    """position: of the first row with a code of at least z_ord, in Z order."""
    return index.rows().filter(F.col("z_ord") < z_ord).agg(F.count("*").alias("position"))


def upper_bound(index: PointIndex, z_ord: int) -> DataFrame:
    """position: of the first row with a greater code."""
    return index.rows().filter(F.col("z_ord") <= z_ord).agg(F.count("*").alias("position"))


def sort_by_z(rows: DataFrame) -> DataFrame:
    return rows.orderBy("z_ord", "id")


def sort_by_id(rows: DataFrame) -> DataFrame:
    return rows.orderBy("id", "z_ord")


def sort_by_distance(rows: DataFrame, lat: float, lng: float) -> DataFrame:
    """Search results with distance_km from a centre, nearest first, ties by id."""
    return rows.withColumn("distance_km", haversine_km(lat, lng, F.col("lat"), F.col("lng"))).orderBy("distance_km", "id")


def top_k(rows: DataFrame, k: int, by: str = "distance_km") -> DataFrame:
    return rows.orderBy(by, "id").limit(k)


def radius_stats(index: PointIndex, lat: float, lng: float, radius_km: float, dedup: str = "exact") -> DataFrame:
    """records_scanned (of the Z-range, before duplicates go), records_matched, ranges_checked."""
    low, high = z_bounds(box(lat, lng, radius_km))
    scanned = index.between(low, high).agg(F.count("*").alias("n"))
    matched = radius_search(index, lat, lng, radius_km, dedup).agg(F.count("*").alias("m"))
    return _stats(scanned, matched)


def bbox_stats(index: PointIndex, min_lat: float, max_lat: float, min_lng: float, max_lng: float) -> DataFrame:
    b = Box(min_lat, max_lat, min_lng, max_lng)
    found = index.between(*z_bounds(b)).agg(F.count("*").alias("records_scanned"), F.count(F.when(inside(b), 1)).alias("records_matched"))
    return found.withColumn("ranges_checked", F.lit(1))


def knn_stats(index: PointIndex, lat: float, lng: float, k: int, max_radius_km: float) -> DataFrame:
    """Statistics of the last ring that the search tried."""
    radii = rings(max_radius_km)
    if k < 1 or not radii:
        raise ValueError("k and max_radius_km must be at least 1")
    for r in radii:
        stats = radius_stats(index, lat, lng, r)
        if r == radii[-1] or stats.first().records_matched >= k:
            return stats
    raise AssertionError


def _stats(scanned: DataFrame, matched: DataFrame) -> DataFrame:
    both = scanned.withColumn("one", F.lit(1)).join(matched.withColumn("one", F.lit(1)), "one")  # one row each
    return both.select(F.col("n").alias("records_scanned"), F.col("m").alias("records_matched"), F.lit(1).alias("ranges_checked"))
