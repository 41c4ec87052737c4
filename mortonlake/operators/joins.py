"""Many searches at once: joins of an index with a table of centres, regions or radii.

Points have one grid cell; a centre or region is copied to the cells that its box
covers, and both sides meet by an equi-join on the cell, which Spark broadcasts,
shuffles or splits where a cell is crowded. Boxes that cover very many cells of
longitude (near a pole, or a whole hemisphere) meet by latitude band alone.
Points are made distinct before they meet centres, so pairs are never shuffled for that.
Counts make no pairs: see circles.py.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_KM, KM_PER_DEGREE, MAX_LAT, MAX_LNG, MIN_LAT, MIN_LNG
from ..functions.geo import bounding_box, haversine_km, is_valid_point, to_degrees
from ..plans.ranges import box, rings, z_bounds
from ..shipped import ship
from . import circles
from .index import PointIndex
from .search import inside, ring_of, without_duplicates

LEAST_CELL, MOST_CELL, MOST_CELLS = 0.01, 30.0, 64
LIMITS = ("min_lat", "max_lat", "min_lng", "max_lng")
POINT = ("id", "z_ord", "lat_q", "lng_q")
#: Points, and centres, of one cell that a task counts at once: more are dealt out. Grids of a nearest join, and cells of longitude that a centre may have in one.
CROWD, LEVELS, MOST_NEAR = 50_000, 12, 1024
WIDE = -(1 << 40)


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size))


def _bands(boxes: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Boxes copied to the cells, and those too wide for cells to the bands, that they cover."""
    first, last = _cell(F.col("min_lng"), size), _cell(F.col("max_lng"), size)
    bands = boxes.filter((F.col("min_lat") <= F.col("max_lat")) & (F.col("min_lng") <= F.col("max_lng"))).withColumn("__band", F.explode(F.sequence(_cell(F.col("min_lat"), size), _cell(F.col("max_lat"), size))))
    return bands.filter(last - first < MOST_CELLS).withColumn("__cell", F.explode(F.sequence(first, last))), bands.filter(last - first >= MOST_CELLS)


def _meet(boxes: DataFrame, points: DataFrame, size: float, test: Column) -> DataFrame:
    """Rows of boxes (with LIMITS) joined with the points inside them that pass test."""
    held = (F.col("lat_q") >= F.col("min_lat")) & (F.col("lat_q") <= F.col("max_lat")) & (F.col("lng_q") >= F.col("min_lng")) & (F.col("lng_q") <= F.col("max_lng")) & test
    narrow, wide = _bands(boxes, size)
    banded = points.withColumn("__band", _cell(F.col("lat_q"), size))
    celled = banded.withColumn("__cell", _cell(F.col("lng_q"), size))
    by_cell = narrow.join(celled, ["__band", "__cell"]).filter(held).drop("__band", "__cell")
    by_band = wide.join(banded, "__band").filter(held).drop("__band")
    return by_cell.unionByName(by_band)


def _size(degrees: float | None) -> float:
    return min(max(degrees or LEAST_CELL, LEAST_CELL), MOST_CELL)


def _boxes(centers: DataFrame, radius_km: float | None, cell: float | None, dedup: bool) -> tuple[DataFrame, float]:
    """qid, c_lat, c_lng, r and LIMITS of each centre (dedup: each different one), and the size of a cell."""
    c = centers.select("qid", F.col("lat").cast("double").alias("c_lat"), F.col("lng").cast("double").alias("c_lng"), (F.lit(float(radius_km)) if radius_km is not None else F.col("radius_km").cast("double")).alias("r"))
    if cell is None:
        most = radius_km if radius_km is not None else c.agg(F.max("r")).first()[0]
        cell = (most or 0.0) / KM_PER_DEGREE
    c = c.distinct() if dedup else c
    return c.select("*", *[e.alias(n) for n, e in bounding_box(F.col("c_lat"), F.col("c_lng"), F.col("r")).items()]), _size(cell)


def _split(boxes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Boxes whose qid no other has, and the others, if there are any: what these find can be the same rows."""
    again = boxes.groupBy("qid").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("qid").alias("again"))
    if again.isEmpty():
        return boxes, None
    same = F.col("qid").eqNullSafe(F.col("again"))
    return boxes.join(again, same, "left_anti"), boxes.join(again, same, "left_semi")


def _pairs(boxes: DataFrame, points: DataFrame, size: float) -> DataFrame:
    distance = haversine_km(F.col("c_lat"), F.col("c_lng"), F.col("lat_q"), F.col("lng_q"))
    found = _meet(boxes, points, size, distance <= F.col("r"))
    return found.select("qid", "id", "z_ord", F.col("lat_q").alias("lat"), F.col("lng_q").alias("lng"), distance.alias("distance_km"))


def distance_join(centers: DataFrame, index: PointIndex, radius_km: float | None = None, cell: float | None = None, dedup: bool = True) -> DataFrame:
    """qid, id, z_ord, lat, lng, distance_km: for each centre (qid, lat, lng[, radius_km]) what radius_search finds."""
    boxes, size = _boxes(centers, radius_km, cell, dedup)
    points = index.rows().select(*POINT)
    if not dedup:
        return _pairs(boxes, points, size)
    points = without_duplicates(points)
    once, again = _split(boxes)
    out = _pairs(once, points, size)
    return out if again is None else out.unionByName(_pairs(again, points, size).dropDuplicates(["qid", "id", "z_ord"]))


def _counts(boxes: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """qid, n of boxes that find something. A qid's points of different boxes are added up."""
    narrow, wide = _bands(boxes, size)
    copies, cell = narrow, F.array(_cell(F.col("lng_q"), size))
    if not wide.isEmpty():
        copies, cell = narrow.unionByName(wide.withColumn("__cell", F.lit(WIDE))), F.array(_cell(F.col("lng_q"), size), F.lit(WIDE))
    placed = points.select("*", _cell(F.col("lat_q"), size).alias("__band"), F.explode(cell).alias("__cell"))
    key = ["__band", "__cell"]
    held = placed.select(*key, F.lit(1).alias("p"), F.lit(0).alias("q")).union(copies.select(*key, F.lit(0), F.lit(1)))
    held = held.groupBy(*key).agg(*[F.ceil(F.sum(x) / CROWD).alias(f"__{x}") for x in "pq"])
    crowded = held.filter("__p > 0 and __q > 0 and (__p > 1 or __q > 1)").collect()  # a row for each CROWD points or copies at most
    if crowded:
        shares = boxes.sparkSession.createDataFrame(crowded, held.schema)
        placed, copies = placed.join(shares, key, "left"), copies.join(shares, key, "left")
        p, q = F.coalesce("__p", F.lit(1)), F.coalesce("__q", F.lit(1))
        placed = placed.withColumn("__p", F.pmod(F.xxhash64("id", "z_ord"), p)).withColumn("__q", F.explode(F.sequence(F.lit(0), q - 1)))
        copies = copies.withColumn("__q", F.pmod(F.xxhash64("qid", "c_lat", "c_lng", "r"), q)).withColumn("__p", F.explode(F.sequence(F.lit(0), p - 1)))
    else:
        placed, copies = (x.withColumn("__p", F.lit(0)).withColumn("__q", F.lit(0)) for x in (placed, copies))
    key += ["__p", "__q"]
    copies = copies.select(*key, "qid", "c_lat", "c_lng", "r", *LIMITS)
    kind = copies.schema["qid"].dataType.simpleString()
    ship(boxes.sparkSession)
    found = placed.select(*key, *POINT).groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(circles.counts, f"qid {kind}, n long")
    return found.groupBy("qid").agg(F.sum("n").alias("n"))


def distance_join_counts(centers: DataFrame, index: PointIndex, radius_km: float | None = None, cell: float | None = None) -> DataFrame:
    """qid, n for every centre, also those that find nothing. Points are counted cell by cell; no pairs are made."""
    boxes, size = _boxes(centers, radius_km, cell, True)
    once, again = _split(boxes)
    points = index.rows().select(*POINT)
    n = _counts(once, points, size)
    if again is not None:
        n = n.unionByName(_pairs(again, without_duplicates(points), size).dropDuplicates(["qid", "id", "z_ord"]).groupBy("qid").agg(F.count("*").alias("n")))
    return centers.select("qid").join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


def region_join(regions: DataFrame, index: PointIndex, cell: float = 10.0) -> DataFrame:
    """name, id, z_ord, lat, lng: the points in each region (name and LIMITS), duplicates too."""
    found = _meet(regions.select("name", *[F.col(c).cast("double").alias(c) for c in LIMITS]), index.rows(), _size(cell), F.lit(True))
    return found.select("name", "id", "z_ord", F.col("lat_q").alias("lat"), F.col("lng_q").alias("lng"))


def region_counts(regions: DataFrame, index: PointIndex, cell: float = 10.0) -> DataFrame:
    n = region_join(regions, index, cell).groupBy("name").agg(F.count("*").alias("n"))
    return regions.select("name").join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def _reach(left: DataFrame, points: DataFrame, k: int, radius_km: float) -> DataFrame:
    """Of centres whose cell, in some grid, has k points: the size of the finest such grid, and a radius that holds the whole cell.

    Cells of the widest grid lie inside the circle of radius_km and its box, whatever centre they have.
    """
    widest = radius_km / KM_PER_DEGREE / 1.5
    levels = max(1, min(LEVELS, math.ceil(math.log2(max(1.0, widest / LEAST_CELL)))))
    sizes = [widest / 2**i for i in range(levels)]
    cells = points.groupBy(_cell(F.col("lat_q"), sizes[-1]).alias("a"), _cell(F.col("lng_q"), sizes[-1]).alias("o")).agg(F.count("*").alias("n"))
    every = F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright("a", levels - 1 - i).alias("a"), F.shiftright("o", levels - 1 - i).alias("o")) for i in range(levels)])
    full = cells.select(F.explode(every).alias("at"), "n").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") >= k).select("at")
    size = F.element_at(F.array(*[F.lit(x) for x in sizes]), F.col("at.level") + 1)
    own = F.array(*[F.struct(F.lit(i).alias("level"), _cell(F.col("lat"), x).alias("a"), _cell(F.col("lng"), x).alias("o")) for i, x in enumerate(sizes)])
    corners = [haversine_km(F.col("lat"), F.col("lng"), (F.col("at.a") + i) * F.col("size"), (F.col("at.o") + j) * F.col("size")) for i in (0, 1) for j in (0, 1)]
    placed = left.filter(is_valid_point(F.col("lat"), F.col("lng"))).withColumn("at", F.explode(own)).withColumn("size", size).withColumn("r", F.greatest(*corners) * F.lit(1 + 1e-9) + F.lit(1e-6))
    angle, cosine = F.col("r") / F.lit(EARTH_RADIUS_KM), F.cos(F.radians("lat"))
    high = to_degrees(angle) + F.lit(1e-7)
    wide = F.when((F.col("lat") + high < MAX_LAT) & (F.col("lat") - high > MIN_LAT), to_degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / cosine))) + F.lit(1e-7)).otherwise(F.lit(360.0))
    placed = placed.withColumn("high", high).withColumn("wide", wide).filter((F.col("r") <= radius_km) & (F.least(F.col("wide") * 2, F.lit(360.0)) / F.col("size") < MOST_NEAR))
    best = placed.join(full, "at").groupBy("qid").agg(F.max_by(F.struct("lat", "lng", "size", "r", "high", "wide"), F.col("at.level")).alias("x"))
    return best.select("qid", "x.*")


def _nearest(near: DataFrame, points: DataFrame, radius_km: float) -> DataFrame:
    """What distance_join with radius_km finds around the centres of _reach, up to the radius of each."""
    c = near.select("qid", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"), "r", "size", "high", "wide")
    c = c.select("*", *[e.alias(n) for n, e in bounding_box(F.col("c_lat"), F.col("c_lng"), radius_km).items()])
    sizes = [r[0] for r in near.select("size").distinct().collect()]  # at most LEVELS
    if not sizes:
        sizes = [LEAST_CELL]
    cover = lambda low, high: F.sequence(_cell(low, F.col("size")), _cell(high, F.col("size")))
    c = c.withColumn("a", F.explode(cover(F.greatest(F.col("c_lat") - F.col("high"), F.col("min_lat")), F.least(F.col("c_lat") + F.col("high"), F.col("max_lat")))))
    c = c.withColumn("o", F.explode(cover(F.greatest(F.col("c_lng") - F.col("wide"), F.col("min_lng")), F.least(F.col("c_lng") + F.col("wide"), F.col("max_lng"))))).drop("high", "wide")
    placed = points.select("*", F.explode(F.array(*[F.lit(x) for x in sizes])).alias("size")).withColumn("a", _cell(F.col("lat_q"), F.col("size"))).withColumn("o", _cell(F.col("lng_q"), F.col("size")))
    distance = haversine_km(F.col("c_lat"), F.col("c_lng"), F.col("lat_q"), F.col("lng_q"))
    held = F.col("lat_q").between(F.col("min_lat"), F.col("max_lat")) & F.col("lng_q").between(F.col("min_lng"), F.col("max_lng")) & (distance <= F.col("r"))
    return c.join(placed, ["size", "a", "o"]).filter(held).select("qid", "id", "z_ord", F.col("lat_q").alias("lat"), F.col("lng_q").alias("lng"), distance.alias("distance_km"))


def knn_join(centers: DataFrame, index: PointIndex, k: int, max_radius_km: float) -> DataFrame:
    """qid, rank, id, z_ord, lat, lng, distance_km: for each centre what knn_search finds.

    Most centres are in a cell of some grid that has k points and lies inside the first ring: a circle around
    that cell has their k best, and they search nothing beyond it. The others go ring by ring: those that hold fewer than k points there go
    on to the next, of twice the radius, so most pairs of a wide ring are never made. The k best are taken as a ring ends.
    Rows that repeat a centre (qid, lat and lng) count once; a qid with several positions is searched
    from each, with ranks of its own for each. What a ring found (at most k rows a centre) is kept persisted for the result.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    radii = rings(max_radius_km)
    if not radii:
        raise ValueError("max_radius_km must be at least 1")
    at = F.struct("qid", "lat", "lng")
    left = centers.select("qid", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).distinct().select(at.alias("qid"), "lat", "lng")
    points = without_duplicates(index.rows().select(*POINT)).persist()
    best = Window.partitionBy("qid").orderBy("distance_km", "id", "z_ord")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    settled = _reach(left, points, k, radii[0]).persist()  # a row a centre
    out = ranked(_nearest(settled, points, radii[0]))
    left = left.join(settled.select(F.col("qid").alias("full")), F.col("qid") == F.col("full"), "left_anti").persist()
    for i, r in enumerate([] if left.isEmpty() else radii):
        boxes, size = _boxes(left, r, None, False)
        near = ranked(_pairs(boxes, points, size))
        last = i == len(radii) - 1
        near = near if last else near.persist()  # at most k rows a centre
        full = near.filter(F.col("rank") == k).select(F.col("qid").alias("full"))
        done = near if last else near.join(full, F.col("qid") == F.col("full"), "left_semi")
        out = out.unionByName(done)
        if not last:
            left = left.join(full, F.col("qid") == F.col("full"), "left_anti").persist()
            if left.isEmpty():
                break
    return out.select("qid.qid", "rank", "id", "z_ord", "lat", "lng", "distance_km")


def radius_sweep(index: PointIndex, lat: float, lng: float, radii: list[float]) -> DataFrame:
    """radius_km, n: how many points each radius finds, in one scan that works each distance out once."""
    wide = box(lat, lng, max(radii))
    near = index.rows().filter(inside(wide)).withColumn("d", haversine_km(lat, lng, F.col("lat_q"), F.col("lng_q")))
    tests = F.filter(F.array(*[F.when(inside(box(lat, lng, r)) & (F.col("d") <= r), F.lit(float(r))) for r in radii]), lambda x: x.isNotNull())
    hit = near.select("id", "z_ord", tests.alias("hit")).filter(F.size("hit") > 0).dropDuplicates(["id", "z_ord"])
    n = hit.select(F.explode("hit").alias("radius_km")).groupBy("radius_km").agg(F.count("*").alias("n"))
    every = index.spark.createDataFrame([(float(r),) for r in radii], "radius_km double")
    return every.join(n, "radius_km", "left").select("radius_km", F.coalesce("n", F.lit(0)).alias("n"))


def knn_sweep(index: PointIndex, lat: float, lng: float, ks: list[int], max_radius_km: float) -> DataFrame:
    """k, found, farthest_km of a search for each k around one centre.

    One scan: each k has its own ring, as a search with that k would choose it.
    """
    if min(ks) < 1:
        raise ValueError("k must be at least 1")
    radii = rings(max_radius_km)
    if not radii:
        raise ValueError("max_radius_km must be at least 1")
    boxes = [box(lat, lng, r) for r in radii]
    near = index.between(*z_bounds(boxes[-1])).filter(inside(boxes[-1])).withColumn("distance_km", haversine_km(lat, lng, F.col("lat_q"), F.col("lng_q")))
    near = near.withColumn("ring", ring_of(F.col("distance_km"), boxes, radii)).filter("ring is not null").select("id", "z_ord", "distance_km", "ring").dropDuplicates(["id", "z_ord"])
    counts = {r[0]: r[1] for r in near.groupBy("ring").count().collect()}  # at most four rows
    upto = [sum(counts.get(i, 0) for i in range(ring + 1)) for ring in range(len(radii))]
    parts = []
    for k in ks:
        ring = next((i for i, n in enumerate(upto) if n >= k), len(radii) - 1)
        best = near.filter(F.col("ring") <= ring).orderBy("distance_km", "id").limit(k)
        parts.append(best.agg(F.lit(int(k)).alias("k"), F.count("*").alias("found"), F.max("distance_km").alias("farthest_km")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
