"""The registered queries of the point engine and, beside each, the SQL it must equal."""

from __future__ import annotations

import re
from collections.abc import Callable
from tempfile import mkdtemp
from uuid import uuid4

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import info
from .constants import EARTH_RADIUS_KM, KM_PER_DEGREE
from .functions import geo, morton
from .operators import batch, joins, search
from .operators.index import PointIndex, project
from .plans.ranges import Box, box, build_ranges, build_ranges_adaptive, merge_ranges, ranges_frame, rings, z_bounds
from .sources import points as src
from .streaming import ingest

LAT, LNG = -23.5505, -46.6333
SOUTH_AMERICA = Box(-56.0, 13.0, -82.0, -34.0)
#: The regions whose points are counted.
REGIONS = [
    ("Sao Paulo Metro", -24.0, -23.2, -47.0, -46.0),
    ("Southeast Brazil", -25.0, -15.0, -53.0, -39.0),
    ("South America", -56.0, 13.0, -82.0, -34.0),
    ("Northern Hemisphere", 0.0, 90.0, -180.0, 180.0),
    ("World", -90.0, 90.0, -180.0, 180.0),
]
SWEEP, KS = [100.0, 500.0, 1000.0, 2000.0, 5000.0], [1, 5, 10, 50, 100]
KEYS = [morton.encode_ordered(a, b) for a, b in ((-90, -180), (LAT, LNG), (0.1, 0.1), (45.3, -120.7), (90, 180))]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- pieces of SQL ----------------------------------------------------------------


def _d(x: float) -> str:
    return f"({float(x)!r}::DOUBLE)"


def _world_sql(table: str, key: str, id: str = "id", shift: int = 0) -> str:
    k = f"({key} + {shift})" if shift else f"({key})"
    return f"SELECT {key} AS {id}, (({k} * 7919 + 13) % 17989) / 100.0::DOUBLE - 89.945::DOUBLE AS lat, (({k} * 104729 + 7) % 35993) / 100.0::DOUBLE - 179.965::DOUBLE AS lng FROM {table}"


WORLD = _world_sql("customer", "c_custkey")
BULK = _world_sql("lineitem", "l_orderkey * 7 + l_linenumber")
CENTERS = _world_sql("supplier", "s_suppkey", "qid", 500_000)
DENSE = "SELECT event_id AS id, -23.5505::DOUBLE + (((event_id * 7919 + 13) % 9973) / 9973.0::DOUBLE - 0.5::DOUBLE) * 0.1::DOUBLE AS lat, -46.6333::DOUBLE + (((event_id * 104729 + 7) % 9967) / 9967.0::DOUBLE - 0.5::DOUBLE) * 0.1::DOUBLE AS lng FROM events"
MESSY = "SELECT o_orderkey AS id, (o_orderkey % 401) - 200.0::DOUBLE AS lat, (o_orderkey % 1201) - 600.0::DOUBLE AS lng FROM orders"
# The masks that spread 32 bits to the even ones of 64, with their shifts.
MASKS = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _spread_ctes(name: str, columns: list[str]) -> str:
    out, last = [], name
    for i, (shift, mask) in enumerate(MASKS):
        step = ", ".join(f"(s_{c} | (s_{c} << {shift})) & {mask}::UBIGINT AS s_{c}" for c in columns)
        first = ", ".join(f"{c} AS s_{c}" for c in columns)
        base = f"(SELECT *, {first} FROM {last})" if not i else last
        keep = "* EXCLUDE (" + ", ".join(f"s_{c}" for c in columns) + ")"
        out.append(f"{name}_{i} AS (SELECT {keep}, {step} FROM {base})")
        last = f"{name}_{i}"
    return ", ".join(out)


def _axis_sql(col: str, low: float, span: float) -> str:
    high = low + span
    return f"CAST(trunc((least(greatest({col}, {_d(low)}), {_d(high)}) - {_d(low)}) / {_d(span)} * 4294967295.0::DOUBLE) AS UBIGINT)"


def _index_sql(points: str, name: str = "idx") -> str:
    """CTEs that end in `name` with the columns of an index, and lat and lng."""
    return (
        f"{name}_p AS ({points}), {name}_n AS (SELECT *, {_axis_sql('lat', -90.0, 180.0)} AS nlat, {_axis_sql('lng', -180.0, 360.0)} AS nlng FROM {name}_p), "
        f"{_spread_ctes(f'{name}_n', ['nlat', 'nlng'])}, "
        f"{name} AS (SELECT * EXCLUDE (s_nlat, s_nlng, nlat, nlng), CAST(nlat AS BIGINT) AS nlat, CAST(nlng AS BIGINT) AS nlng, nlat::DOUBLE / 4294967295.0::DOUBLE * 180.0::DOUBLE - 90.0::DOUBLE AS lat_q, "
        f"nlng::DOUBLE / 4294967295.0::DOUBLE * 360.0::DOUBLE - 180.0::DOUBLE AS lng_q, CAST((s_nlat::HUGEINT + 2 * s_nlng::HUGEINT) - 9223372036854775808::HUGEINT AS BIGINT) AS z_ord FROM {name}_n_4)"
    )


def _hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"sin(radians({lat2} - {lat1}) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lng2} - {lng1}) / 2) ** 2"
    return f"({_d(EARTH_RADIUS_KM)} * 2 * atan2(sqrt({a}), sqrt(greatest(0.0::DOUBLE, 1.0::DOUBLE - ({a})))))"


def _fast(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return f"sqrt((({lng2} - {lng1}) * cos(radians(({lat1} + {lat2}) / 2)) * {_d(KM_PER_DEGREE)}) ** 2 + (({lat2} - {lat1}) * {_d(KM_PER_DEGREE)}) ** 2)"


def _in(b: Box, lat: str = "lat_q", lng: str = "lng_q") -> str:
    return f"{lat} BETWEEN {_d(b.min_lat)} AND {_d(b.max_lat)} AND {lng} BETWEEN {_d(b.min_lng)} AND {_d(b.max_lng)}"


def _radius_sql(points: str, lat: float, lng: float, r: float) -> str:
    d = _hav(_d(lat), _d(lng), "lat_q", "lng_q")
    return f"WITH {_index_sql(points)} SELECT DISTINCT id, z_ord, lat_q AS lat, lng_q AS lng, round({d}, 6) AS distance_km FROM idx WHERE {_in(box(lat, lng, r))} AND {d} <= {_d(r)}"


def _box_columns(lat: str, lng: str, r: str) -> str:
    w = f"({r} / ({_d(KM_PER_DEGREE)} * cos(radians({lat}))))"
    h = f"({r} / {_d(KM_PER_DEGREE)})"
    return f"greatest({lat} - {h}, -90.0::DOUBLE) AS min_lat, least({lat} + {h}, 90.0::DOUBLE) AS max_lat, greatest({lng} - {w}, -180.0::DOUBLE) AS min_lng, least({lng} + {w}, 180.0::DOUBLE) AS max_lng"


def _knn_sql(k: int, most: float) -> str:
    radii = rings(most)
    ring = "CASE " + " ".join(f"WHEN {_in(box(LAT, LNG, r))} AND d <= {_d(r)} THEN {i}" for i, r in enumerate(radii)) + " END"
    return (
        f"WITH {_index_sql(WORLD)}, d AS (SELECT DISTINCT id, z_ord, lat_q, lng_q, {_hav(_d(LAT), _d(LNG), 'lat_q', 'lng_q')} AS d FROM idx), r AS (SELECT *, {ring} AS ring FROM d), "
        f"h AS (SELECT ring, sum(count(*)) OVER (ORDER BY ring) AS held FROM r WHERE ring IS NOT NULL GROUP BY ring), "
        f"c AS (SELECT coalesce(min(ring) FILTER (held >= {k}), {len(radii) - 1}) AS chosen FROM h) "
        f"SELECT id, z_ord, lat_q AS lat, lng_q AS lng, d FROM r, c WHERE ring <= chosen ORDER BY d, id LIMIT {k}"
    )


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols or ("distance_km",)})


def _index(points: DataFrame) -> PointIndex:
    """For one search over a scan there is nothing to gain from sorting first; the search's bounds prune as they can."""
    return PointIndex(project(points)).lazily_built()


# --- codes and scalar functions ----------------------------------------------------


@register(f"WITH {_index_sql(WORLD)} SELECT id, nlat, nlng, z_ord FROM idx")
def morton_encode(spark, sf_dir):
    return project(src.world_points(spark, sf_dir)).select("id", "nlat", "nlng", "z_ord")


@register(f"WITH {_index_sql(WORLD)} SELECT id, lat_q AS lat, lng_q AS lng FROM idx")
def morton_decode_roundtrip(spark, sf_dir):
    rows = batch.decode_batch(batch.encode_batch(src.world_points(spark, sf_dir)))
    return rows.select("id", "point.lat", "point.lng")


@register(f"WITH n AS (SELECT c_custkey AS id, ((c_custkey * 2654435761) % 4294967296)::UBIGINT AS n FROM customer), {_spread_ctes('n', ['n'])} SELECT id, CAST(n AS BIGINT) AS n, CAST(s_n AS BIGINT) AS spread, CAST(n AS BIGINT) AS compact FROM n_4")
def spread_compact_bits(spark, sf_dir):
    n = src._load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * F.lit(2654435761)) % F.lit(4294967296)).alias("n"))
    return batch.compact_bits_batch(batch.spread_bits_batch(n, "n"), "spread")


@register(f"WITH {_index_sql(WORLD)} SELECT round(max(e), 6) AS max_error_m, round(avg(e), 6) AS avg_error_m FROM (SELECT {_hav('lat', 'lng', 'lat_q', 'lng_q')} * 1000.0::DOUBLE AS e FROM idx)")
def encode_error_m(spark, sf_dir):
    rows = batch.decode_batch(batch.encode_batch(src.world_points(spark, sf_dir)))
    e = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("point.lat"), F.col("point.lng"))
    return rows.agg(F.round(F.max(e), 6).alias("max_error_m"), F.round(F.avg(e), 6).alias("avg_error_m"))


@register(f"SELECT id, round({_hav(_d(LAT), _d(LNG), 'lat', 'lng')}, 6) AS distance_km, round({_hav(_d(LAT), _d(LNG), 'lat', 'lng')} * 1000.0::DOUBLE, 3) AS distance_m FROM ({WORLD})")
def haversine_from_center(spark, sf_dir):
    rows = batch.haversine_batch(src.world_points(spark, sf_dir), LAT, LNG)
    return rows.select("id", F.round("distance_km", 6).alias("distance_km"), F.round(geo.haversine_m(LAT, LNG, F.col("lat"), F.col("lng")), 3).alias("distance_m"))


@register(f"SELECT id, round({_fast(_d(LAT), _d(LNG), 'lat', 'lng')}, 6) AS distance_km FROM ({WORLD})")
def fast_distance_from_center(spark, sf_dir):
    return _rounded(batch.fast_distance_batch(src.world_points(spark, sf_dir), LAT, LNG).select("id", "distance_km"))


@register(f"SELECT round(max(abs({_fast(_d(LAT), _d(LNG), 'lat', 'lng')} - {_hav(_d(LAT), _d(LNG), 'lat', 'lng')})), 6) AS max_error_km FROM ({DENSE})")
def fast_vs_exact_error(spark, sf_dir):
    lat, lng = F.col("lat"), F.col("lng")
    error = F.abs(geo.fast_distance_km(LAT, LNG, lat, lng) - geo.haversine_km(LAT, LNG, lat, lng))
    return src.dense_points(spark, sf_dir).agg(F.round(F.max(error), 6).alias("max_error_km"))


@register(f"SELECT id, round(min_lat, 9) AS min_lat, round(max_lat, 9) AS max_lat, round(min_lng, 9) AS min_lng, round(max_lng, 9) AS max_lng FROM (SELECT id, {_box_columns('lat', 'lng', _d(500))} FROM ({WORLD}))")
def bounding_boxes(spark, sf_dir):
    b = geo.bounding_box(F.col("lat"), F.col("lng"), 500.0)
    return src.world_points(spark, sf_dir).select("id", *[F.round(e, 9).alias(n) for n, e in b.items()])


@register(
    "SELECT id, lat BETWEEN -90 AND 90 AS valid_lat, lng BETWEEN -180 AND 180 AS valid_lng, lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AS valid, "
    "least(greatest(lat, -90.0::DOUBLE), 90.0::DOUBLE) AS clamped_lat, least(greatest(lng, -180.0::DOUBLE), 180.0::DOUBLE) AS clamped_lng, "
    f"CASE WHEN lng > 180 THEN lng - 360.0::DOUBLE * ceil((lng - 180.0::DOUBLE) / 360.0::DOUBLE) WHEN lng < -180 THEN lng + 360.0::DOUBLE * ceil((-180.0::DOUBLE - lng) / 360.0::DOUBLE) ELSE lng END AS wrapped_lng FROM ({MESSY})"
)
def validate_clamp_wrap(spark, sf_dir):
    lat, lng = F.col("lat"), F.col("lng")
    return src.messy_points(spark, sf_dir).select(
        "id", geo.is_valid_lat(lat).alias("valid_lat"), geo.is_valid_lng(lng).alias("valid_lng"), geo.is_valid_point(lat, lng).alias("valid"), geo.clamp_lat(lat).alias("clamped_lat"), geo.clamp_lng(lng).alias("clamped_lng"), geo.wrap_lng(lng).alias("wrapped_lng")
    )


@register(f"SELECT id, round(radians(lat), 12) AS lat_rad, round(degrees(radians(lng)), 9) AS lng_deg FROM ({WORLD})")
def radians_degrees(spark, sf_dir):
    return src.world_points(spark, sf_dir).select("id", F.round(geo.to_radians(F.col("lat")), 12).alias("lat_rad"), F.round(geo.to_degrees(geo.to_radians(F.col("lng"))), 9).alias("lng_deg"))


# --- index -------------------------------------------------------------------------


@register(f"WITH {_index_sql(WORLD)} SELECT id, z_ord, row_number() OVER (ORDER BY z_ord, id) AS position FROM idx")
def index_sorted_by_z(spark, sf_dir):
    """Positions from the built index: rows before in the same partition and in the partitions before."""
    from pyspark.sql import Window

    built = PointIndex(project(src.world_points(spark, sf_dir))).build(8).frame.withColumn("part", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("part").orderBy("z_ord", "id"))
    sizes = built.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.select(F.col("part").alias("part_"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return built.withColumn("inside", inside).join(F.broadcast(before), F.col("part") == F.col("part_")).select("id", "z_ord", (F.col("inside") + F.col("before")).alias("position"))


_KEYS_SQL = ", ".join(f"CAST('{k}' AS BIGINT)" for k in KEYS)


@register(f"WITH {_index_sql(WORLD)}, keys AS (SELECT unnest([{_KEYS_SQL}]) AS key) SELECT key, count(*) FILTER (z_ord < key) AS lower_bound, count(*) FILTER (z_ord <= key) AS upper_bound FROM keys, idx GROUP BY key")
def lower_upper_bound(spark, sf_dir):
    index, out = _index(src.world_points(spark, sf_dir)), None
    for k in KEYS:
        row = search.lower_bound(index, k).select(F.lit(k).alias("key"), F.col("position").alias("lower_bound")).join(search.upper_bound(index, k).select(F.lit(k).alias("key"), F.col("position").alias("upper_bound")), "key")
        out = row if out is None else out.unionByName(row)
    return out


# --- searches ----------------------------------------------------------------------


@register(_radius_sql(WORLD, LAT, LNG, 2000))
def radius_search(spark, sf_dir):
    return _rounded(search.radius_search(_index(src.world_points(spark, sf_dir)), LAT, LNG, 2000.0))


@register(_radius_sql(DENSE, LAT, LNG, 5))
def radius_search_dense(spark, sf_dir):
    return _rounded(search.radius_search(_index(src.dense_points(spark, sf_dir)), LAT, LNG, 5.0))


@register(_radius_sql(WORLD, 0, 179.5, 2000))
def radius_search_antimeridian(spark, sf_dir):
    return _rounded(search.radius_search(_index(src.world_points(spark, sf_dir)), 0.0, 179.5, 2000.0))


@register(_radius_sql(WORLD, 89.5, 0, 1000))
def radius_search_pole(spark, sf_dir):
    return _rounded(search.radius_search(_index(src.world_points(spark, sf_dir)), 89.5, 0.0, 1000.0))


@register(_radius_sql(BULK, LAT, LNG, 2000))
def radius_search_duplicates(spark, sf_dir):
    return _rounded(search.radius_search(_index(src.bulk_points(spark, sf_dir)), LAT, LNG, 2000.0))


@register(f"WITH {_index_sql(WORLD)} SELECT DISTINCT id, z_ord, lat_q AS lat, lng_q AS lng, round({_hav(_d(0), _d(179.5), 'lat_q', 'lng_q')}, 6) AS distance_km FROM idx WHERE {_hav(_d(0), _d(179.5), 'lat_q', 'lng_q')} <= 2000")
def radius_search_exact(spark, sf_dir):
    return _rounded(search.radius_search(_index(src.world_points(spark, sf_dir)), 0.0, 179.5, 2000.0, exact=True))


@register(f"WITH {_index_sql(WORLD)} SELECT id, z_ord, lat_q AS lat, lng_q AS lng FROM idx WHERE {_in(SOUTH_AMERICA)}")
def bbox_search(spark, sf_dir):
    return search.bbox_search(_index(src.world_points(spark, sf_dir)), *SOUTH_AMERICA)


@register(f"WITH {_index_sql(BULK)} SELECT id, z_ord, lat_q AS lat, lng_q AS lng FROM idx WHERE {_in(SOUTH_AMERICA)}")
def bbox_search_duplicates(spark, sf_dir):
    return search.bbox_search(_index(src.bulk_points(spark, sf_dir)), *SOUTH_AMERICA)


@register(f"WITH {_index_sql(WORLD)}, regions(name, a, b, c, d) AS (VALUES {', '.join(f'({n!r}, {_d(a)}, {_d(b)}, {_d(c)}, {_d(d)})' for n, a, b, c, d in REGIONS)}) SELECT name, count(id) AS n FROM regions LEFT JOIN idx ON lat_q BETWEEN a AND b AND lng_q BETWEEN c AND d GROUP BY name")
def bbox_region_counts(spark, sf_dir):
    regions = spark.createDataFrame(REGIONS, "name string, min_lat double, max_lat double, min_lng double, max_lng double")
    return joins.region_counts(regions, _index(src.world_points(spark, sf_dir)))


@register(f"SELECT id, z_ord, lat, lng, round(d, 6) AS distance_km FROM ({_knn_sql(10, 10000)})")
def knn_search(spark, sf_dir):
    return _rounded(search.knn_search(_index(src.world_points(spark, sf_dir)), LAT, LNG, 10, 10000.0))


@register(" UNION ALL ".join(f"SELECT {k} AS k, count(*) AS found, round(max(d), 6) AS farthest_km FROM ({_knn_sql(k, 10000)})" for k in KS))
def knn_sweep_farthest(spark, sf_dir):
    return _rounded(joins.knn_sweep(_index(src.world_points(spark, sf_dir)), LAT, LNG, KS, 10000.0), "farthest_km")


@register(f"WITH {_index_sql(BULK)} SELECT id, z_ord, lat_q AS lat, lng_q AS lng, round({_hav(_d(LAT), _d(LNG), 'lat_q', 'lng_q')}, 6) AS distance_km, row_number() OVER (ORDER BY {_hav(_d(LAT), _d(LNG), 'lat_q', 'lng_q')}, id, z_ord) AS position FROM (SELECT DISTINCT id, z_ord, lat_q, lng_q FROM idx) WHERE {_in(box(LAT, LNG, 1000))} AND {_hav(_d(LAT), _d(LNG), 'lat_q', 'lng_q')} <= 1000")
def sorted_by_distance(spark, sf_dir):
    from pyspark.sql import Window

    found = search.radius_search(_index(src.bulk_points(spark, sf_dir)), LAT, LNG, 1000.0)
    # the result of one search: its size is the caller's radius
    return _rounded(search.sort_by_distance(found, LAT, LNG).withColumn("position", F.row_number().over(Window.orderBy("distance_km", "id", "z_ord")).cast("long")))


_Z = z_bounds(box(LAT, LNG, 2000))


@register(
    f"WITH {_index_sql(BULK)}, scan AS (SELECT count(*) AS records_scanned FROM idx WHERE z_ord BETWEEN {_Z[0]} AND {_Z[1]}), hit AS (SELECT count(*) AS records_matched FROM (SELECT DISTINCT id, z_ord FROM idx WHERE {_in(box(LAT, LNG, 2000))} AND {_hav(_d(LAT), _d(LNG), 'lat_q', 'lng_q')} <= 2000)) "
    "SELECT records_scanned, records_matched, 1 AS ranges_checked FROM scan, hit"
)
def search_stats(spark, sf_dir):
    return search.radius_stats(_index(src.bulk_points(spark, sf_dir)), LAT, LNG, 2000.0)


_ZB = z_bounds(SOUTH_AMERICA)


@register(f"WITH {_index_sql(WORLD)} SELECT count(*) FILTER (z_ord BETWEEN {_ZB[0]} AND {_ZB[1]}) AS records_scanned, count(*) FILTER ({_in(SOUTH_AMERICA)}) AS records_matched, 1 AS ranges_checked FROM idx")
def bbox_stats(spark, sf_dir):
    return search.bbox_stats(_index(src.world_points(spark, sf_dir)), *SOUTH_AMERICA)


# --- masks -------------------------------------------------------------------------


@register(f"WITH {_index_sql(WORLD)} SELECT id, CAST(z_ord BETWEEN {_Z[0]} AND {_Z[1]} AS TINYINT) AS in_mask FROM idx")
def filter_range_mask(spark, sf_dir):
    return batch.filter_range(batch.encode_batch(src.world_points(spark, sf_dir)), *_Z).select("id", "in_mask")


@register(f"SELECT id, CAST({_in(SOUTH_AMERICA, 'lat', 'lng')} AS TINYINT) AS in_mask FROM ({WORLD})")
def filter_bbox_mask(spark, sf_dir):
    return batch.filter_bbox(src.world_points(spark, sf_dir), *SOUTH_AMERICA).select("id", "in_mask")


@register(f"SELECT id, CAST({_in(box(LAT, LNG, 2000), 'lat', 'lng')} AND {_hav(_d(LAT), _d(LNG), 'lat', 'lng')} <= 2000 AS TINYINT) AS in_mask, CAST({_hav(_d(LAT), _d(LNG), 'lat', 'lng')} <= 2000 AS TINYINT) AS in_circle FROM ({WORLD})")
def filter_radius_mask(spark, sf_dir):
    rows = batch.filter_radius(src.world_points(spark, sf_dir), LAT, LNG, 2000.0)
    return batch.filter_radius(rows, LAT, LNG, 2000.0, use_box=False, out="in_circle").select("id", "in_mask", "in_circle")


@register(f"SELECT CAST(count(*) FILTER ({_in(box(LAT, LNG, 2000), 'lat', 'lng')} AND {_hav(_d(LAT), _d(LNG), 'lat', 'lng')} <= 2000) AS BIGINT) AS matches FROM ({WORLD})")
def filter_radius_matches(spark, sf_dir):
    return batch.matches(batch.filter_radius(src.world_points(spark, sf_dir), LAT, LNG, 2000.0))


# --- many searches at once ----------------------------------------------------------


@register(f"WITH {_index_sql(WORLD)}, r(radius_km) AS (VALUES {', '.join(f'({_d(r)})' for r in SWEEP)}), b AS (SELECT radius_km, {_box_columns(_d(LAT), _d(LNG), 'radius_km')} FROM r) SELECT radius_km, count(id) AS n FROM b LEFT JOIN idx ON lat_q BETWEEN min_lat AND max_lat AND lng_q BETWEEN min_lng AND max_lng AND {_hav(_d(LAT), _d(LNG), 'lat_q', 'lng_q')} <= radius_km GROUP BY radius_km")
def radius_sweep(spark, sf_dir):
    return joins.radius_sweep(_index(src.world_points(spark, sf_dir)), LAT, LNG, SWEEP)


_JOINED = f"{_index_sql(WORLD)}, c AS (SELECT qid, lat AS c_lat, lng AS c_lng, {_box_columns('lat', 'lng', _d(1000))} FROM ({CENTERS}))"
_NEAR = f"lat_q BETWEEN min_lat AND max_lat AND lng_q BETWEEN min_lng AND max_lng AND {_hav('c_lat', 'c_lng', 'lat_q', 'lng_q')} <= 1000"


@register(f"WITH {_JOINED} SELECT qid, count(id) AS n FROM c LEFT JOIN idx ON {_NEAR} GROUP BY qid")
def distance_join_counts(spark, sf_dir):
    return joins.distance_join_counts(src.query_points(spark, sf_dir), _index(src.world_points(spark, sf_dir)), 1000.0)


@register(f"WITH {_JOINED} SELECT qid, id, z_ord, lat_q AS lat, lng_q AS lng, round({_hav('c_lat', 'c_lng', 'lat_q', 'lng_q')}, 6) AS distance_km FROM c JOIN idx ON {_NEAR}")
def distance_join(spark, sf_dir):
    return _rounded(joins.distance_join(src.query_points(spark, sf_dir), _index(src.world_points(spark, sf_dir)), 1000.0))


def _knn_join_sql(k: int, most: float) -> str:
    radii = rings(most)
    boxes = " UNION ALL ".join(f"SELECT qid, lat AS c_lat, lng AS c_lng, {i} AS ring, {_d(r)} AS r, {_box_columns('lat', 'lng', _d(r))} FROM ({CENTERS})" for i, r in enumerate(radii))
    d = _hav("c_lat", "c_lng", "lat_q", "lng_q")
    return (
        f"WITH {_index_sql(WORLD)}, b AS ({boxes}), m AS (SELECT qid, id, z_ord, lat_q, lng_q, min(ring) AS ring, min({d}) AS d FROM b JOIN idx ON lat_q BETWEEN min_lat AND max_lat AND lng_q BETWEEN min_lng AND max_lng AND {d} <= r GROUP BY ALL), "
        f"h AS (SELECT qid, ring, sum(count(*)) OVER (PARTITION BY qid ORDER BY ring) AS held FROM m GROUP BY qid, ring), c AS (SELECT qid, coalesce(min(ring) FILTER (held >= {k}), {len(radii) - 1}) AS chosen FROM h GROUP BY qid), "
        f"n AS (SELECT m.*, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM m JOIN c USING (qid) WHERE ring <= chosen) SELECT qid, CAST(rank AS INTEGER) AS rank, id, z_ord, lat_q AS lat, lng_q AS lng, round(d, 6) AS distance_km FROM n WHERE rank <= {k}"
    )


@register(_knn_join_sql(5, 5000))
def knn_join(spark, sf_dir):
    return _rounded(joins.knn_join(src.query_points(spark, sf_dir), _index(src.world_points(spark, sf_dir)), 5, 5000.0))


def _corners_sql(n: int) -> str:
    """The Z-range of each cell of an n by n grid over the search box, from its two corners."""
    b = box(LAT, LNG, 2000.0)
    at = lambda low, high, k: f"{_d(low)} + {k} * (({_d(high)} - {_d(low)}) / {n})"
    lat0, lng0 = at(b.min_lat, b.max_lat, "i"), at(b.min_lng, b.max_lng, "j")
    lat1, lng1 = at(b.min_lat, b.max_lat, "(i + 1)"), at(b.min_lng, b.max_lng, "(j + 1)")
    cells = f"(SELECT i, j FROM generate_series(0, {n - 1}) a(i), generate_series(0, {n - 1}) b(j))"
    points = f"SELECT i * {n} + j AS id, {lat0} AS lat, {lng0} AS lng FROM {cells} UNION ALL SELECT i * {n} + j, {lat1}, {lng1} FROM {cells}"
    return f"WITH {_index_sql(points)} SELECT CAST(id AS INTEGER) AS range_no, min(z_ord) AS z_min, max(z_ord) AS z_max FROM idx GROUP BY id"


@register(f"WITH {_index_sql(f'SELECT 0 AS id, {_d(box(LAT, LNG, 2000.0).min_lat)} AS lat, {_d(box(LAT, LNG, 2000.0).min_lng)} AS lng UNION ALL SELECT 0, {_d(box(LAT, LNG, 2000.0).max_lat)}, {_d(box(LAT, LNG, 2000.0).max_lng)}')} SELECT 0 AS range_no, min(z_ord) AS z_min, max(z_ord) AS z_max FROM idx")
def z_ranges(spark, sf_dir):
    return ranges_frame(spark, build_ranges(LAT, LNG, 2000.0))


@register(_corners_sql(8))
def z_ranges_adaptive(spark, sf_dir):
    return ranges_frame(spark, build_ranges_adaptive(LAT, LNG, 2000.0, 64, 3))


_CELLS = merge_ranges(build_ranges_adaptive(LAT, LNG, 2000.0, 64, 3))


@register(f"WITH {_index_sql(BULK)} SELECT DISTINCT id, z_ord FROM idx WHERE {' OR '.join(f'z_ord BETWEEN {a} AND {z}' for a, z in _CELLS)}")
def ranges_search(spark, sf_dir):
    ranges = build_ranges_adaptive(LAT, LNG, 2000.0, 64, 3)
    return search.ranges_search(_index(src.bulk_points(spark, sf_dir)), ranges).select("id", "z_ord")


@register(f"SELECT true AS available, 'Spark {pyspark.__version__}' AS name, 4096 AS batch_size")
def engine_info(spark, sf_dir):
    return info.engine_info(spark)


# --- a built index, its life, and what reads it -------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder in that of spark.checkpoint.dir, which executors share; where that is unset, a local master's own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return f"{top or mkdtemp(prefix='points-')}/points-{uuid4().hex}"


def _saved(points: DataFrame) -> PointIndex:
    """A built index, written and read back: searches meet it as Parquet with minima and maxima."""
    spark = points.sparkSession
    return PointIndex.create(spark).add_batch(points).build().save(_folder(spark))


@register(_radius_sql(WORLD, LAT, LNG, 2000))
def radius_search_saved(spark, sf_dir):
    return _rounded(search.radius_search(_saved(src.world_points(spark, sf_dir)), LAT, LNG, 2000.0))


@register(_radius_sql(BULK, 0, 0, 1500))
def radius_search_adaptive(spark, sf_dir):
    return _rounded(search.radius_search(_saved(src.bulk_points(spark, sf_dir)), 0.0, 0.0, 1500.0, level=3))


@register(f"WITH {_index_sql(BULK)} SELECT id, z_ord, lat_q AS lat, lng_q AS lng FROM idx WHERE {_in(Box(-10.0, 15.0, -12.0, 9.0))}")
def bbox_search_saved(spark, sf_dir):
    return search.bbox_search(_saved(src.bulk_points(spark, sf_dir)), -10.0, 15.0, -12.0, 9.0, level=3)


@register(f"SELECT id, z_ord, lat, lng, round(d, 6) AS distance_km FROM ({_knn_sql(10, 10000)})")
def knn_search_saved(spark, sf_dir):
    return _rounded(search.knn_search(_saved(src.world_points(spark, sf_dir)), LAT, LNG, 10, 10000.0))


@register(f"WITH {_JOINED} SELECT qid, count(id) AS n FROM c LEFT JOIN idx ON {_NEAR} GROUP BY qid")
def distance_join_counts_saved(spark, sf_dir):
    return joins.distance_join_counts(src.query_points(spark, sf_dir), _saved(src.world_points(spark, sf_dir)), 1000.0)


def _ring_stats_sql(k: int, most: float) -> str:
    parts = []
    for i, r in enumerate(rings(most)):
        z, d = z_bounds(box(LAT, LNG, r)), _hav(_d(LAT), _d(LNG), "lat_q", "lng_q")
        parts.append(f"SELECT {i} AS ring, (SELECT count(*) FROM idx WHERE z_ord BETWEEN {z[0]} AND {z[1]}) AS records_scanned, (SELECT count(*) FROM (SELECT DISTINCT id, z_ord FROM idx WHERE {_in(box(LAT, LNG, r))} AND {d} <= {_d(r)})) AS records_matched")
    last = len(parts) - 1
    return f"WITH {_index_sql(WORLD)}, r AS ({' UNION ALL '.join(parts)}) SELECT records_scanned, records_matched, 1 AS ranges_checked FROM r WHERE ring = (SELECT coalesce(min(ring) FILTER (records_matched >= {k}), {last}) FROM r)"


@register(_ring_stats_sql(10, 10000))
def knn_stats(spark, sf_dir):
    return search.knn_stats(_saved(src.world_points(spark, sf_dir)), LAT, LNG, 10, 10000.0)


@register(f"WITH {_index_sql(BULK)} SELECT id, z_ord, row_number() OVER (ORDER BY z_ord, id) AS by_z, row_number() OVER (ORDER BY id, z_ord) AS by_id FROM (SELECT DISTINCT id, z_ord FROM idx WHERE {_in(box(LAT, LNG, 1000))} AND {_hav(_d(LAT), _d(LNG), 'lat_q', 'lng_q')} <= 1000)")
def sorted_by_z_and_id(spark, sf_dir):
    """The places of one search's results in either order: of one sorted partition, as its size is the caller's radius."""
    found = search.radius_search(_index(src.bulk_points(spark, sf_dir)), LAT, LNG, 1000.0).select("id", "z_ord").coalesce(1)
    place = lambda rows, out: rows.select("id", "z_ord", (F.monotonically_increasing_id() + 1).alias(out))
    by_z = place(search.sort_by_z(found).coalesce(1), "by_z")
    return by_z.join(place(search.sort_by_id(found).coalesce(1), "by_id"), ["id", "z_ord"])


@register(f"SELECT id, true AS within_two_percent FROM ({WORLD})")
def approximate_distance(spark, sf_dir):
    rows = batch.haversine_batch(batch.haversine_batch(src.world_points(spark, sf_dir), LAT, LNG), LAT, LNG, out="near_km", approximate=True)
    return rows.select("id", (F.abs(F.col("near_km") - F.col("distance_km")) <= 0.02 * F.col("distance_km") + 20.0).alias("within_two_percent"))


#: The five points of the small demonstration.
DEMO = [(10, -23.55052, -46.633309), (11, -23.559, -46.64), (12, -23.5874162, -46.6576336), (13, -23.4542, -46.5333), (14, -22.9068, -43.1729)]
_DEMO_SQL = f"SELECT * FROM (VALUES {', '.join(f'({i}::BIGINT, {_d(a)}, {_d(b)})' for i, a, b in DEMO)}) t(id, lat, lng)"
_DEMO_AT = DEMO[0][1:]
_DEMO_D = _hav(_d(_DEMO_AT[0]), _d(_DEMO_AT[1]), "lat_q", "lng_q")


@register(
    f"WITH {_index_sql(_DEMO_SQL)} SELECT 'radius' AS search, id, round({_DEMO_D}, 6) AS distance_km FROM idx WHERE {_in(box(*_DEMO_AT, 5))} AND {_DEMO_D} <= 5 UNION ALL "
    f"SELECT 'nearest', id, d FROM (SELECT id, round({_DEMO_D}, 6) AS d FROM idx WHERE {_in(box(*_DEMO_AT, 100))} AND {_DEMO_D} <= 100 ORDER BY {_DEMO_D} LIMIT 3) UNION ALL "
    f"SELECT 'box', id, round({_DEMO_D}, 6) FROM idx WHERE {_in(Box(-24.0, -23.0, -47.0, -46.0))}"
)
def mini_demo(spark, sf_dir):
    """Points added one by one and together, cleared, added again and built; then each kind of search."""
    index = PointIndex.create(spark).add(99, 0.0, 0.0).clear()
    for row in DEMO[:2]:
        index = index.add(*row)
    index = index.add_batch(spark.createDataFrame(DEMO[2:], "id long, lat double, lng double")).build(2, persist=True)
    at = geo.haversine_km(*_DEMO_AT, F.col("lat"), F.col("lng"))
    found = {"radius": search.radius_search(index, *_DEMO_AT, 5.0), "nearest": search.knn_search(index, *_DEMO_AT, 3, 1000.0), "box": search.bbox_search(index, -24.0, -23.0, -47.0, -46.0)}
    out = None
    for name, rows in found.items():
        rows = rows.select(F.lit(name).alias("search"), "id", F.round(at, 6).alias("distance_km"))
        out = rows if out is None else out.unionByName(rows)
    index.destroy()
    return out


@register("SELECT name, (SELECT count(*) FROM customer) AS operations, true AS timed FROM (VALUES ('encode'), ('decode'), ('haversine'), ('filter_radius')) t(name)")
def benchmark_operations(spark, sf_dir):
    """Each batch operator timed once; times differ from run to run, so only that they are positive is a column."""
    began = geo.time_ms()
    runs = [info.benchmark(src.world_points(spark, sf_dir), n) for n in ("encode", "decode", "haversine", "filter_radius")]
    assert geo.time_ms() >= began
    return spark.createDataFrame([(r["name"], int(r["operations"]), r["ms"] > 0 and r["per_second"] > 0) for r in runs], "name string, operations long, timed boolean")


@register(f"WITH {_index_sql(DENSE)} SELECT id, z_ord FROM idx")
def stream_ingest(spark, sf_dir):
    """Points added from a stream of files, then compacted to one sorted index."""
    top = _folder(spark)
    src.dense_points(spark, sf_dir).repartition(3).write.parquet(f"{top}/in")
    points = spark.readStream.schema("id long, lat double, lng double").option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    ingest.ingest(points, f"{top}/batches", f"{top}/log", availableNow=True).awaitTermination()
    return ingest.compact(spark, f"{top}/batches", f"{top}/index").rows().select("id", "z_ord")
