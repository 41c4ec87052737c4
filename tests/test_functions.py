"""Codes, distances, boxes and validation, with values known beforehand."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mortonlake.functions import geo, morton
from mortonlake.plans.ranges import box, build_ranges, build_ranges_adaptive, rings, z_bounds

# Cities and four distances between them in km.
CITIES = [
    ("Sao Paulo", -23.5505200, -46.6333090),
    ("Rio de Janeiro", -22.9068467, -43.1728965),
    ("New York", 40.7127753, -74.0059728),
    ("London", 51.5073509, -0.1277583),
    ("Tokyo", 35.6761919, 139.6503106),
    ("Sydney", -33.8688197, 151.2092955),
    ("Paris", 48.8566140, 2.3522219),
    ("Moscow", 55.7558260, 37.6172999),
    ("Dubai", 25.2048493, 55.2707828),
    ("Singapore", 1.3521150, 103.8198422),
    ("Cape Town", -33.9248685, 18.4240553),
    ("Buenos Aires", -34.6036844, -58.3815591),
    ("Mumbai", 19.0759837, 72.8776559),
    ("Beijing", 39.9041999, 116.4073963),
    ("Los Angeles", 34.0522342, -118.2436849),
]
DISTANCES = [(0, 1, 360.7), (2, 6, 5837.2), (3, 7, 2500.5), (4, 9, 5311.2)]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("n", [0, 1, 255, 65535, 0xFFFFFFFF, 0x12345678, 0xDEADBEEF])
def test_spread_and_compact(spark, n):
    z = morton.spread_int(n)
    assert morton.compact_int(z) == n
    assert morton.compact_int(z | 0xAAAAAAAAAAAAAAAA) == n
    assert value(spark, morton.spread_bits(F.lit(n).cast("long"))) == z
    assert value(spark, morton.compact_bits(morton.spread_bits(F.lit(n).cast("long")))) == n


def test_spread_values():
    assert morton.spread_int(3) == 0x5 and morton.spread_int(15) == 0x55


@settings(max_examples=200, deadline=None)
@given(st.floats(-90, 90), st.floats(-180, 180))
def test_decoded_is_just_below(lat, lng):
    a, b = morton.decode_int(morton.encode_int(lat, lng))
    assert -1e-12 <= lat - a < 4.3e-8 and -1e-12 <= lng - b < 8.5e-8


def test_columns_equal_driver(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-95, 95), rng.uniform(-190, 190)) for _ in range(2000)] + [(a, b) for a in (-90.0, 0.0, 90.0) for b in (-180.0, 0.0, 180.0)]
    df = spark.createDataFrame(rows, "lat double, lng double")
    got = df.select("lat", "lng", morton.encode(F.col("lat"), F.col("lng")).alias("z")).select("*", morton.unsigned(F.col("z")).alias("u"), morton.decode(F.col("z")).alias("p")).collect()
    for r in got:
        z = morton.encode_int(r.lat, r.lng)
        assert r.z == morton.ordered_int(z) and int(r.u) == z
        assert (r.p.lat, r.p.lng) == morton.decode_int(z)


def test_null_nan_and_clamping(spark):
    rows = [(None, 0.0), (float("nan"), 0.0), (-100.0, -200.0), (float("inf"), float("-inf"))]
    got = [r.z for r in spark.createDataFrame(rows, "lat double, lng double").select(morton.encode(F.col("lat"), F.col("lng")).alias("z")).collect()]
    assert got == [None, None, morton.encode_ordered(-90, -180), morton.encode_ordered(90, -180)]


def test_z_distances():
    base = morton.encode_int(-23.5505, -46.6333)
    assert abs(base - morton.encode_int(-23.5495, -46.6323)) == 770360913
    assert abs(base - morton.encode_int(-13.5505, -36.6333)) == 609689249138401650


def test_cities_roundtrip():
    for _, lat, lng in CITIES:
        a, b = morton.decode_int(morton.encode_int(lat, lng))
        assert abs(a - lat) < 5e-5 and abs(b - lng) < 5e-5


def test_distances(spark):
    for i, j, km in DISTANCES:
        d = value(spark, geo.haversine_km(CITIES[i][1], CITIES[i][2], CITIES[j][1], CITIES[j][2]))
        assert abs(d - km) < 0.06
        assert value(spark, geo.haversine_m(*CITIES[i][1:], *CITIES[j][1:])) == pytest.approx(d * 1000)
        assert value(spark, geo.approx_haversine_km(*CITIES[i][1:], *CITIES[j][1:])) == pytest.approx(d, rel=0.01)
    assert value(spark, geo.haversine_km(1.0, 2.0, 1.0, 2.0)) == 0
    assert value(spark, geo.haversine_km(0.0, 0.0, 0.0, 180.0)) == pytest.approx(math.pi * 6371.0088)
    exact, fast = (value(spark, f(-23.5505, -46.6333, -23.56, -46.64)) for f in (geo.haversine_km, geo.fast_distance_km))
    assert round(exact, 4) == 1.2579 and round(fast, 4) == 1.2593


def test_symmetry_and_triangle(spark):
    rows = [(a[1], a[2], b[1], b[2], c[1], c[2]) for a in CITIES[:6] for b in CITIES[3:9] for c in CITIES[8:12]]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    h = geo.haversine_km
    c = F.col
    bad = df.filter((F.abs(h(c("a"), c("b"), c("c"), c("d")) - h(c("c"), c("d"), c("a"), c("b"))) > 1e-6) | (h(c("a"), c("b"), c("e"), c("f")) > h(c("a"), c("b"), c("c"), c("d")) + h(c("c"), c("d"), c("e"), c("f")) + 1e-3))
    assert bad.isEmpty()


def test_validate_clamp_wrap(spark):
    v = lambda f, x: value(spark, f(F.lit(x).cast("double")))
    assert [v(geo.is_valid_lat, x) for x in (90, -90, 91, -91, float("nan"), None)] == [True, True, False, False, False, False]
    assert [v(geo.is_valid_lng, x) for x in (180, -180, 181, float("inf"))] == [True, True, False, False]
    assert [v(geo.clamp_lat, x) for x in (100, -100, 45)] == [90, -90, 45]
    assert [v(geo.clamp_lng, x) for x in (200, -200)] == [180, -180]
    assert [v(geo.wrap_lng, x) for x in (0, 180, -180, 270, -270, 540, float("inf"))] == [0, 180, -180, -90, 90, 180, None]


def test_box_columns_equal_driver(spark):
    for lat, lng, r in ((0, 0, 100), (60, 179, 500), (-89.99, 10, 50), (90, 0, 10), (10, 10, -5)):
        cols = geo.bounding_box(F.lit(float(lat)), F.lit(float(lng)), F.lit(float(r)))
        got = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
        assert tuple(got) == pytest.approx(tuple(box(lat, lng, r)))


def test_rings():
    assert rings(1000) == [100, 200, 400, 800] and rings(5) == [1, 2, 4] and rings(1) == [1] and rings(0.5) == []


@settings(max_examples=100, deadline=None)
@given(st.floats(-85, 85), st.floats(-179, 179), st.floats(0.1, 3000), st.floats(0, 1), st.floats(0, 1))
def test_ranges_cover_the_box(lat, lng, r, s, t):
    b = box(lat, lng, r)
    z = morton.encode_ordered(b.min_lat + s * (b.max_lat - b.min_lat), b.min_lng + t * (b.max_lng - b.min_lng))
    assert any(a <= z <= c for a, c in build_ranges(lat, lng, r))
    for level in (0, 2, 3):
        ranges = build_ranges_adaptive(lat, lng, r, 64, level)
        assert len(ranges) == 4**level and any(a - 1 <= z <= c + 1 for a, c in ranges)


def test_range_limits():
    assert build_ranges(0, 0, 10, 0) == [] and build_ranges_adaptive(0, 0, 10, 0, 2) == []
    assert len(build_ranges_adaptive(0, 0, 10, 10, 3)) == 9
    a, z = z_bounds(box(0, 0, -5))
    assert a <= z
