"""Fixed values that results depend on."""

# Limits of coordinates in degrees, the earth's mean radius in km, the km that a
# degree of the search box counts for, and the resolution of an axis.
MIN_LAT, MAX_LAT = -90.0, 90.0
MIN_LNG, MAX_LNG = -180.0, 180.0
EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = 111.32
AXIS_BITS = 32
AXIS_MAX = 4294967295
LEAST_COSINE = 1e-10
EVEN_BITS = 0x5555555555555555
SIGN = -(1 << 63)
