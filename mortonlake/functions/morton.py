"""Morton (Z-order) codes: latitude on the even bits, longitude on the odd bits.

Spark has no unsigned long, so a code z is kept as z_ord = z XOR 2**63: the signed order
of z_ord is the unsigned order of z. Binary digits read as digits of base 4 are spread
bits, and the other way round compacted ones, so either expression mentions its input
once, and Catalyst can fold it into a filter. Masks and shifts would double it at each step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AXIS_MAX, EVEN_BITS, MAX_LAT, MAX_LNG, MIN_LAT, MIN_LNG, SIGN

_SPREAD = [sum((b >> i & 1) << (2 * i) for i in range(8)) for b in range(256)]
_COMPACT = [sum((b >> (2 * i) & 1) << i for i in range(4)) for b in range(256)]


# --- on the driver, for literals -------------------------------------------------


def spread_int(n: int) -> int:
    """Bit i of a 32-bit number goes to bit 2 i."""
    return sum(_SPREAD[n >> 8 * k & 255] << 16 * k for k in range(4))


def compact_int(z: int) -> int:
    """The even bits of a 64-bit number; odd bits are ignored."""
    return sum(_COMPACT[z >> 8 * k & 255] << 4 * k for k in range(8))


def normalize_int(value: float, low: float, high: float) -> int:
    return int((min(max(value, low), high) - low) / (high - low) * AXIS_MAX)


def encode_int(lat: float, lng: float) -> int:
    """The unsigned code of a point; coordinates out of range are clamped."""
    return spread_int(normalize_int(lat, MIN_LAT, MAX_LAT)) | spread_int(normalize_int(lng, MIN_LNG, MAX_LNG)) << 1


def decode_int(z: int) -> tuple[float, float]:
    return compact_int(z) / AXIS_MAX * 180.0 + MIN_LAT, compact_int(z >> 1) / AXIS_MAX * 360.0 + MIN_LNG


def ordered_int(z: int) -> int:
    """z_ord of an unsigned code."""
    return z + SIGN


def encode_ordered(lat: float, lng: float) -> int:
    return ordered_int(encode_int(lat, lng))


# --- columns ---------------------------------------------------------------------


def spread_bits(n: Column) -> Column:
    """Bit i of the low 32 bits goes to bit 2 i."""
    return F.conv(F.bin(n.bitwiseAND(F.lit(AXIS_MAX))), 4, 10).cast("bigint")


def compact_bits(z: Column) -> Column:
    """The even bits of a 64-bit number; odd bits are ignored."""
    return F.conv(F.conv(z.bitwiseAND(F.lit(EVEN_BITS)).cast("string"), 10, 4), 2, 10).cast("bigint")


def _axis(value: Column, low: float, high: float) -> Column:
    value = value.cast("double")
    clamped = F.greatest(F.lit(low), F.least(F.lit(high), value))  # these two pass over nulls, and take NaN for the greatest
    return F.when(value.isNotNull() & ~F.isnan(value), F.floor((clamped - F.lit(low)) / F.lit(high - low) * F.lit(float(AXIS_MAX))))


def normalize_lat(lat: Column) -> Column:
    """0 to 2**32 - 1, towards zero; out of range is clamped, null and NaN give null."""
    return _axis(lat, MIN_LAT, MAX_LAT)


def normalize_lng(lng: Column) -> Column:
    return _axis(lng, MIN_LNG, MAX_LNG)


def denormalize_lat(n: Column) -> Column:
    return n.cast("double") / F.lit(float(AXIS_MAX)) * F.lit(180.0) + F.lit(MIN_LAT)


def denormalize_lng(n: Column) -> Column:
    return n.cast("double") / F.lit(float(AXIS_MAX)) * F.lit(360.0) + F.lit(MIN_LNG)


def interleave(nlat: Column, nlng: Column) -> Column:
    """z_ord of two normalised axes."""
    return spread_bits(nlat).bitwiseOR(F.shiftleft(spread_bits(nlng), 1)).bitwiseXOR(F.lit(SIGN))


def encode(lat: Column, lng: Column) -> Column:
    return interleave(normalize_lat(lat), normalize_lng(lng))


def unordered(z_ord: Column) -> Column:
    """The code's 64 bits as a signed long."""
    return z_ord.bitwiseXOR(F.lit(SIGN))


def unsigned(z_ord: Column) -> Column:
    """The unsigned code as DECIMAL(20, 0), for display."""
    return (z_ord.cast("decimal(20,0)") - F.lit(str(SIGN)).cast("decimal(20,0)")).cast("decimal(20,0)")


def decode(z_ord: Column) -> Column:
    """struct(lat, lng) of a code. Indexes carry nlat and nlng and don't need it."""
    z = unordered(z_ord)
    return F.struct(denormalize_lat(compact_bits(z)).alias("lat"), denormalize_lng(compact_bits(F.shiftrightunsigned(z, 1))).alias("lng"))
