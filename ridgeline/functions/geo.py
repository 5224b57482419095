"""Geodesy as column expressions: all stay inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere's radius in metres, and the WGS-84 and UTM constants.
EARTH_RADIUS_M = 6371010.0
WGS84_A_KM = 6378.137
WGS84_FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_E2 = WGS84_FLATTENING * (2 - WGS84_FLATTENING)
UTM_BANDS = "CDEFGHJKLMNPQRSTUVWX"
FEET_PER_METRE = 3.28084
METRES_PER_FOOT = 0.3048


def lat_of(y: Column, max_lat: Column | float, per_degree: Column | float) -> Column:
    """Latitude of a pixel row of a degree grid; y grows southward."""
    return F.lit(max_lat) - y.cast("double") / F.lit(per_degree)


def lng_of(x: Column, min_lng: Column | float, per_degree: Column | float) -> Column:
    return F.lit(min_lng) + x.cast("double") / F.lit(per_degree)


def wrap_longitude(lng: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lng + 180, F.lit(360)) - 180


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng)
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def ellipsoid_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """WGS-84 distance by Lambert's flattening correction; zero between equal points."""
    mean, half_lat, half_lng = F.radians((lat1 + lat2) / 2), F.radians((lat1 - lat2) / 2), F.radians((lng1 - lng2) / 2)
    square = lambda c: c * c
    sin_f, cos_f, sin_g, cos_g = square(F.sin(mean)), square(F.cos(mean)), square(F.sin(half_lat)), square(F.cos(half_lat))
    sin_l, cos_l = square(F.sin(half_lng)), square(F.cos(half_lng))
    near = sin_g * cos_l + cos_f * sin_l
    far = cos_g * cos_l + sin_f * sin_l
    angle = F.atan2(F.sqrt(near), F.sqrt(far))
    ratio = F.try_divide(F.sqrt(near * far), angle)
    shorter = WGS84_FLATTENING * F.try_divide(3 * ratio - 1, 2 * far) * sin_f * cos_g
    longer = WGS84_FLATTENING * F.try_divide(3 * ratio + 1, 2 * near) * cos_f * sin_g
    return F.when(near == 0, 0.0).otherwise(2000 * WGS84_A_KM * angle * (1 + shorter - longer))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing in radians, with the longitude difference taken from the first point to the second's west (mirrored)."""
    a, b, apart = F.radians(lat1), F.radians(lat2), F.radians(lng1 - lng2)
    return F.atan2(F.sin(apart) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(apart))


def cap_bounds(lat: Column, lng: Column, metres: Column) -> Column:
    """struct(min_lat, min_lng, max_lat, max_lng) around a spherical cap.

    min_lng > max_lng means that the box crosses the antimeridian; a cap that
    holds a pole spans all longitudes.
    """
    angle = F.degrees(metres / EARTH_RADIUS_M)
    low, high = lat - angle, lat + angle
    inside = (low > -90) & (high < 90)
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(metres / EARTH_RADIUS_M) / F.cos(F.radians(lat)))))
    west = F.when(lng - wide < -180, lng - wide + 360).otherwise(lng - wide)
    east = F.when(lng + wide > 180, lng + wide - 360).otherwise(lng + wide)
    return F.struct(
        F.greatest(low, F.lit(-90.0)).alias("min_lat"), F.when(inside, west).otherwise(-180.0).alias("min_lng"),
        F.least(high, F.lit(90.0)).alias("max_lat"), F.when(inside, east).otherwise(180.0).alias("max_lng"),
    )


def utm_band(lat: Column) -> Column:
    """Letter of the 8-degree band (the last has 12); Z beyond 80 S and 84 N."""
    letters = F.array(*map(F.lit, UTM_BANDS))
    place = F.least(F.floor((lat + 80) / 8), F.lit(19)).cast("int")
    return F.when((lat >= -80) & (lat <= 84), F.element_at(letters, place + 1)).otherwise("Z")


def utm_zone(lat: Column, lng: Column) -> Column:
    """Zone number, with the exceptions of southern Norway and Svalbard."""
    at = wrap_longitude(lng)
    zone = F.floor((at + 180) / 6) + 1
    norway = (lat >= 56) & (lat < 64) & (at >= 3) & (at < 12)
    svalbard = (lat >= 72) & (lat < 84) & (at >= 0) & (at < 42)
    north = F.when(at < 9, 31).when(at < 21, 33).when(at < 33, 35).otherwise(37)
    return F.when(norway, 32).when(svalbard, north).otherwise(zone).cast("int")


def _powers(x: Column, n: int) -> list[Column]:
    out = [F.lit(1.0), x]
    while len(out) <= n:
        out.append(out[-1] * x)
    return out


def to_utm(lat: Column, lng: Column) -> Column:
    """struct(zone, band, easting, northing) by the series of USGS Bulletin 1532."""
    e2, e4, e6 = UTM_E2, UTM_E2**2, UTM_E2**3
    second = e2 / (1 - e2)
    zone = utm_zone(lat, lng)
    phi = F.radians(lat)
    t, c = F.tan(phi) * F.tan(phi), second * F.cos(phi) * F.cos(phi)
    a = _powers(F.cos(phi) * F.radians(wrap_longitude(lng) - (zone * 6 - 183)), 6)
    axis = WGS84_A_KM * 1000
    radius = axis / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    # Length of the meridian from the equator.
    series = ((1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi, -(3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi), (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi), -(35 * e6 / 3072) * F.sin(6 * phi))
    meridian = axis * (series[0] + series[1] + series[2] + series[3])
    east = UTM_SCALE * radius * (a[1] + (1 - t + c) * a[3] / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * a[5] / 120) + 500000.0
    north = UTM_SCALE * (meridian + radius * F.tan(phi) * (a[2] / 2 + (5 - t + 9 * c + 4 * c * c) * a[4] / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * a[6] / 720))
    return F.struct(zone.alias("zone"), utm_band(lat).alias("band"), east.alias("easting"), (north + F.when(lat < 0, 10000000.0).otherwise(0.0)).alias("northing"))


def from_utm(zone: Column, easting: Column, northing: Column, north: bool | Column = True) -> Column:
    """struct(lat, lng), the inverse series; southern hemisphere where north is false."""
    e2, e4, e6 = UTM_E2, UTM_E2**2, UTM_E2**3
    second, axis = e2 / (1 - e2), WGS84_A_KM * 1000
    root = (1 - e2) ** 0.5
    e = (1 - root) / (1 + root)
    y = F.when(north if isinstance(north, Column) else F.lit(north), northing).otherwise(northing - 10000000.0)
    mu = y / UTM_SCALE / (axis * (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256))
    phi = mu + (3 * e / 2 - 27 * e**3 / 32) * F.sin(2 * mu) + (21 * e**2 / 16 - 55 * e**4 / 32) * F.sin(4 * mu) + (151 * e**3 / 96) * F.sin(6 * mu)
    bent = 1 - e2 * F.sin(phi) * F.sin(phi)
    n, r = axis / F.sqrt(bent), axis * (1 - e2) / F.pow(bent, F.lit(1.5))
    t, c = F.tan(phi) * F.tan(phi), second * F.cos(phi) * F.cos(phi)
    d = _powers((easting - 500000.0) / (n * UTM_SCALE), 6)
    lat = phi - n * F.tan(phi) / r * (d[2] / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * second) * d[4] / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * second - 3 * c * c) * d[6] / 720)
    lng = (d[1] - (1 + 2 * t + c) * d[3] / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * second + 24 * t * t) * d[5] / 120) / F.cos(phi)
    return F.struct(F.degrees(lat).alias("lat"), (F.degrees(lng) + zone * 6 - 183).alias("lng"))


def feet_to_metres(c: Column) -> Column:
    return c * METRES_PER_FOOT


def metres_to_feet(c: Column) -> Column:
    return c * FEET_PER_METRE


def adjust_coordinate(c: Column) -> Column:
    """A thousandth of a degree away from zero, against binary fractions just below a whole."""
    return F.when(c >= 0, c + 0.001).otherwise(c - 0.001)


def whole_degree(c: Column) -> Column:
    """The part before the point, towards zero."""
    return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")


def fractional_degree(c: Column) -> Column:
    """Hundredths of a degree beyond the whole one, rounded."""
    return F.round(100 * F.abs(c - whole_degree(c))).cast("int")


def round_down(c: Column, interval: float) -> Column:
    return F.floor(c / interval) * interval


def round_up(c: Column, interval: float) -> Column:
    return F.ceil(c / interval) * interval


def tile_name(prefix: str, lat: Column, lng: Column) -> Column:
    """prefix, then degrees and hundredths with a sign only if negative, as in 59x10 and -006x25."""
    lat, lng = adjust_coordinate(lat), adjust_coordinate(lng)
    part = lambda c, width: F.concat(F.when(c >= 0, "").otherwise("-"), F.format_string(f"%0{width}dx%02d", F.abs(whole_degree(c)), fractional_degree(c)))
    return F.concat(F.lit(prefix), part(lat, 2), F.lit("_" if prefix.endswith("_") else "-"), part(lng, 3))
