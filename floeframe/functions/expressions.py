"""Scalar column expressions: dates, angles, vectors, projection, cost shapes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
EARTH_RADIUS_M = 6371008.8          # sphere used for every distance
NM_TO_KM = 1.852
WGS84_A = 6378137.0                 # ellipsoid of the polar stereographic grid
WGS84_E = 0.0818191908426215
TRUE_SCALE_LAT = 70.0               # standard parallel, degrees south
# ----------------------------------------------------------------------------


def date_from_yyyyddd(code: Column) -> Column:
    """``YYYYDDD`` to DATE; wrong width, day 0, day 366 of a common year -> NULL."""
    digits = F.when(code.rlike("^(19[7-9][0-9]|20[0-9][0-9])[0-9]{3}$"), code)
    year = F.substring(digits, 1, 4).cast("int")
    day = F.substring(digits, 5, 3).cast("int")
    moved = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)
    return F.when((day > 0) & (F.year(moved) == year), moved)


def normalise_longitude(lon: Column) -> Column:
    """Into [-180, 180); a value already there is returned untouched."""
    return F.when((lon >= -180) & (lon < 180), lon).otherwise(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)


def rounded(x: Column, digits: int) -> Column:
    """``x`` scaled, rounded half away from zero and scaled back, all in binary, as SQL engines round doubles. Spark's ``round`` looks at the
    shortest decimal form instead, and decides a value beside a half differently."""
    scale = float(10 ** digits)
    return F.round(x * scale) / scale


def length(a: Column, b: Column) -> Column:
    """Length of a vector by the plain formula; ``hypot`` may differ from it in the last bit."""
    return F.sqrt(a * a + b * b)


def shortest_arc(delta: Column) -> Column:
    """Into [-180, 180), by the remainders that the SQL twins take, so that both round alike."""
    return ((delta + 540.0) % 360.0 + 360.0) % 360.0 - 180.0


def great_circle_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    p, q = F.radians(lat_a), F.radians(lat_b)
    half_dp = (q - p) / 2
    half_dl = F.radians(shortest_arc(lon_b - lon_a)) / 2
    h = F.sin(half_dp) * F.sin(half_dp) + F.cos(p) * F.cos(q) * F.sin(half_dl) * F.sin(half_dl)
    return 2.0 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def advect(lat: Column, lon: Column, east: Column, north: Column, seconds) -> tuple[Column, Column]:
    """Constant velocity in the tangent plane; returns (lat, lon)."""
    end = F.radians(lat) + north * seconds / EARTH_RADIUS_M
    limit = math.radians(89.999)
    end = F.greatest(F.least(end, F.lit(limit)), F.lit(-limit))
    mid = (F.radians(lat) + end) * 0.5
    return F.degrees(end), normalise_longitude(
        lon + F.degrees(east * seconds / (EARTH_RADIUS_M * F.cos(mid))))


def displacement(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> tuple[Column, Column]:
    """(east, north) metres: the inverse of ``advect``."""
    mid = F.radians((lat_a + lat_b) * 0.5)
    east = EARTH_RADIUS_M * F.radians(shortest_arc(lon_b - lon_a)) * F.cos(mid)
    return east, EARTH_RADIUS_M * F.radians(lat_b - lat_a)


def turn(east: Column, north: Column, degrees: Column) -> tuple[Column, Column]:
    """Rotate a vector counter-clockwise."""
    a = F.radians(degrees)
    return east * F.cos(a) - north * F.sin(a), east * F.sin(a) + north * F.cos(a)


def to_projected(east: Column, north: Column, lon: Column) -> tuple[Column, Column]:
    """Local east/north into grid x/y.

    On a conformal south-polar grid with central meridian 0 the unit vectors are
    east = (cos lon, -sin lon) and north = (sin lon, cos lon).
    """
    a = F.radians(lon)
    return east * F.cos(a) + north * F.sin(a), -east * F.sin(a) + north * F.cos(a)


def to_geographic(x: Column, y: Column, lon: Column) -> tuple[Column, Column]:
    """Transpose of ``to_projected``."""
    a = F.radians(lon)
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def _isometric(south_lat: Column) -> Column:
    s = WGS84_E * F.sin(south_lat)
    return (F.tan(math.pi / 4 - south_lat / 2)
            / F.pow((1 - s) / (1 + s), F.lit(WGS84_E / 2)))


def polar_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """South-polar stereographic metres, true scale at 70 S (published formula)."""
    fc = math.radians(TRUE_SCALE_LAT)
    sc = WGS84_E * math.sin(fc)
    mc = math.cos(fc) / math.sqrt(1 - sc * sc)
    tc = math.tan(math.pi / 4 - fc / 2) / ((1 - sc) / (1 + sc)) ** (WGS84_E / 2)
    rho = F.lit(WGS84_A * mc / tc) * _isometric(F.radians(-lat))
    return rho * F.sin(F.radians(lon)), rho * F.cos(F.radians(lon))


def local_scale(lat: Column) -> Column:
    """Projected metres per true metre at a latitude: rho / (a m(lat))."""
    phi = F.radians(-lat)
    s = WGS84_E * F.sin(phi)
    _, rho = polar_xy(lat, F.lit(0.0))
    return rho / (WGS84_A * F.cos(phi) / F.sqrt(1 - s * s))


def row_of(y: Column, top: float, size: float) -> Column:
    return F.floor((F.lit(top) - y) / size).cast("int")


def col_of(x: Column, left: float, size: float) -> Column:
    return F.floor((x - F.lit(left)) / size).cast("int")


def bucket_of(seconds: Column, bucket_s: float) -> Column:
    return F.floor(seconds / bucket_s).cast("int")


def growth_factor(hours: Column, calibrated_h: float = 24.0, law: str = "power",
                  exponent: float = 0.5) -> Column:
    """Radius growth; zero at zero, NULL for a negative horizon."""
    ratio = hours / calibrated_h
    grown = ratio if law == "linear" else F.pow(ratio, F.lit(exponent))
    return F.when(hours > 0, grown).when(hours == 0, F.lit(0.0))


def exposure_value(distance_m: Column, radius_m: Column, shape: str = "linear") -> Column:
    inside = F.lit(1.0) if shape == "constant" else 1.0 - distance_m / radius_m
    return F.when(distance_m < radius_m, inside).otherwise(F.lit(0.0))


def resistance_factor(sic: Column, penalty: float = 2.0, exponent: float = 1.5) -> Column:
    """Relative fuel per metre; missing stays missing, outside 0..100 is refused (NULL)."""
    return F.when(sic.between(0, 100), 1.0 + penalty * F.pow(sic / 100.0, F.lit(exponent)))


def nm_to_km(nm: Column) -> Column:
    return F.when(nm > 0, nm * NM_TO_KM)


def classify_rio(rio: Column, category: str = "polar_class") -> Column:
    """Outcome band of a risk sum for one class category (fixed thresholds)."""
    special = "operation_subject_to_special_consideration"
    bands = F.when(rio >= 0, "normal_operation")
    if category == "polar_class":
        bands = bands.when(rio >= -10, "elevated_operational_risk")
    return F.when(rio.isNotNull(), bands.otherwise(special))
