"""Scalar functions as Column expressions, which stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


# --- names, dates, catalog ---------------------------------------------------


def clean_name(name: Column) -> Column:
    """Runs of anything but letters, digits and underscores become one underscore."""
    return F.regexp_replace(name, r"(?U)[^\w]+", "_")


def source_class(name: Column) -> Column:
    """usgs, noaa or ot, by the spellings that data sources use."""
    has = lambda *xs: F.greatest(*[F.contains(name, F.lit(x)) for x in xs])
    return F.when(has("USGS", "usgs"), "usgs").when(has("NOAA", "noaa"), "noaa").otherwise("ot")


def coverage_dates(text: Column, start: Column | None = None, end: Column | None = None) -> tuple[Column, Column]:
    """Start and end date of a coverage: 'a / b', one date for both, or two fields."""
    parts = F.split(text, "/")
    date = lambda x: F.try_to_date(F.substr(F.trim(x), F.lit(1), F.lit(10)))
    first = date(F.get(parts, F.lit(0)))
    last = F.coalesce(date(F.get(parts, F.lit(1))), first)
    return (F.coalesce(date(start), first) if start is not None else first), (F.coalesce(date(end), last) if end is not None else last)


def property_value(properties: Column, name: str) -> Column:
    """Value of the first struct(name, value) with this name, else null."""
    return F.try_element_at(F.filter(properties, lambda p: p["name"] == name), F.lit(1))["value"]


def midpoint_date(start: Column, end: Column) -> Column:
    """Day in the middle, rounded down; null if either is null."""
    return F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))


def decimal_year(date: Column) -> Column:
    return F.year(date) + (F.dayofyear(date) - 1) / F.lit(365.25)


def epoch_string(date: Column) -> Column:
    return F.format_string("+epoch=%.4f", decimal_year(date))


def gps_date(seconds: Column) -> Column:
    """Date of GPS seconds; adjusted seconds (below 1e9) get their offset back; 0 and null give null."""
    whole = F.when(seconds < 1e9, seconds + 1e9).otherwise(seconds)
    return F.when(seconds != 0, F.date_add(F.lit("1980-01-06").cast("date"), F.floor(whole / 86400).cast("int")))


def acquisition_date(tags: Column) -> Column:
    """The first tag that holds a date."""
    out = []
    for tag in ("ACQUISITION_DATE", "TIFFTAG_DATETIME"):
        value = F.try_element_at(tags, F.lit(tag))
        out += [F.to_date(F.try_to_timestamp(value, F.lit("yyyy:MM:dd HH:mm:ss"))), F.to_date(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))]
    return F.coalesce(*out)


def auto_name(name: Column, base: str, position: Column) -> Column:
    """The name, or base and position where there is none."""
    return F.coalesce(F.nullif(F.nullif(F.trim(name), F.lit("")), F.lit("None")), F.concat(F.lit(base), position.cast("string")))


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))


# --- coordinate systems ------------------------------------------------------


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") + 1


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def frame_epoch(wkt: Column) -> Column:
    return F.nullif(F.regexp_extract(wkt, r"FRAME_EPOCH\[(\d+\.\d+)\]", 1), F.lit("")).cast("double")


def horizontal_epsg(wkt: Column) -> Column:
    """Code of the projected or geographic part of a (compound) definition, best effort."""
    part = F.regexp_replace(wkt, r"(?s)VERT_?CRS\[.*|VERT_CS\[.*|VERTCRS\[.*", "")
    code = F.regexp_extract_all(part, F.lit(r"(?:AUTHORITY\[\"EPSG\",\"|ID\[\"EPSG\",)(\d+)"), F.lit(1))
    return F.try_element_at(code, F.lit(-1)).cast("int")


def vertical_epsg(wkt: Column) -> Column:
    """Code of the vertical part, null if there is none."""
    part = F.regexp_extract(wkt, r"(?s)((?:VERT_CS|VERTCRS|VERT_CRS)\[.*)", 1)
    code = F.regexp_extract_all(part, F.lit(r"(?:AUTHORITY\[\"EPSG\",\"|ID\[\"EPSG\",)(\d+)"), F.lit(1))
    return F.try_element_at(code, F.lit(-1)).cast("int")


_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, _N**2 / 48 + _N**3 / 15, 17 / 480 * _N**3)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)


def utm_forward(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing on WGS 84, by Krueger's series to the third order."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500000.0) + F.lit(_K0 * _R) * east, F.when(lat < 0, 1e7).otherwise(0.0) + F.lit(_K0 * _R) * north


def utm_inverse(east: Column, north: Column, zone: Column, south: Column | bool = False) -> tuple[Column, Column]:
    """Longitude and latitude of UTM coordinates on WGS 84."""
    base = F.when(F.lit(south) if isinstance(south, bool) else south, 1e7).otherwise(0.0)
    xi, eta = (north - base) / F.lit(_K0 * _R), (east - 500000.0) / F.lit(_K0 * _R)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(phi)


# --- grids -------------------------------------------------------------------


def pixel_centre(row: Column, col: Column, a: float, c: float, e: float, f: float) -> tuple[Column, Column]:
    return F.lit(c) + (col + 0.5) * F.lit(a), F.lit(f) + (row + 0.5) * F.lit(e)


def lag_bin(distance: Column, width: float) -> Column:
    return F.floor(distance / F.lit(float(width))).cast("int")


def flat_wkt(rings: Column) -> Column:
    """'x, y, x, y' over all vertices of all rings."""
    return F.array_join(F.transform(F.flatten(rings), lambda p: F.concat(p["x"].cast("string"), F.lit(", "), p["y"].cast("string"))), ", ")


def one_sided_range(low: float | None, high: float | None) -> tuple[float | None, float | None]:
    """A range of which one side is given is symmetric."""
    if low is None and high is not None:
        return -abs(high), high
    if high is None and low is not None:
        return low, abs(low)
    return low, high


# --- variogram models --------------------------------------------------------


def spherical(h: Column, sills: list, ranges: list, nugget: float | Column = 0.0) -> Column:
    """Nested spherical semivariance; the nugget counts at distance zero as well."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    out = as_column(nugget)
    for c, a in zip(sills, ranges, strict=True):
        c, a = as_column(c), as_column(a)
        r = h / F.nullif(a, F.lit(0.0))
        out = out + F.when(h <= a, c * (1.5 * r - 0.5 * r * r * r)).otherwise(c)
    return out


def pure_nugget(nugget: float) -> Column:
    return F.lit(float(nugget))


def covariance(gamma: Column, variance: float | Column) -> Column:
    return (variance if isinstance(variance, Column) else F.lit(float(variance))) - gamma


def correlation(gamma: Column, variance: float, clipped: bool = True) -> Column:
    rho = 1 - gamma / F.lit(float(variance))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)) if clipped else rho


def guarded_sqrt(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


WEIGHTS = ("std", "linear", "exp", "sqrt", "sq")


def fit_sigma(scheme: str, lag: Column, sigma: Column) -> Column:
    """Standard deviations a fit assumes, by scheme."""
    schemes = {
        "std": lambda: sigma,
        "linear": lambda: 1 / (1 + lag),
        "exp": lambda: F.exp(-lag),
        "sqrt": lambda: 1 / F.sqrt(1 + lag),
        "sq": lambda: 1 / (1 + lag * lag),
    }
    if scheme not in schemes:
        raise ValueError(f"unknown weighting {scheme!r}; known: {', '.join(schemes)}")
    return schemes[scheme]()
