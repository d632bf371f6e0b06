"""Schemas of the library's tables.

A raster is a table of cells with integer grid keys; a missing measurement is null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "x double, y double, z double, gps_time double, classification int, survey string"
CELL = "raster_id string, row int, col int, x double, y double, value double"
RASTER_META = "raster_id string, width int, height int, a double, b double, c double, d double, e double, f double, nodata double, epsg int, crs_wkt string, tags map<string,string>"
EDGES = "poly_id int, seq int, x1 double, y1 double, x2 double, y2 double"
POLYGON = "poly_id int, name string, category string, rings array<array<struct<x:double,y:double>>>"
NODATA = -9999.0


def canonical(value: Column, nodata: float | None = NODATA) -> Column:
    """The one validity rule: null for null, NaN, infinite and nodata values."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    if nodata is not None:
        bad = bad | (value == F.lit(float(nodata)))
    return F.when(~bad, value)
