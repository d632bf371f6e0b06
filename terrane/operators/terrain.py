"""Terrain derivatives from 3 x 3 neighbourhoods.

Each cell is sent to its nine neighbours and one aggregate puts a neighbourhood together: one shuffle,
no self-joins.  Cells without all nine values have no derivative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of the neighbourhood, row by row.
PLACES = {(-1, -1): "a", (-1, 0): "b", (-1, 1): "c", (0, -1): "d", (0, 0): "m", (0, 1): "f", (1, -1): "g", (1, 0): "h", (1, 1): "i"}


def neighbourhoods(cells: DataFrame) -> DataFrame:
    """row, col and the nine values of each complete neighbourhood."""
    steps = F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(n).alias("at")) for (i, j), n in PLACES.items()])
    sent = cells.filter("value is not null").withColumn("o", F.explode(steps)).select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), F.col("o.at").alias("at"), "value")
    return sent.groupBy("row", "col").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("at") == n, F.col("value"))).alias(n) for n in PLACES.values()]).filter("n = 9").drop("n")


def _gradient(res: float, z: float = 1.0):
    east = (F.col("c") + 2 * F.col("f") + F.col("i")) - (F.col("a") + 2 * F.col("d") + F.col("g"))
    south = (F.col("g") + 2 * F.col("h") + F.col("i")) - (F.col("a") + 2 * F.col("b") + F.col("c"))
    return east * (z / (8 * res)), south * (z / (8 * res))


def slope(cells: DataFrame, res: float = 1.0) -> DataFrame:
    """Degrees, Horn's gradient."""
    gx, gy = _gradient(res)
    return neighbourhoods(cells).select("row", "col", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))).alias("value"))


def aspect(cells: DataFrame, res: float = 1.0) -> DataFrame:
    """Compass direction of the steepest descent, 0 where flat."""
    gx, gy = _gradient(res)
    turned = F.lit(90.0) - F.degrees(F.atan2(gy, -gx))
    compass = F.when(turned < 0, turned + 360).when(turned >= 360, turned - 360).otherwise(turned)
    return neighbourhoods(cells).select("row", "col", F.when((gx == 0) & (gy == 0), 0.0).otherwise(compass).alias("value"))


def hillshade(cells: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, res: float = 1.0, z: float = 1.0) -> DataFrame:
    """1 to 255: illumination of Horn's gradient."""
    gx, gy = _gradient(res, z)
    zenith, az = F.radians(F.lit(90.0 - altitude)), F.radians(F.lit(360.0 - azimuth + 90.0))
    steep, facing = F.atan(F.sqrt(gx * gx + gy * gy)), F.atan2(gy, -gx)
    shade = F.cos(zenith) * F.cos(steep) + F.sin(zenith) * F.sin(steep) * F.cos(az - facing)
    return neighbourhoods(cells).select("row", "col", (1 + 254 * F.greatest(shade, F.lit(0.0))).alias("value"))


def roughness(cells: DataFrame) -> DataFrame:
    names = list(PLACES.values())
    return neighbourhoods(cells).select("row", "col", (F.greatest(*names) - F.least(*names)).alias("value"))


DERIVATIVES = {"slope": slope, "aspect": aspect, "hillshade": hillshade, "roughness": roughness}


def derive(cells: DataFrame, name: str, **options) -> DataFrame:
    if name not in DERIVATIVES:
        raise ValueError(f"unknown derivative {name!r}; known: {', '.join(DERIVATIVES)}")
    return DERIVATIVES[name](cells, **options)
