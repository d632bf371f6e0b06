"""Point-cloud stages and gridding."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import scalars
from terrane.operators.geometry import inside

NOISE = (7, 18)
GROUND = 2


def crop_box(points: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Plain comparisons, which reach the scan."""
    return points.filter(F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy))


def crop(points: DataFrame, rings: list[list[tuple[float, float]]]) -> DataFrame:
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    return crop_box(points, min(xs), min(ys), max(xs), max(ys)).filter(inside(F.col("x"), F.col("y"), rings))


def drop_noise(points: DataFrame) -> DataFrame:
    return points.filter(~F.col("classification").isin(*NOISE))


def reset_classification(points: DataFrame) -> DataFrame:
    return points.withColumn("classification", F.lit(0))


def ground(points: DataFrame) -> DataFrame:
    return points.filter(F.col("classification") == GROUND)


def to_utm(points: DataFrame, zone: int) -> DataFrame:
    """Longitude and latitude in x and y to UTM."""
    east, north = scalars.utm_forward(F.col("x"), F.col("y"), F.lit(zone))
    return points.withColumns({"x": east, "y": north})


def statistics(points: DataFrame) -> DataFrame:
    """Extent and times of a cloud in one pass."""
    out = [F.count("*").alias("n")]
    for c in ("x", "y", "z", "gps_time"):
        if c in points.columns:
            out += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return points.agg(*out)


def classify_ground(points: DataFrame, cell: float = 1.0, window: float = 18.0, slope: float = 0.15, scalar: float = 1.25, threshold: float = 0.5) -> DataFrame:
    """Ground as class 2 by the progressive morphological filter (Pingel et al. 2013), with its usual defaults; others class 1.

    The lowest returns' surface is opened by square windows of growing radius up to ``window``; a cell that an opening lowers by more
    than ``slope`` allows over its radius holds an object, and its ground is the opened surface.  Points within ``threshold``
    and ``scalar`` times the ground's slope of it are ground.  A window is passed over rows, then over columns, in order,
    so a cell is a row however large the window is; cells without returns take no part.
    """
    keyed = points.withColumns({"row": F.floor(F.col("y") / cell).cast("long"), "col": F.floor(F.col("x") / cell).cast("long")})
    cells = keyed.groupBy("row", "col").agg(F.min("z").alias("low")).withColumns({"surface": F.col("low"), "thing": F.lit(False)})
    along = {"col": Window.partitionBy("row").orderBy("col"), "row": Window.partitionBy("col").orderBy("row")}
    for n in range(1, math.ceil(window / cell) + 1):
        opened = cells.withColumn("o", F.min("surface").over(along["col"].rangeBetween(-n, n)))
        opened = opened.withColumn("o", F.min("o").over(along["row"].rangeBetween(-n, n))).withColumn("o", F.max("o").over(along["row"].rangeBetween(-n, n)))
        opened = opened.withColumn("o", F.max("o").over(along["col"].rangeBetween(-n, n)))
        thing = F.col("thing") | (F.col("surface") - F.col("o") > slope * n * cell)
        cells = opened.select("row", "col", "low", F.col("o").alias("surface"), thing.alias("thing"))
    cells = cells.select("row", "col", F.when(F.col("thing"), F.col("surface")).otherwise(F.col("low")).alias("ground"))
    for axis in ("col", "row"):
        step = lambda k: F.first("ground").over(along[axis].rangeBetween(k, k))  # noqa: B023, E731
        cells = cells.withColumn(f"by_{axis}", F.coalesce((step(1) - step(-1)) / (2 * cell), F.lit(0.0)))
    near = F.lit(threshold) + scalar * F.sqrt(F.col("by_col") * F.col("by_col") + F.col("by_row") * F.col("by_row"))
    allowed = cells.select("row", "col", "ground", near.alias("near"))
    ground = F.abs(F.col("z") - F.col("ground")) <= F.col("near")
    return keyed.join(allowed, ["row", "col"]).withColumn("classification", F.when(ground, GROUND).otherwise(1)).drop("row", "col", "ground", "near")


METHODS = ("max", "min", "mean", "count", "stdev", "idw")


def grid(points: DataFrame, method: str, resolution: float = 1.0, radius: float | None = None, keys: tuple = (), origin: tuple = (0.0, 0.0), centred: bool = False, power: float = 1.0) -> DataFrame:
    """row, col and value: points within ``radius`` of a cell's centre (or just in the cell, if None) by ``method``.

    With a radius each point goes to the cells it may reach before the shuffle; the aggregate combines on
    the map side.  idw takes the mean weighted by 1 / d^power, or the points at the centre itself if any.
    ``centred``: cell (0, 0) is centred on the origin instead of beginning there.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    shift = 0.5 if centred else 0.0
    at = {"row": (F.col("y") - origin[1]) / resolution + shift, "col": (F.col("x") - origin[0]) / resolution + shift}
    cells = points.withColumns({k: F.floor(v).cast("long") for k, v in at.items()})
    if radius is None and method == "idw":
        radius = resolution * math.sqrt(2)
    if radius is not None:
        n = math.ceil(radius / resolution)
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-n, n + 1) for j in range(-n, n + 1)])
        cells = cells.withColumn("o", F.explode(steps)).withColumns({"row": F.col("row") + F.col("o.i"), "col": F.col("col") + F.col("o.j")}).drop("o")
        centre = 0.5 - shift
        dx = F.col("x") - (F.lit(origin[0]) + (F.col("col") + centre) * resolution)
        dy = F.col("y") - (F.lit(origin[1]) + (F.col("row") + centre) * resolution)
        cells = cells.withColumn("d", F.sqrt(dx * dx + dy * dy)).filter(F.col("d") <= radius)
    groups = cells.groupBy(*keys, "row", "col")
    if method == "idw":
        weight = F.when(F.col("d") > 0, 1 / (F.col("d") if power == 1 else F.pow("d", F.lit(power))))
        far = F.sum(F.col("z") * weight) / F.sum(weight)
        return groups.agg(F.coalesce(F.avg(F.when(F.col("d") == 0, F.col("z"))), far).alias("value"))
    return groups.agg({"max": F.max, "min": F.min, "mean": F.avg, "stdev": F.stddev_pop}.get(method, F.count)("z").alias("value"))


def dem(points: DataFrame, kind: str, resolution: float = 1.0, radius: float | None = None, **options) -> DataFrame:
    """dtm: ground returns by idw; dsm: all returns by maximum."""
    if kind == "dtm":
        return grid(ground(points), "idw", resolution, radius, **options)
    if kind == "dsm":
        return grid(points, "max", resolution, radius, **options)
    raise ValueError(f"a DEM is dtm or dsm, not {kind!r}")


def prepare(points: DataFrame, rings=None, filter_noise: bool = False, reclassify: bool = False, zone: int | None = None) -> DataFrame:
    """The stages in their usual order: crop, noise, classification, projection."""
    if rings:
        points = crop(points, rings)
    if filter_noise:
        points = drop_noise(points)
    if reclassify:
        points = classify_ground(reset_classification(points))
    return to_utm(points, zone) if zone is not None else points

