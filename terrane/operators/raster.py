"""Rasters as cell tables: differencing, alignment, masks, ranges, datum shifts.

Cells are keyed by integer (row, col); a null value is no measurement.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalars import utm_forward, utm_inverse
from terrane.operators.ranks import percentiles
from terrane.schema import canonical
from terrane.session import shared_folder

KEY = ["row", "col"]


def load(cells: DataFrame, nodata: float | None = -9999.0) -> DataFrame:
    """Cells with the one validity rule applied, invalid ones dropped."""
    return cells.withColumn("value", canonical(F.col("value"), nodata)).filter("value is not null")


def difference(compare: DataFrame, reference: DataFrame) -> DataFrame:
    """reference minus compare where both have a value."""
    a, b = compare.select(*KEY, F.col("value").alias("v1")), reference.select(*KEY, F.col("value").alias("v2"))
    return a.join(b, KEY).filter("v1 is not null and v2 is not null").select(*KEY, (F.col("v2") - F.col("v1")).alias("value"))


def pair(compare: DataFrame, reference: DataFrame, how: str = "full") -> DataFrame:
    a, b = compare.select(*KEY, F.col("value").alias("v1")), reference.select(*KEY, F.col("value").alias("v2"))
    return a.join(b, KEY, how)


def combined_mask(both: DataFrame | None = None, a: DataFrame | None = None, b: DataFrame | None = None) -> DataFrame:
    """1 where either raster has no value; from a pair or from two rasters, not from both."""
    if (both is None) == (a is None or b is None):
        raise ValueError("give a pair, or both rasters")
    both = both if both is not None else pair(a, b)
    return both.select(*KEY, (F.col("v1").isNull() | F.col("v2").isNull()).cast("tinyint").alias("mask"))


def overlap(both: DataFrame) -> DataFrame:
    """Cells where both rasters have a value."""
    return both.filter("v1 is not null and v2 is not null")


def valid_area(cells: DataFrame, a: float = 1.0, e: float = -1.0) -> DataFrame:
    return cells.agg((F.count("value") * abs(a * e)).alias("area"))


def metadata(cells: DataFrame, a: float = 1.0, c: float = 0.0, e: float = -1.0, f: float = 0.0) -> DataFrame:
    """Bounds of a raster from its cells: outer edges of the outermost ones."""
    x0, x1 = F.lit(c) + F.min("col") * a, F.lit(c) + (F.max("col") + 1) * a
    y0, y1 = F.lit(f) + F.min("row") * e, F.lit(f) + (F.max("row") + 1) * e
    return cells.agg(F.least(x0, x1).alias("left"), F.least(y0, y1).alias("bottom"), F.greatest(x0, x1).alias("right"), F.greatest(y0, y1).alias("top"))


def boxed(cells: DataFrame) -> DataFrame:
    """All cells of the bounding box, null where there is no value; the four bounds come to the driver."""
    r0, r1, c0, c1 = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if r0 is None:
        return cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")
    wide = int(c1 - c0) + 1
    spine = cells.sparkSession.range((int(r1 - r0) + 1) * wide).select((F.floor(F.col("id") / wide) + int(r0)).cast("long").alias("row"), (F.col("id") % wide + int(c0)).alias("col"))
    return spine.join(cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"), KEY, "left").select(*KEY, "value")


def extent(meta: DataFrame) -> DataFrame:
    return meta.select(F.array("left", "right", "bottom", "top").alias("extent"))


def symmetric_range(cells: DataFrame, value: str = "value") -> DataFrame:
    """Plus and minus the largest magnitude; zeros without any value."""
    high = F.coalesce(F.max(F.abs(value)), F.lit(0.0))
    return cells.agg((-high).alias("low"), high.alias("high"))


def subtract(cells: DataFrame, constant: float | Column) -> DataFrame:
    """Bias removal: nulls stay, values are stored as 32-bit floats only by a sink."""
    return cells.withColumn("value", F.col("value") - constant)


def remove_median(cells: DataFrame) -> DataFrame:
    """Values minus their median, a one-row aggregate that is broadcast."""
    bias = percentiles(cells, (0.5,)).select(F.col("p")[0].alias("bias"))
    return cells.join(F.broadcast(bias)).select(*KEY, (F.col("value") - F.col("bias")).alias("value"))


def percentile_clip(cells: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    cut = percentiles(cells, (low, high))
    return cells.join(F.broadcast(cut)).filter("value between p[0] and p[1]").drop("p")


def plot_mask(overlay: DataFrame, diff: DataFrame) -> DataFrame:
    """Overlay values where both it and the difference have one."""
    return pair(overlay, diff, "left").select(*KEY, F.when(F.col("v2").isNotNull(), F.col("v1")).alias("value"))


def resample(source: DataFrame, target: DataFrame, source_transform: tuple, target_transform: tuple) -> DataFrame:
    """Nearest value of ``source`` at the centres of ``target``'s cells; transforms are (a, c, e, f).

    Each target cell knows its source cell by arithmetic, so this is an equi-join on integer keys.
    """
    (a, c, e, f), (ta, tc, te, tf) = source_transform, target_transform
    x, y = F.lit(tc) + (F.col("col") + 0.5) * ta, F.lit(tf) + (F.col("row") + 0.5) * te
    keyed = target.select(*KEY, F.floor((y - f) / e).cast("long").alias("srow"), F.floor((x - c) / a).cast("long").alias("scol"))
    values = source.select(F.col("row").cast("long").alias("srow"), F.col("col").cast("long").alias("scol"), "value")
    return keyed.join(values, ["srow", "scol"], "left").select(*KEY, "value")


def align(first: DataFrame, second: DataFrame, first_transform: tuple, second_transform: tuple) -> tuple[DataFrame, DataFrame, tuple]:
    """Both on one grid: the raster of more cells goes to the other's, the second one on a tie."""
    if first_transform == second_transform:
        return first, second, first_transform
    if first.count() > second.count():
        return resample(first, second, first_transform, second_transform), second, second_transform
    return first, resample(second, first, second_transform, first_transform), first_transform


def shift_datum(cells: DataFrame, source: DataFrame, target: DataFrame, same: bool = False) -> DataFrame:
    """Heights moved between vertical datums by two undulation grids on the cells' keys."""
    if same:
        return cells
    a, b = source.select(*KEY, F.col("value").alias("n1")), target.select(*KEY, F.col("value").alias("n2"))
    return cells.join(a, KEY).join(b, KEY).select(*KEY, (F.col("value") + F.col("n1") - F.col("n2")).alias("value"))


def patches(cells: DataFrame, rounds: int = 64) -> DataFrame:
    """row, col and patch of the valid cells: connected over four neighbours, named by the smallest cell.

    Labels spread to neighbours and then jump to their label's label; each round is written to the shared folder
    and read back (a checkpoint keeps its plan's size estimate, whose digits grow fourfold with each round's joins).
    Labels that have not settled after ``rounds`` are an error.
    """
    spark, folder = cells.sparkSession, f"{shared_folder(cells.sparkSession)}/patches-{uuid.uuid4().hex}"

    def written(df: DataFrame, n: int) -> DataFrame:
        df.write.parquet(f"{folder}/{n}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{n}")

    valid = cells.filter("value is not null").select(F.col("row").cast("long"), F.col("col").cast("long"))
    own = F.shiftleft(F.col("row"), 32) + F.col("col")
    now = valid.select("row", "col", own.alias("id"), own.alias("patch"))
    now = written(now, 0)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])
    for n in range(1, rounds + 1):
        moved = now.withColumn("o", F.explode(steps)).select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), F.col("patch").alias("near"))
        low = moved.groupBy("row", "col").agg(F.min("near").alias("near"))
        new = now.join(low, ["row", "col"]).select("row", "col", "id", F.col("patch").alias("old"), F.least("patch", "near").alias("patch"))
        up = new.select(F.col("id").alias("patch"), F.col("patch").alias("up"))
        new = written(new.join(up, "patch").select("row", "col", "id", "old", F.col("up").alias("patch")), n)
        changed = new.filter("patch <> old").limit(1).count()
        now = new.drop("old")
        if not changed:
            break
    else:
        raise RuntimeError(f"patches did not settle in {rounds} rounds")
    return now.select("row", "col", "patch")


def reproject(source: DataFrame, source_transform: tuple, target: DataFrame, target_transform: tuple, zone: int, south: bool = False) -> DataFrame:
    """Nearest value of a raster in longitude and latitude at the centres of ``target``'s UTM cells."""
    (a, c, e, f), (ta, tc, te, tf) = source_transform, target_transform
    east, north = F.lit(tc) + (F.col("col") + 0.5) * ta, F.lit(tf) + (F.col("row") + 0.5) * te
    lon, lat = utm_inverse(east, north, F.lit(zone), south)
    keyed = target.select(*KEY, F.floor((lat - f) / e).cast("long").alias("srow"), F.floor((lon - c) / a).cast("long").alias("scol"))
    values = source.select(F.col("row").cast("long").alias("srow"), F.col("col").cast("long").alias("scol"), "value")
    return keyed.join(values, ["srow", "scol"], "left").select(*KEY, "value")


def process_pair(first: DataFrame, second: DataFrame, first_transform: tuple, second_transform: tuple, resolution: float) -> tuple[DataFrame, DataFrame, tuple, int] | None:
    """Two rasters in longitude and latitude on one UTM grid over their common extent, cells valid in both; with the
    grid's transform and EPSG code.  None if they do not overlap.

    Only the rasters' bounds come to the driver.
    """
    spark = first.sparkSession
    boxes = [metadata(x.filter("value is not null"), *t).first() for x, t in ((first, first_transform), (second, second_transform))]
    if any(b.left is None for b in boxes):
        return None
    left, right = max(b.left for b in boxes), min(b.right for b in boxes)
    bottom, top = max(b.bottom for b in boxes), min(b.top for b in boxes)
    if left >= right or bottom >= top:
        return None
    lon, lat = (left + right) / 2, (bottom + top) / 2
    zone, south = int((lon + 180) // 6) + 1, lat < 0
    # edges bulge, so points along them bound the grid
    along = [i / 16 for i in range(17)]
    edge = [(left + (right - left) * t, y) for t in along for y in (bottom, top)] + [(x, bottom + (top - bottom) * t) for t in along for x in (left, right)]
    corners = spark.createDataFrame(edge, "x double, y double")
    east, north = utm_forward(F.col("x"), F.col("y"), F.lit(zone))
    e0, e1, n0, n1 = corners.agg(F.min(east), F.max(east), F.min(north), F.max(north)).first()
    cols, rows = (max(1, int((b - a) // resolution)) for a, b in ((e0, e1), (n0, n1)))
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col"))
    transform = (resolution, e0, -resolution, n1)
    a, b = (reproject(x, t, grid, transform, zone, south) for x, t in ((first, first_transform), (second, second_transform)))
    both = overlap(pair(a, b, "inner"))
    return both.select(*KEY, F.col("v1").alias("value")), both.select(*KEY, F.col("v2").alias("value")), transform, (32700 if south else 32600) + zone
