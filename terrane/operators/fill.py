"""Filling cells without a value.

idw takes the nearest valid cell in each of eight directions (rows, columns and both diagonals) within reach, weighted by
1 / distance; what was filled may then be smoothed by means over three by three cells.  linear interpolates
along row and column between the valid cells at either side and averages the two; outside of such a pair there is
no value.  cubic and spline solve a radial system (cubed distances, thin plates) over a window around
each tile.  The deviations from a global triangulation are these.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells along the side of a tile that a radial system is solved for.
SPLINE_TILE = 12
METHODS = ("idw", "nearest", "linear", "cubic", "spline")


def _sides(cells: DataFrame) -> DataFrame:
    """The nearest valid cells left, right, above and below, as (position, value)."""
    out = cells
    for axis, other in (("col", "row"), ("row", "col")):
        order = Window.partitionBy(other).orderBy(axis)
        pair = F.when(F.col("value").isNotNull(), F.struct(F.col(axis).alias("p"), F.col("value").alias("v")))
        out = out.withColumn(f"{axis}_before", F.last(pair, True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        out = out.withColumn(f"{axis}_after", F.first(pair, True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    return out


def _idw(cells: DataFrame, reach: int, smoothing: int) -> DataFrame:
    out = cells
    lines = {"across": (F.col("row"), F.col("col"), 1.0), "down": (F.col("col"), F.col("row"), 1.0), "fall": (F.col("row") - F.col("col"), F.col("col"), 2**0.5), "rise": (F.col("row") + F.col("col"), F.col("col"), 2**0.5)}
    weights, values = [], []
    for name, (line, place, step) in lines.items():
        order = Window.partitionBy(line).orderBy(place)
        pair = F.when(F.col("value").isNotNull(), F.struct(place.alias("p"), F.col("value").alias("v")))
        out = out.withColumn(f"{name}_before", F.last(pair, True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        out = out.withColumn(f"{name}_after", F.first(pair, True).over(order.rowsBetween(1, Window.unboundedFollowing)))
        for side in ("before", "after"):
            s = F.col(f"{name}_{side}")
            d = F.abs(s["p"] - place).cast("double") * step
            near = s.isNotNull() & (d <= reach)
            weights.append(F.when(near, 1 / d).otherwise(0.0))
            values.append(F.when(near, s["v"] / d).otherwise(0.0))
    made = sum(values[1:], values[0]) / F.nullif(sum(weights[1:], weights[0]), F.lit(0.0))
    out = out.select("row", "col", F.col("value").isNull().alias("gap"), F.coalesce("value", made).alias("value"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    for _ in range(smoothing):
        near = out.filter("value is not null").withColumn("o", F.explode(steps)).groupBy((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col")).agg(F.avg("value").alias("mean"))
        out = out.join(near, ["row", "col"], "left").select("row", "col", "gap", F.when(F.col("gap") & F.col("value").isNotNull(), F.col("mean")).otherwise(F.col("value")).alias("value"))
    return out.select("row", "col", "value")


def _linear(cells: DataFrame, reach: int) -> DataFrame:
    lines = []
    for axis in ("col", "row"):
        a, b = F.col(f"{axis}_before"), F.col(f"{axis}_after")
        near = (F.col(axis) - a["p"] <= reach) & (b["p"] - F.col(axis) <= reach)
        lines.append(F.when(near, a["v"] + (b["v"] - a["v"]) * (F.col(axis) - a["p"]) / (b["p"] - a["p"])))
    both = F.coalesce((lines[0] + lines[1]) / 2, *lines)
    return _sides(cells).select("row", "col", F.coalesce("value", both).alias("value"))


def nearest(cells: DataFrame, reach: int) -> DataFrame:
    """Value of the nearest valid cell, the first by row and column of equals.

    One axis after the other: of each row within reach a gap needs only the valid cells next to its column, which one ordered
    pass over the row finds; of these the nearest is taken.  So a gap costs 2 * reach + 1 rows, not their square.
    """
    rows = F.sequence(F.col("row") - reach, F.col("row") + reach)
    gaps = cells.filter("value is null").select(F.col("row").cast("long").alias("gap"), F.col("col").cast("long").alias("col"), F.explode(rows.cast("array<long>")).alias("row"))
    known = cells.filter("value is not null").select(F.lit(None).cast("long").alias("gap"), F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"), "value")
    order = Window.partitionBy("row").orderBy("col")
    here = F.when(F.col("value").isNotNull(), F.struct(F.col("col").alias("c"), F.col("value").alias("v")))
    sides = gaps.withColumn("value", F.lit(None).cast("double")).unionByName(known)
    sides = sides.withColumn("before", F.last(here, True).over(order.rangeBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first(here, True).over(order.rangeBetween(0, Window.unboundedFollowing)))
    either = sides.filter("gap is not null").select("gap", "col", "row", F.explode(F.array("before", "after")).alias("x")).filter("x is not null")
    d2 = (F.col("row") - F.col("gap")) * (F.col("row") - F.col("gap")) + (F.col("x.c") - F.col("col")) * (F.col("x.c") - F.col("col"))
    made = either.withColumn("d2", d2).filter(F.col("d2") <= reach * reach).groupBy(F.col("gap").alias("row"), "col").agg(F.min_by("x.v", F.struct("d2", "row", "x.c")).alias("made"))
    return cells.join(made, ["row", "col"], "left").select("row", "col", F.coalesce("value", "made").alias("value"))


def _spline(cells: DataFrame, reach: int, cubic: bool) -> DataFrame:
    """Thin-plate (or cubic radial) interpolation of a tile's gaps from all valid cells of the tiles around.

    A tile is as wide as the reach, up to SPLINE_TILE, so a system has nine times its square of cells at most.
    """
    tile = min(max(reach, 8), SPLINE_TILE)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    spread = cells.select("row", "col", "value", F.explode(steps).alias("o")).select("row", "col", "value", (at("row") + F.col("o.i")).alias("ti"), (at("col") + F.col("o.j")).alias("tj"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gaps = pdf[pdf.own & pdf.value.isna()]
        known = pdf[pdf.value.notna()]
        out = pdf[pdf.own][["row", "col", "value"]].copy()
        if len(gaps) and len(known) > 3:
            g, k = gaps[["row", "col"]].to_numpy(float), known[["row", "col"]].to_numpy(float)
            d = np.sqrt(((g[:, None] - k[None]) ** 2).sum(2))
            kernel = (lambda r: r**3) if cubic else (lambda r: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-12)), 0.0))
            p = np.c_[np.ones(len(k)), k]
            system = np.block([[kernel(np.sqrt(((k[:, None] - k[None]) ** 2).sum(2))), p], [p.T, np.zeros((3, 3))]])
            w = np.linalg.lstsq(system, np.r_[known.value.to_numpy(float), np.zeros(3)], rcond=None)[0]
            made = kernel(d) @ w[: len(k)] + np.c_[np.ones(len(g)), g] @ w[len(k) :]
            out.loc[gaps.index, "value"] = np.where(d.min(1) <= reach, made, np.nan)
        return out.astype({"row": "int64", "col": "int64", "value": "float64"})

    return spread.groupBy("ti", "tj").applyInPandas(solve, "row long, col long, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def fill(cells: DataFrame, method: str = "idw", reach: int = 100, smoothing: int = 0) -> DataFrame:
    """row, col and value, gaps within reach of a valid cell filled; ``smoothing`` rounds after idw."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    if method == "nearest":
        return nearest(cells, reach)
    if method in ("spline", "cubic"):
        return _spline(cells, reach, method == "cubic")
    return _idw(cells, reach, smoothing) if method == "idw" else _linear(cells, reach)
