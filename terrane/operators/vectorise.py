"""Polygons from cells: the outlines of patches, and stable ground derived from unstable areas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import geometry, raster, zonal

_RINGS = "patch long, rings array<array<struct<x:double,y:double>>>"
POLYGON = ["poly_id", "name", "category", "rings"]


def _traced(edges: pd.DataFrame) -> list[list[tuple[int, int]]]:
    """Closed rings from unit edges that keep the patch on their right; where two rings touch, each keeps to its own cell."""
    out_of: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y, dx, dy in edges[["x", "y", "dx", "dy"]].to_numpy().tolist():
        out_of.setdefault((x, y), []).append((dx, dy))
    rings = []
    for start in sorted(out_of):
        while out_of[start]:
            place, step, ring = start, out_of[start].pop(), [start]
            while True:
                place = (place[0] + step[0], place[1] + step[1])
                ways = out_of[place]
                if place == start and not (len(ways) > 0 and (-step[1], step[0]) in ways):
                    break
                turn = (-step[1], step[0])  # to the right, with rows downwards
                following = turn if turn in ways else ways[0]
                ways.remove(following)
                if following != step:
                    ring.append(place)
                step = following
            # the start stays a vertex only if the ring turns there
            first = (ring[1][0] - ring[0][0], ring[1][1] - ring[0][1]) if len(ring) > 1 else step
            if np.sign(first[0]) == step[0] and np.sign(first[1]) == step[1]:
                ring = ring[1:]
            rings.append(ring)
    return rings


def outlines(patches: DataFrame, transform: tuple = (1.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """patch and rings of ``patches(row, col, patch)``: the outer ring and those of holes, in map units by (a, c, e, f).

    Sides between two cells of a patch fall away in a join; a task traces what is left of a patch, its outline.
    """
    a, c, e, f = transform
    sides = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dr", "dc", "x0", "y0", "dx", "dy"), side)]) for side in ((-1, 0, 0, 0, 1, 0), (0, 1, 1, 0, 0, 1), (1, 0, 1, 1, -1, 0), (0, -1, 0, 1, 0, -1))])
    cells = patches.select(F.col("row").cast("long"), F.col("col").cast("long"), "patch")
    spread = cells.withColumn("s", F.explode(sides)).select("patch", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), (F.col("col") + F.col("s.x0")).alias("x"), (F.col("row") + F.col("s.y0")).alias("y"), "s.dx", "s.dy")
    outer = spread.join(cells, ["row", "col", "patch"], "left_anti").select("patch", "x", "y", "dx", "dy")

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = [[{"x": c + x * a, "y": f + y * e} for x, y in ring] for ring in _traced(pdf)]
        return pd.DataFrame({"patch": [pdf["patch"].iloc[0]], "rings": [rings]})

    return outer.groupBy("patch").applyInPandas(trace, _RINGS)


def derive_stable(cells: DataFrame, unstable_edges: DataFrame | None = None, existing: DataFrame | None = None, replace: bool = True, exclude_nodata: bool = True, min_area: float = 0.0, transform: tuple = (1.0, 0.0, 1.0, 0.0), base: str = "stable") -> DataFrame:
    """Polygons of the cells outside all unstable areas: poly_id, name, category and rings.

    Cells without a value don't count unless ``exclude_nodata`` is off, when all cells within the raster's bounds do.  Polygons
    smaller than ``min_area`` fall away; the others are named by base and number.  They stand for the ``existing`` ones, or
    come after them if ``replace`` is off.
    """
    if not exclude_nodata:
        box = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
        if box[0] is not None:
            wide = int(box[3] - box[2]) + 1
            cells = cells.sparkSession.range((int(box[1] - box[0]) + 1) * wide).select((F.floor(F.col("id") / wide) + int(box[0])).cast("long").alias("row"), (F.col("id") % wide + int(box[2])).alias("col"), F.lit(1.0).alias("value"))
    held = zonal.stable(cells, unstable_edges)
    found = outlines(raster.patches(held), transform).withColumnRenamed("patch", "poly_id")
    sized = found.join(geometry.measures(geometry.edges(found)).select("poly_id", "area"), "poly_id")
    kept = geometry.at_least(sized, min_area)
    start = 0
    if existing is not None and not replace:
        start = existing.count()
    named = zonal.named(kept.withColumn("name", F.lit(None).cast("string")), base, start)
    out = named.select("poly_id", "name", F.lit("stable").alias("category"), "rings")
    if start:
        out = existing.select(F.col("poly_id").cast("long").alias("poly_id"), "name", "category", "rings").unionByName(out)
    return out
