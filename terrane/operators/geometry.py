"""Polygons as edges: point in polygon, area, centroid, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalars import utm_forward

#: Edges up to which the polygon side of a join is broadcast; beyond, the join goes by tiles.
BROADCAST_EDGES = 200_000
#: Tiles along the longer side of all bounds, where polygons are too many to broadcast.
TILES = 256


def edges(polygons: DataFrame) -> DataFrame:
    """Edges of ``polygons(poly_id, rings)``; open rings are closed, horizontal edges never cross and are left out."""
    ring = polygons.select("poly_id", F.posexplode("rings").alias("ring", "r"))
    closed = ring.select("poly_id", "ring", F.concat("r", F.slice("r", 1, 1)).alias("r"))
    pairs = F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r") - 1), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    return closed.select("poly_id", "ring", F.posexplode(pairs).alias("seq", "e")).select("poly_id", "ring", "seq", "e.*")


def crosses(x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) to the right crosses the edge in scope."""
    at = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    return ((F.col("y1") > y) != (F.col("y2") > y)) & (x < at)


def inside(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Point in a constant polygon as one expression."""
    hits = F.lit(0)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if y1 != y2:
                hits = hits + F.when(((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < F.lit(float(x2 - x1)) * (y - F.lit(float(y1))) / F.lit(float(y2 - y1)) + F.lit(float(x1))), 1).otherwise(0)
    return hits % 2 == 1


def bounds(polygon_edges: DataFrame) -> DataFrame:
    return polygon_edges.groupBy("poly_id").agg(*[f(*c).alias(n) for n, f, c in (("minx", _low, "x"), ("maxx", _high, "x"), ("miny", _low, "y"), ("maxy", _high, "y"))])


def _low(axis: str) -> Column:
    return F.least(F.min(f"{axis}1"), F.min(f"{axis}2"))


def _high(axis: str) -> Column:
    return F.greatest(F.max(f"{axis}1"), F.max(f"{axis}2"))


def measures(polygon_edges: DataFrame) -> DataFrame:
    """Area, centroid and bounds by the shoelace formula."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    out = polygon_edges.groupBy("poly_id").agg(
        (F.sum(cross) / 2).alias("signed"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("mx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("my"),
        _low("x").alias("minx"), _high("x").alias("maxx"), _low("y").alias("miny"), _high("y").alias("maxy"),
    )
    six = F.nullif(6 * F.col("signed"), F.lit(0.0))
    return out.select("poly_id", F.abs("signed").alias("area"), (F.col("mx") / six).alias("cx"), (F.col("my") / six).alias("cy"), "minx", "maxx", "miny", "maxy")


def at_least(polygons: DataFrame, area: float) -> DataFrame:
    return polygons.filter(F.col("area") >= area) if area > 0 else polygons


def _odd(edge_list: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) to the right crosses an odd number of the listed edges."""
    def hit(e):
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)

    return F.size(F.filter(edge_list, hit)) % 2 == 1


def within(points: DataFrame, polygon_edges: DataFrame, key: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with the poly_id of each polygon that holds them; a point in several polygons gets a row each.

    Bounds pick candidates.  While edges are few a polygon is a row with its list of edges, which is broadcast, so that
    points stay where they are; else candidates meet through tiles that the bounds cover, as wide as a 256th of all bounds, and
    the ray crossings are counted by edge.  ``key`` names a point.
    """
    sloped, box = polygon_edges.filter("y1 <> y2"), bounds(polygon_edges)
    small = polygon_edges.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES
    hit = (F.col(x) >= F.col("minx")) & (F.col(x) <= F.col("maxx")) & (F.col(y) >= F.col("miny")) & (F.col(y) <= F.col("maxy"))
    names = points.columns
    if small:
        lists = sloped.groupBy("poly_id").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
        near = points.join(F.broadcast(box.join(lists, "poly_id")), hit)
        return near.filter(_odd(F.col("edges"), F.col(x), F.col(y))).select(*names, "poly_id")
    all_ = box.agg(F.min("minx"), F.min("miny"), F.greatest(F.max("maxx") - F.min("minx"), F.max("maxy") - F.min("miny"))).first()
    x0, y0, side = all_[0], all_[1], max(all_[2] / TILES, 1e-9)
    tile = lambda v, low: F.floor((v - low) / side).cast("long")
    tiles = box.withColumn("tx", F.explode(F.sequence(tile(F.col("minx"), x0), tile(F.col("maxx"), x0)))).withColumn("ty", F.explode(F.sequence(tile(F.col("miny"), y0), tile(F.col("maxy"), y0))))
    near = points.withColumns({"tx": tile(F.col(x), x0), "ty": tile(F.col(y), y0)}).join(tiles, ["tx", "ty"]).filter(hit).select(*dict.fromkeys([*key, x, y]), "poly_id")
    crossed = near.join(sloped, "poly_id").filter(crosses(F.col(x), F.col(y)))
    odd = crossed.groupBy(*key, "poly_id").agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")
    return points.join(odd, key).select(*names, "poly_id")


def to_utm(polygons: DataFrame, zone: int) -> DataFrame:
    """Rings in longitude and latitude to UTM, vertex by vertex."""
    def moved(p):
        east, north = utm_forward(p["x"], p["y"], F.lit(zone))
        return F.struct(east.alias("x"), north.alias("y"))

    return polygons.withColumn("rings", F.transform("rings", lambda r: F.transform(r, moved)))
