"""How the star-schema tables stand in for surveys, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import geometry, pointcloud, raster

TRIANGLE = [(10.5, 10.5), (80.5, 20.5), (60.5, 90.5)]
KITE = [(30.3, 5.7), (55.9, 40.1), (30.3, 75.3), (5.1, 40.9)]
MODEL = ([20.0, 5.0], [8.0, 25.0], 3.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x and y from part and order keys, z in thousands from prices, two surveys by line status."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        (F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_orderkey") % 100).cast("double").alias("y"), (F.col("l_extendedprice") / 1000).alias("z"),
        F.col("l_linenumber").alias("classification"), F.when(F.col("l_linestatus") == "F", "compare").otherwise("reference").alias("survey"), F.col("l_shipdate").alias("acquired"),
    )


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean z of the two surveys by cell, one pass over the points."""
    p = points(spark, sf_dir).withColumns({"row": F.col("y").cast("long"), "col": F.col("x").cast("long")})
    by = lambda s: F.avg(F.when(F.col("survey") == s, F.col("z")))
    return p.groupBy("row", "col").agg(by("compare").alias("v1"), by("reference").alias("v2"))


def survey(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pointcloud.grid(points(spark, sf_dir).filter(F.col("survey") == name), "mean")


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.overlap(both(spark, sf_dir)).select("row", "col", (F.col("v2") - F.col("v1")).alias("value"))


def full_grid(cells: DataFrame, size: int = 100) -> DataFrame:
    """All cells of the square grid, null where there is no value."""
    spine = cells.sparkSession.range(size * size).select(F.floor(F.col("id") / size).cast("long").alias("row"), (F.col("id") % size).alias("col"))
    return spine.join(cells, ["row", "col"], "left").select("row", "col", "value")


def polygons(spark: SparkSession) -> DataFrame:
    rows = [(1, "slide", [TRIANGLE]), (2, None, [KITE])]
    return spark.createDataFrame([(i, n, [[{"x": x, "y": y} for x, y in r] for r in rings]) for i, n, rings in rows], "poly_id int, name string, rings array<array<struct<x:double,y:double>>>")


def polygon_edges(spark: SparkSession) -> DataFrame:
    return geometry.edges(polygons(spark))


P = "p AS (SELECT CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_orderkey % 100 AS DOUBLE) AS y, l_extendedprice / 1000e0 AS z, l_linenumber AS classification, CASE l_linestatus WHEN 'F' THEN 'compare' ELSE 'reference' END AS survey, l_shipdate AS acquired FROM lineitem)"
G = P + ", g AS (SELECT CAST(y AS BIGINT) AS \"row\", CAST(x AS BIGINT) AS col, avg(CASE WHEN survey = 'compare' THEN z END) AS v1, avg(CASE WHEN survey = 'reference' THEN z END) AS v2 FROM p GROUP BY 1, 2)"
D = G + ", d AS (SELECT \"row\", col, v2 - v1 AS value FROM g WHERE v1 IS NOT NULL AND v2 IS NOT NULL)"
SPINE = "s AS (SELECT i // 100 AS \"row\", i % 100 AS col FROM (SELECT unnest(range(10000)) AS i))"
FULL = D + ", " + SPINE + ", f AS (SELECT s.\"row\", s.col, d.value FROM s LEFT JOIN d USING (\"row\", col))"


def edge_values() -> str:
    rows = []
    for i, ring in ((1, TRIANGLE), (2, KITE)):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            rows.append(f"({i}, {x1}e0, {y1}e0, {x2}e0, {y2}e0)")
    return "e(poly_id, x1, y1, x2, y2) AS (VALUES " + ", ".join(rows) + ")"


CROSS = "sum(CASE WHEN (y1 > \"row\") <> (y2 > \"row\") AND col < (x2 - x1) * (\"row\" - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1"
IN = D + ", " + edge_values() + ", h AS (SELECT \"row\", col, any_value(value) AS value, poly_id FROM d, e GROUP BY \"row\", col, poly_id HAVING " + CROSS + ")"


def gamma_sql(h: str, model=MODEL) -> str:
    out = f"{model[2]}e0"
    for c, a in zip(model[0], model[1]):
        r = f"(({h}) / {a}e0)"
        out += f" + CASE WHEN {h} <= {a}e0 THEN {c}e0 * (1.5e0 * {r} - 0.5e0 * {r} * {r} * {r}) ELSE {c}e0 END"
    return f"({out})"
