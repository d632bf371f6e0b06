"""Statistics of cells, over all of them or by polygon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.geometry import within
from terrane.operators.ranks import percentiles

KEY = ["row", "col"]


def describe(cells: DataFrame, *by: str, value: str = "value", order: tuple = ("row", "col")) -> DataFrame:
    """Mean, median, mode (the value met first, in row-major order), population moments and outer percentiles."""
    v, p = F.col(value), F.col("p")
    valid = cells.filter(v.isNotNull())
    main = valid.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.count(v).alias("n"),
    )
    parts = [percentiles(valid, (0.5, 0.005, 0.995), *by, value=value), first_mode(cells, *by, value=value, order=order)]
    for part in parts:  # a row a group
        main = main.join(part, list(by)) if by else main.join(F.broadcast(part))
    return main.select(*by, "mean", p[0].alias("median"), "std", "variance", "min", "max", "skewness", "kurtosis", p[1].alias("p0_5"), p[2].alias("p99_5"), "n", "mode")


def first_mode(cells: DataFrame, *by: str, value: str = "value", order: tuple = ("row", "col")) -> DataFrame:
    counts = cells.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), "first")).alias("mode"))


def smallest_mode(cells: DataFrame, value: str = "value") -> DataFrame:
    counts = cells.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(value, F.struct(-F.col("n"), value)).alias("mode"))


def summary(cells: DataFrame, value: str = "value") -> DataFrame:
    """The figures beside a histogram; mode is the smallest one."""
    p = F.col("p")
    ends = cells.agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = ends.join(F.broadcast(percentiles(cells, (0.5, 0.25, 0.75, 0.01, 0.99), value=value))).join(F.broadcast(smallest_mode(cells, value)))
    return out.select("mean", p[0].alias("median"), "mode", p[1].alias("q1"), p[2].alias("q3"), p[3].alias("p1"), p[4].alias("p99"), "min", "max")


def histogram(cells: DataFrame, bins: int = 60, value: str = "value") -> DataFrame:
    """bin (0 ..), its edges and count; the upper edge belongs to the last bin; empty bins are listed."""
    ends = cells.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    at = F.coalesce(F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("w"), F.lit(0.0))), F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = cells.filter(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    spine = ends.filter("lo is not null").select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "w")
    return spine.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("from"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("to"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def median(cells: DataFrame, value: str = "value") -> DataFrame:
    return percentiles(cells, (0.5,), value=value).select(F.col("p")[0].alias("median"))


def rms(cells: DataFrame, value: str = "value", strict: bool = False) -> DataFrame:
    """Root mean square; ``strict`` raises at run time where there is no value."""
    out = F.sqrt(F.avg(F.col(value) * F.col(value)))
    return cells.agg((F.coalesce(out, F.raise_error(F.lit("no valid cells")).cast("double")) if strict else out).alias("rms"))


def uncorrelated(value: str = "value") -> Column:
    """RMS over the root of the number of valid cells, as an aggregate."""
    v = F.col(value)
    return F.sqrt(F.avg(v * v)) / F.sqrt(F.nullif(F.count(v), F.lit(0)).cast("double"))


def centres(cells: DataFrame) -> DataFrame:
    """Cells whose keys are their coordinates, for polygons in grid units."""
    return cells.withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")})


def by_polygon(cells: DataFrame, polygon_edges: DataFrame) -> DataFrame:
    """Cells by polygon; one in several polygons comes once for each."""
    return within(centres(cells), polygon_edges, KEY).drop("x", "y")


def mask(cells: DataFrame, polygon_edges: DataFrame) -> DataFrame:
    """All cells, values outside every polygon null."""
    held = by_polygon(cells, polygon_edges).select(*KEY).distinct().withColumn("held", F.lit(True))
    return cells.join(held, KEY, "left").select(*KEY, F.when(F.col("held"), F.col("value")).alias("value"))


def clip(cells: DataFrame, polygon_edges: DataFrame) -> DataFrame:
    return cells.join(by_polygon(cells, polygon_edges).select(*KEY).distinct(), KEY, "left_semi")


def stable(cells: DataFrame, unstable_edges: DataFrame | None) -> DataFrame:
    """Valid cells outside all polygons of interest."""
    valid = cells.filter("value is not null")
    if unstable_edges is None:
        return valid
    return valid.join(by_polygon(valid, unstable_edges).select(*KEY).distinct(), KEY, "left_anti")


def pixel_counts(cells: DataFrame, polygons: DataFrame, polygon_edges: DataFrame) -> DataFrame:
    """Polygons with their numbers of valid cells."""
    counts = by_polygon(cells.filter("value is not null"), polygon_edges).groupBy("poly_id").agg(F.count("*").alias("pixels"))
    return polygons.join(counts, "poly_id", "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)).cast("long"))


def stats_all(cells: DataFrame, polygon_edges: DataFrame) -> DataFrame:
    return describe(clip(cells, polygon_edges)).withColumn("area_id", F.lit("all_areas"))


def stats_each(cells: DataFrame, polygon_edges: DataFrame) -> DataFrame:
    return describe(by_polygon(cells, polygon_edges), "poly_id").withColumnRenamed("poly_id", "area_id")


def named(polygons: DataFrame, base: str, start: int = 0) -> DataFrame:
    """Names where they are missing: base and position."""
    from terrane.functions.scalars import auto_name

    order = F.row_number().over(Window.orderBy("poly_id"))
    return polygons.withColumn("name", auto_name(F.col("name"), base, order + start))
