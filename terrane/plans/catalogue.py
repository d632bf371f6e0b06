"""The query catalogue: each operator on the standing tables, with the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import scalars
from terrane.operators import fill, geometry, model, pointcloud, raster, sampling, terrain, uncertainty, variogram, vectorise, zonal
from terrane.plans import fixtures as fx
from terrane.plans import regional, workflow
from terrane.plans.fixtures import D, FULL, G, IN, MODEL, P, edge_values, gamma_sql
from terrane.session import shared_folder
from terrane.sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded, so that engines that sum in another order agree."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6_sql(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in columns)


# --- point clouds ------------------------------------------------------------


@query("grid_max", f"WITH {P} SELECT CAST(y AS BIGINT) AS \"row\", CAST(x AS BIGINT) AS col, round(max(z), 6) AS value FROM p GROUP BY 1, 2")
def grid_max(spark, d):
    return r6(pointcloud.dem(fx.points(spark, d), "dsm"))


@query("grid_idw", f"""WITH {P}, o AS (SELECT i, j FROM (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j)),
n AS (SELECT CAST(y AS BIGINT) + i AS "row", CAST(x AS BIGINT) + j AS col, z, sqrt(CAST(i * i + j * j AS DOUBLE)) AS d FROM p, o WHERE classification = 2 AND i * i + j * j <= 1)
SELECT "row", col, round(coalesce(avg(CASE WHEN d = 0 THEN z END), sum(CASE WHEN d > 0 THEN z / d END) / sum(CASE WHEN d > 0 THEN 1 / d END)), 6) AS value FROM n GROUP BY 1, 2""")
def grid_idw(spark, d):
    return r6(pointcloud.dem(fx.points(spark, d), "dtm", radius=1.0, centred=True))


@query("grid_mean_count", f"WITH {P} SELECT survey, CAST(y AS BIGINT) AS \"row\", CAST(x AS BIGINT) AS col, round(avg(z), 6) AS mean, count(*) AS n FROM p GROUP BY 1, 2, 3")
def grid_mean_count(spark, d):
    p = fx.points(spark, d)
    mean, n = (pointcloud.grid(p, m, keys=("survey",)).withColumnRenamed("value", m) for m in ("mean", "count"))
    return r6(mean.join(n, ["survey", "row", "col"]).select("survey", "row", "col", "mean", F.col("count").alias("n")))


@query("grid_min_stdev", f"WITH {P} SELECT CAST(y AS BIGINT) AS \"row\", CAST(x AS BIGINT) AS col, round(min(z), 6) AS low, round(stddev_pop(z), 6) AS spread FROM p GROUP BY 1, 2")
def grid_min_stdev(spark, d):
    p = fx.points(spark, d)
    low, spread = (pointcloud.grid(p, m).withColumnRenamed("value", n) for m, n in (("min", "low"), ("stdev", "spread")))
    return r6(low.join(spread, ["row", "col"]))


@query("crop_bbox", f"WITH {P} SELECT x, y, round(z, 6) AS z FROM p WHERE x BETWEEN 20 AND 40 AND y BETWEEN 30 AND 35")
def crop_bbox(spark, d):
    return r6(pointcloud.crop_box(fx.points(spark, d), 20, 30, 40, 35).select("x", "y", "z"))


@query("crop_polygon", f"""WITH {P}, {edge_values()}, q AS (SELECT DISTINCT x, y FROM p),
i AS (SELECT x, y FROM q, e WHERE poly_id = 1 GROUP BY x, y HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1)
SELECT x, y, count(*) AS n, round(sum(z), 6) AS total FROM p JOIN i USING (x, y) GROUP BY x, y""")
def crop_polygon(spark, d):
    kept = pointcloud.crop(fx.points(spark, d), [fx.TRIANGLE])
    return kept.groupBy("x", "y").agg(F.count("*").alias("n"), F.round(F.sum("z"), 6).alias("total"))


@query("noise_filter", f"WITH {P} SELECT classification, count(*) AS n, round(sum(z), 6) AS total FROM p WHERE classification NOT IN (7, 18) GROUP BY 1")
def noise_filter(spark, d):
    return pointcloud.drop_noise(fx.points(spark, d)).groupBy("classification").agg(F.count("*").alias("n"), F.round(F.sum("z"), 6).alias("total"))


@query("ground_filter_dtm", f"WITH {P} SELECT CAST(y AS BIGINT) AS \"row\", CAST(x AS BIGINT) AS col, round(avg(z), 6) AS value FROM p WHERE classification = 2 GROUP BY 1, 2")
def ground_filter_dtm(spark, d):
    return r6(pointcloud.grid(pointcloud.ground(fx.points(spark, d)), "mean"))


@query("reset_classification", f"WITH {P} SELECT 0 AS classification, count(*) AS n FROM p")
def reset_classification(spark, d):
    return pointcloud.reset_classification(fx.points(spark, d)).groupBy("classification").agg(F.count("*").alias("n"))


@query("cloud_stats", f"WITH {P} SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, min(epoch(acquired) - 315964800) AS min_gps_time, max(epoch(acquired) - 315964800) AS max_gps_time FROM p")
def cloud_stats(spark, d):
    p = fx.points(spark, d).withColumn("gps_time", F.unix_timestamp(F.col("acquired").cast("timestamp")).cast("double") - 315964800)
    return r6(pointcloud.statistics(p))


def _ground_sql(radius: int, slope: float, scalar: float, threshold: float) -> str:
    """The progressive filter on cells of one unit, an opening a step."""
    over = lambda by, n: f"OVER (PARTITION BY {'col' if by == 'row' else 'r'} ORDER BY {'r' if by == 'row' else 'col'} RANGE BETWEEN {n} PRECEDING AND {n} FOLLOWING)"
    steps = "c0 AS (SELECT CAST(floor(y) AS BIGINT) AS r, CAST(floor(x) AS BIGINT) AS col, min(z) AS low, min(z) AS surface, FALSE AS thing FROM p GROUP BY 1, 2)"
    for n in range(1, radius + 1):
        steps += f""", a{n} AS (SELECT *, min(surface) {over('col', n)} AS o1 FROM c{n - 1}), b{n} AS (SELECT *, min(o1) {over('row', n)} AS o2 FROM a{n}),
m{n} AS (SELECT *, max(o2) {over('row', n)} AS o3 FROM b{n}), o{n} AS (SELECT *, max(o3) {over('col', n)} AS o FROM m{n}),
c{n} AS (SELECT r, col, low, o AS surface, thing OR surface - o > {slope * n}e0 AS thing FROM o{n})"""
    side = lambda by, k: f"first(ground) OVER (PARTITION BY {'col' if by == 'row' else 'r'} ORDER BY {'r' if by == 'row' else 'col'} RANGE BETWEEN {f'{k} FOLLOWING AND {k} FOLLOWING' if k > 0 else f'{-k} PRECEDING AND {-k} PRECEDING'})"
    return f"""WITH {P}, {steps}, t AS (SELECT r, col, CASE WHEN thing THEN surface ELSE low END AS ground FROM c{radius}),
n AS (SELECT *, coalesce(({side('col', 1)} - {side('col', -1)}) / 2e0, 0e0) AS gx, coalesce(({side('row', 1)} - {side('row', -1)}) / 2e0, 0e0) AS gy FROM t)
SELECT CASE WHEN abs(z - ground) <= {threshold}e0 + {scalar}e0 * sqrt(gx * gx + gy * gy) THEN 2 ELSE 1 END AS classification, count(*) AS n, round(sum(z), 6) AS total
FROM p JOIN n ON n.r = CAST(floor(y) AS BIGINT) AND n.col = CAST(floor(x) AS BIGINT) GROUP BY 1"""


@query("ground_classes", _ground_sql(5, 0.15, 1.25, 0.5))
def ground_classes(spark, d):
    """Windows up to a radius of five cells; the usual eighteen differ in number only."""
    found = pointcloud.classify_ground(fx.points(spark, d), window=5.0)
    return found.groupBy("classification").agg(F.count("*").alias("n"), F.round(F.sum("z"), 6).alias("total"))


@query("utm_project", None)
def utm_project(spark, d):
    p = fx.points(spark, d).select((F.col("x") / 20 - 87).alias("x"), (F.col("y") / 10 + 35).alias("y"), "z")
    return r6(pointcloud.to_utm(p, 16))


# --- rasters -----------------------------------------------------------------


@query("diff_raster", f"WITH {D} SELECT \"row\", col, round(value, 6) AS value FROM d")
def diff_raster(spark, d):
    return r6(raster.difference(fx.survey(spark, d, "compare"), fx.survey(spark, d, "reference")))


@query("combined_mask", f"WITH {G} SELECT \"row\", col, CAST(CASE WHEN v1 IS NULL OR v2 IS NULL THEN 1 ELSE 0 END AS TINYINT) AS mask FROM g")
def combined_mask(spark, d):
    return raster.combined_mask(a=fx.survey(spark, d, "compare"), b=fx.survey(spark, d, "reference"))


@query("overlap_area", f"WITH {D} SELECT CAST(count(*) AS DOUBLE) AS area FROM d")
def overlap_area(spark, d):
    return raster.valid_area(fx.diff(spark, d))


@query("raster_bounds", f"WITH {D} SELECT CAST(min(col) AS DOUBLE) AS \"left\", CAST(-(max(\"row\") + 1) AS DOUBLE) AS bottom, CAST(max(col) + 1 AS DOUBLE) AS \"right\", CAST(-min(\"row\") AS DOUBLE) AS top FROM d")
def raster_bounds(spark, d):
    return raster.metadata(fx.diff(spark, d))


@query("sym_range", f"WITH {D} SELECT round(-max(abs(value)), 6) AS low, round(max(abs(value)), 6) AS high FROM d")
def sym_range(spark, d):
    return r6(raster.symmetric_range(fx.diff(spark, d)))


@query("debias", f"WITH {D} SELECT \"row\", col, round(value - (SELECT quantile_cont(value, 0.5) FROM d), 6) AS value FROM d")
def debias(spark, d):
    return r6(raster.remove_median(fx.diff(spark, d)))


@query("percentile_clip", f"WITH {D}, q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM d) SELECT \"row\", col, round(value, 6) AS value FROM d, q WHERE value BETWEEN lo AND hi")
def percentile_clip(spark, d):
    return r6(raster.percentile_clip(fx.diff(spark, d)))


@query("plot_mask", f"WITH {G} SELECT \"row\", col, round(CASE WHEN v2 IS NOT NULL THEN v1 END, 6) AS value FROM g WHERE v1 IS NOT NULL")
def plot_mask(spark, d):
    return r6(raster.plot_mask(fx.survey(spark, d, "compare"), fx.survey(spark, d, "reference")))


@query("resample_nearest", f"""WITH {D}, t AS (SELECT i // 40 AS "row", i % 40 AS col FROM (SELECT unnest(range(1600)) AS i))
SELECT t."row", t.col, round(d.value, 6) AS value FROM t LEFT JOIN d ON d."row" = CAST(floor((t."row" + 0.5e0) * 2.5e0) AS BIGINT) AND d.col = CAST(floor((t.col + 0.5e0) * 2.5e0) AS BIGINT)""")
def resample_nearest(spark, d):
    target = spark.range(1600).select(F.floor(F.col("id") / 40).cast("long").alias("row"), (F.col("id") % 40).alias("col"))
    return r6(raster.resample(fx.diff(spark, d), target, (1.0, 0.0, 1.0, 0.0), (2.5, 0.0, 2.5, 0.0)))


@query("align_rasters", f"WITH {P}, a AS (SELECT CAST(floor(y / 2) AS BIGINT) AS \"row\", CAST(floor(x / 2) AS BIGINT) AS col, avg(z) AS v1 FROM p WHERE survey = 'compare' GROUP BY 1, 2), b AS (SELECT CAST(y AS BIGINT) AS \"row\", CAST(x AS BIGINT) AS col, avg(z) AS v2 FROM p WHERE survey = 'reference' GROUP BY 1, 2) "
       "SELECT a.\"row\", a.col, round(b.v2 - a.v1, 6) AS value FROM a JOIN b ON b.\"row\" = 2 * a.\"row\" + 2 AND b.col = 2 * a.col + 1")
def align_rasters(spark, d):
    """The raster of more cells, whose grid begins one row earlier, goes to the other's grid of two by two cells."""
    p = fx.points(spark, d)
    coarse, fine = pointcloud.grid(p.filter("survey = 'compare'"), "mean", 2.0), pointcloud.grid(p.filter("survey = 'reference'"), "mean")
    a, b, _ = raster.align(coarse, fine, (2.0, 0.0, 2.0, 1.0), (1.0, 0.0, 1.0, 0.0))
    return r6(raster.difference(a, b))


@query("datum_shift", f"WITH {D} SELECT \"row\", col, round(value + (10e0 + 0.1e0 * \"row\") - (12e0 + 0.05e0 * col), 6) AS value FROM d")
def datum_shift(spark, d):
    cells = fx.diff(spark, d)
    a = cells.select("row", "col", (F.lit(10.0) + 0.1 * F.col("row")).alias("value"))
    b = cells.select("row", "col", (F.lit(12.0) + 0.05 * F.col("col")).alias("value"))
    return r6(raster.shift_datum(cells, a, b))


@query("patches")
def patches(spark, d):
    """Cells that rose, over the whole grid: the recursive statement is too slow for it, so a test by brute force takes its place."""
    return raster.patches(fx.diff(spark, d).filter("value > 0"))


# --- terrain and gaps --------------------------------------------------------

_N = FULL + """, n AS (SELECT m."row", m.col, """ + ", ".join(f"max(CASE WHEN k.\"row\" - m.\"row\" = {i} AND k.col - m.col = {j} THEN k.value END) AS {n}" for (i, j), n in terrain.PLACES.items()) + """
FROM f m JOIN f k ON k."row" BETWEEN m."row" - 1 AND m."row" + 1 AND k.col BETWEEN m.col - 1 AND m.col + 1 WHERE k.value IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 9),
q AS (SELECT *, ((c + 2 * f + i) - (a + 2 * d + g)) / 8e0 AS gx, ((g + 2 * h + i) - (a + 2 * b + c)) / 8e0 AS gy FROM n)"""


@query("slope", f"WITH {_N} SELECT \"row\", col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS value FROM q")
def slope(spark, d):
    return r6(terrain.slope(fx.diff(spark, d)))


@query("aspect", f"WITH {_N}, z AS (SELECT *, 90e0 - degrees(atan2(gy, -gx)) AS t FROM q) SELECT \"row\", col, round(CASE WHEN gx = 0 AND gy = 0 THEN 0 WHEN t < 0 THEN t + 360 WHEN t >= 360 THEN t - 360 ELSE t END, 6) AS value FROM z")
def aspect(spark, d):
    return r6(terrain.aspect(fx.diff(spark, d)))


@query("hillshade", f"""WITH {_N} SELECT "row", col, round(1 + 254 * greatest(0e0, cos(radians(45e0)) * cos(atan(sqrt(gx * gx + gy * gy))) + sin(radians(45e0)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(135e0) - atan2(gy, -gx))), 6) AS value FROM q""")
def hillshade(spark, d):
    return r6(terrain.hillshade(fx.diff(spark, d)))


@query("roughness", f"WITH {_N} SELECT \"row\", col, round(greatest(a, b, c, d, m, f, g, h, i) - least(a, b, c, d, m, f, g, h, i), 6) AS value FROM q")
def roughness(spark, d):
    return r6(terrain.roughness(fx.diff(spark, d)))


@query("fill_nearest", f"""WITH {FULL}, c AS (SELECT a."row", a.col, b.value, (a."row" - b."row") * (a."row" - b."row") + (a.col - b.col) * (a.col - b.col) AS d2, b."row" AS r, b.col AS cc
FROM f a JOIN d b ON b."row" BETWEEN a."row" - 10 AND a."row" + 10 AND b.col BETWEEN a.col - 10 AND a.col + 10 WHERE a.value IS NULL),
m AS (SELECT "row", col, first(value ORDER BY d2, r, cc) AS made FROM c WHERE d2 <= 100 GROUP BY 1, 2)
SELECT f."row", f.col, round(coalesce(value, made), 6) AS value FROM f LEFT JOIN m USING ("row", col)""")
def fill_nearest(spark, d):
    return r6(fill.fill(fx.full_grid(fx.diff(spark, d)), "nearest", 10))


_SIDE = FULL + """, w AS (SELECT *, """ + ", ".join(
    f"{fn}(CASE WHEN value IS NOT NULL THEN {what} END IGNORE NULLS) OVER (PARTITION BY {other} ORDER BY {axis} ROWS BETWEEN {frame}) AS {axis_name}{part}{side}"
    for axis, other, axis_name in (("col", '"row"', "c"), ('"row"', "col", "r"))
    for fn, frame, side in (("last_value", "UNBOUNDED PRECEDING AND 1 PRECEDING", "b"), ("first_value", "1 FOLLOWING AND UNBOUNDED FOLLOWING", "a"))
    for what, part in ((axis, "p"), ("value", "v"))
) + " FROM f)"


_LINES = (("\"row\"", "col", 1.0), ("col", "\"row\"", 1.0), ("\"row\" - col", "col", 2**0.5), ("\"row\" + col", "col", 2**0.5))
_EIGHT = FULL + ", w AS (SELECT *, " + ", ".join(
    f"{fn}(CASE WHEN value IS NOT NULL THEN {what} END IGNORE NULLS) OVER (PARTITION BY {line} ORDER BY {place} ROWS BETWEEN {frame}) AS {part}{i}{side}"
    for i, (line, place, _) in enumerate(_LINES)
    for fn, frame, side in (("last_value", "UNBOUNDED PRECEDING AND 1 PRECEDING", "b"), ("first_value", "1 FOLLOWING AND UNBOUNDED FOLLOWING", "a"))
    for what, part in ((place, "p"), ("value", "v"))
) + " FROM f)"


def _idw_sql(reach: int) -> str:
    sides = [(place, step, f"p{i}{s}", f"v{i}{s}") for i, (_, place, step) in enumerate(_LINES) for s in "ba"]
    far = lambda x, step, p: f"(CAST(abs({p} - {x}) AS DOUBLE) * {step!r}e0)"
    top = " + ".join(f"coalesce(CASE WHEN {far(x, step, p)} <= {reach} THEN {v} / {far(x, step, p)} END, 0)" for x, step, p, v in sides)
    low = " + ".join(f"coalesce(CASE WHEN {far(x, step, p)} <= {reach} THEN 1 / {far(x, step, p)} END, 0)" for x, step, p, v in sides)
    return f"({top}) / nullif({low}, 0)"


_FILLED = f"{_EIGHT}, i AS (SELECT \"row\", col, value IS NULL AS gap, coalesce(value, {_idw_sql(100)}) AS value FROM w)"


@query("fill_idw", f"WITH {_FILLED}, o AS (SELECT unnest([-1, 0, 1]) AS k), m AS (SELECT \"row\" + a.k AS \"row\", col + b.k AS col, avg(value) AS mean FROM i, o a, o b WHERE value IS NOT NULL GROUP BY 1, 2) "
       "SELECT i.\"row\", i.col, round(CASE WHEN gap AND value IS NOT NULL THEN mean ELSE value END, 6) AS value FROM i LEFT JOIN m ON m.\"row\" = i.\"row\" AND m.col = i.col")
def fill_idw(spark, d):
    """The usual reach of 100 cells, smoothed once."""
    return r6(fill.fill(fx.full_grid(fx.diff(spark, d)), "idw", 100, 1))


@query("fill_linear", f"""WITH {_SIDE}, l AS (SELECT *, CASE WHEN col - cpb <= 10 AND cpa - col <= 10 THEN cvb + (cva - cvb) * (col - cpb) / (cpa - cpb) END AS a, CASE WHEN "row" - rpb <= 10 AND rpa - "row" <= 10 THEN rvb + (rva - rvb) * ("row" - rpb) / (rpa - rpb) END AS b FROM w)
SELECT "row", col, round(coalesce(value, (a + b) / 2, a, b), 6) AS value FROM l""")
def fill_linear(spark, d):
    return r6(fill.fill(fx.full_grid(fx.diff(spark, d)), "linear", 10))


@query("fill_spline")
def fill_spline(spark, d):
    return fill.fill(fx.full_grid(fx.diff(spark, d)), "spline", 10)


@query("fill_cubic")
def fill_cubic(spark, d):
    return fill.fill(fx.full_grid(fx.diff(spark, d)), "cubic", 10)


# --- statistics and polygons -------------------------------------------------


def _describe_sql(source: str, key: str = "") -> str:
    k, on = (f"{key}, ", f"USING ({key})") if key else ("", "ON true")
    by = f"GROUP BY {key}" if key else ""
    return f"""mu AS (SELECT {k}avg(value) AS m, stddev_pop(value) AS s FROM {source} {by}),
cnt AS (SELECT {k}value, count(*) AS n, min("row" * 1000 + col) AS first FROM {source} GROUP BY {k}value),
mo AS (SELECT {k}first(value ORDER BY n DESC, first) AS mode FROM cnt {by}),
st AS (SELECT {k}avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_pop(value) AS std, var_pop(value) AS variance, min(value) AS min, max(value) AS max, kurtosis_pop(value) AS kurtosis, quantile_cont(value, 0.005) AS p0_5, quantile_cont(value, 0.995) AS p99_5, count(*) AS n FROM {source} {by}),
sk AS (SELECT {k}avg(power((value - m) / s, 3)) AS skewness FROM {source} JOIN mu {on} {by}),
ds AS (SELECT st.*, skewness, mode FROM st JOIN sk {on} JOIN mo {on})"""


_STATS = r6_sql("mean", "median", "std", "variance", "min", "max", "skewness", "kurtosis", "p0_5", "p99_5", "mode")


@query("descriptive_stats", f"WITH {D}, {_describe_sql('d')} SELECT {_STATS}, n FROM ds")
def descriptive_stats(spark, d):
    return r6(zonal.describe(fx.diff(spark, d)))


@query("mode_first", f"WITH {P}, c AS (SELECT classification, count(*) AS n, min(y * 100 + x) AS first FROM p GROUP BY 1) SELECT first(classification ORDER BY n DESC, first) AS mode FROM c")
def mode_first(spark, d):
    return zonal.first_mode(fx.points(spark, d), value="classification", order=("y", "x"))


@query("mode_smallest", f"WITH {P}, c AS (SELECT classification, count(*) AS n FROM p GROUP BY 1) SELECT first(classification ORDER BY n DESC, classification) AS mode FROM c")
def mode_smallest(spark, d):
    return zonal.smallest_mode(fx.points(spark, d), "classification")


@query("data_summary", f"WITH {D} SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, (SELECT round(value, 6) FROM d GROUP BY value ORDER BY count(*) DESC, value LIMIT 1) AS mode, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.99), 6) AS p99, round(min(value), 6) AS min, round(max(value), 6) AS max FROM d")
def data_summary(spark, d):
    return r6(zonal.summary(fx.diff(spark, d)))


@query("hist60", f"""WITH {P}, w AS (SELECT min(z) AS lo, max(z) AS hi, (max(z) - min(z)) / 60 AS w FROM p), c AS (SELECT CAST(least(floor((z - lo) / w), 59) AS INTEGER) AS bin, count(*) AS n FROM p, w GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * w, 6) AS "from", round(lo + (b.bin + 1) * w, 6) AS "to", coalesce(n, 0) AS n FROM (SELECT unnest(range(60)) AS bin) b JOIN w ON true LEFT JOIN c ON c.bin = b.bin""")
def hist60(spark, d):
    return r6(zonal.histogram(fx.points(spark, d), 60, "z"))


@query("median_bias", f"WITH {D} SELECT round(quantile_cont(value, 0.5), 6) AS median FROM d")
def median_bias(spark, d):
    return r6(zonal.median(fx.diff(spark, d)))


@query("rms", f"WITH {D} SELECT round(sqrt(avg(value * value)), 6) AS rms FROM d")
def rms(spark, d):
    return r6(zonal.rms(fx.diff(spark, d)))


@query("uncorrelated_term", f"WITH {D} SELECT round(sqrt(avg(value * value)) / sqrt(count(*)), 6) AS uncorrelated FROM d")
def uncorrelated_term(spark, d):
    return r6(fx.diff(spark, d).agg(zonal.uncorrelated().alias("uncorrelated")))


@query("zonal_all", f"WITH {IN}, a AS (SELECT DISTINCT \"row\", col, value FROM h), {_describe_sql('a')} SELECT {_STATS}, n, 'all_areas' AS area_id FROM ds")
def zonal_all(spark, d):
    return r6(zonal.stats_all(fx.diff(spark, d), fx.polygon_edges(spark)))


@query("zonal_each", f"WITH {IN}, {_describe_sql('h', 'poly_id')} SELECT poly_id AS area_id, {_STATS}, n FROM ds")
def zonal_each(spark, d):
    return r6(zonal.stats_each(fx.diff(spark, d), fx.polygon_edges(spark)))


@query("pixel_count", f"WITH {IN} SELECT poly_id, CASE poly_id WHEN 1 THEN 'slide' ELSE 'area2' END AS name, count(*) AS pixels FROM h GROUP BY 1")
def pixel_count(spark, d):
    polygons = zonal.named(fx.polygons(spark), "area")
    return zonal.pixel_counts(fx.diff(spark, d), polygons, fx.polygon_edges(spark)).select("poly_id", "name", "pixels")


@query("mask_all", f"WITH {IN} SELECT d.\"row\", d.col, round(a.value, 6) AS value FROM d LEFT JOIN (SELECT DISTINCT \"row\", col, value FROM h) a USING (\"row\", col)")
def mask_all(spark, d):
    return r6(zonal.mask(fx.diff(spark, d), fx.polygon_edges(spark)))


@query("mask_each", f"WITH {IN} SELECT \"row\", col, round(value, 6) AS value, poly_id FROM h")
def mask_each(spark, d):
    return r6(zonal.by_polygon(fx.diff(spark, d), fx.polygon_edges(spark)).select("row", "col", "value", "poly_id"))


@query("clip_raster", f"WITH {IN} SELECT \"row\", col, round(value, 6) AS value FROM h WHERE poly_id = 2")
def clip_raster(spark, d):
    return r6(zonal.clip(fx.diff(spark, d), fx.polygon_edges(spark).filter("poly_id = 2")))


@query("stable_minus_foi", f"WITH {IN} SELECT \"row\", col, round(value, 6) AS value FROM d ANTI JOIN h USING (\"row\", col)")
def stable_minus_foi(spark, d):
    return r6(zonal.stable(fx.diff(spark, d), fx.polygon_edges(spark)))


@query("polygon_area", f"""WITH {edge_values()}, m AS (SELECT poly_id, sum(x1 * y2 - x2 * y1) / 2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my, least(min(x1), min(x2)) AS minx, greatest(max(x1), max(x2)) AS maxx, least(min(y1), min(y2)) AS miny, greatest(max(y1), max(y2)) AS maxy FROM e GROUP BY 1)
SELECT poly_id, round(abs(a), 6) AS area, round(mx / (6 * a), 6) AS cx, round(my / (6 * a), 6) AS cy, minx, maxx, miny, maxy FROM m WHERE abs(a) >= 100""")
def polygon_area(spark, d):
    return r6(geometry.at_least(geometry.measures(fx.polygon_edges(spark)), 100))


@query("wkt_flat", "SELECT * FROM (VALUES (1, '10.5, 10.5, 80.5, 20.5, 60.5, 90.5'), (2, '30.3, 5.7, 55.9, 40.1, 30.3, 75.3, 5.1, 40.9')) t(poly_id, wkt)")
def wkt_flat(spark, d):
    return fx.polygons(spark).select("poly_id", scalars.flat_wkt(F.col("rings")).alias("wkt"))


@query("geojson_polygons", f"""WITH {edge_values()} SELECT poly_id, name, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS area FROM (SELECT CASE poly_id WHEN 1 THEN 0 ELSE 1001 END AS poly_id, CASE poly_id WHEN 1 THEN 'slide' ELSE 'more' END AS name, x1, y1, x2, y2 FROM e) GROUP BY 1, 2""")
def geojson_polygons(spark, d):
    import json

    ring = lambda r: [list(p) for p in r + r[:1]]
    far = [[x + 1000, y] for x, y in fx.TRIANGLE]
    features = [{"type": "Feature", "properties": {"n": "slide"}, "geometry": {"type": "Polygon", "coordinates": [ring(fx.TRIANGLE)]}}, {"type": "Feature", "properties": {"n": "more"}, "geometry": {"type": "MultiPolygon", "coordinates": [[far + far[:1]], [ring(fx.KITE)]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]
    text = spark.createDataFrame([(json.dumps({"type": "FeatureCollection", "features": features}),)], "value string")
    polygons = readers.polygons_of(text, "n", "unstable").filter("poly_id <> 1000")
    return r6(polygons.select("poly_id", "name").join(geometry.measures(geometry.edges(polygons)).select("poly_id", "area"), "poly_id"))


# --- scalars and catalogs ----------------------------------------------------


@query("clean_names", "SELECT s_suppkey, regexp_replace(s_name || ' / (é) #' || s_suppkey, '[^\\p{L}\\p{N}_]+', '_', 'g') AS clean_name FROM supplier")
def clean_names(spark, d):
    s = fx.table(spark, d, "supplier")
    return s.select("s_suppkey", scalars.clean_name(F.concat("s_name", F.lit(" / (é) #"), F.col("s_suppkey").cast("string"))).alias("clean_name"))


_CAT = """c AS (SELECT s_suppkey, s_name || CASE s_suppkey % 3 WHEN 0 THEN ' USGS lidar' WHEN 1 THEN ' noaa-coast' ELSE ' Usgs' END AS name, s_suppkey % 7 AS k,
CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE make_date(2000 + CAST(s_suppkey % 20 AS INTEGER), 1 + CAST(s_suppkey % 12 AS INTEGER), 3) END AS s, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN make_date(2000 + CAST(s_suppkey % 20 AS INTEGER), 1 + CAST(s_suppkey % 12 AS INTEGER), 3) ELSE make_date(2001 + CAST(s_suppkey % 20 AS INTEGER), 6, 30) END AS e FROM supplier)"""


def _catalog(spark, d):
    s = fx.table(spark, d, "supplier")
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, " USGS lidar").when(F.col("s_suppkey") % 3 == 1, " noaa-coast").otherwise(" Usgs"))
    k = F.col("s_suppkey")
    start = F.make_date(2000 + k % 20, 1 + k % 12, F.lit(3)).cast("string")
    end = F.make_date(2001 + k % 20, F.lit(6), F.lit(30)).cast("string")
    cover = F.when(k % 5 == 0, '"unknown"').when(k % 2 == 0, F.concat(F.lit('"'), start, F.lit('"'))).when(k % 3 == 0, F.concat(F.lit('"'), start, F.lit(" / "), end, F.lit('"'))).otherwise(F.concat(F.lit('{"startDate":"'), start, F.lit('","endDate":"'), end, F.lit('"}')))
    text = F.concat(F.lit('{"Datasets":[{"Dataset":{"name":"'), name, F.lit('","identifier":{"propertyID":"id","value":"'), k.cast("string"), F.lit('"},"spatialCoverage":{"additionalProperty":[{"name":"EPSG (Horizontal)","value":"326'), (k % 7).cast("string"), F.lit('"}]},"temporalCoverage":'), cover, F.lit("}}]}"))
    return readers.catalog_of(s.select(text.alias("value")))


@query("catalog_parse", f"""WITH {_CAT} SELECT name, 'id' AS id_type, CASE WHEN s_suppkey % 3 = 0 THEN 'usgs' WHEN s_suppkey % 3 = 1 THEN 'noaa' ELSE 'ot' END AS data_source, CAST(s_suppkey AS VARCHAR) AS property_id, '326' || k AS horizontal_epsg, CAST(NULL AS VARCHAR) AS vertical_coordinates, regexp_replace(name, '[^\\p{{L}}\\p{{N}}_]+', '_', 'g') AS clean_name, s AS start_date, e AS end_date FROM c""")
def catalog_parse(spark, d):
    return _catalog(spark, d)


@query("pick_epochs", f"""WITH {_CAT}, o AS (SELECT *, row_number() OVER (ORDER BY s NULLS LAST, name) - 1 AS pos FROM c)
SELECT CASE pos WHEN 3 THEN 'compare' ELSE 'reference' END AS role, name, s + CAST(floor((e - s) / 2) AS INTEGER) AS epoch FROM o WHERE pos IN (3, 40)""")
def pick_epochs(spark, d):
    return readers.pick(_catalog(spark, d), 3, 40).select("role", "name", "epoch")


@query("gps_date", "SELECT event_id, CASE WHEN s <> 0 THEN DATE '1980-01-06' + CAST(floor((CASE WHEN s < 1e9 THEN s + 1e9 ELSE s END) / 86400) AS INTEGER) END AS acquired FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0e0 ELSE value * 3000000e0 END AS s FROM events)")
def gps_date(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value") * 3000000).alias("s"))
    return e.select("event_id", scalars.gps_date(F.col("s")).alias("acquired"))


@query("decimal_year", "SELECT o_orderkey, printf('+epoch=%.4f', y) AS epoch, round(y, 6) AS y FROM (SELECT o_orderkey, year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 365.25e0 AS y FROM orders)")
def decimal_year(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("t"))
    return r6(o.select("o_orderkey", scalars.epoch_string(F.col("t")).alias("epoch"), scalars.decimal_year(F.col("t")).alias("y")))


@query("utm_zone", "SELECT c_custkey, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS epsg FROM (SELECT c_custkey, CAST(c_custkey * 37 % 360 AS DOUBLE) - 180 AS lon, CAST(c_custkey * 13 % 160 AS DOUBLE) - 80 AS lat FROM customer)")
def utm_zone(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") * 37 % 360).cast("double") - 180).alias("lon"), ((F.col("c_custkey") * 13 % 160).cast("double") - 80).alias("lat"))
    return c.select("c_custkey", scalars.utm_zone(F.col("lon")).alias("zone"), scalars.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query("geoid_lookup", "SELECT n_nationkey, a AS alias, CASE n_nationkey % 6 WHEN 0 THEN 'egm96_15.gtx' WHEN 1 THEN 'egm08_25.gtx' WHEN 2 THEN 'us_nga_geoid18_conus.tif' WHEN 3 THEN 'NAVD 88' WHEN 4 THEN 'egm08_1.gtx' ELSE a END AS grid FROM (SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'EGM_96' WHEN 1 THEN 'egm 2008' WHEN 2 THEN 'Geoid18' WHEN 3 THEN 'NAVD 88' WHEN 4 THEN 'EGM2008_1' ELSE n_name END AS a FROM nation)")
def geoid_lookup(spark, d):
    k = F.col("n_nationkey") % 6
    names = fx.table(spark, d, "nation").select("n_nationkey", F.when(k == 0, "EGM_96").when(k == 1, "egm 2008").when(k == 2, "Geoid18").when(k == 3, "NAVD 88").when(k == 4, "EGM2008_1").otherwise(F.col("n_name")).alias("alias"))
    return readers.geoid_grid(names)


_WKT = 'COMPD_CS["x",PROJCS["u",GEOGCS["w",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","326%02d"]],VERT_CS["v",AUTHORITY["EPSG","5703"]],FRAME_EPOCH[20%02d.5]]'


@query("crs_parts", "SELECT n_nationkey, CAST(32600 + n_nationkey AS INTEGER) AS horizontal, 5703 AS vertical, 2000.5e0 + n_nationkey AS epoch FROM nation")
def crs_parts(spark, d):
    n = fx.table(spark, d, "nation").withColumn("w", F.format_string(_WKT, "n_nationkey", "n_nationkey"))
    w = F.col("w")
    return n.select("n_nationkey", scalars.horizontal_epsg(w).alias("horizontal"), scalars.vertical_epsg(w).alias("vertical"), scalars.frame_epoch(w).alias("epoch"))


@query("acquisition_tags", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS acquired FROM orders")
def acquisition_tags(spark, d):
    k, t = F.col("o_orderkey") % 4, F.col("o_orderdate")
    tags = F.when(k == 0, F.create_map(F.lit("ACQUISITION_DATE"), F.date_format(t, "yyyy-MM-dd"))).when(k == 1, F.create_map(F.lit("TIFFTAG_DATETIME"), F.date_format(t, "yyyy:MM:dd HH:mm:ss"))).when(k == 2, F.create_map(F.lit("ACQUISITION_DATE"), F.lit("?"), F.lit("TIFFTAG_DATETIME"), F.date_format(t, "yyyy-MM-dd"))).otherwise(F.create_map(F.lit("ACQUISITION_DATE"), F.lit("soon")))
    return fx.table(spark, d, "orders").select("o_orderkey", scalars.acquisition_date(tags).alias("acquired"))


# --- variograms --------------------------------------------------------------

_W, _LAG, _RUNS = 4.0, 40.0, 5
_ID = "\"row\" * 100 + col AS id, col AS x, \"row\" AS y, value"
#: A tenth of the cells by hash, as sampling.sample_cells draws them; a run has a seed of its own.
_DRAWN = f"""SELECT run, {_ID} FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ("row" * 7919 + col * 104729 + 42 + run * 31) % 10007, "row", col) AS k FROM d, (SELECT unnest(range({_RUNS})) AS run)) WHERE k <= (SELECT CAST(floor(0.1e0 * count(*)) AS BIGINT) FROM d)"""
_S = D + f", s AS (SELECT * EXCLUDE (run) FROM ({_DRAWN}) WHERE run = 0)"


def _numbered(cells: DataFrame, *more: str) -> DataFrame:
    return cells.select(*more, (F.col("row") * 100 + F.col("col")).alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "value")


def _sample(spark, d, runs: int = 1) -> DataFrame:
    cells = fx.diff(spark, d)
    n = sampling.sample_size(cells.count(), 10, 10, 1e9)
    out = None
    for run in range(runs):
        one = sampling.sample_cells(cells, n, sampling.hash_rank(42 + run * 31)).withColumn("run", F.lit(run))
        out = one if out is None else out.unionByName(one)
    return _numbered(out, "run")


_VARIO = f"""{_S}, k AS (SELECT sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) AS dist, (a.value - b.value) * (a.value - b.value) AS q FROM s a JOIN s b ON a.id < b.id),
v AS (SELECT CAST(floor(dist / 4e0) AS INTEGER) AS bin, count(*) AS n, sum(q) AS ssd FROM k WHERE dist < 44 GROUP BY 1)"""


@query("variogram_single", f"WITH {_VARIO} SELECT bin, n, round(ssd, 4) AS ssd, round(CASE WHEN n >= 10 THEN ssd / (2 * n) END, 6) AS gamma FROM v")
def variogram_single(spark, d):
    out = variogram.variogram(_sample(spark, d).drop("run"), _W, _LAG)
    return out.select("bin", "n", F.round("ssd", 4).alias("ssd"), F.round("gamma", 6).alias("gamma"))


@query("variogram_band", f"WITH {D}, s AS (SELECT \"row\" * 100 + col AS id, col AS x, \"row\" AS y, value FROM d), k AS (SELECT sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) AS dist, (a.value - b.value) * (a.value - b.value) AS q FROM s a JOIN s b ON a.id < b.id AND b.y - a.y <= 6) SELECT CAST(floor(dist / 1e0) AS INTEGER) AS bin, count(*) AS n, round(sum(q) / (2 * count(*)), 6) AS gamma FROM k WHERE dist < 6 GROUP BY 1")
def variogram_band(spark, d):
    """All cells, short lags: the case in which the band join prunes."""
    return r6(variogram.matheron(variogram.bins(variogram.pairs(_numbered(fx.diff(spark, d)), 6.0), 1.0), 1).select("bin", "n", "gamma"))


_MEAN = f"""{D}, t AS ({_DRAWN}),
k AS (SELECT a.run, sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) AS dist, (a.value - b.value) * (a.value - b.value) AS q FROM t a JOIN t b ON a.run = b.run AND a.id < b.id),
v AS (SELECT run, CAST(floor(dist / 4e0) AS INTEGER) AS bin, count(*) AS n, sum(q) AS ssd FROM k WHERE dist < 44 GROUP BY 1, 2),
y AS (SELECT *, CASE WHEN n >= 10 THEN ssd / (2 * n) END AS gamma FROM v),
m AS (SELECT bin, avg(gamma) AS gamma, (quantile_cont(gamma, 0.975) - quantile_cont(gamma, 0.025)) / 2 AS err, stddev_pop(gamma) AS sigma, sum(n) / {_RUNS}e0 AS mean_count FROM y GROUP BY 1),
vario AS (SELECT bin, (row_number() OVER (ORDER BY bin) - 0.5e0) * 4 AS lag, (bin + 0.5e0) * 4 AS lag_center, gamma, err, CASE WHEN sigma = 0 THEN 2.220446049250313e-16 ELSE sigma END AS sigma, mean_count FROM m WHERE gamma IS NOT NULL)"""


def _mean(spark, d):
    return variogram.mean_variogram(variogram.variogram(_sample(spark, d, _RUNS), _W, _LAG, ("run",)), _W, _LAG, _RUNS)


@query("variogram_mean", f"WITH {_MEAN} SELECT bin, {r6_sql('lag', 'lag_center', 'gamma', 'err', 'sigma', 'mean_count')} FROM vario")
def variogram_mean(spark, d):
    return r6(_mean(spark, d))


@query("sample_density", f"WITH {D}, o AS (SELECT *, row_number() OVER (ORDER BY (\"row\" * 7919 + col * 104729 + 42) % 10007, \"row\", col) AS k FROM d) SELECT \"row\", col, round(value, 6) AS value FROM o WHERE k <= (SELECT CAST(floor(0.1e0 * count(*)) AS BIGINT) FROM d)")
def sample_density(spark, d):
    cells = fx.diff(spark, d)
    n = sampling.sample_size(cells.count(), 10, 10, 1e9)
    return r6(sampling.sample_cells(cells, n, sampling.hash_rank(42)))


@query("bootstrap_median", f"""WITH {D}, u AS (SELECT row_number() OVER (ORDER BY value) - 1 AS id, value FROM d), c AS (SELECT count(*) AS n FROM d),
k AS (SELECT rep, (rep * 7919 + 42) % n AS i, (rep * 104729 + 7) % n AS j FROM c, (SELECT unnest(range(1000)) AS rep)),
m AS (SELECT (a.value + b.value) / 2 AS median FROM k JOIN u a ON a.id = k.i JOIN u b ON b.id = k.j) SELECT round(stddev_pop(median), 6) AS error, round(avg(median), 6) AS mean FROM m""")
def bootstrap_median(spark, d):
    """1,000 replicates; their ranks are given, as the beta draws have no SQL twin."""
    cells = fx.diff(spark, d)
    n = cells.count()
    return r6(sampling.bootstrap_median(cells, ranks=[((rep * 7919 + 42) % n, (rep * 104729 + 7) % n) for rep in range(1000)] if n else []))


@query("spherical_eval", f"SELECT h, round({gamma_sql('h')}, 6) AS gamma, round(28e0 - {gamma_sql('h')}, 6) AS cov, round(greatest(-1e0, least(1e0, 1 - {gamma_sql('h')} / 28e0)), 6) AS rho, 3e0 AS nugget FROM (SELECT CAST(i AS DOUBLE) / 2 AS h FROM (SELECT unnest(range(80)) AS i))")
def spherical_eval(spark, d):
    h = spark.range(80).select((F.col("id").cast("double") / 2).alias("h"))
    g = uncertainty.gamma_of(MODEL, F.col("h"))
    return r6(h.select("h", g.alias("gamma"), scalars.covariance(g, 28.0).alias("cov"), scalars.correlation(g, 28.0).alias("rho"), scalars.pure_nugget(3).alias("nugget")))


@query("weights", f"WITH {_MEAN} SELECT bin, round(sigma, 6) AS std, round(1 / (1 + lag), 6) AS linear, round(exp(-lag), 6) AS exp, round(1 / sqrt(1 + lag), 6) AS sqrt, round(1 / (1 + lag * lag), 6) AS sq FROM vario")
def weights(spark, d):
    return r6(_mean(spark, d).select("bin", *[scalars.fit_sigma(s, F.col("lag"), F.col("sigma")).alias(s) for s in scalars.WEIGHTS]))


@query("aic_of_params", f"WITH {_MEAN}, l AS (SELECT -0.5e0 * sum(ln(2 * pi() * sigma * sigma) + (gamma - {gamma_sql('lag')}) * (gamma - {gamma_sql('lag')}) / (sigma * sigma)) AS loglike FROM vario) SELECT round(loglike, 4) AS loglike, round(10 - 2 * loglike, 4) AS aic FROM l")
def aic_of_params(spark, d):
    out = model.log_likelihood(_mean(spark, d), uncertainty.gamma_of(MODEL, F.col("lag")))
    return out.select(F.round("loglike", 4).alias("loglike"), F.round(10 - 2 * F.col("loglike"), 4).alias("aic"))


@query("fitted_curve", f"WITH {_MEAN}, z AS (SELECT lag, gamma, err, {gamma_sql('lag')} AS fit, mean_count FROM vario) SELECT {r6_sql('lag', 'gamma', 'err', 'fit', 'mean_count')}, (SELECT round(sqrt(avg((gamma - fit) * (gamma - fit))), 6) FROM z) AS rmse FROM z")
def fitted_curve(spark, d):
    return r6(variogram.curve(_mean(spark, d), uncertainty.gamma_of(MODEL, F.col("lag"))))


@query("fit_model")
def fit_model(spark, d):
    return model.best(model.search(_mean(spark, d)))


@query("bootstrap_params")
def bootstrap_params(spark, d):
    return model.intervals(model.bootstrap(_mean(spark, d), *MODEL), 5, [*MODEL[0], *MODEL[1], MODEL[2]])


@query("cv_fit")
def cv_fit(spark, d):
    return model.cross_validate(sampling.folds(_mean(spark, d)), 1, True)


# --- uncertainty -------------------------------------------------------------


@query("unc_analytical", f"WITH r AS (SELECT (i + 0.5e0) * sqrt(10000e0 / pi()) / 1000 AS r FROM (SELECT unnest(range(1000)) AS i)) SELECT round(sqrt(greatest(0, 2 * pi() / 10000e0 * sqrt(10000e0 / pi()) / 1000 * sum(r * (28e0 - {gamma_sql('r')})))), 6) AS sigma FROM r")
def unc_analytical(spark, d):
    return r6(uncertainty.analytical(spark, 10000.0, MODEL))


def _area(spark, d):
    """Valid cells in the kite."""
    return zonal.clip(fx.diff(spark, d), fx.polygon_edges(spark).filter("poly_id = 2")).select("row", "col", "value")


_A = IN + ", a AS (SELECT \"row\", col, value, row_number() OVER (ORDER BY \"row\", col) - 1 AS id FROM h WHERE poly_id = 2), c AS (SELECT count(*) AS n FROM a)"
_H = "sqrt(CAST((a.\"row\" - b.\"row\") * (a.\"row\" - b.\"row\") + (a.col - b.col) * (a.col - b.col) AS DOUBLE))"
#: The first hundred cells by hash, as sampling.sample_cells draws them.
_CENTRES = "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY (\"row\" * 7919 + col * 104729 + 42) % 10007, \"row\", col) AS k FROM a) WHERE k <= 100"


@query("unc_brute", f"WITH {_A}, k AS (SELECT sum(CASE WHEN a.id = b.id THEN 28e0 ELSE 28e0 - {gamma_sql('h')} END) AS t FROM (SELECT a.id AS aid, b.id AS bid, {_H} AS h FROM a, a b) x JOIN a ON a.id = aid JOIN a b ON b.id = bid) SELECT round(sqrt(greatest(0, t * 1e0 / ((1e0 * n) * (1e0 * n)))), 6) AS sigma FROM k, c")
def unc_brute(spark, d):
    cells = _area(spark, d)
    return r6(uncertainty.brute_force(cells, MODEL, 1.0, cells.count() * 1.0))


@query("unc_offset_hist", f"WITH {_A}, k AS (SELECT sum(28e0 - {gamma_sql('h')}) AS t FROM (SELECT {_H} AS h FROM a, a b)) SELECT round(sqrt(greatest(0, t * 1e0 / ((1e0 * n) * (1e0 * n)))), 6) AS sigma FROM k, c")
def unc_offset_hist(spark, d):
    cells = _area(spark, d)
    return r6(uncertainty.autocorrelation(cells, MODEL, 1.0, cells.count() * 1.0))


@query("unc_kcentre", f"WITH {_A}, z AS ({_CENTRES}), k AS (SELECT b.id, sum(1 - {gamma_sql('h')} / 28e0) AS i, count(*) AS n FROM (SELECT b.id, {_H} AS h FROM a, z b) b GROUP BY 1) SELECT round(sqrt(greatest(0, 28e0 * avg(i) / max(n))), 6) AS sigma FROM k")
def unc_kcentre(spark, d):
    cells = _area(spark, d)
    centres = sampling.sample_cells(cells, 100, sampling.hash_rank(42)).select(F.col("col").cast("double").alias("cx"), F.col("row").cast("double").alias("cy"))
    return r6(uncertainty.k_centres(cells.select(F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y")), centres, MODEL))


_PAIRS = _A + ", q AS (SELECT i AS pair, (i * 7919 + 13) % n AS i, (i * 104729 + 7) % n AS j FROM c, (SELECT unnest(range(5000)) AS i)), k AS (SELECT " + _H + " AS h FROM q JOIN a ON a.id = q.i JOIN a b ON b.id = q.j)"


def _pairs(spark, d):
    numbered, n = sampling.number(_area(spark, d), ["row", "col"])
    at = lambda k, m: numbered.select(F.col("id").alias(k), F.col("col").cast("double").alias(f"x{m}"), F.col("row").cast("double").alias(f"y{m}"))
    picked = spark.range(5000).select((F.col("id") * 7919 + 13).alias("i"), (F.col("id") * 104729 + 7).alias("j")).select((F.col("i") % max(n, 1)).alias("i"), (F.col("j") % max(n, 1)).alias("j"))
    return picked.join(at("i", 1), "i").join(at("j", 2), "j")


@query("unc_mc", f"WITH {_PAIRS} SELECT round(sqrt(greatest(0, avg(28e0 - {gamma_sql('h')}))), 6) AS sigma FROM k")
def unc_mc(spark, d):
    return r6(uncertainty.monte_carlo(_pairs(spark, d), MODEL))


@query("unc_mc_local", f"WITH {_PAIRS} SELECT round(sqrt(greatest(0, avg(greatest(-1e0, least(1e0, 1 - {gamma_sql('h')} / 28e0)) * 2e0 * 3e0))), 6) AS sigma FROM k")
def unc_mc_local(spark, d):
    return r6(uncertainty.monte_carlo(_pairs(spark, d), MODEL, (F.lit(2.0), F.lit(3.0))))


@query("unc_raster_mc")
def unc_raster_mc(spark, d):
    """Jittered draws over the valid cells: hashed draws have no SQL twin, rows only."""
    numbered, _ = sampling.number(fx.diff(spark, d), ["row", "col"])
    cells = numbered.select("id", "row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    return r6(uncertainty.estimate("raster", cells, MODEL, pairs=20_000))


_LOW = ([15.0, 4.0], [7.0, 20.0], 2.0)
_PARTS = {"central": MODEL, "min": _LOW}


@query("unc_components", f"WITH {_PAIRS} " + " UNION ALL ".join(
    f"SELECT '{name}' AS component, '{stat}' AS stat, round(sqrt(greatest(0, avg({uncertainty.variance(m)}e0 - {gamma_sql('h', part)}))), 6) AS sigma FROM k"
    for stat, m in _PARTS.items() for name, part in {"total": m, "1": uncertainty.component(m, 0), "2": uncertainty.component(m, 1)}.items()))
def unc_components(spark, d):
    return r6(uncertainty.by_component(_pairs(spark, d), _PARTS))


_REPS = [(i, [20.0 + i, 5.0], [8.0, 25.0 + i], 3.0) for i in range(5)]
_REP_SQL = " UNION ALL ".join(f"SELECT {i} AS rep, '{name}' AS component, sqrt(greatest(0, avg({sum(s) + n}e0 - {gamma_sql('h', part)}))) AS sigma FROM k" for i, s, a, n in _REPS for name, part in {"total": (s, a, n), "1": ([s[0]], [a[0]], n), "2": ([s[1]], [a[1]], n)}.items())


@query("unc_bootstrap", f"WITH {_PAIRS}, b AS ({_REP_SQL}) SELECT component, round(quantile_cont(sigma, 0.16), 6) AS low, round(quantile_cont(sigma, 0.5), 6) AS median, round(quantile_cont(sigma, 0.84), 6) AS high FROM b GROUP BY 1")
def unc_bootstrap(spark, d):
    samples = spark.createDataFrame(_REPS, "rep int, sills array<double>, ranges array<double>, nug double")
    return r6(uncertainty.propagate(_pairs(spark, d), samples, 2))


@query("unc_total", f"WITH {_PAIRS}, u AS (SELECT sqrt(avg(value * value)) / sqrt(count(*)) AS uncorrelated FROM d), v AS (SELECT sqrt(greatest(0, avg(28e0 - {gamma_sql('h')}))) AS correlated FROM k) SELECT {r6_sql('uncorrelated', 'correlated')}, round(sqrt(uncorrelated * uncorrelated + correlated * correlated), 6) AS total FROM u, v")
def unc_total(spark, d):
    a = fx.diff(spark, d).agg(zonal.uncorrelated().alias("uncorrelated"))
    b = uncertainty.monte_carlo(_pairs(spark, d), MODEL).withColumnRenamed("sigma", "correlated")
    out = a.join(F.broadcast(b))
    return r6(out.select("uncorrelated", "correlated", uncertainty.total(F.col("uncorrelated"), F.col("correlated")).alias("total")))


_HIGH = ([26.0, 7.0], [9.0, 30.0], 4.0)
_BOUNDS = {"central": MODEL, "min": _LOW, "max": _HIGH}


def _scope_sql(scope: str, cells: str) -> str:
    """Numbered cells, pairs of them by arithmetic, and the rows of a scope."""
    rows = " UNION ALL ".join(
        f"SELECT '{scope}' AS scope, '{name}' AS component, '{stat}' AS stat, sqrt(greatest(0, avg({uncertainty.variance(m)}e0 - {gamma_sql('h', part)}))) AS correlated FROM k_{scope}"
        for stat, m in _BOUNDS.items() for name, part in {"total": m, "1": uncertainty.component(m, 0), "2": uncertainty.component(m, 1)}.items())
    return f"""z_{scope} AS (SELECT "row", col, value, row_number() OVER (ORDER BY "row", col) - 1 AS id FROM {cells}), n_{scope} AS (SELECT count(*) AS n FROM z_{scope}),
q_{scope} AS (SELECT (i * 7919 + 13) % n AS i, (i * 104729 + 7) % n AS j FROM n_{scope}, (SELECT unnest(range(20000)) AS i)),
k_{scope} AS (SELECT sqrt(CAST((a."row" - b."row") * (a."row" - b."row") + (a.col - b.col) * (a.col - b.col) AS DOUBLE)) AS h FROM q_{scope} q JOIN z_{scope} a ON a.id = q.i JOIN z_{scope} b ON b.id = q.j),
s_{scope} AS ({rows}), u_{scope} AS (SELECT sqrt(avg(value * value)) / sqrt(count(*)) AS uncorrelated FROM z_{scope})"""


def _given_pairs(spark, cells: DataFrame) -> DataFrame:
    """20,000 pairs over numbered cells(id, x, y), by arithmetic that SQL repeats."""
    n = max(cells.count(), 1)
    at = lambda k, m: cells.select(F.col("id").alias(k), F.col("x").alias(f"x{m}"), F.col("y").alias(f"y{m}"))
    picked = spark.range(20_000).select(((F.col("id") * 7919 + 13) % n).alias("i"), ((F.col("id") * 104729 + 7) % n).alias("j"))
    return picked.join(at("i", 1), "i").join(at("j", 2), "j")


@query("unc_regional", f"WITH {IN}, {_scope_sql('polygon', '(SELECT * FROM h WHERE poly_id = 2)')}, {_scope_sql('raster', 'd')}, l AS (SELECT * FROM s_polygon JOIN u_polygon ON TRUE UNION ALL SELECT * FROM s_raster JOIN u_raster ON TRUE) "
       f"SELECT scope, component, stat, {r6_sql('correlated', 'uncorrelated')}, CASE WHEN component = 'total' THEN round(sqrt(uncorrelated * uncorrelated + correlated * correlated), 6) END AS total FROM l")
def unc_regional(spark, d):
    """Polygon and raster, all cells of each: total and components by the central model and its bounds."""
    one = regional.Regional.of(fx.diff(spark, d), fx.polygons(spark).filter("poly_id = 2"), MODEL, _LOW, _HIGH)
    polygon, raster_ = (_given_pairs(spark, one.numbered(cells)) for cells in (one.inside(), one.cells))
    return r6(one.uncertainty(polygon, raster_))


@query("unc_polygon")
def unc_polygon(spark, d):
    """Drawn pairs and 500 bootstrapped parameter sets: the correlated part of the polygon and the totals; hashed draws, rows only."""
    refits = model.bootstrap(_mean(spark, d), *MODEL)
    samples = refits.select("rep", F.slice("params", 1, 2).alias("sills"), F.slice("params", 3, 2).alias("ranges"), F.element_at("params", 5).alias("nug"))
    one = regional.Regional.of(fx.diff(spark, d), fx.polygons(spark).filter("poly_id = 2"), MODEL, _LOW, _HIGH, samples=samples)
    return r6(one.uncertainty(n=2000))


@query("unc_kcentre_map", f"WITH {IN}, aa AS (SELECT col AS x, \"row\" AS y, \"row\" * 1000000 + col AS id, row_number() OVER (ORDER BY (\"row\" * 7919 + col * 104729 + 42) % 10007, \"row\", col) AS k FROM h WHERE poly_id = 2), mm AS (SELECT \"row\" // 4 AS \"row\", col // 4 AS col, avg(value * value) AS value FROM d GROUP BY 1, 2), "
       "gg AS (SELECT max(\"row\") AS r1, min(\"row\") AS r0, max(col) AS c1, min(col) AS c0 FROM mm), pp AS (SELECT aa.*, greatest(least(ceil(aa.y / 4e0 - 1), r1), r0) AS r, greatest(least(ceil(aa.x / 4e0 - 1), c1), c0) AS c FROM aa, gg), "
       "vv AS (SELECT avg(mm.value) AS variance FROM pp LEFT JOIN mm ON mm.\"row\" = pp.r AND mm.col = pp.c), "
       f"kk AS (SELECT b.id, sum(1 - {gamma_sql('h')} / 28e0) AS i, count(*) AS n FROM (SELECT z.id, sqrt(CAST((a.x - z.x) * (a.x - z.x) + (a.y - z.y) * (a.y - z.y) AS DOUBLE)) AS h FROM aa a, aa z WHERE z.k <= 100) b GROUP BY 1) "
       "SELECT round(sqrt(greatest(0, avg(i) / max(n))) * sqrt(any_value(variance)), 6) AS sigma FROM kk, vv")
def unc_kcentre_map(spark, d):
    """All cells of the polygon, a hundred of them centres, and a variance map of 4 by 4 cells."""
    diff = fx.diff(spark, d)
    one = regional.Regional.of(diff, fx.polygons(spark).filter("poly_id = 2"), MODEL)
    cells = one.numbered(one.inside())
    variances = diff.groupBy(F.floor(F.col("row") / 4).alias("row"), F.floor(F.col("col") / 4).alias("col")).agg(F.avg(F.col("value") * F.col("value")).alias("value"))
    centres = sampling.sample_cells(cells, 100, sampling.hash_rank(42)).select(F.col("x").alias("cx"), F.col("y").alias("cy"))
    return r6(regional.local_k_centres(cells, centres, MODEL, variances, (4.0, 0.0, 4.0, 0.0)))


@query("variogram_single_whole", ORACLES["variogram_single"].replace(_S, f"{D}, s AS (SELECT {_ID} FROM d)").replace("round(ssd, 4)", "round(ssd, 1)"))
def variogram_single_whole(spark, d):
    out = variogram.variogram(_numbered(fx.diff(spark, d)), _W, _LAG)
    return out.select("bin", "n", F.round("ssd", 1).alias("ssd"), F.round("gamma", 6).alias("gamma"))


@query("unc_closed_form", "WITH n AS (SELECT p_partkey, p_size * 1000e0 / 4e0 AS n FROM part), t AS (SELECT p_partkey, 0.3e0 / sqrt(n) AS uncorrelated, sqrt(40e0 / n * (pi() * 64e0 / 20e0) + 10e0 / n * (pi() * 625e0 / 20e0)) AS correlated FROM n) SELECT p_partkey, round(uncorrelated, 6) AS uncorrelated, round(correlated, 6) AS correlated, round(sqrt(uncorrelated * uncorrelated + correlated * correlated), 6) AS total FROM t")
def unc_closed_form(spark, d):
    p = fx.table(spark, d, "part")
    return r6(p.select("p_partkey", *[c.alias(n) for n, c in uncertainty.closed_form(F.col("p_size") * 1000.0, 2.0, 0.3, MODEL).items()]))


@query("unc_report", "SELECT * FROM (VALUES ('slide', 'slide, polygon total central: 0.1235'), ('slide', 'slide, raster 1 min: 2.0000')) t(feature, line)")
def unc_report(spark, d):
    rows = [("slide", "polygon", "total", "central", 0.12345), ("slide", "raster", "1", "min", 2.0), ("slide", "raster", "2", "min", None)]
    return uncertainty.report(spark.createDataFrame(rows, "feature string, scope string, component string, stat string, value double"))


@query("derived_stable")
def derived_stable(spark, d):
    """Polygons of the valid cells outside the triangle: an outline a patch, tested by brute force."""
    found = vectorise.derive_stable(fx.diff(spark, d), fx.polygon_edges(spark).filter("poly_id = 1"), min_area=2.0)
    sizes = geometry.measures(geometry.edges(found)).select("poly_id", "area")
    return r6(found.join(sizes, "poly_id").select("poly_id", "name", "category", "area", F.size("rings").alias("rings")))


@query("workflow_dsm", f"WITH {P}, g AS (SELECT survey, CAST(y AS BIGINT) AS \"row\", CAST(x AS BIGINT) AS col, max(z) AS value FROM p GROUP BY 1, 2, 3) SELECT \"row\", col, round(b.value - a.value, 6) AS value FROM (SELECT * FROM g WHERE survey = 'compare') a JOIN (SELECT * FROM g WHERE survey = 'reference') b USING (\"row\", col)")
def workflow_dsm(spark, d):
    """Two surveys' surface models and their difference, without filling."""
    orders = [workflow.Order(role, "usgs", fx.points(spark, d).filter(F.col("survey") == role)) for role in ("compare", "reference")]
    return r6(workflow.run(spark, *orders, kinds=("dsm",), gaps=None)["diff_dsm"])


# --- streams -----------------------------------------------------------------


def _stream(spark, d):
    """Events as a stream of points."""
    path = f"{d.rstrip('/')}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).format("parquet").load(f"{path.rsplit('/', 1)[0]}/events.parquet*")
    return source.select(F.col("ts").cast("timestamp").alias("t"), (F.col("user_id") % 10).cast("double").alias("x"), (F.col("event_id") % 10).cast("double").alias("y"), F.col("value").alias("z"))


@query("stream_grid", "SELECT event_id % 10 AS \"row\", user_id % 10 AS col, round(max(value), 6) AS max_z, round(avg(value), 6) AS mean_z, count(*) AS n FROM events GROUP BY 1, 2")
def stream_grid(spark, d):
    import uuid

    from terrane.streaming import gridding

    name = f"grid_{uuid.uuid4().hex}"
    base = shared_folder(spark)
    return r6(gridding.run_available(gridding.grid_stream(_stream(spark, d)), name, "complete", f"{base}/{name}"))


@query("stream_bias")
def stream_bias(spark, d):
    """Daily windows that the watermark has closed; the last ones stay open, hence rows only."""
    import uuid

    from terrane.streaming import gridding

    name = f"bias_{uuid.uuid4().hex}"
    base = shared_folder(spark)
    return r6(gridding.run_available(gridding.bias_windows(_stream(spark, d)), name, "append", f"{base}/{name}"))


# --- the whole workflow ------------------------------------------------------


@query("survey_workflow")
def survey_workflow(spark, d):
    """Difference to uncertainty in one chain; the fit has no SQL twin."""
    from terrane.plans.survey import Survey

    done = Survey.between(fx.survey(spark, d, "compare"), fx.survey(spark, d, "reference")).stable(fx.polygon_edges(spark).filter("poly_id = 1")).unbiased()
    done = done.variogram(4.0, 0.1, 3, (99.0, 99.0)).fit()
    return r6(done.uncertainty("analytical"))


def flagship(spark, d) -> DataFrame:
    """Points to gridded surveys to their difference's statistics by polygon."""
    return zonal_each(spark, d)
