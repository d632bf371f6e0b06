"""Mean uncertainty of an area from a variogram model.

A model is (sills, ranges, nugget); its variance is their sum.  Covariance depends on the offset of two cells only, so
pairs of cells are counted by offset, from runs of cells or by a Fourier transform, and never listed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions.scalars import correlation, covariance, guarded_sqrt, spherical
from terrane.operators.sampling import draw

Model = tuple[list, list, float]


def variance(model: Model) -> float:
    return float(sum(model[0]) + model[2])


def gamma_of(model: Model, h: Column) -> Column:
    return spherical(h, model[0], model[1], model[2])


def component(model: Model, i: int) -> Model:
    """A single sill and range, the nugget kept."""
    return [model[0][i]], [model[1][i]], model[2]


def analytical(spark: SparkSession, area: float, model: Model, steps: int = 1000) -> DataFrame:
    """Integral over the disk of equal area, by midpoints of radii."""
    if area <= 0:
        raise ValueError("the area must be positive")
    dr = math.sqrt(area / math.pi) / steps
    r = (F.col("id") + 0.5) * F.lit(dr)
    inner = F.sum(r * covariance(gamma_of(model, r), variance(model)))
    return spark.range(steps).agg(guarded_sqrt(F.lit(2 * math.pi / area * dr) * inner).alias("sigma"))


#: Blocks of rows whose pairs are joined.
ROW_BLOCKS = 32
#: Values of a column block's matrix that a task holds.
BLOCK_VALUES = 1 << 22


def offsets(cells: DataFrame, reach: int | None = None) -> DataFrame:
    """di, dj and n: how many ordered pairs of ``cells(row, col)`` lie at each offset.

    A row is a list of runs of neighbouring cells.  The pairs of two runs by offset form a trapezoid, whose four bends are all
    that is counted; adding up twice over dj gives the pairs.  Rows meet by an equi-join on pairs of row blocks,
    each row in ROW_BLOCKS of them.
    """
    place = cells.select("row", "col").distinct().withColumn("run", F.col("col") - F.row_number().over(Window.partitionBy("row").orderBy("col")))
    runs = place.groupBy("row", "run").agg(F.min("col").alias("a"), (F.max("col") + 1).alias("e")).drop("run")
    block = F.pmod(F.col("row"), F.lit(ROW_BLOCKS)) if reach is None else F.floor(F.col("row") / max(reach, 1))
    steps = F.sequence(F.lit(0), F.lit(ROW_BLOCKS - 1)) if reach is None else F.array(block, block + 1)
    left = runs.select(F.col("row").alias("r1"), F.col("a").alias("a1"), F.col("e").alias("e1"), block.alias("i"), F.explode(steps).alias("j"))
    right = runs.select(F.col("row").alias("r2"), F.col("a").alias("a2"), F.col("e").alias("e2"), block.alias("j"))
    if reach is None:
        right = right.withColumn("i", F.explode(steps))
        met = left.join(right, ["i", "j"])
    else:
        met = left.join(right, "j")
    met = met.filter("r2 >= r1" if reach is None else f"r2 >= r1 and r2 - r1 <= {int(reach)}")
    bends = F.array(*[F.struct(x.alias("dj"), F.lit(sign).alias("n")) for x, sign in ((F.col("a2") - F.col("e1") + 1, 1), (F.col("a2") - F.col("a1") + 1, -1), (F.col("e2") - F.col("e1") + 1, -1), (F.col("e2") - F.col("a1") + 1, 1))])
    bent = met.select((F.col("r2") - F.col("r1")).alias("di"), F.explode(bends).alias("b")).groupBy("di", "b.dj").agg(F.sum("b.n").alias("n"))
    ends = bent.groupBy("di").agg(F.min("dj").alias("low"), F.max("dj").alias("high"))
    spine = ends.select("di", F.explode(F.sequence("low", "high")).alias("dj")).join(bent, ["di", "dj"], "left").fillna(0, ["n"])
    along = Window.partitionBy("di").orderBy("dj").rowsBetween(Window.unboundedPreceding, 0)  # a row of offsets
    half = spine.withColumn("n", F.sum("n").over(along)).withColumn("n", F.sum("n").over(along)).filter("n > 0")
    return half.select("di", "dj", F.when(F.col("di") > 0, 2 * F.col("n")).otherwise(F.col("n")).cast("long").alias("n"))


def convolved_offsets(cells: DataFrame) -> DataFrame:
    """The same by a two-dimensional Fourier transform of the footprint: rows, then columns, the power, and back.

    Three passes over blocks of the zero-padded grid; the numbers of rows and columns come to the driver, and a task holds
    a row, or some columns of BLOCK_VALUES values in all.
    """
    size = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if size[0] is None:
        return cells.sparkSession.createDataFrame([], "di long, dj long, n long")
    r0, c0, height, width = int(size[0]), int(size[2]), int(size[1] - size[0]) + 1, int(size[3] - size[2]) + 1
    tall, wide = (1 << (2 * n - 1).bit_length() for n in (height, width))
    step = max(1, min(wide, BLOCK_VALUES // tall))

    def pieces(rows, values):
        """Rows of complex values, cut into blocks of columns."""
        out = [(b // step, int(r), v[b : b + step]) for r, v in zip(rows, values) for b in range(0, values.shape[1], step)]
        return pd.DataFrame({"block": [o[0] for o in out], "line": [o[1] for o in out], "re": [o[2].real.tolist() for o in out], "im": [o[2].imag.tolist() for o in out]})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros((1, wide))
        line[0, (pdf["col"] - c0).to_numpy()] = 1
        return pieces([pdf["row"].iloc[0] - r0], np.fft.rfft(line, axis=1))

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((tall, len(pdf["re"].iloc[0])), complex)
        values[pdf["line"].to_numpy()] = np.array(pdf["re"].tolist()) + 1j * np.array(pdf["im"].tolist())
        power = np.abs(np.fft.fft(values, axis=0)) ** 2
        back = np.fft.ifft(power, axis=0)[:height]
        return pd.DataFrame({"block": pdf["block"].iloc[0], "line": range(height), "re": back.real.tolist(), "im": back.imag.tolist()})

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        line = np.concatenate([np.array(a) + 1j * np.array(b) for a, b in zip(pdf["re"], pdf["im"])])
        n = np.rint(np.fft.irfft(line, wide)).astype("int64")
        dj = np.arange(wide)
        dj = np.where(dj < width, dj, dj - wide)
        di, held = int(pdf["line"].iloc[0]), n > 0
        return pd.DataFrame({"di": di, "dj": dj[held], "n": n[held] * (2 if di else 1)})

    schema = "block long, line long, re array<double>, im array<double>"
    spectrum = cells.select(F.col("row").cast("long"), F.col("col").cast("long")).distinct().groupBy("row").applyInPandas(across, schema)
    return spectrum.groupBy("block").applyInPandas(down, schema).groupBy("line").applyInPandas(back, "di long, dj long, n long")


def from_offsets(counted: DataFrame, model: Model, cell: float, area: float, diagonal: str = "limit") -> DataFrame:
    """Sum of covariances over offsets; the zero offset takes the variance without the nugget ('limit') or with it ('full')."""
    h = F.lit(float(cell)) * F.sqrt((F.col("di") * F.col("di") + F.col("dj") * F.col("dj")).cast("double"))
    cov = covariance(gamma_of(model, h), variance(model))
    if diagonal == "full":
        cov = F.when((F.col("di") == 0) & (F.col("dj") == 0), F.lit(variance(model))).otherwise(cov)
    return counted.agg(guarded_sqrt(F.sum(F.col("n") * cov) * F.lit(float(cell) ** 4 / float(area) ** 2)).alias("sigma"))


def brute_force(cells: DataFrame, model: Model, cell: float, area: float) -> DataFrame:
    """All pairs of cells, the diagonal with the full variance: the reference for the other estimators."""
    return from_offsets(offsets(cells), model, cell, area, "full")


def autocorrelation(cells: DataFrame, model: Model, cell: float, area: float) -> DataFrame:
    """The same through the footprint's autocorrelation by convolution, whose zero offset leaves the nugget out."""
    return from_offsets(convolved_offsets(cells), model, cell, area, "limit")


def monte_carlo(pairs: DataFrame, model: Model, sigma: tuple[Column, Column] | None = None) -> DataFrame:
    """Mean covariance of ``pairs(x1, y1, x2, y2)`` drawn in the area; with local deviations, mean of correlation times both."""
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    g = gamma_of(model, F.sqrt(dx * dx + dy * dy))
    value = covariance(g, variance(model)) if sigma is None else correlation(g, variance(model)) * sigma[0] * sigma[1]
    return pairs.agg(guarded_sqrt(F.avg(value)).alias("sigma"))


def draw_pairs(cells: DataFrame, n: int, cell: float = 1.0, seed: int = 42, jitter: bool = True) -> DataFrame:
    """n pairs of points over numbered ``cells(id, x, y)``: two cells by hash, jittered within them."""
    if n <= 0:
        raise ValueError("pairs must be more than none")
    total = cells.count()
    pick = lambda k: F.floor(draw(seed, F.lit(k), "pair") * F.lit(total)).cast("long")
    shift = lambda k: (draw(seed, F.lit(k), "pair") - 0.5) * cell if jitter else F.lit(0.0)
    picked = cells.sparkSession.range(n).withColumnRenamed("id", "pair").withColumns({"i": pick("i"), "j": pick("j")})
    a, b = (cells.select(F.col("id").alias(k), F.col("x").alias(f"x{m}"), F.col("y").alias(f"y{m}")) for k, m in (("i", 1), ("j", 2)))
    out = picked.join(a, "i").join(b, "j")
    return out.select("pair", (F.col("x1") + shift("a")).alias("x1"), (F.col("y1") + shift("b")).alias("y1"), (F.col("x2") + shift("c")).alias("x2"), (F.col("y2") + shift("d")).alias("y2"))


def box_pairs(spark: SparkSession, box: tuple, n: int, seed: int = 42) -> DataFrame:
    """n pairs of uniform points in bounds (minx, miny, maxx, maxy)."""
    if n <= 0:
        raise ValueError("pairs must be more than none")
    minx, miny, maxx, maxy = box
    at = lambda k, lo, hi: F.lit(float(lo)) + draw(seed, F.lit(k), "id") * float(hi - lo)
    return spark.range(n).select(F.col("id").alias("pair"), at("x1", minx, maxx).alias("x1"), at("y1", miny, maxy).alias("y1"), at("x2", minx, maxx).alias("x2"), at("y2", miny, maxy).alias("y2"))


def k_centres(cells: DataFrame, centres: DataFrame, model: Model, cell_variance: float | None = None) -> DataFrame:
    """Mean over centres of the summed correlation to all cells, times the mean variance, over the number of cells.

    ``centres(cx, cy)`` are a hundred or so: the one side whose size is fixed.
    """
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    rho = correlation(gamma_of(model, F.sqrt(dx * dx + dy * dy)), variance(model), clipped=False)
    summed = cells.join(F.broadcast(centres)).groupBy("cx", "cy").agg(F.sum(rho).alias("i"), F.count("*").alias("n"))
    return summed.agg(guarded_sqrt(F.lit(float(variance(model) if cell_variance is None else cell_variance)) * F.avg("i") / F.max("n")).alias("sigma"))


def by_component(pairs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """component, stat and sigma over the same pairs, in one grouped pass.

    models: central, min and max.  Components keep the model's total variance.
    """
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    d = F.sqrt(dx * dx + dy * dy)
    entries = []
    for stat, model in models.items():
        parts = {"total": model} | {str(i + 1): component(model, i) for i in range(len(model[0]))}
        entries += [F.struct(F.lit(name).alias("component"), F.lit(stat).alias("stat"), covariance(gamma_of(part, F.col("d")), variance(model)).alias("c")) for name, part in parts.items()]
    rows = pairs.select(d.alias("d")).select(F.explode(F.array(*entries)).alias("e"))
    return rows.groupBy("e.component", "e.stat").agg(guarded_sqrt(F.avg("e.c")).alias("sigma"))


def propagate(pairs: DataFrame, samples: DataFrame, components: int) -> DataFrame:
    """component and 16, 50, 84 percentiles of sigma over parameter samples(rep, sills, ranges, nug).

    Every replicate meets the one set of pairs; replicates are a few hundred and are the broadcast side.
    """
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    d = pairs.select(F.sqrt(dx * dx + dy * dy).alias("d"))
    sill, range_ = (lambda i: F.element_at("sills", i + 1)), (lambda i: F.element_at("ranges", i + 1))
    total = F.aggregate("sills", F.lit(0.0), lambda a, b: a + b) + F.col("nug")
    full = [F.struct(F.lit("total").alias("component"), covariance(spherical(F.col("d"), [sill(i) for i in range(components)], [range_(i) for i in range(components)], F.col("nug")), total).alias("c"))]
    parts = [F.struct(F.lit(str(i + 1)).alias("component"), covariance(spherical(F.col("d"), [sill(i)], [range_(i)], F.col("nug")), total).alias("c")) for i in range(components)]
    rows = d.join(F.broadcast(samples)).select("rep", F.explode(F.array(*full, *parts)).alias("e"))
    sigma = rows.groupBy("rep", "e.component").agg(guarded_sqrt(F.avg("e.c")).alias("sigma"))
    p = F.percentile("sigma", F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84)))
    return sigma.groupBy("component").agg(p[0].alias("low"), p[1].alias("median"), p[2].alias("high"))


def total(uncorrelated: Column, correlated: Column) -> Column:
    """In quadrature; null if either is."""
    return F.sqrt(uncorrelated * uncorrelated + correlated * correlated)


def closed_form(area: Column, resolution: float, rms: float, model: Model) -> dict[str, Column]:
    """Uncorrelated, correlated and total uncertainty of an area as columns."""
    n = area / F.lit(float(resolution) ** 2)
    uncorrelated = F.lit(float(rms)) / F.sqrt(n)
    parts = [F.lit(math.sqrt(2 * c)) / F.sqrt(n) * F.lit(math.sqrt(math.pi * a * a / (5 * resolution * resolution))) for c, a in zip(model[0], model[1])]
    squares = [p * p for p in parts]
    correlated = F.sqrt(sum(squares[1:], squares[0]))
    return {"uncorrelated": uncorrelated, "correlated": correlated, "total": total(uncorrelated, correlated)}


METHODS = {"analytical": "analytical", "analytic": "analytical", "brute_force": "brute_force", "numerical": "brute_force", "monte_carlo": "monte_carlo", "montecarlo": "monte_carlo", "fft": "autocorrelation", "convolution": "autocorrelation", "hug": "k_centres", "hugonnet": "k_centres", "raster": "raster"}


def estimate(method: str, cells: DataFrame, model: Model, cell: float = 1.0, pairs: int = 100_000, centres: int = 100, seed: int = 42, detailed: bool = True) -> DataFrame:
    """sigma of the area that ``cells(id, row, col, x, y)`` cover, by method; a raster that is not ``detailed`` is its bounds."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    kind = METHODS[method]
    area = cells.count() * cell * cell
    if kind == "analytical":
        return analytical(cells.sparkSession, area, model)
    if kind in ("brute_force", "autocorrelation"):
        return globals()[kind](cells, model, cell, area)
    if kind == "raster" and not detailed:
        box = cells.agg(F.min("x") - cell / 2, F.min("y") - cell / 2, F.max("x") + cell / 2, F.max("y") + cell / 2).first()
        return monte_carlo(box_pairs(cells.sparkSession, tuple(box), pairs, seed), model)
    if kind in ("monte_carlo", "raster"):
        return monte_carlo(draw_pairs(cells, pairs, cell, seed), model)
    chosen = cells.orderBy(draw(seed, "row", "col"), "row", "col").limit(centres).select(F.col("x").alias("cx"), F.col("y").alias("cy"))
    return k_centres(cells, chosen, model)


def report(results: DataFrame) -> DataFrame:
    """Long rows (feature, scope, component, stat, value) of what is known, as lines of text."""
    known = results.filter("value is not null")
    return known.select("feature", F.format_string("%s, %s %s: %.4f", "feature", "scope", F.concat_ws(" ", "component", "stat"), "value").alias("line"))
