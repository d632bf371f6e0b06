"""Empirical variograms: a distance-banded self-join and a group-by.

Pairs come from tiles as wide as the largest distance: each cell meets the cells of its own and the
neighbouring tiles by an equi-join, so a plan never holds a cross product.  Each unordered pair of
tiles is met once.  If the largest distance spans most of the extent, tiles no longer prune and the sample,
not the join, has to bound the work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.scalars import EPSILON, lag_bin

MIN_PAIRS = 10


def max_lag(x_extent: float, y_extent: float, multiplier: float | str = 1 / 3) -> float:
    """Largest distance: the extent's diagonal times 'max', 'median' (a half) or a number."""
    share = {"max": 1.0, "median": 0.5}.get(multiplier, multiplier)
    return math.hypot(x_extent, y_extent) * float(share)


def n_bins(lag: float, width: float, most: int | None = None) -> int:
    n = math.ceil(lag / width) + 1
    if most is not None and n > most:
        raise ValueError(f"{n} bins are more than {most}")
    return n


def pairs(sample: DataFrame, reach: float, by: tuple = ()) -> DataFrame:
    """d and q (squared difference of values) of all pairs of ``sample(id, x, y, value)`` nearer than ``reach``, within groups."""
    tile = lambda c: F.floor(F.col(c) / reach).cast("long")
    # the tile itself and half of its neighbours, so that two tiles meet once
    half = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in half])
    a = sample.select(*by, "id", "x", "y", "value", tile("x").alias("tx"), tile("y").alias("ty"), F.explode(steps).alias("o"))
    a = a.select(*by, F.col("id").alias("id1"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("value").alias("v1"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"), (F.col("tx") + F.col("o.i")).alias("tx"), (F.col("ty") + F.col("o.j")).alias("ty"))
    b = sample.select(*by, F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("value").alias("v2"), tile("x").alias("tx"), tile("y").alias("ty"))
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    met = a.join(b, [*by, "tx", "ty"]).filter(~F.col("own") | (F.col("id1") < F.col("id2"))).withColumn("d", F.sqrt(dx * dx + dy * dy)).filter(F.col("d") < reach)
    return met.select(*by, "d", ((F.col("v1") - F.col("v2")) * (F.col("v1") - F.col("v2"))).alias("q"))


def bins(pair_rows: DataFrame, width: float, by: tuple = (), limit: int | None = None) -> DataFrame:
    """bin, n and ssd; pairs beyond the last bin are dropped."""
    keyed = pair_rows.withColumn("bin", lag_bin(F.col("d"), width))
    if limit is not None:
        keyed = keyed.filter(F.col("bin") < limit)
    return keyed.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum("q").alias("ssd"))


def matheron(binned: DataFrame, min_pairs: int = MIN_PAIRS) -> DataFrame:
    return binned.withColumn("gamma", F.when(F.col("n") >= min_pairs, F.col("ssd") / (2 * F.col("n"))))


def variogram(sample: DataFrame, width: float, lag: float, by: tuple = (), min_pairs: int = MIN_PAIRS, most: int | None = None) -> DataFrame:
    """One realisation by group: bin, n, ssd and gamma."""
    limit = n_bins(lag, width, most)
    return matheron(bins(pairs(sample, limit * width, by), width, by, limit), min_pairs)


def mean_variogram(by_run: DataFrame, width: float, lag: float, runs: int) -> DataFrame:
    """Mean over runs: lag (bins without gamma left out and the rest counted on), true bin centre, gamma, half the
    95 % spread, standard deviation and mean number of pairs, where bins that a run lacks count zero."""
    limit = n_bins(lag, width)
    spread = F.percentile("gamma", F.array(F.lit(0.025), F.lit(0.975)))
    sigma = F.stddev_pop("gamma")
    out = by_run.filter(F.col("bin") < limit).groupBy("bin").agg(F.avg("gamma").alias("gamma"), ((spread[1] - spread[0]) / 2).alias("err"), F.when(sigma == 0, EPSILON).otherwise(sigma).alias("sigma"), (F.sum("n") / runs).alias("mean_count"))
    place = F.row_number().over(Window.orderBy("bin")) - 0.5  # one row a bin
    return out.filter("gamma is not null").select("bin", (place * width).alias("lag"), ((F.col("bin") + 0.5) * width).alias("lag_center"), "gamma", "err", "sigma", "mean_count")


def curve(vario: DataFrame, fitted: Column) -> DataFrame:
    """The variogram beside a model, and their root mean squared difference."""
    shown = vario.select("lag", "gamma", "err", fitted.alias("fit"), "mean_count")
    gap = F.col("gamma") - F.col("fit")
    return shown.join(F.broadcast(shown.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))))
