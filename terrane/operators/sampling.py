"""Samples and bootstraps that are a function of a seed: draws are hashes, so reruns and partitions agree."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators.geometry import within
from terrane.operators.ranks import at_ranks


def draw(seed: int, *keys) -> Column:
    """A uniform number in [0, 1) from a seed and keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") / F.lit(float(1 << 53))


def normal(seed: int, *keys) -> Column:
    """A standard normal number, by Box and Muller."""
    u, v = draw(seed, F.lit(1), *keys), draw(seed, F.lit(2), *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def sample_size(valid: int, side: float, per_area: float, most: float, cell_area: float = 1.0) -> int:
    """Cells to sample by density; below one, or more than there are, is an error."""
    n = min(int(cell_area / side**2 * per_area * valid), int(most))
    if n < 1 or n > valid:
        raise ValueError(f"cannot sample {n} of {valid} valid cells")
    return n


def sample_cells(cells: DataFrame, n: int, rank: Column) -> DataFrame:
    """The n valid cells of lowest rank, ties by row and column: a bounded top-n, without a full sort."""
    return cells.filter("value is not null").withColumn("rank", rank).orderBy("rank", "row", "col").limit(n).drop("rank")


def hash_rank(seed: int) -> Column:
    """Integer arithmetic that any engine repeats."""
    return F.pmod(F.col("row") * 7919 + F.col("col") * 104729 + F.lit(seed), F.lit(10007))


def density_sample(cells: DataFrame, side: float, per_area: float, most: float = 1e9, cell_area: float = 1.0, seed: int = 42) -> DataFrame:
    n = sample_size(cells.filter("value is not null").count(), side, per_area, most, cell_area)
    return sample_cells(cells, n, draw(seed, "row", "col"))


def run_samples(cells: DataFrame, share: float, runs: int, seed: int = 42) -> DataFrame:
    """run, row, col and value of independent samples: a cell is in a run's sample if its draw is below the share."""
    spread = cells.filter("value is not null").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return spread.filter(draw(seed, "run", "row", "col") < share)


def median_ranks(n: int, replicates: int, share: float, seed: int = 42) -> list[tuple[int, int]]:
    """Of each replicate, a sample of share * n of n ranks drawn with replacement, the ranks of its two middle values.

    The middle of m uniform draws has a beta distribution, and the next one follows from it, so no sample has to be drawn.
    """
    size, rng = max(1, round(share * n)), np.random.default_rng(seed)
    k = (size + 1) // 2
    first = rng.beta(k, size - k + 1, replicates)
    second = first if size % 2 else 1 - (1 - first) * rng.random(replicates) ** (1 / (size - k))
    rank = lambda u: np.minimum((u * n).astype(int), n - 1).tolist()
    return list(zip(rank(first), rank(second)))


def bootstrap_median(cells: DataFrame, replicates: int = 1000, share: float = 0.1, ranks: list[tuple[int, int]] | None = None, seed: int = 42) -> DataFrame:
    """Standard deviation (population) and mean of the medians of replicates drawn with replacement.

    A median is the mean of the values at two ranks, by ``median_ranks`` or as given; the ranks lie close to the middle, so only
    values around the median are put in order, whatever the number of cells.
    """
    n = cells.filter("value is not null").count()
    pairs = ranks if ranks is not None else (median_ranks(n, replicates, share, seed) if n else [])
    values = at_ranks(cells, [r for pair in pairs for r in pair])
    asked = cells.sparkSession.createDataFrame([(rep, int(r)) for rep, pair in enumerate(pairs) for r in pair], "rep long, rank long")
    medians = asked.join(F.broadcast(values), "rank").groupBy("rep").agg(F.avg("value").alias("median"))  # a row a replicate
    return medians.agg(F.stddev_pop("median").alias("error"), F.avg("median").alias("mean"))


def number(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Rows with a dense id from 0 in order, and how many there are, without one task for all rows.

    Rows are cut into blocks by value ranges of the first column; blocks are counted, and rows are
    numbered within their block.
    """
    from pyspark.sql import Window

    blocks = rows.groupBy(order[0]).agg(F.count("*").alias("in_block"))
    before = Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)  # one row a distinct value
    offsets = blocks.withColumn("offset", F.coalesce(F.sum("in_block").over(before), F.lit(0)))
    total = blocks.agg(F.sum("in_block")).first()[0] or 0
    inside = F.row_number().over(Window.partitionBy(order[0]).orderBy(*order)) - 1
    return rows.join(offsets.select(order[0], "offset"), order[0]).withColumn("id", F.col("offset") + inside).drop("offset"), total


def points_in_polygons(spark, polygon_edges: DataFrame, box: tuple[float, float, float, float], n: int, area_share: float, seed: int = 42) -> DataFrame:
    """About n uniform points in polygons: draws in the joint bounds (minx, miny, maxx, maxy), those outside rejected.

    area_share: of the polygons in the bounds; some more are drawn than needed on average.
    """
    minx, miny, maxx, maxy = box
    tries = int(n / max(area_share, 1e-9) * 1.2) + 50
    drawn = spark.range(tries).select("id", (F.lit(minx) + draw(seed, F.lit("x"), "id") * (maxx - minx)).alias("x"), (F.lit(miny) + draw(seed, F.lit("y"), "id") * (maxy - miny)).alias("y"))
    held = within(drawn, polygon_edges, ["id"]).select("id", "x", "y").distinct()
    return held.orderBy("id").limit(n)


def folds(bins: DataFrame, k: int = 5, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Bins with a fold: a permutation cut into pieces of max(1, n // k); what is left over is in no fold (null)."""
    from pyspark.sql import Window

    ranked = bins.withColumn("at", F.row_number().over(Window.orderBy(order if order is not None else draw(seed, "bin"), "bin")) - 1)
    whole = Window.partitionBy()
    fold = F.floor(F.col("at") / F.greatest(F.lit(1), F.floor(F.count("*").over(whole) / k))).cast("int")
    return ranked.withColumn("fold", F.when(fold < k, fold)).drop("at")
