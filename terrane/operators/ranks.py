"""Exact order statistics without a table of all distinct values in one task.

A sketch (approximate percentiles, whose error in rank is bounded) brackets the values in question; what lies below a
bracket is only counted, and of what lies in it distinct values are put in order.  A bracket holds some RANKS-th of the
rows, or a few values that are very frequent, which are counted before they are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch: ranks are met within one RANKS-th of the rows.
RANKS = 20_000


#: Rows up to which all values are put in order.
FEW = 4 * RANKS


def _bracket(v, low: float, high: float) -> tuple:
    """Values between which the ranks from low to high (shares) lie."""
    margin, few = 2 / RANKS, F.count(v) <= FEW
    a = F.min(v) if low <= margin else F.when(few, F.min(v)).otherwise(F.percentile_approx(v, low - margin, RANKS))
    b = F.max(v) if high >= 1 - margin else F.when(few, F.max(v)).otherwise(F.percentile_approx(v, high + margin, RANKS))
    return a, b


def percentiles(cells: DataFrame, probs: tuple, *by: str, value: str = "value", name: str = "p") -> DataFrame:
    """``by`` and an array of the percentiles, interpolated as percentile does; one row a group, null without values.

    Brackets are one row a group.
    """
    v = F.col(value)
    valid = cells.filter(v.isNotNull()).select(*by, v.cast("double").alias("v"))
    ends = [x.alias(f"{end}{i}") for i, p in enumerate(probs) for end, x in zip("ab", _bracket(F.col("v"), p, p))]
    cuts = valid.groupBy(*by).agg(F.count("*").alias("rows"), *ends)
    met = valid.join(F.broadcast(cuts)) if not by else valid.join(cuts, list(by))
    below = met.groupBy(*by, "rows").agg(*[F.sum((F.col("v") < F.col(f"a{i}")).cast("long")).alias(f"below{i}") for i in range(len(probs))])
    held = F.filter(F.array(*[F.when(F.col("v").between(F.col(f"a{i}"), F.col(f"b{i}")), i) for i in range(len(probs))]), lambda i: i.isNotNull())
    inside = met.select(*by, "v", F.explode(held).alias("i")).groupBy(*by, "i", "v").agg(F.count("*").alias("n"))
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "i").orderBy("v")))
    placed = inside.join(F.broadcast(below)) if not by else inside.join(below, list(by))
    at = lambda i, x: F.element_at(F.array(*[F.lit(y) if isinstance(y, float) else F.col(y) for y in x]), i + 1)
    start = at(F.col("i"), [f"below{i}" for i in range(len(probs))])
    place = at(F.col("i"), [float(p) for p in probs]) * (F.col("rows") - 1)
    first, end = start + F.col("upto") - F.col("n"), start + F.col("upto")
    pick = lambda rank: F.max(F.when((first <= rank) & (rank < end), F.col("v")))
    found = placed.groupBy(*by, "i").agg(pick(F.floor(place)).alias("low"), pick(F.ceil(place)).alias("high"), F.first(place - F.floor(place)).alias("part"))
    one = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    out = found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", one.alias("x")))), lambda s: s["x"]).alias(name))
    return out if by else out.select(F.when(F.size(name) > 0, F.col(name)).alias(name))


def at_ranks(cells: DataFrame, ranks: list[int], value: str = "value") -> DataFrame:
    """rank and value of the valid cells' order statistics from 0; the ranks are a bounded list, best close to each other."""
    spark, v = cells.sparkSession, F.col(value)
    valid = cells.filter(v.isNotNull()).select(v.cast("double").alias("v"))
    rows = valid.count()
    if not rows or not ranks:
        return spark.createDataFrame([], "rank long, value double")
    a, b = _bracket(F.col("v"), min(ranks) / rows, (max(ranks) + 1) / rows)
    low, high = valid.agg(a, b).first()
    below = valid.filter(F.col("v") < low).count()
    counts = valid.filter(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n"))
    ends = counts.select("v", (F.sum("n").over(Window.orderBy("v")) + F.lit(below)).alias("end"), F.lit(None).cast("long").alias("rank"))
    asked = spark.createDataFrame([(int(r),) for r in set(ranks)], "rank long").select(F.lit(None).cast("double").alias("v"), (F.col("rank") + 1).alias("end"), "rank")
    # of each rank, the first value whose end is not before it
    after = Window.orderBy("end", F.col("rank").isNull()).rowsBetween(0, Window.unboundedFollowing)
    return ends.unionByName(asked).withColumn("value", F.first("v", True).over(after)).filter("rank is not null").select("rank", "value")
