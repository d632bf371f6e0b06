"""Gridding of point streams: the batch aggregates as incremental ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_stream(points: DataFrame, resolution: float = 1.0, keys: tuple = ()) -> DataFrame:
    """row, col, max_z, mean_z and n of all points so far (update or complete mode)."""
    cell = {"row": F.floor(F.col("y") / resolution).cast("long"), "col": F.floor(F.col("x") / resolution).cast("long")}
    return points.withColumns(cell).groupBy(*keys, "row", "col").agg(F.max("z").alias("max_z"), F.avg("z").alias("mean_z"), F.count("*").alias("n"))


def bias_windows(points: DataFrame, time: str = "t", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean and spread by time window; a window is final once the watermark has passed it (append mode)."""
    return points.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("std_z"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "mean_z", "std_z", "n")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str):
    """Everything that is there now into a memory table of this name."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
