"""The workflow as one chain: difference, stable ground, bias, variogram, model, uncertainty."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import model, raster, sampling, uncertainty, variogram, zonal


@dataclass(frozen=True)
class Survey:
    """A difference raster on its way; each step returns a new one and nothing runs before a result is asked for."""

    cells: DataFrame
    cell: float = 1.0
    vario: DataFrame | None = None
    fitted: tuple | None = None

    @classmethod
    def between(cls, compare: DataFrame, reference: DataFrame, cell: float = 1.0) -> Survey:
        return cls(raster.difference(compare, reference), cell)

    def stable(self, unstable_edges: DataFrame | None) -> Survey:
        return replace(self, cells=zonal.stable(self.cells, unstable_edges))

    def clip(self, edges: DataFrame) -> Survey:
        return replace(self, cells=zonal.clip(self.cells, edges))

    def unbiased(self) -> Survey:
        return replace(self, cells=raster.remove_median(self.cells))

    def statistics(self) -> DataFrame:
        return zonal.describe(self.cells)

    def variogram(self, width: float, share: float, runs: int, extent: tuple[float, float], multiplier: float | str = 1 / 3, seed: int = 42) -> Survey:
        """Mean variogram of runs, each over a hashed sample of the share of cells; extent in map units."""
        lag = variogram.max_lag(*extent, multiplier)
        sample = sampling.run_samples(self.cells, share, runs, seed)
        centre = {"id": F.shiftleft(F.col("row").cast("long"), 32) + F.col("col"), "x": F.col("col") * self.cell, "y": F.col("row") * self.cell}
        by_run = variogram.variogram(sample.withColumns(centre), width, lag, ("run",))
        return replace(self, vario=variogram.mean_variogram(by_run, width, lag, runs))

    def fit(self, seed: int = 42) -> Survey:
        """The best nested spherical model; a row of a few numbers comes to the driver."""
        m = model.best(model.search(self.vario, seed)).first()
        return replace(self, fitted=(list(m.sills), list(m.ranges), float(m.nug)))

    def uncertainty(self, method: str = "analytical", **options) -> DataFrame:
        numbered, _ = sampling.number(self.cells.filter("value is not null"), ["row", "col"])
        cells = numbered.select("id", "row", "col", (F.col("col") * self.cell).alias("x"), (F.col("row") * self.cell).alias("y"))
        return uncertainty.estimate(method, cells, self.fitted, self.cell, **options)
