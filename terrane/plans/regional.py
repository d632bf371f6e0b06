"""Mean uncertainty of one polygon and of its raster from a fitted variogram, with the bounds of its parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import geometry, sampling, uncertainty, zonal
from terrane.operators.uncertainty import Model

STATS = ("central", "min", "max")
#: Pairs of points in the polygon and in the raster.
POLYGON_PAIRS, RASTER_PAIRS = 200_000, 100_000


def models_of(fitted: Model, lower: Model | None = None, upper: Model | None = None) -> dict[str, Model]:
    """The central model and those of its parameters' lower and upper bounds, as far as there are any."""
    given = {"central": fitted, "min": lower, "max": upper}
    for stat, model in given.items():
        if model is not None and (len(model[0]) != len(model[1]) or not model[0] or min(model[1]) <= 0):
            raise ValueError(f"the {stat} model needs a positive range for each sill")
    return {stat: model for stat, model in given.items() if model is not None}


@dataclass(frozen=True)
class Regional:
    """One polygon on a raster of differences, and the models of its variogram."""

    cells: DataFrame
    edges: DataFrame
    models: dict
    cell: float = 1.0
    samples: DataFrame | None = None

    @classmethod
    def of(cls, cells: DataFrame, polygons: DataFrame, fitted: Model, lower: Model | None = None, upper: Model | None = None, cell: float = 1.0, samples: DataFrame | None = None) -> Regional:
        """cells: row, col, value; polygons(poly_id, rings) in units of cells, exactly one with an area; samples(rep, sills, ranges,
        nug): bootstrapped parameters, if any."""
        edges = geometry.edges(polygons)
        found = geometry.measures(edges).filter("area > 0").limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"one polygon with an area is needed, not {'several' if found else 'none'}")
        return cls(cells.filter("value is not null").select("row", "col", "value"), edges, models_of(fitted, lower, upper), cell, samples)

    def inside(self) -> DataFrame:
        return zonal.clip(self.cells, self.edges).select("row", "col", "value")

    def numbered(self, cells: DataFrame) -> DataFrame:
        rows, _ = sampling.number(cells, ["row", "col"])
        return rows.select("id", "row", "col", "value", (F.col("col") * self.cell).alias("x"), (F.col("row") * self.cell).alias("y"))

    def pairs(self, scope: str, n: int | None = None, seed: int = 42, detailed: bool = True) -> DataFrame:
        """Pairs of points over the polygon's or all valid cells; for a raster that is not ``detailed``, in its bounds."""
        if scope == "polygon":
            return uncertainty.draw_pairs(self.numbered(self.inside()), n or POLYGON_PAIRS, self.cell, seed)
        if detailed:
            return uncertainty.draw_pairs(self.numbered(self.cells), n or RASTER_PAIRS, self.cell, seed)
        box = self.cells.agg(F.min("col"), F.min("row"), F.max("col") + 1, F.max("row") + 1).first()
        return uncertainty.box_pairs(self.cells.sparkSession, tuple(v * self.cell for v in box), n or RASTER_PAIRS, seed)

    def correlated(self, scope: str, pairs: DataFrame) -> DataFrame:
        """component, stat and sigma by the models; of a polygon with bootstrapped parameters their median and outer percentiles
        stand for the total and the components."""
        by_model = uncertainty.by_component(pairs, self.models)
        if scope != "polygon" or self.samples is None:
            return by_model
        spread = uncertainty.propagate(pairs, self.samples, len(self.models["central"][0]))
        entries = F.array(*[F.struct(F.lit(stat).alias("stat"), F.col(c).alias("sigma")) for stat, c in zip(STATS, ("median", "low", "high"))])
        return spread.select("component", F.explode(entries).alias("e")).select("component", "e.stat", "e.sigma")

    def uncorrelated(self) -> DataFrame:
        """scope and the uncorrelated part: the root mean square over the root of the number of cells."""
        parts = {"polygon": self.inside(), "raster": self.cells}
        out = None
        for scope, cells in parts.items():
            row = cells.agg(zonal.uncorrelated().alias("uncorrelated")).select(F.lit(scope).alias("scope"), "uncorrelated")
            out = row if out is None else out.unionByName(row)
        return out

    def uncertainty(self, polygon: DataFrame | None = None, raster: DataFrame | None = None, **options) -> DataFrame:
        """scope, component, stat, correlated, uncorrelated and total (null for components, and where a part is unknown).

        polygon, raster: pairs to use instead of drawn ones.
        """
        pairs = {"polygon": polygon, "raster": raster}
        long = None
        for scope, given in pairs.items():
            one = self.correlated(scope, given if given is not None else self.pairs(scope, **options))
            one = one.select(F.lit(scope).alias("scope"), "component", "stat", F.col("sigma").alias("correlated"))
            long = one if long is None else long.unionByName(one)
        out = long.join(F.broadcast(self.uncorrelated()), "scope")  # two rows
        total = F.when(F.col("component") == "total", uncertainty.total(F.col("uncorrelated"), F.col("correlated")))
        return out.select("scope", "component", "stat", "correlated", "uncorrelated", total.alias("total"))

    def report(self, feature: str, results: DataFrame) -> DataFrame:
        """Lines of text of what ``uncertainty`` found; unknown values are left out."""
        kinds: dict[str, Column] = {"correlated": F.col("correlated"), "total": F.col("total")}
        entries = F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in kinds.items()])
        rows = results.select(F.lit(feature).alias("feature"), "scope", F.explode(entries).alias("e"), "component", "stat")
        return uncertainty.report(rows.select("feature", "scope", F.concat_ws(" ", "e.kind", "component").alias("component"), "stat", "e.value"))


def local_k_centres(cells: DataFrame, centres: DataFrame, model: Model, variances: DataFrame, transform: tuple) -> DataFrame:
    """The K-centre estimate with a variance map: the mean variance is that of the map's nearest pixels.

    cells(x, y); variances(row, col, value) on a grid with transform (a, c, e, f), whose pixel nearest to a cell is known by
    rounding, so the lookup is an equi-join; beyond the grid's border the border pixel is the nearest.
    """
    a, c, e, f = transform
    size = variances.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    placed = cells.join(F.broadcast(size))  # one row
    # halfway between two pixels the one of the smaller index is the nearest
    near = lambda v, low, high: F.greatest(F.least(F.ceil(v - 1.0), F.col(high)), F.col(low)).cast("long")
    keyed = placed.select("x", "y", near((F.col("y") - f) / e, "r0", "r1").alias("row"), near((F.col("x") - c) / a, "c0", "c1").alias("col"))
    held = keyed.join(variances.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"), ["row", "col"], "left")
    mean = held.agg(F.avg("value").alias("variance"))
    sigma = uncertainty.k_centres(cells, centres, model, 1.0)
    return sigma.join(F.broadcast(mean)).select((F.col("sigma") * F.sqrt("variance")).alias("sigma"))
