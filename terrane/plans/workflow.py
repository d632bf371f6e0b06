"""Elevation models of two surveys from their point clouds, in one go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from terrane.operators import fill, pointcloud, raster
from terrane.sources import readers

KINDS = ("dtm", "dsm")
#: Ways points come in by data source: its own table, or a cloud file.
SOURCES = ("ot", "usgs", "noaa")


@dataclass(frozen=True)
class Order:
    """One survey of a workflow: role, data source, and its points or the path of them."""

    role: str
    source: str
    points: DataFrame | str

    def __post_init__(self) -> None:
        if self.role not in ("compare", "reference") or self.source not in SOURCES:
            raise ValueError(f"a survey is compare or reference from {', '.join(SOURCES)}, not {self.role} from {self.source}")

    def read(self, spark, box: tuple | None = None) -> DataFrame:
        if not isinstance(self.points, str):
            return self.points
        if self.points.lower().endswith(readers.POINT_FILES):
            return readers.read_las(spark, self.points)
        return readers.read_points(spark, self.points, box)


def models(order: Order, spark, kinds: tuple = KINDS, resolution: float = 1.0, rings=None, filter_noise: bool = False, reclassify: bool = False, zone: int | None = None, gaps: str | None = "idw", reach: int = 50, smoothing: int = 0) -> dict[str, DataFrame]:
    """The elevation models of one survey by kind, their gaps filled unless ``gaps`` is None.

    The spine of a model is its own bounding box, so gaps are cells between measured ones.
    """
    unknown = set(kinds) - set(KINDS)
    if unknown:
        raise ValueError(f"a DEM is {' or '.join(KINDS)}, not {', '.join(sorted(unknown))}")
    points = pointcloud.prepare(order.read(spark), rings, filter_noise, reclassify, zone)
    out = {}
    for kind in kinds:
        grid = pointcloud.dem(points, kind, resolution)
        out[kind] = fill.fill(raster.boxed(grid), gaps, reach, **({"smoothing": smoothing} if gaps == "idw" else {})) if gaps else grid
    return out


def run(spark, compare: Order, reference: Order, **options) -> dict[str, DataFrame]:
    """role and kind to model, and diff_<kind> to their differences, reference minus compare."""
    if (compare.role, reference.role) != ("compare", "reference"):
        raise ValueError("give the compare survey first, then the reference one")
    made = {order.role: models(order, spark, **options) for order in (compare, reference)}
    out = {f"{role}_{kind}": grid for role, grids in made.items() for kind, grid in grids.items()}
    for kind in made["compare"]:
        out[f"diff_{kind}"] = raster.difference(made["compare"][kind], made["reference"][kind])
    return out


def single(spark, catalog: DataFrame, read, name: str | None = None, kind: str = "dsm", **options) -> DataFrame:
    """The model of one dataset of a catalog (by name, else the first); ``read`` maps its row to points or a path."""
    row = readers.one_dataset(catalog, name).first()
    source = next((s for s in SOURCES if s in str(row.data_source).lower()), SOURCES[0])
    return models(Order("compare", source, read(row)), spark, (kind,), **options)[kind]
