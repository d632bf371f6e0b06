"""Queries over all cells of the grid or polygon, against plain Python."""

import os

import pytest

from terrane.operators import raster, zonal
from terrane.plans import fixtures as fx
from terrane.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def flood(cells):
    """The smallest cell of each cell's patch."""
    left, out = set(cells), []
    for cell in sorted(cells):
        todo = [cell] if cell in left else []
        left -= {cell}
        while todo:
            i, j = todo.pop()
            out.append((i, j, cell[0] * 2**32 + cell[1]))
            near = left & {(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)}
            left -= near
            todo += near
    return sorted(out)


def test_patches_of_the_whole_grid(spark):
    rose = [(r["row"], r["col"]) for r in fx.diff(spark, DATA).filter("value > 0").collect()]
    assert max(i for i, _ in rose) > 90 and max(j for _, j in rose) > 90
    assert sorted(tuple(r) for r in QUERIES["patches"](spark, DATA).collect()) == flood(rose)


def test_a_winding_patch_and_too_few_rounds(spark):
    cells = [(i, j) for i in range(0, 6, 2) for j in range(6)] + [(1, 5), (3, 0)]
    grid = spark.createDataFrame([(i, j, 1.0) for i, j in cells], "row long, col long, value double")
    assert sorted(tuple(r) for r in raster.patches(grid).collect()) == flood(cells)
    with pytest.raises(RuntimeError):
        raster.patches(grid, 2)


def test_uncertainty_and_variogram_take_all_cells(spark):
    cells = [(r["row"], r["col"], r["value"]) for r in zonal.clip(fx.diff(spark, DATA), fx.polygon_edges(spark).filter("poly_id = 2")).collect()]
    sills, ranges, nugget = fx.MODEL

    def covariance(h):
        return sum(sills) + nugget - nugget - sum(c * (1.5 * h / a - 0.5 * (h / a) ** 3) if h <= a else c for c, a in zip(sills, ranges))

    total = sum(covariance(((i - k) ** 2 + (j - m) ** 2) ** 0.5) for i, j, _ in cells for k, m, _ in cells)
    assert QUERIES["unc_offset_hist"](spark, DATA).first()["sigma"] == pytest.approx(total**0.5 / len(cells), abs=1e-5)
    grid = [(r["row"], r["col"]) for r in fx.diff(spark, DATA).collect()]
    near = sum(((i - k) ** 2 + (j - m) ** 2) < 16 for n, (i, j) in enumerate(grid) for k, m in grid[:n] if abs(i - k) < 4)
    assert {r["bin"]: r["n"] for r in QUERIES["variogram_single_whole"](spark, DATA).collect()}[0] == near
