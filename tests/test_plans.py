"""The estimator, the workflow, outlines of patches, order statistics and offset counts, against plain Python."""

import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import fill, geometry, pointcloud, raster, ranks, sampling, uncertainty, vectorise, zonal
from terrane.plans import fixtures as fx
from terrane.plans import regional, workflow
from terrane.sources import readers

GRID = "row long, col long, value double"


def blob(seed, n=14, share=0.6):
    rng = random.Random(seed)
    return [(i, j) for i in range(n) for j in range(n) if rng.random() < share]


def frame(spark, cells, value=1.0):
    return spark.createDataFrame([(i, j, value) for i, j in cells], GRID)


@pytest.mark.parametrize("seed, share", [(1, 0.6), (2, 0.95), (3, 0.1)])
def test_offsets_both_ways_against_all_pairs(spark, seed, share):
    cells = blob(seed, share=share)
    want = Counter((abs(a - c) if a != c else 0, (d - b) if a <= c else (b - d)) for a, b in cells for c, d in cells)
    pairs = Counter()
    for a, b in cells:
        for c, d in cells:
            if c >= a:
                pairs[c - a, d - b] += 2 if c > a else 1
    assert sum(want.values()) == sum(pairs.values()) == len(cells) ** 2
    for found in (uncertainty.offsets(frame(spark, cells)), uncertainty.convolved_offsets(frame(spark, cells))):
        assert {(r.di, r.dj): r.n for r in found.collect()} == dict(pairs)
    near = {(r.di, r.dj): r.n for r in uncertainty.offsets(frame(spark, cells), 3).collect()}
    assert near == {k: n for k, n in pairs.items() if k[0] <= 3}


def test_offsets_of_small_blocks_and_nothing(spark, monkeypatch):
    cells = blob(5)
    want = {(r.di, r.dj): r.n for r in uncertainty.offsets(frame(spark, cells)).collect()}
    monkeypatch.setattr(uncertainty, "BLOCK_VALUES", 100)
    assert {(r.di, r.dj): r.n for r in uncertainty.convolved_offsets(frame(spark, cells)).collect()} == want
    assert uncertainty.convolved_offsets(frame(spark, [(0, 0)]).limit(0)).count() == 0


@pytest.mark.parametrize("few", [80_000, 0])
def test_percentiles_and_ranks(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "RANKS", 200 if not few else 20_000)
    rng = random.Random(4)
    rows = [(i % 3, float(rng.choice([rng.gauss(0, 9), 7.0, -1.0]))) for i in range(5000)]
    df = spark.createDataFrame([(g, 0, v) for g, v in rows] + [(5, 0, None)], "g long, row long, value double")
    probs = (0.005, 0.25, 0.5, 0.99, 1.0, 0.0)
    got = {r.g: r.p for r in ranks.percentiles(df, probs, "g").collect()}
    for g in range(3):
        own = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx([float(np.quantile(own, p)) for p in probs], abs=1e-9)
    assert ranks.percentiles(df, (0.5,)).first().p[0] == pytest.approx(statistics.median(v for _, v in rows))
    assert ranks.percentiles(df.limit(0), (0.5,)).first().p is None
    order = sorted(v for _, v in rows)
    asked = [2400, 2500, 2501, 2600]
    assert {r["rank"]: r["value"] for r in ranks.at_ranks(df, asked).collect()} == {k: order[k] for k in asked}


def test_bootstrap_of_the_median_against_drawn_samples(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(0, 5, 4000)
    df = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(values)], GRID)
    for share in (0.1, 0.10025):  # an even and an odd number of draws
        got = sampling.bootstrap_median(df, 1000, share).first()
        drawn = [np.median(rng.choice(values, round(share * 4000))) for _ in range(3000)]
        assert got["error"] == pytest.approx(np.std(drawn), rel=0.12) and got["mean"] == pytest.approx(np.mean(drawn), abs=0.05)
    assert sampling.bootstrap_median(df.limit(0)).first()["error"] is None


@pytest.mark.parametrize("seed, share", [(1, 0.6), (2, 0.9), (7, 0.4)])
def test_outlines_hold_their_cells(spark, seed, share):
    cells = blob(seed, share=share)
    patches = raster.patches(frame(spark, cells))
    size = Counter(r.patch for r in patches.collect())
    found = vectorise.outlines(patches).withColumnRenamed("patch", "poly_id")
    edges = geometry.edges(found)
    assert {r.poly_id: r.area for r in geometry.measures(edges).collect()} == pytest.approx(dict(size))
    centres = patches.select("row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"), "patch")
    held = geometry.within(centres, edges, ["row", "col"]).collect()
    assert len(held) == len(cells) and all(r.poly_id == r.patch for r in held)


def test_derived_stable_polygons(spark):
    cells = [(i, j) for i in range(20) for j in range(20) if j != 9 and (i, j) != (3, 3)]
    square = spark.createDataFrame([(1, [[{"x": 11.5, "y": 4.5}, {"x": 15.5, "y": 4.5}, {"x": 15.5, "y": 8.5}, {"x": 11.5, "y": 8.5}]])], "poly_id int, rings array<array<struct<x:double,y:double>>>")
    found = vectorise.derive_stable(frame(spark, cells), geometry.edges(square)).collect()
    assert sorted(len(r.rings) for r in found) == [2, 2] and sorted(r["name"] for r in found) == ["stable_1", "stable_2"] or len({r["name"] for r in found}) == 2
    areas = lambda df: sorted(r.area for r in geometry.measures(geometry.edges(df)).collect())
    assert areas(vectorise.derive_stable(frame(spark, cells), geometry.edges(square))) == [179.0, 184.0]
    assert areas(vectorise.derive_stable(frame(spark, cells), geometry.edges(square), min_area=180)) == [184.0]
    assert areas(vectorise.derive_stable(frame(spark, cells), geometry.edges(square), exclude_nodata=False)) == [384.0]
    old = square.withColumns({"name": F.lit("old"), "category": F.lit("stable")})
    assert [r["name"] for r in vectorise.derive_stable(frame(spark, cells), None, old, replace=False).collect()].count("old") == 1


def test_estimator_binds_bounds_and_wants_one_polygon(spark):
    cells = frame(spark, [(i, j) for i in range(30) for j in range(30)], 2.0)
    polygon = fx.polygons(spark).filter("poly_id = 2")
    low, high = ([10.0, 2.0], [6.0, 20.0], 1.0), ([30.0, 8.0], [9.0, 30.0], 5.0)
    samples = spark.createDataFrame([(i, [20.0 + i, 5.0], [8.0, 25.0], 3.0) for i in range(5)], "rep int, sills array<double>, ranges array<double>, nug double")
    for bad in (fx.polygons(spark), polygon.limit(0)):
        with pytest.raises(ValueError):
            regional.Regional.of(cells, bad, fx.MODEL)
    one = regional.Regional.of(cells, polygon, fx.MODEL, low, high, samples=samples)
    got = {(r.scope, r.component, r.stat): r for r in one.uncertainty(n=4000).collect()}
    assert len(got) == 18 and all(got[s, "total", "min"].correlated < got[s, "total", "central"].correlated < got[s, "total", "max"].correlated for s in ("polygon", "raster"))
    n = one.inside().count()
    r = got["polygon", "total", "central"]
    assert r.uncorrelated == pytest.approx(2 / n**0.5) and r.total == pytest.approx((r.uncorrelated**2 + r.correlated**2) ** 0.5)
    # the median over bootstrapped parameters stands for the central value
    median = uncertainty.propagate(one.pairs("polygon", 4000), samples, 2).filter("component = 'total'").first()["median"]
    assert r.correlated == pytest.approx(median)
    lines = [x.line for x in one.report("slide", one.uncertainty(n=500)).collect()]
    assert any(x.startswith("slide, polygon total total central:") for x in lines) and len(lines) == 18 + 6
    loose = regional.Regional.of(cells, polygon, fx.MODEL)
    assert loose.uncertainty(n=500, detailed=False).count() == 6
    with pytest.raises(ValueError):
        regional.models_of(([1.0], [0.0], 0.0))


def test_k_centres_with_a_map_take_the_nearest_pixels(spark):
    cells = spark.createDataFrame([(float(x), float(y)) for x in range(10) for y in range(10)], "x double, y double")
    centres = cells.limit(5).select(F.col("x").alias("cx"), F.col("y").alias("cy"))
    whole = uncertainty.k_centres(cells, centres, fx.MODEL, 9.0).first()["sigma"]
    flat = spark.createDataFrame([(i, j, 9.0) for i in range(2) for j in range(2)], GRID)
    assert regional.local_k_centres(cells, centres, fx.MODEL, flat, (4.0, 0.0, 4.0, 0.0)).first()["sigma"] == pytest.approx(whole)
    stripes = spark.createDataFrame([(i, j, float(j)) for i in range(3) for j in range(3)], GRID)
    mean = statistics.mean(min(range(3), key=lambda j: abs(x - 4 * (j + 0.5))) for x in range(10) for _ in range(10))
    got = regional.local_k_centres(cells, centres, fx.MODEL, stripes, (4.0, 0.0, 4.0, 0.0)).first()["sigma"]
    assert got == pytest.approx(whole / 3 * mean**0.5)


def test_workflow_and_single_models(spark):
    pts = [(float(x) + 0.3, float(y) + 0.6, float(x + y + s), 2) for x in range(8) for y in range(8) for s in (0, 1) if (x, y) != (3, 4)]
    df = spark.createDataFrame(pts, "x double, y double, z double, classification int")
    orders = workflow.Order("compare", "ot", df), workflow.Order("reference", "noaa", df.withColumn("z", F.col("z") + 2))
    out = workflow.run(spark, *orders, reach=5)
    assert set(out) == {f"{r}_{k}" for r in ("compare", "reference", "diff") for k in ("dtm", "dsm")}
    diff = out["diff_dsm"].collect()
    assert len(diff) == 64 and all(r["value"] == pytest.approx(2.0) for r in diff)
    for bad in (lambda: workflow.Order("third", "ot", df), lambda: workflow.Order("compare", "else", df), lambda: workflow.run(spark, *orders[::-1]), lambda: workflow.models(orders[0], spark, ("chm",))):
        with pytest.raises(ValueError):
            bad()
    catalog = spark.createDataFrame([("b", "USGS", None), ("a", "USGS", None)], "name string, data_source string, start_date date")
    assert workflow.single(spark, catalog, lambda row: df, gaps=None).count() == 63
    with pytest.raises(ValueError):
        readers.one_dataset(catalog, "c")


def test_progressive_ground_filter_keeps_slopes_and_drops_buildings(spark):
    inside = lambda x, y: 8 <= x < 14 and 8 <= y < 14
    pts = [(x + 0.5, y + 0.5, 0.1 * x + (6.0 if inside(x, y) else 0.0), 0) for x in range(30) for y in range(30)]
    got = pointcloud.classify_ground(spark.createDataFrame(pts, "x double, y double, z double, classification int")).collect()
    assert len(got) == 900
    assert all((r.classification == 1) == inside(int(r.x), int(r.y)) for r in got)


def test_idw_in_eight_directions_and_smoothing(spark):
    grid = {(i, j): float(i * 3 + j) for i in range(7) for j in range(7)}
    gaps = [(3, 3), (3, 4), (0, 0)]
    df = spark.createDataFrame([(i, j, None if (i, j) in gaps else v) for (i, j), v in grid.items()], GRID)
    got = {(r["row"], r["col"]): r["value"] for r in fill.fill(df, "idw", 3).collect()}
    for i, j in gaps:
        top = low = 0.0
        for di, dj in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
            k = next((k for k in range(1, 7) if (i + k * di, j + k * dj) in grid and (i + k * di, j + k * dj) not in gaps), None)
            if k and k * (di * di + dj * dj) ** 0.5 <= 3:
                d = k * (di * di + dj * dj) ** 0.5
                top, low = top + grid[i + k * di, j + k * dj] / d, low + 1 / d
        assert got[i, j] == pytest.approx(top / low)
    smooth = {(r["row"], r["col"]): r["value"] for r in fill.fill(df, "idw", 3, 1).collect()}
    near = [got[a, b] for a in (2, 3, 4) for b in (2, 3, 4)]
    assert smooth[3, 3] == pytest.approx(statistics.mean(near)) and smooth[1, 1] == grid[1, 1]


def test_nearest_against_all_cells(spark):
    rng = random.Random(8)
    grid = {(i, j): rng.random() if rng.random() < 0.2 else None for i in range(16) for j in range(16) if rng.random() < 0.9}
    got = {(r["row"], r["col"]): r["value"] for r in fill.nearest(spark.createDataFrame([(i, j, v) for (i, j), v in grid.items()], GRID), 4).collect()}
    for (i, j), v in grid.items():
        best = min((((i - a) ** 2 + (j - b) ** 2, a, b) for (a, b), w in grid.items() if w is not None), default=None)
        assert got[i, j] == (v if v is not None else grid[best[1:]] if best[0] <= 16 else None)
