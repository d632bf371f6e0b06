import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import fill, geometry, model, pointcloud, raster, sampling, terrain, uncertainty, variogram, zonal
from terrane.plans import fixtures as fx
from terrane.schema import canonical

CELLS = "row long, col long, value double"
POINTS = "x double, y double, z double, classification int"


def cells(spark, rows):
    return spark.createDataFrame([(i, j, None if v is None else float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], CELLS)


def values(df):
    return {(r.row, r.col): r.value for r in df.collect()}


def test_canonical_values(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-9999.0,), (2.0,)], "v double")
    assert [r[0] for r in df.select(canonical(F.col("v"))).collect()] == [None, None, None, None, 2.0]


def test_terrain_by_hand(spark):
    dem = cells(spark, [[1, 2, 3], [4, 5, 7], [7, 9, 12]])
    assert values(terrain.slope(dem)) == {(1, 1): pytest.approx(75.8706808)}
    assert values(terrain.roughness(dem)) == {(1, 1): 11.0}
    flat = cells(spark, [[1] * 3] * 3)
    assert values(terrain.aspect(flat)) == {(1, 1): 0.0} and values(terrain.hillshade(flat)) == {(1, 1): pytest.approx(1 + 254 * math.cos(math.radians(45)))}
    assert values(terrain.aspect(cells(spark, [[3, 3, 3], [2, 2, 2], [1, 1, 1]]))) == {(1, 1): pytest.approx(180.0)}
    assert values(terrain.slope(cells(spark, [[1, 2, 3], [4, None, 7], [7, 9, 12]]))) == {}
    with pytest.raises(ValueError):
        terrain.derive(dem, "curvature")


def test_moments_and_modes(spark):
    c = cells(spark, [[1, 2, 2.5, 7, 11]])
    d = zonal.describe(c).first()
    assert (d.std, d.skewness, d.kurtosis) == pytest.approx((3.7629775445, 0.6802447616, -1.1374425452))
    assert (d.p0_5, d.median, d.p99_5) == pytest.approx((1.02, 2.5, 10.92))
    tie = cells(spark, [[3, 1, 1, 3]])
    assert zonal.first_mode(tie).first().mode == 3 and zonal.smallest_mode(tie).first().mode == 1
    assert zonal.describe(cells(spark, [[None, None]])).count() in (0, 1)
    assert zonal.rms(cells(spark, [[None]])).first().rms is None
    with pytest.raises(Exception):
        zonal.rms(cells(spark, [[None]]), strict=True).collect()


def test_difference_is_antisymmetric_and_masks(spark):
    a, b = cells(spark, [[1, None, 3], [4, 5, 6]]), cells(spark, [[2, 2, None], [1, 1, 1]])
    x, y = values(raster.difference(a, b)), values(raster.difference(b, a))
    assert x == {(0, 0): 1.0, (1, 0): -3.0, (1, 1): -4.0, (1, 2): -5.0} and x == {k: -v for k, v in y.items()}
    assert {(r.row, r.col): r["mask"] for r in raster.combined_mask(a=a, b=b).collect()}[(0, 1)] == 1
    for bad in ({}, {"both": raster.pair(a, b), "a": a, "b": b}):
        with pytest.raises(ValueError):
            raster.combined_mask(**bad)
    assert tuple(raster.symmetric_range(cells(spark, [[None]])).first()) == (0.0, 0.0)
    assert raster.remove_median(b.filter("value is not null")).agg(F.percentile("value", F.lit(0.5))).first()[0] == 0


def test_gridding(spark):
    rng = random.Random(1)
    pts = [(rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(0, 10), rng.choice([1, 2, 7])) for _ in range(200)]
    df = spark.createDataFrame(pts, POINTS)
    top = {}
    for x, y, z, _ in pts:
        top[int(y), int(x)] = max(top.get((int(y), int(x)), -1), z)
    assert values(pointcloud.dem(df, "dsm")) == pytest.approx(top)
    got = values(pointcloud.grid(df, "idw", 1.0, 1.5))
    for (r, c), v in got.items():
        near = [(z, math.dist((x, y), (c + 0.5, r + 0.5))) for x, y, z, _ in pts if math.dist((x, y), (c + 0.5, r + 0.5)) <= 1.5]
        assert v == pytest.approx(sum(z / d for z, d in near) / sum(1 / d for _, d in near))
    assert pointcloud.drop_noise(df).filter("classification = 7").count() == 0
    assert pointcloud.reset_classification(df).select("classification").distinct().count() == 1
    for bad in (lambda: pointcloud.grid(df, "middle"), lambda: pointcloud.dem(df, "dxm")):
        with pytest.raises(ValueError):
            bad()


def test_ground_filter_takes_spikes_off(spark):
    pts = [(float(x) + 0.5, float(y) + 0.5, 1.0 + (20.0 if (x, y) == (5, 5) else 0.0), 0) for x in range(10) for y in range(10)]
    got = pointcloud.classify_ground(spark.createDataFrame(pts, POINTS)).filter("classification = 1").collect()
    assert [(r.x, r.y) for r in got] == [(5.5, 5.5)]


def test_points_in_polygons_both_ways(spark, monkeypatch):
    rng = random.Random(2)
    pts = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(400)]
    df, e = spark.createDataFrame(pts, "id long, x double, y double"), fx.polygon_edges(spark)

    def held(x, y, ring):
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    want = sorted((i, k) for i, x, y in pts for k, ring in ((1, fx.TRIANGLE), (2, fx.KITE)) if held(x, y, ring))
    assert sorted((r.id, r.poly_id) for r in geometry.within(df, e, ["id"]).collect()) == want
    monkeypatch.setattr(geometry, "BROADCAST_EDGES", 0)
    assert sorted((r.id, r.poly_id) for r in geometry.within(df, e, ["id"]).collect()) == want
    assert {r.poly_id for r in geometry.at_least(geometry.measures(e), 1800).collect()} == {1}


@pytest.mark.parametrize("method", fill.METHODS)
def test_fill_keeps_values_and_fills_within_reach(spark, method):
    grid = [[float(i + 2 * j) for j in range(12)] for i in range(12)]
    gaps = [(3, 3), (6, 7), (6, 8)]
    holes = [[None if (i, j) in gaps else v for j, v in enumerate(r)] for i, r in enumerate(grid)]
    got = values(fill.fill(cells(spark, holes), method, 4))
    assert len(got) == 144 and all(got[i, j] == grid[i][j] for i in range(12) for j in range(12) if (i, j) not in gaps)
    for i, j in gaps:
        assert got[i, j] is not None and (method in ("nearest", "idw") or got[i, j] == pytest.approx(grid[i][j], abs=1e-6))
    with pytest.raises(ValueError):
        fill.fill(cells(spark, holes), "guess")


def test_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0, 5)) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, x double, y double, value double")
    got = sorted((round(r.d, 9), round(r.q, 9)) for r in variogram.pairs(df, 4.0).collect())
    want = sorted((round(math.dist(a[1:3], b[1:3]), 9), round((a[3] - b[3]) ** 2, 9)) for a, b in itertools.combinations(pts, 2) if math.dist(a[1:3], b[1:3]) < 4)
    assert got == want
    whole = variogram.bins(variogram.pairs(df, 100.0), 2.0)
    assert whole.agg(F.sum("n")).first()[0] == 120 * 119 // 2


def test_pair_bins_by_hand(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 2.0), (2, 0.0, 1.0, 4.0), (3, 3.0, 4.0, 8.0)], "id long, x double, y double, value double")
    got = {r.bin: (r.n, r.ssd, r.gamma) for r in variogram.matheron(variogram.bins(variogram.pairs(df, 10.0), 2.0), 3).collect()}
    assert got == {0: (3, 14.0, pytest.approx(7 / 3)), 2: (3, 101.0, pytest.approx(101 / 6))}
    with pytest.raises(ValueError):
        variogram.n_bins(100, 1, 50)


def test_fit_recovers_a_model(spark):
    h = np.arange(1, 40, dtype=float)
    g = model.gamma(h, np.array([2.0, 12.0, 0.5]), 1)
    vario = spark.createDataFrame([(int(i), float(x), float(y), 0.05) for i, (x, y) in enumerate(zip(h, g))], "bin int, lag double, gamma double, sigma double")
    best = model.best(model.search(vario)).first()
    assert best.sills == pytest.approx([2.0], abs=1e-3) and best.ranges == pytest.approx([12.0], abs=1e-2) and best.nug == pytest.approx(0.5, abs=1e-3)
    reps = model.bootstrap(vario, [2.0], [12.0], 0.5, 20)
    rows = model.intervals(reps, 3, [2.0, 12.0, 0.5]).collect()
    assert all(r.low <= r.median <= r.high for r in rows) and len(rows) == 3
    cv = model.cross_validate(sampling.folds(vario), 1, True).first()
    assert cv.folds == 5 and cv.rmse < 0.05


def test_uncertainty_by_hand_and_between_estimators(spark):
    assert uncertainty.analytical(spark, 10_000, ([1], [10], 0)).first().sigma == pytest.approx(0.0792670733)
    square = spark.createDataFrame([(i, j, 10.0 * i, 10.0 * j, i * 10 + j) for i in range(10) for j in range(10)], "row long, col long, y double, x double, id long")
    m = ([1], [30], 0)
    brute = uncertainty.brute_force(square, m, 10, 10_000).first().sigma
    assert brute == pytest.approx(0.2232584750) and uncertainty.autocorrelation(square, m, 10, 10_000).first().sigma == pytest.approx(brute)
    nug = ([1], [30], 0.5)
    full, off = (f(square, nug, 10, 10_000).first().sigma for f in (uncertainty.brute_force, uncertainty.autocorrelation))
    assert full**2 - off**2 == pytest.approx(0.5 * 100 * 1e4 / 1e8)
    for method in ("monte_carlo", "hug", "analytical"):
        got = uncertainty.estimate(method, square, m, 10.0, pairs=20_000).first().sigma
        assert got == pytest.approx(brute, rel=0.15)
    row = spark.range(1).select(*[c.alias(n) for n, c in uncertainty.closed_form(F.lit(1e6), 1.0, 0.3, ([0.04], [50.0], 0)).items()]).first()
    assert tuple(row) == pytest.approx((0.0003, 0.0112099824, 0.0112139960))
    for bad in (lambda: uncertainty.estimate("guess", square, m), lambda: uncertainty.box_pairs(spark, (0, 0, 1, 1), 0), lambda: uncertainty.analytical(spark, 0, m)):
        with pytest.raises(ValueError):
            bad()


def test_samples(spark):
    grid = cells(spark, [[i * 20 + j for j in range(20)] for i in range(20)])
    assert sampling.density_sample(grid, 10, 10).count() == 40
    for n in (0.001, 500):
        with pytest.raises(ValueError):
            sampling.sample_size(400, 10, n, 1e9)
    numbered, n = sampling.number(grid, ["row", "col"])
    assert n == 400 and [r.id for r in numbered.orderBy("row", "col").collect()] == list(range(400))
    boot = sampling.bootstrap_median(grid, 40).first()
    assert 0 < boot.error < 60 and abs(boot.mean - 199.5) < 30
    folded = sampling.folds(spark.range(11).select(F.col("id").alias("bin")), 5).collect()
    assert sum(r.fold is None for r in folded) == 1 and {r.fold for r in folded} == {None, 0, 1, 2, 3, 4}
    e = fx.polygon_edges(spark).filter("poly_id = 1")
    pts = sampling.points_in_polygons(spark, e, (10.5, 10.5, 80.5, 90.5), 50, 0.45)
    assert pts.count() == 50 and geometry.within(pts, e, ["id"]).count() == 50


def test_pairs_of_geographic_rasters_meet_on_a_utm_grid(spark):
    size, t1, t2 = 0.001, (0.001, 9.0, -0.001, 46.02), (0.001, 9.005, -0.001, 46.015)
    a = cells(spark, [[100 + i for _ in range(20)] for i in range(20)])
    b = cells(spark, [[200 + i for _ in range(20)] for i in range(20)])
    first, second, transform, epsg = raster.process_pair(a, b, t1, t2, 50.0)
    x, y = values(first), values(second)
    assert epsg == 32632 and x.keys() == y.keys() and len(x) > 300
    # the second raster begins five rows south of the first
    assert {round(y[k] - x[k]) for k in x} == {95}
    north = transform[3]
    want = scalars_row(spark, 9.01, 46.01)
    assert abs(want[1] - (north - 50.0 * (max(r for r, _ in x) + min(r for r, _ in x) + 1) / 2)) < 600
    assert raster.process_pair(a, b, t1, (size, 20.0, -size, 46.0), 50.0) is None
    moved = geometry.to_utm(spark.createDataFrame([(1, [[{"x": 9.0, "y": 0.0}]])], "poly_id int, rings array<array<struct<x:double,y:double>>>"), 32).first()
    assert (moved.rings[0][0].x, moved.rings[0][0].y) == pytest.approx((500000.0, 0.0))


def scalars_row(spark, lon, lat):
    from terrane.functions.scalars import utm_forward

    return tuple(spark.range(1).select(*utm_forward(F.lit(lon), F.lit(lat), F.lit(32))).first())
