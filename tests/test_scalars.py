"""Golden values by hand or from the formulas."""

import datetime

import pytest
from pyspark.sql import functions as F

from terrane.functions import scalars


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("sills, ranges, nugget, want", [
    ([1], [10], 0, [0, 0.6875, 1, 1, 1]),
    ([1, 0.5], [10, 25], 0, [0, 0.8355, 1.284, 1.472, 1.5]),
    ([1], [10], 0.1, [0.1, 0.7875, 1.1, 1.1, 1.1]),
])
def test_spherical(spark, sills, ranges, nugget, want):
    got = one(spark, *[scalars.spherical(F.lit(float(h)), sills, ranges, nugget) for h in (0, 5, 10, 20, 30)])
    assert got == pytest.approx(want)


def test_names_dates_and_codes(spark):
    assert one(spark, scalars.clean_name(F.lit("Été  Lidar-2018!"))) == ("Été_Lidar_2018_",)
    assert one(spark, *[scalars.source_class(F.lit(x)) for x in ("A USGS b", "noaa", "Usgs")]) == ("usgs", "noaa", "ot")
    assert one(spark, *[scalars.gps_date(F.lit(x).cast("double")) for x in (2e8, 0, None, 1.2e9)]) == (datetime.date(2018, 1, 14), None, None, datetime.date(2018, 1, 14))
    assert one(spark, scalars.utm_zone(F.lit(-84.98)), scalars.utm_epsg(F.lit(-84.98), F.lit(41.42)), scalars.utm_epsg(F.lit(10.0), F.lit(-1.0))) == (16, 32616, 32732)
    day = F.to_date(F.lit("2018-01-01"))
    assert one(spark, scalars.epoch_string(day), scalars.midpoint_date(day, F.to_date(F.lit("2018-01-04"))), scalars.midpoint_date(day, F.lit(None).cast("date"))) == ("+epoch=2018.0000", datetime.date(2018, 1, 2), None)
    assert one(spark, scalars.frame_epoch(F.lit("X,FRAME_EPOCH[2010.5]")), scalars.frame_epoch(F.lit("none"))) == (2010.5, None)
    assert one(spark, scalars.auto_name(F.lit(""), "area", F.lit(3)), scalars.auto_name(F.lit("x"), "area", F.lit(3)), scalars.auto_name(F.lit("None"), "a", F.lit(1))) == ("area3", "x", "a1")
    assert scalars.one_sided_range(None, 3) == (-3, 3) and scalars.one_sided_range(-2, None) == (-2, 2) and scalars.one_sided_range(1, 4) == (1, 4)
    start, end = scalars.coverage_dates(F.lit("2011-02-03 / 2012-03-04"))
    assert one(spark, start, end) == (datetime.date(2011, 2, 3), datetime.date(2012, 3, 4))


def test_utm_against_known_values_and_back(spark):
    # central meridian, equator and a point on 3 degrees off it
    got = one(spark, *scalars.utm_forward(F.lit(3.0), F.lit(0.0), F.lit(31)), *scalars.utm_forward(F.lit(0.0), F.lit(45.0), F.lit(31)))
    assert got == pytest.approx((500000.0, 0.0, 263553.9739, 4987329.5045), abs=1e-3)
    for lon, lat in ((1.2, 47.3), (5.9, -33.2), (3.0, 80.0)):
        east, north = scalars.utm_forward(F.lit(lon), F.lit(lat), F.lit(31))
        assert one(spark, *scalars.utm_inverse(east, north, F.lit(31), lat < 0)) == pytest.approx((lon, lat), abs=1e-8)


def test_weights_and_errors(spark):
    lag, sigma = F.lit(3.0), F.lit(0.5)
    assert one(spark, *[scalars.fit_sigma(s, lag, sigma) for s in scalars.WEIGHTS]) == pytest.approx((0.5, 0.25, 0.0497870684, 0.5, 0.1))
    with pytest.raises(ValueError):
        scalars.fit_sigma("other", lag, sigma)
    assert one(spark, scalars.correlation(F.lit(9.0), 2.0), scalars.correlation(F.lit(9.0), 2.0, False), scalars.guarded_sqrt(F.lit(-1.0))) == (-1.0, -3.5, 0.0)
