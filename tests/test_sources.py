import struct

import pytest

from terrane.sources import readers
from terrane.streaming import gridding


def las(points):
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<I", head, 96, 227)
    head[104] = 1
    struct.pack_into("<HI", head, 105, 28, len(points))
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    body = b"".join(struct.pack("<iiiHBBbBHd", round((x - 100) * 100), round((y - 200) * 100), round(z * 100), 0, 0, c, 0, 0, 0, t) for x, y, z, c, t in points)
    return bytes(head) + body


def tiff(rows):
    h, w = len(rows), len(rows[0])
    body = struct.pack(f"<{h * w}f", *[v for r in rows for v in r])
    tags = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (279, 4, 1, len(body)), (339, 3, 1, 3)]
    place = 8 + len(body)
    extra = struct.pack("<3d", 2.0, 2.0, 0.0) + struct.pack("<6d", 0, 0, 0, 50.0, 90.0, 0)
    n = len(tags) + 2
    at = place + 2 + 12 * n + 4
    tags += [(33550, 12, 3, at), (33922, 12, 6, at + 24)]
    return b"II*\0" + struct.pack("<I", place) + body + struct.pack("<H", n) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0" + extra


def test_files_by_suffix(spark, tmp_path):
    pts = [(101.0, 202.0, 3.5, 2, 2e8), (110.25, 199.5, -1.0, 7, 2.5e8)]
    (tmp_path / "a.las").write_bytes(las(pts))
    got = sorted((r.x, r.y, r.z, r.classification, r.gps_time, r.survey) for r in readers.open_any(spark, str(tmp_path / "a.las")).collect())
    assert got == [(*p, "a.las") for p in pts]
    (tmp_path / "b.tif").write_bytes(tiff([[1, 2, -9999], [4, 5, 6]]))
    got = {(r.row, r.col): (r.x, r.y, r.value) for r in readers.open_any(spark, str(tmp_path / "b.tif")).collect()}
    assert got[0, 0] == (51.0, 89.0, 1.0) and got[0, 2][2] is None and got[1, 2] == (55.0, 87.0, 6.0)
    (tmp_path / "c.asc").write_text("ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -1\n1 2\n-1 4\n")
    got = {(r.row, r.col): (r.x, r.y, r.value) for r in readers.open_any(spark, str(tmp_path / "c.asc")).collect()}
    assert got == {(0, 0): (12.5, 27.5, 1.0), (0, 1): (17.5, 27.5, 2.0), (1, 0): (12.5, 22.5, None), (1, 1): (17.5, 22.5, 4.0)}
    with pytest.raises(ValueError):
        readers.open_any(spark, "x.png")


def test_parquet_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("r", 0, 0, 0.5, 0.5, 1.5), ("r", 0, 1, 1.5, 0.5, float("nan")), ("q", 0, 0, 0.5, 0.5, -9999.0)], "raster_id string, row int, col int, x double, y double, value double")
    readers.write_cells(cells, str(tmp_path / "cells"), ("raster_id",))
    got = readers.read_cells(spark, str(tmp_path / "cells"), "r").collect()
    assert sorted((r.col, r.value) for r in got) == [(0, 1.5), (1, None)]
    pts = spark.createDataFrame([(1.0, 1.0, 5.0), (9.0, 9.0, 6.0)], "x double, y double, z double")
    readers.write_points(pts, str(tmp_path / "points"))
    box = readers.read_points(spark, str(tmp_path / "points"), (0, 0, 5, 5))
    assert box.count() == 1 and "PushedFilters: [IsNotNull(x)" in box._jdf.queryExecution().toString()


def test_geojson_guard_and_lookup(spark):
    assert readers.geojson_polygon('{"type": "Polygon"}')
    with pytest.raises(ValueError):
        readers.geojson_polygon('{"type": "Point"}')
    text = spark.createDataFrame([('{"assets": {"ept": {"href": "u"}}}',)], "value string")
    assert readers.ept_href(text).first().href == "u"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(float(i % 5), float(i % 3), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    df.repartition(4).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    got = gridding.run_available(gridding.grid_stream(stream), "grid_test", "complete", str(tmp_path / "ck"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, gridding.grid_stream(df).collect()))
