"""Tiled and packed TIFF grids, written here by hand."""

import struct
import zlib

import numpy as np
import pytest

from terrane.sources import geoids, readers

HIGH, WIDE = 37, 53


def lzw(data):
    """Codes by a growing table, cleared before it is full."""
    out, bits, held = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
            bits &= (1 << held) - 1

    table, width, now = {bytes((i,)): i for i in range(256)}, 9, b""
    put(256, 9)
    for byte in data:
        longer = now + bytes((byte,))
        if longer in table:
            now = longer
            continue
        put(table[now], width)
        table[longer] = len(table) + 2
        now = bytes((byte,))
        if len(table) + 2 >= 4094:
            put(table[now], width)
            put(256, width)
            table, width, now = {bytes((i,)): i for i in range(256)}, 9, b""
        else:
            width = 9 + (len(table) + 2 > 511) + (len(table) + 2 > 1023) + (len(table) + 2 > 2047)
    if now:
        put(table[now], width)
    put(257, width)
    put(0, 7)
    return bytes(out)


def packed(data):
    return b"".join(bytes((257 - n,)) + x if n > 1 else b"\x00" + x for x, n in runs(data))


def runs(data):
    at = 0
    while at < len(data):
        n = 1
        while n < 128 and data[at + n : at + n + 1] == data[at : at + 1]:
            n += 1
        yield data[at : at + 1], n
        at += n


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packed}


def tiff(values, order, packing, predictor, tile):
    """A file of values with a transform, a nodata value, codes and a time."""
    kind = np.dtype(values.dtype).newbyteorder(order)
    high, wide = (tile, tile) if tile else (8, values.shape[1])
    bodies = []
    for top in range(0, values.shape[0], high):
        for left in range(0, values.shape[1], wide):
            block = values[top : top + high, left : left + wide]
            if tile:
                block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1])))
            if predictor == 2:
                block = np.concatenate((block[:, :1], np.diff(block, axis=1)), 1)
            if predictor == 3:
                apart = block.astype(np.dtype(values.dtype).newbyteorder(">")).view(np.uint8).reshape(block.shape[0], block.shape[1], -1).transpose(0, 2, 1).reshape(block.shape[0], -1)
                body = np.concatenate((apart[:, :1], np.diff(apart, axis=1)), 1).astype(np.uint8).tobytes()
            else:
                body = block.astype(kind).tobytes()
            bodies.append(PACK[packing](body))
    code = {"<": b"II", ">": b"MM"}[order]
    starts, place = [], 8
    for b in bodies:
        starts.append(place)
        place += len(b)
    form = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    entries = {256: ("I", [values.shape[1]]), 257: ("I", [values.shape[0]]), 258: ("H", [values.dtype.itemsize * 8]), 259: ("H", [packing]), 277: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [form]), 306: ("s", b"2021:07:03 10:11:12\0"),
               33550: ("d", [2.0, 2.0, 0.0]), 33922: ("d", [0, 0, 0, 500_000.0, 4_000_000.0, 0]), 34735: ("H", [1, 1, 0, 2, 3072, 0, 1, 32611, 4096, 0, 1, 5703]), 42113: ("s", b"-9999\0")}
    entries |= {322: ("I", [tile]), 323: ("I", [tile]), 324: ("I", starts), 325: ("I", [len(b) for b in bodies])} if tile else {273: ("I", starts), 278: ("I", [high]), 279: ("I", [len(b) for b in bodies])}
    number = {"H": 3, "I": 4, "d": 12, "s": 2}
    directory, extra, at = [], b"", place + 2 + 12 * len(entries) + 4
    for tag, (k, v) in sorted(entries.items()):
        body = v if k == "s" else struct.pack(f"{order}{len(v)}{k}", *v)
        if len(body) <= 4:
            value = body.ljust(4, b"\0")
        else:
            value, extra = struct.pack(order + "I", at + len(extra)), extra + body
        directory.append(struct.pack(order + "HHI", tag, number[k], len(v)) + value)
    return code + struct.pack(order + "HI", 42, place) + b"".join(bodies) + struct.pack(order + "H", len(entries)) + b"".join(directory) + b"\0" * 4 + extra


CASES = [("<", 1, 1, 0, "f4"), (">", 8, 2, 16, "i2"), ("<", 8, 3, 16, "f4"), ("<", 5, 1, 16, "f8"), (">", 5, 2, 0, "u1"), ("<", 32773, 1, 32, "i4"), (">", 8, 3, 0, "f8")]


@pytest.mark.parametrize("order, packing, predictor, tile, kind", CASES)
def test_round_trip(order, packing, predictor, tile, kind):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 120, (HIGH, WIDE)).cumsum(1) % 120
    values = (values / 7 if kind[0] == "f" else values).astype(kind)
    found = readers.Tiff(tiff(values, order, packing, predictor, tile))
    out = np.full(values.shape, -1.0)
    for top, left, block in found.blocks():
        out[top : top + block.shape[0], left : left + block.shape[1]] = block
    assert np.array_equal(out, values.astype(float))
    assert found.transform == (2.0, 500_000.0, -2.0, 4_000_000.0) and found.nodata == -9999 and (found.epsg, found.vertical) == (32611, 5703)


def test_cells_and_metadata_of_files(spark, tmp_path):
    values = np.arange(HIGH * WIDE, dtype="f4").reshape(HIGH, WIDE)
    values[3, 4] = -9999
    (tmp_path / "one.tif").write_bytes(tiff(values, "<", 8, 3, 16))
    cells = {(r["row"], r["col"]): r for r in readers.read_grid(spark, f"{tmp_path}/*.tif").collect()}
    assert len(cells) == HIGH * WIDE and cells[3, 4].value is None and cells[36, 52].value == HIGH * WIDE - 1
    assert (cells[1, 2].x, cells[1, 2].y) == (500_005.0, 3_999_997.0)
    meta = readers.read_grid_meta(spark, f"{tmp_path}/*.tif").first()
    assert (meta.width, meta.height, meta.horizontal_epsg, meta.vertical_epsg, str(meta.acquired)) == (WIDE, HIGH, 32611, 5703, "2021-07-03")
    with pytest.raises(ValueError):
        readers.Tiff(tiff(values, "<", 1, 1, 0).replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0)))


def test_geoid_names(spark):
    names = spark.createDataFrame([("GEOID 12B_AK",), ("Geoid12B_ak",), ("ht2_2010v70",), ("none of them",)], "alias string")
    assert geoids.registry(spark).count() == len({line.split()[0] for line in geoids.GRIDS.strip().splitlines()})
    got = {r.alias: r.grid for r in readers.geoid_grid(names).collect()}
    assert got == {"GEOID 12B_AK": "g2012b_ak.gtx" if "geoid12bak" in geoids.GRIDS else "GEOID 12B_AK", "Geoid12B_ak": "g2012b_ak.gtx", "ht2_2010v70": "ca_ht2_2010v70.gtx", "none of them": "none of them"}
    twice = spark.createDataFrame([("a", "x"), ("a", "y")], "alias string, grid string")
    assert readers.geoid_grid(spark.createDataFrame([("A",)], "alias string"), twice).collect()[0].grid == "x"
