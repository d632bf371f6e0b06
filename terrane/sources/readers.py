"""Readers and sinks.

Points, cells and polygons live in Parquet; LAS clouds (uncompressed), ASCII and TIFF grids (strips or tiles, plain, deflate, LZW or packed) are decoded from
binary files in parallel, one file a task; polygons come from GeoJSON, catalogs from JSON responses.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane import schema
from terrane.functions import scalars
from terrane.sources import geoids

POINT_FILES, RASTER_FILES = (".las", ".laz"), (".tif", ".tiff", ".asc")


def kind_of(path: str) -> str:
    """pointcloud or raster, by suffix."""
    name = path.lower()
    if name.endswith(POINT_FILES):
        return "pointcloud"
    if name.endswith(RASTER_FILES):
        return "raster"
    raise ValueError(f"neither a point cloud nor a raster: {path}")


def open_any(spark: SparkSession, path: str) -> DataFrame:
    return read_las(spark, path) if kind_of(path) == "pointcloud" else read_grid(spark, path)


def read_points(spark: SparkSession, path: str, box: tuple | None = None) -> DataFrame:
    """Points from Parquet; bounds (minx, miny, maxx, maxy) are pushed into the scan."""
    out = spark.read.parquet(path)
    if box:
        out = out.filter(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))
    return out


def write_points(points: DataFrame, path: str) -> None:
    points.write.parquet(path)


def read_cells(spark: SparkSession, path: str, raster_id: str | None = None, nodata: float | None = schema.NODATA) -> DataFrame:
    out = spark.read.parquet(path).withColumn("value", schema.canonical(F.col("value"), nodata))
    return out.filter(F.col("raster_id") == raster_id) if raster_id is not None else out


def write_cells(cells: DataFrame, path: str, by: tuple = ()) -> None:
    """Values as 32-bit floats; a folder for each polygon or raster instead of a file."""
    writer = cells.withColumn("value", F.col("value").cast("float")).write
    (writer.partitionBy(*by) if by else writer).parquet(path)


def _las(data: bytes) -> pd.DataFrame:
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    offset, form, size, n = struct.unpack_from("<I", data, 96)[0], data[104], struct.unpack_from("<H", data, 105)[0], struct.unpack_from("<I", data, 107)[0]
    if form & 0x80:
        raise ValueError("compressed point clouds are not read")
    if data[25] >= 4:
        n = struct.unpack_from("<Q", data, 247)[0]
    scale, shift = np.frombuffer(data, "<f8", 3, 131), np.frombuffer(data, "<f8", 3, 155)
    rows = np.frombuffer(data, np.uint8, n * size, offset).reshape(n, size)
    at = lambda i, kind: rows[:, i : i + np.dtype(kind).itemsize].copy().view(kind).ravel()
    xyz = [at(4 * i, "<i4") * scale[i] + shift[i] for i in range(3)]
    classes = rows[:, 16] if form >= 6 else rows[:, 15] & 31
    time = at(22, "<f8") if form >= 6 else at(20, "<f8") if form in (1, 3, 4, 5) else np.full(n, np.nan)
    return pd.DataFrame({"x": xyz[0], "y": xyz[1], "z": xyz[2], "gps_time": time, "classification": classes.astype("int32")})


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, gps_time, classification and survey (the file's name); a file a task."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                out = _las(content)
                for i in range(0, len(out), 1_000_000):
                    yield out.iloc[i : i + 1_000_000].assign(survey=name.rsplit("/", 1)[-1])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    points = files.mapInPandas(decode, schema.POINTS)
    return points.withColumn("gps_time", F.when(~F.isnan("gps_time"), F.col("gps_time")))


def _ascii_grid(data: bytes) -> tuple[np.ndarray, tuple, float]:
    head, rest = {}, io.StringIO(data.decode("ascii"))
    while True:
        place = rest.tell()
        line = rest.readline().split()
        if len(line) == 2 and re.match(r"[A-Za-z]", line[0]):
            head[line[0].lower()] = float(line[1])
        else:
            rest.seek(place)
            break
    size, rows = head["cellsize"], int(head["nrows"])
    left = head.get("xllcorner", head.get("xllcenter", size / 2) - size / 2)
    low = head.get("yllcorner", head.get("yllcenter", size / 2) - size / 2)
    values = np.array(rest.read().split(), float).reshape(rows, int(head["ncols"]))
    return values, (size, left, -size, low + rows * size), head.get("nodata_value", schema.NODATA)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that widen one code early."""
    out, table, width, last = [], [], 9, None
    bits, held, place = 0, 0, 0
    while True:
        while held < width:
            if place >= len(data):
                return b"".join(out)
            bits, held, place = (bits << 8 | data[place]) & 0xFFFFFFFF, held + 8, place + 1
        code = bits >> (held - width) & ((1 << width) - 1)
        held -= width
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            width = 9 + (len(table) > 510) + (len(table) > 1022) + (len(table) > 2046)
        out.append(entry)
        last = entry


def _packed(data: bytes) -> bytes:
    """Runs by counts: 0 to 127 literal, 129 to 255 repeated."""
    out, place = [], 0
    while place < len(data):
        n, place = data[place], place + 1
        if n < 128:
            out.append(data[place : place + n + 1])
            place += n + 1
        elif n > 128:
            out.append(data[place : place + 1] * (257 - n))
            place += 1
    return b"".join(out)


#: Compression codes of the format.
_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packed}


class Tiff:
    """First band of a TIFF of strips or tiles, with its transform, nodata value, EPSG code and time."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if self.order is None or struct.unpack_from(self.order + "H", data, 2)[0] != 42:
            raise ValueError("not a TIFF file")
        place, tags = struct.unpack_from(self.order + "I", data, 4)[0], {}
        kinds = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d"}
        for i in range(struct.unpack_from(self.order + "H", data, place)[0]):
            tag, kind, count, value = struct.unpack_from(self.order + "HHII", data, place + 2 + 12 * i)
            if kind in kinds:
                code = f"{self.order}{count}{kinds[kind]}"
                tags[tag] = struct.unpack_from(code, data, place + 10 + 12 * i if struct.calcsize(code) <= 4 else value)
        self.tags, one = tags, lambda tag, default: tags.get(tag, (default,))[0]
        self.width, self.height, self.bands = one(256, 0), one(257, 0), one(277, 1)
        self.packing, self.predictor, self.apart = one(259, 1), one(317, 1), one(284, 1) == 2
        bits, form = one(258, 1), one(339, 1)
        if self.packing not in _UNPACK or bits not in (8, 16, 32, 64) or form not in (1, 2, 3) or self.predictor not in (1, 2, 3):
            raise ValueError(f"compression {self.packing}, {bits} bits of form {form} or predictor {self.predictor} is not read")
        self.kind = f"{self.order}{'uif'[form - 1]}{bits // 8}"
        sx, sy = tags.get(33550, (1.0, 1.0))[:2]
        tie = tags.get(33922, (0, 0, 0, 0, 0, 0))
        self.transform = (sx, tie[3] - tie[0] * sx, -sy, tie[4] + tie[1] * sy)
        text = lambda tag: one(tag, b"").rstrip(b"\0 ").decode("latin-1") or None
        self.nodata = float(text(42113)) if text(42113) else schema.NODATA
        self.time = text(306)
        keys = tags.get(34735, ())
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        self.epsg, self.vertical = codes.get(3072, codes.get(2048)), codes.get(4096)

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(top row, left column, values) of each tile or strip, cut to the raster."""
        tiled = 324 in self.tags
        high, wide = (self.tags[323][0], self.tags[322][0]) if tiled else (min(self.tags.get(278, (self.height,))[0], self.height), self.width)
        across = -(-self.width // wide)
        down = -(-self.height // high)
        starts, sizes = (self.tags[324], self.tags[325]) if tiled else (self.tags[273], self.tags[279])
        bands = 1 if self.apart else self.bands
        for i, (start, size) in enumerate(zip(starts[: across * down], sizes)):
            top, left = i // across * high, i % across * wide
            body = _UNPACK[self.packing](self.data[start : start + size])
            rows = high if tiled else min(high, self.height - top)
            yield top, left, self._values(body, rows, wide, bands)[: self.height - top, : self.width - left]

    def _values(self, body: bytes, rows: int, wide: int, bands: int) -> np.ndarray:
        kind = np.dtype(self.kind)
        if self.predictor == 3:  # bytes of a row's numbers by significance, as differences
            flat = np.frombuffer(body, np.uint8, rows * wide * bands * kind.itemsize).reshape(rows, -1, bands)
            flat = np.cumsum(flat, 1, np.uint8).reshape(rows, kind.itemsize, wide * bands)
            return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, wide, bands)[:, :, 0].astype(float)
        values = np.frombuffer(body, kind, rows * wide * bands).reshape(rows, wide, bands)
        if self.predictor == 2:
            values = np.cumsum(values, 1, kind.newbyteorder("="))
        return values[:, :, 0].astype(float)


def _blocks(name: str, content: bytes) -> tuple[Iterator[tuple[int, int, np.ndarray]], tuple, float]:
    """Blocks of a grid file, its transform and its nodata value."""
    if name.lower().endswith(".asc"):
        values, transform, nodata = _ascii_grid(content)
        step = max(1, 1_000_000 // values.shape[1])
        return ((top, 0, values[top : top + step]) for top in range(0, values.shape[0], step)), transform, nodata
    tiff = Tiff(content)
    return tiff.blocks(), tiff.transform, tiff.nodata


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells of ASCII or TIFF grids; a file a task, a tile or strip at a time."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                blocks, (a, c, e, f), nodata = _blocks(name, content)
                for top, left, block in blocks:
                    row, col = (x.ravel() for x in np.indices(block.shape))
                    row, col, flat = row + top, col + left, block.ravel()
                    bad = ~np.isfinite(flat) | (flat == nodata)
                    yield pd.DataFrame({"raster_id": name.rsplit("/", 1)[-1], "row": row, "col": col, "x": c + (col + 0.5) * a, "y": f + (row + 0.5) * e, "value": np.where(bad, np.nan, flat)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cells = files.mapInPandas(decode, schema.CELL)
    return cells.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def read_grid_meta(spark: SparkSession, path: str) -> DataFrame:
    """A row a grid file: raster_id, width, height, transform, nodata, horizontal and vertical EPSG code, day of acquisition."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf.path, pdf.content):
                if name.lower().endswith(".asc"):
                    values, transform, nodata = _ascii_grid(content)
                    size, rest = values.shape, (None, None, None)
                else:
                    t = Tiff(content)
                    size, transform, nodata, rest = (t.height, t.width), t.transform, t.nodata, (t.epsg, t.vertical, t.time)
                rows.append((name.rsplit("/", 1)[-1], size[1], size[0], *map(float, transform), float(nodata), *rest))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _META.split(", ")]).astype({"horizontal_epsg": "Int64", "vertical_epsg": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInPandas(describe, _META)
    day = F.to_date(F.regexp_replace(F.left("taken", F.lit(10)), ":", "-"))
    return out.withColumn("acquired", F.when(F.col("taken").rlike(r"^\d{4}[:-]\d{2}[:-]\d{2}"), day)).drop("taken")


_META = "raster_id string, width long, height long, a double, c double, e double, f double, nodata double, horizontal_epsg long, vertical_epsg long, taken string"
_POSITION = "array<double>"
_GEO = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_geojson(spark: SparkSession, path: str, name_field: str | None = None, category: str | None = None) -> DataFrame:
    """Polygons of a GeoJSON file, multipolygons exploded; other and null geometries are dropped."""
    return polygons_of(spark.read.text(path, wholetext=True), name_field, category)


def polygons_of(texts: DataFrame, name_field: str | None = None, category: str | None = None) -> DataFrame:
    """poly_id, name, category and rings from GeoJSON in column value."""
    feature = texts.select(F.posexplode(F.from_json("value", _GEO)["features"]).alias("at", "f")).select("at", "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    feature = feature.filter(F.col("kind").isin("Polygon", "MultiPolygon"))
    one = F.from_json("c", f"array<array<{_POSITION}>>")
    many = F.from_json("c", f"array<array<array<{_POSITION}>>>")
    parts = feature.withColumn("parts", F.when(F.col("kind") == "Polygon", F.array(one)).otherwise(many))
    parts = parts.select("at", "properties", F.posexplode("parts").alias("part", "rings"))
    # a ring's last vertex repeats its first
    ring = lambda r: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    name = F.try_element_at("properties", F.lit(name_field)) if name_field else F.lit(None).cast("string")
    return parts.select((F.col("at") * 1000 + F.col("part")).cast("int").alias("poly_id"), name.alias("name"), F.lit(category).cast("string").alias("category"), F.transform("rings", ring).alias("rings"))


def geojson_polygon(text: str) -> str:
    """A drawn geometry's text if it is a polygon, else an error."""
    import json

    kind = json.loads(text).get("type")
    if kind != "Polygon":
        raise ValueError(f"a polygon is needed, not {kind}")
    return text


_CATALOG = (
    "Datasets array<struct<Dataset:struct<name:string,identifier:struct<propertyID:string,value:string>,"
    "spatialCoverage:struct<additionalProperty:array<struct<name:string,value:string>>>,temporalCoverage:string>>>"
)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return catalog_of(spark.read.text(path, wholetext=True))


def catalog_of(texts: DataFrame) -> DataFrame:
    """Datasets of catalog responses in column value, by start date (unknown last) and name."""
    d = texts.select(F.explode(F.from_json("value", _CATALOG)["Datasets"]).alias("d")).select("d.Dataset.*")
    properties, cover = F.col("spatialCoverage.additionalProperty"), F.col("temporalCoverage")
    start, end = scalars.coverage_dates(cover, F.get_json_object(cover, "$.startDate"), F.get_json_object(cover, "$.endDate"))
    out = d.select(
        "name", F.col("identifier.propertyID").alias("id_type"), scalars.source_class(F.col("name")).alias("data_source"), F.col("identifier.value").alias("property_id"),
        scalars.property_value(properties, "EPSG (Horizontal)").alias("horizontal_epsg"), scalars.property_value(properties, "Vertical Coordinates").alias("vertical_coordinates"),
        scalars.clean_name(F.col("name")).alias("clean_name"), start.alias("start_date"), end.alias("end_date"),
    )
    return out.orderBy(F.asc_nulls_last("start_date"), "name")


def pick(catalog: DataFrame, compare: int, reference: int) -> DataFrame:
    """The rows at two positions of a sorted catalog with the day in the middle of their coverage."""
    from pyspark.sql import Window

    at = catalog.withColumn("at", F.row_number().over(Window.orderBy(F.asc_nulls_last("start_date"), "name")) - 1)
    role = F.when(F.col("at") == compare, "compare").when(F.col("at") == reference, "reference")
    return at.withColumn("role", role).filter("role is not null").withColumn("epoch", scalars.midpoint_date(F.col("start_date"), F.col("end_date"))).drop("at")


def ept_href(texts: DataFrame) -> DataFrame:
    """Location of an octree from catalog items in column value."""
    return texts.select(F.get_json_object("value", "$.assets.ept.href").alias("href"))


def area_of_interest(spark: SparkSession, south: float, north: float, west: float, east: float) -> DataFrame:
    return spark.createDataFrame([(float(south), float(north), float(west), float(east))], "south double, north double, west double, east double")


#: Rows of a registry that may be broadcast.
REGISTRY_ROWS = 100_000


def geoid_grid(names: DataFrame, registry: DataFrame | None = None, alias: str = "alias") -> DataFrame:
    """Grid files of geoid names from ``registry(alias, grid)``, the known ones if none is given: spelled alike without
    blanks and underscores, else in lower case, else the name itself.  Of an alias that is listed twice the smaller grid counts.
    """
    listed = (registry if registry is not None else geoids.registry(names.sparkSession)).groupBy("alias").agg(F.min("grid").alias("grid"))
    near = F.broadcast if listed.limit(REGISTRY_ROWS + 1).count() <= REGISTRY_ROWS else (lambda df: df)
    a = listed.select(F.col("alias").alias("a1"), F.col("grid").alias("g1"))
    b = listed.select(F.col("alias").alias("a2"), F.col("grid").alias("g2"))
    plain = F.regexp_replace(F.lower(alias), "[ _]", "")
    out = names.join(near(a), plain == F.col("a1"), "left").join(near(b), F.lower(alias) == F.col("a2"), "left")
    return out.select(*names.columns, F.coalesce("g1", "g2", alias).alias("grid"))


def dump_catalog(texts: DataFrame, path: str) -> None:
    """Catalog responses in column value as text files."""
    texts.select(F.col("value").cast("string")).write.text(path)


def one_dataset(catalog: DataFrame, name: str | None = None) -> DataFrame:
    """The dataset of a name, else the first by start date; an error if there is none."""
    found = catalog.filter(F.col("name") == name) if name is not None else catalog
    first = found.orderBy(F.asc_nulls_last("start_date"), "name").limit(1)
    if not first.count():
        raise ValueError("the catalog has no such dataset")
    return first
