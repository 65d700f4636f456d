"""Mapbox vector tiles.  A tile's place comes from arguments, or from .../z/x/y in its path, so many tiles are one table.

Every layer's features are records, numbered through; the layer's name is the attribute _layer and the column layer.
Several outer rings in one feature give one polygon with all rings.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane import errors
from terrane.functions.geometry import bbox, intersects, tile_bounds
from terrane.sources import files

PLACE = re.compile(r"(\d+)/(\d+)/(\d+)\.[^/]*$")
EXTENT = 4096


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise errors.InvalidMvt("a number is cut off")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & (1 << 64) - 1, at


def _message(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        field, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 2, 5):
            if wire == 2:
                size, at = _varint(data, at)
            else:
                size = 8 if wire == 1 else 4
            if at + size > len(data):
                raise errors.InvalidMvt("a field is cut off")
            value, at = data[at : at + size], at + size
        else:
            raise errors.InvalidMvt(f"unknown wire type {wire}")
        if not field:
            raise errors.InvalidMvt("field number zero")
        yield field, wire, value


def _numbers(wire: int, value: int | bytes) -> list[int]:
    """Packed or single unsigned numbers of 32 bits."""
    if wire == 0:
        return [value & 0xFFFFFFFF]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(n & 0xFFFFFFFF)
    return out


def _string(value) -> str:
    if not isinstance(value, bytes):
        raise errors.InvalidMvt("text expected")
    try:
        return value.decode()
    except UnicodeDecodeError as e:
        raise errors.InvalidMvt(str(e)) from None


def unzigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def attribute(data: bytes) -> dict:
    """Where several members are set: text, double, float, int, unsigned, signed, then logical."""
    got = {field: value for field, _, value in _message(data)}
    if 1 in got:
        return files.text(_string(got[1]))
    readers = ((3, lambda v: struct.unpack("<d", v)[0]), (2, lambda v: struct.unpack("<f", v)[0]), (4, _signed), (5, int), (6, unzigzag))
    for field, read in readers:
        if field in got:
            return files.number(float(read(got[field])))
    return files.logical(bool(got[7])) if 7 in got else files.NOTHING


class Tile:
    def __init__(self, z: int, x: int, y: int):
        self.x, self.y, self.n = x, y, 2.0**z

    def place(self, px: float, py: float, extent: int) -> tuple[float, float]:
        lon = (self.x + px / extent) / self.n * 360 - 180
        return lon, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (self.y + py / extent) / self.n))))


def commands(numbers: list[int]) -> Iterator[tuple[int, tuple[int, int] | None]]:
    """(command, cursor) for each step of a feature's geometry; closing a path has no cursor."""
    at = x = y = 0
    while at < len(numbers):
        command, times = numbers[at] & 7, numbers[at] >> 3
        at += 1
        if command == 7:
            yield 7, None
            continue
        if command not in (1, 2):
            raise errors.InvalidMvt(f"unknown command {command}")
        if at + 2 * times > len(numbers):
            raise errors.InvalidMvt("a geometry is cut off")
        for at in range(at, at + 2 * times, 2):
            x, y = x + unzigzag(numbers[at]), y + unzigzag(numbers[at + 1])
            yield command, (x, y)
        at += 2 if times else 0


def geometry(kind: int, numbers: list[int], tile: Tile, extent: int) -> files.Geometry:
    on_map = lambda path: [tile.place(x, y, extent) for x, y in path]
    allowed = {1: (1,), 2: (1, 2), 3: (1, 2, 7)}.get(kind, ())
    if not allowed:
        return files.NO_GEOMETRY
    paths, open_path = [], []
    for command, xy in commands(numbers):
        if command not in allowed:
            raise errors.InvalidMvt(f"command {command} in a geometry of kind {kind}")
        if command == 7:
            paths.append([*open_path, *open_path[:1]])
            open_path = []
            continue
        if kind == 2 and command == 1 and open_path:
            paths.append(open_path)
            open_path = []
        open_path.append(xy)
    if kind == 1:
        return ("Point" if len(open_path) == 1 else "MultiPoint"), [on_map(open_path)]
    if kind == 2:
        return "Polyline", [on_map(p) for p in [*paths, open_path] if p]
    return ("Polygon", [on_map(p) for p in paths]) if paths else files.NO_GEOMETRY


class Layer:
    def __init__(self, data: bytes):
        self.name, self.extent, self.features, self.keys, self.values = None, EXTENT, [], [], []
        for field, _, value in _message(data):
            if field == 1:
                self.name = _string(value)
            elif field == 2:
                self.features.append(value)
            elif field == 3:
                self.keys.append(_string(value))
            elif field == 4:
                self.values.append(attribute(value))
            elif field == 5:
                self.extent = value & 0xFFFFFFFF
        if self.name is None:
            raise errors.InvalidMvt("a layer without its name")


def layers(data: bytes) -> Iterator[Layer]:
    for field, wire, value in _message(data):
        if field == 3:
            if wire != 2:
                raise errors.InvalidMvt("a layer expected")
            yield Layer(value)


def records(data: bytes, z: int, x: int, y: int) -> Iterator[tuple]:
    tile = Tile(z, x, y)
    for layer in layers(data):
        for feature in layer.features:
            tags, kind, numbers = [], 0, []
            for field, wire, value in _message(feature):
                if field == 2:
                    tags += _numbers(wire, value)
                elif field == 3:
                    kind = value
                elif field == 4:
                    numbers += _numbers(wire, value)
            pairs = zip(tags[::2], tags[1::2], strict=False)
            attributes = {layer.keys[k]: layer.values[v] for k, v in pairs if k < len(layer.keys) and v < len(layer.values)}
            yield geometry(kind, numbers, tile, layer.extent), attributes | {"_layer": files.text(layer.name)}, layer.name


def _place(path: str, tile: tuple[int, int, int] | None) -> tuple[int, int, int]:
    if tile is not None:
        return tile
    found = PLACE.search(path or "")
    if not found:
        raise errors.InvalidMvt(f"no tile given, and none in the path {path}")
    return tuple(map(int, found.groups()))


def read_mvt(spark: SparkSession, path: str, tile: tuple[int, int, int] | None = None, box: tuple[float, float, float, float] | None = None, margin: float = 1.0) -> DataFrame:
    """tile: (z, x, y) of all files; None: each file's own, from its path.

    box: only records whose envelopes meet it, as the filter by a box gives them; files are opened only where their tile, widened
    on each side by `margin` of its size, meets it, so features may lie that far outside of their tile.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if box is None:
        return read_tiles(found, tile)
    chosen = within(found.select("path"), box, tile, margin)
    read = files.decoded(files.dealt(chosen), lambda f: records(files.read_range(f["path"]), *_place(f["path"], tile)))
    return read.where(intersects(bbox(F.col("geometry")), *box))


def within(paths: DataFrame, box: tuple[float, float, float, float], tile: tuple[int, int, int] | None = None, margin: float = 1.0) -> DataFrame:
    """The paths of the tiles that may hold something within a box.  One without a place is kept, as reading it tells what is wrong."""
    at = F.struct(*(F.lit(v).alias(n) for v, n in zip(tile, "zxy", strict=True))) if tile else place(F.col("path"))
    b = tile_bounds(at["z"], at["x"], at["y"])
    wide, high = (b["x_max"] - b["x_min"]) * margin, (b["y_max"] - b["y_min"]) * margin
    # Rows of a tile are higher towards the equator: half as high again covers the next one's.
    more = F.struct((b["x_min"] - wide).alias("x_min"), (b["y_min"] - high * 1.5).alias("y_min"), (b["x_max"] + wide).alias("x_max"), (b["y_max"] + high * 1.5).alias("y_max"))
    return paths.where(at.isNull() | intersects(more, *box))


def read_tiles(tiles: DataFrame, tile: tuple[int, int, int] | None = None) -> DataFrame:
    """The records of tiles held in a table with path and content."""
    return files.decoded(tiles.select("path", "content"), lambda f: records(f["content"], *_place(f["path"], tile)))


def place(path: Column) -> Column:
    """z, x and y of a tile's path; null where it has none."""
    number = lambda k: F.regexp_extract(path, PLACE.pattern, k).cast("int")
    return F.when(path.rlike(PLACE.pattern), F.struct(*(number(k).alias(n) for k, n in enumerate("zxy", 1))))


def bounds(spark: SparkSession, path: str, tile: tuple[int, int, int] | None = None) -> DataFrame:
    """path, z, x, y, x_min .. y_max: the tile's own box, whatever its features are."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    at = F.struct(*(F.lit(v).alias(n) for v, n in zip(tile, "zxy", strict=True))) if tile else place(F.col("path"))
    return found.select("path", at.alias("at")).select("path", "at.*", tile_bounds(F.col("at.z"), F.col("at.x"), F.col("at.y")).alias("box")).select("path", "z", "x", "y", "box.*")


def layer_names(spark: SparkSession, path: str) -> DataFrame:
    """layer_names_of() the files of a path."""
    return layer_names_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def layer_names_of(tiles: DataFrame) -> DataFrame:
    """path, layers: in file order, repeats and layers without features included."""

    def run(batches):
        for batch in batches:
            names = [[x.name for x in layers(c)] for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(names, pa.list_(pa.string()))], ["path", "layers"])

    return tiles.select("path", "content").mapInArrow(run, "path string, layers array<string>")


#: Feature codes of road centre lines.
ROAD_CENTERLINE = (2701, 2702, 2703, 2704)


def in_layers(df: DataFrame, names: list[str] | None = None, ft_codes: list[int] | None = None) -> DataFrame:
    """Records of the named layers and with one of the feature codes; None accepts all."""
    if names is not None:
        df = df.where(F.col("layer").isin(names))
    if ft_codes is not None:
        code = F.col("attributes")["ftCode"]
        whole = F.when(F.isnan(code["num"]), 0).otherwise(code["num"].try_cast("long"))
        df = df.where((code["kind"] == "numeric") & whole.isin(list(ft_codes)))
    return df


def road_centerline(df: DataFrame) -> DataFrame:
    return in_layers(df, ft_codes=list(ROAD_CENTERLINE))
