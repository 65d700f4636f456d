"""Shape files with their attribute tables (.shp, .dbf, and .shx, .prj, .cpg where they are there).

Decisions: a deleted table row takes its shape with it; stored boxes are not used; without a known .cpg label text is
Shift_JIS as Windows has it; the table's declared header size counts.
"""

from __future__ import annotations

import codecs
import struct
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from terrane import errors
from terrane.functions.geometry import bbox, intersects
from terrane.sources import files

#: Codes of shape kinds in file headers.
KINDS = {0: "Null", 1: "Point", 3: "Polyline", 5: "Polygon", 8: "MultiPoint", 11: "PointZ", 13: "PolylineZ", 15: "PolygonZ", 21: "PointM", 23: "PolylineM", 25: "PolygonM", 31: "MultiPatch"}
COMPANIONS = ("dbf", "shx", "prj", "cpg")
DEFAULT_ENCODING = "cp932"
#: Bytes that hold any table's header, and bytes of shapes and rows that one task decodes at a time.
HEAD, RANGE = 65_600, 32 << 20


def _need(data: bytes, start: int, size: int) -> None:
    if start < 0 or size < 0 or start + size > len(data):
        raise errors.CorruptedFile(f"{size} bytes expected at {start}, the file has {len(data)}")


def header(data: bytes) -> tuple[str, tuple[float, float, float, float]]:
    """(kind of shape, box) of a .shp file."""
    _need(data, 0, 100)
    if struct.unpack_from(">i", data)[0] != 9994:
        raise errors.CorruptedFile("not a shape file: wrong file code")
    version, kind = struct.unpack_from("<2i", data, 28)
    if version != 1000:
        raise errors.CorruptedFile(f"unknown version {version}")
    if kind not in KINDS:
        raise errors.UnsupportedShapeType(str(kind))
    return KINDS[kind], struct.unpack_from("<4d", data, 36)


def _points(data: bytes, start: int, n: int) -> np.ndarray:
    _need(data, start, 16 * n)
    return np.frombuffer(data, "<f8", 2 * n, start).reshape(n, 2)


def shapes(data: bytes, at: int = 100) -> Iterator[files.Geometry]:
    """Geometries in file order; each record's declared length leads to the next one."""
    while at < len(data):
        _need(data, at, 12)
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        body = at + 8
        _need(data, body, max(size, 4))
        kind = struct.unpack_from("<i", data, body)[0]
        if kind == 0:
            yield files.NO_GEOMETRY
        elif kind == 1:
            yield "Point", [_points(data, body + 4, 1)]
        elif kind == 8:
            _need(data, body, 40)
            yield "MultiPoint", [_points(data, body + 40, struct.unpack_from("<i", data, body + 36)[0])]
        elif kind in (3, 5):
            _need(data, body, 44)
            n_parts, n = struct.unpack_from("<2i", data, body + 36)
            _need(data, body + 44, 4 * n_parts)
            first = struct.unpack_from(f"<{n_parts}i", data, body + 44)
            xy = _points(data, body + 44 + 4 * n_parts, n)
            yield KINDS[kind], [xy[a:b] for a, b in zip(first, [*first[1:], n], strict=False)]
        else:
            raise errors.UnsupportedShapeType(f"{kind} {KINDS.get(kind, '')}".strip())
        at = body + max(size, 4)


def fields(table: bytes) -> tuple[list[tuple[str, str, int, int]], int, int, int]:
    """(name, kind, length, decimals) of each field, rows, header bytes, bytes of a row."""
    _need(table, 0, 33)
    rows, head, size = struct.unpack_from("<IHH", table, 4)
    _need(table, 0, head)
    found = []
    for at in range(32, head - 1, 32):
        if table[at] == 0x0D:
            break
        _need(table, at, 32)
        name, kind = table[at : at + 11].split(b"\0")[0].decode("utf-8", "strict"), chr(table[at + 11])
        if kind not in "CNFDL":
            raise errors.CorruptedFile(f"unknown kind of field {name}: {kind!r}")
        found.append((name, kind, table[at + 16], table[at + 17]))
    if table[32 + 32 * len(found)] != 0x0D:
        raise errors.CorruptedFile("the list of fields has no end mark")
    return found, rows, head, size


def _value(name: str, kind: str, raw: bytes, encoding: str) -> dict:
    if kind == "C":
        try:
            s = raw.decode(encoding).rstrip()
        except UnicodeDecodeError as e:
            raise errors.EncodingError(f"{name}: {e.reason}") from None
        return files.text(s) if s else files.NOTHING
    s = raw.decode("utf-8", "replace").strip()
    if kind == "L":
        mark = raw[:1].upper()
        return files.logical(mark in b"TY") if mark and mark in b"TYFN" else files.NOTHING
    if not s or kind != "D" and not s.strip("*"):
        return files.NOTHING
    if kind == "D":
        return files.date(s)
    if not files.NUMBER.fullmatch(s):
        raise errors.CorruptedFile(f"field {name} is no number: {s!r}")
    return files.number(float(s))


def rows(table: bytes, encoding: str) -> Iterator[dict | None]:
    """Attributes of each row; None for a deleted one."""
    found, n, head, size = fields(table)
    for k in range(n):
        at = head + k * size
        _need(table, at, size)
        deleted, at, out = table[at] == 0x2A, at + 1, {}
        for name, kind, length, _ in found if not deleted else ():
            out[name] = _value(name, kind, table[at : at + length], encoding)
            at += length
        yield None if deleted else out


def encoding_of(label: bytes | None) -> str:
    name = (label or b"").decode("ascii", "replace").strip()
    try:
        found = codecs.lookup(f"cp{name}" if name.isdigit() and name != "65001" else {"65001": "utf-8"}.get(name, name)).name
    except LookupError:
        return DEFAULT_ENCODING
    return DEFAULT_ENCODING if found == "shift_jis" else found


def _decode(row: dict, encoding: str | None) -> Iterator[tuple]:
    if row["dbf"] is None:
        raise errors.MissingFile(f"{row['path']} has no attribute table")
    header(row["shp"])
    _index(row["shx"])
    yield from _paired(shapes(row["shp"]), rows(row["dbf"], encoding or encoding_of(row["cpg"])))


def _paired(found: Iterator[files.Geometry], table: Iterator[dict | None]) -> Iterator[tuple]:
    for shape in found:
        try:
            attributes = next(table)
        except StopIteration:
            raise errors.CorruptedFile("the attribute table has fewer rows than there are shapes") from None
        if attributes is not None:
            yield shape, attributes, None


def _index(data: bytes | None) -> None:
    if data is not None and data[:4] != struct.pack(">i", 9994):
        raise errors.CorruptedFile("the index has a wrong file code")


def entries_of(index: bytes, size: int) -> np.ndarray | None:
    """(place, bytes of contents) of each record in an index, or None if it doesn't cover a .shp file of this size in order."""
    found = np.frombuffer(index, ">i4", (len(index) - 100) // 8 * 2, 100).reshape(-1, 2).astype(np.int64) * 2
    ends = found.sum(axis=1) + 8
    if not len(ends) or found[0, 0] != 100 or (found[1:, 0] != ends[:-1]).any() or ends[-1] != size or (found[:, 1] < 4).any():
        return None
    return found


def chased(path: str, size: int, block: int = 8 << 20) -> np.ndarray:
    """The same from the records themselves, each one's length leading to the next: for sets without a usable index.

    Contents are passed over; a block is read where the next header isn't in the last one.
    """
    found, at, data, first = [], 100, b"", 0
    while at < size:
        if not first <= at <= first + len(data) - 8:
            data, first = files.read_range(path, at, block), at
        _need(data, at - first, 8)
        length = max(struct.unpack_from(">i", data, at - first + 4)[0] * 2, 4)
        if at + 8 + length > size:
            raise errors.CorruptedFile(f"the record at {at} goes beyond the file's {size} bytes")
        found.append((at, length))
        at += 8 + length
    return np.array(found, np.int64).reshape(-1, 2)


def cuts_of(found: np.ndarray, row_size: int, at_most: int) -> list[int]:
    """Numbers of the records, from 0, at which ranges of about at_most bytes of shapes and rows begin, and of the end."""
    total = np.cumsum(found[:, 1] + 8 + row_size)
    return [*np.flatnonzero(np.diff(total // at_most, prepend=-1)).tolist(), len(found)]


def _ranges(row: dict, at_most: int) -> Iterator[dict]:
    """Ranges of a set that one task each decodes: bytes of the .shp file, rows of the table, and the number of the first record.

    Deleted rows have no number, so all rows' marks are counted, a range at a time.  A table of fewer rows than shapes is
    decoded whole, as that tells where they end.
    """
    if row["dbf"] is None:
        raise errors.MissingFile(f"{row['path']} has no attribute table")
    header(files.read_range(row["path"], 0, 100))
    index = files.read_range(row["shx"]) if row["shx"] else None
    _index(index)
    _, n, head, row_size = fields(files.read_range(row["dbf"], 0, HEAD))
    size = files.size_of(row["path"])
    whole = {"path": row["path"], "dbf": row["dbf"], "cpg": row["cpg"], "start": 100, "end": size, "row": 0, "n_rows": n, "first": 1, "next": None}
    if size <= at_most:
        yield whole
        return
    found = entries_of(index, size) if index else None
    if found is None:
        found = chased(row["path"], size)
    if len(found) > n:
        yield whole
        return
    cuts = cuts_of(found, row_size, at_most)
    starts, first = [*found[cuts[:-1], 0].tolist(), size], 1
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        marks = np.frombuffer(files.read_range(row["dbf"], head + a * row_size, (b - a) * row_size), np.uint8)[:: max(row_size, 1)]
        after = first + int((marks != 0x2A).sum())
        last = k == len(cuts) - 2
        yield whole | {"start": starts[k], "end": starts[k + 1], "row": a, "n_rows": b - a, "first": first, "next": None if last else after}
        first = after


def _decode_range(row: dict, encoding: str | None) -> Iterator[tuple]:
    label = files.read_range(row["cpg"]) if row["cpg"] else None
    head = files.read_range(row["dbf"], 0, HEAD)
    _, _, size, row_size = fields(head)
    body = files.read_range(row["dbf"], size + row["row"] * row_size, row["n_rows"] * row_size)
    # A table of these rows only.
    table = head[:4] + struct.pack("<I", row["n_rows"]) + head[8:size] + body
    yield from _paired(shapes(files.read_range(row["path"], row["start"], row["end"] - row["start"]), 0), rows(table, encoding or encoding_of(label)))


def _mapped(df: DataFrame, make: Callable[[dict], Iterable[dict]], schema: str, types: list) -> DataFrame:
    """make()'s rows for each row of df, which is dealt over all tasks first: it holds names of files, not their bytes."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(make(row)), pa.schema(types))

    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """One row a set: path (of the .shp file), and each companion's path.  path: a .shp file, a folder or a pattern of them.

    Only names are read and grouped.
    """
    stem = path[:-4] if path.endswith(".shp") else path.rstrip("/") + "/*"
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{shp,{','.join(COMPANIONS)}}}").load(f"{stem}.*").select("path")
    named = names.select(F.regexp_extract("path", r"^(.*)\.([^./]*)$", 1).alias("base"), F.regexp_extract("path", r"\.([^./]*)$", 1).alias("ext"), "path")
    one = named.groupBy("base").agg(*(F.max(F.when(F.col("ext") == e, F.col("path"))).alias(e) for e in ("shp", *COMPANIONS)))
    return one.where("shp is not null").withColumnRenamed("shp", "path").drop("base")


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """The sets of a path with the beginnings of their files, as much as metadata_of() needs."""
    import pyarrow as pa

    def run(row: dict) -> Iterator[dict]:
        part = lambda name, size=None: files.read_range(row[name], 0, size) if row[name] else None
        yield {"path": row["path"], "shp": part("path", 100), "dbf": part("dbf", HEAD), "shx": None, "prj": part("prj"), "cpg": part("cpg")}

    return _mapped(_listed(spark, path), run, "path string, shp binary, dbf binary, shx binary, prj binary, cpg binary", [("path", pa.string()), *((c, pa.binary()) for c in ("shp", *COMPANIONS))])


def read_sets(sets: DataFrame, encoding: str | None = None) -> DataFrame:
    """The records of sets held in a table: path and the bytes of shp, dbf, shx, prj, cpg, null for a file that isn't there."""
    return files.decoded(sets.select("path", "shp", *COMPANIONS), lambda row: _decode(row, encoding))


def _planned(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """The ranges of the sets of a path."""
    return files.mapped(_listed(spark, path), lambda row: _ranges(row, range_bytes), _PART)


_PART = "path string, dbf string, cpg string, start long, end long, row long, n_rows long, first long, next long"


def zone_map(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The ranges of the sets of a path with the box around each one's vertices, null without any, and odd, whether NaN is among them.

    Boxes come from the vertices, as the stored ones may say anything.  Write it as a table to have it for many reads.
    """

    def boxed(row: dict) -> Iterator[dict]:
        low, high, odd = np.full(2, np.inf), np.full(2, -np.inf), False
        for _, parts in shapes(files.read_range(row["path"], row["start"], row["end"] - row["start"]), 0):
            for p in parts or ():
                if len(p):
                    odd |= bool(np.isnan(p).any())
                    low, high = np.fmin(low, np.fmin.reduce(p)), np.fmax(high, np.fmax.reduce(p))
        box = dict(zip(("x_min", "y_min", "x_max", "y_max"), [*low.tolist(), *high.tolist()], strict=True)) if low[0] <= high[0] else None
        yield row | {"box": box, "odd": odd}

    return files.mapped(_planned(spark, path, range_bytes), boxed, f"{_PART}, box struct<x_min:double,y_min:double,x_max:double,y_max:double>, odd boolean")


def zones_within(zones: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The ranges of a zone map that may hold shapes whose envelopes meet a box; NaN is apart from nothing."""
    return zones.where(F.col("odd") | intersects(F.col("box"), *box))


def read_zones(zones: DataFrame, box: tuple[float, float, float, float], encoding: str | None = None) -> DataFrame:
    """The records whose envelopes meet a box, from the ranges of a zone map that may hold such."""
    chosen = zones_within(zones, box).select(*(F.col(c.split()[0]) for c in _PART.split(", ")))
    return files.decoded(files.dealt(chosen), lambda row: _decode_range(row, encoding)).where(intersects(bbox(F.col("geometry")), *box))


def read_shapefile(spark: SparkSession, path: str, encoding: str | None = None, numbers: tuple[int, int] | None = None, range_bytes: int = RANGE) -> DataFrame:
    """The records of one set or of many; encoding goes before what the .cpg files say.

    A set is decoded in ranges of range_bytes, each by a task of its own that reads its part of the files; where they begin tells
    the index, or the records where no index covers them.  numbers: the first and last record_number wanted; ranges without them aren't opened.
    """
    found = _planned(spark, path, range_bytes)
    if numbers:
        found = found.where((F.col("first") <= numbers[1]) & (F.col("next").isNull() | (F.col("next") > numbers[0])))
    out = files.decoded(found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), lambda row: _decode_range(row, encoding))
    return out.where(F.col("record_number").between(*numbers)) if numbers else out


def sets_in(path: str) -> list[dict]:
    """path (of the .shp file) and companions of the sets in a folder, of a pattern in one, or of one .shp file."""
    folder, _, name = path.rpartition("/")
    if path.endswith(".shp") or any(c in name for c in "*?["):
        pattern = name if name.endswith(".shp") else f"{name}.shp"
    else:
        folder, pattern = path.rstrip("/"), "*.shp"
    out = []
    for shp in files.listed(folder, pattern):
        companions = {e: f"{shp[:-4]}.{e}" for e in COMPANIONS}
        out.append({"path": shp} | {e: f if files.is_there(f) else None for e, f in companions.items()})
    if not out:
        raise errors.MissingFile(f"no shape file at {path}")
    return out


class Part(InputPartition):
    """One range of a set."""


class Reader(DataSourceReader):
    """Reads ranges that may hold a wanted record_number; Spark applies all filters again, so none is lost."""

    def __init__(self, options: dict):
        self.path, self.encoding = options["path"], options.get("encoding")
        self.range_bytes = int(options.get("rangeBytes", RANGE))
        self.low, self.high = 1, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("record_number",) and not isinstance(v := getattr(f, "value", None), bool):
                low = high = None
                if isinstance(f, EqualTo):
                    low = high = v
                elif isinstance(f, In):
                    low, high = (min(v), max(v)) if (v := [x for x in f.value if x is not None]) else (1, 0)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low = v + isinstance(f, GreaterThan)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    high = v - isinstance(f, LessThan)
                self.low = self.low if low is None else max(self.low, low)
                self.high = self.high if high is None else high if self.high is None else min(self.high, high)
            yield f

    def partitions(self) -> list[Part]:
        """Ranges of all sets; headers, indexes and the marks of deleted rows are read here, several sets at a time."""
        with ThreadPoolExecutor(8) as pool:
            found = pool.map(lambda s: list(_ranges(s, self.range_bytes)), sets_in(self.path))
        wanted = lambda r: (self.high is None or r["first"] <= self.high) and (r["next"] is None or r["next"] > self.low)
        return [Part(r) for of in found for r in of if wanted(r)]

    def read(self, partition: Part | None) -> Iterator:
        if partition is None:  # no range is wanted
            return
        r = partition.value
        yield from files.batched((r["path"], k, *record) for k, record in enumerate(_decode_range(r, self.encoding), r["first"]))


class Shapefile(DataSource):
    """spark.read.format("shapefile"): options path, encoding and rangeBytes; register() makes it known.

    Sets are planned on the driver, so read_shapefile(), which plans them in tasks, suits very many sets better.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return files.RECORDS

    def reader(self, schema) -> Reader:
        if "path" not in self.options:
            raise errors.MissingFile("no path is given")
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes format("shapefile") known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shapefile)


def declared(spark: SparkSession, path: str) -> dict[str, bool]:
    """Fields of the tables' headers and whether they are numeric, for the checks of filters and describe_field().

    Headers only come to the driver, each distinct list of fields once; sets with different lists give all of their fields.
    """
    lists = metadata(spark, path).select("fields").distinct().toLocalIterator()
    return {f.name: f.type in "NF" for row in lists for f in row.fields}


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """metadata_of() the sets of a path."""
    return metadata_of(_heads(spark, path))


def metadata_of(sets: DataFrame) -> DataFrame:
    """path, shape_type, n_records (of the table's header), x_min .. y_max, crs_wkt, crs_name, is_geographic, encoding, fields."""
    import pyarrow as pa

    kind = pa.struct([("name", pa.string()), ("type", pa.string()), ("length", pa.int32()), ("decimals", pa.int32())])

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["dbf"] is None:
                    raise errors.MissingFile(f"{row['path']} has no attribute table")
                shape, box = header(row["shp"])
                found, n, *_ = fields(row["dbf"])
                names = [dict(zip(("name", "type", "length", "decimals"), f, strict=True)) for f in found]
                wkt = row["prj"].decode("utf-8", "replace") if row["prj"] is not None else None
                out.append({"path": row["path"], "shape_type": shape, "n_records": n, **dict(zip(("x_min", "y_min", "x_max", "y_max"), box, strict=True)), "crs_wkt": wkt, "encoding": encoding_of(row["cpg"]), "fields": names})
            types = [("path", pa.string()), ("shape_type", pa.string()), ("n_records", pa.int64()), *((c, pa.float64()) for c in ("x_min", "y_min", "x_max", "y_max")), ("crs_wkt", pa.string()), ("encoding", pa.string()), ("fields", pa.list_(kind))]
            yield pa.RecordBatch.from_pylist(out, pa.schema(types))

    schema = "path string, shape_type string, n_records long, x_min double, y_min double, x_max double, y_max double, crs_wkt string, encoding string, fields array<struct<name:string,type:string,length:int,decimals:int>>"
    wkt = F.col("crs_wkt")
    name = F.regexp_extract(wkt, '"([^"]*)"', 1)
    return sets.mapInArrow(run, schema).withColumns({"crs_name": F.when(wkt.contains('"'), name), "is_geographic": F.contains(wkt, F.lit("GEOGCS")) & ~F.contains(wkt, F.lit("PROJCS"))})
