"""From files to records: whole files by Spark's own reader, so any store works, decoded in Arrow batches.

Here a file is decoded by one task, and many files spread over many tasks; the modules of shape files, GeoJSON and GML cut large
ones into ranges first.  Records come out as they are decoded, BATCH at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fnmatch import fnmatch
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from terrane.functions import geometry

#: Records and vertices of one Arrow batch at most; it may hold many files' records.
BATCH, VERTICES = 2000, 500_000
_FIELDS = "record_number long, geometry struct<type:string,parts:array<array<struct<x:double,y:double>>>>, attributes map<string,struct<kind:string,text:string,num:double,bool:boolean>>"
RECORDS = f"path string, {_FIELDS}, layer string"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_VALUE = pa.struct([("kind", pa.string()), ("text", pa.string()), ("num", pa.float64()), ("bool", pa.bool_())])
_ARROW = pa.schema([
    ("path", pa.string()), ("record_number", pa.int64()), ("geometry", pa.struct([("type", pa.string()), ("parts", pa.list_(pa.list_(_POINT)))])),
    ("attributes", pa.map_(pa.string(), _VALUE)), ("layer", pa.string()),
])
NUMBER = re.compile(r"[+-]?(?:inf(?:inity)?|nan|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)", re.I | re.A)

#: (type, parts) with parts as lists of (x, y); no geometry is ("Null", None).
Geometry = tuple[str, list | None]
NO_GEOMETRY: Geometry = ("Null", None)


def text(v: str) -> dict:
    return {"kind": "text", "text": v}


def number(v: float) -> dict:
    return {"kind": "numeric", "num": v}


def date(v: str) -> dict:
    return {"kind": "date", "text": v}


def logical(v: bool) -> dict:
    return {"kind": "logical", "bool": v}


NOTHING = {"kind": "null"}


def number_or_text(s: str) -> dict:
    s = s.strip()
    if not s:
        return NOTHING
    return number(float(s)) if NUMBER.fullmatch(s) else text(s)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (path, number, (kind, parts), attributes, layer); coordinates and attributes go in as flat columns with offsets."""
    paths, numbers, geometries, attributes, layers = zip(*rows, strict=True)
    there = [parts is not None for _, parts in geometries]
    parts = [p for _, of in geometries for p in of or ()]
    sizes, n_parts = [len(p) for p in parts], [len(of or ()) for _, of in geometries]
    xy = np.concatenate([np.zeros((0, 2)), *(np.asarray(p, np.float64).reshape(-1, 2) for p in parts)])
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(_POINT))
    lines = pa.ListArray.from_arrays(_offsets(sizes), points)
    shapes = pa.ListArray.from_arrays(_offsets(n_parts), lines, mask=pa.array([not t for t in there]))
    values = [v for of in attributes for v in of.values()]
    items = pa.StructArray.from_arrays([pa.array([v.get(f.name) for v in values], f.type) for f in _VALUE], fields=list(_VALUE))
    return pa.RecordBatch.from_arrays([
        pa.array(paths, pa.string()), pa.array(numbers, pa.int64()), pa.StructArray.from_arrays([pa.array([kind for kind, _ in geometries], pa.string()), shapes], fields=list(_ARROW.field("geometry").type)),
        pa.MapArray.from_arrays(_offsets([len(of) for of in attributes]), pa.array([k for of in attributes for k in of], pa.string()), items), pa.array(layers, pa.string()),
    ], schema=_ARROW)


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path as Spark names it; stores other than local ones by their URI."""
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@%"))


def size_of(path: str) -> int:
    store, name = _opened(path)
    return store.get_file_info(name).size


def listed(path: str, pattern: str = "*") -> list[str]:
    """Names of the files in a folder that fit a pattern, or the file itself, in order."""
    store, name = _opened(path)
    root = path[: len(path) - len(name)] if path.endswith(name) else ""
    found = store.get_file_info(name)
    if found.type == fs.FileType.File:
        return [path]
    inside = store.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return sorted(root + f.path for f in inside if f.type == fs.FileType.File and fnmatch(f.base_name, pattern))


def is_there(path: str) -> bool:
    store, name = _opened(path)
    return store.get_file_info(name).type == fs.FileType.File


def read_range(path: str, start: int = 0, size: int | None = None) -> bytes:
    """size bytes from start, fewer where the file ends; all the rest without size.  Called within tasks."""
    store, name = _opened(path)
    with store.open_input_file(name) as f:
        left = max(f.size() - start, 0)
        return f.read_at(left if size is None else min(size, left), start) if left else b""


def output(path: str) -> pa.NativeFile:
    """A file to write to, with the folders that lead to it."""
    store, name = _opened(path)
    store.create_dir(name.rpartition("/")[0])
    return store.open_output_stream(name)


def write(path: str, data: bytes) -> str:
    """Writes a file and gives its path.  Called within tasks."""
    with output(path) as f:
        f.write(data)
    return path


def pieces(path: str, size: int = 8 << 20) -> Iterator[bytes]:
    """A file's bytes, so many at a time."""
    store, name = _opened(path)
    with store.open_input_stream(name) as f:
        while data := f.read(size):
            yield data


def move(path: str, to: str) -> None:
    store, name = _opened(path)
    store.move(name, _opened(to)[1])


def remove_folder(path: str) -> None:
    store, name = _opened(path)
    if store.get_file_info(name).type == fs.FileType.Directory:
        store.delete_dir(name)


def dealt(rows: DataFrame) -> DataFrame:
    """A small table of pieces of work, dealt over all tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def mapped(rows: DataFrame, make: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """make()'s rows for each row of a small table of pieces of work, dealt over all tasks."""
    kinds = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for made in make(row):
                    yield pa.RecordBatch.from_pylist([made], kinds)

    return dealt(rows).mapInArrow(run, schema)


def own_or_fold(own: DataFrame, records: DataFrame) -> DataFrame:
    """path, x_min .. y_max: own's box (path, own) of a file where it has one, else the box around its records, folded by path."""
    ends, inf = (("x_min", F.min, 1), ("y_min", F.min, 1), ("x_max", F.max, -1), ("y_max", F.max, -1)), float("inf")
    box = records.select("path", geometry.bbox(F.col("geometry")).alias("box"))
    folded = box.groupBy("path").agg(*(f(F.col("box")[n]).alias(n) for n, f, _ in ends))
    return own.join(folded, "path", "left").select("path", *(F.coalesce(F.col("own")[n], F.col(n), F.lit(sign * inf)).alias(n) for n, _, sign in ends))


def decoded(files: DataFrame, decode: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """Records of each row of files (path and contents); decode(row) gives (geometry, attributes, layer) one by one.

    Numbers begin at 1, or at a row's own column first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for row in range(batch.num_rows):
                    file = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                    for k, record in enumerate(decode(file), file.get("first", 1)):
                        yield file["path"], k, *record

        yield from batched(each())

    return files.mapInArrow(run, RECORDS)


def batched(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Records of (path, number, geometry, attributes, layer) in batches of a bounded size."""
    rows, vertices = [], 0
    for r in records:
        rows.append(r)
        vertices += sum(map(len, r[2][1] or ()))
        if len(rows) == BATCH or vertices >= VERTICES:
            yield batch_of(rows)
            rows, vertices = [], 0
    if rows:
        yield batch_of(rows)
