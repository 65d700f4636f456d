"""Shape files and vector tiles built from rows, in a table's binary columns, for queries that read a format back."""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from terrane.sources import files

#: Codes of the kinds of shapes built here.
_CODES = {"Null": 0, "Point": 1, "Polyline": 3, "Polygon": 5, "MultiPoint": 8}


def flat_parts(g: Column) -> Column:
    """A geometry's parts as arrays of x, y, x, y ..."""
    return F.transform(g["parts"], lambda part: F.flatten(F.transform(part, lambda p: F.array(p["x"], p["y"]))))


def _shape(kind: str, parts: list) -> bytes:
    code, xy = struct.pack("<i", _CODES[kind]), [float(v) for p in parts for v in p]
    if kind == "Null":
        return code
    numbers = struct.pack(f"<{len(xy)}d", *xy)
    if kind == "Point":
        return code + numbers
    head = code + struct.pack("<4d", *[0.0] * 4)
    if kind == "MultiPoint":
        return head + struct.pack("<i", len(xy) // 2) + numbers
    firsts = [sum(len(p) for p in parts[:k]) // 2 for k in range(len(parts))]
    return head + struct.pack(f"<2i{len(parts)}i", len(parts), len(xy) // 2, *firsts) + numbers


def shape_sets(df: DataFrame, fields: list[tuple[str, str, int]], wkt: str) -> DataFrame:
    """One set for each k, of rows in order of id: kind, parts (flat) and cells (text), one for each (name, type, length)."""
    row = 1 + sum(size for *_, size in fields)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        bodies = [_shape(kind, [] if parts is None else list(parts)) for kind, parts in zip(pdf["kind"], pdf["parts"], strict=True)]
        body = b"".join(struct.pack(">2i", k, len(b) // 2) + b for k, b in enumerate(bodies, 1))
        code = max(_CODES[k] for k in pdf["kind"])
        flat = [p for parts in pdf["parts"] if parts is not None for p in parts]
        xs, ys = ([float(v) for p in flat for v in p[i::2]] or [0.0] for i in (0, 1))
        head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + size // 2) + struct.pack("<2i8d", 1000, code, min(xs), min(ys), max(xs), max(ys), *[0.0] * 4)
        shp, shx, at = head(len(body)) + body, head(8 * len(bodies)), 100
        for b in bodies:
            shx += struct.pack(">2i", at // 2, len(b) // 2)
            at += 8 + len(b)
        names = b"".join(n.encode().ljust(11, b"\0") + t.encode() + bytes(4) + bytes([size, 0]) + bytes(14) for n, t, size in fields)
        fields_head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(pdf), 33 + len(names), row) + names + b"\r"
        cells = [b" " + b"".join((c or "").encode().ljust(size) for c, (*_, size) in zip(line, fields, strict=True)) for line in pdf["cells"]]
        one = {"path": f"set-{pdf['k'].iloc[0]}.shp", "shp": shp, "dbf": fields_head + b"".join(cells), "shx": shx, "prj": wkt.encode(), "cpg": b"UTF-8"}
        return pd.DataFrame([one])

    chosen = df.select("k", "id", "kind", "parts", F.col("cells").cast("array<string>"))
    return chosen.groupBy("k").applyInPandas(build, "path string, shp binary, dbf binary, shx binary, prj binary, cpg binary")


def written(made: DataFrame, folder: str, columns: dict[str, str]) -> DataFrame:
    """Writes each row's contents into files of a folder, within tasks: columns of bytes by what follows the path's stem.

    A task that is run again writes the same bytes to the same names.  Gives the paths; nothing is written before it is counted.
    """

    def run(batches):
        for batch in batches:
            paths = []
            for row in batch.to_pylist():
                for column, ending in columns.items():
                    if row[column] is not None:
                        stem = row["path"].rpartition(".")[0] if ending else row["path"]
                        paths.append(files.write(f"{folder}/{stem}{ending}", row[column]))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return made.mapInArrow(run, "path string")


def _varint(n: int) -> bytes:
    out = []
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _steps(kind: int, parts: list) -> list[int]:
    """Commands of a geometry: a move to each part's first place, lines to its others, and rings closed."""
    out, x, y = [], 0, 0
    for part in parts:
        places = [(int(part[i]), int(part[i + 1])) for i in range(0, len(part), 2)]
        for k, (px, py) in enumerate(places):
            if k == 0:
                out.append(1 | 1 << 3)
            elif k == 1:
                out.append(2 | len(places) - 1 << 3)
            out += [2 * d if d >= 0 else -2 * d - 1 for d in (px - x, py - y)]
            x, y = px, py
        if kind == 3:
            out.append(7 | 1 << 3)
    return out


def tiles(df: DataFrame) -> DataFrame:
    """path and content of one tile for each path, of rows in order of id: layer, kind (1 to 3), parts (flat), number and text.

    A feature's attributes are ftCode, from number, and name, from text.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        content = b""
        for name, rows in pdf.sort_values("id").groupby("layer", sort=True):
            values = b"".join(_field(4, _field(4, int(n))) + _field(4, _field(1, t.encode())) for n, t in zip(rows["number"], rows["text"], strict=True))
            features = b""
            for i, (kind, parts) in enumerate(zip(rows["kind"], rows["parts"], strict=True)):
                tags, steps = (b"".join(map(_varint, v)) for v in ((0, 2 * i, 1, 2 * i + 1), _steps(int(kind), list(parts))))
                features += _field(2, _field(2, tags) + _field(3, int(kind)) + _field(4, steps))
            content += _field(3, _field(15, 2) + _field(1, name.encode()) + features + _field(3, b"ftCode") + _field(3, b"name") + values)
        return pd.DataFrame([{"path": pdf["path"].iloc[0], "content": content}])

    chosen = df.select("path", "id", "layer", F.col("kind").cast("int").alias("kind"), "parts", F.col("number").cast("int").alias("number"), "text")
    return chosen.groupBy("path").applyInPandas(build, "path string, content binary")
