"""GML in the profile of Japanese base maps: members with one feature each, positions in the order latitude, longitude.

The prefix "gml" is compared as text.  A feature's own children with text are its attributes.  Malformed positions are
passed over; a feature whose geometry then holds nothing is left out, one without any geometry element is kept.
Every child of a plural featureMembers is a feature of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from terrane import errors
from terrane.sources import files, splitxml

#: Bytes of a file that one task decodes at a time.
RANGE = 32 << 20
MEMBERS = ("featureMember", "featureMembers")
#: Geometry elements by the kind of record; the multi ones hold on to what lies within them.
_LINES, _AREAS = ("LineString", "Curve"), ("Polygon", "Surface")


class Element:
    """tag, local name, whether its prefix is gml, attributes, children, the text after the last child, <a/> or not."""

    def __init__(self, tag: str, attributes: dict[str, str]):
        prefix, _, local = tag.partition(":")
        self.local, self.gml = local or prefix, bool(local) and prefix == "gml"
        self.attributes, self.children, self.text, self.short = attributes, [], "", False

    def walk(self) -> Iterator[tuple[bool, Element]]:
        """(True, element) where one begins and (False, element) where it ends, in document order, without self."""
        for child in self.children:
            yield True, child
            yield from child.walk()
            yield False, child

    def attribute(self, local: str) -> str | None:
        return next((v for k, v in self.attributes.items() if k.rpartition(":")[2] == local), None)


def _elements(data: bytes) -> Iterator[Element]:
    """The document's elements with the prefix gml that are members or the envelope, as each one is complete."""
    parser, open_elements, ready, cdata = expat.ParserCreate(), [], [], []

    def start(tag, attributes):
        e = Element(tag, attributes)
        if open_elements:
            open_elements[-1].text = ""
        open_elements.append(e)

    def end(_):
        e = open_elements.pop()
        at = parser.CurrentByteIndex
        e.short = not e.children and not e.text and data[at - 2 : at] == b"/>"
        whole = e.gml and (e.local in MEMBERS or e.local == "boundedBy")
        inside = any(x.gml and (x.local in MEMBERS or x.local == "boundedBy") for x in open_elements)
        if whole and not inside:
            ready.append(e)
        elif inside:
            open_elements[-1].children.append(e)

    def chars(s):
        if open_elements and not cdata:
            open_elements[-1].text += s

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = lambda: cdata.append(1), cdata.clear
    try:
        for k in range(0, len(data), 1 << 16):
            parser.Parse(data[k : k + (1 << 16)], False)
            yield from ready
            ready.clear()
        parser.Parse(b"", True)
    except expat.ExpatError as e:
        raise errors.InvalidGml(str(e)) from None
    yield from ready


def _numbers(words: list[str]) -> list[float] | None:
    return [float(w) for w in words] if all(files.NUMBER.fullmatch(w) for w in words) else None


def positions(text: str) -> list[tuple[float, float]]:
    """Of pos and posList: latitude and longitude in turn; nothing where a number is bad or one is left over."""
    n = _numbers(text.split())
    return list(zip(n[1::2], n[::2], strict=True)) if n and len(n) % 2 == 0 else []


def one_position(text: str) -> list[tuple[float, float]]:
    n = _numbers(text.split()[:2])
    return [(n[1], n[0])] if n and len(n) == 2 else []


def tuples(text: str) -> list[tuple[float, float]]:
    """Of coordinates: tuples split by ; or white space, numbers by commas."""
    out = []
    for one in text.replace(";", " ").split():
        n = _numbers([w.strip() for w in one.split(",")][:2])
        if not n or len(n) < 2:
            return []
        out.append((n[1], n[0]))
    return out


_READ = {"pos": one_position, "posList": positions, "coordinates": tuples}


def _rings(outer: list | None, inner: list[list]) -> list[list]:
    return [outer, *filter(None, inner)] if outer else []


def feature(e: Element) -> Iterator[tuple]:
    kind, points, lines, areas, outer, inner, side = None, [], [], [], None, [], None
    attributes = {}
    for begins, x in e.walk():
        if not x.gml:
            if x.short and begins and kind is None:
                attributes[x.local] = files.NOTHING
            elif not begins and any(x is c for c in e.children) and x.local != e.local and x.text.strip():
                attributes[x.local] = files.number_or_text(x.text)
            continue
        name = x.local
        if name == "GeometryCollection":
            raise errors.InvalidGml("a collection of geometries is not supported")
        if begins and not x.short:
            if name in ("Point", "MultiCurve", "MultiSurface") or name in _LINES and kind != "MultiCurve" or name in _AREAS and kind != "MultiSurface":
                kind = name
            elif name in ("exterior", "interior"):
                side = name
        elif not begins:
            if name in _READ:
                points += _READ[name](x.text)
            elif name in _LINES and kind == "MultiCurve" and points:
                lines.append(points)
                points = []
            elif name == "LinearRing" and side:
                if side == "exterior":
                    outer = points
                else:
                    inner.append(points)
                points = []
            elif name in ("exterior", "interior"):
                side = None
            elif name in _AREAS and kind == "MultiSurface":
                areas.append(_rings(outer, inner))
                outer, inner = None, []
    found: list[files.Geometry] = []
    if kind is None:
        found = [files.NO_GEOMETRY]
    elif kind == "Point":
        found = [("Point", [points[:1]])] if points else []
    elif kind in _LINES or kind == "MultiCurve":
        parts = [p for p in [*lines, points] if p]
        found = [("Polyline", parts)] if parts else []
    else:
        found = [("Polygon", rings) for rings in [*areas, _rings(outer, inner)] if rings]
    for g in found:
        yield g, attributes, None


def records(data: bytes) -> Iterator[tuple]:
    for member in _elements(data):
        if member.local in MEMBERS:
            for child in member.children:
                if not child.gml and not child.short:
                    yield from feature(child)


def read_gml(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The records of the files of a path; longer ones than range_bytes are cut into ranges, which terrane.sources.splitxml tells of.

    Which files are long is looked up when the table is named, as other readers list theirs.
    """
    found = spark.read.format("binaryFile").load(path)
    long = found.where(F.col("length") > range_bytes).select("path", "length")
    whole = lambda df: files.decoded(df.select("path", "content"), lambda f: records(f["content"]))
    if long.isEmpty():
        return whole(found)
    split = splitxml.Split(long, range_bytes, records)
    rest = found.where(F.col("length") <= range_bytes).select("path", "content").unionByName(found.join(split.others(), "path").select("path", "content"))
    return whole(rest).unionByName(split.read())


def read_gml_strings(df: DataFrame, text_col: str, path_col: str | None = None) -> DataFrame:
    """Documents in a column; path_col names each one."""
    path = F.col(path_col) if path_col else F.lit(None)
    return files.decoded(df.select(path.cast("string").alias("path"), F.col(text_col).cast("binary").alias("content")), lambda f: records(f["content"]))


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """path, x_min .. y_max: a document's envelope, else the box around its records."""
    ends = ("x_min", "y_min", "x_max", "y_max")
    return files.own_or_fold(metadata(spark, path).select("path", F.when(F.col("x_min").isNotNull(), F.struct(*ends)).alias("own")), read_gml(spark, path))


#: Elements whose srsName may name the document's reference system.
_NAMED = ("Envelope", "Point", "MultiCurve", "MultiSurface", *_LINES, *_AREAS)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """metadata_of() the files of a path."""
    return metadata_of(spark.read.format("binaryFile").load(path))


def metadata_of(documents: DataFrame) -> DataFrame:
    """path, srs_name (the first one given), x_min .. y_max of the envelope, or null where a corner is missing."""

    def run(batches):
        for batch in batches:
            out = []
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                srs, corner = None, {}
                for top in _elements(data):
                    for begins, x in top.walk():
                        if begins and x.gml and x.local in _NAMED and srs is None:
                            srs = x.attribute("srsName")
                        if not begins and x.gml and x.local in ("lowerCorner", "upperCorner") and top.local == "boundedBy":
                            corner[x.local] = one_position(x.text)
                low, high = corner.get("lowerCorner"), corner.get("upperCorner")
                box = [*low[0], *high[0]] if low and high else [None] * 4
                out.append({"path": file, "srs_name": srs, **dict(zip(("x_min", "y_min", "x_max", "y_max"), box, strict=True))})
            schema = pa.schema([("path", pa.string()), ("srs_name", pa.string()), *((c, pa.float64()) for c in ("x_min", "y_min", "x_max", "y_max"))])
            yield pa.RecordBatch.from_pylist(out, schema)

    return documents.select("path", "content").mapInArrow(run, "path string, srs_name string, x_min double, y_min double, x_max double, y_max double")
