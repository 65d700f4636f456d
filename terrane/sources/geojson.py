"""GeoJSON documents: collections of features, single features and bare geometries, decoded by Spark's own JSON expressions.

Multi-polygons become one record a polygon; properties that hold lists or objects become compact JSON text, keys in order;
third coordinates are left out; one bad feature fails its document.  Files of more than range_bytes that hold a collection are
decoded in ranges (terrane.sources.splitjson), others whole.  What follows a document's end is not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane.sources import files, splitjson

#: Bytes of a file that one task decodes at a time.
RANGE = 32 << 20
#: Geometry type: how deep its positions lie, and the kind of record it becomes.
TYPES = {"Point": (0, "Point"), "MultiPoint": (1, "MultiPoint"), "LineString": (1, "Polyline"), "MultiLineString": (2, "Polyline"), "Polygon": (2, "Polygon"), "MultiPolygon": (3, "Polygon")}
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_PARTS = "array<array<struct<x:double,y:double>>>"
_VALUE = "struct<kind:string,text:string,num:double,bool:boolean>"
#: Stands before numbers that are quoted while the keys around them are sorted.
_MARK = "\\u0001number:"


def _bad(what: Column | str) -> Column:
    return F.raise_error(F.concat(F.lit("InvalidGeoJson: "), what if isinstance(what, Column) else F.lit(what)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once where use() names it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _position(p: Column) -> Column:
    return F.when((F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull(), F.struct(p[0].alias("x"), p[1].alias("y"))).otherwise(_bad("not a position"))


def _numbers(p: Column) -> Column:
    """The first two members of any values, null where one is no number."""
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.variant_get(v, "$", "double"))
    return F.transform(F.slice(p, 1, 2), number)


def _nested(depth: int, of: Column, each: Callable[[Column], Column]) -> Column:
    """each() of all positions that lie `depth` lists deep; a list that isn't there is an error."""
    if not depth:
        return each(of)
    return F.transform(F.coalesce(of, _bad("coordinates are missing or no list")), lambda x: _nested(depth - 1, x, each))


def _coordinates(text: Column, depth: int) -> Column:
    """Positions in lists, `depth` deep.  Members after the second may be anything; then all are read as values of any kind."""
    kind = lambda leaf: "array<" * (depth + 1) + leaf + ">" * (depth + 1)
    plain = F.from_json(text, kind("double"), _STRICT)
    any_kind = _let(F.from_json(text, kind("variant"), _STRICT), lambda v: _nested(depth, v, _numbers))
    return _let(F.coalesce(plain, any_kind), lambda v: _nested(depth, v, _position))


def _geometries(text: Column) -> Column:
    """The array of geometries that a geometry's text gives: one, or one for each polygon."""
    one = lambda kind, parts: F.struct(F.lit(kind).alias("type"), parts.cast(_PARTS).alias("parts"))

    def typed(g: Column) -> Column:
        made = F.when(F.lit(False), F.array(one("Null", F.lit(None))))
        for name, (depth, kind) in TYPES.items():
            found = _coordinates(g["coordinates"], depth)
            many = F.transform(found, lambda rings: one("Polygon", rings)) if name == "MultiPolygon" else F.array(one(kind, F.array(F.array(found)) if depth == 0 else F.array(found) if depth == 1 else found))
            made = made.when(g["type"] == name, many)
        return made.otherwise(_bad(F.concat(F.lit("unsupported geometry: "), F.coalesce(g["type"], F.lit("none")))))

    return F.when(text.isNull(), F.array(one("Null", F.lit(None)))).otherwise(_let(F.from_json(text, "type string, coordinates string", _STRICT), typed))


def _sorted(text: Column) -> Column:
    """Compact JSON with its keys in order.  Fractions are quoted meanwhile, as values of any kind would lose their ends."""
    tokens = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+|-'), F.lit(0))
    fraction = lambda t: t.rlike("^-?[0-9].*[.eE]")
    quoted = F.array_join(F.transform(tokens, lambda t: F.when(fraction(t), F.concat(F.lit('"' + _MARK), F.lower(t), F.lit('"'))).otherwise(t)), "")
    return F.regexp_replace(F.to_json(F.parse_json(quoted)), '"\\\\u0001number:([^"]*)"', "$1")


def _attributes(text: Column) -> Column:
    """The map of a feature's properties; of a key that is there more than once the last; empty where there are none."""

    def value(key: Column, v: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
        none = F.lit(None)
        made = lambda name, s=none, n=none, b=none: F.struct(F.lit(name).alias("kind"), s.cast("string").alias("text"), n.cast("double").alias("num"), b.cast("boolean").alias("bool"))
        nested = F.element_at(F.from_json(text, "map<string,string>", _STRICT), key)
        return (
            F.when(kind == "STRING", made("text", F.variant_get(v, "$", "string")))
            .when(kind == "VOID", made("null"))
            .when(kind == "BOOLEAN", made("logical", none, none, F.variant_get(v, "$", "boolean")))
            .when(kind.rlike("^(OBJECT|ARRAY)"), made("text", _sorted(nested)))
            .otherwise(made("numeric", none, F.variant_get(v, "$", "double")))
        )

    def last(m: Column) -> Column:
        keys, entries = F.map_keys(m), F.map_entries(m)
        again = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), m).otherwise(F.map_from_entries(again))

    none = F.from_json(F.lit("{}"), f"map<string,{_VALUE}>")
    return F.coalesce(F.transform_values(_let(F.from_json(text, "map<string,variant>", _STRICT), last), value).cast(f"map<string,{_VALUE}>"), none)


def _records(features: Column) -> Column:
    """The array of (geometry, attributes) of an array of features' texts; what is no feature has neither."""

    def one(f: Column) -> Column:
        return _let(_attributes(f["properties"]), lambda a: F.transform(_geometries(f["geometry"]), lambda g: F.struct(g.alias("geometry"), a.alias("attributes"))))

    blank = F.from_json(F.lit("{}"), "geometry string, properties string")
    return F.flatten(F.transform(features, lambda t: _let(F.coalesce(F.from_json(t, "geometry string, properties string", _STRICT), blank), one)))


def _features(text: Column) -> Column:
    """The features of a document, as texts."""

    def dispatch(root: Column) -> Column:
        kind = root["type"]
        listed = F.coalesce(F.from_json(root["features"], "array<string>", _STRICT), _bad("a collection without its features"))
        bare = F.array(F.concat(F.lit('{"geometry":'), text, F.lit("}")))
        broken = root.isNull() | root["_corrupt_record"].isNotNull()
        return F.when(broken, _bad("malformed document")).when(kind == "FeatureCollection", listed).when(kind == "Feature", F.array(text)).when(kind.isNotNull(), bare).otherwise(_bad("a document without a type"))

    return _let(F.from_json(text, "type string, features string, _corrupt_record string", _STRICT), dispatch)


def _decoded(rows: DataFrame, first: Column, features: Column) -> DataFrame:
    """Records of rows with a path: each one's features, numbered from first."""
    each = rows.select("path", first.cast("long").alias("first"), F.posexplode(_records(features)).alias("k", "r"))
    return each.select("path", (F.col("first") + F.col("k")).alias("record_number"), "r.geometry", "r.attributes", F.lit(None).cast("string").alias("layer"))


def read_geojson(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The records of the files of a path.  Which files are long is looked up when the table is named, as other readers list theirs."""
    found = spark.read.format("binaryFile").load(path)
    long = found.where(F.col("length") > range_bytes).select("path", "length")
    whole = found.where(F.col("length") <= range_bytes)
    if long.isEmpty():
        text = found.select("path", F.col("content").cast("string").alias("text"))
        return _decoded(text, F.lit(1), _features(F.col("text")))
    split = splitjson.Split(long, range_bytes)
    rest = whole.select("path", "content").unionByName(found.join(split.others(), "path").select("path", "content"))
    text = rest.select("path", F.col("content").cast("string").alias("text"))
    return _decoded(text, F.lit(1), _features(F.col("text"))).unionByName(_decoded(split.features(), F.col("first"), F.col("features")))


def read_geojson_strings(df: DataFrame, text_col: str, path_col: str | None = None) -> DataFrame:
    """Documents in a column; path_col names each one."""
    rows = df.select(F.col(path_col).cast("string").alias("path") if path_col else F.lit(None).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return _decoded(rows, F.lit(1), _features(F.col("text")))


def root_bbox(text: Column) -> Column:
    """The first four numbers of a document's own box, or null without four."""
    box = F.from_json(F.get_json_object(text, "$.bbox"), "array<double>")
    return F.when(F.size(box) >= 4, F.struct(*(F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x_min", "y_min", "x_max", "y_max")))))


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """path, x_min .. y_max: a document's own box, else the box around its records."""
    documents = spark.read.format("binaryFile").load(path)
    return files.own_or_fold(documents.select("path", root_bbox(F.col("content").cast("string")).alias("own")), read_geojson(spark, path))


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _quoted(s: Column) -> Column:
    inside = F.to_json(F.array(s))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def feature(geometry: Column, attributes: Column) -> Column:
    """A record as the JSON text of a feature."""
    pair = lambda p: F.array(_finite(p["x"]), _finite(p["y"]))
    parts = F.transform(geometry["parts"], lambda part: F.transform(part, pair))
    one, kind = F.get(parts, F.lit(0)), geometry["type"]
    made = lambda name, c: F.concat(F.lit(f'{{"type":"{name}","coordinates":'), F.to_json(c), F.lit("}"))
    shape = (
        F.when(kind == "Point", made("Point", F.get(one, F.lit(0))))
        .when(kind == "MultiPoint", made("MultiPoint", one))
        .when((kind == "Polyline") & (F.size(parts) == 1), made("LineString", one))
        .when(kind == "Polyline", made("MultiLineString", parts))
        .when(kind == "Polygon", made("Polygon", parts))
    )

    def value(v: Column) -> Column:
        x = _finite(v["num"])
        return F.coalesce(F.when(v["kind"].isin("text", "date"), _quoted(v["text"])).when(v["kind"] == "numeric", x.cast("string")).when(v["kind"] == "logical", v["bool"].cast("string")), F.lit("null"))

    items = F.transform(F.array_sort(F.map_keys(attributes)), lambda k: F.concat(_quoted(k), F.lit(":"), value(attributes[k])))
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(shape, F.lit("null")), F.lit(',"properties":{'), F.coalesce(F.array_join(items, ","), F.lit("")), F.lit("}}"))


def write_features(df: DataFrame, path: str) -> None:
    """One feature a line, in parallel."""
    df.select(feature(F.col("geometry"), F.col("attributes")).alias("value")).write.text(path)


def collections(df: DataFrame, by: str = "path") -> DataFrame:
    """by, document: one collection of the records of each value of a column, in order of their numbers, as text.

    A document is one value, so this is for groups that a task can hold; write_features() suits larger ones.
    """
    each = df.select(by, "record_number", feature(F.col("geometry"), F.col("attributes")).alias("f"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_number", "f"))), lambda x: x["f"]), ",")
    return each.groupBy(by).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), listed, F.lit("]}")).alias("document"))


def to_geojson(df: DataFrame, limit: int | None = None, pretty: bool = False) -> str:
    """One collection as a string on the driver, in order of record numbers: for results that a caller means to hold.

    pretty: over several lines, each level two spaces deeper.
    """
    first = df if limit is None else df.where(F.col("record_number") <= limit)
    lines = first.select("record_number", feature(F.col("geometry"), F.col("attributes")).alias("f")).orderBy("record_number")
    text = '{"type":"FeatureCollection","features":[' + ",".join(r.f for r in lines.toLocalIterator()) + "]}"
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False) if pretty else text
