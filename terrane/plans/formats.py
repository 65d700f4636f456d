"""Queries that build files of each format from the tables' rows and read them back, and the SQL of the same rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane.functions import geometry as g
from terrane.operators import records as r
from terrane.plans import encoded
from terrane.sources import geojson, gml, mvt, shapefile

WKT = 'GEOGCS["Plain degrees",DATUM["Ball",SPHEROID["Ball",6371000,0]],UNIT["degree",0.0174532925199433]]'


def _value(name: str) -> Column:
    return F.col("attributes")[name]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(first: int, n: int) -> Column:
    """n vertices of an embedding, from its pair number first."""
    e = F.col("embedding").cast("array<double>")
    return F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda i: g.point(F.get(e, i * 2), F.get(e, i * 2 + 1)))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and, by its remainder by five, no geometry, a point, points, four lines of eight, or a ring with a hole."""
    made = [g.geometry("Point", F.array(_pairs(0, 1))), g.geometry("MultiPoint", F.array(_pairs(0, 6))), g.geometry("Polyline", F.array(*(_pairs(8 * k, 8) for k in range(4)))), g.geometry("Polygon", F.array(_pairs(0, 8), _pairs(8, 4)))]
    kind = F.col("vec_id") % 5
    chosen = F.when(kind == 0, F.struct(F.lit("Null").alias("type"), F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("parts")))
    for k, one in enumerate(made, 1):
        chosen = chosen.when(kind == k, one)
    return _table(spark, sf_dir, "embeddings").select("vec_id", chosen.alias("geometry"))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes in sets of a hundred, with their id."""
    rows = _shapes(spark, sf_dir).select(F.floor(F.col("vec_id") / 100).alias("k"), F.col("vec_id").alias("id"), g.shape_type(F.col("geometry")).alias("kind"), encoded.flat_parts(F.col("geometry")).alias("parts"), F.array(F.col("vec_id").cast("string")).alias("cells"))
    return encoded.shape_sets(rows, [("ID", "N", 12)], WKT)


def _measured(found: DataFrame, vec_id: Column) -> DataFrame:
    """What the geometry measures say of each kind."""
    area, along, polygon = g.polygon_area(F.col("geometry")), g.length(F.col("geometry")), g.shape_type(F.col("geometry")) == "Polygon"
    line = g.shape_type(F.col("geometry")) == "Polyline"
    return found.select(
        vec_id.cast("long").alias("vec_id"), g.shape_type(F.col("geometry")).alias("shape"), F.coalesce(F.when(~g.is_null(F.col("geometry")), g.num_parts(F.col("geometry"))), F.lit(0)).cast("long").alias("n_parts"), F.coalesce(F.when(~g.is_null(F.col("geometry")), g.num_points(F.col("geometry"))), F.lit(0)).cast("long").alias("n_points"),
        F.round(F.when(line | polygon, along), 6).alias("length"), F.round(F.when(polygon, area), 6).alias("area"), F.round(g.bbox(F.col("geometry"))["x_min"], 6).alias("x_min"), F.round(g.bbox(F.col("geometry"))["y_max"], 6).alias("y_max"),
    )


def shapefile_roundtrip(spark, sf_dir):
    return _measured(shapefile.read_sets(_sets(spark, sf_dir)), r.as_number(_value("ID")))


def shapefile_metadata(spark, sf_dir):
    """Rows and reference system of each set."""
    m = shapefile.metadata_of(_sets(spark, sf_dir))
    return m.select("path", "n_records", "crs_name", "is_geographic", "encoding", F.size("fields").cast("long").alias("n_fields"))


def _customer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    day = F.when(key % 3 > 0, F.concat(F.lit("202401"), F.lpad((key % 28 + 1).cast("string"), 2, "0")))
    flag = F.when(key % 4 == 0, "T").when(key % 4 == 1, "f").otherwise("?")
    cells = F.array(key.cast("string"), F.col("c_name"), F.when(key % 5 > 0, F.format_string("%.2f", "c_acctbal")), flag, day)
    parts = F.array(F.array(F.col("c_nationkey").cast("double"), (key % 90).cast("double")))
    rows = c.select(F.floor(key / 100).alias("k"), key.alias("id"), F.lit("Point").alias("kind"), parts.alias("parts"), cells.alias("cells"))
    return encoded.shape_sets(rows, [("KEY", "N", 12), ("NAME", "C", 30), ("BALANCE", "F", 16), ("OK", "L", 1), ("DAY", "D", 8)], WKT)


def _customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapefile.read_sets(_customer_sets(spark, sf_dir))


def _key() -> Column:
    return r.as_number(_value("KEY")).cast("long").alias("c_custkey")


def dbf_types(spark, sf_dir):
    kinds = F.concat_ws(",", *(F.col("attributes")[n]["kind"] for n in ("NAME", "BALANCE", "OK", "DAY")))
    return _customer_records(spark, sf_dir).select(_key(), r.as_text(_value("NAME")).alias("name"), F.round(r.as_number(_value("BALANCE")), 2).alias("balance"), r.as_flag(_value("OK")).alias("ok"), _value("DAY")["text"].alias("day"), kinds.alias("kinds"), r.is_numeric(_value("BALANCE")).alias("has_balance"))


def attr_eq_numeric(spark, sf_dir):
    return _customer_records(spark, sf_dir).where(r.equals(F.col("attributes"), "KEY", r.value("numeric", None, 7), ["KEY"])).select(_key())


def attr_eq_null(spark, sf_dir):
    return _customer_records(spark, sf_dir).where(r.equals(F.col("attributes"), "BALANCE", r.value("null"))).select(_key())


def attr_eq_flag(spark, sf_dir):
    return _customer_records(spark, sf_dir).where(r.equals(F.col("attributes"), "OK", r.value("logical", None, None, True))).select(_key())


def describe_field(spark, sf_dir):
    d = r.describe_field(_customer_records(spark, sf_dir), "BALANCE", {"BALANCE": True})
    return d.select("count", *(F.round(n, 6).alias(n) for n in ("min", "max", "mean", "median")))


def records_limit(spark, sf_dir):
    """The first ten records of each set."""
    return r.first(_customer_records(spark, sf_dir), 10).select("path", _key())


def record_get(spark, sf_dir):
    """The record at index 4 of each set."""
    return r.get(_customer_records(spark, sf_dir), 4).select("path", _key())


def point_distance(spark, sf_dir):
    """Of each customer's point from (10, 20), and whether it lies in a box."""
    at = g.exterior(F.col("geometry"))[0]
    box = F.struct(*(F.lit(float(v)).alias(n) for v, n in ((5, "x_min"), (10, "y_min"), (15, "x_max"), (40, "y_max"))))
    return _customer_records(spark, sf_dir).select(_key(), F.round(g.distance(at, g.point(F.lit(10), F.lit(20))), 6).alias("distance"), g.contains(box, at["x"], at["y"]).alias("inside"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points, lines and triangles, two hundred a tile of level 14, a layer for each segment."""
    key = F.col("c_custkey")
    px, py = (key % 4000).cast("double"), F.col("c_nationkey") * 100.0
    parts = F.when(key % 3 == 0, F.array(F.array(px, py))).when(key % 3 == 1, F.array(F.array(px, py, px + 10, py), F.array(px, py + 5, px, py + 9, px + 3, py + 9)))
    parts = parts.otherwise(F.array(F.array(px, py, px + 20, py, px + 20, py + 30)))
    path = F.format_string("tiles/14/%d/6400.mvt", 9000 + F.floor(key / 200))
    return encoded.tiles(_table(spark, sf_dir, "customer").select(path.alias("path"), key.alias("id"), F.col("c_mktsegment").alias("layer"), (key % 3 + 1).alias("kind"), parts.alias("parts"), (2699 + key % 8).alias("number"), F.col("c_name").alias("text")))


def mvt_roundtrip(spark, sf_dir):
    """Name, kind and first vertex of each feature."""
    at = g.exterior(F.col("geometry"))[0]
    found = mvt.read_tiles(_tiles(spark, sf_dir))
    return found.select(r.as_text(_value("name")).alias("name"), "layer", (_value("_layer")["text"] == F.col("layer")).alias("same_layer"), g.shape_type(F.col("geometry")).alias("shape"), g.num_parts(F.col("geometry")).cast("long").alias("n_parts"), g.num_points(F.col("geometry")).cast("long").alias("n_points"), F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


def layer_filter(spark, sf_dir):
    return mvt.in_layers(mvt.read_tiles(_tiles(spark, sf_dir)), ["BUILDING", "MACHINERY"], [2700, 2705]).select(_value("name")["text"].alias("name"))


def road_centerline(spark, sf_dir):
    return mvt.road_centerline(mvt.read_tiles(_tiles(spark, sf_dir))).select(_value("name")["text"].alias("name"), _value("ftCode")["num"].cast("long").alias("code"))


def tile_layers(spark, sf_dir):
    """Place and layers of each tile."""
    found = mvt.layer_names_of(_tiles(spark, sf_dir))
    return found.select(mvt.place(F.col("path")).alias("at"), F.explode("layers").alias("layer")).select("at.*", "layer").select(*(F.col(c).cast("long").alias(c) for c in "zxy"), "layer")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shape as a document of its own."""
    fields = F.create_map(F.lit("id"), r.value("numeric", None, F.col("vec_id")))
    return _shapes(spark, sf_dir).select("vec_id", geojson.feature(F.col("geometry"), fields).alias("doc"))


def geojson_roundtrip(spark, sf_dir):
    return _measured(geojson.read_geojson_strings(_documents(spark, sf_dir), "doc"), r.as_number(_value("id")))


def multipolygon_expand(spark, sf_dir):
    """One document an order, of one to four triangles; one record a triangle."""
    key = F.col("o_orderkey")
    one = lambda i: F.format_string("[[[%d,0],[%d,1],[%d,1],[%d,0]]]", i, i, i + 1, i)
    many = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), key % 4), one), ",")
    doc = F.concat(F.lit('{"type":"Feature","properties":{"key":'), key.cast("string"), F.lit('},"geometry":{"type":"MultiPolygon","coordinates":['), many, F.lit("]}}"))
    found = geojson.read_geojson_strings(_table(spark, sf_dir, "orders").select(doc.alias("doc")), "doc")
    return found.select(r.as_number(_value("key")).cast("long").alias("o_orderkey"), "record_number", g.exterior(F.col("geometry"))[0]["x"].cast("long").alias("x"), F.round(g.polygon_area(F.col("geometry")), 6).alias("area"))


def feature_export(spark, sf_dir):
    """Customers as the text of features."""
    key, fields = F.col("c_custkey"), F.create_map(F.lit("name"), r.value("text", F.col("c_name")), F.lit("big"), r.value("logical", None, None, F.col("c_acctbal") > 5000), F.lit("none"), r.value("null"))
    point = g.geometry("Point", F.array(F.array(g.point(F.col("c_nationkey") + 0.5, key % 90 + 0.25))))
    return _table(spark, sf_dir, "customer").select("c_custkey", geojson.feature(point, fields).alias("feature"))


def gml_roundtrip(spark, sf_dir):
    """Each embedding as a document: four curves, a surface with a hole, or two surfaces, by the remainder by three."""
    e = F.col("embedding").cast("array<double>")
    listed = lambda first, n: F.array_join(F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda i: F.concat_ws(" ", F.get(e, i * 2 + 1).cast("string"), F.get(e, i * 2).cast("string"))), " ")
    within = lambda tags, *inside: F.concat(F.lit("".join(f"<gml:{t}>" for t in tags.split())), *inside, F.lit("".join(f"</gml:{t}>" for t in reversed(tags.split()))))
    curves = within("MultiCurve", *(within("curveMember LineString posList", listed(8 * k, 8)) for k in range(4)))
    surface = lambda first: within("Polygon", within("exterior LinearRing posList", listed(first, 8)), within("interior LinearRing posList", listed(first + 8, 4)))
    surfaces = within("MultiSurface", within("surfaceMember", surface(0)), within("surfaceMember", surface(12)))
    shape = F.when(F.col("vec_id") % 3 == 0, curves).when(F.col("vec_id") % 3 == 1, surface(0)).otherwise(surfaces)
    doc = F.concat(F.lit('<k:D xmlns:gml="g" xmlns:k="k">'), within("featureMember", F.lit("<k:V><k:id>"), F.col("vec_id").cast("string"), F.lit("</k:id><k:p>"), shape, F.lit("</k:p></k:V>")), F.lit("</k:D>"))
    found = gml.read_gml_strings(_table(spark, sf_dir, "embeddings").select(doc.alias("doc")), "doc")
    return found.select(r.as_number(_value("id")).cast("long").alias("vec_id"), "record_number", g.shape_type(F.col("geometry")).alias("shape"), g.num_parts(F.col("geometry")).cast("long").alias("n_parts"), g.num_points(F.col("geometry")).cast("long").alias("n_points"), F.round(g.length(F.col("geometry")), 6).alias("length"), F.round(g.exterior(F.col("geometry"))[0]["x"], 6).alias("x"))


def gml_metadata(spark, sf_dir):
    """Reference system and envelope of a document a customer."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    doc = F.format_string('<D xmlns:gml="g"><gml:boundedBy><gml:Envelope srsName="EPSG:%d"><gml:lowerCorner>%d %d</gml:lowerCorner><gml:upperCorner>%d %d</gml:upperCorner></gml:Envelope></gml:boundedBy></D>', 4000 + nation, -nation, -nation - 1, key % 90, key % 180)
    return gml.metadata_of(_table(spark, sf_dir, "customer").select(key.cast("string").alias("path"), doc.cast("binary").alias("content")))


def root_bbox(spark, sf_dir):
    """The box that a document itself gives, of its first four numbers, and null of fewer."""
    key = F.col("c_custkey")
    doc = F.format_string('{"type":"FeatureCollection","bbox":[%s],"features":[]}', F.when(key % 2 == 0, F.concat_ws(",", F.lit("-1"), F.lit("-2"), key.cast("string"), F.lit("4"), F.lit("5"), F.lit("6"))).otherwise("1,2,3"))
    box = geojson.root_bbox(doc)
    return _table(spark, sf_dir, "customer").select("c_custkey", *(box[n].alias(n) for n in ("x_min", "y_min", "x_max", "y_max")))


def _folder(spark: SparkSession, tag: str) -> str:
    """A new folder among those that the driver and all executors share; on one machine a temporary one will do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return f"{(at or 'file:///tmp/checkpoints').rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def _set_files(sets: DataFrame) -> str:
    """A folder with the sets' files."""
    at = _folder(sets.sparkSession, "sets")
    encoded.written(sets, at, {n: f".{n}" for n in ("shp", "dbf", "shx", "prj", "cpg")}).count()
    return at


def _file(path: str = "path") -> Column:
    return F.regexp_extract(path, "[^/]*$", 0).alias("path")


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' sets by the data source, in ranges of 4 kB."""
    shapefile.register(spark)
    return spark.read.format("shapefile").option("rangeBytes", 4096).load(_set_files(_customer_sets(spark, sf_dir)))


def shapefile_scan(spark, sf_dir):
    at = g.exterior(F.col("geometry"))[0]
    return _source(spark, sf_dir).select(_file(), "record_number", _key(), r.as_text(_value("NAME")).alias("name"), at["x"].alias("x"), at["y"].alias("y"))


def shapefile_seek(spark, sf_dir):
    """The record at index 40 of each set: the source reads only the ranges that may hold it."""
    return r.get(_source(spark, sf_dir), 40).select(_file(), _key())


def shapefile_header(spark, sf_dir):
    m = shapefile.metadata(spark, _set_files(_sets(spark, sf_dir)))
    return m.select(_file(), "shape_type", "n_records", *(F.round(c, 6).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")))


def shapefile_fields(spark, sf_dir):
    """Fields of the tables' headers and whether they are numeric."""
    m = shapefile.metadata(spark, _set_files(_customer_sets(spark, sf_dir)))
    return m.select(_file(), F.posexplode("fields").alias("k", "f")).select("path", F.col("k").cast("long").alias("k"), "f.name", F.col("f.type").isin("N", "F").alias("is_numeric"), F.col("f.length").cast("long").alias("length"))


def zone_filter(spark, sf_dir):
    """Shapes that meet a box, by the boxes of ranges of 4 kB."""
    zones = shapefile.zone_map(spark, _set_files(_sets(spark, sf_dir)), 4096)
    return shapefile.read_zones(zones, (-0.02, -0.02, 0.02, 0.02)).select(r.as_number(_value("ID")).cast("long").alias("vec_id"))


def _tile_files(spark: SparkSession, sf_dir: str) -> str:
    at = _folder(spark, "tiles")
    encoded.written(_tiles(spark, sf_dir), at, {"content": ""}).count()
    return at


def tile_file_bounds(spark, sf_dir):
    b = mvt.bounds(spark, _tile_files(spark, sf_dir))
    return b.select(*(F.col(c).cast("long").alias(c) for c in "zxy"), *(F.round(c, 6).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")))


def tile_box_filter(spark, sf_dir):
    """Features that meet a box; tiles far from it aren't opened."""
    found = mvt.read_mvt(spark, _tile_files(spark, sf_dir), box=TILE_BOX)
    return found.select(r.as_text(_value("name")).alias("name"))


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and the collection of each hundred customers' points."""
    key, fields = F.col("c_custkey"), F.create_map(F.lit("name"), r.value("text", F.col("c_name")), F.lit("balance"), r.value("numeric", None, F.col("c_nationkey") + 0.5))
    point = g.geometry("Point", F.array(F.array(g.point(F.col("c_nationkey") + 0.5, key % 90 - 0.25))))
    rows = _table(spark, sf_dir, "customer").select(F.floor(key / 100).alias("k"), key.alias("record_number"), point.alias("geometry"), fields.alias("attributes"))
    return geojson.collections(rows, "k")


def collection_export(spark, sf_dir):
    return _collections(spark, sf_dir)


def geojson_bounds(spark, sf_dir):
    """The box around the records of each file, as none gives its own."""
    at = _folder(spark, "collections")
    docs = _collections(spark, sf_dir).select(F.format_string("c-%d.geojson", "k").alias("path"), F.col("document").cast("binary").alias("content"))
    encoded.written(docs, at, {"content": ""}).count()
    return geojson.bounds(spark, at).select(_file(), "x_min", "y_min", "x_max", "y_max")


def records_empty(spark, sf_dir):
    """Whether any customer is of a nation, and of none."""
    c = _customers_by_nation(spark, sf_dir)
    return r.is_empty(c.where("c_nationkey >= 0")).select(F.lit("some").alias("which"), "is_empty").unionByName(r.is_empty(c.where("c_nationkey < 0")).select(F.lit("none").alias("which"), "is_empty"))


def _customers_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")


def zm_bbox(spark, sf_dir):
    """Boxes of points with z, lines with m and rings with z, which become null when exported."""
    e = F.col("embedding").cast("array<double>")
    vertices = lambda n, make: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: make(F.get(e, i * 3), F.get(e, i * 3 + 1), F.get(e, i * 3 + 2)))
    one = {"PointZ": (1, g.point_z), "PolylineM": (8, g.point_m), "PolygonZ": (5, g.point_z)}
    made = [(kind, g.geometry(kind, F.array(vertices(n, make)))) for kind, (n, make) in one.items()]
    rows = _table(spark, sf_dir, "embeddings")
    found = [rows.select("vec_id", F.lit(kind).alias("kind"), g.bbox(shape).alias("b"), F.get_json_object(geojson.feature(shape, F.create_map().cast("map<string,struct<kind:string,text:string,num:double,bool:boolean>>")), "$.geometry").alias("exported")) for kind, shape in made]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("vec_id", "kind", "b.*", "exported")


#: Degrees around some of the tiles.
TILE_BOX = (17.765, 36.586, 17.83, 36.594)

QUERIES = {f.__name__: f for f in (shapefile_scan, shapefile_seek, shapefile_header, shapefile_fields, zone_filter, tile_file_bounds, tile_box_filter, collection_export, geojson_bounds, records_empty, zm_bbox, shapefile_roundtrip, shapefile_metadata, dbf_types, attr_eq_numeric, attr_eq_null, attr_eq_flag, describe_field, records_limit, record_get, point_distance, mvt_roundtrip, layer_filter, road_centerline, tile_layers, geojson_roundtrip, multipolygon_expand, feature_export, gml_roundtrip, gml_metadata, root_bbox)}

# Vertices are numbered from 1; a run of them is given by its first and last.
_V = "(SELECT vec_id, list_transform(range(32), lambda i: embedding[2*i+1]::DOUBLE) xs, list_transform(range(32), lambda i: embedding[2*i+2]::DOUBLE) ys FROM embeddings)"


def _along(first: int, last: int) -> str:
    return f"list_sum(list_transform(range({first}, {last}), lambda i: sqrt((xs[i+1]-xs[i])*(xs[i+1]-xs[i]) + (ys[i+1]-ys[i])*(ys[i+1]-ys[i]))))"


def _area(first: int, last: int) -> str:
    after = f"CASE WHEN i={last} THEN {first} ELSE i+1 END"
    return f"abs(list_sum(list_transform(range({first}, {last}+1), lambda i: xs[i]*ys[{after}] - xs[{after}]*ys[i])) / 2)"


_CURVES = " + ".join(_along(8 * k + 1, 8 * k + 8) for k in range(4))
_KINDS = f"""SELECT vec_id, ['Null','Point','MultiPoint','Polyline','Polygon'][m+1] AS shape, [0,1,1,4,2][m+1]::BIGINT AS n_parts, [0,1,6,32,12][m+1]::BIGINT AS n_points,
 round(CASE m WHEN 3 THEN {_CURVES} WHEN 4 THEN {_along(1, 8)} + {_along(9, 12)} END, 6) AS length, round(CASE m WHEN 4 THEN {_area(1, 8)} - {_area(9, 12)} END, 6) AS area,
 round(CASE WHEN m > 0 THEN list_min(xs[1:[0,1,6,32,12][m+1]]) END, 6) AS x_min, round(CASE WHEN m > 0 THEN list_max(ys[1:[0,1,6,32,12][m+1]]) END, 6) AS y_max FROM (SELECT *, vec_id % 5 AS m FROM {_V})"""
_SET = "concat('set-', c_custkey // 100, '.shp')"
_USED = "(SELECT vec_id, code, list_transform(range(n), lambda i: embedding[2*i+1]::DOUBLE) AS x, list_transform(range(n), lambda i: embedding[2*i+2]::DOUBLE) AS y FROM (SELECT *, [0,1,6,32,12][vec_id % 5 + 1] AS n, [0,1,8,3,5][vec_id % 5 + 1] AS code FROM embeddings))"
_BALANCE = "CASE WHEN c_custkey % 5 > 0 THEN c_acctbal::DOUBLE END"

ORACLES: dict[str, str] = {
    "shapefile_roundtrip": _KINDS,
    "geojson_roundtrip": _KINDS,
    "shapefile_metadata": "SELECT concat('set-', vec_id // 100, '.shp') AS path, count(*) AS n_records, 'Plain degrees' AS crs_name, true AS is_geographic, 'utf-8' AS encoding, 1::BIGINT AS n_fields FROM embeddings GROUP BY vec_id // 100",
    "dbf_types": f"SELECT c_custkey, c_name AS name, round({_BALANCE}, 2) AS balance, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS ok, CASE WHEN c_custkey % 3 > 0 THEN concat('202401', lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0')) END AS day, concat_ws(',', 'text', CASE WHEN c_custkey % 5 > 0 THEN 'numeric' ELSE 'null' END, CASE WHEN c_custkey % 4 < 2 THEN 'logical' ELSE 'null' END, CASE WHEN c_custkey % 3 > 0 THEN 'date' ELSE 'null' END) AS kinds, c_custkey % 5 > 0 AS has_balance FROM customer",
    "attr_eq_numeric": "SELECT c_custkey FROM customer WHERE c_custkey = 7",
    "attr_eq_null": "SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0",
    "attr_eq_flag": "SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0",
    "describe_field": f"SELECT count(b) AS count, round(min(b), 6) AS min, round(max(b), 6) AS max, round(avg(b), 6) AS mean, round(median(b), 6) AS median FROM (SELECT {_BALANCE} AS b FROM customer)",
    "records_limit": f"SELECT {_SET} AS path, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) <= 10",
    "record_get": f"SELECT {_SET} AS path, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) = 5",
    "point_distance": "SELECT c_custkey, round(sqrt((10 - c_nationkey) * (10 - c_nationkey) + (20 - c_custkey % 90) * (20 - c_custkey % 90)), 6) AS distance, c_nationkey BETWEEN 5 AND 15 AND c_custkey % 90 BETWEEN 10 AND 40 AS inside FROM customer",
    "mvt_roundtrip": "SELECT c_name AS name, c_mktsegment AS layer, true AS same_layer, ['Point','Polyline','Polygon'][c_custkey % 3 + 1] AS shape, [1,2,1][c_custkey % 3 + 1]::BIGINT AS n_parts, [1,5,4][c_custkey % 3 + 1]::BIGINT AS n_points, round((9000 + c_custkey // 200 + c_custkey % 4000 / 4096) / 16384 * 360 - 180, 6) AS x, round(degrees(atan(sinh(pi() * (1 - 2 * (6400 + c_nationkey * 100 / 4096) / 16384)))), 6) AS y FROM customer",
    "layer_filter": "SELECT c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 8 IN (1, 6)",
    "road_centerline": "SELECT c_name AS name, 2699 + c_custkey % 8 AS code FROM customer WHERE c_custkey % 8 BETWEEN 2 AND 5",
    "tile_layers": "SELECT DISTINCT 14::BIGINT AS z, 9000 + c_custkey // 200 AS x, 6400::BIGINT AS y, c_mktsegment AS layer FROM customer",
    "multipolygon_expand": "SELECT o_orderkey, i + 1 AS record_number, i AS x, 0.5::DOUBLE AS area FROM (SELECT o_orderkey, unnest(range(o_orderkey % 4 + 1)) AS i FROM orders)",
    "feature_export": """SELECT c_custkey, concat('{"type":"Feature","geometry":{"type":"Point","coordinates":[', c_nationkey, '.5,', c_custkey % 90, '.25]},"properties":{"big":', CASE WHEN c_acctbal > 5000 THEN 'true' ELSE 'false' END, ',"name":"', c_name, '","none":null}}') AS feature FROM customer""",
    "gml_roundtrip": f"""SELECT vec_id, 1::BIGINT AS record_number, CASE m WHEN 0 THEN 'Polyline' ELSE 'Polygon' END AS shape, CASE m WHEN 0 THEN 4 ELSE 2 END::BIGINT AS n_parts, CASE m WHEN 0 THEN 32 ELSE 12 END::BIGINT AS n_points, round(CASE m WHEN 0 THEN {_CURVES} ELSE {_along(1, 8)} + {_along(9, 12)} END, 6) AS length, round(xs[1], 6) AS x FROM (SELECT *, vec_id % 3 AS m FROM {_V})
 UNION ALL SELECT vec_id, 2, 'Polygon', 2, 12, round({_along(13, 20)} + {_along(21, 24)}, 6), round(xs[13], 6) FROM {_V} WHERE vec_id % 3 = 2""",
    "gml_metadata": "SELECT c_custkey::VARCHAR AS path, concat('EPSG:', 4000 + c_nationkey) AS srs_name, (-c_nationkey - 1)::DOUBLE AS x_min, (-c_nationkey)::DOUBLE AS y_min, (c_custkey % 180)::DOUBLE AS x_max, (c_custkey % 90)::DOUBLE AS y_max FROM customer",
    "shapefile_scan": f"SELECT {_SET} AS path, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS record_number, c_custkey, c_name AS name, c_nationkey::DOUBLE AS x, (c_custkey % 90)::DOUBLE AS y FROM customer",
    "shapefile_seek": f"SELECT {_SET} AS path, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) = 41",
    "shapefile_header": f"SELECT concat('set-', vec_id // 100, '.shp') AS path, ['Null','Point','','Polyline','','Polygon','','','MultiPoint'][max(code) + 1] AS shape_type, count(*) AS n_records, round(coalesce(min(list_min(x)), 0), 6) AS x_min, round(coalesce(min(list_min(y)), 0), 6) AS y_min, round(coalesce(max(list_max(x)), 0), 6) AS x_max, round(coalesce(max(list_max(y)), 0), 6) AS y_max FROM {_USED} GROUP BY vec_id // 100",
    "shapefile_fields": f"SELECT DISTINCT {_SET} AS path, k::BIGINT AS k, ['KEY','NAME','BALANCE','OK','DAY'][k+1] AS name, k IN (0, 2) AS is_numeric, [12,30,16,1,8][k+1]::BIGINT AS length FROM customer, range(5) t(k)",
    "zone_filter": f"SELECT vec_id FROM {_USED} WHERE len(x) > 0 AND list_min(x) <= 0.02 AND list_max(x) >= -0.02 AND list_min(y) <= 0.02 AND list_max(y) >= -0.02",
    "tile_file_bounds": "SELECT 14::BIGINT AS z, x, 6400::BIGINT AS y, round(x / 16384 * 360 - 180, 6) AS x_min, round(degrees(atan(sinh(pi() * (1 - 2 * 6401 / 16384)))), 6) AS y_min, round((x + 1) / 16384 * 360 - 180, 6) AS x_max, round(degrees(atan(sinh(pi() * (1 - 2 * 6400 / 16384)))), 6) AS y_max FROM (SELECT DISTINCT 9000 + c_custkey // 200 AS x FROM customer)",
    "tile_box_filter": f"""SELECT name FROM (SELECT c_name AS name, (9000 + c_custkey // 200 + px / 4096) / 16384 * 360 - 180 AS x_min, (9000 + c_custkey // 200 + (px + w) / 4096) / 16384 * 360 - 180 AS x_max,
 degrees(atan(sinh(pi() * (1 - 2 * (6400 + (py + h) / 4096) / 16384)))) AS y_min, degrees(atan(sinh(pi() * (1 - 2 * (6400 + py / 4096) / 16384)))) AS y_max
 FROM (SELECT *, c_custkey % 4000 AS px, c_nationkey * 100 AS py, [0, 10, 20][c_custkey % 3 + 1] AS w, [0, 9, 30][c_custkey % 3 + 1] AS h FROM customer)) WHERE x_min <= {TILE_BOX[2]} AND x_max >= {TILE_BOX[0]} AND y_min <= {TILE_BOX[3]} AND y_max >= {TILE_BOX[1]}""",
    "collection_export": """SELECT c_custkey // 100 AS k, concat('{"type":"FeatureCollection","features":[', string_agg(concat('{"type":"Feature","geometry":{"type":"Point","coordinates":[', c_nationkey, '.5,', CASE WHEN c_custkey % 90 = 0 THEN '-0.25' ELSE concat(c_custkey % 90 - 1, '.75') END, ']},"properties":{"balance":', c_nationkey, '.5,"name":"', c_name, '"}}'), ',' ORDER BY c_custkey), ']}') AS document FROM customer GROUP BY k""",
    "geojson_bounds": "SELECT concat('c-', c_custkey // 100, '.geojson') AS path, min(c_nationkey) + 0.5::DOUBLE AS x_min, min(c_custkey % 90) - 0.25::DOUBLE AS y_min, max(c_nationkey) + 0.5::DOUBLE AS x_max, max(c_custkey % 90) - 0.25::DOUBLE AS y_max FROM customer GROUP BY c_custkey // 100",
    "records_empty": "SELECT 'some' AS which, count(*) = 0 AS is_empty FROM customer WHERE c_nationkey >= 0 UNION ALL SELECT 'none', count(*) = 0 FROM customer WHERE c_nationkey < 0",
    "zm_bbox": "SELECT vec_id, kind, list_min(x) AS x_min, list_min(y) AS y_min, list_max(x) AS x_max, list_max(y) AS y_max, NULL::VARCHAR AS exported FROM (SELECT vec_id, kind, list_transform(range(n), lambda i: embedding[3*i+1]::DOUBLE) AS x, list_transform(range(n), lambda i: embedding[3*i+2]::DOUBLE) AS y FROM embeddings, (VALUES ('PointZ', 1), ('PolylineM', 8), ('PolygonZ', 5)) t(kind, n))",
    "root_bbox": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN -1 END::DOUBLE AS x_min, CASE WHEN c_custkey % 2 = 0 THEN -2 END::DOUBLE AS y_min, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END::DOUBLE AS x_max, CASE WHEN c_custkey % 2 = 0 THEN 4 END::DOUBLE AS y_max FROM customer",
}
